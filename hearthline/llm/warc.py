"""WARC archives, index first.

Every row becomes a WARC/1.1 record: a response with the page, or, where an equal payload of some length is already there, a
revisit that refers to it. Records are gzip members of their own, so one can be read without the others. Before an archive is
written the index is made: archive, offset, length, URL, digest and kind of every record. To read, the wanted rows of
the index are sorted by archive and offset, neighbours are joined into byte ranges, and tasks read ranges, never whole archives.

Compressed records are made once and kept in the shared folder; digests are counted on narrow columns; a record is shuffled
once, to its archive. An archive is written by one task under another name and renamed, so a repeated task does no harm.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import map_arrow
from hearthline.session import ship


@dataclass(frozen=True)
class Settings:
    """``archive_bytes``: about so much in an archive. ``gap``, ``range_bytes``: how ranges of records are joined."""

    date: str = "2024-01-01T00:00:00Z"
    least_revisit: int = 100
    archive_bytes: int = 64 << 20
    gap: int = 64 << 10
    range_bytes: int = 4 << 20
    level: int = 6


def _pack(data: bytes, level: int) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def make_record(page: int | None, url: str | None, size: int, digest: str, payload: bytes | None, refers_to: int | None, s: Settings) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit without (``payload`` None).

    A null URL leaves the target out; blanks and control characters of a URL are percent-encoded.
    """
    kind = "revisit" if payload is None else "response"
    target = None if url is None else "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page} {target} {digest}'.encode('utf-8', 'replace')).hexdigest())}>",
        "WARC-Date": s.date,
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if payload is None else None,
        "X-Refers-To-Page": refers_to,
        "X-Page": page,
        "X-Payload-Length": size,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    return _pack(head.encode("utf-8", "replace") + block + b"\r\n\r\n", s.level)


_MADE = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record binary"


def _responses(pages: DataFrame, s: Settings, id_column: str, url_column: str, html_column: str) -> DataFrame:
    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for page, url, html in zip(*(part.column(k).to_pylist() for k in range(3))):
            payload = (html or "").encode("utf-8", "surrogatepass")
            digest = hashlib.sha256(payload).hexdigest()
            out.append((page, url, len(payload), digest, make_record(page, url, len(payload), digest, payload, None, s)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in _MADE.split(", ")])

    chosen = pages.select(F.col(id_column).cast("bigint"), F.col(url_column).cast("string"), F.col(html_column).cast("string"))
    return map_arrow(chosen, batch, _MADE)


def make_index(records: DataFrame, archives: int, s: Settings) -> DataFrame:
    """(row, archive, offset, length, url, payload_digest, payload_bytes, record_type, page_id, refers_to, revisit).

    Of rows with equal payloads of some length, the one with the smallest page is the response (of rows that agree in that too,
    the first row; if no page has an id, the first row). Digests are counted before they are shuffled, and revisits are found
    by a join that adaptive execution splits, so a payload that a third of the pages share is no burden.
    """
    long = F.col("payload_bytes") >= s.least_revisit
    narrow = records.select("row", "page_id", "url", "payload_bytes", "payload_digest", F.octet_length("record").cast("bigint").alias("full"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    firsts = narrow.where(long).groupBy(F.col("payload_digest").alias("digest")).agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    firsts = firsts.where("copies > 1").select("digest", F.col("first.row").alias("first_row"), F.col("first.page_id").alias("first_page"))
    known = narrow.join(firsts, (F.col("payload_digest") == F.col("digest")) & long, "left")
    kind = F.when(F.col("first_row").isNull() | (F.col("row") == F.col("first_row")), "response").otherwise("revisit")
    known = known.withColumn("record_type", kind).withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("first_page")))
    known = known.withColumn("archive", F.pmod(F.xxhash64("row"), F.lit(archives)).cast("int"))
    columns = ["row", "archive", "page_id", "url", "payload_bytes", "payload_digest", "full", "record_type", "refers_to"]
    known = known.select(*columns)

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        made = [
            make_record(r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], None, r["refers_to"], s) if r["record_type"] == "revisit" else None
            for r in part.to_pylist()
        ]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], [*part.schema.names, "revisit"])

    typed = map_arrow(known, batch, known.limit(0).selectExpr("*", "CAST(NULL AS BINARY) AS revisit").schema)
    typed = typed.withColumn("length", F.coalesce(F.octet_length("revisit").cast("bigint"), F.col("full"))).drop("full")
    own = Window.partitionBy("archive").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return typed.withColumn("offset", F.sum("length").over(own) - F.col("length"))


def archive_name(path: str, archive: int) -> str:
    return f"{path}/archives/{archive:06d}.warc.gz"


def write_archives(
    pages: DataFrame, path: str, settings: Settings = Settings(), id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """Write the index to ``path``/index, then the archives to ``path``/archives; the index is returned.

    ``path``: a URI in a folder that all executors share. There are at least as many archives as shuffle partitions, so that writing
    is parallel. Null html is an empty payload. An empty table gives an empty index and no archive.
    """
    spark, s = pages.sparkSession, settings
    made = _responses(pages, s, id_column, url_column, html_column).withColumn("row", F.monotonically_increasing_id())
    made.write.parquet(f"{path}/records")  # rows are numbered once and for all
    records = spark.read.schema(made.schema).parquet(f"{path}/records")
    size = records.agg(F.sum(F.octet_length("record"))).first()[0] or 0
    archives = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // s.archive_bytes))
    index = make_index(records, archives, s)
    index.write.parquet(f"{path}/index")
    index = spark.read.schema(index.schema).parquet(f"{path}/index")
    # to each record its line of the index: both are dealt by archive and meet in the order of rows
    lines = index.select("archive", "row", F.lit(0).alias("part"), F.coalesce("revisit", F.lit(b"")).alias("body"))
    number = F.pmod(F.xxhash64("row"), F.lit(archives)).cast("int")
    bodies = records.select(number.alias("archive"), "row", F.lit(1).alias("part"), F.col("record").alias("body"))
    dealt = lines.unionByName(bodies).repartition(archives, "archive").sortWithinPartitions("archive", "row", "part")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system = out = name = hidden = None
        current, written, revisit = None, 0, b""

        def close() -> pa.RecordBatch:
            out.close()
            system.move(hidden, name)
            return pa.RecordBatch.from_pydict({"archive": pa.array([current], pa.int32()), "bytes": pa.array([written], pa.int64())})

        for batch in batches:
            for archive, part, body in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if archive != current:
                    if current is not None:
                        yield close()
                    system, name = fs.FileSystem.from_uri(_uri(archive_name(path, archive)))
                    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    hidden = f"{name}.{uuid.uuid4().hex}.part"
                    out = system.open_output_stream(hidden, compression=None)
                    current, written = archive, 0
                if part == 0:
                    revisit = body
                else:
                    out.write(revisit or body)
                    written += len(revisit or body)
        if current is not None:
            yield close()

    done = dealt.mapInArrow(write, "archive int, bytes bigint").agg(F.sum("bytes")).first()[0] or 0
    if done != (index.agg(F.sum("length")).first()[0] or 0):
        raise RuntimeError("the archives do not have the bytes that the index names")
    return index.drop("revisit")


def ranges(index: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(archive, start, stop, records): byte ranges that cover the wanted records.

    Sorted by offset, a record joins the range of the one before it if the gap is small; ranges are cut at multiples of
    ``range_bytes``, so none grows with its archive.
    """
    own = Window.partitionBy("archive").orderBy("offset")
    far = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(own) > s.gap
    cut = F.floor(F.col("offset") / s.range_bytes) != F.lag(F.floor(F.col("offset") / s.range_bytes)).over(own)
    number = F.sum(F.coalesce((far | cut).cast("int"), F.lit(1))).over(own)
    return index.select("archive", "offset", "length").withColumn("range", number).groupBy("archive", "range").agg(
        F.min("offset").alias("start"),
        F.max(F.col("offset") + F.col("length")).alias("stop"),
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"),
    )


READ = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, html string"
_READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("html", pa.string())]
)


def read_records(index: DataFrame, path: str, settings: Settings = Settings(), payloads: bool = True) -> DataFrame:
    """The records of these rows of an index, as written in the archives.

    Executors open the archives by URI. A response whose payload does not have its digest stops the job. ``html`` is null for
    revisits, and for all records unless ``payloads``.
    """
    spark = index.sparkSession
    ship(spark)
    # ranges are dealt out anew: a range is much more to read than its row is to move
    wanted = ranges(index, settings).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive", "range")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                system, name = fs.FileSystem.from_uri(_uri(archive_name(path, row["archive"])))
                with system.open_input_file(name) as source:
                    source.seek(row["start"])
                    data = source.read(row["stop"] - row["start"])
                out = [parse_record(data[r["offset"] - row["start"] :][: r["length"]]) for r in row["records"]]
                if not payloads:
                    out = [{**r, "html": None} for r in out]
                yield pa.RecordBatch.from_pylist(out, schema=_READ)

    return wanted.mapInArrow(read, READ)


def _uri(file: str) -> str:
    """``file:/x`` and plain paths as URIs that every file system library reads."""
    if file.startswith("/"):
        return "file://" + file
    return "file://" + file[5:] if file.startswith("file:/") and not file.startswith("file://") else file


def parse_record(member: bytes) -> dict:
    """Fields of one record; the payload is checked against its digest."""
    record = zlib.decompress(member, 31)
    head, _, block = record.partition(b"\r\n\r\n")
    block = block[:-4]
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if version != "WARC/1.1" or int(fields["Content-Length"]) != len(block):
        raise ValueError(f"no WARC record here: {record[:80]!r}")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    html = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
        html = payload.decode("utf-8", "replace")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"),
        "payload_bytes": number("X-Payload-Length"), "payload_digest": digest, "html": html,
    }
