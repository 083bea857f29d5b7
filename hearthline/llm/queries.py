"""Registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm import extraction, langid, line_dedup, mixing, neardup_vectors, ngram_join, packing, periodic, quality, sharding, toxicity, warc, whitening
from hearthline.llm.common import crc_fold, table
from hearthline.session import work_dir


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.train(documents, table(spark, folder, "labels"))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    first = F.element_at("spans", 1)
    return scored.select(
        "doc_id",
        (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.when(F.size("spans") > 0, first["start"]).alias("first_start"),
        F.when(F.size("spans") > 0, first["end"]).alias("first_end"),
    )


def op2_vector_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup_vectors.near_duplicates(table(spark, folder, "embeddings"))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = langid.train(documents)
    found = langid.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_ring_shards(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.shard(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.quality_rules(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "band")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    found = packing.pack(packing.pieces(table(spark, folder, "documents")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = work_dir(spark, "warc")
    index = warc.write_archives(table(spark, folder, "pages"), path)
    found = warc.read_records(index, path, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.by_component(*whitening.whiten(table(spark, folder, "embeddings")))


def with_run(identifier: object, words: list[bytes]) -> list[bytes]:
    """The words with a run in them where the id's checksum ends in 0, as the contract of ``op12`` has it; a null id has none."""
    h = zlib.crc32(str(identifier).encode()) if identifier is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, folder, "documents"), rewrite=with_run)
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    exponent = F.expr("1000 * best.length div best.period")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    found = line_dedup.kept_text(documents, line_dedup.keep_bitmaps(documents))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_vector_neardup, op3_language, op4_ring_shards, op5_ngram_join, op6_mixing, op7_quality_rules, op8_packing, op9_warc, op10_extraction,
        op11_whitening, op12_periodic_runs, op13_line_dedup,
    )
}

_WORDS = r"'[^\x20\x09-\x0D]+'"

CHECKS: dict[str, str] = {
    "op2_vector_neardup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[64]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        ),
        l AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE array_cosine_similarity(a.e, b.e) >= 0.98
        ),
        r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
        n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
        SELECT c.x AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.x = component_id AS kept FROM c LEFT JOIN n ON c.x = n.x
    """,
    "op5_ngram_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w
            FROM documents WHERE text IS NOT NULL
        ),
        s AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                     ELSE [concat(len(w), ':', array_to_string(w, ' '))] END) AS g
            FROM w WHERE len(w) > 0
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
        SELECT c.x AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM c LEFT JOIN n ON c.x = n.doc_id
    """,
    "op6_mixing": f"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORDS})), 0)::BIGINT AS size,
                (('0x' || md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')))[1:13])::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
            FROM documents
        ),
        t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        k AS (SELECT *, ([5.0::DOUBLE, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2::DOUBLE * source_size AS cap FROM t),
        v AS (
            SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM t)::DOUBLE - coalesce(sum(cap) OVER e, 0)) / ((SELECT sum(weight) FROM k) - coalesce(sum(weight) OVER e, 0)) AS level
            FROM k WINDOW e AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ),
        g AS (SELECT source, source_size, least(cap, (SELECT max(level) FROM v) * weight) AS target FROM v),
        b AS (
            SELECT d.*, g.source_size, g.target, 1::DOUBLE / (1::BIGINT << (length(bin(size)) // 4)) AS w
            FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
        ),
        h AS (SELECT source, any_value(target) AS target, w, sum(size)::BIGINT AS words FROM b WHERE size > 0 GROUP BY source, w),
        i AS (
            SELECT source, (target - 2 * coalesce(sum(words) OVER e, 0)) / (sum(w * words) OVER (PARTITION BY source) - coalesce(sum(w * words) OVER e, 0)) AS level
            FROM h WINDOW e AS (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ),
        c AS (SELECT source, max(level) AS c FROM i GROUP BY source),
        e AS (SELECT b.*, least(2::DOUBLE, coalesce(c.c, 0) * w) AS e FROM b LEFT JOIN c ON b.source IS NOT DISTINCT FROM c.source),
        p AS (SELECT *, floor(e) AS whole, e - floor(e) AS p FROM e),
        q AS (SELECT *, CASE WHEN p > 0 THEN (u * (1 - p)) / (u * (1 - p) + (1 - u) * p) END AS rank, target - sum(whole * size) OVER (PARTITION BY source) AS room FROM p),
        m AS (
            SELECT *, CASE WHEN p > 0 AND size > 0 THEN sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) - size / 2 END AS middle
            FROM q
        )
        SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN (whole + CASE WHEN middle <= room THEN 1 ELSE 0 END) * size ELSE 0 END)::BIGINT AS taken FROM m
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op13_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM d),
        k AS (
            SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ),
        n AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.*, top IS NOT NULL AND doc_id <> top AS dropped FROM k LEFT JOIN n ON k.key = n.key)
        SELECT doc_id, count(*) AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
}
