"""N-gram Jaccard join with a prefix tree.

A document is the set of its word shingles in one global order: shingles that a bounded sample shows to be frequent come last,
the rest by hash. Two sets with a Jaccard similarity of t share one of the first n - ceil(t n) + 1 shingles of each (n: its
size), whatever the order; the order only keeps these prefixes selective.

1. Equal sets are one set. Prefixes are counted per shingle; a shingle with two sets names the smallest as its centre.
2. Candidates are found among sets that share a prefix shingle: each against the centre first, then, for shingles whose sets
   are not all connected yet, those outside the centre's group against all. A pair survives if a sketch of parity bits does not
   prove that the sets differ too much; the sketch never rejects a similar pair. Only a connection is kept, not all pairs.
3. Sets of a candidate group are joined exactly, with a trie: sets in global order share the nodes of common beginnings, a
   probe adds up its overlap along a path once for all sets below, and leaves a subtree when even all remaining shingles could
   not reach the needed overlap. A large group is cut into blocks, each with the group's first set; afterwards only sets that
   are not connected with that one visit the other blocks. No group is gathered in one task, and groups of copies cost linear work.
4. Links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm import wordhash
from hearthline.llm.common import free_name, give_back, map_arrow, stored
from hearthline.llm.components import components, stars
from hearthline.llm.neardup_vectors import _runs
from hearthline.session import ship


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` documents and ``frequent`` shingles bound the table of frequent shingles; it only affects speed.

    ``compare`` sketches are compared with as many others in a piece of work, ``block`` sets with others by a trie.
    """

    width: int = 5
    percent: int = 80
    sample_rows: int = 16_384
    frequent: int = 1 << 18
    block: int = 64
    compare: int = 1024
    remembered: int = 1 << 16


def needed(n: int, m: int, percent: int) -> int:
    """Least overlap of sets of n and m shingles with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1 if n else 0


def in_order(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles in the global order: by how often the sample has them, then by hash."""
    if not len(frequent):
        return shingles
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    return shingles[np.argsort(np.where(frequent[at] == shingles, counts[at], 0), kind="stable")]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each bit; at least as many bits as shingles, a power of two."""
    bits = max(64, 1 << max(0, int(len(shingles) - 1).bit_length()))
    odd = np.bincount((wordhash.mix(shingles) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def may_match(n: int, a: np.ndarray, m: int, b: np.ndarray, percent: int) -> bool:
    """False only if the sets of n and m shingles cannot be similar: differing bits are differing shingles."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    while len(a) != len(b):
        # the longer one folds: a bit's place is taken modulo the number of bits
        if len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= n + m - 2 * needed(n, m, percent)


# ---------------------------------------------------------------- the trie


class Trie:
    """Sets in global order, with common beginnings shared; a path without branches is one node."""

    def __init__(self, sets: list[np.ndarray]):
        # any order that keeps equal beginnings together will do
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = sets
        #: shingles of the edge, depth at its end, children, names of sets that end here, least and greatest size below, parent
        self.root = self._build(order, 0)

    def _build(self, order: list[int], depth: int) -> tuple:
        """Node for sorted sets that agree in their first ``depth`` shingles. Parents come before children; no recursion."""
        steps: list[list] = []
        todo = [(order, depth, -1)]
        while todo:
            names, begin, parent = todo.pop()
            first, last = self.sets[names[0]], self.sets[names[-1]]
            end = min(len(first), len(last))
            differ = np.flatnonzero(first[begin:end] != last[begin:end])
            end = begin + int(differ[0]) if len(differ) else end
            sizes = [len(self.sets[i]) for i in names]
            key = len(steps)
            steps.append([first[begin:end], end, [], [i for i in names if len(self.sets[i]) == end], min(sizes), max(sizes), parent])
            groups: list[list[int]] = []
            for i in names:
                if len(self.sets[i]) > end:
                    if groups and self.sets[groups[-1][0]][end] == self.sets[i][end]:
                        groups[-1].append(i)
                    else:
                        groups.append([i])
            todo.extend((g, end, key) for g in groups)
        for step in reversed(steps):
            if step[6] >= 0:
                steps[step[6]][2].append(step)
        return steps[0]

    def similar(self, probe: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Names of the sets similar to ``probe``. ``skip(name)`` tells that a set is not wanted any more."""
        place = np.argsort(probe)
        sorted_probe = probe[place]
        todo = [(self.root, 0, 0)]
        while todo:
            (edge, end, children, here, low, high, _), overlap, used = todo.pop()
            if 100 * len(probe) < percent * low or 100 * high < percent * len(probe):
                continue
            lost = False
            for begin in range(0, len(edge), 64):
                part = edge[begin : begin + 64]
                at = np.minimum(np.searchsorted(sorted_probe, part), len(sorted_probe) - 1)
                met = at[sorted_probe[at] == part]
                overlap += len(met)
                if len(met):
                    # shingles of the probe up to the last one met cannot be met again
                    used = int(place[met[-1]]) + 1
                depth = end - len(edge) + begin + len(part)
                if overlap + min(len(probe) - used, high - depth) < needed(len(probe), low, percent):
                    lost = True
                    break
            if lost:
                continue
            for name in here:
                if overlap >= needed(len(probe), len(self.sets[name]), percent) and not skip(name):
                    yield name
            todo.extend((c, overlap, used) for c in children)


def join_sets(nodes: list[int], sets: list[np.ndarray], stored_rows: list[int], probes: list[int], percent: int) -> list[tuple[int, int]]:
    """Edges that connect similar sets: probes (positions) against the stored ones. No edge between connected sets."""
    stored_rows = [i for i in stored_rows if len(sets[i])]
    if not stored_rows:
        return []
    trie = Trie([sets[i] for i in stored_rows])
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []
    for i in probes:
        if len(sets[i]):
            for name in trie.similar(sets[i], percent, lambda n, i=i: find(stored_rows[n]) == find(i)):
                j = stored_rows[name]
                if find(i) != find(j):
                    root[find(i)] = find(j)
                    edges.append((nodes[i], nodes[j]))
    return edges


# ---------------------------------------------------------------- the join


def frequent_shingles(documents: DataFrame, s: Settings, text_column: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in two or more of about ``sample_rows`` documents, the most frequent ones, with their counts."""
    total = documents.count()
    if not total:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    share = min(1.0, s.sample_rows / total)
    text = documents.select(F.col(text_column).cast("string").alias("text")).where("text IS NOT NULL")
    # equal texts are drawn together and counted once
    drawn = text.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = list(dict.fromkeys(part.column(0).to_pylist()))
        found, counts = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *wordhash.shingle_sets(texts, s.width)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["shingle", "n"])

    counted = map_arrow(drawn, batch, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1")
    rows = counted.orderBy(F.desc("n"), "shingle").limit(s.frequent).toArrow()
    values = rows.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(values)
    return values[order], rows.column("n").to_numpy()[order]


PROFILE = "doc_id bigint, text_key bigint, n_shingles bigint, low bigint, high bigint, prefix array<bigint>, sketch binary"


def profiles(documents: DataFrame, frequent: tuple[np.ndarray, np.ndarray], s: Settings, id_column: str, text_column: str) -> DataFrame:
    """Size, a 128-bit key of the set, prefix and sketch of every document; the latter two once per set and task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, None] = {}
        for part in batches:
            out: list[tuple] = []
            owners, keys = part.column(0).to_pylist(), part.column(2).to_pylist()
            for owner, key, own in zip(owners, keys, wordhash.shingle_sets(part.column(1).to_pylist(), s.width)):
                low = int(np.bitwise_xor.reduce(wordhash.mix(own ^ np.uint64(0x9E3779B97F4A7C15)))) if len(own) else 0
                high = int(wordhash.mix(own).sum(dtype=np.uint64)) if len(own) else 0
                prefix = bits = None
                if len(own) and low not in seen:
                    seen[low] = None
                    if len(seen) > s.remembered:
                        seen.clear()
                    prefix = in_order(own, *frequent)[: prefix_length(len(own), s.percent)].view(np.int64)
                    bits = sketch(own).tobytes()
                out.append((owner, key, len(own), _signed(low), _signed(high), prefix, bits))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            names = [c.split()[0] for c in PROFILE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)
        give_back()

    ship(documents.sparkSession)
    text = F.col(text_column).cast("string")
    chosen = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return chosen.mapInArrow(each, PROFILE)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _candidates(found: DataFrame, s: Settings) -> DataFrame:
    """(a, b): pairs of sets (by low key) that connect all sets which may be similar, as stars where known. See step 2."""
    bodies = stored(found.where("prefix IS NOT NULL").select(F.col("low").alias("node"), F.col("n_shingles").alias("n"), "sketch").groupBy("node", "n").agg(F.first("sketch").alias("sketch")), "sketches")
    entries = found.where("prefix IS NOT NULL").select(F.col("low").alias("node"), "n_shingles", F.posexplode("prefix").alias("place", "shingle"))
    # a set whose first common shingle is this one cannot be similar to a larger one than that
    most = F.expr(f"CAST((n_shingles - place) * {100 + s.percent} div {s.percent} - n_shingles AS INT)")
    entries = entries.select("node", "shingle", most.alias("most"))
    ends = entries.groupBy("shingle").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last")
    shared = stored(entries.join(ends.select("shingle", "centre"), "shingle"), "shared")
    pairs = shared.where("node <> centre").select("node", "centre").distinct()
    left = pairs.join(bodies, "node")
    both = left.join(bodies.withColumnsRenamed({"node": "centre", "n": "m", "sketch": "other"}), "centre")
    close = stored(_sketched(both, s), "close")
    groups = components(close, "a", "b")
    named = shared.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node")).select("shingle", "node", "centre", "group", "most")
    open_ = named.groupBy("shingle").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 < g1")
    left_over = named.join(open_.select("shingle"), "shingle")
    main = left_over.where("node = centre").select("shingle", F.col("group").alias("main")).distinct()
    rows = left_over.join(main, "shingle").select("shingle", "node", "group", "most", (F.col("group") == F.col("main")).cast("int").alias("late"))
    # read twice below: nested in itself, its plan would have hundreds of nodes, held by the driver again for every stage
    rows = stored(rows.distinct().join(bodies.select("node", "n"), "node"), "open")
    cells = _cells(rows, s)
    return stars(groups, "a", "b").unionByName(_compared(cells.join(bodies.select("node", "sketch"), "node"), s))


def _cells(rows: DataFrame, s: Settings) -> DataFrame:
    """Pieces of work for the sets of open shingles (shingle, node, group, most, late, n): those outside the centre's group
    (``probe``) against all, a block of the ones and a block of the others in each cell.

    Sets are kept by classes of size, of which only neighbours can hold similar sets; classes in which all are connected, and
    those with the same sets as another shingle's, are left out, and so is a set where all of a class are larger than ``most``. However many sets share a shingle, a cell has about ``compare`` of each kind.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / s.percent))).cast("int")
    key = ["shingle", "class"]
    # a set outside is there for its own class, and as a probe for three
    kinds = F.when(F.col("late") == 0, F.array(*[F.struct(F.lit(p).alias("probe"), (size + k).alias("class")) for p, k in ((0, 0), (1, -1), (1, 0), (1, 1))]))
    kinds = F.coalesce(kinds, F.array(F.struct(F.lit(0).alias("probe"), size.alias("class"))))
    both = rows.select("shingle", "node", "group", "n", "most", F.inline(kinds))
    # the smallest size that a set of the class, or one that is compared with the class, can have
    least = F.floor(F.pow(F.lit(100 / s.percent), F.col("class") - F.when(F.col("probe") == 1, 0).otherwise(1)) - 1e-6)
    both = both.where(F.col("most") >= least).drop("most")
    counts = both.groupBy(*key).agg(
        F.ceil(F.sum(1 - F.col("probe")) / s.compare).cast("int").alias("blocks"),
        F.ceil(F.sum("probe") / s.compare).cast("int").alias("of_probes"),
        F.min("group").alias("g0"),
        F.max("group").alias("g1"),
        F.count("*").alias("sets"),
        *[F.bit_xor(F.xxhash64("node", "probe", F.lit(k))).alias(f"x{k}") for k in (1, 2)],
    )
    # sets that share one rare shingle share many: shingles of the very same sets are one piece of work
    work = counts.where("blocks > 0 AND of_probes > 0 AND g0 < g1")
    work = work.groupBy("class", "blocks", "of_probes", "sets", "x1", "x2").agg(F.min("shingle").alias("shingle"))
    open_ = both.join(work.select(*key, "blocks", "of_probes"), key)
    deal = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("probe") == 1, F.col("blocks")).otherwise(F.col("of_probes")) - 1)
    placed = open_.select(*key, "probe", "node", "group", "n", "blocks", "of_probes", F.explode(others).alias("other"))
    i = F.when(F.col("probe") == 1, deal("of_probes")).otherwise(F.col("other"))
    j = F.when(F.col("probe") == 1, F.col("other")).otherwise(deal("blocks"))
    return placed.select(*key, i.alias("i"), j.alias("j"), "probe", "node", "group", "n")


def _compared(cells: DataFrame, s: Settings) -> DataFrame:
    """(a, b): pairs of each cell that their sketches do not tell apart, without those that are connected already."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, kept = None, []
        above: dict[int, int] = {}  # groups that pairs of this cell have connected

        def top(group: int) -> int:
            while group in above:
                group = above[group]
            return group

        for part in batches:
            out = []
            columns = {n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)}
            own_cells = zip(*(columns[c] for c in ("shingle", "class", "i", "j")))
            for own_cell, probe, node, group, n, bits in zip(own_cells, *(columns[c] for c in ("probe", "node", "group", "n", "sketch"))):
                if own_cell != cell:
                    cell, kept = own_cell, []
                    above.clear()
                own = np.frombuffer(bits, dtype=np.uint8)
                if not probe:
                    kept.append((node, group, n, own))
                    continue
                for other, g, m, b in kept:
                    if other != node and 100 * min(n, m) >= s.percent * max(n, m) and top(g) != top(group) and may_match(n, own, m, b, s.percent):
                        out.append((node, other))
                        above[max(top(g), top(group))] = min(top(g), top(group))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        give_back()

    dealt = cells.withColumn("deal", F.xxhash64("shingle", "class", "i", "j")).repartition("deal")
    ordered = dealt.sortWithinPartitions("deal", "shingle", "class", "i", "j", "probe", "node")
    return ordered.mapInArrow(compare, "a bigint, b bigint").distinct()


def _sketched(pairs: DataFrame, s: Settings) -> DataFrame:
    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        columns = {n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)}
        good = [
            may_match(n, np.frombuffer(a, dtype=np.uint8), m, np.frombuffer(b, dtype=np.uint8), s.percent)
            for n, a, m, b in zip(columns["n"], columns["sketch"], columns["m"], columns["other"])
        ]
        kept = part.filter(pa.array(good, pa.bool_()))
        return pa.RecordBatch.from_arrays([kept.column("node"), kept.column("centre")], ["a", "b"])

    return map_arrow(pairs, batch, "a bigint, b bigint")


def _linked(cells: DataFrame, s: Settings) -> DataFrame:
    """Edges from rows (cell, node, probe, kept, body): in each cell, rows with ``probe`` against the trie of rows with ``kept``."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _runs(batches, ("cell", "part")):
            sets = [np.frombuffer(b, dtype=np.uint64) for b in part["body"]]
            rows = range(len(sets))
            edges = join_sets(part["node"], sets, [i for i in rows if part["kept"][i]], [i for i in rows if part["probe"][i]], s.percent)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])
        give_back()

    key = cells.withColumn("__deal", F.xxhash64("cell", "part")).repartition("__deal").sortWithinPartitions("__deal", "cell", "part", "node")
    return key.mapInArrow(join, "a bigint, b bigint")


def jaccard_groups(documents: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, component) of every row; component_id is the smallest doc_id reachable by links.

    Words are lower-cased in A-Z. A text with fewer words than a shingle has its whole sequence as one; a null text or one without
    words has an empty set and is a component of its own. Equal sets are linked. A null id is never the smallest, but links go
    through its text; a component without any id has none, and ``component`` (null for empty sets) tells it apart. Rows that share an id are linked each by its own text. Empty table: no rows.
    """
    s = settings
    ship(documents.sparkSession)
    frequent = frequent_shingles(documents, s, text_column)
    found = stored(profiles(documents, frequent, s, id_column, text_column), "profiles")
    pairs = stored(_candidates(found, s), "candidates")
    groups = stored(components(pairs, "a", "b"), "groups")
    member = _join(documents, found, groups, frequent, s, id_column, text_column)
    some = found.where("n_shingles > 0").groupBy("low", "high", "n_shingles").agg(F.min("doc_id").alias("id"))
    named = some.join(member.withColumnRenamed("node", "low"), "low", "left").withColumn("component", F.coalesce("component", "low"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    known = named.join(least, "component").select(F.col("low").alias("l"), F.col("high").alias("h"), F.col("n_shingles").alias("n"), "component_id", "component")
    on = (F.col("low") == F.col("l")) & (F.col("high") == F.col("h")) & (F.col("n_shingles") == F.col("n"))
    out = found.select("doc_id", "text_key", "n_shingles", "low", "high").join(known, on, "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")


def _join(documents: DataFrame, found: DataFrame, groups: DataFrame, frequent: tuple, s: Settings, id_column: str, text_column: str) -> DataFrame:
    """Step 3: (node, component) by the exact links among the sets of each candidate group."""
    counts = groups.groupBy("component").agg(F.count("*").alias("members"))
    cells = stored(groups.join(counts, "component").withColumn("parts", F.ceil(F.col("members") / s.block).cast("int")), "cells")
    # one document for each set that is in a group: by its id, or by its text where no row of the set has an id
    wanted = found.where("n_shingles > 0").join(groups.select(F.col("node").alias("low")), "low")
    ids = wanted.groupBy("low").agg(F.min("doc_id").alias("id"), F.min(F.when(F.col("doc_id").isNull(), F.col("text_key"))).alias("key"))
    texts = documents.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    named = texts.where("id IS NOT NULL").join(ids.where("id IS NOT NULL").select("id", "low"), "id")
    nameless = texts.where("id IS NULL").withColumn("key", F.xxhash64("text")).groupBy("key").agg(F.first("text").alias("text"))
    nameless = nameless.join(ids.where("id IS NULL").select("key", "low"), "key")
    chosen = named.select("low", "text").unionByName(nameless.select("low", "text"))

    def batch(part: pa.RecordBatch) -> pa.RecordBatch:
        names = part.schema.names
        keys, bodies = [], []
        for key, own in zip(part.column(names.index("low")).to_pylist(), wordhash.shingle_sets(part.column(names.index("text")).to_pylist(), s.width)):
            low = int(np.bitwise_xor.reduce(wordhash.mix(own ^ np.uint64(0x9E3779B97F4A7C15)))) if len(own) else 0
            if _signed(low) == key:  # another row may share the id
                keys.append(key)
                bodies.append(in_order(own, *frequent).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies, pa.binary())], ["node", "body"])

    bodies = stored(map_arrow(chosen.select("low", "text"), batch, "node bigint, body binary"), "bodies")
    placed = bodies.join(cells, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    first = placed.where("node = component").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = placed.where("node <> component").unionByName(first).select(F.col("component").alias("cell"), "part", "node", F.lit(True).alias("probe"), F.lit(True).alias("kept"), "body")
    links = stored(_linked(own, s), "links")
    # sets of large groups that are not connected with the group's first one visit the other blocks
    member = components(links, "a", "b")
    large = cells.where("parts > 1").join(member.withColumnRenamed("component", "linked"), "node", "left").withColumn("linked", F.coalesce("linked", "node"))
    main = large.where("node = component").select("component", F.col("linked").alias("main"))
    apart = stored(large.join(main, "component").where("linked <> main").select("node", "component", "parts"), "apart")
    if apart.isEmpty():
        return member
    # a block of them and a block of the group's sets in each cell
    sizes = apart.groupBy("component").agg(F.ceil(F.count("*") / (4 * s.block)).cast("int").alias("rounds"))
    apart = apart.join(sizes, "component")
    place = F.col("round") * F.col("parts") + F.col("part")
    round_ = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rounds")).cast("int")
    visits = bodies.join(apart, "node").withColumn("round", round_).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hosts = placed.join(sizes, "component").withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    rows = visits.select(F.col("component").alias("cell"), place.alias("part"), "node", F.lit(True).alias("probe"), F.lit(False).alias("kept"), "body").unionByName(
        hosts.select(F.col("component").alias("cell"), place.alias("part"), "node", F.lit(False).alias("probe"), F.lit(True).alias("kept"), "body")
    )
    return components(stars(member, "a", "b").unionByName(_linked(rows, s)), "a", "b")


def keep_one(documents: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``documents`` of which one of each group stays: the one with the group's smallest id.

    Rows without words all stay. Of a group without any id a row with the smallest hash of its text stays. Of rows that agree
    in id and text one stays. Columns of any name come through.
    """
    found = stored(jaccard_groups(documents, settings, id_column, text_column).where("n_shingles > 0"), "kept")
    least = found.where("component_id IS NULL").groupBy("component").agg(F.min("text_key").alias("least"))
    judged = found.join(least, "component", "left")
    stays = F.when(F.col("component_id").isNull(), F.col("text_key") == F.col("least")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    id_, key = free_name(documents, "kept_id"), free_name(documents, "kept_key")
    name = {"doc_id": id_, "text_key": key}
    gone = judged.where(~stays).select("doc_id", "text_key").distinct().withColumnsRenamed(name)
    twice = judged.where(stays).groupBy("doc_id", "text_key").count().where("count > 1").drop("count").withColumnsRenamed(name)
    same = F.col(id_column).cast("bigint").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(text_column).cast("string")) == F.col(key))
    if twice.isEmpty():
        return documents.join(gone, same, "left_anti")
    repeated = documents.join(twice, same, "left_semi").dropDuplicates([id_column, text_column])
    return documents.join(gone.unionByName(twice), same, "left_anti").unionByName(repeated)
