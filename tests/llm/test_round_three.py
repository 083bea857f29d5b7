"""Periodic runs, line dedup and whitening: brute force, and odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hearthline.llm import extraction, langid, line_dedup, mixing, neardup_vectors, ngram_join, packing, periodic, whitening
from hearthline.llm.common import stored
from hearthline.llm.queries import QUERIES, with_run
from tests.llm.test_operators import SMALL, nothing, odd_documents, shingles, smallest_reachable

# ---------------------------------------------------------------- periodic runs


def all_runs(words):
    """Every run by its definition."""
    found, n = [], len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                stretch = words[i : i + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def random_words(rng, letters, n):
    words = []
    while len(words) < n:
        if rng.random() < 0.3:
            period = [rng.randrange(letters) for _ in range(rng.randrange(1, 30))]
            words += (period * 60)[: rng.randrange(5, 140)]
        words += [rng.randrange(letters) for _ in range(rng.randrange(0, 40))]
    return words[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 7, 40, 500])
def test_runs_are_brute_force(letters):
    rng = random.Random(letters)
    some = 0
    for _ in range(60):
        words = random_words(rng, letters, rng.randrange(1, 420))
        expected = all_runs(words)
        some += len(expected)
        assert periodic.find_runs(periodic.number([b"%d" % w for w in words])) == expected
    assert some > 20


def test_runs_at_the_limits():
    for q in range(1, 40):
        for length in (max(24, 3 * q) - 1, max(24, 3 * q), max(24, 3 * q) + q):
            words = [f"a{k}" for k in range(50)] + [f"p{k % q}" for k in range(length)] + [f"b{k}" for k in range(50)]
            expected = [(50, length, q)] if length >= max(24, 3 * q) else []
            assert periodic.find_runs(periodic.number([w.encode() for w in words])) == expected


def test_segments_split_at_rare_words():
    words = ["x", "y"] * 20 + ["once"] + ["x", "z"] * 5 + ["twice"] + ["z", "v"] * 20 + ["twice"]
    found = periodic.segments(periodic.number([w.encode() for w in words]))
    assert found == [(0, 40), (52, 92)]  # the ten words between are too few
    # x is frequent in the text, but rare in the second part: only the recursion splits there
    words = ["x"] * 30 + ["once"] + ["p", "q"] * 15 + ["x"] + ["p", "q"] * 15
    assert periodic.segments(periodic.number([w.encode() for w in words])) == [(0, 30), (31, 61), (62, 92)]


def test_long_run_takes_no_square_of_its_length():
    words = periodic.number([b"a"] * 200_000 + [b"%d" % (k % 3000) for k in range(100_000)])
    # the first word of the second stretch does not belong to the first
    assert periodic.find_runs(words) == [(0, 200_000, 1), (200_000, 100_000, 3000)]


def test_periodic_query_is_brute_force(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(documents)
    planted = 0
    for d in documents:
        words = with_run(d["doc_id"], (d["text"] or "").encode().split())
        if len(words) > 700:
            continue
        runs, row = all_runs(words), rows[d["doc_id"]]
        planted += bool(runs)
        keep = [not any(s + q <= k < s + n for s, n, q in runs) for k in range(len(words))]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert row["n_runs"] == len(runs)
        assert row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for w, k in zip(words, keep) if k)).hexdigest()
        if runs:
            start, length, period = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
            assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == (start, length, period, 1000 * length // period)
        else:
            assert row["start"] is None and row["exponent_milli"] is None
    assert planted > 5


def test_periodic_odd_input(spark):
    found = periodic.periodic_runs(odd_documents(spark)).collect()
    assert len(found) == odd_documents(spark).count()
    long = next(r for r in found if r["doc_id"] == 500)
    assert [tuple(r) for r in long["runs"]] == [(0, 30_000, 1)] and long["collapsed"] == "é" and long["n_words"] == 30_000
    empty = [r for r in found if r["doc_id"] in (1, 2)]
    assert [(r["n_words"], r["runs"], r["best"], r["collapsed"]) for r in empty] == [(0, [], None, "")] * 2
    assert periodic.periodic_runs(nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic.Settings(least_words=10)


# ---------------------------------------------------------------- line dedup


def deduplicated(rows, least=5, points=40):
    """(n_lines, n_dropped, kept) of each (doc_id, text)."""
    holders = defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    rank = lambda i: (i is not None, i)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= points:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least or i == max(holders[key(x)], key=rank)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def line_documents():
    rng = random.Random(3)
    common = "  This line is in very many documents, more than one task holds. "
    shared = [f"shared line number {k} that is long enough to be looked at" for k in range(30)]
    rows = [(None, common), (None, None), (7, ""), (7, f"{common}\n{common.upper()}"), (2_000_000, "ä" * 39), (2_000_001, "x\n" * 30_000 + common)]
    rows += [(100 + k, "é" * 40 + "\t\n" + "e" * 39) for k in range(6)]
    for k in range(3000):
        lines = [common if k % 3 else f"own line {k} which nobody else has written down anywhere"]
        lines += rng.sample(shared, rng.randrange(0, 6)) * rng.choice([1, 1, 2]) + [f"short {k}", ""]
        rng.shuffle(lines)
        rows.append((1000 + k, "\n".join(lines)))
    return rows + rows[50:60]


def test_line_dedup_is_brute_force(spark):
    rows = line_documents()
    frame = spark.createDataFrame([(*r, "n", 1, b"x") for r in rows], "doc_id bigint, text string, id string, at int, bitmap binary").repartition(7)
    bitmaps = line_dedup.keep_bitmaps(frame)
    found = sorted([tuple(r) for r in line_dedup.kept_text(frame, bitmaps).collect()], key=lambda r: (r[0] is not None, r))
    assert found == deduplicated(rows)
    # text does not travel with the records
    assert [c for c, kind in line_dedup.line_records(frame).dtypes if kind == "string"] == []


def test_a_line_spread_over_tasks_is_decided_once(spark):
    rows = [(k, "the same line in every document, spread over all the tasks") for k in range(20_000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        records = line_dedup.line_records(spark.createDataFrame(rows, "doc_id bigint, text string"))
        found = line_dedup.dropped_lines(records)
        assert sorted(r["id"] for r in found.collect()) == list(range(19_999))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_stream_does_not_depend_on_batches(size):
    """Partitions and batches of every size give the same lines."""
    import pyarrow as pa

    rng = random.Random(size)
    records = sorted({(rng.choice([1, 1, 2, 3, 4, 5, 6, 7]), d, at) for d in range(40) for at in range(rng.randrange(3))}, key=lambda r: (r[0], -r[1], r[2]))
    cuts = sorted({0, len(records), *[k for k in range(1, len(records)) if rng.random() < 0.08 and records[k][:2] != records[k - 1][:2]]})
    kinds = defaultdict(list)
    for a, b in zip(cuts, cuts[1:]):
        part = records[a:b]
        schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("id", pa.int64()), ("text_key", pa.int64()), ("n_lines", pa.int32()), ("at", pa.int32())])
        state = line_dedup._Streamed(5, pa.schema([*schema, pa.field("kind", pa.int8()), pa.field("documents", pa.int64())]))
        out = []
        for k in range(0, len(part), size):
            own = part[k : k + size]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([x[c] for x in own], f.type) for c, f in zip((0, 0, 1, 1, 2, 2), schema)], schema=schema
            )
            out += [r for b in state.add(batch) for r in b.to_pylist()]
        out += [r for b in state.close(True) for r in b.to_pylist()]
        assert sum(r["kind"] == 2 for r in out) <= 2
        for r in out:
            kinds[r["kind"]].append(r)
    totals = defaultdict(lambda: [0, -1])
    for r in kinds[2]:
        totals[r["high"]][0] += r["documents"]
        totals[r["high"]][1] = max(totals[r["high"]][1], r["id"])
    dropped = kinds[0] + [r for r in kinds[1] if totals[r["high"]][0] >= 5 and r["id"] != totals[r["high"]][1]]
    documents = defaultdict(set)
    for h, d, _ in records:
        documents[h].add(d)
    expected = [(h, d, at) for h, d, at in records if len(documents[h]) >= 5 and d != max(documents[h])]
    assert sorted((r["high"], r["id"], r["at"]) for r in dropped) == sorted(expected)


def test_line_dedup_odd_input(spark):
    frame = odd_documents(spark)
    found = line_dedup.kept_text(frame, line_dedup.keep_bitmaps(frame))
    assert found.count() == frame.count()
    empty = nothing(spark)
    assert line_dedup.kept_text(empty, line_dedup.keep_bitmaps(empty)).count() == 0
    bits = np.array([1, 0, 1, 1, 0, 1, 1, 1, 0], bool)
    assert (line_dedup.read_bitmap(line_dedup._bitmap(9, [1, 4, 8]), 9) == bits).all()


# ---------------------------------------------------------------- whitening


def test_whitening_is_brute_force(spark):
    rows = QUERIES["op11_whitening"](spark, SMALL).toPandas()
    source = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.floor(256 * np.stack(source["embedding"].map(np.array).to_list()).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(rows) == 4 * len(source) and set(rows["n"]) == {n}
    assert 0 <= rows["identity_error"].iloc[0] <= 1e-4 and rows["identity_error"].nunique() == 1
    for c in range(4):
        own = rows[rows["component"] == c + 1].set_index("vec_id").loc[source["vec_id"]]
        expected = (x - total / n) @ vectors[:, c] / np.sqrt(values[c])
        sign = np.sign(expected @ own["whitened"].to_numpy())
        assert np.allclose(sign * own["whitened"], expected, rtol=1e-6, atol=1e-8)
        assert np.allclose(own["explained"], values[c] / values.sum(), rtol=1e-6)
        assert (own["deviation"].to_numpy() == ((n * x - total) ** 2).sum(axis=1)).all()


def odd_vectors(spark):
    rng = np.random.default_rng(1)
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0, 3.0]), (1, None), (2, []), (3, [1.0, None, 3.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 0.0, 0.0]), (6, [1.0, 2.0])]
    rows += [(10, [1.0, 2.0, 3.0])] * 40 + [(20 + k, [float(v) for v in rng.normal(size=3)]) for k in range(60)] + [(7, [1e300, 0.0, 0.0])]
    return spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id bigint, embedding array<double>, x string, dims int").repartition(5)


def test_whitening_odd_input(spark):
    rows, found = whitening.whiten(odd_vectors(spark))
    assert found.n == 61 and rows.count() == 101  # copies count once; each keeps its row
    got = whitening.by_component(rows, found).toPandas()
    assert sorted(got["component"].unique()) == [1, 2, 3]  # no more than entries
    assert got[got["vec_id"] == 10]["whitened"].round(9).nunique() == 3
    assert got["vec_id"].isna().sum() == 3
    empty, none = whitening.whiten(odd_vectors(spark).limit(0))
    assert none is None and whitening.by_component(empty, none).count() == 0


def test_whitening_without_variance(spark):
    rows, found = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 3, "vec_id bigint, embedding array<float>"))
    got = whitening.by_component(rows, found).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in got] == [(1, 0, None, None)] * 6
    # one direction only: the second component is zero
    line = [(k, [float(k), 2.0 * k]) for k in range(9)]
    rows, found = whitening.whiten(spark.createDataFrame(line, "vec_id bigint, embedding array<float>"))
    got = whitening.by_component(rows, found).where("component = 2").collect()
    assert len(got) == 9 and all(r["whitened"] is None and r["explained"] < 1e-12 for r in got)


def test_deviations_are_exact_or_null(spark):
    big = [(1, [3e15, 0.0]), (2, [0.0, 1e9]), (3, [1.0, 2.0])]
    rows, found = whitening.whiten(spark.createDataFrame(big, "vec_id bigint, embedding array<double>"))
    x = [[int(v * 256) for v in r[1]] for r in big]
    sums = [sum(c) for c in zip(*x)]
    assert list(found.sums) == sums
    for r in rows.collect():
        exact = sum((3 * v - s) ** 2 for v, s in zip(x[r["vec_id"] - 1], sums))
        assert r["deviation"] == (exact if exact < 1 << 63 else None)


def test_blocks_of_any_height_agree(spark):
    frame = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    one, _ = whitening.whiten(frame)
    other, _ = whitening.whiten(frame, whitening.Settings(block_rows=7))
    a = {r["vec_id"]: r["z"] for r in one.collect()}
    for r in other.collect():
        assert np.allclose(np.abs(a[r["vec_id"]]), np.abs(r["z"]))


# ---------------------------------------------------------------- packing


def plain_best_fit(sizes, length, limit):
    """(bin, offset) of each size: among the open bins that hold it the fullest, the last one of equals."""
    used, waiting, places, opened, closed = {}, [], [], 0, 0
    for size in sizes:
        holding = [b for b in waiting if used[b] + size <= length]
        if holding:
            most = max(used[b] for b in holding)
            chosen = [b for b in holding if used[b] == most][-1]
            waiting.remove(chosen)
        else:
            if len(waiting) >= limit:
                most = max(used[b] for b in waiting)
                waiting.remove([b for b in waiting if used[b] == most][-1])
                closed += 1
            chosen, opened = opened, opened + 1
            used[chosen] = 0
        places.append((chosen, used[chosen]))
        used[chosen] += size
        if used[chosen] < length:
            waiting.append(chosen)
    return places, closed


@pytest.mark.parametrize("limit", [1, 2, 7, 40, 10_000])
def test_best_fit_is_brute_force(limit):
    rng = random.Random(limit)
    for length, most in ((10, 9), (64, 63), (64, 20), (500, 499)):
        sizes = [rng.randrange(1, most + 1) for _ in range(700)]
        fit = packing.BestFit(length, limit)
        places = [fit.add(n) for n in sizes]
        expected, closed = plain_best_fit(sizes, length, limit)
        assert places == expected and fit.closed == closed
        assert closed > 0 or limit >= 40


def test_bins_close_with_production_parameters():
    """What a packer gets makes bins close by the bound, and few sequences more than the least possible."""
    settings = packing.Settings()
    rng = random.Random(4)
    sizes = []
    while sum(sizes) < settings.packer_tokens:
        sizes.append(min(settings.length - 1, int(rng.lognormvariate(6, 1))))
    fit = packing.BestFit(settings.length, settings.open_bins)
    for n in sizes:
        fit.add(n)
    assert fit.closed > 100
    assert fit.opened <= 1.02 * sum(sizes) / settings.length


def test_a_full_table_keeps_what_is_met_often(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    monkeypatch.setattr(packing, "BLOCK_POINTS", 2000)
    rng = random.Random(6)
    letters = "abcdeéß日ж"
    often = ["".join(rng.choice(letters) for _ in range(5)) for _ in range(20)]
    texts = []
    for _ in range(400):
        words = [rng.choice(often) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12))) for _ in range(30)]
        texts.append(rng.choice(["", " ", "\n", "12 "]) + rng.choice([" ", "  ", " - ", "\n "]).join(words))
    made = packing.Tokenizer(path)
    assert [x.tolist() for x in made.ids(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert made._known < 2500  # far fewer than there are different words


# ---------------------------------------------------------------- n-gram join


def linked_documents():
    """Bridges through rows without an id, and groups of which no row has one."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    left = [word() for _ in range(60)]
    middle = [word() for _ in range(5)] + left[5:]
    right = middle[:-5] + [word() for _ in range(5)]
    alone = [word() for _ in range(40)]
    near = [*alone[:-1], word()]
    rows = [(5, left), (None, middle), (9, right), (None, alone), (None, near), (None, near), (30, ["other", "words"]), (None, ["other", "words"])]
    # many sets that have one shingle in common and nothing else
    common = [word() for _ in range(5)]
    rows += [(100 + k, common + [word() for _ in range(9)]) for k in range(60)]
    rows += [(200, rows[20][1][:-1]), (201, rows[20][1] + [word()])]
    return [(i, " ".join(words)) for i, words in rows]


def groups_by_hand(rows):
    sets = [shingles(text) for _, text in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = smallest_reachable(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(i, least.get(group[k], i))
    return group, [least.get(group[k]) for k in range(len(rows))]


def test_links_go_through_rows_without_an_id(spark):
    rows = linked_documents()
    frame = spark.createDataFrame([(*r, 1, "x", 7) for r in rows], "doc_id bigint, text string, kept_id int, kept_key string, low int")
    group, want = groups_by_hand(rows)
    assert want[2] == 5 and want[3] is None
    for settings in (ngram_join.Settings(), ngram_join.Settings(block=2, frequent=4, compare=3)):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(frame, settings).collect())
        assert got == Counter((i, len(shingles(text)), c) for (i, text), c in zip(rows, want))
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(found) == len(set(group.values()))
    # one of each group, the one with the smallest id
    members = {}
    for k, row in enumerate(rows):
        members.setdefault(group[k], []).append((row, want[k]))
    for own in members.values():
        assert sum((i, text) in [r for r, _ in own] and (c is None or i == c) for i, text in found for c in [own[0][1]]) == 1


def test_cells_are_bounded(spark):
    """Thousands of sets that share one shingle, none in the centre's group: every piece of work stays small."""
    n = 3000
    rows = spark.range(n).selectExpr("1L AS shingle", "id AS node", "id AS `group`", "cast(id = 0 AS int) AS late", "20 + id % 30 AS n", "1000 AS most")
    cells = ngram_join._cells(rows, ngram_join.Settings(compare=50))
    sizes = cells.groupBy("class", "i", "j").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 4 * 50
    # every similar pair meets: each probe is with all sets of its class and of the neighbouring ones
    met = cells.where("probe = 1").alias("p").join(cells.where("probe = 0").alias("k"), ["class", "i", "j"]).where("p.node < 40 AND p.node <> k.node")
    pairs = {(r[0], r[1]) for r in met.select("p.node", "k.node").collect()}
    size = lambda x: 20 + x % 30
    assert {(a, b) for a in range(1, 40) for b in range(n) if a != b and 100 * min(size(a), size(b)) >= 80 * max(size(a), size(b))} <= pairs


def test_mixing_keeps_columns_of_any_name(spark):
    frame = odd_documents(spark).selectExpr("*", "1 AS mix_copies", "2 AS mix_id", "3 AS mix_own", "4 AS __copies")
    taken = mixing.take(frame)
    assert taken.columns == frame.columns
    counts = mixing.mix(frame).agg({"copies": "sum"}).first()[0]
    assert taken.count() == counts > 0
    assert mixing.take(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- languages


def plain_grams(text, buckets):
    """Buckets of all 1- to 3-grams, one character after the other."""
    mask = (1 << 64) - 1
    letters = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    letters = re.sub(" +", " ", letters)
    out = []
    for k in range(len(letters)):
        for n, factors in ((1, ()), (2, (0xC2B2AE3D27D4EB4F,)), (3, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))):
            gram = letters[k - n + 1 : k + 1] if k - n + 1 >= 0 else ""
            if not gram or gram == " ":
                continue
            value = ord(gram[-1]) * 0x9E3779B97F4A7C15
            value += sum(ord(c) * f for c, f in zip(gram[-2::-1], factors))
            value &= mask
            value = ((value ^ (value >> 29)) * 0xBF58476D1CE4E5B9) & mask
            out.append((value >> 40) % buckets)
    return Counter(out)


@pytest.mark.parametrize("n", [2, 3, 4, 9])
def test_decoding_is_brute_force(n):
    rng = np.random.default_rng(n)
    codes = langid.codewords(n, 31)
    bits = codes.shape[1]
    apart = min((codes[a] != codes[b]).sum() for a in range(n) for b in range(a))
    assert apart >= 3
    trust = rng.random(bits)
    model = langid.Model([f"l{k}" for k in range(n)], codes, rng.normal(size=(64, bits)), rng.normal(size=bits), trust / trust.sum(), 64, 3.0, 0.05)
    texts = ["Häuser und Bäume", "a", "x1y2  z", "ÀÉ--ß", "the quick brown fox " * 9]
    for text, (name, score, ambiguous) in zip(texts, langid.predict_texts(model, texts)):
        counted = plain_grams(text, 64)
        total = sum(counted.values())
        losses = []
        for k in range(n):
            loss = 0.0
            for b in range(bits):
                margin = model.bias[b] + sum(model.scale * c / total * model.weights[g, b] for g, c in counted.items())
                loss += model.trust[b] * math.log1p(math.exp(-codes[k, b] * margin))
            losses.append(loss)
        low, following = sorted(losses)[:2]
        assert name == f"l{losses.index(low)}" and ambiguous == (following - low < 0.05)
        assert score == pytest.approx(1 / sum(math.exp((low - x) * bits) for x in losses))


def test_one_wrong_bit_is_corrected():
    """Two languages have three bits: a classifier that is wrong does not decide."""
    words = {"de": "der hund und das haus zwischen grünen wiesen fließt".split(), "en": "the dog and house which through thorough weather why".split()}
    rng = random.Random(2)
    names = ["de", "en"] * 30
    made = langid.fit([" ".join(rng.choices(words[name], k=12)) for name in names], names)
    assert made.codes.shape == (2, 3) and not np.allclose(made.weights[:, 0], made.weights[:, 1])
    made.weights[:, 1] *= -1
    made.bias[1] *= -1
    assert [r[0] for r in langid.predict_texts(made, ["das haus und der hund", "the house and the dog"])] == ["de", "en"]


def test_every_language_is_learned(spark):
    """Hundreds of languages, one of long documents only, one that holds most rows; the number of jobs stays the same."""
    rng = random.Random(8)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèßñøå", 5)) for _ in range(300)]
    rows, k = [], 0
    for i, letters in enumerate(alphabets):
        for _ in range(400 if i == 0 else 14):
            words = 20_000 if i == 1 else 30
            rows.append((k, " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(words)), f"x{i:03d}"))
            k += 1
    frame = spark.createDataFrame([*rows, (None, "a b", "none"), (k, None, "none"), (k + 1, "a", None)], "doc_id bigint, text string, lang string")
    texts, names = langid.training_sample(frame)
    assert len(set(names)) == 300 and max(map(len, texts)) <= 1000
    assert Counter(names).most_common(1)[0][1] == 66  # 20,000 rows among 300 languages
    tracker, before = spark.sparkContext.statusTracker(), "languages"
    spark.sparkContext.setJobGroup(before, "")
    langid.training_sample(frame)
    many = len(tracker.getJobIdsForGroup(before))
    spark.sparkContext.setJobGroup("few", "")
    langid.training_sample(frame.where("lang < 'x003'"))
    assert many <= len(tracker.getJobIdsForGroup("few")) + 1
    spark.sparkContext.setJobGroup("", "")


# ---------------------------------------------------------------- page extraction


def sf_pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def test_templates_are_counted_by_brute_force(spark):
    s = extraction.Settings()
    found = {r["host"]: (set(r["keys"]), set(r["way"])) for r in extraction.site_templates(sf_pages(spark), s).collect()}
    hosts = defaultdict(list)
    for r in sf_pages(spark).collect():
        host = re.match("[a-z]+://([^/?#:]*)", r["url"])[1].lower()
        hosts[host].append(extraction.parse(r["html"] or ""))
    expected = {}
    for host, roots in hosts.items():
        votes = extraction.votes([extraction.voter(x) for x in roots])
        keys, places, ways = defaultdict(set), defaultdict(set), defaultdict(set)
        for root, vote in zip(roots, votes):
            shapes, own, most = extraction.shape_keys(root)
            for k in extraction.subtree_keys(root) | shapes:
                keys[k].add(vote)
            for k in own:
                places[k].add(vote)
            for k in most:
                ways[k].add(vote)
        often = {k for k, v in keys.items() if len(v) >= max(s.least_pages, s.least_share * len(set(votes)))}
        way = {k for k, v in ways.items() if len(places[k]) >= s.least_pages and 2 * len(v) >= len(places[k])}
        if often or way:
            expected[host] = (often, way)
    assert found == expected and any(keys for keys, _ in found.values())


def test_menus_go_by_templates_alone(spark, monkeypatch):
    """Without any list of names and without the preference for a marked article, recurring shapes alone leave the article."""
    templates = {r["host"]: r for r in extraction.site_templates(sf_pages(spark)).collect()}
    rows = [(r, re.match("[a-z]+://([^/?#:]*)", r["url"])[1].lower()) for r in sf_pages(spark).collect()]
    want = {r["page_id"]: extraction.main_text(r["html"] or "", set()) for r, _ in rows}
    for name in ("_WORDS", "_SOFT", "_BESIDE"):
        monkeypatch.setattr(extraction, name, set())
    monkeypatch.setattr(extraction, "_article", lambda root: root)
    monkeypatch.setattr(extraction.Settings, "least_links", 10**9)
    extraction._names_aside.cache_clear()
    many = changed = exact = 0
    try:
        for r, host in rows:
            own = templates.get(host)
            if own is None or not own["keys"]:
                continue
            many += 1
            plain = extraction.main_text(r["html"] or "", set())
            text = extraction.main_text(r["html"] or "", set(own["keys"]), way=set(own["way"]))
            changed += text != plain
            exact += text == want[r["page_id"]]
    finally:
        extraction._names_aside.cache_clear()
    assert many >= 30 and changed >= 0.95 * many and exact >= 0.9 * many, (many, changed, exact)


def site(k, article, extra=""):
    links = "".join(f"<li><a href='/{k}-{i}'>{k} word {i}</a></li>" for i in range(3 + k % 4))
    return f"<body><div class='top'><ul>{links}</ul></div><div class='wrap w-{k}'>{article}</div>{extra}<div class='low'><p>text {k} of the foot</p></div></body>"


def test_shapes_beside_the_text_only(spark):
    """What differs from page to page goes by its shape; headings, first paragraphs and boxes in the text stay."""
    body = lambda k: f"<h1>Title {k}</h1><div class='lead'><p>Lead {k} " + f"w{k} " * 30 + "</p></div>" + "".join(f"<p>Par {k} {i} " + f"v{k * i} " * 30 + "</p>" for i in range(3))
    pages = [(k, f"http://a.example/{k}", site(k, body(k))) for k in range(8)]
    pages += [(100 + k, f"http://b.example/{k}", site(k, body(k))) for k in range(3)]  # too few pages
    pages += [(200 + k, f"http://c.example/{k}", site(1, body(1))) for k in range(9)]  # copies of one page
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    for k in range(8):
        text = got[k]
        assert text.startswith(f"Title {k}\nLead {k} ") and "foot" not in text and " word " not in text and f"Par {k} 2" in text
    assert all("foot" in got[100 + k] and f"Lead {k}" in got[100 + k] for k in range(3))
    assert all("Lead 1" in got[200 + k] for k in range(9))


def test_long_and_odd_pages(spark):
    long = "<body><article>" + "<p>" + "word " * 300_000 + "</p><div>" * 3000 + "</article></body>"
    rows = [(1, None, None), (2, "http://h.example/", ""), (None, "x", "<p>a"), (3, "http://h.example/", long), (3, "http://h.example/", long)]
    frame = spark.createDataFrame([(*r, "z", 5) for r in rows], "page_id bigint, url string, html string, host string, keys int")
    got = [(r["page_id"], r["n_chars"]) for r in extraction.extract(frame).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (None, 1), (3, 5 * 300_000 - 1), (3, 5 * 300_000 - 1)], key=str)


# ---------------------------------------------------------------- the pipeline


def test_odd_rows_go_through_every_stage(spark):
    """Nulls in any column, repeated rows, very long texts, and columns that operators use themselves."""
    import corpus_pipeline as p

    names = ["mix_id", "mix_own", "mix_copies", "kept_id", "kept_key", "low", "group", "probe", "text_key", "component", "length", "piece", "ratio", "__toxic"]
    docs = odd_documents(spark).selectExpr("*", *[f"{k} AS {n}" for k, n in enumerate(names)])
    for name, stage in p.STAGES:
        before, docs = docs, stored(stage(spark, docs, SMALL), name.replace(" ", "-"))
        if name == "packing":
            break
        assert docs.columns == before.columns, name
        rows = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        given = Counter((r["doc_id"], r["text"]) for r in before.collect())
        assert rows and set(rows) <= set(given), name
        if name == "quality rules":
            assert all(len((text or "").split()) >= 20 for _, text in rows)
        if name in ("quality rules", "toxicity"):
            assert all(rows[k] == given[k] for k in rows), name  # repeated rows stay or go together
        if name == "n-gram join":
            assert max(rows.values()) == 1
            _, want = groups_by_hand(list(given))
            assert {i for i, _ in rows if i is not None} == {i for (i, _), c in zip(given, want) if i is not None and i == c}
        if name == "mixing":
            assert max(rows.values()) <= 2
    placed = docs.groupBy("doc_id", "piece").count()
    assert placed.count() > 0 and docs.agg({"length": "max"}).first()[0] <= 2048


def test_an_empty_table_stays_empty(spark):
    import corpus_pipeline as p

    docs = nothing(spark)
    for name, stage in p.STAGES:
        docs = stored(stage(spark, docs, SMALL), name.replace(" ", "-"))
        assert docs.count() == 0, name


@pytest.mark.parametrize("size", [3, 8, 24, 64, 128, 384, 768])
def test_recall_of_vectors_at_the_limit(spark, size):
    """Pairs at a cosine of little above 0.98: at least 99 of 100 are linked, and none below the limit."""
    rng = np.random.default_rng(size)
    n, rows = 400, []
    for k in range(n):
        a = rng.normal(size=size)
        a /= np.linalg.norm(a)
        b = rng.normal(size=size)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cosine = 0.9801 if k % 2 else 0.9799
        rows += [(2 * k, a.tolist(), k), (2 * k + 1, (cosine * a + math.sqrt(1 - cosine**2) * b).tolist(), k)]
    # one label for all: every vector is compared with every other
    frame = spark.createDataFrame([(i, v, 1 if size > 8 else k) for i, v, k in rows], "vec_id bigint, embedding array<double>, label int")
    links = {r["vec_id"]: r["n_links"] for r in neardup_vectors.near_duplicates(frame).collect()}
    assert sum(links[2 * k] > 0 for k in range(1, n, 2)) >= 0.99 * n / 2
    assert sum(links[2 * k] > 0 for k in range(0, n, 2)) == 0
