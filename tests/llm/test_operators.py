"""Operators of the training-data subpackage: brute force, round trips, held-out accuracy, and odd input."""

from __future__ import annotations

import base64
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import zstandard

from hearthline.llm import extraction, langid, mixing, neardup_vectors, ngram_join, packing, quality, sharding, toxicity, warc, wordhash
from hearthline.llm.components import components
from hearthline.llm.queries import QUERIES
from hearthline.session import work_dir

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string, page_id int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def odd_documents(spark, rows=60):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with the operators' own names."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 120))) for _ in range(8)]
    out = [(None, None, None, None, None, None, None, None), (1, "", "en", "a", 0, 1.0, "n", 1), (2, None, None, None, 0, None, None, 2)]
    for k in range(rows):
        text = base[k % 8].split()
        if k % 3:
            text[rng.randrange(len(text))] = "changed"
        out.append((10 + k, " ".join(text), "en", rng.choice(["a", "b", None]), 5, 0.5, "x", k))
    out += [out[5], out[5], (None, base[0], "en", "a", 1, 0.0, "y", 3), (500, "é " * 30_000, "fr", "b", 1, 0.0, "z", 4), (501, "two words", "en", "b", 1, 0.0, "z", 4)]
    return spark.createDataFrame(out, SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, k) for k in range(301, 380)]
    frame = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a bigint, b bigint")
    want = smallest_reachable({n for e in edges for n in e}, edges)
    got = {r.node: r.component for r in components(frame, "a", "b").collect()}
    assert got == {n: c for n, c in want.items() if n in got} and set(got) >= {n for a, b in edges if a != b for n in (a, b)}
    assert components(frame.limit(0), "a", "b").count() == 0


def test_ngram_join_is_brute_force(spark):
    documents = odd_documents(spark).where("doc_id IS NOT NULL").distinct()
    rows = [(r.doc_id, shingles(r.text)) for r in documents.collect()]
    links = [(a, b) for a, s in rows for b, t in rows if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    want = smallest_reachable([a for a, _ in rows], links)
    for settings in (ngram_join.Settings(), ngram_join.Settings(block=2, frequent=4)):
        got = ngram_join.jaccard_groups(documents, settings).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {a: (len(s), want[a]) for a, s in rows}
    kept = {r.doc_id for r in ngram_join.keep_one(odd_documents(spark)).collect()}
    assert kept == {a for a, s in rows if want[a] == a} | {None}


def test_trie_against_all_pairs():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate((rng.choice(base, rng.integers(120, 190), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 20), dtype=np.uint64)))) for _ in range(40)]
    trie = ngram_join.Trie(sets)
    for s in sets:
        want = {k for k, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t))}
        assert set(trie.similar(s, 80, lambda name: False)) == want
        for t in sets:
            if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t)):
                assert ngram_join.may_match(len(s), ngram_join.sketch(s), len(t), ngram_join.sketch(t), 80)


def test_vectors_are_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(120):
        v = rng.normal(size=24)
        rows += [(3 * k, v.tolist(), k % 3), (3 * k + 1, (v + 0.05 * rng.normal(size=24)).tolist(), k % 3), (3 * k + 2, v.tolist(), (k + k % 2) % 3)]
    odd = [(900, None, 1), (901, [0.0] * 24, 1), (902, [float("nan")] * 24, 1), (903, [1.0] * 24, None), (904, [1.0, None], 1), (905, [], 1), (906, [1.0, 2.0], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: k for i, _, k in rows}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.98]
    want = smallest_reachable([r[0] for r in rows + odd], links)
    count = Counter(x for e in links for x in e)
    for block in (256, 2):
        got = neardup_vectors.near_duplicates(frame, neardup_vectors.Settings(block=block)).collect()
        assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (count[i], c, i == c) for i, c in want.items()}
    assert neardup_vectors.near_duplicates(frame.limit(0)).count() == 0


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(4)
    texts = [None, "", "a b c", "x " * 100, "l1 w\nl2 w\nl1 w\n\n", "é#* $ü <b>", "".join(rng.choice("abcdef 0189") for _ in range(9000)), "\x1f \x85 a b"]
    texts += [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(200)), "one two three four five six seven eight nine " * 2]
    frame = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id bigint, text string, ratio string")
    for r in quality.quality_rules(frame).collect():
        t = texts[r.doc_id] or ""
        words = WORD.findall(t)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        count, inside = Counter(windows), set()
        for i, w in enumerate(windows):
            if count[w] > 1:
                inside.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(w.count(c) for w in words for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 20 or 100 * len(inside) > 30 * len(words))
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality.keep_good(frame).collect()}
    assert kept == {r.doc_id for r in quality.quality_rules(frame).where("kept").collect()} and 8 in kept and 3 not in kept


def noise_documents():
    """(name, length, text): words of random letters, base64, and prose whose second half is random letters."""
    rng = random.Random(7)
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist()
    prose = {}
    for d in docs:
        # two languages of plain prose, without the texts that repeat themselves
        t = d["text"] or ""
        if len(t) > 500 and len(t.encode()) / len(zstandard.ZstdCompressor(level=3).compress(t.encode())) < 2.4:
            prose[d["lang"]] = prose.get(d["lang"], "") + t + " "
    out = []
    for length in (600, 1200, 2000, 6000, 20_000, 100_000):
        letters = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(length // 4))[:length]
        out += [("letters", length, letters), ("base64", length, base64.b64encode(rng.randbytes(length)).decode()[:length])]
        out += [("half", length, (prose["en"][: length // 2] + " " + letters[: length // 2]))]
    return out


def test_quality_limits_follow_the_corpus(spark):
    """Noise of a length is rejected by what other documents of that length have, and hardly any prose is."""
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = noise_documents()
    frame = corpus.unionByName(spark.createDataFrame([(-1 - i, t) for i, (_, _, t) in enumerate(planted)], "doc_id bigint, text string"))
    rows = quality.quality_rules(frame).select("doc_id", "band", "kept").collect()
    band = {r.doc_id: r.band for r in rows}
    for i, (name, length, _) in enumerate(planted):
        # below 1,200 bytes letters compress as prose does; half of them show from 2,000 on
        if length >= {"letters": 1200, "base64": 600, "half": 2000}[name]:
            assert band[-1 - i] in ("low", "chunks"), (name, length)
    assert sum(b in ("low", "chunks") for i, b in band.items() if i is not None and i >= 0) <= 0.02 * len(band)
    kept = {r.doc_id for r in quality.keep_good(frame).collect()}
    assert kept == {r.doc_id for r in rows if r.kept}


def test_quality_limits_and_copies():
    """Limits where texts are few, and where near copies fill one length class."""
    bands = quality.Bands()
    plain = {k: [(int(200 * (1 + k / 40)) + d, 20) for d in range(-5, 6)] for k in range(20, 50)}
    found = quality._limits(plain, bands)
    heavy = quality._limits(plain | {35: [(int(200 * 2.9), 50_000)]}, bands)
    assert heavy.whole == pytest.approx(np.array(found.whole), abs=0.1)
    assert quality._limits({40: [(400, 3)]}, bands).whole == bands.whole
    chunks = [2.1] * 20
    assert not quality._bad_chunks(chunks, (2.0, 6.0), bands)
    assert not quality._bad_chunks([1.7, *chunks], (2.0, 6.0), bands)
    assert quality._bad_chunks([*chunks[:10], 1.7, 1.7, *chunks], (2.0, 6.0), bands)


def test_tokens_are_the_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    library.encode_special_tokens = True
    rng = random.Random(1)
    signs = ["'", " ", "  ", "s", "re", "ll", "\n", "é", "1", "!", " ", "t", "ve", "Z", "_", "日", "😀", "<|endoftext|>"]
    texts = ["", " 's", "\n 's", "don't''s"] + ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(3000)]
    assert [x.tolist() for x in packing.tokenizer("byte_bpe_50k.json").encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_unchanged_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(2)
    signs = ["'", " ", "  ", "s", "re", "\n", "é", "1", "!", "Z", "<|", "endoftext", "|>", "😀", "<|endoftext|>", "<|endoftext|>"]
    texts = ["", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext|>" * 3] + ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(3000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert want[1] == [64, 50256, 65]
    assert [x.tolist() for x in packing.tokenizer("byte_bpe_50k.json").ids(texts)] == want
    frame = spark.createDataFrame(list(enumerate(texts[:200])), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in packing.pieces(frame, ids=True).collect()}
    assert got == {i: [*own, 0] for i, own in enumerate(want[:200])}


def test_packing(spark):
    settings = packing.Settings(length=64, open_bins=16, packer_tokens=4000)
    cut = packing.pieces(odd_documents(spark), settings, ids=True)
    rows = packing.pack(cut, settings).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r.length for r in rows)
    assert len(places) <= 1.1 * total / 64 + 4
    assert all(r.length == 64 for r in rows if r.piece > 0)
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd_documents(spark).collect()}
    assert packing.pack(packing.pieces(nothing(spark))).count() == 0
    fit = packing.BestFit(10, 2)
    assert [fit.add(n) for n in (6, 7, 3, 4, 9, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]


def test_sharding(spark):
    documents = odd_documents(spark)
    rows = sharding.shard(documents, shards=4).collect()
    assert len(rows) == documents.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(nothing(spark)).count() == 0
    loads = [(k, 1 + k % 7) for k in range(30_000)]
    before, after = (sharding.deal(loads, n, 64, 0.005) for n in (8, 9))
    held = Counter()
    for place, load in loads:
        held[before[place]] += load
    assert max(held.values()) <= 1.005 * sum(held.values()) / 8
    assert sum(before[p] != after[p] for p, _ in loads) < 0.45 * len(loads)


def test_mixing(spark):
    rows = mixing.mix(odd_documents(spark)).collect()
    total = sum(r.size for r in rows)
    for source in ("a", "b", None):
        own = [r for r in rows if r.source == source]
        taken = sum(r.size * r.copies for r in own)
        assert abs(taken - own[0].target) <= max(r.size for r in own)
        assert own[0].target <= 2 * own[0].source_size + 1e-9 and all(0 <= r.copies <= 2 for r in own)
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * total) < 1e-6 * total
    again = sorted((str(r.doc_id), r.draw, r.copies) for r in mixing.mix(odd_documents(spark)).collect())
    assert again == sorted((str(r.doc_id), r.draw, r.copies) for r in rows)
    taken = mixing.take(odd_documents(spark))
    assert taken.columns == odd_documents(spark).columns and taken.count() == sum(r.copies for r in rows)
    assert mixing.mix(nothing(spark)).count() == 0


def test_warc_round_trip(spark):
    html = ["<p>x</p>" * 30, "<p>x</p>" * 30, "short", "short", None, "", "\r\n\r\n" * 50 + "é", "<p>x</p>" * 30]
    pages = [(7, "http://a/b c", html[0]), (3, None, html[1]), (1, "http://a", html[2]), (2, "u", html[3]), (5, "u", None), (6, "u", ""), (8, "u", html[6]), (None, "u", html[7]), (3, None, html[1])]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    path = work_dir(spark, "warc-test")
    index = warc.write_archives(frame, path)
    rows = warc.read_records(index, path).collect()
    assert len(rows) == len(pages)
    responses = Counter(r.html for r in rows if r.record_type == "response")
    assert responses == Counter({html[0]: 1, "short": 2, "": 2, html[6]: 1})
    revisits = [r for r in rows if r.record_type == "revisit"]
    assert Counter(r.page_id for r in revisits) == Counter({7: 1, 3: 1, None: 1}) and {r.refers_to for r in revisits} == {3}
    some = warc.read_records(index.where("page_id = 8"), path).collect()
    assert [(r.page_id, r.html) for r in some] == [(8, html[6])]
    assert warc.write_archives(frame.limit(0), work_dir(spark, "warc-test")).count() == 0


def test_extraction(spark):
    page = (
        "<html><body><header><h1>Site</h1></header><div class='menu'><a>a</a></div><div id=content><p>Hello <b>wor</b>ld &amp; all<br>next<p>Second"
        "<ul><li>one<li>two</ul><form>no</form><div class='comments'><p>bad</p></div><script>if(a<b){'</p>'}</script><!-- x --> tail</div></body></html>"
    )
    assert extraction.main_text(page, set()) == "Hello world & all next\nSecond\none\ntwo\ntail"
    assert extraction.main_text("<article><header><h1>T</h1></header><p>x</article><p>out", set()) == "T\nx"
    # the same box on every page of a host is template, in whatever element
    pages = [(k, "http://h.org/%d" % k, f"<body><div><p>Follow us everywhere</p></div><div><p>Text {k}</p></div></body>") for k in range(9)]
    pages += [(20, None, None), (21, "x", ""), (22, "http://other/", "<p>Follow us everywhere</p>"), (23, "http://h.org/", "<<p a='>x"), (24, "http://deep/", "<div>" * 5000 + "z")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extraction.extract(frame).collect()}
    assert all(got[k] == f"Text {k}" for k in range(9)) and got[20] == got[21] == "" and got[22] == "Follow us everywhere" and got[24] == "z"
    assert extraction.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class='layout has-sidebar'><article><p>Long text</p></article></div><p>out", "Long text"),
        ("<div class='no-sidebar with-comments cookie-free'><p>Long text</p></div>", "Long text"),
        ("<article><h2 id='related-work'>Related</h2><p>a b</p><h2 id='search'>Search</h2><p>c d</p></article>", "Related\na b\nSearch\nc d"),
        ("<article><p title='the hidden truth' data-x=\"class='ad'\">Text</p><p hidden>no</p><p aria-hidden=true>no</p></article>", "Text"),
        ("<article><p aria-hidden=false aria-expanded=true>Text</p></article>", "Text"),
        ("<form><div class='sidebar-right'><p>The whole page is in a form</p></div></form><p>end", "The whole page is in a form\nend"),
        ("<div class='related'><article><p>The only article</p></article></div>", "The only article"),
        ("<main><p>A long main part of the page with its text</p><article>teaser</article></main>", "A long main part of the page with its text\nteaser"),
        ("<main><p>by x</p><article><p>The article of this page</p></article></main>", "The article of this page"),
        ("<article><p>The text of this article</p><div class='related-posts'>no</div><ul class='share_buttons'><li>no</ul><div id='comments'>no</div></article>", "The text of this article"),
        ("<article><p>Short</p></article><section class='comments'><article class='comment'>A comment that is longer than that</article></section>", "Short"),
    ],
)
def test_extraction_keeps_the_article(page, want):
    """Class names that only hold a listed word, attributes' values, and wrappers do not take the text away."""
    assert extraction.main_text(page, set()) == want


def test_copies_of_a_page_are_one_vote(spark):
    """Copies and near copies of an article on a host do not make its paragraphs template; a box on all pages stays one."""
    rng = random.Random(9)
    some = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    box = "<div><p>Follow us everywhere</p></div>"
    shared = [some(60) for _ in range(6)]
    near = ["<article>" + "".join(f"<p>{p}</p>" for p in shared) + f"<p>On day {k} {some(4)}</p></article>" for k in range(40)]
    other = [f"<article><p>{some(80)}</p>{box}</article>" for _ in range(30)]
    exact = [f"<article>loose text<p>{shared[0]}</p><p>{shared[1]}</p></article>"] * 20
    hosts = {"mixed": [box + p for p in near] + other, "alone": [box + p for p in near], "exact": exact}
    rows = [(host, k, p) for host, pages in hosts.items() for k, p in enumerate(pages)]
    frame = spark.createDataFrame([(i, f"http://{h}/{k}", f"<body>{p}</body>") for i, (h, k, p) in enumerate(rows)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in extraction.extract(frame).collect()}
    for i, (host, k, page) in enumerate(rows):
        if host == "exact":
            assert got[i] == "\n".join(["loose text", *shared[:2]])
        elif page in other:
            assert got[i] == re.search("<p>(.*?)</p>", page)[1]
        else:
            assert got[i].startswith("\n".join(shared) + f"\nOn day {k} ")


def test_toxicity_held_out(spark):
    rows = QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(truth[r.doc_id], r.predicted) for r in rows if r.doc_id in truth]
    assert sum(a == b for a, b in judged) >= 0.9 * len(judged)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    scores, start, moves = rng.normal(size=5), 0.3, (0.2, -0.4, 0.1, 0.7)
    weight = {}
    for k in range(32):
        tags = [(k >> t) & 1 for t in range(5)]
        weight[k] = np.exp(sum(s * t for s, t in zip(scores, tags)) + start * tags[0] + sum(moves[2 * a + b] for a, b in zip(tags, tags[1:])))
    chains = toxicity.Chains(np.array([5]))
    ahead, back = chains.passes(chains.spread(scores), start, moves)
    for t, odds in enumerate(chains.flat([f + b for f, b in zip(ahead, back)])):
        want = sum(w for k, w in weight.items() if (k >> t) & 1) / sum(weight.values())
        assert abs(1 / (1 + np.exp(-odds)) - want) < 1e-9


def test_toxicity_odd_input(spark):
    model = toxicity.fit(["you idiot there", "you fine there"] * 20, [1, 0] * 20)
    rows = toxicity.score(odd_documents(spark), model).collect()
    assert len(rows) == odd_documents(spark).count() and all(0 <= r.score <= 1 and r.spans == [] for r in rows)
    found = toxicity.score(spark.createDataFrame([("oh you idiot!",)], "text string"), model).first()
    assert found.score >= 0.5 and [(s.start, s.end) for s in found.spans] == [(7, 12)]
    assert toxicity.keep_clean(nothing(spark), toxicity.fit([], [])).count() == 0


def test_language(spark):
    rows = QUERIES["op3_language"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.95 * len(rows)
    model = langid.train(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert [r[0] for r in langid.predict_texts(model, [None, "", "12 34 !!"])] == ["und"] * 3
    assert langid.identify(odd_documents(spark), model).count() == odd_documents(spark).count()
    assert langid.identify(nothing(spark), langid.train(nothing(spark))).count() == 0
    codes = langid.codewords(12, 31)
    assert min((a != b).sum() for i, a in enumerate(codes) for b in codes[:i]) >= 9


def test_word_hashes_do_not_depend_on_blocks():
    texts = ["A b\tc\x0bd e f", None, "x" * 700_000 + " y", "a B c d e F"]
    sets = list(wordhash.shingle_sets(texts, 5))
    assert [len(s) for s in sets] == [2, 0, 1, 2] and (sets[0] == sets[3]).all()


def test_pipeline_stages(spark):
    """Each stage against a plain rendering of its rule on the whole of its input."""
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = p.quality_stage(spark, docs, SMALL)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    clean = p.toxicity_stage(spark, good, SMALL)
    assert set(clean.columns) == set(docs.columns)
    one = p.join_stage(spark, docs, SMALL)
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    links = [(a, b) for a, s in rows for b, t in rows if a < b and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    want = smallest_reachable([a for a, _ in rows], links)
    assert sorted(r.doc_id for r in one.collect()) == sorted(a for a, c in want.items() if a == c)
    mixed = p.mixing_stage(spark, one, SMALL)
    places = p.packing_stage(spark, mixed, SMALL)
    assert places.agg({"length": "sum"}).first()[0] == packing.pieces(mixed).agg({"length": "sum"}).first()[0]


@pytest.mark.parametrize("name", ["op4_ring_shards", "op7_quality_rules", "op8_packing", "op10_extraction"])
def test_every_row_comes_back(spark, name):
    column, table = ("page_id", "pages") if name.startswith("op10") else ("doc_id", "documents")
    rows = QUERIES[name](spark, SMALL).select(column).distinct().count()
    assert rows == spark.read.parquet(f"{SMALL}/{table}.parquet").select(column).distinct().count()
