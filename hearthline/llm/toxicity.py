"""Toxicity by a linear-chain conditional random field over words.

Two tags: offending or not. A word's emission score is the sum of the weights of its features (the word itself, its first
and last letters), of the word before and of the word after; transitions tie neighbours. Forward and backward passes
give each word the marginal probability of being offending. Marginals over one half are joined into spans of code points,
and a document's score is a logistic function of its marginals.

Token labels come from the documents' labels: a feature seen in offending documents far more often than in others marks
the words that carry it. The model is fitted on the driver from a bounded sample (``Settings.sample_rows`` documents and
``Settings.sample_chars`` characters of each class); scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import bounded_sample, crc_fold, give_back, map_arrow

_TOKEN = re.compile(r"\w+|[.!?\n]")
_STOPS = (".", "!", "?", "\n")
PREFIXES = (3, 4, 5)


@dataclass(frozen=True)
class Settings:
    """Bounds of the fit. ``chain`` is the longest sequence: sequences end at . ! ? and line ends, or after so many words."""

    sample_rows: int = 1500
    sample_chars: int = 3_000_000
    sequences: int = 4_000
    chain: int = 128
    rounds: int = 50
    l2: float = 0.02
    least_documents: int = 3
    least_share: float = 0.01
    plain_share: float = 0.05
    least_log_odds: float = 3.0
    chance: float = 1e-6


@dataclass
class Model:
    """Weights of hashed features for three places (the word, the word before, the word after), and the chain's own."""

    own: dict[str, float]
    before: dict[str, float]
    after: dict[str, float]
    bias: float
    start: float
    moves: tuple[float, float, float, float]
    chain: int
    document: tuple[float, float, float]
    key: str = ""

    def emission(self, word: str) -> tuple[float, float, float]:
        marks = word_features(word)
        own = self.own.get
        return sum([own(m, 0.0) for m in marks]), self.before.get(marks[0], 0.0), self.after.get(marks[0], 0.0)


def word_features(word: str) -> list[str]:
    """The lower-case word, its beginnings and its ending; the word comes first."""
    w = word.lower()
    return ["w:" + w, *(f"p:{w[:k]}" for k in PREFIXES if len(w) > k), "s:" + w[-3:]]


def word_sequences(text: str, chain: int) -> list[list[str]]:
    """Words of a text, cut into sequences."""
    out: list[list[str]] = [[]]
    for token in _TOKEN.findall(text):
        if token in _STOPS:
            out.append([])
        elif len(out[-1]) == chain:
            out.append([token])
        else:
            out[-1].append(token)
    return [s for s in out if s]


class Chains:
    """Sequences of different lengths side by side: the longest first, one row of the matrix per place.

    ``lengths`` of the sequences, whose elements lie one after the other in flat arrays.
    """

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.places = int(lengths.max()) if len(lengths) else 0
        self.active = [int(np.count_nonzero(lengths > t)) for t in range(self.places)]
        first = (np.cumsum(lengths) - lengths)[order]
        self.at = [first[:k] + t for t, k in enumerate(self.active)]

    def spread(self, flat: np.ndarray) -> list[np.ndarray]:
        return [flat[at] for at in self.at]

    def flat(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(sum(self.active))
        for at, row in zip(self.at, rows):
            out[at] = row
        return out

    def passes(self, scores: list[np.ndarray], start: float, moves: tuple) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Forward and backward log odds of tag 1 at each place; their sum is the log odds of the marginal.

        ``scores``: tag 1's emission less tag 0's. ``moves``: scores of 0-0, 0-1, 1-0, 1-1.
        """
        a00, a01, a10, a11 = moves
        ahead: list[np.ndarray] = []
        for t in range(self.places):
            if t == 0:
                ahead.append(scores[0] + start)
            else:
                r = ahead[-1][: self.active[t]]
                ahead.append(scores[t] + np.logaddexp(a01, r + a11) - np.logaddexp(a00, r + a10))
        back = [np.zeros(k) for k in self.active]
        for t in range(self.places - 2, -1, -1):
            r = scores[t + 1] + back[t + 1]
            back[t][: len(r)] = np.logaddexp(a10, r + a11) - np.logaddexp(a00, r + a01)
        return ahead, back


# ---------------------------------------------------------------- fitting, on a bounded sample


@lru_cache(10_000)
def least_count(mean: float, chance: float) -> int:
    """Smallest count that a Poisson variable of this mean reaches with at most this chance."""
    term = left = math.exp(-mean)
    k = 1
    while 1 - left > chance and k < 10_000:
        term *= mean / k
        left += term
        k += 1
    return k


def _features_of(text: str) -> set[str]:
    return {m for w in set(_TOKEN.findall(text)) for m in word_features(w)[:-1]}


def marked_features(texts: list[str], toxic: list[int], settings: Settings) -> set[str]:
    """Features that explain why documents are offending.

    Only features much rarer elsewhere come into question. Those in a fair share of all offending documents are taken;
    then, again and again, the one that occurs in most offending documents without a taken one (of equals the longest).
    Words that merely come along, as in copies of one document, explain nothing more and are left out.
    """
    n1 = sum(1 for label in toxic if label)
    n0 = len(toxic) - n1
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for text, label in zip(texts, toxic):
        if label:
            seen[1].update(_features_of(text))
    for m in [m for m, k in seen[1].items() if k < settings.least_documents]:
        del seen[1][m]
    # elsewhere only what is left is counted, so that the driver holds little
    for text, label in zip(texts, toxic):
        if not label:
            seen[0].update(_features_of(text) & seen[1].keys())
    least = max(settings.least_documents, settings.least_share * n1)
    able = {
        m: k
        for m, k in seen[1].items()
        if k >= settings.least_documents
        and seen[0][m] <= 0.05 * k
        and math.log((k + 0.5) / (n1 + 1)) - math.log((seen[0][m] + 0.5) / (n0 + 1)) >= settings.least_log_odds
        and k >= least_count((seen[0][m] + 1) / (n0 + 1) * n1, settings.chance)
    }
    taken = {m for m, k in able.items() if k >= max(least, settings.plain_share * n1)}
    rest = [marks & able.keys() for text, label in zip(texts, toxic) if label and not (marks := _features_of(text)) & taken]
    while rest:
        left = Counter(m for marks in rest for m in marks)
        best = max(left, key=lambda m: (left[m], len(m), m), default=None)
        if best is None or left[best] < least:
            break
        taken.add(best)
        rest = [marks for marks in rest if best not in marks]
    return taken


def fit(texts: list[str], toxic: list[int], settings: Settings = Settings()) -> Model:
    """Fit emissions and transitions by gradient ascent on the chains' log likelihood, then the document's function.

    Without an offending document in the sample every score is near 0.
    """
    marks = marked_features(texts, toxic, settings)
    chosen: list[tuple[list[str], list[int]]] = []
    count = [0, 0]
    for text, label in zip(texts, toxic):
        for words in word_sequences(text, settings.chain):
            tags = [int(bool(label) and any(m in marks for m in word_features(w)[:-1])) for w in words]
            kind = int(any(tags))
            if count[kind] < settings.sequences // 2:
                count[kind] += 1
                chosen.append((words, tags))
    index: dict[str, int] = {}
    at, what = array("q"), array("q")  # plain numbers: the driver holds little
    place = 0
    for words, _ in chosen:
        for t, w in enumerate(words):
            named = word_features(w)
            for m in named:
                at.append(place + t)
                what.append(index.setdefault("o" + m, len(index)))
            if t + 1 < len(words):
                at.append(place + t + 1)
                what.append(index.setdefault("b" + named[0], len(index)))
            if t:
                at.append(place + t - 1)
                what.append(index.setdefault("a" + named[0], len(index)))
        place += len(words)
    size = len(index)
    at, what = np.frombuffer(at, dtype=np.int64), np.frombuffer(what, dtype=np.int64)
    chains = Chains(np.array([len(w) for w, _ in chosen], dtype=np.int64))
    tags = np.array([t for _, own in chosen for t in own], dtype=float)
    theta, memory = np.zeros(size + 6), np.full(size + 6, 1e-3)
    theta[size] = -1.0
    if count[1]:
        for _ in range(settings.rounds):
            slope = _slope(theta, chains, at, what, tags, size)
            slope[:size] -= settings.l2 * theta[:size]
            memory += slope * slope
            theta += 0.5 * slope / np.sqrt(memory)
    weights = {k: float(theta[i]) for k, i in index.items() if abs(theta[i]) > 0.01}
    part = {p: {k[1:]: v for k, v in weights.items() if k[0] == p} for p in "oba"}
    bias, start, *moves = theta[size:].tolist()
    model = Model(part["o"], part["b"], part["a"], bias, start, tuple(moves), settings.chain, (0.0, 0.0, 0.0))
    model.key = hashlib.md5(repr((sorted(weights.items()), theta[size:].tolist())).encode()).hexdigest()
    model.document = _fit_document(model, texts, toxic) if count[1] else (-9.0, 0.0, 0.0)
    return model


def _slope(theta, chains: Chains, at, what, tags, size: int) -> np.ndarray:
    """Observed less expected counts of features, of the start and of the moves."""
    slope = np.zeros_like(theta)
    bias, start, moves = theta[size], theta[size + 1], theta[size + 2 :]
    scores = chains.spread(bias + np.bincount(at, weights=theta[what], minlength=len(tags)))
    ahead, back = chains.passes(scores, start, tuple(moves))
    chance = chains.flat([1 / (1 + np.exp(-(f + b))) for f, b in zip(ahead, back)])
    gap = tags - chance
    slope[:size] = np.bincount(what, weights=gap[at], minlength=size)
    slope[size] = gap.sum()
    seen = chains.spread(tags)
    slope[size + 1] = (seen[0] - chance[chains.at[0]]).sum()
    for t in range(1, chains.places):
        k = chains.active[t]
        r, s = ahead[t - 1][:k], scores[t] + back[t]
        four = np.stack([np.full(k, moves[0]), moves[1] + s, moves[2] + r, moves[3] + r + s])
        four = np.exp(four - four.max(axis=0))
        four /= four.sum(axis=0)
        x, y = seen[t - 1][:k], seen[t]
        real = np.stack([(1 - x) * (1 - y), (1 - x) * y, x * (1 - y), x * y])
        slope[size + 2 :] += (real - four).sum(axis=1)
    return slope


def _fit_document(model: Model, texts: list[str], toxic: list[int]) -> tuple[float, float, float]:
    """Logistic regression of the label on the largest log odds and the expected number of offending words."""
    x = np.array([[1.0, *summary(odds)] for odds in log_odds(model, texts)])
    y = np.array(toxic, dtype=float)
    w = np.array([0.0, 0.5, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    return tuple(float(v) for v in w)


# ---------------------------------------------------------------- scoring

#: Words a worker remembers, as rows of a table of emissions, for the model it scores with; forgotten beyond REMEMBERED.
_known: dict[str, tuple[dict[str, int], np.ndarray]] = {}
REMEMBERED = 100_000
#: Characters scored at once; a longer text is scored alone.
AT_ONCE = 1 << 19


def summary(odds: np.ndarray) -> tuple[float, float]:
    """Largest log odds of a word, clipped, and log(1 + expected number of offending words over one half)."""
    if not len(odds):
        return -8.0, 0.0
    high = odds[odds > 0]
    return float(np.clip(odds.max(), -8, 8)), float(np.log1p((1 / (1 + np.exp(-high))).sum()))


def log_odds(model: Model, texts: list[str | None]) -> list[np.ndarray]:
    """Log odds of being offending of the words of each text."""
    out, held, size = [], [], 0
    for text in texts:
        if held and size + len(text or "") > AT_ONCE:
            out += _log_odds(model, held)
            held, size = [], 0
        held.append(text)
        size += len(text or "")
    return out + (_log_odds(model, held) if held else [])


def _log_odds(model: Model, texts: list[str | None]) -> list[np.ndarray]:
    if model.key not in _known or len(_known[model.key][0]) > REMEMBERED:
        _known.clear()
        # row 0 ends a sequence
        _known[model.key] = dict.fromkeys(_STOPS, 0), np.zeros((1, 3))
    rows, table = _known[model.key]
    tokens: list[str] = []
    ends = []
    for text in texts:
        if text:
            tokens += _TOKEN.findall(text)
        tokens.append(".")
        ends.append(len(tokens))
    found = list(map(rows.get, tokens))
    if None in found:
        fresh = list(dict.fromkeys(t for t, k in zip(tokens, found) if k is None))
        rows.update(zip(fresh, range(len(table), len(table) + len(fresh))))
        table = np.concatenate((table, [model.emission(t) for t in fresh]))
        _known[model.key] = rows, table
        found = list(map(rows.get, tokens))
    at = np.array(found)
    word = at > 0
    number = np.cumsum(word)
    own, before, after = table[at[word]].T
    # a sequence begins after a stop, and after each full chain
    stops = np.flatnonzero(~word)
    runs = np.diff(np.concatenate(([0], number[stops])))
    runs = runs[runs > 0]
    cut = -(-runs // model.chain)
    lengths = np.full(cut.sum(), model.chain)
    lengths[np.cumsum(cut) - 1] = runs - (cut - 1) * model.chain
    ends_of = np.cumsum(lengths)
    scores = own + model.bias
    inner = np.ones(len(own), dtype=bool)
    inner[ends_of - 1] = False
    join = np.flatnonzero(inner)
    scores[join + 1] += before[join]
    scores[join] += after[join + 1]
    chains = Chains(lengths)
    ahead, back = chains.passes(chains.spread(scores), model.start, model.moves)
    odds = chains.flat([f + b for f, b in zip(ahead, back)])
    bounds = np.concatenate(([0], number[np.array(ends) - 1]))
    return [odds[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def document_score(model: Model, odds: np.ndarray) -> float:
    top, expected = summary(odds)
    w = model.document
    return float(1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * top + w[2] * expected)))))


def offending(text: str | None, odds: np.ndarray) -> list[dict]:
    """Runs of neighbouring words over one half: start and end in code points, and the largest probability."""
    high = np.flatnonzero(odds > 0).tolist()
    if not high:
        return []
    spans = [m.span() for m in _TOKEN.finditer(text) if m.group() not in _STOPS]
    out: list[dict] = []
    last = -2
    for i in high:
        p = float(1 / (1 + math.exp(-odds[i])))
        if i == last + 1:
            out[-1] = {"start": out[-1]["start"], "end": spans[i][1], "probability": max(p, out[-1]["probability"])}
        else:
            out.append({"start": spans[i][0], "end": spans[i][1], "probability": p})
        last = i
    return out


SCORED = "score double, spans array<struct<start:bigint,end:bigint,probability:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


def training_sample(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``sample_rows`` documents and ``sample_chars`` characters of each class.

    Only documents with a label and a text, and outside the held-out fold, can be in it.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    usable = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").where(crc_fold(F.col("doc_id"), 5) != 0)
    # ids and lengths first: no text is shuffled or sorted
    sizes = usable.select("doc_id", F.length("text").alias("n")).join(known, "doc_id")
    texts, toxic = [], []
    for label in (0, 1):
        ids, room = set(), settings.sample_chars
        for row in bounded_sample(sizes.where(F.col("__toxic") == label), settings.sample_rows, F.col("doc_id")).collect():
            if row.n <= room:
                room -= row.n
                ids.add(row.doc_id)
        if not ids:
            continue
        found = sorted({(r.doc_id, r.text) for r in usable.where(F.col("doc_id").isin(sorted(ids))).select("doc_id", "text").collect()})
        texts += [t for _, t in found]
        toxic += [label] * len(found)
    return texts, toxic


def train(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    model = fit(*training_sample(documents, labels, settings), settings)
    give_back()
    return model


def score(documents: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``documents`` with ``score`` and ``spans`` added; columns of these names are replaced.

    A null or empty text has no words: it gets the score of a document without any offending word, and no spans.
    """
    kept = documents.drop("score", "spans")
    at = kept.columns.index(text_column)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(at).to_pylist()
        found = log_odds(model, texts)
        scores = pa.array([document_score(model, odds) for odds in found], pa.float64())
        spans = pa.array([offending(*x) for x in zip(texts, found)], _SPANS)
        return pa.RecordBatch.from_arrays([*rows.columns, scores, spans], [*rows.schema.names, "score", "spans"])

    schema = kept.limit(0).selectExpr("*", "0D AS score", f"from_json('[]', '{SCORED.split('spans ')[1]}') AS spans").schema
    return map_arrow(kept, batch, schema)


def keep_clean(documents: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Rows of ``documents`` with a score below one half, unchanged, with all their columns. One narrow pass."""
    at = documents.columns.index(text_column)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = log_odds(model, rows.column(at).to_pylist())
        return rows.filter(pa.array([document_score(model, odds) < 0.5 for odds in found], pa.bool_()))

    return map_arrow(documents, batch, documents.schema)
