"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier per bit separates the languages with a 1 there from those with a 0.
A classifier is a linear function of the shares of hashed character n-grams (1 to 3) of the lower-cased letters of a
text, with each run of other characters as one blank. A text's margins are decoded by loss: the language whose codeword
has the smallest sum of weighted logistic losses is chosen, and the gap to the next one says how ambiguous the text is.
Weights of bits come from the accuracy of their classifiers.

Classifiers are fitted on the driver from a bounded sample of every language (``Settings``): a stretch of each sampled
document, and pieces of it, so that short texts are known too. The sample takes two passes, however many languages there are;
prediction is one narrow pass.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import crc_fold, map_arrow


@dataclass(frozen=True)
class Settings:
    """The sample: ``sample_rows`` documents of each language, of each at most ``sample_chars`` characters in a row.

    Where there are many languages each has fewer, so that all have ``most_rows`` together, but ``least_rows`` at least.
    """

    sample_rows: int = 200
    sample_chars: int = 1000
    most_rows: int = 20_000
    least_rows: int = 8
    pieces: tuple[int, ...] = (15, 40, 120, 400)
    buckets: int = 1 << 14
    most_bits: int = 31
    rounds: int = 80
    l2: float = 1e-4
    ambiguous: float = 0.2


@dataclass
class Model:
    """``weights``: (buckets, bits); ``codes``: (languages, bits) of -1 and 1; ``trust``: a weight for each bit."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    buckets: int
    scale: float
    ambiguous: float


def codewords(n: int, most_bits: int) -> np.ndarray:
    """Codes of n languages: all splits of them in two (the exhaustive code) where these fit, else random ones far apart.

    Two and three languages have too few splits to correct an error, so each of these is there more than once; see ``fit``.
    """
    if n == 1:
        return np.ones((1, 1))
    if 2 ** (n - 1) - 1 <= most_bits:
        bits = [[1, *rest] for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.tile(np.array(bits, dtype=float).T, (1, {2: 3, 3: 2}.get(n, 1)))
    rng, best = np.random.Generator(np.random.PCG64(7)), None
    for _ in range(200):
        trial = rng.choice([-1.0, 1.0], size=(n, most_bits))
        apart = ((trial[:, None, :] != trial[None, :, :]).sum(axis=2) + np.eye(n) * most_bits).min()
        if np.abs(trial.sum(axis=0)).max() < n and (best is None or apart > best[0]):
            best = (apart, trial)
    return best[1]


_letters = np.zeros(0, dtype=bool)


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if not len(_letters):
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters[points]


def grams(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of all 1- to 3-grams of the letters of a text, blanks between words; empty without a letter."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter(points)
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    # a blank for each run of other characters, and one at either end
    letter = np.concatenate(([False], letter, [False]))
    points = np.where(letter, np.concatenate(([0], points, [0])), 32).astype(np.uint64)
    points = points[letter | np.concatenate(([True], letter[:-1]))]
    one = points * np.uint64(0x9E3779B97F4A7C15)
    two = one[1:] + points[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[1:] + points[:-2] * np.uint64(0x165667B19E3779F9)
    every = np.concatenate((one[points != 32], two, three))
    every = (every ^ (every >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (every >> np.uint64(40)).astype(np.int64) % buckets


def fit(texts: list[str], languages: list[str], settings: Settings = Settings()) -> Model:
    """Logistic classifiers of all bits at once, by gradient descent on whole texts and pieces of them.

    Bits of one split learn from different thirds less of the texts, so that they can be wrong one by one.
    One language only: it is always chosen. No text at all: a model without languages, which predicts ``und``.
    """
    names = sorted(set(languages))
    empty = np.zeros((settings.buckets, 1))
    if not names:
        return Model([], np.zeros((0, 1)), empty, np.zeros(1), np.ones(1), settings.buckets, 1.0, settings.ambiguous)
    codes = codewords(len(names), settings.most_bits)
    rows, labels, texts_of = [], [], []
    for at, (text, name) in enumerate(zip(texts, languages)):
        parts = [text]
        for k, n in enumerate(settings.pieces):
            begin = (len(text) * (k + 1)) // (len(settings.pieces) + 2)
            parts.append(text[begin : begin + n])
        for part in parts:
            found = grams(part, settings.buckets)
            if len(found):
                rows.append(np.unique(found, return_counts=True))
                labels.append(names.index(name))
                texts_of.append(at)
    if not rows:
        return Model([], np.zeros((0, 1)), empty, np.zeros(1), np.ones(1), settings.buckets, 1.0, settings.ambiguous)
    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    what = np.concatenate([f for f, _ in rows])
    share = np.concatenate([c / c.sum() for _, c in rows])
    labels = np.array(labels)
    counts = np.bincount(labels, minlength=len(names))
    sides = codes[labels]
    scale, bits = 20.0, codes.shape[1]
    weights, bias = np.zeros((settings.buckets, bits)), np.zeros(bits)
    memory = np.full((settings.buckets, bits), 1e-8)
    begins = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
    balance = (1.0 / counts[labels] / len(names))[:, None]
    same = np.array([(codes[:, :k] == codes[:, k : k + 1]).all(axis=0).sum() for k in range(bits)])
    if same.any():
        learned = (np.array(texts_of)[:, None] + same[None, :]) % 3 != 0
        balance = balance * learned
    order = np.argsort(what, kind="stable")
    used, first = np.unique(what[order], return_index=True)
    for _ in range(settings.rounds):
        margin = scale * np.add.reduceat(weights[what] * share[:, None], begins, axis=0) + bias
        pull = balance * sides / (1 + np.exp(np.clip(sides * margin, -30, 30)))
        slope = scale * np.add.reduceat(share[order][:, None] * pull[owner[order]], first, axis=0) - settings.l2 * weights[used]
        memory[used] += slope * slope
        weights[used] += 0.3 * slope / np.sqrt(memory[used])
        bias += 0.5 * pull.sum(axis=0)
    margin = scale * np.add.reduceat(weights[what] * share[:, None], begins, axis=0) + bias
    right = np.clip((balance * (sides * margin > 0)).sum(axis=0) / np.maximum(balance.sum(axis=0), 1e-9), 0.5, 1 - 1e-3)
    trust = np.log(right / (1 - right)) + 1e-3
    return Model(names, codes, weights, bias, trust / trust.sum(), settings.buckets, scale, settings.ambiguous)


def predict_texts(model: Model, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """(language, score, ambiguous) of each text."""
    out = []
    for text in texts:
        found = grams(text, model.buckets)
        if not len(found) or not model.languages:
            out.append(("und", 0.0, True))
            continue
        counts = np.bincount(found, minlength=model.buckets)
        used = np.flatnonzero(counts)
        margin = model.scale * (counts[used] / len(found)) @ model.weights[used] + model.bias
        loss = (np.logaddexp(0.0, -model.codes * margin) * model.trust).sum(axis=1)
        chance = np.exp(-(loss - loss.min()) * model.codes.shape[1])
        chance /= chance.sum()
        best = int(np.argmin(loss))
        rest = np.delete(loss, best)
        gap = float(rest.min() - loss[best]) if len(rest) else 1.0
        out.append((model.languages[best], float(chance[best]), gap < model.ambiguous))
    return out


def training_sample(documents: DataFrame, settings: Settings = Settings()) -> tuple[list[str], list[str]]:
    """Stretches of text and their languages, of each language's documents with the smallest hashes outside the held-out fold.

    Every language that has a document with an id and a text is there. A stretch of a longer document begins at a place
    drawn by hash. A language's rows are cut to its share inside each task before they are shuffled, without whole texts.
    """
    usable = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(crc_fold(F.col("doc_id"), 3) != 1)
    n = usable.agg(F.count_distinct("lang")).first()[0]
    if not n:
        return [], []
    own = max(settings.least_rows, min(settings.sample_rows, settings.most_rows // n))
    draw = F.xxhash64("doc_id", "lang")
    room = F.greatest(F.length("text") - settings.sample_chars, F.lit(0)) + 1
    stretch = F.substring("text", (F.pmod(draw, room) + 1).cast("int"), F.lit(settings.sample_chars))
    rows = usable.select(F.col("lang").cast("string").alias("lang"), "doc_id", draw.alias("draw"), stretch.alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    found = rows.withColumn("place", place).where(F.col("place") <= own).select("lang", "doc_id", "text").collect()
    chosen = sorted({(r.lang, r.doc_id, r.text) for r in found})
    return [t for _, _, t in chosen], [name for name, _, _ in chosen]


def train(documents: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of every language outside the held-out fold; rows without id, text or language teach nothing."""
    return fit(*training_sample(documents, settings), settings)


def identify(documents: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``documents`` with ``lang_pred``, ``score`` and ``ambiguous`` added; columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0, and ambiguous.
    """
    kept = documents.drop("lang_pred", "score", "ambiguous")
    at = kept.columns.index(text_column)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = predict_texts(model, rows.column(at).to_pylist())
        made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([*rows.columns, *made], [*rows.schema.names, "lang_pred", "score", "ambiguous"])

    schema = kept.limit(0).selectExpr("*", "'' AS lang_pred", "0D AS score", "true AS ambiguous").schema
    return map_arrow(kept, batch, schema)
