"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The features are densities and strengths of lexicon words, their nearness to second-person words, and rates of capitals, punctuation
and obfuscation. The lexicon is learned from labelled texts: words and beginnings of words that toxic texts have far more often.
So that the trees don't see the lexicon's own training rows, labelled rows are dealt into folds; the features of a fold use the
lexicon of the other folds, and the calibration uses scores of trees fitted without the fold.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, Isotonic
from .common import blocks, discard, materialize, texts
from .decontaminate import WORDS

#: Most labelled rows that a fit uses (those with the least hashes of doc_id, so the choice repeats).
SAMPLE = 20_000
#: Most lexicon terms, the heaviest by weight times toxic texts: the size of the model, not of what it learns from.
TERMS = 4_000
FOLDS = 4
#: Lengths in bytes of the beginnings of words that are lexicon terms too.
BEGINNINGS = (4, 5, 6, 7)
NEAR = 5
#: Second-person words of the corpus languages.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen sie ihr euch euer usted ustedes ti tus vosotros vuestro".split()
NAMES = [
    "log_words", "hits", "hit_density", "weight", "weight_density", "strongest", "second_strongest", "different_hits", "strong_hits", "strong_density", "densest_stretch",
    "you_density", "you_nearest", "near_you", "capitals", "capital_words", "exclamations", "questions", "punctuation", "symbols", "digits", "digit_inside", "symbol_inside", "repeated_letters", "beyond_ascii", "word_length",
]


def terms_of(word: bytes) -> list[bytes]:
    return [word, *(word[:k] + b"*" for k in BEGINNINGS if len(word) > k)]


class Weights(dict):
    """word -> weight of its heaviest lexicon term, 0 without one, kept for words seen before."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) > 200_000:
            self.clear()
        self[word] = w = max([0.0, *(self.lexicon.get(t, 0.0) for t in terms_of(word))])
        return w


_YOU = frozenset(w.encode() for w in SECOND_PERSON)
_IS = np.zeros((7, 256), bool)
for _k, _test in enumerate((
    lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: b in b".,;:'\"()-!?", lambda b: b in b"*#$%&@^~_|<>+=\\/{}[]",
    lambda b: 48 <= b <= 57, lambda b: b >= 128, lambda b: b <= 32
)):
    _IS[_k] = [_test(b) for b in range(256)]


def features(text: bytes, weights: Weights) -> list[float]:
    words = text.translate(WORDS).split()
    n = len(words) or 1
    w = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    hit = np.flatnonzero(w)
    strong = w[hit] >= 3.0
    you = np.array([i for i, x in enumerate(words) if x in _YOU], np.int64)
    nearest, near = 50.0, 0
    if len(hit) and len(you):
        at = np.searchsorted(you, hit)
        apart = np.minimum(np.abs(hit - you[np.minimum(at, len(you) - 1)]), np.abs(hit - you[np.maximum(at - 1, 0)]))
        nearest, near = min(50.0, float(apart.min())), int((apart <= NEAR).sum())
    stretch = 0
    if len(hit):
        stretch = int((np.searchsorted(hit, hit + 20) - np.arange(len(hit))).max())
    kinds = {words[i]: w[i] for i in hit.tolist()}
    top = sorted(kinds.values(), reverse=True)[:2] + [0.0, 0.0]
    raw = np.frombuffer(text, np.uint8)
    size = len(raw) or 1
    upper, lower, punct, symbol, digit, high, space = (_IS[k][raw] for k in range(7))
    letter = upper | lower | high
    letters = int(letter.sum()) or 1
    inside = lambda kind: int((kind[1:-1] & letter[:-2] & letter[2:]).sum()) if size > 2 else 0
    begin = ~space
    begin[1:] &= space[:-1]
    again = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & letter[2:] if size > 2 else np.zeros(0)
    shouted = int((upper[:-1] & upper[1:]).sum()) if size > 1 else 0
    return [
        math.log1p(len(words)), len(hit), len(hit) / n, w.sum(), w.sum() / n, top[0], top[1], len(kinds), int(strong.sum()), strong.sum() / n, stretch,
        len(you) / n, nearest, near, upper.sum() / letters, shouted / letters, text.count(b"!") / n, text.count(b"?") / n, punct.sum() / size, symbol.sum() / size, digit.sum() / size,
        inside(digit) / n, inside(symbol) / n, again.sum() / letters, high.sum() / letters, letters / n,
    ]


def _term_counts(only: frozenset | None):
    """Labelled texts -> (term, fold, toxic, clean): in how many texts each term occurs; partly added up."""

    def run(batches):
        counts: Counter = Counter()
        for rows, data, offsets in blocks(batches):
            for text, fold, toxic in zip(texts(data, offsets), rows.column("fold").to_pylist(), rows.column("toxic").to_pylist(), strict=True):
                found = {t for w in set(text.translate(WORDS).split()) if len(w) > 2 for t in terms_of(w)}
                counts.update((t, fold, toxic) for t in (found if only is None else found & only))
            if len(counts) > 200_000:
                yield _rows(counts)
                counts = Counter()
        yield _rows(counts)

    def _rows(counts):
        t, f, y = zip(*counts, strict=True) if counts else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(t, pa.binary()), pa.array(f, pa.int32()), pa.array(y, pa.int32()), pa.array(counts.values(), pa.int64())],
            ["term", "fold", "toxic", "n"]
        )

    return run


_COUNTS = "term binary, fold int, toxic int, n long"


def _features(lexicons: list[dict]):
    def run(batches):
        weights = [Weights(x) for x in lexicons]
        for rows, data, offsets in blocks(batches):
            x = [features(t, weights[f]) for t, f in zip(texts(data, offsets), rows.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("fold"), rows.column("toxic"), pa.array(x, pa.list_(pa.float64()))],
                ["doc_id", "fold", "toxic", "x"]
            )

    return run


class ToxicityModel:
    """lexicon, trees and calibration; without labelled rows of both kinds the score is the share of toxic ones (0 without any)."""

    def __init__(self, lexicon=None, trees=None, calibration=None, rate: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.rate = lexicon or {}, trees, calibration, rate

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.rate)
        raw = self.trees.raw(x)
        return np.clip(0.999 * self.calibration(raw) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)  # the last part keeps the order within a step


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic, fold) of at most SAMPLE labelled rows whose crc32(doc_id as text) mod 5 is not 0; the fold is that remainder less 1.

    Rows with a null id or label are left out; a doc_id that repeats in labels has the larger label, one that repeats in docs gives a row each.
    """
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    ).dropna().where(rest != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.join(
        docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi"
    ).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # SAMPLE bounds its size
    return rows.select("doc_id", "text", "toxic", (rest - 1).cast("int").alias("fold"))


def lexicon_of(counts: dict[bytes, np.ndarray], rows: np.ndarray, without: int | None) -> dict[bytes, float]:
    """counts: term -> (fold, label) counts of texts; rows: texts by (fold, label). Weights are smoothed log ratios of the two rates."""
    use = [f for f in range(FOLDS) if f != without]
    clean, toxic = rows[use].sum(0)
    least, out = max(3, math.ceil(0.004 * toxic)), {}
    for term, c in counts.items():
        a, b = c[use].sum(0)[::-1].tolist()
        if a >= least:
            weight = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
            if weight >= 1.6:
                out[term] = weight
    return out


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The model of labels.toxic; see training_rows for the rows it uses. The driver gets counts of terms of the sample's toxic texts and SAMPLE rows of features."""
    sample = materialize(training_rows(docs, labels), "toxicity-sample")
    rows = np.zeros((FOLDS, 2))
    for r in sample.groupBy("fold", "toxic").count().collect():
        rows[r.fold, min(r.toxic, 1)] += r["count"]
    if not rows.sum(0).all():
        return ToxicityModel(rate=float(rows[:, 1].sum() / max(1, rows.sum())))
    toxic = sample.where("toxic > 0").mapInArrow(
        _term_counts(None), _COUNTS
    ).groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, int(0.003 * rows[:, 1].sum())))
    names = frozenset(bytes(r["term"]) for r in toxic.toArrow().to_pylist())  # the words of the sample's toxic texts bound their number
    counted = sample.mapInArrow(_term_counts(names), _COUNTS).groupBy("term", "fold", "toxic").agg(F.sum("n").alias("n"))
    counts: dict[bytes, np.ndarray] = {}
    for r in counted.toArrow().to_pylist():
        counts.setdefault(bytes(r["term"]), np.zeros((FOLDS, 2)))[r["fold"], min(r["toxic"], 1)] += r["n"]
    lexicons = []
    for without in [*range(FOLDS), None]:
        lexicon = lexicon_of(counts, rows, without)
        best = sorted(lexicon, key=lambda t: (-lexicon[t] * counts[t][:, 1].sum(), t))[:TERMS]
        lexicons.append({t: lexicon[t] for t in best})
    got = sample.mapInArrow(_features(lexicons[:-1]), "doc_id long, fold int, toxic int, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    discard(sample)
    x = np.array(got["x"].combine_chunks().values.to_numpy(zero_copy_only=False)).reshape(-1, len(NAMES))
    y, fold = np.minimum(got["toxic"].to_numpy(), 1).astype(float), got["fold"].to_numpy()
    out = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any():
            out[fold == k] = Boosted().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    return ToxicityModel(lexicons[-1], Boosted().fit(x, y), Isotonic().fit(out, y))


def _score(model):
    def run(batches):
        weights = Weights(model.value.lexicon)
        for rows, data, offsets in blocks(batches):
            x = np.array([features(t, weights) for t in texts(data, offsets)], np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.value.score(x))], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, score, predicted), one row for each row; only the text is an input of the score.

    Null and empty texts are scored like a text without words, long ones whole; equal texts score the same, repeated rows come back as often as they
    stand there, an empty table gives an empty result. held_out is whether crc32(doc_id as text) mod 5 is 0 (a null doc_id
    counts as empty text, so it is held out). Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(sent), "doc_id long, score double")
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return scored.select("doc_id", (rest == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(model):
    def run(batches):
        weights = Weights(model.value.lexicon)
        for rows, data, offsets in blocks(batches):
            x = np.array([features(t, weights) for t in texts(data, offsets)], np.float64).reshape(-1, len(NAMES))
            yield rows.filter(pa.array(model.value.score(x) < 0.5))

    return run


def reject_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs without those that score 0.5 or more; all columns stay. Null and empty texts score like a text without words; repeated rows go or stay
    together; long texts are scored whole; an empty table stays empty."""
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
