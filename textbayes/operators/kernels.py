"""Passes over documents that work on blocks of texts as arrays: what they need of the vocabulary goes to the tasks, so nothing is joined or shuffled.

That is for tables with a known bound (features.small); without a vocabulary limit the operators join rows of (document, gram) instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from textbayes.config import Config
from textbayes.functions import blocks
from textbayes.functions.text import holds_placeholder, is_script_bigram

#: The models in the order of nesting, and the weight of features in each (None: 1).
MODELS = {"StandardNB": None, "FWNB": "w_fwnb", "DFWNB-v2": "w_dfwnb", "SDFWNB": "w_dfwnb"}
#: Cells of a table of pair counts that a task keeps until its end.
PAIR_CELLS = 1 << 23
#: Pairs of candidates that are made at once.
PAIRS = 1 << 19


def over_blocks(docs: DataFrame, run: Callable, schema: StructType | str, text: str = "model_text", last: Callable | None = None) -> DataFrame:
    """run(rows, codes, at) for each block of docs, giving record batches; last(), if given, once at the end of a task, gives the rest. A null text is empty.

    run is made anew for each task by calling the given function, so it may keep state.
    """

    def task(batches) -> Iterator[pa.RecordBatch]:
        step, rest = run()
        for batch in batches:
            column = batch.column(text)
            for part in blocks.cut(column):
                rows = batch.slice(part.start, part.stop - part.start)
                yield from step(rows, *blocks.points([t or "" for t in blocks.strings(rows.column(text))]))
        if rest:
            yield from rest()

    return docs.mapInArrow(task, schema)


def _longs(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array(a, pa.int64()) for a in arrays]


def _sums(row: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """Sums by row that don't hang on the order of terms: their parts above 2**-20 add up exactly, what is left is too small to matter."""
    high = np.rint(of * 2.0**20) * 2.0**-20
    return np.bincount(row, high, rows).astype(np.float64) + np.bincount(row, of - high, rows)


def classes_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """For each row whether its label is 1, and whether it is another one; neither for null."""
    label = rows.column("label")
    one = np.asarray(label.fill_null(0)) == 1
    return one, ~one & ~np.asarray(label.is_null())


def gram_rows(docs: DataFrame, config: Config, text: str = "model_text") -> DataFrame:
    """(doc_id, label, gram, tf) of each document's distinct grams."""
    names, (low, high) = ["doc_id", "label", "gram", "tf"], config.ngram_range

    def run():
        def step(rows, codes, at):
            for n in range(low, high + 1):
                row, gram, times, strings = blocks.grams(codes, at, n)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(take), rows.column("label").take(take), strings.take(pa.array(gram)), *_longs(times)], names)

        return step, None

    kinds = docs.schema
    return over_blocks(
        docs.select("doc_id", "label", text), run, StructType([kinds["doc_id"], kinds["label"], StructField("gram", StringType()), StructField("tf", LongType())]), text
    )


def gram_stats(docs: DataFrame, config: Config, text: str = "model_text") -> DataFrame:
    """features.term_stats of documents: each block's grams are added up where they are counted."""
    names, (low, high) = ["gram", "df", "tf", "df0", "df1", "tf0", "tf1"], config.ngram_range

    def run():
        def step(rows, codes, at):
            one, zero = classes_of(rows)
            for n in range(low, high + 1):
                row, gram, times, strings = blocks.grams(codes, at, n)
                add = lambda w=None: np.bincount(gram, w, len(strings)).astype(np.int64)  # noqa: E731, B023
                o, z = one[row].astype(np.float64), zero[row].astype(np.float64)
                yield pa.RecordBatch.from_arrays([strings, *_longs(add(), add(times), add(z), add(o), add(z * times), add(o * times))], names)

        return step, None

    found = over_blocks(docs.select("label", text), run, "gram string, " + ", ".join(f"{n} long" for n in names[1:]), text)
    return found.groupBy("gram").agg(*(F.sum(n).alias(n) for n in names[1:]))


def candidate_pairs(docs: DataFrame, cands: DataFrame, config: Config) -> DataFrame:
    """redundancy.pair_frequency of documents; cands(idx, gram, mi) are bigrams.

    Candidates are numbered by rank, so a document's best ones are its least numbers. A task counts pairs in one table and gives it at its end.
    """
    table = cands.orderBy(F.desc("mi"), "idx").select("idx", "gram").collect()  # candidate_feature_count bounds it
    grams, idx, most = [r.gram for r in table], np.array([r.idx for r in table], np.int64), config.maximum_features_per_document

    def run():
        look, size = blocks.Lookup(grams) if grams else None, len(grams)
        kept = np.zeros(size * size, np.int64) if size * size <= PAIR_CELLS else None

        def batch(key, n):
            left, right = np.divmod(key, size)
            return pa.RecordBatch.from_arrays(_longs(np.minimum(idx[left], idx[right]), np.maximum(idx[left], idx[right]), n), ["left", "right", "n"])

        def step(rows, codes, at):
            if not size:
                return
            found = look(codes, at)
            hit = np.flatnonzero(found >= 0)
            row, cand, _ = blocks.tally(blocks.rows_of(at)[hit], found[hit], size)
            best = blocks.ranks(row, len(at) - 1) < most
            row, cand = row[best], cand[best]
            after = np.searchsorted(row, row, "right") - np.arange(len(row)) - 1  # those behind it in its document
            stride = max(1, PAIRS // most)
            for a in range(0, len(row), stride):
                n = after[a : a + stride]
                left = np.repeat(np.arange(a, a + len(n)), n)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
                key = cand[left] * size + cand[right]
                if kept is not None:
                    np.add.at(kept, key, 1)
                else:
                    yield batch(*blocks.tally(np.zeros(len(key), np.int64), key, size * size)[1:])

        def rest():
            if kept is not None:
                for a in range(0, len(kept), 1 << 18):
                    key = a + np.flatnonzero(kept[a : a + (1 << 18)])
                    if len(key):
                        yield batch(key, kept[key])

        return step, rest

    found = over_blocks(docs.select("model_text"), run, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))
    return found.select(F.col("left").cast("int").alias("left"), F.col("right").cast("int").alias("right"), "n")


def _script(vocab: DataFrame, config: Config) -> tuple[list[str], np.ndarray]:
    """The grams that pairs are made of, and their indexes."""
    rows = vocab.where(is_script_bigram(F.col("gram"), config.script_class) & ~holds_placeholder(F.col("gram"))).select("gram", "idx").collect()
    return [r.gram for r in rows], np.array([r.idx for r in rows], np.int64)


def _adjacent(look: blocks.Lookup | None, size: int, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, pair), each once: two different grams of which the second begins with the first one's end."""
    found = look(codes, at) if look else np.full(len(codes), -1, np.int64)
    place = np.flatnonzero((found[:-1] >= 0) & (found[1:] >= 0) & (found[:-1] != found[1:]))
    row, pair, _ = blocks.tally(blocks.rows_of(at)[place], found[place] * size + found[place + 1], size * size)
    return row, pair


def document_pairs(docs: DataFrame, vocab: DataFrame, config: Config, text: str = "model_text") -> DataFrame:
    """dependency.doc_pairs for a vocabulary with a small bound."""
    (grams, idx), names = _script(vocab, config), ["doc_id", "label", "left_idx", "right_idx"]

    def run():
        look = blocks.Lookup(grams) if grams else None

        def step(rows, codes, at):
            row, pair = _adjacent(look, len(grams), codes, at)
            left, right = np.divmod(pair, max(1, len(grams)))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(take), rows.column("label").take(take), *_longs(idx[left], idx[right])], names)

        return step, None

    kinds = docs.schema
    found = over_blocks(
        docs.select("doc_id", "label", text), run,
        StructType([kinds["doc_id"], kinds["label"], *(StructField(n, LongType()) for n in names[2:])]), text
    )
    return found.select("doc_id", "label", *(F.col(n).cast("int").alias(n) for n in names[2:]))


def pair_stats(docs: DataFrame, vocab: DataFrame, config: Config, text: str = "model_text") -> DataFrame:
    """(left_idx, right_idx, neg_doc_freq, pos_doc_freq): document_pairs counted by class, added up in each block."""
    (grams, idx), names = _script(vocab, config), ["left_idx", "right_idx", "neg_doc_freq", "pos_doc_freq"]

    def run():
        look = blocks.Lookup(grams) if grams else None

        def step(rows, codes, at):
            one, zero = classes_of(rows)
            row, pair = _adjacent(look, len(grams), codes, at)
            pairs, number = np.unique(pair, return_inverse=True)
            left, right = np.divmod(pairs, max(1, len(grams)))
            n = [np.bincount(number, x[row].astype(np.float64), len(pairs)).astype(np.int64) for x in (zero, one)]
            yield pa.RecordBatch.from_arrays(_longs(idx[left], idx[right], *n), names)

        return step, None

    found = over_blocks(docs.select("label", text), run, ", ".join(f"{n} long" for n in names), text)
    found = found.groupBy("left_idx", "right_idx").agg(*(F.sum(n).alias(n) for n in names[2:]))
    return found.select(*(F.col(n).cast("int").alias(n) for n in names[:2]), *names[2:])


class Scorer:
    """A model's tables as arrays, which tasks get whole: scores and evidence of documents, each from its own text alone."""

    def __init__(self, params: DataFrame, classes: DataFrame, corrections: DataFrame, config: Config):
        script = is_script_bigram(F.col("gram"), config.script_class) & ~holds_placeholder(F.col("gram"))
        p = params.select("idx", "gram", "w_fwnb", "w_dfwnb", "logp0", "logp1", script.alias("script")).orderBy("idx").toPandas()
        c = corrections.orderBy(F.desc("relevance"), "left_idx", "right_idx").toPandas()
        self.config, self.priors = config, [float(x) for x in classes.select("log_prior_0", "log_prior_1").first()]
        self.grams, self.idx = p.gram.tolist(), p.idx.to_numpy(np.int64)
        self.logp = [p[f"logp{k}"].to_numpy(np.float64) for k in (0, 1)]
        self.weight = {m: p[w].to_numpy(np.float64) if w else np.ones(len(p)) for m, w in MODELS.items()}
        # pairs are looked for as trigrams; only such can be in a document
        gram, pairs = dict(zip(self.idx.tolist(), zip(self.grams, p.script.tolist(), strict=True), strict=True)), []
        for r in c.itertuples():
            (left, a), (right, b) = (gram.get(i, ("", False)) for i in (r.left_idx, r.right_idx))
            if a and b and left != right and left[1] == right[0]:
                pairs.append((left + right[1], left, right, float(r.delta_0), float(r.delta_1)))
        self.trigrams, self.left, self.right = ([x[k] for x in pairs] for k in range(3))
        self.delta = [np.array([x[k] for x in pairs], np.float64) * config.dependency_strength for k in (3, 4)]
        self.order = np.empty(len(pairs), np.int64)
        self.order[sorted(range(len(pairs)), key=self.trigrams.__getitem__)] = np.arange(len(pairs))

    def _ready(self) -> tuple[Callable, Callable]:
        """terms and active, both of (codes, at): (text, feature, times), and (text, correction) of the most relevant corrections of each text."""
        by_length: dict[int, list[int]] = {}
        for k, g in enumerate(self.grams):
            by_length.setdefault(len(g), []).append(k)
        looks = [(blocks.Lookup([self.grams[k] for k in places]), np.array(places)) for places in by_length.values()]
        pairs = blocks.Lookup(self.trigrams) if self.trigrams else None

        def terms(codes, at):
            of, rows, features = blocks.rows_of(at), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for look, places in looks:
                found = look(codes, at)
                hit = np.flatnonzero(found >= 0)
                rows.append(of[hit])
                features.append(places[found[hit]])
            return blocks.tally(np.concatenate(rows), np.concatenate(features), max(1, len(self.grams)))

        def active(codes, at):
            if pairs is None:
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
            found = pairs(codes, at)
            hit = np.flatnonzero(found >= 0)
            row, pair, _ = blocks.tally(blocks.rows_of(at)[hit], found[hit], len(self.trigrams))
            best = blocks.ranks(row, len(at) - 1) < self.config.maximum_pairs_per_document
            return row[best], pair[best]

        return terms, active

    def _effects(self, row, pair, n) -> list[np.ndarray]:
        return [_sums(row, d[pair], n) for d in self.delta]

    def _scores(self, terms, effects, n) -> dict[str, np.ndarray]:
        row, place, times = terms
        out = {}
        for m in MODELS:
            for k in (0, 1):
                if m == "SDFWNB":
                    out[f"{m}_{k}"] = out[f"DFWNB-v2_{k}"] + effects[k]
                else:
                    out[f"{m}_{k}"] = self.priors[k] + _sums(row, times * self.logp[k][place] * self.weight[m][place], n)
        return out

    def _evidence(self, terms, model) -> list[np.ndarray]:
        _, place, times = terms
        return [times * self.weight[model][place] * self.logp[k][place] for k in (0, 1)]

    @staticmethod
    def _strongest(row, ev, tie, n, rows) -> np.ndarray:
        """Places of each row's n entries with the largest difference, in order."""
        order = np.lexsort((tie, -np.round(np.abs(ev[1] - ev[0]), 12), row))
        return order[blocks.ranks(row[order], rows) < n]

    def _over(self, docs: DataFrame, step: Callable, fields: list[StructField]) -> DataFrame:
        kinds = docs.schema
        names = ["doc_id", "label", *(f.name for f in fields)]

        def run():
            terms, active = self._ready()

            def one(rows, codes, at):
                take, columns = step(terms, active, codes, at)
                ids = [rows.column(c) if take is None else rows.column(c).take(pa.array(take)) for c in names[:2]]
                yield pa.RecordBatch.from_arrays([*ids, *columns], names)

            return one, None

        return over_blocks(docs.select("doc_id", "label", "model_text"), run, StructType([kinds["doc_id"], kinds["label"], *fields]))

    def score(self, docs: DataFrame) -> DataFrame:
        """bayes.scores of documents."""
        names = [f"{m}_{k}" for m in MODELS for k in (0, 1)]

        def step(terms, active, codes, at):
            n = len(at) - 1
            scores = self._scores(terms(codes, at), self._effects(*active(codes, at), n), n)
            return None, [pa.array(scores[c]) for c in names]

        return self._over(docs, step, [StructField(c, DoubleType()) for c in names])

    def evidence(self, docs: DataFrame, model: str, n: int) -> DataFrame:
        """(doc_id, label, rank, idx, feature, count, weight, evidence_negative, evidence_positive): each document's n strongest terms of a score."""
        grams = pa.array(self.grams, pa.string())

        def step(terms, active, codes, at):
            row, place, times = found = terms(codes, at)
            ev = self._evidence(found, model)
            best = self._strongest(row, ev, place, n, len(at) - 1)
            row, place = row[best], place[best]
            rank = blocks.ranks(row, len(at) - 1) + 1
            return row, [
                pa.array(rank, pa.int32()), pa.array(self.idx[place], pa.int32()), grams.take(pa.array(place)), *_longs(times[best]),
                *(pa.array(x) for x in (self.weight[model][place], ev[0][best], ev[1][best]))
            ]

        kinds = "rank int, idx int, feature string, count long, weight double, evidence_negative double, evidence_positive double"
        return self._over(docs, step, StructType.fromDDL(kinds).fields)

    def effects(self, docs: DataFrame) -> DataFrame:
        """(doc_id, label, trigram, left_feature, right_feature, effect_negative, effect_positive) of the pairs that count in each document."""
        names = [pa.array(x, pa.string()) for x in (self.trigrams, self.left, self.right)]

        def step(terms, active, codes, at):
            row, pair = active(codes, at)
            return row, [*(x.take(pa.array(pair)) for x in names), *(pa.array(d[pair]) for d in self.delta)]

        kinds = "trigram string, left_feature string, right_feature string, effect_negative double, effect_positive double"
        return self._over(docs, step, StructType.fromDDL(kinds).fields)

    def explain(self, docs: DataFrame, model: str, n: int) -> DataFrame:
        """All scores, sums of one model's evidence and effects, and the n strongest of either as arrays; see explain.explanations."""
        grams, names = pa.array(self.grams, pa.string()), [pa.array(x, pa.string()) for x in (self.trigrams, self.left, self.right)]
        scores = [f"{m}_{k}" for m in MODELS for k in (0, 1)]
        term, effect = ["feature", "count", "weight", "evidence_negative", "evidence_positive"], ["trigram", "left_feature", "right_feature", "effect_negative", "effect_positive"]

        def lists(row, columns, fields, rows):
            ends = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields), mask=pa.array(ends[1:] == ends[:-1]))

        def step(terms, active, codes, at):
            rows = len(at) - 1
            found, (row, pair) = terms(codes, at), active(codes, at)
            every = self._scores(found, self._effects(row, pair, rows), rows)
            if model != "SDFWNB":
                row, pair = row[:0], pair[:0]
            ev, effects = self._evidence(found, model), [d[pair] for d in self.delta]
            best = self._strongest(found[0], ev, found[1], n, rows)
            place = pa.array(found[1][best])
            first = lists(found[0][best], [
                grams.take(place), *_longs(found[2][best]), *(pa.array(x) for x in (self.weight[model][found[1][best]], ev[0][best], ev[1][best]))
            ], term, rows)
            top = self._strongest(row, effects, self.order[pair], n, rows)
            second = lists(row[top], [*(x.take(pa.array(pair[top])) for x in names), *(pa.array(x[top]) for x in effects)], effect, rows)
            return None, [
                *(pa.array(every[c]) for c in scores), *(pa.array(_sums(found[0], x, rows)) for x in ev), first,
                *(pa.array(_sums(row, x, rows)) for x in effects), second
            ]

        doubles = lambda *names: ", ".join(f"`{c}` double" for c in names)
        kinds = (
            f"{doubles(*scores, 'evidence_0', 'evidence_1')}, features array<struct<feature: string, count: long, weight: double, evidence_negative: double, "
            f"evidence_positive: double>>, {doubles('effect_0', 'effect_1')}, dependencies array<struct<trigram: string, left_feature: string, right_feature: string, "
            f"effect_negative: double, effect_positive: double>>"
        )
        return self._over(docs, step, StructType.fromDDL(kinds).fields)
