"""Passes over blocks of texts against rows of (document, gram), and what their plans hold."""

import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from textbayes.functions import blocks
from textbayes.operators import bayes, dependency, features, kernels, redundancy
from textbayes.plans import analyzer

from .test_models import CONFIG, NEGATIVE, POSITIVE


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    data = [("".join(rng.choices(POSITIVE if y else NEGATIVE, k=2)) + "不想再买，"[: rng.randrange(6)] * rng.randrange(3), y) for y in (0, 1) for _ in range(40)] + [("", 0), (None, 1), ("雨", 0)]
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(data)], "doc_id long, model_text string, label int").cache()


@pytest.fixture(scope="module")
def model(docs):
    return analyzer.fit(docs, CONFIG)


def values(df):
    def plain(x):
        return round(x, 9) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x

    columns = sorted(df.columns)
    return sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)


def physical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_make_no_rows_of_grams(model, docs):
    ready = analyzer.prepared(docs)
    for df in (model.score(docs), model.evidence(docs, "FWNB"), model.effects(docs), kernels.gram_stats(ready, CONFIG), dependency.pair_stats(ready, model.params, CONFIG),
               redundancy.document_pair_frequency(ready, model.params, redundancy.candidates(model.params, CONFIG), CONFIG)):
        assert not {"Generate", "Join", "Window"} & {line.strip(" +-:*").split(" ")[0] for line in physical(df).splitlines()}
    for df in (model.score(docs), model.evidence(docs, "FWNB"), model.effects(docs), model.explain(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_same_as_rows(spark, model, docs):
    free = replace(model, config=replace(CONFIG, max_features=None))  # without a bound documents' rows are joined
    assert values(model.score(docs)) == values(free.score(docs)) and values(model.effects(docs)) == values(free.effects(docs)) != []
    for name in bayes.MODELS:
        assert values(model.evidence(docs, name, 3)) == values(free.evidence(docs, name, 3))
        a, b = model.explain(docs, name, 3), free.explain(docs, name, 3)
        assert values(a) == values(b) and a.columns == b.columns and [t for _, t in a.dtypes] == [t for _, t in b.dtypes]
    grown = analyzer.fit(docs, free.config)
    assert all(values(getattr(model, t)) == values(getattr(grown, t)) for t in model.tables)


def test_grams_of_documents(spark, docs):
    config = replace(CONFIG, ngram_range=(1, 4))
    expected = {}
    for r in docs.collect():
        t = r.model_text or ""
        expected[r.doc_id] = Counter(g for n in range(1, 5) for i in range(len(t) - n + 1) if (g := t[i : i + n]).strip(blocks.PUNCTUATION))
    rows = features.doc_grams(docs, config)
    assert {(r.doc_id, r.gram): r.tf for r in rows.collect()} == {(d, g): n for d, c in expected.items() for g, n in c.items()}
    unlabelled = docs.withColumn("label", F.when(F.col("doc_id") % 5 > 0, F.col("label")))
    assert values(features.gram_stats(unlabelled, config)) == values(features.term_stats(features.doc_grams(unlabelled, config)))


@pytest.mark.parametrize(("cells", "pairs"), [(1 << 23, 1 << 19), (0, 7), (1 << 23, 7)])
def test_candidate_pairs(model, docs, monkeypatch, cells, pairs):
    monkeypatch.setattr(kernels, "PAIR_CELLS", cells)
    monkeypatch.setattr(kernels, "PAIRS", pairs)
    config = replace(CONFIG, maximum_features_per_document=5)
    cands = redundancy.candidates(model.params, config)
    expected = redundancy.pair_frequency(model.counts(docs), cands, config)
    assert values(redundancy.document_pair_frequency(docs, model.params, cands, config)) == values(expected) != []


def test_corrections_of_no_trigram_never_apply(model, docs):
    odd = model.corrections.withColumn("right_idx", F.col("left_idx"))
    assert replace(model, corrections=odd).effects(docs).isEmpty()
