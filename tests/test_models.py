import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from textbayes.config import Config, load_config
from textbayes.operators import bayes, dependency, evaluation, explain, features, redundancy
from textbayes.plans import analyzer
from textbayes.storage import in_order

POSITIVE = ["湖水清澈见底岸边花开满园", "列车准时到站座位宽大舒适", "老师讲课清楚学生听得入神", "面包松软香甜还想再买一些", "夜晚星空明亮微风十分凉爽"]
NEGATIVE = ["河水浑浊发臭岸边垃圾成堆", "列车晚点三次座位破旧不堪", "老师讲课混乱学生昏昏欲睡", "面包又干又硬不想再买第二", "夜晚蚊虫成群闷热无法入睡"]
CONFIG = replace(Config(), redundancy_minimum_pair_df=2, minimum_jaccard=0.0, dependency_minimum_pair_df=2, dependency_support_tau=5.0, maximum_pairs_per_document=3)


@pytest.fixture(scope="module")
def docs(spark):
    data = [(t, 1) for t in POSITIVE * 4] + [(t, 0) for t in NEGATIVE * 4] + [("想再买想再买还想再", 1)] * 3 + [("不想再买不想", 0)] * 2
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(data)], "doc_id long, model_text string, label int").cache()


@pytest.fixture(scope="module")
def model(docs):
    return analyzer.fit(docs, CONFIG)


def test_vocabulary(spark):
    def vocab(texts, **k):
        config = replace(Config(), **k)
        d = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, model_text string, label int")
        return d, {r.gram: r.idx for r in features.vocabulary(features.term_stats(features.doc_grams(d, config)), config).collect()}

    _, v = vocab(["雨天雨天", "雨天有雾", "冰雹冰雹"], max_features=10)
    assert v["雨天"] == 0 and "冰雹" not in v
    texts = ["春江花月", "江花月夜", "花月夜静", "月夜静好", "夜静好眠"]
    _, v = vocab(texts, min_df=1, max_features=4)
    assert len(v) == 4 and sorted(v.values()) == list(range(4))
    _, free = vocab(texts, min_df=1, max_features=None)
    assert {g: i for g, i in free.items() if i < 4} == v and sorted(free.values()) == list(range(len(free)))
    d, v = vocab(["云海云雾云海", "云海云雾云海"], max_features=None)
    c = features.counts(features.doc_grams(d, Config()), spark.createDataFrame([(0, "云海")], "idx int, gram string"), replace(Config(), max_features=None))
    assert {r.tf for r in c.collect()} == {2}


def test_class_statistics(model, docs):
    texts = [(r.model_text, r.label) for r in docs.collect()]
    n1 = sum(y for _, y in texts)
    n0 = len(texts) - n1
    for r in model.params.collect():
        d0, d1 = (sum(r.gram in t for t, y in texts if y == k) for k in (0, 1))
        assert (r.df0, r.df1, r.df) == (d0, d1, d0 + d1)
        mi = sum(a / (n0 + n1) * math.log(a * (n0 + n1) / (f * n)) for a, f, n in ((d0, d0 + d1, n0), (d1, d0 + d1, n1), (n0 - d0, n0 + n1 - d0 - d1, n0), (n1 - d1, n0 + n1 - d0 - d1, n1)) if a)
        assert r.mi == pytest.approx(max(mi, 0), abs=1e-11) and 0 <= r.norm_mi <= 1
        p = [(d + 0.5) / (n + 1) for d, n in ((d0, n0), (d1, n1))]
        assert r.direction == pytest.approx(math.log(p[1] / (1 - p[1])) - math.log(p[0] / (1 - p[0])), abs=1e-12)
        assert 0.25 <= r.w_fwnb <= 1.5


def _scores(docs, model, config, params=None):
    return {r.doc_id: r for r in bayes.scores(docs, model.counts(docs), model.pairs(docs), params or model.params, model.classes, model.corrections, config).collect()}


def test_plain_scores(model, docs):
    params = {r.gram: r for r in model.params.collect()}
    got = _scores(docs, model, CONFIG)
    priors = model.classes.first()
    for r in docs.collect():
        for c, prior in ((0, priors.log_prior_0), (1, priors.log_prior_1)):
            for name, weight in (("StandardNB", None), ("FWNB", "w_fwnb"), ("DFWNB-v2", "w_dfwnb")):
                grams = [r.model_text[i : i + 2] for i in range(len(r.model_text) - 1)]
                expected = prior + sum(params[g][f"logp{c}"] * (params[g][weight] if weight else 1) for g in grams if g in params)
                assert got[r.doc_id][f"{name}_{c}"] == pytest.approx(expected, abs=1e-9)


def test_nesting(model, docs):
    unit = model.params.withColumns({"w_fwnb": F.lit(1.0), "w_dfwnb": F.lit(1.0)})
    for r in _scores(docs, model, replace(CONFIG, dependency_strength=0.0), unit).values():
        for c in (0, 1):
            assert r[f"StandardNB_{c}"] == pytest.approx(r[f"FWNB_{c}"], abs=1e-10) == pytest.approx(r[f"SDFWNB_{c}"], abs=1e-10)
    none = redundancy.redundancy_weights(model.params.drop("redundancy", "w_dfwnb"), model.params.select("idx", F.lit(0.0).alias("redundancy")), CONFIG)
    assert all(abs(r.w_fwnb - r.w_dfwnb) < 1e-12 for r in none.collect())


def test_redundancy_weights_keep_the_mean(spark):
    base, scores = [1.0, 0.5, 0.8, 1.2, 0.3], [0, 1, 0.5, 0, 0.2]
    stats = spark.createDataFrame([(i, w) for i, w in enumerate(base)], "idx int, w_fwnb double")
    out = redundancy.redundancy_weights(stats, spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "idx int, redundancy double"), Config())
    got = [r.w_dfwnb for r in out.orderBy("idx").collect()]
    assert np.mean(got) == pytest.approx(np.mean(base), rel=1e-12) and got[1] < base[1]


def test_dependencies(model, docs):
    rows = model.dependencies.collect()
    assert rows and any(abs(r.delta_1) > 0.01 for r in rows)
    for r in rows:
        assert r.delta_0 + r.delta_1 == pytest.approx(0, abs=1e-12) and abs(r.delta_raw_0) <= 4 and r.total_doc_freq >= 2
        assert r.trigram == r.left_feature + r.right_feature[-1] and r.preferred_class == ("positive" if r.delta_1 > 0 else "negative")
    again = dependency.dependency_table(model.pairs(docs), model.params, features.class_totals(docs), CONFIG)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    assert model.pairs(docs).groupBy("doc_id", "left_idx", "right_idx").count().where("count > 1").isEmpty()
    with pytest.raises(ValueError, match="negative"):
        dependency.strongest(model.dependencies, -1)


def test_doc_pairs(spark):
    vocab = spark.createDataFrame([("竹林", 0), ("林间", 1), ("间小", 2), ("小路", 3), ("路网", 4), ("网址", 5)], "gram string, idx int")
    d = spark.createDataFrame([(1, 0, "竹林间小路网址林间小嘻嘻嘻")], "doc_id long, label int, model_text string")
    assert sorted((r.left_idx, r.right_idx) for r in dependency.doc_pairs(d, vocab, Config()).collect()) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_pair_cap(model, docs):
    active = bayes.active_pairs(model.pairs(docs), model.corrections, CONFIG)
    assert active.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 3


def test_explanations_add_up(model, docs):
    for name in bayes.MODELS:
        for r in model.explain(docs, name, 2).collect():
            assert r.log_prior_0 + r.evidence_0 + r.effect_0 == pytest.approx(r.score0, abs=1e-9) and r.log_prior_1 + r.evidence_1 + r.effect_1 == pytest.approx(r.score1, abs=1e-9)
            assert len(r.features or []) <= 2
    some = model.explain(docs).where("effect_1 <> 0").first()
    assert some and abs(sum(d.effect_positive for d in some.dependencies) - some.effect_1) < 1e-9


def test_rankings(model):
    top = explain.top_features(model.params, 5).collect()
    assert [r.mutual_information for r in top] == sorted((r.mutual_information for r in top), reverse=True)
    assert all(r.direction < 0 for r in explain.top_features(model.params, 5, class_filter=0).collect())
    assert explain.redundancy_relations(model.params, 3).count() == 3 and explain.top_dependencies(model.dependencies, 2).count() == 2
    with pytest.raises(ValueError, match="ranked"):
        explain.top_features(model.params, by="x")


def test_end_to_end(spark, model, docs, tmp_path):
    report = model.evaluate(docs)
    metrics = {r.model: r for r in report["metrics"].collect()}
    assert set(metrics) == set(bayes.MODELS) and max(r.accuracy for r in metrics.values()) > 0.9
    new = spark.createDataFrame([(1, "湖水清澈花开"), (2, "河水发臭垃圾成堆"), (3, ""), (4, "陌生文字而已")], "doc_id long, model_text string")
    got = {r.doc_id: r for r in model.predict(new, ["SDFWNB"]).collect()}
    assert got[1].pred == 1 and got[2].pred == 0 and got[1].p1 > got[2].p1
    assert got[3].score1 == got[4].score1 == model.classes.first().log_prior_1
    loaded = analyzer.Model.load(spark, model.save(str(tmp_path / "m")))
    assert loaded.config == model.config and model.evaluate(docs).to_string().count("NB") == 4
    for name, column, value in (("params", "w_fwnb", -1.0), ("params", "logp1", float("nan")), ("params", "idx", 7), ("corrections", "delta_0", float("inf")), ("corrections", "left_idx", -1)):
        table = getattr(loaded, name)
        with pytest.raises(ValueError, match="need"):
            replace(loaded, **{name: table.withColumn(column, F.lit(value).cast(table.schema[column].dataType))}).checked()
    assert {r.doc_id: round(r.p1, 12) for r in loaded.predict(new, ["SDFWNB"]).collect()} == {i: round(r.p1, 12) for i, r in got.items()}
    assert model.predict(new.limit(0)).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        model.predict(new, ["x"])


def test_bad_input(spark, docs):
    with pytest.raises(ValueError, match="both"):
        analyzer.fit(docs.where("label = 1"), CONFIG)
    with pytest.raises(ValueError, match="empty"):
        analyzer.fit(docs.withColumn("model_text", F.lit("x")), CONFIG)
    for bad in ({"alpha": 0.0}, {"ngram_range": (2, 1)}, {"minimum_weight": 2.0}, {"dependency_pair_count": -1}):
        with pytest.raises(ValueError):
            replace(Config(), **bad)


def test_numbers_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("w"))
    got = in_order(df, [F.desc("k")], "t").collect()
    assert sorted((r.before, r.k) for r in got) == [(i, 999 - i) for i in range(1000)]
    weights = {r.k: r.w for r in df.collect()}
    assert all(r.before == sum(weights[k] for k in range(r.k + 1, 1000)) for r in in_order(df, [F.desc("k")], "t", F.col("w")).collect())


def test_scope_deletes_what_was_written(spark, docs, model):
    from textbayes.storage import materialize, scope

    outer = materialize(spark.range(3).toDF("x"), "t")
    with scope(spark):
        inner = materialize(spark.range(4).toDF("x"), "t")
        assert inner.count() == 4
    assert outer.count() == 3 and model.params.count() > 0
    with pytest.raises(Exception, match="exist|find"):
        spark.read.parquet(inner._written_to)


def predicted(spark, y, *models):
    rows = [(name, i, t, p, s) for name, ps, ss in models for i, (t, p, s) in enumerate(zip(y, ps, ss, strict=True))]
    return spark.createDataFrame(rows, "model string, doc_id long, label int, pred int, p1 double")


def test_auc_and_metrics(spark):
    value = lambda y, s: evaluation.auc(predicted(spark, y, ("m", [0] * len(y), s))).first().auc
    assert value([0, 1, 0, 1], [0.5] * 4) == 0.5 and value([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]) == 1.0 and value([1, 1], [0.1, 0.2]) is None
    m = evaluation.metrics(predicted(spark, [0, 1, 0, 1], ("m", [0, 1, 0, 1], [0.1, 0.9, 0.2, 0.8]))).first()
    assert m.accuracy == m.macro_f1 == m.auc == 1.0 and m.balanced_accuracy == m.macro_recall
    z = evaluation.metrics(predicted(spark, [0, 0], ("m", [0, 0], [0.1, 0.2]))).first()
    assert z.precision_positive == z.recall_positive == z.f1_positive == 0.0


def test_mcnemar(spark):
    p = predicted(spark, [1] * 4, ("a", [1, 0, 0, 0], [0.5] * 4), ("b", [0, 1, 1, 1], [0.5] * 4))
    r = evaluation.mcnemar(p, [("a", "b"), ("a", "a")]).orderBy("model_b").collect()
    assert (r[1].a_correct_b_wrong, r[1].a_wrong_b_correct, r[1].discordant_pairs, r[1].p_value_exact_two_sided) == (1, 3, 4, pytest.approx(0.625))
    assert (r[0].p_value_exact_two_sided, r[0].discordant_pairs, r[0]["significant_at_0.05"]) == (1.0, 0, False)
    df = spark.createDataFrame([(15, 63), (5, 13), (18, 39), (400, 1200), (0, 1), (1, 2)], "k long, n long")
    got = [2 * r.p for r in df.select(evaluation.binomial_lower_tail(F.col("k"), F.col("n")).alias("p")).collect()]
    for value, expected in zip(got, [3.7606121325417525e-05, 0.5810546875, 0.7492586247608418, None, 1.0, 1.5], strict=True):
        exact = expected or 2 * float(sum(math.comb(1200, i) for i in range(401)) * 1.0 / 2**1200 if False else math.exp(math.log(sum(math.comb(1200, i) for i in range(401))) - 1200 * math.log(2)))
        assert value == pytest.approx(exact, rel=1e-9)


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 60)
    noisy = lambda p: np.where(rng.random(60) < p, y, 1 - y)
    a, b = noisy(0.6), noisy(0.9)
    p = predicted(spark, y.tolist(), ("a", a.tolist(), [0.5] * 60), ("b", b.tolist(), [0.5] * 60))
    r, again = (evaluation.bootstrap(p, 5000, 123, [("a", "b")]).first() for _ in range(2))
    assert r == again and r.ci_95_lower <= r.mean_macro_f1_difference <= r.ci_95_upper and r.ci_excludes_zero == (r.ci_95_lower > 0 or r.ci_95_upper < 0)

    # resampled document by document
    def f1(t, q):
        return np.mean([2 * ((t == c) & (q == c)).sum() / max(1, (t == c).sum() + (q == c).sum()) for c in (0, 1)])

    diffs = [f1(y[k], b[k]) - f1(y[k], a[k]) for k in rng.integers(0, 60, (5000, 60))]
    assert r.mean_macro_f1_difference == pytest.approx(np.mean(diffs), abs=0.01)
    assert [r.ci_95_lower, r.ci_95_upper] == pytest.approx(np.percentile(diffs, [2.5, 97.5]), abs=0.02)


def test_metrics_keep_the_artifact_contract(spark, model, docs):
    report = model.evaluate(docs)
    for r in report["metrics"].collect():
        shares = {k: v for k, v in r.asDict().items() if isinstance(v, float)}
        assert all(0 <= v <= 1 for v in shares.values()) and r.balanced_accuracy == r.macro_recall and r.tn + r.fp + r.fn + r.tp == docs.count()
    tests = analyzer.significance(report["predictions"], CONFIG)
    assert all(r.discordant_pairs == r.a_correct_b_wrong + r.a_wrong_b_correct and 0 <= r.p_value_exact_two_sided <= 1 for r in tests["mcnemar"].collect())
    assert {(r.bootstrap_resamples, r.random_seed) for r in tests["bootstrap"].collect()} == {(5000, 142)}


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"text_feature": {"ngram_range": [1, 2], "min_df": 3}, "sdfwnb": {"minimum_pair_df": 9}, "dfwnb_v2": {"support_tau": 7.0}}')
    c = load_config(str(tmp_path / "c.json"))
    assert (c.ngram_range, c.min_df, c.dependency_minimum_pair_df, c.redundancy_support_tau) == ((1, 2), 3, 9, 7.0)
    with pytest.raises(FileNotFoundError):
        load_config("/none.json")
    with pytest.raises(ValueError, match="unknown"):
        Config.of({"x": 1})
