"""The whole protocol: fit, score, evaluate, explain, save and load.

A fit runs in steps; each step's table is written to the shared folder and read back, so that a model's parameters are scans, and plans that
use them stay as short as the last step.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbayes.config import Config
from textbayes.operators import bayes, dependency, evaluation, explain, features, kernels, redundancy
from textbayes.storage import discard, materialize, one_row

VERSION = 1


def prepared(docs: DataFrame) -> DataFrame:
    """docs(doc_id, label, model_text), label null where there is none, normalized once: later steps read what this writes."""
    docs = docs if "label" in docs.columns else docs.withColumn("label", F.lit(None).cast("int"))
    return materialize(docs.select("doc_id", F.col("label").cast("int").alias("label"), "model_text"), "documents")


class Report(dict):
    """An evaluation's tables by name: predictions, metrics and confusion."""

    def to_string(self, digits: int = 4) -> str:
        """The metrics as text, a line for each model."""
        return self["metrics"].orderBy("model").toPandas().round(digits).to_string(index=False)


@dataclass
class Model:
    """A fitted model: parameter tables, all with a size that the configuration bounds."""

    config: Config
    params: DataFrame
    classes: DataFrame
    dependencies: DataFrame
    corrections: DataFrame
    tables: tuple = field(default=("params", "classes", "dependencies", "corrections"), repr=False)

    def counts(self, docs: DataFrame) -> DataFrame:
        return features.counts(features.doc_grams(docs, self.config), self.params, self.config)

    def pairs(self, docs: DataFrame) -> DataFrame:
        return dependency.doc_pairs(docs, self.params, self.config)

    def score(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, model_text[, label]) -> wide log scores. Texts must be normalized; an empty table gives an empty result."""
        return self._scored(prepared(docs))

    def _scorer(self) -> kernels.Scorer | None:
        """The parameters as arrays; none without bounds on their size."""
        return kernels.Scorer(self.params, self.classes, self.corrections, self.config) if features.small(self.config) else None

    def _scored(self, docs: DataFrame) -> DataFrame:
        if scorer := self._scorer():
            return scorer.score(docs)
        return bayes.scores(docs, self.counts(docs), self.pairs(docs), self.params, self.classes, self.corrections, self.config)

    def predict(self, docs: DataFrame, models: list[str] | None = None) -> DataFrame:
        return bayes.predictions(self.score(docs), models)

    def evaluate(self, docs: DataFrame, models: list[str] | None = None) -> Report:
        """predictions, metrics and confusion counts of labelled documents, which are scored once."""
        predicted = bayes.predictions(materialize(self.score(docs), "scores"), models)
        return Report(predictions=predicted, metrics=evaluation.metrics(predicted), confusion=evaluation.confusion(predicted))

    def explain(self, docs: DataFrame, model: str = "SDFWNB", top_n: int = 10) -> DataFrame:
        """One row for each document with its scores by one model and their evidence; see explain.explanations."""
        docs = prepared(docs)
        if scorer := self._scorer():
            found = bayes.predictions(
                scorer.explain(docs, model, top_n), [model], "evidence_0", "evidence_1", "features", "effect_0", "effect_1", "dependencies"
            )
            priors = [F.lit(x).alias(f"log_prior_{k}") for k, x in enumerate(scorer.priors)]
            return found.select(
                "doc_id", "model", "label", "score0", "score1", "p1", "pred", "evidence_0", "evidence_1", "features", "effect_0", "effect_1", "dependencies", *priors
            )
        counts, pairs = self.counts(docs), self.pairs(docs)
        evidence = explain.feature_evidence(counts, self.params, self.config, model)
        corrections = self.corrections if model == "SDFWNB" else self.corrections.limit(0)
        effects = explain.dependency_effects(pairs, corrections, self.params, self.config)
        return explain.explanations(bayes.predictions(self._scored(docs), [model]), evidence, effects, self.classes, top_n)

    def evidence(self, docs: DataFrame, model: str = "SDFWNB", top_n: int = 10) -> DataFrame:
        """(doc_id, rank, idx, feature, count, weight, evidence_negative, evidence_positive): each document's strongest terms of one model's score."""
        docs = prepared(docs)
        names = ["doc_id", "rank", "idx", "feature", "count", "weight", "evidence_negative", "evidence_positive"]
        if scorer := self._scorer():
            return scorer.evidence(docs, model, top_n).select(*names)
        found = explain.feature_evidence(self.counts(docs), self.params, self.config, model)
        return explain.ranked(found, "evidence_negative", "evidence_positive", top_n, "idx").select(*names)

    def effects(self, docs: DataFrame) -> DataFrame:
        """(doc_id, trigram, left_feature, right_feature, effect_negative, effect_positive) of the pairs that count in each document."""
        docs = prepared(docs)
        if scorer := self._scorer():
            return scorer.effects(docs).drop("label")
        return explain.dependency_effects(self.pairs(docs), self.corrections, self.params, self.config)

    def release(self) -> None:
        """Deletes the tables that the fit wrote; the model can't be used after that."""
        for name in self.tables:
            discard(getattr(self, name))

    def save(self, path: str) -> str:
        """Parquet tables and meta.json in a folder of any store."""
        for name in self.tables:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.params.sparkSession
        meta = json.dumps({"version": VERSION, "config": asdict(self.config)}, ensure_ascii=False)
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta.json")
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        meta = json.loads(spark.read.text(f"{path}/meta.json").first().value)
        if meta["version"] != VERSION:
            raise ValueError(f"the model has version {meta['version']}; this is {VERSION}")
        return cls(Config.of(meta["config"]), *(spark.read.parquet(f"{path}/{n}") for n in cls.tables)).checked()

    def checked(self) -> Model:
        """The model, if its tables are sound: weights finite and not negative, probabilities and corrections finite, indexes whole and of known features."""
        number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        weight = lambda c: number(c) & (F.col(c) >= 0)
        features_ = self.params.agg(
            F.count("*").alias("n"), F.count_distinct("idx").alias("d"), F.max("idx").alias("top"),
            F.count_if(~(weight("w_fwnb") & weight("w_dfwnb") & number("logp0") & number("logp1"))).alias("bad")
        ).first()
        if not features_.n or features_.d != features_.n or features_.top != features_.n - 1 or features_.bad:
            raise ValueError("feature parameters need an index from 0 on, finite weights that aren't negative, and finite probabilities")
        known = F.col("left_idx").between(0, features_.top) & F.col("right_idx").between(0, features_.top)
        if not self.corrections.where(~(known & number("delta_0") & number("delta_1") & number("relevance"))).isEmpty():
            raise ValueError("corrections need pairs of known features and finite values")
        return self


def fit(docs: DataFrame, config: Config | None = None) -> Model:
    """docs(doc_id, label, model_text) -> Model. Labels must be 0 or 1, both must occur, and there must be a vocabulary.

    Texts are normalized once, and read three times: for their grams, for pairs of candidates and for adjacent grams; what follows are tables whose size the configuration bounds.
    """
    config, spark = config or Config(), docs.sparkSession
    docs = prepared(docs)
    n = features.class_totals(docs).first()
    if n.other or not n.n0 or not n.n1:
        raise ValueError("labels must be 0 or 1, and both must occur")
    totals = one_row(spark, {"n0": n.n0, "n1": n.n1})
    told = materialize(features.information(features.vocabulary(features.gram_stats(docs, config), config), totals, config), "information")
    if told.isEmpty():
        raise ValueError("the vocabulary is empty")
    stats = materialize(features.information_weights(told, config), "features")
    cands = materialize(redundancy.candidates(stats, config), "candidates")
    found = redundancy.document_pair_frequency(docs, stats, cands, config)
    scores = redundancy.redundancy_scores(redundancy.relations(found, stats, config), config)
    weighted = materialize(redundancy.redundancy_weights(stats, materialize(scores, "redundancy"), config), "weights")
    classes = one_row(spark, bayes.class_params(weighted, totals).first().asDict())
    params = materialize(bayes.feature_params(weighted, classes, config), "params")
    table = materialize(dependency.table_of(dependency.pair_stats(docs, stats, config), stats, totals, config), "dependencies")
    corrections = materialize(dependency.corrections(table, config), "corrections")
    for df in (docs, told, stats, cands, weighted):
        discard(df)
    return Model(config, params, classes, table, corrections)


def significance(predicted: DataFrame, config: Config | None = None, resamples: int | None = None) -> dict[str, DataFrame]:
    """McNemar and bootstrap tests of the compared pairs of models."""
    config = config or Config()
    resamples = config.bootstrap_resamples if resamples is None else resamples
    return {"mcnemar": evaluation.mcnemar(predicted), "bootstrap": evaluation.bootstrap(predicted, resamples, config.random_seed + config.bootstrap_seed_offset)}


def run(train: DataFrame, test: DataFrame, config: Config | None = None, models: list[str] | None = None, save_to: str | None = None) -> Report:
    """Fits on train, evaluates on test; both (doc_id, label, model_text). Returns the model, the evaluation's tables and the tests."""
    model = fit(train, config)
    if save_to:
        model.save(save_to)
    report = model.evaluate(test, models)
    return Report(model=model, **report, **(significance(report["predictions"], model.config) if models is None else {}))
