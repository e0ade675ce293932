"""Naive Bayes: parameters, scores of four nested models in one plan, and the evidence that adds up to a score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textbayes.config import Config

from .features import bounded
from .kernels import MODELS


def class_params(stats: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: log_prior_0/1, n_tokens_0/1 (of vocabulary grams) and n_features."""
    sums = stats.agg(F.sum("tf0").alias("n_tokens_0"), F.sum("tf1").alias("n_tokens_1"), F.count("*").alias("n_features"))
    n = F.col("n0") + F.col("n1")
    return totals.select(F.ln(F.col("n0") / n).alias("log_prior_0"), F.ln(F.col("n1") / n).alias("log_prior_1")).crossJoin(F.broadcast(sums))


def feature_params(stats: DataFrame, classes: DataFrame, config: Config) -> DataFrame:
    """stats with logp0 and logp1: ln((tf + alpha) / (tokens + alpha * features)); features absent from a class keep alpha's share."""
    a = config.alpha
    s = stats.crossJoin(F.broadcast(classes.select("n_tokens_0", "n_tokens_1", "n_features")))
    logp = lambda c: F.ln((F.col(f"tf{c}") + a) / (F.col(f"n_tokens_{c}") + a * F.col("n_features")))
    return s.withColumns({"logp0": logp(0), "logp1": logp(1)}).drop("n_tokens_0", "n_tokens_1", "n_features")


def active_pairs(pairs: DataFrame, corrections: DataFrame, config: Config) -> DataFrame:
    """(doc_id, left_idx, right_idx, delta_0, delta_1): a document's corrected pairs, the most relevant maximum_pairs_per_document of them."""
    have = pairs.join(bounded(corrections, config.dependency_pair_count), ["left_idx", "right_idx"])
    w = W.partitionBy("doc_id").orderBy(F.desc("relevance"), "left_idx", "right_idx")
    return have.withColumn("r", F.row_number().over(w)).where(F.col("r") <= config.maximum_pairs_per_document).drop("r", "label")


def scores(docs: DataFrame, counts: DataFrame, pairs: DataFrame, params: DataFrame, classes: DataFrame, corrections: DataFrame, config: Config) -> DataFrame:
    """(doc_id, label, score_<model>_0/1 ...): log scores of all models, wide; documents without known grams have the prior.

    The six sums of the weighted models come from one aggregation of counts with the broadcast parameters; a feature may have several rows of counts.
    """
    known = counts.select("doc_id", "idx", "tf").join(bounded(params.select("idx", "w_fwnb", "w_dfwnb", "logp0", "logp1"), config.max_features), "idx")
    sums = {}
    for model, weight in MODELS.items():
        if model != "SDFWNB":
            for c in (0, 1):
                term = F.col("tf") * F.col(f"logp{c}") * (F.col(weight) if weight else F.lit(1.0))
                sums[f"{model}_{c}"] = F.sum(term).alias(f"{model}_{c}")
    added = known.groupBy("doc_id").agg(*sums.values())
    out = docs.select("doc_id", "label").join(added, "doc_id", "left")
    if config.dependency_strength and config.dependency_pair_count:
        active = active_pairs(pairs, corrections, config)
        effect = active.groupBy("doc_id").agg(*((config.dependency_strength * F.sum(f"delta_{c}")).alias(f"effect_{c}") for c in (0, 1)))
        out = out.join(effect, "doc_id", "left")
    else:
        out = out.withColumns({"effect_0": F.lit(0.0), "effect_1": F.lit(0.0)})
    out = out.crossJoin(F.broadcast(classes.select("log_prior_0", "log_prior_1")))
    zero = F.lit(0.0)
    columns = []
    for model in MODELS:
        for c in (0, 1):
            base = F.col(f"log_prior_{c}") + F.coalesce(F.col(f"`{'DFWNB-v2' if model == 'SDFWNB' else model}_{c}`"), zero)
            columns.append((base + F.coalesce(F.col(f"effect_{c}"), zero) if model == "SDFWNB" else base).alias(f"{model}_{c}"))
    return out.select("doc_id", "label", *columns)


def predictions(scored: DataFrame, models: list[str] | None = None, *more: str) -> DataFrame:
    """Long form (model, doc_id, label, score0, score1, p1, pred), with more columns of scored: softmax of the two scores; ties go to class 0."""
    names = list(MODELS) if models is None else models
    if unknown := set(names) - set(MODELS):
        raise ValueError(f"unknown models: {sorted(unknown)}")
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"`{m}_0`").alias("score0"), F.col(f"`{m}_1`").alias("score1")) for m in names))
    long = scored.select("doc_id", "label", *more, F.explode(each).alias("s")).select("s.model", "doc_id", "label", "s.score0", "s.score1", *more)
    top = F.greatest("score0", "score1")
    e0, e1 = F.exp(F.col("score0") - top), F.exp(F.col("score1") - top)
    return long.withColumn("p1", e1 / (e0 + e1)).withColumn("pred", F.when(F.col("score1") > F.col("score0"), 1).otherwise(0))
