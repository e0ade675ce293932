"""Explanations: ranked features and pairs of a model, and the evidence of each document, which adds up to its score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textbayes.config import Config

from .bayes import MODELS, active_pairs
from .features import bounded


def top_features(params: DataFrame, n: int = 20, by: str = "mutual_information", class_filter: int | None = None) -> DataFrame:
    """The n features with most information or redundancy, of one direction if class_filter is 0 or 1; ties by idx."""
    column = {"mutual_information": "mi", "redundancy": "redundancy"}.get(by)
    if column is None:
        raise ValueError("features are ranked by mutual_information or redundancy")
    if class_filter is not None:
        params = params.where(F.col("direction") > 0 if class_filter else F.col("direction") < 0)
    out = params.select(
        "idx", F.col("gram").alias("feature"), F.col("mi").alias("mutual_information"), "direction",
        F.when(F.col("direction") > 0, "positive").otherwise("negative").alias("preferred_class"), "redundancy", "w_fwnb", "w_dfwnb", "df"
    )
    return out.orderBy(F.desc("redundancy" if column == "redundancy" else "mutual_information"), "idx").limit(n)


def redundancy_relations(params: DataFrame, n: int = 20) -> DataFrame:
    return top_features(params, n, by="redundancy")


def top_dependencies(table: DataFrame, n: int = 20) -> DataFrame:
    """The n strongest rows of a dependency table."""
    order = [F.desc("selection_score"), F.desc("pair_label_mi"), F.desc("total_doc_freq"), "left_index", "right_index"]
    return table.orderBy(*order).limit(n).select(
        "trigram", "left_feature", "right_feature", "neg_doc_freq", "pos_doc_freq", "delta_0", "delta_1", "dependency_contrast", "preferred_class"
    )


def feature_evidence(counts: DataFrame, params: DataFrame, config: Config, model: str = "SDFWNB") -> DataFrame:
    """(doc_id, idx, feature, count, weight, evidence_negative, evidence_positive): the terms of the score before they are summed."""
    weight = F.col(MODELS[model]) if MODELS[model] else F.lit(1.0)
    known = counts.join(bounded(params.select("idx", "gram", "w_fwnb", "w_dfwnb", "logp0", "logp1"), config.max_features), "idx")
    return known.select(
        "doc_id", "idx", F.col("gram").alias("feature"), F.col("tf").alias("count"), weight.alias("weight"),
        (F.col("tf") * weight * F.col("logp0")).alias("evidence_negative"), (F.col("tf") * weight * F.col("logp1")).alias("evidence_positive")
    )


def dependency_effects(pairs: DataFrame, corrections: DataFrame, params: DataFrame, config: Config) -> DataFrame:
    """(doc_id, trigram, ..., effect_negative, effect_positive) of the pairs that count in each document, by the pair's own features."""
    active = active_pairs(pairs, corrections, config)
    side = lambda s: bounded(params.select(F.col("idx").alias(f"{s}_idx"), F.col("gram").alias(f"{s}_feature")), config.max_features)
    t = active.join(side("left"), "left_idx").join(side("right"), "right_idx")
    return t.select(
        "doc_id", F.concat("left_feature", F.right("right_feature", F.lit(1))).alias("trigram"), "left_feature", "right_feature",
        (config.dependency_strength * F.col("delta_0")).alias("effect_negative"),
        (config.dependency_strength * F.col("delta_1")).alias("effect_positive")
    )


def ranked(evidence: DataFrame, negative: str, positive: str, n: int, *ties: str) -> DataFrame:
    """Each document's n rows with the largest difference between the two columns, with their rank."""
    w = W.partitionBy("doc_id").orderBy(F.desc(F.round(F.abs(F.col(positive) - F.col(negative)), 12)), *ties)
    return evidence.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _summed(rows: DataFrame, negative: str, positive: str, sums: str, name: str, fields: list[str], n: int, tie: str) -> DataFrame:
    """(doc_id, <sums>_0, <sums>_1, <name>): sums of a document's rows and its n strongest, in one aggregation."""
    strength = (-F.round(F.abs(F.col(positive) - F.col(negative)), 12)).alias("by")
    best = F.slice(F.array_sort(F.collect_list(F.struct(strength, F.col(tie).alias("tie"), F.struct(*fields).alias("row")))), 1, n)
    return rows.groupBy("doc_id").agg(
        F.sum(negative).alias(f"{sums}_0"), F.sum(positive).alias(f"{sums}_1"), F.transform(best, lambda s: s["row"]).alias(name)
    )


def explanations(predicted: DataFrame, evidence: DataFrame, effects: DataFrame, classes: DataFrame, n: int = 10) -> DataFrame:
    """One row for each document of one model's predictions: its scores, sums of evidence, and the strongest terms as arrays.

    log_prior + evidence + effects = score, for either class. to_json of the row gives the nested document.
    """
    first = _summed(
        evidence, "evidence_negative", "evidence_positive", "evidence", "features",
        ["feature", "count", "weight", "evidence_negative", "evidence_positive"], n, "idx"
    )
    second = _summed(
        effects, "effect_negative", "effect_positive", "effect", "dependencies",
        ["trigram", "left_feature", "right_feature", "effect_negative", "effect_positive"], n, "trigram"
    )
    out = predicted.join(first, "doc_id", "left").join(second, "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("evidence_0", "evidence_1", "effect_0", "effect_1")}
    return out.withColumns(zero).crossJoin(F.broadcast(classes.select("log_prior_0", "log_prior_1")))
