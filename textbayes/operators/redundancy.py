"""Redundancy between features: which script bigrams stand together in documents, and the weights that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textbayes.config import Config
from textbayes.functions.text import is_script_bigram, share_character

from . import kernels
from .features import bounded


def candidates(stats: DataFrame, config: Config) -> DataFrame:
    """(idx, mi) of the script bigrams with most information, by mi falling, then idx; at most candidate_feature_count rows."""
    return stats.where(is_script_bigram(F.col("gram"), config.script_class)).orderBy(
        F.desc("mi"), "idx"
    ).limit(config.candidate_feature_count).select("idx", "mi")


def pair_frequency(counts: DataFrame, cands: DataFrame, config: Config) -> DataFrame:
    """(left, right, n), left < right: documents whose best candidates (maximum_features_per_document of them) hold both.

    A document's candidates meet in one array of that size at most, and pairs are made inside it; there is no join of rows with rows.
    """
    have = counts.join(F.broadcast(cands), "idx")  # candidate_feature_count bounds its size
    best = have.groupBy("doc_id").agg(F.slice(
        F.array_sort(F.collect_list(F.struct((-F.col("mi")).alias("by"), "idx"))), 1, config.maximum_features_per_document
    ).alias("best"))
    ids = best.select(F.array_sort(F.transform("best", lambda b: b["idx"])).alias("ids"))
    pairs = F.flatten(F.transform(
        "ids", lambda a, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda b: F.struct(a.alias("left"), b.alias("right")))
    ))
    return ids.select(F.explode(pairs).alias("p")).select("p.*").groupBy("left", "right").agg(F.count("*").alias("n"))


def document_pair_frequency(docs: DataFrame, stats: DataFrame, cands: DataFrame, config: Config) -> DataFrame:
    """pair_frequency of documents, without a row for each document and pair."""
    return kernels.candidate_pairs(docs, stats.select("idx", "gram").join(F.broadcast(cands), "idx"), config)  # candidate_feature_count bounds it


def relations(pairs: DataFrame, stats: DataFrame, config: Config) -> DataFrame:
    """(left, right, n, jaccard, score, penalized): pairs frequent and similar enough, of one direction, without a shared character.

    The feature with less information is penalized; then that with the smaller df; then that with the larger idx.
    """
    side = lambda s: bounded(
        stats.select(F.col("idx").alias(s), *(F.col(c).alias(f"{n}_{s}") for c, n in (("gram", "gram"), ("df", "df"), ("mi", "mi"), ("direction", "d")))),
        config.max_features
    )
    p = pairs.where(F.col("n") >= config.redundancy_minimum_pair_df).join(side("left"), "left").join(side("right"), "right")
    p = p.where(~share_character(F.col("gram_left"), F.col("gram_right"))).where(F.col("d_left") * F.col("d_right") > 0)
    p = p.withColumn("union", F.col("df_left") + F.col("df_right") - F.col("n")).where(F.col("union") > 0)
    p = p.withColumn("jaccard", F.col("n") / F.col("union")).where(F.col("n") >= config.minimum_jaccard * F.col("union") - 1e-9)
    a, b = F.abs("d_left"), F.abs("d_right")
    score = F.col("jaccard") * F.least(a, b) / (F.greatest(a, b) + 1e-12) * F.col("n") / (F.col("n") + config.redundancy_support_tau)
    left = (F.col("mi_left") < F.col("mi_right")) | ((F.col("mi_left") == F.col("mi_right")) & (F.col("df_left") < F.col("df_right")))
    return p.select(
        "left", "right", "n", "jaccard", F.round(score, 12).alias("score"), F.when(left, F.col("left")).otherwise(F.col("right")).alias("penalized")
    )


def redundancy_scores(related: DataFrame, config: Config) -> DataFrame:
    """(idx, redundancy): the mean of a feature's top_k relation scores, scaled by the 95% quantile of all such means and cut to 0..1."""
    w = W.partitionBy("penalized").orderBy(F.desc("score"), "left", "right")
    raw = related.withColumn(
        "r", F.row_number().over(w)
    ).where(F.col("r") <= config.top_k).groupBy(F.col("penalized").alias("idx")).agg(F.avg("score").alias("raw"))
    scale = raw.where("raw > 0").agg(F.percentile("raw", 0.95).alias("scale"))
    scaled = raw.crossJoin(F.broadcast(scale))  # a single row
    s = F.when(F.coalesce("scale", F.lit(0.0)) > 0, F.col("scale")).otherwise(F.lit(1.0))
    return scaled.select("idx", F.least(F.greatest(F.col("raw") / s, F.lit(0.0)), F.lit(1.0)).alias("redundancy"))


def redundancy_weights(stats: DataFrame, scores: DataFrame, config: Config) -> DataFrame:
    """stats with redundancy (0 without relations) and w_dfwnb: w_fwnb shrunk by redundancy, scaled to keep the mean over all features."""
    s = stats.join(F.broadcast(scores), "idx", "left").withColumn("redundancy", F.coalesce("redundancy", F.lit(0.0)))  # at most as many rows as candidates
    s = s.withColumn("shrunk", F.col("w_fwnb") / (1 + config.redundancy_strength * F.pow("redundancy", F.lit(config.redundancy_gamma))))
    means = s.agg(F.avg("w_fwnb").alias("mean"), F.avg("shrunk").alias("after"))  # a single row
    scaled = F.when(F.col("after") > 0, F.col("shrunk") * F.col("mean") / F.col("after")).otherwise(F.col("shrunk"))
    return s.crossJoin(F.broadcast(means)).withColumn("w_dfwnb", scaled).drop("shrunk", "mean", "after")
