"""Term counts, the vocabulary and per-class statistics.

A document's grams are counted in its block of texts (kernels), so that what is shuffled are counts by gram, which each block has added up before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textbayes.config import Config
from textbayes.operators import kernels
from textbayes.storage import in_order

#: A vocabulary or parameter table of at most so many rows is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """df with a broadcast hint if its size has a known bound that is small enough."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def small(config: Config) -> bool:
    """Whether parameters and corrections have bounds that are small enough to send them to all tasks."""
    return config.max_features is not None and max(config.max_features, config.dependency_pair_count) <= BROADCAST_ROWS


def doc_grams(docs: DataFrame, config: Config, text: str = "model_text") -> DataFrame:
    """docs(doc_id, label, text) -> (doc_id, label, gram, tf), without a shuffle."""
    return kernels.gram_rows(docs, config, text)


def gram_stats(docs: DataFrame, config: Config, text: str = "model_text") -> DataFrame:
    """term_stats of the documents' grams, without a row for each document and gram."""
    return kernels.gram_stats(docs, config, text)


def term_stats(grams: DataFrame) -> DataFrame:
    """(gram, df, tf, df0, df1, tf0, tf1) over all documents: what the vocabulary and every class statistic need, in one aggregation."""
    one, tf = F.col("label") == 1, F.col("tf")
    return grams.groupBy("gram").agg(
        F.count("*").alias("df"), F.sum("tf").alias("tf"), F.count_if(~one).alias("df0"), F.count_if(one).alias("df1"), F.sum(F.when(
            ~one, tf
        ).otherwise(0)).alias("tf0"), F.sum(F.when(one, tf).otherwise(0)).alias("tf1")
    )


def vocabulary(stats: DataFrame, config: Config) -> DataFrame:
    """(idx, ...) of the grams in at least min_df documents, by df and tf falling, then by gram; the first max_features of them."""
    order = [F.desc("df"), F.desc("tf"), F.asc("gram")]
    kept = stats.where(F.col("df") >= config.min_df)
    if config.max_features is None:
        return in_order(kept, order, "vocabulary").withColumnRenamed("before", "idx").withColumn("idx", F.col("idx").cast("int"))
    kept = kept.orderBy(*order).limit(config.max_features)
    return kept.withColumn("idx", (F.row_number().over(W.orderBy(*order)) - 1).cast("int"))  # of max_features rows


def counts(grams: DataFrame, vocab: DataFrame, config: Config) -> DataFrame:
    """(doc_id, label, idx, tf) of the grams in the vocabulary."""
    return grams.join(bounded(vocab.select("gram", "idx"), config.max_features), "gram").select("doc_id", "label", "idx", "tf")


def class_totals(docs: DataFrame) -> DataFrame:
    """One row: n0 and n1, the documents of each class. Both must be there, and no other."""
    return docs.agg(
        F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"),
        F.count_if(~F.col("label").isin(0, 1)).alias("other")
    )


def presence_information(df0: Column, df1: Column, n0: Column, n1: Column) -> Column:
    """Mutual information, in nats, of a binary feature with the class: four cells, of which empty ones add nothing; never negative."""
    n = (n0 + n1).cast("double")

    def cell(joint, feature, label):
        p = joint / n
        return F.when(joint > 0, p * F.ln(p / (feature / n * (label / n)))).otherwise(F.lit(0.0))

    there, gone = df0 + df1, n0 + n1 - df0 - df1
    return F.greatest(cell(df0, there, n0) + cell(df1, there, n1) + cell(n0 - df0, gone, n0) + cell(n1 - df1, gone, n1), F.lit(0.0))


def direction(df0: Column, df1: Column, n0: Column, n1: Column, smoothing: float) -> Column:
    """logit of a feature's smoothed rate in class 1 less that in class 0."""

    def logit(df, n):
        p = (df + smoothing) / (n + 2 * smoothing)
        return F.ln(p / (1 - p))

    return logit(df1, n1) - logit(df0, n0)


def information_weights(stats: DataFrame, config: Config, mi: str = "mi") -> DataFrame:
    """Adds norm_mi (by the largest) and w_fwnb = minimum + (1 + boost - minimum) * norm_mi ** gamma."""
    top = stats.agg(F.max(mi).alias("top"))  # a single row
    norm = F.when(F.col("top") > 0, F.col(mi) / F.col("top")).otherwise(F.lit(0.0))
    span = 1 + config.maximum_boost - config.minimum_weight
    return stats.crossJoin(F.broadcast(top)).withColumn("norm_mi", norm).withColumn(
        "w_fwnb", config.minimum_weight + span * F.pow("norm_mi", F.lit(config.gamma))
    ).drop("top")


def information(vocab: DataFrame, totals: DataFrame, config: Config) -> DataFrame:
    """The vocabulary with mi and direction. mi is rounded to 12 places, so that ties don't hang on the order of sums."""
    one = F.broadcast(totals.select("n0", "n1"))  # a single row
    s = vocab.crossJoin(one)
    s = s.withColumn("mi", F.round(presence_information(F.col("df0"), F.col("df1"), F.col("n0"), F.col("n1")), 12))
    return s.withColumn("direction", direction(F.col("df0"), F.col("df1"), F.col("n0"), F.col("n1"), config.direction_smoothing))


def feature_stats(vocab: DataFrame, totals: DataFrame, config: Config) -> DataFrame:
    """The vocabulary with mi, direction, norm_mi and w_fwnb."""
    return information_weights(information(vocab, totals, config), config)
