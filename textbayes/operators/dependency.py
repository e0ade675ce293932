"""Dependencies: adjacent script bigrams (a trigram's two halves) and the corrections of the scores that they call for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbayes.config import Config
from textbayes.functions.text import holds_placeholder, is_script_bigram

from . import kernels
from .features import bounded, presence_information, small


def doc_pairs(docs: DataFrame, vocab: DataFrame, config: Config, text: str = "model_text") -> DataFrame:
    """(doc_id, label, left_idx, right_idx), once for each document: trigrams without placeholders whose halves are script bigrams of the vocabulary."""
    if small(config):
        return kernels.document_pairs(docs, vocab, config, text)
    # both halves are of the script's characters, so all three are
    found = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=([{config.script_class}]{{3}}))."), F.lit(1))
    grams = docs.select("doc_id", "label", F.explode(F.array_distinct(found)).alias("trigram"))
    grams = grams.where(~holds_placeholder(F.col("trigram")))
    halves = grams.select("doc_id", "label", F.substring("trigram", 1, 2).alias("l"), F.substring("trigram", 2, 2).alias("r")).where("l <> r")
    script = vocab.where(is_script_bigram(F.col("gram"), config.script_class))
    side = lambda s, c: bounded(script.select(F.col("gram").alias(s), F.col("idx").alias(c)), config.max_features)
    return halves.join(side("l", "left_idx"), "l").join(side("r", "right_idx"), "r").select("doc_id", "label", "left_idx", "right_idx")


def counted(pairs: DataFrame) -> DataFrame:
    """(left_idx, right_idx, neg_doc_freq, pos_doc_freq) of documents' pairs."""
    one = F.col("label") == 1
    return pairs.groupBy("left_idx", "right_idx").agg(F.count_if(~one).alias("neg_doc_freq"), F.count_if(one).alias("pos_doc_freq"))


def pair_stats(docs: DataFrame, vocab: DataFrame, config: Config) -> DataFrame:
    """The same of documents; where the vocabulary has a small bound, without a row for each document and pair."""
    return kernels.pair_stats(docs, vocab, config) if small(config) else counted(doc_pairs(docs, vocab, config))


def dependency_table(pairs: DataFrame, stats: DataFrame, totals: DataFrame, config: Config) -> DataFrame:
    """One row for each pair in enough documents, with its centred, shrunk log ratios of joint to separate rates by class."""
    return table_of(counted(pairs), stats, totals, config)


def table_of(found: DataFrame, stats: DataFrame, totals: DataFrame, config: Config) -> DataFrame:
    """dependency_table of counted pairs."""
    found = found.withColumn(
        "total_doc_freq", F.col("neg_doc_freq") + F.col("pos_doc_freq")
    ).where(F.col("total_doc_freq") >= config.dependency_minimum_pair_df)
    side = lambda s: bounded(
        stats.select(F.col("idx").alias(f"{s}_idx"), F.col("gram").alias(f"{s}_feature"), F.col("df0").alias(f"{s}_df0"), F.col("df1").alias(f"{s}_df1")),
        config.max_features
    )
    t = found.join(side("left"), "left_idx").join(side("right"), "right_idx").crossJoin(F.broadcast(totals.select("n0", "n1")))
    s = config.dependency_smoothing
    rate = lambda df, n: (F.col(df) + s) / (F.col(n) + 2 * s)
    clip = lambda x: F.least(F.greatest(x, F.lit(-config.delta_clip)), F.lit(config.delta_clip))
    t = t.withColumn("support_factor", F.col("total_doc_freq") / (F.col("total_doc_freq") + config.dependency_support_tau))
    for c, df in ((0, "neg_doc_freq"), (1, "pos_doc_freq")):
        t = t.withColumn(f"delta_raw_{c}", clip(F.ln(rate(df, f"n{c}") / (rate(f"left_df{c}", f"n{c}") * rate(f"right_df{c}", f"n{c}")))))
    mean = (F.col("delta_raw_0") + F.col("delta_raw_1")) * F.col("support_factor") / 2
    t = t.withColumns({f"delta_{c}": F.col(f"delta_raw_{c}") * F.col("support_factor") - mean for c in (0, 1)})
    t = t.withColumn("dependency_contrast", F.round(F.abs(F.col("delta_1") - F.col("delta_0")), 12))
    mi = F.round(presence_information(F.col("neg_doc_freq"), F.col("pos_doc_freq"), F.col("n0"), F.col("n1")), 12)
    return t.select(
        F.col("left_idx").alias("left_index"), F.col("right_idx").alias("right_index"), "left_feature", "right_feature", F.concat(
            "left_feature", F.right("right_feature", F.lit(1))
        ).alias("trigram"),
        "neg_doc_freq", "pos_doc_freq", "total_doc_freq", "support_factor", "delta_raw_0", "delta_raw_1", "delta_0", "delta_1", "dependency_contrast", mi.alias("pair_label_mi"),
        F.when(F.col("delta_1") > 0, "positive").otherwise("negative").alias("preferred_class"), F.col("dependency_contrast").alias("selection_score"),
    )


def strongest(table: DataFrame, n: int) -> DataFrame:
    """The n rows with the largest selection_score, then pair_label_mi, then total_doc_freq; then the smallest indexes."""
    if n < 0:
        raise ValueError("the number of pairs can't be negative")
    return table.orderBy(F.desc("selection_score"), F.desc("pair_label_mi"), F.desc("total_doc_freq"), "left_index", "right_index").limit(n)


def corrections(table: DataFrame, config: Config) -> DataFrame:
    """(left_idx, right_idx, delta_0, delta_1, relevance) of the dependency_pair_count strongest pairs."""
    top = strongest(table, config.dependency_pair_count)
    return top.select(
        F.col("left_index").alias("left_idx"), F.col("right_index").alias("right_idx"), "delta_0", "delta_1",
        F.col("selection_score").alias("relevance")
    )
