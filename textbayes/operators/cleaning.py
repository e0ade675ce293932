"""Cleaning of labelled splits: label conflicts, duplicates, leaks between splits; raw texts first, then normalized ones.

Splits stand in one table (split, row_id, label, text). Each rule marks rows with a reason instead of taking tables apart, so summaries
are counts of reasons. Rules are decided by key, on digests and without the texts: tasks add up what they have of a key before anything is
shuffled, so a text that a third of all rows share is a row from each task, and reasons come back to the rows by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbayes.functions.text import duplicate_key, normalize
from textbayes.storage import materialize

#: Splits by rank: a text stays in the first of these that has it.
SPLITS = ("test", "dev", "train")


def decide(rows: DataFrame) -> DataFrame:
    """rows(split, row_id, label, key), those alive -> (split, row_id, reason) of rows that go, by key.

    conflict: all rows of a key that has both labels within a split; duplicate: of the others all but the first; in_test and in_dev: those whose key is
    kept by a split of higher rank.
    """
    rank = F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))
    keys = rows.groupBy("split", "key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("row_id").alias("first"))
    keys = keys.withColumn("disputed", F.coalesce(F.col("low") < F.col("high"), F.lit(False)))
    best = keys.where("not disputed").groupBy("key").agg(F.min(rank).alias("best"))
    known = rows.join(keys.select("split", "key", "first", "disputed"), ["split", "key"]).join(best, "key", "left")
    leak = F.concat(F.lit("in_"), F.element_at(F.array(*map(F.lit, SPLITS)), F.col("best").cast("int")))
    reason = F.when(F.col("disputed"), "conflict").when(F.col("row_id") > F.col("first"), "duplicate").when(F.col("best") < rank, leak)
    return known.select("split", "row_id", reason.alias("reason")).where("reason is not null")


def clean(df: DataFrame) -> DataFrame:
    """df(split, row_id, label, text) with text_key, model_text, raw_reason and model_reason; rows without a reason are ready.

    Raw texts: within a split, conflicting keys go whole, then all but the first of a key; then train and dev lose what test keeps, and train
    what dev keeps. The same follows on model_text among the rows left, after those that normalize to nothing; model_text is null for rows
    that went before. Null texts are empty, null labels conflict with none; (split, row_id) names a row. Texts are normalized once.
    """
    digest = lambda c: F.unhex(F.sha2(c, 256))
    made = df.withColumns({"raw": digest(duplicate_key(F.col("text"))), "model_text": normalize(F.col("text"))})
    made = materialize(made.withColumn("model", F.when(F.col("model_text") != "", digest(F.col("model_text")))), "cleaning")
    raw = materialize(decide(made.select("split", "row_id", "label", F.col("raw").alias("key"))).withColumnRenamed("reason", "raw_reason"), "raw-reasons")
    left = made.select("split", "row_id", "label", "model").join(raw, ["split", "row_id"], "left_anti")
    second = decide(left.where("model is not null").select("split", "row_id", "label", F.col("model").alias("key"))).withColumnRenamed(
        "reason", "model_reason"
    )
    out = made.join(raw, ["split", "row_id"], "left").join(materialize(second, "model-reasons"), ["split", "row_id"], "left")
    went = F.col("raw_reason").isNotNull()
    return out.select(
        *df.columns, duplicate_key(F.col("text")).alias("text_key"), F.when(~went, F.col("model_text")).alias("model_text"), "raw_reason",
        F.when(~went, F.when(F.col("model_text") == "", "empty").otherwise(F.col("model_reason"))).alias("model_reason"),
    )


def ready(cleaned: DataFrame) -> DataFrame:
    return cleaned.where("raw_reason is null and model_reason is null").select("split", "row_id", "label", "text", "model_text")


def summary(cleaned: DataFrame) -> DataFrame:
    """One row for each split: rows at first, removed by each rule of the two stages, and left after each."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    raw, model = F.col("raw_reason"), F.col("model_reason")
    return cleaned.groupBy("split").agg(
        F.count("*").alias("n_rows"), count(raw == "conflict").alias("raw_conflict"), count(raw == "duplicate").alias("raw_duplicate"), count(raw.startswith("in_")).alias("raw_leak"), count(raw.isNull()).alias("raw_left"),
        count(model == "empty").alias("model_empty"), count(model == "conflict").alias("model_conflict"), count(model == "duplicate").alias("model_duplicate"), count(model.startswith("in_")).alias("model_leak"),
        count(raw.isNull() & model.isNull()).alias("model_left"),
    )
