"""Scoring of a stream of texts with a fitted model: stateless but for sums within a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textbayes.functions.text import normalize
from textbayes.plans.analyzer import Model
from textbayes.storage import scope


def score_stream(texts: DataFrame, model: Model, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Streams texts(doc_id, text, ...) into Parquet predictions at path, a folder for each micro-batch, so a repeated batch replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        docs = df.select("doc_id", normalize(F.col("text")).alias("model_text"))
        with scope(df.sparkSession):
            model.predict(docs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
