"""Tables between steps: written to the folder that the cluster shares, and read back, so that plans stay short and lost executors cost nothing.

The folder is the cluster's (spark.checkpoint.dir). What this process has written there goes with release(), which callers run once their
results are written; a result that is still to be read may depend on it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Paths written by this process and not yet deleted.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A single machine without one gets a temporary folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textbayes-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: its plan is one scan."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame | None) -> None:
    """Deletes what materialize() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_written_to", None)
    if path:
        _delete(df.sparkSession, path)
        if path in _written:
            _written.remove(path)


def release(spark: SparkSession) -> None:
    """Deletes all that this process has written; results that were not yet read are lost."""
    while _written:
        _delete(spark, _written.pop())


@contextmanager
def scope(spark: SparkSession):
    """Deletes on leaving what was written inside."""
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            _delete(spark, _written.pop())


def one_row(spark: SparkSession, values: dict[str, float | int]) -> DataFrame:
    """A row of constants, which the optimizer folds."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


def in_order(df: DataFrame, order: Sequence[Column], name: str, weight: Column | None = None) -> DataFrame:
    """df with `before`: the number of rows, or the sum of a column, that come before a row in a total order.

    Rows are dealt by ranges of the order and added up within each; only one number for each range is added up in one task.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    mid = F.monotonically_increasing_id()  # the range's number, then the row's number in it
    dealt = df.withColumn("__w", weight).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("__m", mid).withColumns({"__part": F.shiftright("__m", 33)}), name)
    sums = dealt.groupBy("__part").agg(F.sum("__w").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("__part", earlier.alias("__start"))  # as many rows as ranges
    within = F.coalesce(F.sum("__w").over(W.partitionBy("__part").orderBy("__m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("before", within).join(F.broadcast(starts), "__part").withColumn("before", F.col("before") + F.col("__start")).drop("__w", "__m", "__part", "__start")
