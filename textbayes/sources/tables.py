"""Sources and sinks: labelled TSV splits, checksums, result files and models as Parquet."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textbayes.functions import blocks
from textbayes.storage import in_order

#: Column names that count as label and text, in order of preference.
LABELS = ("label", "labels", "sentiment", "y")
TEXTS = ("text_a", "text", "review", "content")


def _recoded(column: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """A block's strings at a time, so that a worker holds a batch as Arrow and little else. A text that can't be changed raises."""
    return blocks.mapped(column, lambda part: pa.array([None if t is None else change(t) for t in part.to_pylist()], pa.string()))


@F.arrow_udf(StringType())
def _decoded(column: pa.Array) -> pa.Array:
    return _recoded(column, lambda t: t.encode("latin-1").decode("gb18030"))


@F.arrow_udf(StringType())
def _encoded(column: pa.Array) -> pa.Array:
    return _recoded(column, lambda t: t.encode("gb18030").decode("latin-1"))


def _files(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """The files at a path by whether they are UTF-8. Every line of every file is looked at, as bytes; a file with a line that isn't UTF-8 isn't."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(path)
    lines = spark.read.text(path)  # lines keep their bytes; neither line feed nor tab is ever part of a GB18030 character
    found = lines.select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("utf8")).groupBy("file").agg(F.min("utf8").alias("utf8"))
    out: dict[bool, list[str]] = {True: [], False: []}
    for r in found.orderBy("file").collect():  # a row for each file
        out[r.utf8].append(r.file)
    return out


def _parsed(spark: SparkSession, files: list[str], utf8: bool) -> DataFrame:
    """Files of one encoding as strings, with what orders their rows: file, block and number within."""
    df = spark.read.csv(files, sep="\t", header=True, quote="", encoding="UTF-8" if utf8 else "ISO-8859-1")
    order = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at")]
    if utf8:
        return df.select(*(F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in df.columns), *order)
    # Spark reads no GB18030: bytes pass through Latin-1 and are decoded strictly afterwards
    return df.select(*(_decoded(F.col(f"`{c}`")).alias(c.encode("latin-1").decode("gb18030")) for c in df.columns), *order)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated split, a file or a folder of files, with a header and without quoting, as strings, and row_id: the order of rows by file and place.

    Files are UTF-8, with or without a byte order mark, or else GB18030; bytes that are neither raise an error when they are read. Blank lines are skipped.
    """
    found = _files(spark, path)
    parts = [_parsed(spark, files, utf8) for utf8, files in found.items() if files]
    if not parts:
        raise ValueError(f"{path} has no header")
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    names = {c.strip().lower() for c in df.columns}
    if not names & set(LABELS) or not names & set(TEXTS):
        raise ValueError(f"{path} needs a column of each of {LABELS} and {TEXTS}; it has {df.columns[:-3]}")
    numbered = in_order(df, [F.col("__file"), F.col("__block"), F.col("__at")], "split")
    return numbered.withColumnRenamed("before", "row_id").drop("__file", "__block", "__at")


def write_split(df: DataFrame, path: str, encoding: str = "utf-8") -> None:
    """A folder of tab-separated files with a header, in UTF-8 or GB18030. Tabs and line ends in values would break rows and must not occur."""
    if encoding.lower() == "gb18030":
        df = df.select(*(_encoded(F.col(c).cast("string")).alias(c) for c in df.columns))
    df.write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False, emptyValue="", encoding="UTF-8" if encoding.lower() != "gb18030" else "ISO-8859-1")


def standardize(df: DataFrame, split: str, check: bool = True) -> DataFrame:
    """(split, row_id, label, text): labels become whole numbers, rows without label or text go, and labels must be 0 or 1."""
    by_name = {c.strip().lower(): c for c in df.columns}
    label, text = (next((by_name[n] for n in names if n in by_name), None) for names in (LABELS, TEXTS))
    if label is None or text is None:
        raise ValueError(f"no label or text among {df.columns}")
    row_id = F.col(by_name["row_id"]) if "row_id" in by_name else F.monotonically_increasing_id()
    number = F.expr(f"try_cast(`{label}` AS DOUBLE)").cast("long")
    out = df.select(
        F.lit(split).alias("split"), row_id.alias("row_id"), number.alias("label"), F.col(text).cast("string").alias("text")
    ).dropna(subset=["label", "text"])
    if check and (bad := unknown_labels(out).first()):
        raise ValueError(f"labels must be 0 or 1; {split} has {bad.label}")
    return out


def unknown_labels(df: DataFrame) -> DataFrame:
    """(label, n): the labels that aren't 0 or 1."""
    return df.where(~F.col("label").isin(0, 1)).groupBy("label").agg(F.count("*").alias("n"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files; each file is read whole by one task."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify_checksum(spark: SparkSession, path: str, expected: str) -> bool:
    return checksums(spark, path).first().sha256 == expected.lower()


def verify_pinned(spark: SparkSession, path: str, pinned: dict[str, str]) -> DataFrame:
    """(name, sha256, expected, ok) of the pinned file names: ok is false for a file that differs or isn't there. Files without a pin are left out."""
    expected = spark.createDataFrame(list(pinned.items()), "name string, expected string")
    found = checksums(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return F.broadcast(expected).join(found, "name", "left").select(
        "name", "sha256", "expected", F.coalesce(F.col("sha256") == F.lower("expected"), F.lit(False)).alias("ok")
    )


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a byte order mark, for spreadsheets."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    df.toPandas().to_csv(path, index=False, encoding="utf-8-sig")


def write_json(value, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
