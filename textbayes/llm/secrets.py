"""Secret scans: credentials in texts, and the weaker parts of multipart credentials where complementary parts stand near.

Strong spans (assignments to a secret's name, access keys, long hex runs) always count. Weak candidates (names of identifiers with a
value, mixed random-looking runs, endpoints) count only as parts of a credential: an interval join on scopes of SCOPE code points, within
a row, finds whether a complementary part lies near. The join is an equi-join on (row, scope) with each candidate filed under its own and
the neighbouring scopes, and a semi-join, so pairs are never emitted. Everything is built-in SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, small

#: Code points between parts of one credential, at most.
SCOPE = 300

# Patterns by kind, in the order of the kinds. (pattern, group of the value, least length of the value, quick test)
STRONG = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8, r"(?i:passw|secret|token|api_?key)"),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 16, "AKIA"),
    "hex": (r"([0-9a-f]+)", 1, 32, r"[0-9a-f]{32}"),
}
WEAK = {
    "identifier": (
        r"""(\b(?i:access_?key_?id|client_?id|user_?name|user_?id|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+))""", 2, 4,
        r"(?i:key_?id|client_?id|user_?name|user_?id|login|account)"
    ),
    "random": (r"(?<![A-Za-z0-9+/_-])((?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,})", 1, 20, r"[A-Za-z0-9+/_-]{20}"),
    "endpoint": (r"""(\b(?:https?|ftp|sftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\s"'<>|]+)""", 1, 8, "://"),
}
KINDS = [*STRONG, *WEAK]
#: Role of each kind, and the roles that complete a weak kind.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "random": "secret", "endpoint": "endpoint"}
COMPLETED_BY = {"identifier": ["secret"], "random": ["identifier", "endpoint"], "endpoint": ["secret"]}

PART = "struct<start:long,rank:int,stop:long>"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def running(numbers: Column, width: int = 256) -> Column:
    """Running totals of an array of longs, in pieces so that the work stays far below the square of its size."""

    def totals(a, base):
        grown = F.aggregate(a, F.array(base), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return let(grown, lambda g: F.slice(g, 2, F.size(g)))

    def whole(a):
        pieces = F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / width).cast("int")), lambda k: F.slice(a, k * width + 1, F.lit(width)))
        return let(
            pieces,
            lambda p: let(totals(F.transform(p, lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)), F.lit(0).cast("long")), lambda ends: F.flatten(F.transform(p, lambda x, i: totals(x, F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0).cast("long"))))))
        )

    return F.when(F.size(numbers) > 0, let(numbers, whole)).otherwise(F.expr("cast(array() as array<long>)"))


def spans(text: Column, kind: str) -> Column:
    """Array of PART: leftmost matches of a kind that don't overlap, by code points; matches with too short a value fail but use up their text."""
    pattern, group, least, quick = (STRONG | WEAK)[kind]
    step = r"\G(?s:.*?)" + pattern  # \G: each match goes on where the last one ended, so the lengths add up to places

    def parts(lengths, matches, values):
        def located(stops):
            all_ = F.transform(
                F.sequence(F.lit(0), F.size(stops) - 1),
                lambda i: F.struct((F.get(stops, i) - F.length(F.get(matches, i))).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.get(stops, i).alias("stop"), F.length(F.get(values, i)).alias("size"))
            )
            return F.transform(
                F.filter(all_, lambda p: p["size"] >= least),
                lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["stop"].alias("stop"))
            )

        return F.when(F.size(lengths) > 0, let(running(lengths), located)).otherwise(F.expr(f"cast(array() as array<{PART}>)"))

    every = lambda g: F.regexp_extract_all(text, F.lit(step), F.lit(g))
    lengths = F.transform(every(0), lambda s: F.length(s).cast("long"))
    found = let(lengths, lambda n: let(every(1), lambda m: let(every(group), lambda v: parts(n, m, v))))
    return F.when(text.rlike(quick), found).otherwise(F.expr(f"cast(array() as array<{PART}>)"))


def _row() -> Column:
    """What rows with the same doc_id and text share: two hashes of 64 bits."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b"))


def _candidates(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    strong = F.array_sort(F.concat(*(spans(text, k) for k in STRONG)))
    weak = F.concat(*(spans(text, k) for k in WEAK))
    return docs.select("doc_id", _row().alias("row"), strong.alias("strong"), weak.alias("weak"))


def _linked(found: DataFrame) -> DataFrame:
    """found(row, strong, weak) -> (row, extra): weak parts that a complementary part completes."""
    role = F.element_at(F.array(*(F.lit(ROLE[k]) for k in KINDS)), F.col("rank") + 1)
    rows = found.where(F.size("weak") > 0).select("row", "strong", "weak").dropDuplicates(["row"])
    parts = rows.select("row", F.explode(F.concat("strong", "weak")).alias("p")).select("row", "p.*")
    # every scope that the part touches; a very long part is filed by its ends, which are what can lie near another part
    touched = F.array_distinct(F.array(F.floor(F.col("start") / SCOPE), F.floor(F.col("stop") / SCOPE)))
    filed = parts.select("row", role.alias("role"), F.col("start").alias("q_start"), F.col("stop").alias("q_stop"), F.explode(touched).alias("scope"))
    asks = F.element_at(F.array(*(F.array(*map(F.lit, COMPLETED_BY.get(k, [""]))) for k in KINDS)), F.col("rank") + 1)
    near = F.array_distinct(F.flatten(F.transform(touched, lambda s: F.array(s - 1, s, s + 1))))
    asked = rows.select("row", F.explode("weak").alias("p")).select("row", "p.*").withColumn("role", F.explode(asks)).withColumn("scope", F.explode(near))
    apart = ((F.col("q_start") >= F.col("stop")) & (F.col("q_start") <= F.col("stop") + SCOPE)) | ((F.col("q_stop") <= F.col("start")) & (F.col("q_stop") >= F.col("start") - SCOPE))
    met = asked.alias("a").join(
        filed.alias("f"), (F.col("a.row") == F.col("f.row")) & (F.col("a.scope") == F.col("f.scope")) & (F.col("a.role") == F.col("f.role")) & apart,
        "left_semi"
    )
    return met.select("row", F.struct("start", "rank", "stop").alias("p")).groupBy("row").agg(F.collect_set("p").alias("extra"))


def secret_scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, strong, extra): arrays of spans (start, rank, stop), one row for each row.

    rank numbers KINDS; places are code points, stop is exclusive; strong is sorted. extra are weak spans that a complementary part
    within SCOPE code points, not overlapping, completes. Null and empty texts have none; long texts are scanned whole. Rows may repeat, doc_id may be
    null; of spans that start together the kinds' order decides. An empty table gives an empty result. Other columns are ignored.
    """
    found = materialize(_candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "secrets")
    extra = _linked(found)
    none = F.expr(f"cast(array() as array<{PART}>)")
    return found.join(extra, "row", "left").select("doc_id", "strong", F.array_sort(F.coalesce("extra", none)).alias("extra"))


def rendered(parts: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(parts, lambda p: F.concat_ws(":", F.element_at(names, p["rank"] + 1), p["start"].cast("string"), p["stop"].cast("string"))), ","
    )


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs(doc_id, text, ...) with every found span replaced by a mark and n_chars, if there is such a column, counted anew; other columns stay.

    Spans that overlap become one mark. Null and empty texts and texts without spans stay as they are; long texts are scanned whole; repeated rows
    come back as often as they stand there; an empty table stays empty.
    """
    found = materialize(_candidates(docs.select("doc_id", "text")).where(F.size("strong") + F.size("weak") > 0), "secrets")
    none = F.expr(f"cast(array() as array<{PART}>)")
    key, row, spans_, new = (fresh(docs, n) for n in ("key", "of_row", "cut_spans", "new_text"))
    marks = found.dropDuplicates(["row"]).join(_linked(found), "row", "left").select(
        F.col("row").alias(row), F.array_sort(F.concat("strong", F.coalesce("extra", none))).alias(spans_)
    ).where(F.size(spans_) > 0)
    marks = materialize(marks, "secret-spans")
    discard(found)
    long = lambda x: F.lit(x).cast("long")

    def cut(acc, p):
        begin = F.greatest(p["start"], acc["at"])
        piece = F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int")), F.lit(mark))
        inside = p["stop"] <= acc["at"]
        return F.struct(F.when(inside, acc["out"]).otherwise(piece).alias("out"), F.greatest(p["stop"], acc["at"]).alias("at"))

    done = F.aggregate(
        spans_, F.struct(F.lit("").alias("out"), long(0).alias("at")), cut,
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), 2**31 - 1))
    )
    marked = docs.withColumn(key, _row()).join(small(marks), F.col(key) == F.col(row), "left")
    marked = marked.withColumn(new, F.when(F.col(spans_).isNotNull(), done).otherwise(F.col("text")))

    def column(c):
        if c == "n_chars":
            return F.when(F.col(spans_).isNotNull(), F.length(new).cast("long")).otherwise(F.col(c)).alias(c)
        return F.col(new).alias(c) if c == "text" else F.col(c)

    return marked.select(*map(column, docs.columns))
