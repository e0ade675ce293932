"""Column expressions on text: normalization, duplicate keys, character n-grams and predicates on grams.

Normalization is an Arrow UDF that works on blocks of texts (blocks.normalized): ten regular expressions over each text cost fifty times as much.
Of duplicate keys all but Unicode NFKC is built in; that is an Arrow UDF for texts with a character outside of ranges that it leaves alone.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textbayes.config import HAN
from textbayes.functions import blocks
from textbayes.functions.blocks import EMAIL, NUMBER, PUNCTUATION, URL

# Placeholders and white space.
PLACEHOLDERS = (NUMBER, URL, EMAIL)
SPACE = r"\s\x1c-\x1f"
#: Ranges that NFKC leaves alone, also side by side.
STABLE = "\x00-\x9fÀ-ıĴ-ľŁ-ňŊ-žƀ-ǃǍ-ǰǴ-ʯ、-。" + HAN


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC of a text; null stays null."""
    return F.coalesce(_nfkc(F.when(text.rlike(f"[^{STABLE}]"), text)), text)


@F.arrow_udf(StringType())
def _normalized(column: pa.Array) -> pa.Array:
    return blocks.mapped(column, lambda part: blocks.normalized(blocks.strings(part)))


def normalize(text: Column) -> Column:
    """The text that models read: lower case, placeholders for urls, mail addresses and numbers, no white space, no other signs than PUNCTUATION."""
    return _normalized(text)


def duplicate_key(text: Column) -> Column:
    """What two raw texts share if they count as the same: NFKC, lower case, single spaces."""
    x = F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), rf"(?U)[{SPACE}]+", " ")
    return F.btrim(x)


def ngrams(text: Column, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """All character n-grams in order, shorter first, by code point; grams of nothing but PUNCTUATION are left out."""
    low, high = ngram_range
    if low < 1 or high < low:
        raise ValueError("ngram_range must be (low, high) with 1 <= low <= high")
    parts = [F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))."), F.lit(1)) for n in range(low, high + 1)]
    grams = parts[0] if len(parts) == 1 else F.concat(*parts)
    return F.filter(grams, lambda g: ~g.rlike(f"^[{PUNCTUATION}]+$"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def counted(grams: Column) -> Column:
    """array<struct<gram, tf>> of an array's distinct elements: sorted, each run gives one; null for an empty array."""

    def runs(a):
        begin = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
        return _let(begin, lambda b: F.transform(b, lambda x, j: F.struct(F.get(a, x).alias("gram"), (F.coalesce(F.get(b, j + 1), F.size(a)) - x).cast("long").alias("tf"))))

    return F.when(F.size(grams) > 0, _let(F.sort_array(grams), runs))


def is_script_bigram(gram: Column, script_class: str = HAN) -> Column:
    """Whether a gram is two characters of a class; null is not."""
    return F.coalesce(gram.rlike(rf"\A[{script_class}]{{2}}\z"), F.lit(False))


def share_character(a: Column, b: Column) -> Column:
    return F.arrays_overlap(F.split(a, ""), F.split(b, ""))


def holds_placeholder(gram: Column) -> Column:
    return gram.rlike("|".join(PLACEHOLDERS))
