from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textbayes.llm import queries, token_counts
from tests.llm import plain

PATH = public_tokenizers.path("word_bpe_49k.json")
DECOMPOSED = ["aH\u0331b", "HaT\u0308amza", "aW\u030ab", "aY\u030ab", "J\u030c", "J\u030cA.", "\u00c9COLE!", "\u0130STANBUL,", "HELLO", "Don'T."]


@pytest.fixture(scope="module")
def n():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)


def test_capitals_with_marks_that_compose_in_small_letters_only(spark, n):
    docs = [*DECOMPOSED, " ".join(DECOMPOSED)]
    out = token_counts.token_counts(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), PATH).collect()
    assert {r.doc_id: len(r.token_ends) for r in out} == {i: n(t) for i, t in enumerate(docs)}


def test_against_the_library(spark, n):
    data = plain.rows(spark, extra=["x" * 9000, "日本語" * 3000, "a" * 3_000_000])
    df = plain.frame(spark, data)
    out = token_counts.token_counts(df, PATH).collect()
    assert Counter((r.doc_id, r.n_bytes, len(r.token_ends)) for r in out) == Counter((r[0], len((r[1] or "").encode()), n(r[1])) for r in data)
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0
    cuts = {(r.doc_id, r.n_bytes): r.c for r in token_counts.token_counts(df, PATH).select("doc_id", "n_bytes", token_counts.cut_bytes(F.col("n_bytes"), F.col("token_ends"), 50).alias("c")).collect()}
    text = {(r[0], len((r[1] or "").encode())): (r[1] or "").encode() for r in data}
    for r in out:
        raw, ends = text[r.doc_id, r.n_bytes], np.array(r.token_ends, np.int64)
        assert cuts[r.doc_id, r.n_bytes] == token_counts.within(ends, len(raw), 50)


def test_every_prefix(spark, n):
    """Ends are those of the library's tokens of the whole text; at ends of words the count is that of the prefix encoded alone, and so is the cut's."""
    texts = [t for t in plain.ODD if t and len(t) < 400 and "<|" not in t] + ["naïveté déjà-vu, 日本語テキスト 😀😀 e\u0301e\u0301 unbelievably antidisestablishmentarianism"]
    tokenizer = Tokenizer.from_file(PATH)
    out = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    for r in out:
        text = texts[r.doc_id]
        raw, ends = text.encode(), np.array(r.token_ends, np.int64)
        offsets = [b for _, b in tokenizer.encode(text, add_special_tokens=False).offsets]
        assert ends.tolist() == np.maximum.accumulate([len(text[:b].encode()) for b in offsets]).tolist()
        for i in range(len(text) + 1):
            assert token_counts.before(ends, len(text[:i].encode())) == sum(len(text[:b].encode()) <= len(text[:i].encode()) for b in np.maximum.accumulate(offsets))
            if i == len(text) or text[i] == " ":
                assert token_counts.before(ends, len(text[:i].encode())) == n(text[:i])
        for limit in range(len(ends) + 2):
            cut = token_counts.within(ends, len(raw), limit)
            assert token_counts.before(ends, cut) <= limit
            longer = [e for e in r.token_ends if e > cut]
            assert not longer or token_counts.before(ends, min(longer)) > limit


def test_long_words_are_cut_inside(spark):
    df = spark.createDataFrame([(1, "日本語テキスト" * 2000), (2, "short")], "doc_id long, text string")
    out = {r.doc_id: r for r in token_counts.token_counts(df, PATH).select("doc_id", "n_bytes", token_counts.cut_bytes(F.col("n_bytes"), F.col("token_ends"), queries.LIMIT).alias("cut"), F.size("token_ends").alias("n")).collect()}
    assert out[1].n > queries.LIMIT and 2000 < out[1].cut < out[1].n_bytes and out[2].cut == 5
