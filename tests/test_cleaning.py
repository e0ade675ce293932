import pytest
from pyspark.sql import functions as F

from textbayes.operators import cleaning
from textbayes.sources import tables

DEV, TEST = [(1, "早上有雾")], [(0, "傍晚起风")]


def cleaned(spark, train, dev=DEV, test=TEST):
    data = [(s, i, label, text) for s, rows in (("train", train), ("dev", dev), ("test", test)) for i, (label, text) in enumerate(rows)]
    return cleaning.clean(spark.createDataFrame(data, "split string, row_id long, label long, text string"))


def kept(spark, *a, **k):
    out = cleaning.ready(cleaned(spark, *a, **k)).collect()
    return {s: sorted(r.text for r in out if r.split == s) for s in ("train", "dev", "test")}, out


def test_first_of_equal_rows_stays(spark):
    _, rows = kept(spark, [(0, "河水  很急"), (1, "湖面平静"), (0, "河水 很急"), (0, "河水 很急 ")])
    assert sorted((r.row_id, r.text) for r in rows if r.split == "train") == [(0, "河水  很急"), (1, "湖面平静")]


def test_disputed_texts_go_whole(spark):
    assert kept(spark, [(0, "山路很远"), (1, "桥上有人"), (1, "山路很远"), (1, "山路很远")])[0]["train"] == ["桥上有人"]


def test_later_splits_lose_what_earlier_ones_keep(spark):
    got, _ = kept(spark, [(1, "X月光"), (0, "x月光"), (1, "灯塔"), (0, "沙滩")], [(0, "沙滩"), (1, "船票"), (1, "钟楼")], [(1, "钟楼"), (0, "灯塔")])
    assert got == {"train": [], "dev": sorted(["沙滩", "船票"]), "test": sorted(["灯塔", "钟楼"])}


def test_normalized_texts_are_cleaned_too(spark):
    got, rows = kept(spark, [(1, "走了7里"), (1, "走了85里"), (0, "走了？"), (1, "；，、"), (None, "无标签")])
    assert got["train"] == sorted(["走了7里", "走了？", "无标签"]) and sorted(r.model_text for r in rows if r.split == "train") == sorted(["走了数字里", "走了？", "无标签"])


def test_what_test_drops_protects_nothing(spark):
    got, _ = kept(spark, [(0, "海鸥飞过")], test=[(0, "海鸥飞过"), (1, "海鸥飞过"), (1, "退潮")])
    assert got["train"] == ["海鸥飞过"] and got["test"] == ["退潮"]


def test_summary_counts(spark):
    train = [(0, "渔船"), (0, "渔船"), (0, "港口"), (1, "港口"), (0, "傍晚起风"), (1, "、、"), (1, "B 3"), (1, "b 4")]
    t = {r.split: r for r in cleaning.summary(cleaned(spark, train)).collect()}["train"]
    assert (t.n_rows, t.raw_conflict, t.raw_duplicate, t.raw_leak, t.raw_left) == (8, 2, 1, 1, 4)
    assert (t.model_empty, t.model_conflict, t.model_duplicate, t.model_leak, t.model_left) == (1, 0, 1, 0, 2)


def test_sources(spark, tmp_path):
    path = tmp_path / "train.tsv"
    path.write_bytes("﻿label\ttext_a\n1\t竹林 \"x\"\n\n1.7\tb\nx\tc\n0\t\n".encode())
    df = tables.standardize(tables.read_split(spark, str(path)), "train")
    assert [(r.label, r.text) for r in df.orderBy("row_id").collect()] == [(1, '竹林 "x"'), (1, "b")]
    (tmp_path / "gb.tsv").write_bytes("Sentiment \tReview\n0\t石桥\n".encode("gb18030"))
    assert [tuple(r) for r in tables.standardize(tables.read_split(spark, str(tmp_path / "gb.tsv")), "dev").select("split", "label", "text").collect()] == [("dev", 0, "石桥")]
    with pytest.raises(ValueError, match="0 or 1"):
        tables.standardize(spark.createDataFrame([(2, "x")], "label int, text string"), "train")
    with pytest.raises(ValueError, match="column"):
        (tmp_path / "bad.tsv").write_text("a\tb\n1\t2\n")
        tables.read_split(spark, str(tmp_path / "bad.tsv"))
    with pytest.raises(FileNotFoundError):
        tables.read_split(spark, str(tmp_path / "none.tsv"))
    late = tmp_path / "late.tsv"  # what tells its encoding stands after a long run of ASCII
    late.write_bytes(b"label\ttext\n" + b"1\tplain line of ascii\n" * 60_000 + "0\t石桥\n".encode("gb18030"))
    assert tables.read_split(spark, str(late)).orderBy(F.desc("row_id")).first().text == "石桥"
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    for name, data in (("b.tsv", "label\ttext\n0\t乙\n1\t丙\n".encode("gb18030")), ("a.tsv", "\ufefflabel\ttext\n1\t甲\n".encode()), ("c.tsv", b"label\ttext\n" + b"1\tz\n" * 5000)):
        (mixed / name).write_bytes(data)
    rows = tables.standardize(tables.read_split(spark, str(mixed)), "test").orderBy("row_id").collect()
    assert [r.text for r in rows[:4]] == ["甲", "乙", "丙", "z"] and [r.row_id for r in rows] == list(range(5003))
    (tmp_path / "broken.tsv").write_bytes(b"label\ttext\n1\t\xff\xff\n")
    with pytest.raises(Exception, match="decode"):
        tables.read_split(spark, str(tmp_path / "broken.tsv")).collect()
    import hashlib

    pins = {"train.tsv": hashlib.sha256(path.read_bytes()).hexdigest().upper(), "gb.tsv": "0" * 64, "gone.tsv": "1" * 64}
    assert {r.name: r.ok for r in tables.verify_pinned(spark, str(tmp_path / "*.tsv"), pins).collect()} == {"train.tsv": True, "gb.tsv": False, "gone.tsv": False}
    assert tables.verify_checksum(spark, str(path), hashlib.sha256(path.read_bytes()).hexdigest())
    tables.write_csv(df.select(F.lit(1).alias("a")), str(tmp_path / "o/x.csv"))
    assert (tmp_path / "o/x.csv").read_bytes().startswith(b"\xef\xbb\xbfa")
