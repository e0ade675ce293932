from textbayes.llm.ngram_join import keep_one


def test_texts_that_share_a_doc_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    # 7 stands for a copy of a and for two texts of its own; one row stands twice; 9 is a copy of one of 7's texts
    rows = [(1, a, "x"), (7, a, "x"), (7, b, "x"), (7, c, "x"), (7, c, "y"), (9, b, "x"), (10, d, "x"), (-3, d, "x"), (None, a, "x"), (8, None, "x"), (8, "", "x")]
    out = keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert out.columns == ["doc_id", "text", "source"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (7, b), (7, c), (-3, d), (None, a), (8, None), (8, "")], key=str)
