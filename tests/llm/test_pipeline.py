from collections import Counter

import corpus_pipeline
from textbayes.llm import decontaminate, secrets, toxicity
from tests.llm import plain
from tests.llm.test_ngram_join import brute


def masked(text):
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in plain.secrets(text)[0])
    out, at = "", 0
    for a, b in spans:
        if b > at:
            out, at = out + text[at : max(a, at)] + "[REDACTED]", b
    return out + (text or "")[at:]


def test_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    rows = {i: t for i, t in rows.items() if score[i] < 0.5}
    now = stages["toxicity"](spark, docs, sf)
    assert {r.doc_id for r in now.collect()} == set(rows) and now.columns == columns
    component = brute(list(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if component[i][1] == i}
    now = stages["near copies"](spark, now, sf)
    assert Counter(r.doc_id for r in now.collect()) == Counter(list(rows)) and now.columns == columns
    rows = {i: t for i, t in rows.items() if not plain.leaks(t, benchmark)[1]}
    now = stages["decontamination"](spark, now, sf)
    assert Counter(r.doc_id for r in now.collect()) == Counter(list(rows)) and now.columns == columns
    now = stages["secrets"](spark, now, sf)
    got = {r.doc_id: (r.text, r.n_chars) for r in now.collect()}
    spans = {r.doc_id: r.extra for r in secrets.secret_scan(docs).collect()}
    assert got.keys() == rows.keys() and now.columns == columns
    assert all(got[i] == (masked(t), len(masked(t))) for i, t in rows.items() if not spans[i])
    encoded = stages["encoding"](spark, now, sf).collect()
    assert {r.doc_id for r in encoded} == set(rows) and all(r.round_trip for r in encoded)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(rows)


def test_odd_rows(spark, tmp_path):
    data = plain.rows(spark)
    plain.frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    unique = list({r[0]: r[1] for r in data if r[0] is not None}.items())
    component = brute(unique, 5, 80)
    assert out == Counter([i for i, _ in unique if component[i][1] == i] + [None])


def test_empty_documents(spark, tmp_path):
    plain.frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "ids" in out.columns


def test_passages_in_long_documents_go(spark):
    """However small its share of a document, a benchmark passage takes the document away; its neighbours stay."""
    item = "what colour is the sky on a clear day in june at noon"
    docs = [(1, " ".join(["word"] * 5000) + " " + item + " end"), (2, " ".join(["word"] * 5000)), (3, item[:-5]), (4, None)]
    kept = decontaminate.clean(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
