"""Queries of the engine's operators on the driver's tables, each over the whole of them.

Labelled documents are documents with labels.quality. Counts and fits use all of them, scores and evidence are of all documents. The queries named
final_test_... run the whole protocol: every labelled document is put in a split by doc_id mod 10 (0 to 6 train, 7 dev, 8 and 9 test), splits are
cleaned, the models are fitted on train and dev and judged on test. The tables' languages have Latin script, so script features are pairs of a-z.
Doubles are rounded to 6 places for comparison.

Texts are dealt by doc_id when they are read: normalization costs a hundred times what that shuffle does, and files don't always divide well.
"""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textbayes.config import Config, load_config
from textbayes.functions import text as T
from textbayes.operators import cleaning, dependency, evaluation, explain, features, redundancy
from textbayes.plans import analyzer
from textbayes.sources import tables
from textbayes.storage import materialize, shared_dir

CONFIG = replace(Config(), script_class="a-z")


def _documents(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition("doc_id")


def _labels(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))


def _labelled(spark, sf_dir) -> DataFrame:
    return _documents(spark, sf_dir).join(_labels(spark, sf_dir), "doc_id").select("doc_id", "label", T.normalize(F.col("text")).alias("model_text"))


def _all(spark, sf_dir) -> DataFrame:
    """Every document, with a label where it has one."""
    return _documents(spark, sf_dir).join(_labels(spark, sf_dir), "doc_id", "left").select("doc_id", "label", T.normalize(F.col("text")).alias("model_text"))


def _split(doc_id):
    d = doc_id % 10
    return F.when(d < 7, "train").when(d == 7, "dev").otherwise("test")


def _model(spark, sf_dir) -> analyzer.Model:
    return analyzer.fit(_labelled(spark, sf_dir), CONFIG)


def _terms(docs) -> DataFrame:
    return features.gram_stats(docs, CONFIG)


def _vocabulary(docs) -> DataFrame:
    return features.vocabulary(_terms(docs), CONFIG)


def _stats(docs) -> DataFrame:
    """The table of features, written once."""
    told = features.information(_vocabulary(docs), features.class_totals(docs), CONFIG)
    return features.information_weights(materialize(told, "information"), CONFIG)


def _round(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def normalize_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("model_text"))


def dup_key(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.duplicate_key(F.col("text")).alias("dup_key"))


def _wide(text):
    """A text with its visible ASCII in full-width form, which NFKC undoes."""
    codes = range(0x21, 0x7F)
    return F.translate(text, "".join(map(chr, codes)), "".join(chr(c + 0xFEE0) for c in codes))


def normalize_wide(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.normalize(_wide(F.col("text"))).alias("model_text"))


def dup_key_wide(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.duplicate_key(_wide(F.col("text"))).alias("dup_key"))


def char_ngrams(spark, sf_dir):
    docs = normalize_text(spark, sf_dir).withColumn("label", F.lit(0))
    return features.doc_grams(docs, CONFIG).select("doc_id", "gram", "tf")


def unigram_bigram(spark, sf_dir):
    docs = normalize_text(spark, sf_dir)
    return docs.select(F.explode(T.ngrams(F.col("model_text"), (1, 2))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def gram_predicates(spark, sf_dir):
    gram, other = F.col("gram"), F.lit("the数")
    return _vocabulary(_labelled(spark, sf_dir)).select(
        "gram", T.is_script_bigram(gram).alias("is_han"), T.is_script_bigram(gram, "a-z").alias("is_latin"),
        T.share_character(gram, other).alias("shares"), T.holds_placeholder(gram).alias("placeholder")
    )


def vocab_df_tf(spark, sf_dir):
    return _vocabulary(_labelled(spark, sf_dir)).select("idx", "gram", "df", "tf")


def vocab_topk(spark, sf_dir):
    return features.vocabulary(_terms(_labelled(spark, sf_dir)), replace(CONFIG, max_features=100)).select("idx", "gram", "df", "tf")


def vocab_unlimited(spark, sf_dir):
    """Without a limit indexes are numbered by ranges."""
    return features.vocabulary(_terms(_labelled(spark, sf_dir)), replace(CONFIG, max_features=None)).select("idx", "gram", "df", "tf")


def doc_term_counts(spark, sf_dir):
    docs = analyzer.prepared(_labelled(spark, sf_dir))
    return features.counts(features.doc_grams(docs, CONFIG), _vocabulary(docs), CONFIG).select("doc_id", "idx", "tf")


def _cleaned(spark, sf_dir) -> DataFrame:
    """All documents, labelled by doc_id mod 2, with conflicts and copies across splits."""
    docs = _documents(spark, sf_dir)
    return cleaning.clean(docs.select(_split(F.col("doc_id")).alias("split"), F.col("doc_id").alias("row_id"), (F.col("doc_id") % 2).alias("label"), "text"))


def clean_pipeline(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("split", "row_id", "raw_reason", "model_reason")


def clean_ready(spark, sf_dir):
    return cleaning.ready(_cleaned(spark, sf_dir)).select("split", "row_id", "label", "model_text")


def clean_summary(spark, sf_dir):
    return cleaning.summary(_cleaned(spark, sf_dir))


def class_df(spark, sf_dir):
    return _stats(_labelled(spark, sf_dir)).select("idx", "df0", "df1", "tf0", "tf1", "n0", "n1")


def feature_information(spark, sf_dir):
    return _round(_stats(_labelled(spark, sf_dir)).select("idx", "gram", "mi", "norm_mi", "direction", "w_fwnb"))


def redundancy_candidates(spark, sf_dir):
    return _round(redundancy.candidates(_stats(_labelled(spark, sf_dir)), CONFIG))


def _cooccurrence(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = analyzer.prepared(_labelled(spark, sf_dir))
    stats = _stats(docs)
    return redundancy.document_pair_frequency(docs, stats, redundancy.candidates(stats, CONFIG), CONFIG), stats


def pair_cooccurrence(spark, sf_dir):
    return _cooccurrence(spark, sf_dir)[0]


def redundancy_relations(spark, sf_dir):
    pairs, stats = _cooccurrence(spark, sf_dir)
    return _round(redundancy.relations(pairs, stats, CONFIG))


def dfwnb_weights(spark, sf_dir):
    return _round(_model(spark, sf_dir).params.select("idx", "redundancy", "w_fwnb", "w_dfwnb"))


def doc_pairs(spark, sf_dir):
    docs = analyzer.prepared(_labelled(spark, sf_dir))
    return dependency.doc_pairs(docs, _vocabulary(docs), CONFIG).select("doc_id", "left_idx", "right_idx")


def dependency_table(spark, sf_dir):
    return _round(_model(spark, sf_dir).dependencies)


def dependency_selection(spark, sf_dir):
    return _round(_model(spark, sf_dir).corrections)


def nb_params(spark, sf_dir):
    model = _model(spark, sf_dir)
    return _round(model.params.crossJoin(F.broadcast(model.classes)).select("idx", "logp0", "logp1", "log_prior_0", "log_prior_1"))


def class_params(spark, sf_dir):
    """What a fit says of itself: documents, tokens and features."""
    model = _model(spark, sf_dir)
    totals = model.params.select("n0", "n1").limit(1)
    counts = model.corrections.agg(F.count("*").alias("n_corrections"))
    return _round(model.classes.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(counts)))


def score_all(spark, sf_dir):
    scored = _model(spark, sf_dir).score(_all(spark, sf_dir))
    names = {c: c.replace("-", "_").lower() for c in scored.columns}
    return _round(scored.withColumnsRenamed(names))


def predict_all(spark, sf_dir):
    return _round(_model(spark, sf_dir).predict(_all(spark, sf_dir)))


def metrics_all(spark, sf_dir):
    return _round(_model(spark, sf_dir).evaluate(_labelled(spark, sf_dir))["metrics"])


def macro_f1_all(spark, sf_dir):
    return _round(evaluation.macro_f1_only(_predicted(spark, sf_dir)))


def _predicted(spark, sf_dir) -> DataFrame:
    return _model(spark, sf_dir).evaluate(_labelled(spark, sf_dir))["predictions"]


def _tests(predicted: DataFrame) -> DataFrame:
    return _round(evaluation.mcnemar(predicted)).withColumnRenamed("significant_at_0.05", "significant")


def mcnemar_all(spark, sf_dir):
    return _tests(_predicted(spark, sf_dir))


def bootstrap_cells(spark, sf_dir):
    """The counts that a paired bootstrap draws from."""
    return evaluation.cells(_predicted(spark, sf_dir))


def bootstrap_all(spark, sf_dir):
    return evaluation.bootstrap(_predicted(spark, sf_dir), CONFIG.bootstrap_resamples, CONFIG.random_seed + CONFIG.bootstrap_seed_offset)


def top_features(spark, sf_dir):
    return _round(explain.top_features(_model(spark, sf_dir).params, 20)).drop("redundancy", "w_dfwnb")


def top_features_positive(spark, sf_dir):
    return _round(explain.top_features(_model(spark, sf_dir).params, 20, class_filter=1)).drop("redundancy", "w_dfwnb")


def top_features_negative(spark, sf_dir):
    return _round(explain.top_features(_model(spark, sf_dir).params, 20, class_filter=0)).drop("redundancy", "w_dfwnb")


def top_redundant(spark, sf_dir):
    """Features by redundancy, rounded before they are ranked, so that the twin's order is the same."""
    params = _model(spark, sf_dir).params.withColumn("redundancy", F.round("redundancy", 6))
    return _round(explain.redundancy_relations(params, 20)).select("idx", "feature", "redundancy", "w_fwnb", "w_dfwnb", "df")


def top_dependencies(spark, sf_dir):
    return _round(explain.top_dependencies(_model(spark, sf_dir).dependencies, 20))


def explain_features(spark, sf_dir):
    return _round(_model(spark, sf_dir).evidence(_all(spark, sf_dir), "FWNB", 10)).drop("idx")


def explain_dependencies(spark, sf_dir):
    return _round(_model(spark, sf_dir).effects(_all(spark, sf_dir)))


def explain_documents(spark, sf_dir):
    """Each document's explanation: scores, sums of evidence, the strongest terms in order, and whether all has its place in the JSON."""
    out = _model(spark, sf_dir).explain(_all(spark, sf_dir))
    names = lambda c, f: F.array_join(F.transform(F.coalesce(c, F.array().cast(out.schema[c].dataType)), lambda x: x[f]), " ")
    json = F.to_json(F.struct("*"))
    sizes = [F.coalesce(F.json_array_length(F.get_json_object(json, f"$.{c}")), F.lit(0)).alias(f"n_{c}") for c in ("features", "dependencies")]
    sums = ["evidence_0", "evidence_1", "effect_0", "effect_1", "log_prior_0", "log_prior_1"]
    return _round(out.select(
        "doc_id", "pred", "score0", "score1", *sums, names("features", "feature").alias("features"),
        names("dependencies", "trigram").alias("dependencies"), *sizes
    ))


def model_roundtrip(spark, sf_dir):
    """Predictions of a model that was written and read again."""
    import uuid

    path = _model(spark, sf_dir).save(f"{shared_dir(spark)}/model-{uuid.uuid4().hex}")
    return _round(analyzer.Model.load(spark, path).predict(_all(spark, sf_dir)))


def _protocol(spark, sf_dir) -> dict:
    raw = _documents(spark, sf_dir).join(_labels(spark, sf_dir), "doc_id")
    ready = materialize(
        cleaning.ready(cleaning.clean(raw.select(_split(F.col("doc_id")).alias("split"), F.col("doc_id").alias("row_id"), "label", "text"))), "ready"
    )
    docs = ready.select("split", F.col("row_id").alias("doc_id"), "label", "model_text")
    return analyzer.fit(docs.where("split <> 'test'"), CONFIG).evaluate(docs.where("split = 'test'"))


def final_test_metrics(spark, sf_dir):
    return _round(_protocol(spark, sf_dir)["metrics"])


def final_test_confusion(spark, sf_dir):
    return _protocol(spark, sf_dir)["confusion"]


def final_test_mcnemar(spark, sf_dir):
    return _tests(_protocol(spark, sf_dir)["predictions"])


def final_test_predictions(spark, sf_dir):
    return _round(_protocol(spark, sf_dir)["predictions"])


def final_test_bootstrap(spark, sf_dir):
    return evaluation.bootstrap(_protocol(spark, sf_dir)["predictions"], CONFIG.bootstrap_resamples, CONFIG.random_seed + CONFIG.bootstrap_seed_offset)


def _scratch(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _one_line(text):
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\t\\n\\r\\x0b\\x0c\\x1c-\\x1f\\x85\u2028\u2029]+", " "), F.lit(" "))


def _read_back(spark, path: str) -> DataFrame:
    return tables.standardize(tables.read_split(spark, path), "train").select("split", "label", "text")


def tsv_split(spark, sf_dir):
    """Labelled documents, written as tab-separated files, read and standardized: rows without text go, labels are numbers."""
    docs = _documents(spark, sf_dir).join(_labels(spark, sf_dir), "doc_id")
    tables.write_split(docs.select(F.col("label").cast("string").alias("label"), _one_line(F.col("text")).alias("text_a")), path := _scratch(spark, "tsv"))
    return _read_back(spark, path)


def tsv_gb18030(spark, sf_dir):
    """The same of normalized texts, whose marks are Chinese, in GB18030 and under other names of columns."""
    docs = _labelled(spark, sf_dir)
    tables.write_split(
        docs.select(F.col("label").cast("string").alias(" Sentiment"), F.col("model_text").alias("Review ")), path := _scratch(spark, "tsv-gb"),
        "gb18030"
    )
    return _read_back(spark, path)


def tsv_odd_labels(spark, sf_dir):
    """Labels as text, of which some are no numbers and some have fractions, under a byte order mark; conversations give the texts."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = F.pmod(F.length("text"), F.lit(4))
    label = F.when(kind == 0, "0").when(kind == 1, "1.7").when(kind == 2, "?").otherwise("")
    tables.write_split(turns.select(label.alias("\ufeffY"), _one_line(F.col("text")).alias("content"), "role"), path := _scratch(spark, "tsv-odd"))
    return _read_back(spark, path)


def label_domain(spark, sf_dir):
    """Labels outside of 0 and 1, of texts read without the check."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    tables.write_split(
        turns.select(F.pmod(F.length("text"), F.lit(4)).cast("string").alias("labels"), F.lit("x").alias("text")),
        path := _scratch(spark, "tsv-domain")
    )
    return tables.unknown_labels(tables.standardize(tables.read_split(spark, path), "train", check=False))


def frozen_config(spark, sf_dir):
    """The frozen settings, as a configuration file holds them, after it was read."""
    import json
    import os
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False) as f:
        f.write(Config().to_json())
    values = asdict(load_config(f.name))
    os.remove(f.name)
    return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in values.items() if k != "script_class"], "name string, value string")


def tsv_in_order(spark, sf_dir):
    """row_id numbers the rows of several files by file and place."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.pmod("o_orderkey", F.lit(2)).cast("string").alias("label"), F.format_string("%015d", F.col("o_orderkey").cast("long")).alias("text")
    )
    tables.write_split(orders.repartitionByRange(7, "text").sortWithinPartitions("text"), path := _scratch(spark, "tsv-order"))
    out = tables.standardize(tables.read_split(spark, path), "dev")
    return out.select("split", "row_id", "label", F.col("text").cast("long").alias("o_orderkey"))


def _checked(spark, sf_dir) -> str:
    """A folder with one file for each nation."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    nations.repartition("key").write.partitionBy("key").text(path := _scratch(spark, "files"))
    return path


def file_checksums(spark, sf_dir):
    found = tables.checksums(spark, f"{_checked(spark, sf_dir)}/*/")
    return found.select(F.regexp_extract("path", "key=(\\d+)", 1).cast("long").alias("n_nationkey"), "sha256")


def result_sinks(spark, sf_dir):
    """Metrics as CSV with a byte order mark, read again: the sinks that the command line uses."""
    import json
    import os
    import tempfile

    folder = tempfile.mkdtemp()  # results for people are written by the driver, to a folder of its own
    metrics = evaluation.confusion(_predicted(spark, sf_dir))
    tables.write_csv(metrics.orderBy("model"), f"{folder}/metrics.csv")
    tables.write_json({"rows": metrics.count(), "alpha": CONFIG.alpha}, f"{folder}/meta.json")
    with open(f"{folder}/metrics.csv", encoding="utf-8-sig") as f:
        head, *lines = [line.split(",") for line in f.read().splitlines()]
    with open(f"{folder}/meta.json", encoding="utf-8") as f:
        meta = json.load(f)
    for name in ("metrics.csv", "meta.json"):
        os.remove(f"{folder}/{name}")
    os.rmdir(folder)
    rows = [(r[0], *map(int, r[1:]), meta["rows"], meta["alpha"]) for r in lines]
    return spark.createDataFrame(rows, ", ".join(["model string", *(f"{c} long" for c in head[1:]), "n_rows long", "alpha double"]))


NAMES = [
    "normalize_text", "dup_key", "normalize_wide", "dup_key_wide", "char_ngrams", "unigram_bigram", "gram_predicates", "vocab_df_tf", "vocab_topk", "vocab_unlimited", "doc_term_counts", "clean_pipeline", "clean_ready", "clean_summary", "class_df",
    "feature_information", "redundancy_candidates", "pair_cooccurrence", "redundancy_relations", "dfwnb_weights", "doc_pairs", "dependency_table", "dependency_selection", "nb_params", "class_params", "score_all", "predict_all",
    "metrics_all", "macro_f1_all", "mcnemar_all", "bootstrap_cells", "bootstrap_all", "top_features", "top_features_positive", "top_features_negative", "top_redundant", "top_dependencies", "explain_features",
    "explain_dependencies", "explain_documents", "model_roundtrip", "final_test_metrics", "final_test_confusion", "final_test_mcnemar", "final_test_predictions", "final_test_bootstrap", "tsv_split", "tsv_gb18030", "tsv_odd_labels",
    "label_domain", "frozen_config", "tsv_in_order", "file_checksums", "result_sinks",
]


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}


def entry(spark) -> DataFrame:
    """The flagship: fit on the labelled documents of sf0.001, metrics of all models."""
    return metrics_all(spark, "/root/testdata/sf0.001")
