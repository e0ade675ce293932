"""Command line: run, final-test, explain, info. Exit codes: 0 done, 2 a file is missing, 1 anything else."""

from __future__ import annotations

import argparse
import sys
import traceback

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbayes.config import Config, load_config
from textbayes.operators import cleaning
from textbayes.plans import analyzer
from textbayes.sources import tables
from textbayes.storage import materialize, release


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textbayes", description=__doc__)
    p.add_argument("--config", help="a JSON configuration; by default the frozen one")
    commands = p.add_subparsers(dest="command", required=True)
    for name, text in (("run", "fit on train, evaluate on dev"), ("final-test", "fit on train and dev, evaluate on test, with tests of significance")):
        c = commands.add_parser(name, help=text)
        for split in ("train", "dev", "test"):
            c.add_argument(f"--{split}", required=True, help=f"TSV file or folder of the {split} split")
        c.add_argument("--out", default="results")
        c.add_argument("--save-model")
        if name == "final-test":
            c.add_argument("--skip-bootstrap", action="store_true")
    c = commands.add_parser("explain", help="explain predictions as JSON")
    c.add_argument("--model-path", required=True)
    c.add_argument("--text", nargs="+", help="texts; by default lines of the standard input")
    c.add_argument("--model", default="SDFWNB")
    c.add_argument("--top", type=int, default=10)
    commands.add_parser("info", help="print the configuration")
    commands.add_parser("download", help="not available: this engine reads local or shared paths")
    return p


def load_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The cleaned splits as one table (split, row_id, label, text, model_text), kept, with its summary printed."""
    whole = None
    for split, path in paths.items():
        part = tables.standardize(tables.read_split(spark, path), split)
        whole = part if whole is None else whole.unionByName(part)
    cleaned = materialize(cleaning.clean(whole), "cleaned")
    cleaning.summary(cleaned).orderBy("split").show()
    return cleaning.ready(cleaned)


def _docs(ready: DataFrame, *splits: str) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, splits)), F.col("split")) - 1
    return ready.where(F.col("split").isin(*splits)).select(
        (F.col("row_id") * len(splits) + rank).alias("doc_id"), F.col("label").cast("int").alias("label"), "model_text"
    )


def _protocol(spark: SparkSession, args, config: Config) -> None:
    ready = load_splits(spark, {s: getattr(args, s) for s in ("train", "dev", "test")})
    final = args.command == "final-test"
    train = _docs(ready, "train", "dev") if final and config.train_dev_merge else _docs(ready, "train")
    model = analyzer.fit(train, config)
    report = model.evaluate(_docs(ready, "test" if final else "dev"))
    prefix = "final_test" if final else "validation"
    tables.write_csv(report["metrics"], f"{args.out}/{prefix}_metrics.csv")
    tables.write_json({"config": config.__dict__, "features": model.params.count(), "pairs": model.corrections.count()}, f"{args.out}/{prefix}_metadata.json")
    if final:
        tests = analyzer.significance(report["predictions"], config)
        tables.write_csv(tests["mcnemar"], f"{args.out}/{prefix}_mcnemar.csv")
        if not args.skip_bootstrap:
            tables.write_csv(tests["bootstrap"], f"{args.out}/{prefix}_bootstrap.csv")
    if args.save_model:
        model.save(args.save_model)
    report["metrics"].show(truncate=False)


def _explain(spark: SparkSession, args) -> None:
    from textbayes.functions.text import normalize

    model = analyzer.Model.load(spark, args.model_path)
    lines = args.text or [line.rstrip("\n") for line in sys.stdin]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").select("doc_id", normalize(F.col("text")).alias("model_text"))
    for row in model.explain(docs, args.model, args.top).orderBy("doc_id").select(F.to_json(F.struct("*")).alias("json")).collect():
        print(row.json)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        config = load_config(args.config)
        if args.command == "info":
            print(config.to_json())
        elif args.command == "download":
            raise NotImplementedError("there is no download; give paths to --train, --dev and --test")
        else:
            spark = SparkSession.builder.appName("textbayes").getOrCreate()
            _explain(spark, args) if args.command == "explain" else _protocol(spark, args, config)
            release(spark)
    except FileNotFoundError as e:
        print(f"missing file: {e}", file=sys.stderr)
        return 2
    except Exception:  # noqa: BLE001
        traceback.print_exc()
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
