"""Every query with a SQL twin against DuckDB, and what imports what."""

import ast
import glob
import os
from pathlib import Path

import duckdb
import pytest

from textbayes import oracle, queries
from textbayes.storage import release

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", queries.NAMES)
def test_query(spark, db, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in oracle.oracle_sql():
        got = db.execute(oracle.oracle_sql()[name])
        columns = [d[0] for d in got.description]
        order = sorted(df.columns)
        assert sorted(columns) == order
        norm = lambda row, names: tuple(str(float(v) + 0.0) if isinstance(v, float) else str(v) for v in (row[names.index(c)] for c in order))
        assert sorted(norm(tuple(r), df.columns) for r in rows) == sorted(norm(r, columns) for r in got.fetchall())
    release(spark)


def test_every_labelled_row_counts(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").count()
    r = queries.class_df(spark, SF).first()
    assert r.n0 + r.n1 == n
    assert queries.score_all(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_plans_stay_short(spark):
    for name in ("metrics_all", "explain_documents", "mcnemar_all"):
        plan = queries.queries()[name](spark, SF)._jdf.queryExecution().toString()
        assert len(plan) < 200_000, name


def test_nothing_else_imports_llm():
    for path in [*ROOT.glob("textbayes/*.py"), *ROOT.glob("textbayes/*/*.py")]:
        if path.parent.name != "llm":
            for node in ast.walk(ast.parse(path.read_text())):
                if isinstance(node, (ast.Import, ast.ImportFrom)):
                    assert "llm" not in ast.unparse(node), path
