"""The queries that SQL can express against DuckDB."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from textbayes.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_twin(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, got = queries.queries()[name](spark, SF), con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    rows = Counter(tuple(map(str, r)) for r in df.select(columns).collect())
    assert rows and rows == Counter(tuple(map(str, r)) for r in got.fetchall())
