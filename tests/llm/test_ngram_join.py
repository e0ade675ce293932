import os
import random
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pytest

from textbayes.llm import ngram_join
from textbayes.llm.ngram_join import keep_one, ngram_jaccard_join

SCHEMA = "doc_id long, text string, component_id string"


def brute(rows, size=3, percent=90):
    table, sets = {}, {}
    for i, text, *_ in rows:
        words = (text or "").encode().lower().split()
        n = min(size, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    at = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            at[g].add(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j in {j for g in s for j in at[g] if j > i}:
            o = len(s & sets[j])
            if 100 * o >= percent * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for i in sets:
        table[i] = (len(sets[i]), find(i))
    return table


def found(spark, rows, *threshold):
    out = ngram_jaccard_join(spark.createDataFrame([(*r, "x")[:3] for r in rows], SCHEMA), *threshold).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


def corpus(seed=1):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, k = [], 0
    for _ in range(40):
        base = rnd.choices(vocabulary, k=rnd.choice([1, 2, 3, 5, 11, 12, 13, 30, 60, 200]))
        for _ in range(rnd.choice([1, 2, 6])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                words += rnd.choices(vocabulary, k=rnd.choice([1, 2]))
            rows.append((k, " ".join(words).upper() if rnd.random() < 0.2 else "\t".join(words)))
            k += 1
    return [*rows, (k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "a b"), (k + 4, "A  B"), (k + 5, "a\xa0b")]


def test_against_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == brute(rows)


def test_other_threshold_and_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 3)
    monkeypatch.setattr(ngram_join, "FLUSH", 2000)
    rows = corpus(4)
    assert found(spark, rows, 5, 80) == brute(rows, 5, 80)


@pytest.mark.parametrize("bounds", [{"BLOCK_SHINGLES": 150}, {"BLOCK_ROWS": 3, "TILE": 2, "COLUMNS": 3, "PAIRS": 2, "QUERY_PARTS": 0}, {"BLOCK_ROWS": 2, "BUCKET": 50, "PARTITIONS": 1, "QUERY_PARTS": 1}])
def test_blocks_dealt_into_parts(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(2)
    assert found(spark, rows) == brute(rows)


def test_classes_of_sets():
    """Products in tiles against pairs, with shingles that few and that many rows have."""
    rnd = np.random.default_rng(3)
    base = np.unique(rnd.integers(0, 1 << 62, 60).astype(np.uint64))
    sets = []
    for i in range(700):
        kept = base[rnd.random(len(base)) > (0.02 if i % 3 else 0.3)]
        sets.append(np.unique(np.append(kept, rnd.integers(0, 1 << 62, rnd.integers(0, 5)).astype(np.uint64))))
    a, b = (ngram_join.Tile(x) for x in (sets[:300], sets[300:]))
    expected = np.array([[len(np.intersect1d(x, y)) for y in sets[300:340]] for x in sets[:40]])
    assert (ngram_join.overlaps(a, b)[:40, :40] == expected).all()
    got, root = ngram_join.classes(sets, 90), list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            o = len(np.intersect1d(x, sets[j], assume_unique=True))
            if 100 * o >= 90 * (len(x) + len(sets[j]) - o) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert got.tolist() == root


def test_many_short_near_copies_fit_in_memory():
    """20,000 sets of 20 shingles of one template, in one process of bounded memory."""
    code = """
import resource, sys
import numpy as np, pyarrow as pa
from textbayes.llm import ngram_join as N
rnd = np.random.default_rng(0)
base = np.arange(1, 25, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
sets = [np.unique(rnd.choice(base, 20, replace=False)).tobytes() for _ in range(20_000)]
part = pa.RecordBatch.from_pydict({"block": [1] * 20_000, "part": [0] * 20_000, "node": list(range(20_000)), "shingles": sets})
links = sum(b.num_rows for b in N._square(90)(part.slice(i, 1000) for i in range(0, 20_000, 1000)))
print(links, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    links, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=root, env=os.environ | {"PYTHONPATH": root}).stdout.split())
    assert links > 19_000 and mb < 1000


def test_whole_table(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(path).select("doc_id", "text").collect()]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(spark.read.parquet(path)).collect()}
    assert out == brute(rows)


def test_empty_nulls_and_repeats(spark):
    assert found(spark, []) == {}
    df = spark.createDataFrame([(None, "a b c d", "x"), (3, "a b c d", "x"), (3, "a b c d", "x"), (5, "a b c d", "y")], SCHEMA)
    out = sorted(((r.doc_id or -1, r.component_id, r.n_same) for r in ngram_jaccard_join(df).collect()), key=str)
    assert out == sorted([(-1, None, 1), (3, 3, 3), (3, 3, 3), (5, 3, 3)], key=str)
    assert sorted((r.doc_id or -1) for r in keep_one(df).collect()) == [-1, 3]
