import math
import zlib

import numpy as np

from textbayes.llm import queries, toxicity
from textbayes.llm.boosting import Boosted, Isotonic
from tests.llm import plain


def ranked(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0) | (rng.random(3000) < 0.05)).astype(float)
    model = Boosted(trees=40).fit(x[:2000], y[:2000])
    raw = model.raw(x[2000:])
    assert ranked(y[2000:], raw) > 0.9 and (Boosted(trees=40).fit(x[:2000], y[:2000]).raw(x[2000:]) == raw).all()
    score, label = rng.random(500), (rng.random(500) < 0.4).astype(float)
    iso = Isotonic().fit(score, label)
    assert (np.diff(iso.y) > 0).all() and abs(np.average(iso.y, weights=np.ones(len(iso.y))) - 0.4) < 0.5
    assert (np.diff(iso(np.sort(score))) >= 0).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert len(out) == 10_000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in out.items())
    held = [(t, out[i].score, out[i].predicted) for i, t in labels if out[i].held_out]
    y, s, p = (np.array(c) for c in zip(*held, strict=True))
    print("held out", len(y), "auc", ranked(y, s), "accuracy", (y == p).mean(), "recall", p[y == 1].mean(), "precision", y[p == 1].mean(), "brier", ((s - y) ** 2).mean())
    assert ranked(y, s) > 0.93 and (y == p).mean() > 0.95


def test_odd_rows(spark):
    docs = plain.frame(spark, plain.rows(spark))
    labels = spark.createDataFrame([(1, 0, 1), (2, None, 0), (None, 1, 1), (3, 1, 0), (3, 0, 1)], "doc_id long, toxic int, text int")
    for known in (labels, labels.limit(0)):
        out = toxicity.toxicity(docs, toxicity.fit(docs, known)).collect()
        assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.toxicity(docs.limit(0), toxicity.ToxicityModel()).count() == 0
    kept = toxicity.reject_toxic(docs, toxicity.ToxicityModel(rate=0.2))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_labels_are_not_inputs(spark):
    """The score is a function of the text."""
    model = toxicity.ToxicityModel({b"bad": 4.0}, Boosted(trees=3).fit(np.array([toxicity.features(t, toxicity.Weights({b"bad": 4.0})) for t in [b"you bad thing", b"a fine day"] * 20]), np.array([1.0, 0.0] * 20)), Isotonic().fit(np.array([-1.0, 1.0]), np.array([0.0, 1.0])))
    docs = spark.createDataFrame([(1, "you bad thing"), (7, "you bad thing"), (3, "a fine day")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert s[1] == s[7] > s[3]


def plain_trees(x, y, trees, depth=3, rate=0.15, ridge=1.0, leaf=2.0):
    """Boosted trees once more, split by split, row by row; returns a function of a row."""
    cuts = [sorted({*np.quantile(c, np.arange(1, 32) / 32).tolist(), float(np.nextafter(c.min(), np.inf))}) for c in x.T]
    binned = lambda row: [sum(c <= v for c in cut) for cut, v in zip(cuts, row, strict=True)]
    b, base = [binned(row) for row in x], math.log(y.mean() / (1 - y.mean()))
    raw, grown = [base] * len(y), []

    def grow(rows, g, h, level):
        sums = lambda r: (sum(g[i] for i in r), sum(h[i] for i in r))
        value = lambda s: s[0] ** 2 / (s[1] + ridge)
        if level == depth:
            s = sums(rows)
            return rate * s[0] / (s[1] + ridge)
        best = (1e-9, None, None)
        for j in range(x.shape[1]):
            for c in range(32):
                left, right = [i for i in rows if b[i][j] <= c], [i for i in rows if b[i][j] > c]
                a, z = sums(left), sums(right)
                if left and right and a[1] >= leaf and z[1] >= leaf and value(a) + value(z) - value(sums(rows)) > best[0] + 1e-12:
                    best = (value(a) + value(z) - value(sums(rows)), j, c)
        if best[1] is None:
            return (0, 99, grow(rows, g, h, level + 1), 0.0)
        _, j, c = best
        return (j, c, grow([i for i in rows if b[i][j] <= c], g, h, level + 1), grow([i for i in rows if b[i][j] > c], g, h, level + 1))

    def walk(tree, bins):
        while isinstance(tree, tuple):
            tree = tree[2] if bins[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        grown.append(grow(range(len(y)), [a - q for a, q in zip(y, p, strict=True)], [q * (1 - q) for q in p], 0))
        raw = [r + walk(grown[-1], bins) for r, bins in zip(raw, b, strict=True)]
    return lambda row: base + sum(walk(t, binned(row)) for t in grown)


def test_trees_and_calibration_against_plain_versions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 3)).round(1)
    y = ((x[:, 0] + x[:, 1] ** 2 + rng.normal(size=160) / 3) > 0.8).astype(float)
    new = rng.normal(size=(50, 3))
    plain_ = plain_trees(x, y, 4)
    assert np.allclose(Boosted(trees=4).fit(x, y).raw(new), [plain_(row) for row in new], atol=1e-9)
    score = rng.permutation(120).astype(float)
    label = (rng.random(120) < 0.2 + score / 200).astype(float)
    iso, at = Isotonic().fit(score, label), label[np.argsort(score)]
    # the least of the means that end later, the greatest of those that begin earlier
    fitted = [max(min(at[a : b + 1].mean() for b in range(i, 120)) for a in range(i + 1)) for i in range(120)]
    assert np.allclose(sorted(set(np.round(fitted, 9))), np.round(iso.y, 9))
