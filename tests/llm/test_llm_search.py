"""Exact top-k search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tapewatch.llm import topk
from tapewatch.session import stage


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, is_query, k=10):
    size = max((len(v) for _, v in rows), default=0)
    data = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v] + [0] * (size - len(v))) for i, v in rows]
    want = []
    for q, a in data:
        if is_query(q):
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in data if i != q)[:k]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(want)


def answers(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties"])
def test_top_k_is_exact(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "GROUP", 3)
    monkeypatch.setattr(topk, "BUCKET", 3)
    monkeypatch.setattr(topk, "HELD", 50)
    monkeypatch.setattr(topk, "PIVOTS", 7)
    rng = np.random.default_rng(3)
    n = 700
    if kind == "clusters":
        x = rng.normal(size=(9, 16))[rng.integers(0, 9, n)] + 0.1 * rng.normal(size=(n, 16))
    elif kind == "noise":
        x = rng.normal(size=(n, 16)) * rng.exponential(size=(n, 1))
    else:
        x = np.where(np.arange(n)[:, None] % 3 == 0, 0.5, rng.integers(-1, 2, (n, 16)).astype(float))
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got = answers(topk.top_k(table(spark, [(i, v, 0) for i, v in rows]), F.col("vec_id") % 50 == 0))
    assert got == brute(rows, lambda q: q % 50 == 0)


def test_equal_vectors_are_spread_over_buckets(spark, monkeypatch):
    """A third of all rows in one annulus: its blocks lie in many buckets, and none of its keys holds more than a few."""
    monkeypatch.setattr(topk, "BLOCK", 20)
    monkeypatch.setattr(topk, "BUCKET", 2)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 6)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table_ = stage(table(spark, [(i, v, 0) for i, v in rows]))
    assert answers(topk.top_k(table_, F.col("vec_id") % 100 == 0)) == brute(rows, lambda q: q % 100 == 0)
    vectors = topk.numbered(table_.mapInArrow(topk._quantise(1024), "vec_id long, v binary, norm double, peak double, size int"))
    geometry = topk.Geometry(topk.choose_pivots(np.floor(1024 * x[:50].astype(float)), 8), float((np.floor(1024 * x.astype(float))**2).sum(axis=1).max()))
    index, annuli = topk.build_index(vectors.select("vec_id", "v", "rid"), geometry)
    sizes = index.groupBy("bucket").agg(F.sum(F.length("ids") / 8).alias("n"), F.count("*").alias("blocks")).collect()
    assert sum(r.n for r in sizes) == 1500 and max(r.n for r in sizes) < 150 and max(r.blocks for r in sizes) <= 2
    assert max(a.n for a in annuli) >= 500


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.5, -1.0]), (1, [3.0]), (2, []), (3, [2.0, 2.0]), (3, [2.0, 2.0]), (200, [1.0, 1.0])]
    odd = [(4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [9.0, 9.0])]
    df = table(spark, [(i, v, None) for i, v in [*rows, *odd]]).withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    assert answers(topk.top_k(df, F.col("vec_id") % 100 == 0)) == brute(rows, lambda q: q % 100 == 0)


def test_large_components_stay_exact():
    q, x = np.array([[2.0**40, 1.0], [2.0**52, 2.0**52]]), np.array([[2.0**20, 3.0], [2.0**62, 0.0]])
    assert topk.scores(q, x).tolist() == [[2**60 + 3, 2**63 - 1], [2**63 - 1, 2**63 - 1]]


def test_components_whose_squares_overflow(spark):
    """A huge component takes nothing from the answers between small vectors; products beyond a long tie."""
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))]
    rows[7] = (7, [1e160, 0.0, 1.0, -1.0])
    rows[250] = (250, [-3e307, 1.7e308, 0.0, 0.0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = np.finfo(float).max
    data = {i: [int(min(max(np.floor(1024.0 * c) if abs(c) < 1e300 else c * np.inf, -most), most)) for c in v] for i, v in rows}
    want = []
    for q in (0, 100, 200):
        score = {i: min(max(sum(a * b for a, b in zip(data[q], v)), -2**63), 2**63 - 1) for i, v in data.items() if i != q}
        want += [(q, n + 1, i, score[i]) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:10])]
    assert answers(topk.top_k(df, F.col("vec_id") % 100 == 0)) == want


def test_few_and_no_vectors(spark):
    assert answers(topk.top_k(table(spark, [(0, [1.0], 1)]), F.col("vec_id") % 100 == 0)) == []
    assert topk.top_k(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_far_annuli_are_skipped():
    """Queries within a tight cluster visit few of the annuli."""
    rng = np.random.default_rng(8)
    centers = np.round(1000 * rng.normal(size=(20, 8)))
    x = np.round(np.repeat(centers, 50, axis=0) + 5 * rng.normal(size=(1000, 8)))
    geometry = topk.Geometry(centers, float((x**2).sum(axis=1).max()))
    d = geometry.of_vectors(x)
    near = d.argmin(axis=1)
    own = d[np.arange(1000), near]
    annuli = [topk.Annulus(p, 0, own[near == p].min(), own[near == p].max(), int((near == p).sum()))
              for p in sorted(set(near.tolist()))]
    q = x[np.argmax((x**2).sum(axis=1))][None, :]
    best = np.sort(topk.scores(q, x)[0])[-10]
    visited = topk.visited(geometry, annuli, q, np.array([best]), 10, False).sum()
    assert 1 <= visited <= 5
