"""Embedding whitening against plain linear algebra on all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tapewatch.llm import whitening as wh
from tapewatch.llm.common import read_table

SF = "/root/testdata/sf0.001"


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def brute(rows, count=8):
    """Exact deviations by integers; components of the covariance of all rows, copies and all."""
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * c - s) / n for c, s in zip(line, sums)] for line in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(line, sums)) for line in x]
    return n, deviation, centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check(got, rows, count=8):
    n, deviation, white, explained = brute(rows, count)
    lines = {}
    for r in got:
        lines.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(got) == len(rows) * white.shape[1]
    at = {(i, d): k for k, ((i, _), d) in enumerate(zip(rows, deviation))}
    signs = {}
    for found, of in lines.items():
        for c, copies in of.items():
            for r in copies:
                assert r.n == n and r.identity_error < 1e-9
                want = white[at[found], c - 1]
                signs.setdefault(c, np.sign(want * r.whitened))
                assert r.whitened * signs[c] == pytest.approx(want, abs=1e-9)
                assert r.explained == pytest.approx(explained[c - 1], rel=1e-9)


def test_query_against_all_rows(spark):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in read_table(spark, SF, "embeddings").collect()]
    check(wh.op12_embedding_whitening(spark, SF).collect(), rows)


def test_copies_count_as_often_as_they_occur(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 12)).astype(np.float32).astype(float)
    rows = [(i, x[0 if i % 3 == 0 else i % 60].tolist()) for i in range(600)] + [(7, x[7].tolist())] * 2
    df = table(spark, rows).withColumns({c: F.lit("clash") for c in ("x", "w", "rows", "white", "deviation", "n", "at")})
    check(wh.whiten(df.repartition(7)).collect(), rows)


def test_weight_one_fits_each_vector_once(spark):
    x = [[1.0, 2.0, 0.5], [0.0, 1.0, -1.0], [3.0, -1.0, 0.0], [1.5, 1.0, 1.0]]
    once = {(r.component, r.whitened, r.n) for r in wh.whiten(table(spark, list(enumerate(x)))).collect()}
    many = wh.whiten(table(spark, [(i % 4, x[i % 4]) for i in range(9)]), weights="one").collect()
    assert len(many) == 27
    assert {(c, round(w, 9), n) for c, w, n in once} == {(r.component, round(r.whitened, 9), r.n) for r in many}
    with pytest.raises(ValueError):
        wh.whiten(table(spark, []), weights="two")


def test_large_mean_and_small_spread_stay_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (1e6 + rng.normal(size=5)).tolist()) for i in range(200)]
    check(wh.whiten(table(spark, rows, "double")).collect(), rows)


def test_odd_vectors(spark):
    good = [(1, [1.0, 2.0, 0.0]), (2, [0.0, 1.0, 3.0]), (None, [2.0, 2.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 0.0, 0.0])]
    short = [(1, [1.0, 2.0]), (2, [0.0, 1.0, 3.0]), (None, [2.0, 2.0, 1.0]), (4, [1.0]), (5, [])]
    odd = [(6, None), (7, [1.0, None, 1.0]), (8, [float("nan"), 1.0, 1.0]), (9, [float("-inf"), 1.0, 1.0])]
    check(wh.whiten(table(spark, short + odd)).collect(), good)
    assert wh.whiten(table(spark, odd)).count() == 0
    assert wh.whiten(table(spark, [(1, [])])).count() == 0


def test_components_without_spread(spark):
    flat = wh.whiten(table(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [3.0, 5.0])])).collect()
    assert sorted({(r.component, r.whitened is None, round(r.explained, 9)) for r in flat}) == [(1, False, 1.0), (2, True, 0.0)]
    same = wh.whiten(table(spark, [(1, [1.0, 5.0]), (1, [1.0, 5.0])])).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation, r.n) for r in same} == {(None, None, None, 0, 2)}
    assert len(same) == 4


def test_huge_entries_stay_exact(spark):
    rows = [(1, [1e14, 0.0]), (2, [0.0, 1.0]), (3, [-1e14, 2.0])]
    got = wh.whiten(table(spark, rows, "double")).collect()
    assert {r.vec_id: r.deviation for r in got}[2] < 2**63 - 1 and {r.vec_id: r.deviation for r in got}[1] == 2**63 - 1
    assert wh.whiten(table(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0])], "double")).count() == 4
