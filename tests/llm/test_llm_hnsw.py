"""Nearest neighbours by graph search: recall, exact scores and defined results."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tapewatch.llm import hnsw
from tapewatch.llm.common import read_table

SF = "/root/testdata/sf0.01"


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def brute(rows, every=50, k=5):
    size = max((len(v) for _, v in rows), default=0)
    x = np.array([list(v) + [0.0] * (size - len(v)) for _, v in rows], np.float64)
    unit = x / np.sqrt((x**2).sum(axis=1))[:, None]
    ids = np.array([i for i, _ in rows])
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        score = unit @ unit[at]
        best = [j for j in np.lexsort((ids, -score.round(12))) if ids[j] != ids[at]][:k]
        out[int(ids[at])] = [(int(ids[j]), float(score[j])) for j in best]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        found = out.setdefault(r.query_id, [])
        assert r["rank"] == len(found) + 1
        found.append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum((Counter(i for i, _ in got.get(q, [])) & Counter(i for i, _ in near)).total() for q, near in want.items())
    return hits / sum(map(len, want.values()))


def clusters(rng, n, spread):
    return rng.normal(size=(40, 24))[rng.integers(0, 40, n)] + spread * rng.normal(size=(n, 24))


def test_query_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, SF, "embeddings").collect()]
    got, want = answers(hnsw.op13_hnsw(spark, SF)), brute(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95
    at = {i: np.array(v, np.float64) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (-p[1], p[0])) and len(near) == 5
        for i, score in near:
            assert score == pytest.approx(at[q] @ at[i] / np.linalg.norm(at[q]) / np.linalg.norm(at[i]), abs=1e-14)


@pytest.mark.parametrize("spread", [0.01, 0.3, 5.0])
def test_recall_over_several_shards(spark, monkeypatch, spread):
    monkeypatch.setattr(hnsw, "SHARD_LEAST", 400)
    monkeypatch.setattr(hnsw, "ROOTS", 4)
    x = clusters(np.random.default_rng(1), 3000, spread)
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    assert recall(answers(hnsw.nearest_neighbours(table(spark, rows), F.col("vec_id") % 50 == 0)), brute(rows)) >= 0.95


def test_recall_in_one_large_shard():
    rng = np.random.default_rng(6)
    x = hnsw.unit(clusters(rng, 6000, 0.5)).astype(np.float32)
    levels = -np.sort(-np.floor(rng.exponential(1 / np.log(16), len(x))).astype(np.int32))
    near = hnsw.Graph.build(x, levels).search(x[:200])
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(near.tolist(), best.tolist())]) >= 0.95


@pytest.mark.parametrize("spread", [1e-4, 1.0])
def test_all_nodes_are_reached(spread):
    rng = np.random.default_rng(3)
    x = hnsw.unit(clusters(rng, 2000, spread)).astype(np.float32)
    links, choice = hnsw.linked(x, 2 * hnsw.LINKS)
    links = hnsw.connect(links, choice)
    reached = np.zeros(len(x), bool)
    hnsw.reached_from(links, 0, reached)
    assert reached.all() and links.shape == (2000, 2 * hnsw.LINKS + hnsw.SPARE)
    # Nodes that nothing leads to are put into the list of an earlier one, also when near ones are full.
    alone = hnsw.connect(np.full((40, 2), -1, np.int32), np.zeros((40, 1), np.int32))
    reached = np.zeros(40, bool)
    hnsw.reached_from(alone, 0, reached)
    assert reached.all()


def test_copies_of_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_LEAST", 200)
    monkeypatch.setattr(hnsw, "ROOTS", 1)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (100, x[1].tolist())]
    got = answers(hnsw.nearest_neighbours(table(spark, rows), (F.col("vec_id") % 50 == 0) & (F.col("vec_id") != 100) & (F.col("vec_id") > 0)))
    want = {q: near for q, near in brute(rows).items() if q not in (0, 100)}
    assert got.keys() == want.keys() and recall(got, want) >= 0.99
    assert [i for i, _ in got[150]] == [0, 0, 3, 6, 9]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, -1.0]), (1, [3.0]), (3, [2.0, 2.0]), (3, [2.0, 2.0]), (100, [1e200, 1e200]),
            (4, [1e-200, 2e-200]), (5, [-1.0, -2.0]), (6, [3.0, 6.0]), (7, [2.0, -4.0])]
    odd = [(8, None), (9, [1.0, None]), (10, [float("nan"), 1.0]), (11, [float("inf"), 1.0]), (None, [9.0, 9.0]), (12, []),
           (13, [0.0, -0.0])]
    df = table(spark, rows + odd, "double").withColumns({c: F.lit("clash") for c in "v rid shard node ids score unit".split()})
    got = answers(hnsw.nearest_neighbours(df, F.col("vec_id") % 50 == 0))
    scaled = [(i, (np.array(v) / max(map(abs, v))).tolist()) for i, v in rows]
    want = brute(scaled)
    assert got.keys() == want.keys()
    for q in got:
        # Multiples of one vector tie but for rounding.
        assert [i for i, _ in sorted(got[q], key=lambda p: (-round(p[1], 12), p[0]))] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def test_few_and_no_vectors(spark):
    assert answers(hnsw.nearest_neighbours(table(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0)) == {}
    assert answers(hnsw.nearest_neighbours(table(spark, [(0, [1.0]), (1, [2.0])]), F.col("vec_id") % 50 == 0)) == {0: [(1, 1.0)]}
    assert hnsw.nearest_neighbours(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert hnsw.nearest_neighbours(table(spark, [(1, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
