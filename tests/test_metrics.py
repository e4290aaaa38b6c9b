import math
import random
import struct

import numpy as np
import pytest
from helpers import rows, scores
from pyspark.sql import functions as F

from tapewatch.operators import curves, ensemble, explore, metrics, selection
from tapewatch.operators.loco import evaluate_cases, leave_one_case_out, loco_means
from tapewatch.session import stage

SIX = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.4, 1), (0.1, 0)]


def brute_auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(pairs):
    total, result, seen_tp, seen = sum(y for _, y in pairs), 0.0, 0, 0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        tied = [y for t, y in pairs if t == s]
        seen_tp, seen = seen_tp + sum(tied), seen + len(tied)
        result += sum(tied) / total * seen_tp / seen
    return result


def near(points):
    return [tuple(pytest.approx(x) for x in point) for point in points]


def noisy(n, seed, levels):
    rng = random.Random(seed)
    return [(rng.randrange(levels) / levels, int(rng.random() < 0.3)) for _ in range(n)]


@pytest.mark.parametrize("pairs", [SIX, noisy(400, 1, 30), noisy(300, 2, 100_000)])
def test_auc_and_ap_equal_brute_force(spark, pairs):
    df = scores(spark, pairs)
    assert metrics.roc_auc(df, "score").first()[0] == pytest.approx(brute_auc(pairs))
    assert metrics.pr_auc(df, "score").first()[0] == pytest.approx(brute_ap(pairs))


def test_six_rows_by_hand(spark):
    df = scores(spark, SIX)
    curve = curves.score_curve(df, "score", "is_leaked_market")
    assert rows(metrics.roc_points(curve, "score"), "fpr", "tpr") == near([
        (0, 0), (0, 1 / 3), (1 / 3, 1 / 3), (2 / 3, 2 / 3), (2 / 3, 1), (1, 1)])
    assert rows(metrics.pr_points(curve, "score"), "recall", "precision") == near([
        (0, 1), (1 / 3, 1 / 2), (1 / 3, 1), (2 / 3, 1 / 2), (1, 1 / 2), (1, 3 / 5)])
    # The nearest rate to 1 % is 0, first met at the origin.
    assert metrics.recall_at_fpr(df, "score").first()[0] == 0.0
    assert metrics.recall_at_fpr(df, "score", target_fpr=0.3).first()[0] == pytest.approx(1 / 3)


def test_straight_runs_are_left_out(spark):
    df = scores(spark, [(9, 1), (8, 1), (7, 1), (6, 0), (5, 0), (4, 1)])
    points = rows(metrics.roc_points(curves.score_curve(df, "score", "is_leaked_market"), "score"), "fpr", "tpr")
    assert points == near([(0, 0), (0, 0.25), (0, 0.75), (1, 0.75), (1, 1)])


def test_constant_and_one_sided_labels(spark):
    tied = scores(spark, [(0.5, 1), (0.5, 0), (0.5, 0)])
    assert metrics.roc_auc(tied, "score").first()[0] == 0.5
    only = metrics.evaluate_model(scores(spark, [(0.5, 1), (0.4, 1)]), "score").first()
    assert (only.roc_auc, only.pr_auc, only.precision_at_10, only.base_rate) == (None, 1.0, 1.0, 1.0)
    none = metrics.evaluate_model(scores(spark, [(0.5, 0), (0.4, 0)]), "score").first()
    assert (none.roc_auc, none.pr_auc, none.recall_at_1pct_fpr, none.lift_at_10) == (None, None, None, None)


def test_precision_at_k_with_few_rows_and_ties(spark):
    df = scores(spark, [(1.0, 1), (1.0, 0), (0.5, 1)])
    assert rows(metrics.precision_at_k(df, "score", k_values=[1, 2, 10])) == [(1, 1.0), (2, 0.5), (10, pytest.approx(2 / 3))]


def test_rank_with_ties_and_cut(spark):
    df = scores(spark, [(5, 1), (5, 0), (3, 1), (9, 0), (3, 1)])
    ranked = curves.with_rank(df, "score", "rank")
    assert rows(ranked, "taker", "rank") == [("w000", 2), ("w001", 2), ("w002", 4), ("w003", 1), ("w004", 4)]
    assert metrics.precision_rank_cut(ranked, "rank", cut=4).first().precision == 0.75


def test_rank_equals_pandas_with_a_hot_score_in_many_parts(spark):
    rng = random.Random(3)
    pairs = [(0.0 if rng.random() < 0.4 else rng.randrange(900), 0) for _ in range(3000)]
    df = scores(spark, pairs).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = curves.with_rank(df, "score", "rank").toPandas()
        parts = curves.split_by_range(df.select("score").distinct(), "score", [], True)
        assert parts.select("_part").distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (got["rank"] == got["score"].rank(ascending=False, method="min")).all()
    assert len(got) == 3000


def test_many_models_in_one_pass(spark):
    a, b = noisy(200, 5, 40), noisy(150, 6, 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        summary = metrics.model_summary({"a": (scores(spark, a), "score"), "b": (scores(spark, b), "score")}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.model: r for r in summary}
    for name, pairs in (("a", a), ("b", b)):
        assert got[name].roc_auc == pytest.approx(brute_auc(pairs))
        assert got[name].pr_auc == pytest.approx(brute_ap(pairs))
        assert got[name].n_total == len(pairs)


def test_quantiles_equal_numpy(spark):
    rng = random.Random(4)
    x = [rng.choice([0.0, 1.0, rng.gauss(0, 5)]) for _ in range(501)]
    y = [rng.randrange(3) for _ in range(501)]
    df = spark.createDataFrame(list(zip(x, y)) + [(None, 7)], "x double, y int").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {(r.feature, r.prob): r.quantile for r in selection.exact_quantiles(df, ["x", "y"], probs).collect()}
    for p in probs:
        assert got["x", p] == pytest.approx(np.quantile(x, p))
        assert got["y", p] == pytest.approx(np.quantile(y + [7], p))


def test_keys_order_as_doubles_do(spark):
    rng = random.Random(12)
    values = [struct.unpack(">d", rng.randbytes(8))[0] for _ in range(2000)]
    values += [s * 2.0**e * m for s in (1, -1) for e in range(-1074, 1024, 7) for m in (1.0, 1 - 2**-53, 1 + 2**-52)]
    values += [0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 2.0**-1022, 1.7976931348623157e308]
    values = [v for v in values if not math.isnan(v)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", selection.order_key(F.col("v")).alias("k")).collect()
    assert all(selection.value_of(r.k) == r.v for r in got)
    ordered = sorted(got, key=lambda r: r.k)
    assert [r.v for r in ordered] == sorted(values)
    nan = spark.sql("select double('nan') v union all select null").select(selection.order_key(F.col("v")).alias("k")).collect()
    assert {r.k for r in nan} == {None, 0x7FF8000000000000}


def test_quantiles_of_skewed_values(spark, monkeypatch):
    """Heavy tails, ties of a third of all rows, neighbours in the last bit; three reads for any number of places."""
    rng = random.Random(13)
    x = [rng.choice([1.0, rng.lognormvariate(0, 20), -1e-300 * rng.random(), math.nextafter(1.0, 2.0)]) for _ in range(900)]
    df = stage(spark.createDataFrame([(v,) for v in x], "x double").repartition(4), "skewed")
    jobs, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: jobs.append(1) or collect(self))
    probs = [i / 16 for i in range(17)]
    got = {r.prob: r.quantile for r in selection.exact_quantiles(df, ["x"], probs).collect()}
    assert [got[p] for p in probs] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)
    assert len(jobs) == 5  # totals, one per digit, and the one above
    assert selection.exact_quantiles(df.where("false"), ["x"], probs).count() == 0


def test_histogram_equals_numpy(spark):
    rng = random.Random(9)
    values = {0: [rng.uniform(-3, 9) for _ in range(300)], 1: [2.5] * 7}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [(1, None)], "k int, v double")
    got = explore.histogram(df, "v", ["k"], 30).orderBy("k", "bin").collect()
    for k, vs in values.items():
        mine = [r for r in got if r.k == k]
        counts, edges = np.histogram(vs, bins=30)
        density, _ = np.histogram(vs, bins=30, density=True)
        assert [r.n for r in mine] == counts.tolist()
        assert [r.lo for r in mine] == pytest.approx(edges[:-1].tolist())
        assert [r.density for r in mine] == pytest.approx(density.tolist())


def test_histogram_clips(spark):
    df = spark.createDataFrame([(0, -5.0), (0, 1.0), (0, 99.0)], "k int, v double")
    got = explore.histogram(df, "v", ["k"], 4, 0, 4).orderBy("bin").collect()
    assert [r.n for r in got] == [1, 1, 0, 1] and (got[0].lo, got[-1].hi) == (0.0, 4.0)


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2, 5.0), (2.0, 4, 5.0), (3.0, 6, 5.0)], "a double, b int, c double")
    got = {(r.f1, r.f2): r.r for r in explore.feature_corr(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and got["a", "c"] is None and len(got) == 9


def test_describe_equals_pandas(spark):
    rng = random.Random(11)
    df = spark.createDataFrame([(rng.gauss(5, 2), i, "t") for i in range(57)] + [(None, 57, "t")],
                               "x double, y int, z string")
    got = {r.feature: r for r in explore.describe_numeric(df).collect()}
    want = df.drop("z").toPandas().describe()
    assert set(got) == {"x", "y"}
    for f, r in got.items():
        assert [r.n, r.mean, r["std"], r["min"], r.q25, r.q50, r.q75, r["max"]] == pytest.approx(want[f].tolist())


def test_ensemble(spark):
    a = scores(spark, [(1, 1), (3, 0), (2, 1)], "anomaly_score_if").selectExpr("*", "'c' AS case_id")
    b = scores(spark, [(7, 1), (7, 0)], "anomaly_score_ae")
    got = ensemble.ensemble_scores(a, b)
    assert rows(got, "taker", "score_if_norm", "score_ae_norm", "anomaly_score_ensemble", "rank_ensemble") == [
        ("w000", 0.0, 0.0, 0.0, 2), ("w001", 1.0, 0.0, 0.5, 1)]


LOCO = "taker string, is_leaked_market int, case_id string, score double"


def loco_table(seed, n):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        case = rng.choice(["", "", "c1", "c2", "c3"])
        data.append((f"w{i:04d}", 0 if case == "" else 1, case, float(rng.randrange(25))))
    return data + [("mixed", 1, "", 30.0)]


def brute_loco(data, k):
    controls = [r for r in data if r[1] == 0]
    out = []
    for case in sorted({r[2] for r in data if r[1] == 1 and r[2]}):
        universe = [r for r in data if r[2] == case] + controls
        top = sorted(universe, key=lambda r: (-r[3], r[0]))[:k]
        out.append((case, sum(r[1] for r in top) / len(top), brute_auc([(r[3], r[1]) for r in universe])))
    return out


@pytest.mark.parametrize("n,k", [(200, 20), (12, 20), (300, 5)])
def test_loco_equals_brute_force(spark, n, k):
    data = loco_table(n, n)
    got = evaluate_cases(spark.createDataFrame(data, LOCO), "score", k)
    assert rows(got) == [(r[0], pytest.approx(r[1]), pytest.approx(r[2]))
                         for r in brute_loco(data, k)]


def test_loco_trains_once_or_per_case(spark):
    data = loco_table(1, 120)
    table = spark.createDataFrame(data, LOCO)
    calls = []

    def train(rows_in):
        calls.append({r.case_id for r in rows_in.select("case_id").distinct().collect()})
        if "c2" in calls[-1] and len(calls) > 1:
            raise RuntimeError("no luck")
        return rows_in.select("taker", "score")

    once = rows(leave_one_case_out(table, train, "score"))
    assert len(calls) == 1 and [r[0] for r in once] == ["c1", "c2", "c3"]
    failed = []
    each = rows(leave_one_case_out(table, train, "score", refit=True, on_error=lambda c, e: failed.append(c)))
    assert failed == ["c2"]
    assert each == [once[0], ("c2", None, None, "no luck"), once[2]]
    means = loco_means(leave_one_case_out(table, lambda p: p.select("taker", "score"), "score")).first()
    assert means.mean_roc_auc == pytest.approx(sum(r[2] for r in once) / 3)


def test_loco_evaluates_cases_together(spark, monkeypatch):
    """Tables written do not grow with the cases; one whose trainer fails when it runs does not stop the others."""
    from pyspark.sql import functions as F

    from tapewatch.operators import loco
    cases = [f"c{i:02d}" for i in range(12)]
    rng = random.Random(3)
    data = [(f"w{i:03d}", int(i % 2), cases[i // 2 % 12] if i % 2 else "", float(rng.randrange(30))) for i in range(240)]
    table, staged, stage = spark.createDataFrame(data, LOCO), [], loco.stage
    monkeypatch.setattr(loco, "stage", lambda df, name="stage": staged.append(name) or stage(df, name))

    def train(rows_in):
        return rows_in.select("taker", "score")

    once = rows(leave_one_case_out(table, train, "score"))
    staged.clear()
    assert rows(leave_one_case_out(table, train, "score", refit=True)) == once and len(once) == 12
    assert len(staged) < 6
    sampled = rows(leave_one_case_out(table, train, "score", sample=40))
    assert rows(leave_one_case_out(table, train, "score", refit=True, sample=40)) == sampled != once

    def fails_later(rows_in):
        return rows_in.select("taker", F.when(F.col("case_id") == "c07", F.raise_error(F.lit("no luck"))).otherwise(
            F.col("score")).cast("double").alias("score"))

    failed = []
    got = rows(leave_one_case_out(table, fails_later, "score", refit=True, on_error=lambda c, e: failed.append(c)))
    assert failed == ["c07"] and [r[0] for r in got] == cases
    assert [r for r in got if r[0] != "c07"] == [r for r in once if r[0] != "c07"] and got[7][1:3] == (None, None)


def test_wallets_searched_equal_sorted(spark, monkeypatch):
    """Counting controls between the wallets gives what running totals over sorted scores give, also for odd scores."""
    from pyspark.sql import functions as F

    from tapewatch.operators import loco
    rng, nan = random.Random(5), float("nan")
    data = []
    for turn in (3, 0, 7, 9):
        for i in range(60):
            case = rng.choice(["", "", f"c{turn}", f"d{turn}"]) if turn != 7 else f"c{turn}"  # group 7 has no controls
            value = rng.choice([0.0, -0.0, nan, float("inf"), -1.5, 2.25, 1e-300, None, rng.random(), float(rng.randrange(4))])
            data.append((turn, f"w{rng.randrange(50):02d}", rng.randrange(50), 0 if case == "" else 1, case, value))
    data += [(11, "w00", 1, 0, "", 1.0), (9, "w01", 2, 1, "", 5.0), (9, "w02", 3, 1, None, 5.0)]
    table = spark.createDataFrame(data, "turn int, taker string, place long, is_leaked_market int, case_id string, score double")
    for sample in (None, 7):
        for k in (20, 3):
            want = rows(evaluate_cases(table.withColumn("taker", F.lpad("place", 4, "0")) if sample is None else table.withColumn(
                "place", F.substring("taker", 2, 2).cast("long")), "score", k, sample, by=["turn"]))
            given = table if sample is None else table.withColumn("place", F.substring("taker", 2, 2).cast("long"))
            spread = given.repartition(3)
            with monkeypatch.context() as patch:
                patch.setattr(loco, "stage", None)  # nothing is written
                got = rows(evaluate_cases(spread, "score", k, sample, by=["turn"], place="place"))
            assert str(got) == str(want) and len(got) == 7
            with monkeypatch.context() as patch:
                patch.setattr(loco, "SEARCHED", 5)  # too many wallets: sorted as without places
                assert str(rows(evaluate_cases(spread, "score", k, sample, by=["turn"], place="place"))) == str(want)
    whole = spread.withColumn("score", F.col("score").cast("decimal(20,3)")).where("score IS NOT NULL")
    assert rows(evaluate_cases(whole, "score", 20, by=["turn"], place="place")) == rows(
        evaluate_cases(whole.withColumn("score", F.col("score").cast("double")), "score", 20, by=["turn"], place="place"))


def test_loco_turns_go_side_by_side(spark, monkeypatch):
    """Batches of turns keep each to its case, scores are dropped once used, and repeated wallets count as before."""
    import os

    from pyspark.sql import functions as F

    from tapewatch.operators import loco
    from tapewatch.session import application_folder
    monkeypatch.setattr(loco, "TURNS", 2)
    monkeypatch.setattr(loco, "SHARED", 2)
    monkeypatch.setattr(loco, "FILE_ROWS", 50)
    data = loco_table(8, 150)
    data = [(w, y, f"{c}'\"{i % 4}" if c else c, s) for i, (w, y, c, s) in enumerate(data)]
    data += data[:20] + [(None, 0, "", 3.0), (None, 1, "c1'\"0", 9.0), ("none", 1, None, 4.0), ("void", None, "c2'\"1", 4.0)]
    table, seen = spark.createDataFrame(data, LOCO), []

    def train(rows_in):
        seen.append(sorted(map(str, rows_in.collect())))
        return rows_in.dropDuplicates(["taker"]).select("taker", "score")

    once = rows(leave_one_case_out(table, train, "score"))
    cases = sorted({r[2] for r in data if r[1] == 1 and r[2]})
    assert [r[0] for r in once] == cases and len(cases) == 12
    seen.clear()
    staged = set(os.listdir(application_folder(spark)))
    each = rows(leave_one_case_out(table, train, "score", refit=True))
    assert each == once
    assert seen == [sorted(map(str, table.where((F.col("is_leaked_market") == 0) | (F.col("case_id") == c)).collect())) for c in cases]
    new = {name.split("-")[0] for name in os.listdir(application_folder(spark)) if name not in staged}
    assert "scored" not in new and "controls" not in new
    # A score that no double holds, and a table too large to be broadcast.
    monkeypatch.setattr(loco, "is_small", lambda df: False)
    exact = table.withColumn("score", F.col("score").cast("decimal(30,5)"))
    assert rows(leave_one_case_out(exact, lambda p: p.dropDuplicates(["taker"]).select("taker", "score"), "score", refit=True)) == once
