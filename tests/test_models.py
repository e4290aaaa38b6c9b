import random

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tapewatch.constants import MODEL_FEATURES
from tapewatch.operators import autoencoder, iforest, linear, sampling, scaling
from tapewatch.session import stage

SCHEMA = "taker string, is_leaked_market int, case_id string, " + ", ".join(f"{f} double" for f in MODEL_FEATURES)


def wallets(spark, controls=400, leaked=40, outliers=6, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(controls + leaked + outliers, len(MODEL_FEATURES)))
    base[:, 3] = 2 * base[:, 0] + 0.1 * base[:, 1]
    base[controls + leaked:] += rng.choice([-9, 9], size=(outliers, len(MODEL_FEATURES)))
    data = [(f"w{i:05d}", int(i >= controls), "c" if i >= controls else "", *map(float, x)) for i, x in enumerate(base)]
    return spark.createDataFrame(data, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def scaled(spark):
    from tapewatch.session import stage
    return stage(scaling.scale_features(wallets(spark)), "test")


def test_scaler_fits_controls_only(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 3.0, 5.0), (1, 100.0, 7.0)], "is_leaked_market int, a double, b double")
    got = scaling.scale_features(df, ["a", "b"], keep=("is_leaked_market",))
    assert rows(got) == [(0, -1.0, 0.0), (0, 1.0, 0.0), (1, 98.0, 2.0)]


def test_split_and_sample_repeat(spark):
    df = wallets(spark, controls=2000, leaked=10)
    split = sampling.split_controls(df)
    share = split.agg(F.avg(F.col("is_validation").cast("int"))).first()[0]
    assert split.count() == 2000 and 0.16 < share < 0.24
    a = rows(sampling.sample_controls(df, 50), "taker", "is_leaked_market")
    assert len(a) == 50 and a == rows(sampling.sample_controls(df.repartition(7), 50), "taker", "is_leaked_market")
    import hashlib
    least = sorted((f"w{i:05d}" for i in range(2000)), key=lambda w: hashlib.md5(f"42-{w}".encode()).hexdigest())[:50]
    assert [r[0] for r in a] == sorted(least)
    assert sampling.sample_controls(df, 3000).count() == sampling.sample_controls(df, None).count() == 2000
    assert [sampling.sample_controls(df, n, seed=s).count() for n in (1, 2) for s in range(6)] == [1] * 6 + [2] * 6
    assert sampling.sample_controls(df, 50, seed=7).join(sampling.sample_controls(df, 50), "taker").count() < 20


@pytest.mark.parametrize("n", [100, 900, 5000, 400_000])
def test_every_tree_gets_enough_rows(spark, n):
    df = spark.range(n).select(F.concat(F.lit("w"), F.col("id")).alias("taker"), F.rand(1).alias("x"))
    sizes = [r["count"] for r in iforest.tree_samples(df, n, ["x"], trees=40, rows=64).groupBy("tree").count().collect()]
    assert len(sizes) == 40 and min(sizes) >= min(n, 64) and max(sizes) < 2 * iforest.OVERSAMPLE * 64


def test_mean_path():
    assert iforest.mean_path([0, 1, 2]).tolist() == [0, 0, 1]
    assert iforest.mean_path(256) == pytest.approx(10.24, abs=0.01)


def test_tree_isolates_every_row_when_deep_enough():
    x = np.arange(16.0).reshape(-1, 1)
    nodes = iforest.grow_tree(x, np.random.default_rng(0), 15)
    leaves = [n for n in nodes if n[1] < 0]
    assert len(leaves) == 16 and all(n[5] == 1 for n in leaves)
    assert len(iforest.grow_tree(np.ones((9, 2)), np.random.default_rng(0), 8)) == 1


def test_forest_repeats_and_finds_planted_outliers(spark, scaled):
    nodes = iforest.fit_forest(scaled, trees=60)
    assert rows(nodes) == rows(iforest.fit_forest(scaled.repartition(3), trees=60))
    assert nodes.agg(F.max("depth")).first()[0] <= 8 and nodes.where("node = 0").agg(F.max("rows")).first()[0] == 256
    raw = iforest.raw_scores(scaled, nodes)
    low, high = raw.agg(F.min("if_raw"), F.max("if_raw")).first()
    assert 0 < low < high <= 1
    got = iforest.score_forest(scaled, nodes).orderBy("rank_if").limit(6)
    assert {r.taker for r in got.collect()} == {f"w{i:05d}" for i in range(440, 446)}


def test_about_one_percent_of_controls_are_flagged(spark, scaled):
    nodes = iforest.fit_forest(scaled, trees=60)
    flagged = iforest.score_forest(scaled, nodes).where("is_leaked_market = 0 and anomaly_score_if > 0").count()
    assert flagged == 4


def test_path_length_by_hand():
    import pandas as pd
    nodes = pd.DataFrame([(0, 0, 0, 0.5, 1, 2, 3, 0), (0, 1, -1, 0.0, -1, -1, 1, 1), (0, 2, -1, 0.0, -1, -1, 2, 1)],
                         columns="tree node feature cut left right rows depth".split())
    got = iforest.Forest(nodes).score(np.array([[0.2], [0.9]]))
    norm = iforest.mean_path(3)
    assert got == pytest.approx([2 ** (-1 / norm), 2 ** (-2 / norm)])


def test_gradient_equals_differences():
    net = autoencoder.Network(3, [4, 3, 2, 3, 4])
    net_code = net.code
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(5, 3)), net.initial(1)

    class NoDropout:
        def random(self, shape):
            return np.ones(shape)

    keep = autoencoder.DROPOUT
    autoencoder.DROPOUT = 0.0
    try:
        grad = net.gradient(w, x, NoDropout())
    finally:
        autoencoder.DROPOUT = keep
    assert net_code == 2
    for i in rng.choice(net.size, 12, replace=False):
        up, down = w.copy(), w.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        loss = [((net.forward(v, x) - x) ** 2).mean() for v in (up, down)]
        assert grad[i] == pytest.approx((loss[0] - loss[1]) / 2e-6, abs=1e-6)


def test_network_size():
    assert autoencoder.Network(10).size == 6618


def test_autoencoder_learns_and_repeats(spark, scaled):
    model = autoencoder.fit_autoencoder(scaled, epochs=12)
    assert model.epochs == [5, 10, 12] and model.history[-1] < model.history[0]
    again = autoencoder.fit_autoencoder(scaled, epochs=12)
    assert again.history == model.history
    errors = autoencoder.reconstruction_error(scaled, model.weights)
    top = errors.orderBy(F.desc("anomaly_score_ae")).limit(6).select("taker").collect()
    assert {r.taker for r in top} == {f"w{i:05d}" for i in range(440, 446)}


def test_autoencoder_in_several_tasks(spark, scaled, monkeypatch):
    model = autoencoder.fit_autoencoder(scaled, epochs=8, tasks=6, local_epochs=2)
    assert model.epochs == [2, 4, 6, 8] and model.history[-1] < model.history[0]
    monkeypatch.setattr(autoencoder, "MERGED_STATES", 2)
    merged = autoencoder.fit_autoencoder(scaled, epochs=8, tasks=6, local_epochs=2)
    assert merged.history == pytest.approx(model.history)
    assert np.allclose(merged.weights, model.weights)


@pytest.mark.parametrize("batch", [7, 200_000])
def test_epochs_mean_the_same_however_rows_arrive(spark, scaled, batch):
    """Weights don't depend on how many rows go to Python at a time, and each epoch passes over all rows once."""
    want = autoencoder.fit_autoencoder(scaled, epochs=6, local_epochs=3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = autoencoder.fit_autoencoder(scaled, epochs=6, local_epochs=3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert (got.weights == want.weights).all() and got.history == want.history


def test_mini_batches_stay_within_an_epoch():
    import pyarrow as pa
    x = np.arange(23.0)
    epoch, check = np.repeat([0, 1], [13, 10]).astype(np.int32), np.arange(23) % 6 == 5
    for size in (1, 4, 23):
        batches = [pa.RecordBatch.from_arrays([pa.array(v[i:i + size]) for v in (x, check, epoch)],
                                              ["x", "is_validation", "epoch"]) for i in range(0, 23, size)]
        got = list(autoencoder._portions(iter(batches), ["x"], 4))
        assert [p[:, 0].tolist() for held, p in got if not held] == [
            [0, 1, 2, 3], [4, 6, 7, 8], [9, 10, 12], [13, 14, 15, 16], [18, 19, 20, 21], [22]]
        assert [p[:, 0].tolist() for held, p in got if held] == [[5, 11, 17]]


def test_saved_models_score_alike(spark, tmp_path):
    profiles = wallets(spark, controls=300, leaked=20, outliers=2)
    path = str(tmp_path / "forest")
    first = rows(iforest.run_isolation_forest(profiles, path, trees=20))
    assert rows(iforest.score_saved_forest(profiles, path)) == first
    # Scaler and threshold are the saved ones, also for a table without controls.
    some = profiles.where("is_leaked_market = 1")
    assert rows(iforest.score_saved_forest(some, path), "taker", "anomaly_score_if") == sorted(
        (r[0], r[3]) for r in first if r[1] == 1)
    path = str(tmp_path / "autoencoder")
    first = rows(autoencoder.run_autoencoder(profiles, path, epochs=2))
    assert rows(autoencoder.score_saved_autoencoder(profiles, path)) == first
    assert rows(spark.read.parquet(path + "/history"), "epoch", "learning_rate") == [(2, 0.001)]


def test_loco_with_a_model(spark):
    from tapewatch.operators.loco import leave_one_case_out
    profiles = wallets(spark, controls=300, leaked=0, outliers=12)
    got = leave_one_case_out(profiles, lambda p: iforest.run_isolation_forest(p, trees=20), "anomaly_score_if")
    row = got.first()
    assert row.case_id == "c" and row.roc_auc > 0.99 and row.precision_at_20 == 0.6


def test_early_stop(spark, scaled, monkeypatch):
    monkeypatch.setattr(autoencoder, "LEARNING_RATE", 0.0)
    monkeypatch.setattr(autoencoder, "PATIENCE", 3)
    model = autoencoder.fit_autoencoder(scaled, epochs=30, local_epochs=1)
    assert len(model.history) == 4 and len(set(model.history)) == 1


def test_no_controls(spark, scaled):
    with pytest.raises(ValueError):
        autoencoder.fit_autoencoder(scaled.where("is_leaked_market = 1"), epochs=1)


def test_forests_of_all_cases_equal_the_loop(spark):
    from tapewatch.operators.loco import leave_one_case_out, leave_one_case_out_forests
    profiles = wallets(spark, controls=300, leaked=40, outliers=9).withColumn(
        "case_id", F.when(F.col("is_leaked_market") == 1, F.concat(F.lit("c"), F.pmod(F.xxhash64("taker"), F.lit(3)).cast("string"))).otherwise(""))
    loop = leave_one_case_out(profiles, lambda p: iforest.run_isolation_forest(p, trees=25), "anomaly_score_if", refit=True)
    want = {r.case_id: (r.precision_at_20, r.roc_auc) for r in loop.collect()}
    got = {r.case_id: (r.precision_at_20, r.roc_auc) for r in leave_one_case_out_forests(profiles, trees=25).collect()}
    assert got.keys() == want.keys() == {"c0", "c1", "c2"}
    for case in want:
        assert got[case] == pytest.approx(want[case])
    assert leave_one_case_out_forests(profiles.where("is_leaked_market = 0"), trees=5).count() == 0


def test_forests_leave_rows_out(spark, scaled, monkeypatch):
    """Each turn's forest is the one grown without the rows that are tagged with it."""
    tags = F.when(F.col("taker") < "w00150", F.array(F.lit("a"))).when(F.col("taker") > "w00380", F.array(F.lit("a"), F.lit("b")))
    tagged = stage(scaled.withColumn("left_out", tags))
    nodes = iforest.fit_forests(tagged, ["a", "b", "c"], "left_out", trees=12)
    columns = [c for c in nodes.columns if c != "turn"]
    for turn in "abc":
        kept = tagged.where(~F.coalesce(F.array_contains("left_out", turn), F.lit(False)))
        assert rows(nodes.where(F.col("turn") == turn).select(columns)) == rows(iforest.fit_forest(kept, trees=12))
    monkeypatch.setattr(iforest, "PORTION", 50)
    table = scaled.withColumn("turn", F.lit("c"))
    got = iforest.score_turns(table, nodes)
    want = iforest.raw_scores(scaled, nodes.where("turn = 'c'").drop("turn"))
    assert dict(rows(got, "taker", "if_raw")) == pytest.approx(dict(rows(want, "taker", "if_raw")))


def test_linear_error(spark, tmp_path):
    profiles = wallets(spark, controls=300, leaked=20, outliers=4)
    scaled = iforest.model_input(profiles)
    matrix = linear.second_moments(scaled)
    data = np.array([list(r) for r in scaled.where("is_leaked_market = 0").select(*MODEL_FEATURES).collect()])
    assert matrix == pytest.approx(data.T @ data / len(data))
    for count in (1, 5, 10):
        d = linear.main_directions(matrix, count)
        assert d @ d.T == pytest.approx(np.eye(count), abs=1e-12)
        got = linear.linear_error(scaled, d).where("is_leaked_market = 0").select("anomaly_score_linear").collect()
        left = data - data @ d.T @ d
        assert sorted(r[0] for r in got) == pytest.approx(sorted((left**2).mean(axis=1)), abs=1e-12)
        # What is left is the trace without the eigenvalues of the directions.
        assert np.mean([r[0] for r in got]) * 10 == pytest.approx(np.trace(matrix) - np.linalg.eigvalsh(matrix)[::-1][:count].sum(), abs=1e-9)
    path = str(tmp_path / "linear")
    first = rows(linear.run_linear(profiles, path))
    assert rows(linear.score_saved_linear(profiles, path)) == first and len(first) == profiles.count()
    with pytest.raises(ValueError):
        linear.second_moments(scaled.where("is_leaked_market = 1"))


def test_controls_are_scored_once_per_different_forest(spark, monkeypatch):
    from tapewatch.operators import loco
    profiles = wallets(spark, controls=300, leaked=40, outliers=9).withColumn(
        "case_id", F.when(F.col("is_leaked_market") == 1, F.concat(F.lit("c"), F.pmod(F.xxhash64("taker"), F.lit(3)).cast("string"))).otherwise(""))
    scored, score = [], loco.score_turns
    monkeypatch.setattr(loco, "score_turns", lambda rows_in, *args, **more: scored.append(rows_in.count()) or score(rows_in, *args, **more))
    assert loco.leave_one_case_out_forests(profiles, trees=5).count() == 3
    assert scored == [profiles.count()]


def test_turns_share_the_trees_of_the_same_rows(spark, scaled, monkeypatch):
    monkeypatch.setattr(iforest, "TURNS_PER_TASK", 1)
    tags = F.when(F.col("taker") < "w00150", F.array(F.lit("b"), F.lit("d")))
    grown = stage(iforest.fit_turns(stage(scaled.withColumn("left_out", tags)), ["a", "b", "c", "d"], "left_out", trees=6))
    forests, nodes = iforest.distinct_forests(grown)
    of = dict(rows(forests, "turn", "forest"))
    assert of["a"] == of["c"] != of["b"] == of["d"] and nodes.select("forest").distinct().count() == 2
    whole = rows(iforest.fit_forest(scaled, trees=6))
    assert rows(nodes.where(F.col("forest") == of["a"]).drop("forest")) == whole
