"""Isolation forest: trees grown in parallel on small samples, then applied to every row."""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.constants import LABEL, MODEL_FEATURES
from tapewatch.operators.curves import with_rank
from tapewatch.operators.sampling import SEED
from tapewatch.operators.scaling import fit_scaler, is_control, model_input
from tapewatch.operators.selection import exact_quantiles
from tapewatch.session import stage

# Trees, rows per tree, share of training rows taken as anomalous.
TREES = 300
SAMPLE_ROWS = 256
CONTAMINATION = 0.01

NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, rows int, depth int"
_NODE_COLUMNS = [part.split()[0] for part in NODE_SCHEMA.split(", ")]
OVERSAMPLE = 4
# Turns whose trees of one number are grown by one task.
TURNS_PER_TASK = 500
# Rows that a task scores under one of several forests.
PORTION = 100_000

# Workers get the functions of this module with the task, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    grown = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, grown, np.where(n == 2, 1.0, 0.0))


def _unit(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the hash of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _shares(n: int, trees: int, rows: int) -> tuple[float, float]:
    """Which rows are looked at, and which of them a tree takes, so that it gets about `OVERSAMPLE` times its rows."""
    coarse = min(1.0, trees * OVERSAMPLE * rows / max(n, 1))
    return coarse, min(1.0, OVERSAMPLE * rows / max(n, 1) / coarse)


def tree_samples(controls: DataFrame, n: int, features: list[str], trees: int = TREES, rows: int = SAMPLE_ROWS,
                 seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """About four times the rows each tree needs, as (tree, pick, features); `draw` decides which rows are looked at.

    A row and a tree meet when a hash of both is small enough. With many rows, most are set aside by a
    first hash, so that the number of pairs looked at stays the same however large the table is.
    """
    coarse, fine = _shares(n, trees, rows)
    drawn = controls.withColumn("draw", _unit(F.lit(seed), F.col("taker")))
    kept = drawn.where(F.col("draw") < coarse) if coarse < 1.0 else drawn

    def pick(tree: Column) -> Column:
        return _unit(F.lit(seed + 1), F.col("taker"), tree)

    hits = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: pick(t) < fine)
    pairs = kept.select("taker", "draw", *keep, F.array(*features).alias("x"), F.explode(hits).alias("tree"))
    return pairs.select("tree", pick(F.col("tree")).alias("pick"), "draw", *keep, "x")


def grow_tree(x: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Nodes of one tree: random feature among those that vary, uniform cut, down to the depth limit."""
    nodes: list[list] = []
    waiting = [(np.arange(len(x)), 0, -1, 0)]
    while waiting:
        members, depth, parent, side = waiting.pop()
        number = len(nodes)
        nodes.append([number, -1, 0.0, -1, -1, len(members), depth])
        if parent >= 0:
            nodes[parent][side] = number
        if depth >= depth_limit or len(members) < 2:
            continue
        part = x[members]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if len(varying) == 0:
            continue
        feature = int(rng.choice(varying))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= cut
        nodes[number][1:3] = [feature, cut]
        waiting.append((members[~goes_left], depth + 1, number, 4))
        waiting.append((members[goes_left], depth + 1, number, 3))
    return [tuple(node) for node in nodes]


def fit_forest(scaled: DataFrame, features: list[str] = MODEL_FEATURES, trees: int = TREES,
               rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """Grow the forest on the control wallets of a scaled table; one row per node."""
    controls = scaled.where(is_control())
    n = controls.count()
    used = min(n, rows)
    depth_limit = math.ceil(math.log2(max(used, 2)))

    def grow(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        return _grown(int(key[0]), sample, used, depth_limit, seed)

    samples = tree_samples(controls, n, features, trees, rows, seed).drop("draw")
    return samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def _grown(tree: int, sample: pd.DataFrame, used: int, depth_limit: int, seed: int) -> pd.DataFrame:
    x = np.stack(sample.nsmallest(used, "pick")["x"].to_numpy())
    nodes = grow_tree(x, np.random.default_rng([seed, tree]), depth_limit)
    out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "rows", "depth"])
    out.insert(0, "tree", tree)
    return out


def fit_turns(scaled: DataFrame, turns: list[str] | DataFrame, left_out: str | None = None, features: list[str] = MODEL_FEATURES,
              trees: int = TREES, rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """The trees of a forest per turn, all grown by one job: nodes with `sample`, and on each root the `turns` of the tree.

    `turns` are names, or a table with the column `turn`. `left_out` names an array column with the turns that leave a
    row out. The rows that a tree may take go once to each `TURNS_PER_TASK` turns, and every turn draws its own from
    them. A tree follows from its number and its rows, so turns that draw the same rows share one; `sample` tells the rows.
    """
    controls = scaled.where(is_control())
    absent = F.col(left_out) if left_out else F.array().cast("array<string>")
    controls = controls.withColumn("absent", F.coalesce(absent, F.array().cast("array<string>")))
    total = controls.count()
    schema = f"sample string, {NODE_SCHEMA}, turns array<string>"
    names = turns if isinstance(turns, DataFrame) else scaled.sparkSession.createDataFrame([(t,) for t in turns], "turn string")
    gone = controls.select(F.explode("absent").alias("turn")).groupBy("turn").agg(F.count("*").alias("gone"))
    sizes = stage(names.select("turn").distinct().join(gone, "turn", "left").select(
        "turn", (F.lit(total) - F.coalesce("gone", F.lit(0))).alias("n")).where("n > 0"), "sizes")
    least, count = sizes.agg(F.min("n"), F.count("*")).first()
    if not count:
        return scaled.sparkSession.createDataFrame([], schema)
    parts = math.ceil(count / TURNS_PER_TASK)
    samples = tree_samples(controls, least, features, trees, rows, seed, keep=("absent",)).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    wanted = sizes.withColumn("part", F.pmod(F.xxhash64("turn"), F.lit(parts)).cast("int")).withColumn(
        "tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))

    def grow(key: tuple, sample: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found = _drawn(sample, asking, trees, rows)
        if not found:
            return pd.DataFrame(columns=["sample", *_NODE_COLUMNS, "turns"])
        return pd.concat([_shared(int(key[0]), name, part, used, of, seed) for name, (part, used, of) in found.items()])

    return samples.groupBy("tree", "part").cogroup(wanted.groupBy("tree", "part")).applyInPandas(grow, schema)


def _drawn(sample: pd.DataFrame, asking: pd.DataFrame, trees: int, rows: int) -> dict[str, tuple[pd.DataFrame, int, list[str]]]:
    """The different samples of a tree by their digests: rows, how many a tree takes of them, and the turns that draw them."""
    asked, without = set(asking["turn"]), {}
    for i, turns in enumerate(sample["absent"]):
        for turn in asked.intersection(turns):
            without.setdefault(turn, []).append(i)
    named, found = {}, {}
    for turn, n in zip(asking["turn"], asking["n"]):
        key = int(n), tuple(without.get(turn, ()))
        if key not in named:
            coarse, fine = _shares(key[0], trees, rows)
            taken = ((sample["draw"] < coarse) & (sample["pick"] < fine)).to_numpy(dtype=bool, copy=True)
            taken[list(key[1])] = False
            used = min(key[0], rows)
            part = sample[taken].nsmallest(used, "pick")
            text = b"".join(np.asarray(x, dtype=float).tobytes() for x in part["x"])
            named[key] = hashlib.sha256(f"{used} ".encode() + text).hexdigest() if len(part) else None
            if len(part):
                found.setdefault(named[key], (part, used, []))
        if named[key] is not None:
            found[named[key]][2].append(turn)
    return found


def _shared(tree: int, name: str, part: pd.DataFrame, used: int, turns: list[str], seed: int) -> pd.DataFrame:
    nodes = _grown(tree, part, used, math.ceil(math.log2(max(used, 2))), seed)
    nodes.insert(0, "sample", name)
    nodes["turns"] = [turns if node == 0 else None for node in nodes["node"]]
    return nodes


def turn_trees(grown: DataFrame) -> DataFrame:
    """(turn, tree, sample) of the trees that `fit_turns` has grown."""
    return grown.where("node = 0").select(F.explode("turns").alias("turn"), "tree", "sample")


def distinct_nodes(grown: DataFrame) -> DataFrame:
    """The nodes of each tree once, also where turns of several tasks share it."""
    return grown.drop("turns").dropDuplicates(["tree", "sample", "node"])


def fit_forests(scaled: DataFrame, turns: list[str] | DataFrame, left_out: str | None = None, features: list[str] = MODEL_FEATURES,
                trees: int = TREES, rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """A forest per turn, all grown by one job: nodes with the column `turn`, as `fit_forest` grows them for each turn."""
    grown = stage(fit_turns(scaled, turns, left_out, features, trees, rows, seed), "grown")
    return turn_trees(grown).join(distinct_nodes(grown), ["tree", "sample"]).select("turn", *_NODE_COLUMNS)


def distinct_forests(grown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turn, forest), and the nodes of each forest; turns all of whose trees are the same have one forest."""
    each = F.sort_array(F.collect_list(F.concat_ws(":", "tree", "sample")))
    trees = turn_trees(grown)
    forests = stage(trees.groupBy("turn").agg(F.sha2(F.array_join(each, ","), 256).alias("forest")), "forests")
    one = forests.groupBy("forest").agg(F.min("turn").alias("turn"))
    nodes = trees.join(one, "turn").join(distinct_nodes(grown), ["tree", "sample"])
    return forests, nodes.select("forest", *_NODE_COLUMNS)


def score_turns(rows: DataFrame, nodes: DataFrame, features: list[str] = MODEL_FEATURES, keep: tuple[str, ...] = ()) -> DataFrame:
    """(turn, taker, label, `keep`, if_raw) of rows with a `turn`, under its forest. A forest goes to each portion of its rows."""
    table = rows.select("turn", "taker", F.col(LABEL).cast("int").alias(LABEL), *keep, F.array(*features).alias("x"))
    counts = stage(table.groupBy("turn").agg(F.ceil(F.count("*") / F.lit(PORTION)).cast("int").alias("portions")), "portions")
    portions = F.broadcast(counts)  # a row per turn
    dealt = table.join(portions, "turn").withColumn("portion", F.pmod(F.xxhash64("taker"), F.col("portions")).cast("int"))
    trees = nodes.join(portions, "turn").withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))

    def score(key: tuple, part: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        out = part[["turn", "taker", LABEL, *keep]].copy()
        out["if_raw"] = Forest(forest).score(np.stack(part["x"].to_numpy())) if len(part) else np.zeros(0)
        return out

    return dealt.drop("portions").groupBy("turn", "portion").cogroup(
        trees.drop("portions").groupBy("turn", "portion")).applyInPandas(
        score, T.StructType([*table.drop("x").schema, T.StructField("if_raw", T.DoubleType())]))


class Forest:
    """The forest as arrays: at most trees x 511 nodes whatever the data, so it can go out with the task."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"], kind="stable")
        trees = nodes["tree"].to_numpy()
        start = np.searchsorted(trees, trees)
        self.roots = np.flatnonzero(nodes["node"].to_numpy() == 0)
        leaf = nodes["feature"].to_numpy() < 0
        own = np.arange(len(nodes))
        self.feature = np.where(leaf, 0, nodes["feature"].to_numpy())
        self.cut = np.where(leaf, np.inf, nodes["cut"].to_numpy())
        # Node i goes on to child[2i], or to child[2i + 1] above the cut; a leaf stays where it is.
        self.child = np.empty(2 * len(nodes), dtype=np.int64)
        self.child[0::2] = np.where(leaf, own, nodes["left"].to_numpy() + start)
        self.child[1::2] = np.where(leaf, own, nodes["right"].to_numpy() + start)
        self.length = nodes["depth"].to_numpy() + mean_path(nodes["rows"].to_numpy())
        self.depth = int(nodes["depth"].max()) if len(nodes) else 0
        used = int(nodes["rows"].to_numpy()[self.roots].max()) if len(nodes) else 0
        self.norm = float(mean_path(used)) or 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / expected path) per row, in (0, 1]; higher is more anomalous."""
        total = np.zeros(len(x))
        values = np.ascontiguousarray(x).ravel()
        row = np.arange(len(x)) * x.shape[1]
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                above = values.take(row + self.feature.take(at)) > self.cut.take(at)
                at = self.child.take(2 * at + above)
            total += self.length.take(at)
        return np.exp2(-total / (max(len(self.roots), 1) * self.norm))


def raw_scores(scaled: DataFrame, nodes: DataFrame, features: list[str] = MODEL_FEATURES) -> DataFrame:
    """Add `if_raw`, the forest's score before the offset. Only the feature columns go to Python."""
    forest = Forest(nodes.toPandas())

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(forest.score(np.column_stack([c.to_numpy(dtype=float) for c in batch])))

    return scaled.withColumn("if_raw", score(*features))


def flag_threshold(raw: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """One row `threshold`: the score that the most anomalous 1 % of the controls exceed."""
    quantile = exact_quantiles(raw.where(is_control()), ["if_raw"], [1.0 - contamination])
    return quantile.select(F.col("quantile").alias("threshold"))


def score_forest(scaled: DataFrame, nodes: DataFrame, features: list[str] = MODEL_FEATURES,
                 contamination: float = CONTAMINATION, threshold: DataFrame | None = None) -> DataFrame:
    """Anomaly score (positive: flagged) and rank of every wallet.

    The flagging threshold is taken from the controls of the table, or from a `threshold` found before.
    """
    raw = stage(raw_scores(scaled, nodes, features).select("taker", LABEL, "case_id", "if_raw"), "if_raw")
    offset = flag_threshold(raw, contamination) if threshold is None else threshold
    scores = raw.select(
        "taker", LABEL, "case_id",
        (F.col("if_raw") - offset.select("threshold").scalar()).alias("anomaly_score_if"))
    return with_rank(scores, "anomaly_score_if", "rank_if")


def run_isolation_forest(profiles: DataFrame, model_path: str | None = None, trees: int = TREES) -> DataFrame:
    """Profiles in, scores out; scaler, forest and threshold are saved as Parquet when a path is given."""
    scaler = stage(fit_scaler(profiles), "scaler")
    scaled = model_input(profiles, scaler=scaler)
    nodes = stage(fit_forest(scaled, trees=trees), "forest")
    if model_path is not None:
        threshold = flag_threshold(stage(raw_scores(scaled.where(is_control()), nodes), "if_raw"))
        for name, part in (("scaler", scaler), ("nodes", nodes), ("threshold", threshold)):
            part.write.mode("overwrite").parquet(f"{model_path}/{name}")
    return score_forest(scaled, nodes)


def score_saved_forest(profiles: DataFrame, model_path: str) -> DataFrame:
    """Scores of new profiles under a saved forest."""
    scaler, nodes, threshold = (
        profiles.sparkSession.read.parquet(f"{model_path}/{name}") for name in ("scaler", "nodes", "threshold"))
    return score_forest(model_input(profiles, scaler=scaler), nodes, threshold=threshold)
