"""Autoencoder trained data-parallel: in each round every task takes some epochs over its rows, then all are averaged."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tapewatch.constants import LABEL, MODEL_FEATURES
from tapewatch.operators.curves import with_rank
from tapewatch.operators.sampling import SEED, split_controls
from tapewatch.operators.scaling import fit_scaler, model_input
from tapewatch.session import stage

# Layer widths between input and output, and the training settings.
HIDDEN = [64, 32, 16, 32, 64]
DROPOUT_LAYERS = 2
DROPOUT = 0.2
BATCH_ROWS = 256
EPOCHS = 150
LEARNING_RATE = 1e-3
WEIGHT_DECAY = 1e-5
PATIENCE = 15
PLATEAU_PATIENCE = 5
PLATEAU_FACTOR = 0.5
PLATEAU_THRESHOLD = 1e-4
ADAM_BETAS = (0.9, 0.999)
ADAM_EPS = 1e-8

# Tasks and epochs per round. The result depends on both, so they are parameters and never follow the table's size:
# a larger table may be given more tasks.
TASKS = 4
LOCAL_EPOCHS = 5
# Rows that the validation loss is summed over at a time.
LOSS_ROWS = 4096
MERGED_STATES = 32

# Workers get the functions of this module with the task, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])


class Network:
    """A fixed stack of dense layers over one flat weight vector; ReLU between, none at code and output."""

    def __init__(self, inputs: int, hidden: list[int] = HIDDEN):
        widths = [inputs, *hidden, inputs]
        self.shapes = list(zip(widths[:-1], widths[1:]))
        self.code = len(hidden) // 2
        self.size = sum(a * b + b for a, b in self.shapes)

    def initial(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.uniform(-1, 1, a * b + b) / np.sqrt(a) for a, b in self.shapes])

    def layers(self, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append((w[at:at + a * b].reshape(a, b), w[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def _active(self, i: int) -> bool:
        return i != self.code and i != len(self.shapes) - 1

    def forward(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        for i, (m, b) in enumerate(self.layers(w)):
            x = x @ m + b
            if self._active(i):
                x = np.maximum(x, 0.0)
        return x

    def gradient(self, w: np.ndarray, x: np.ndarray, rng: np.random.Generator, dropout: float | None = None) -> np.ndarray:
        """Gradient of the mean squared reconstruction error, with dropout in the encoder."""
        dropout = DROPOUT if dropout is None else dropout
        layers, inputs, masks, h = self.layers(w), [], [], x
        for i, (m, b) in enumerate(layers):
            inputs.append(h)
            h = h @ m + b
            mask = np.ones_like(h)
            if self._active(i):
                mask = (h > 0).astype(float)
                if i < DROPOUT_LAYERS and dropout:
                    mask *= (rng.random(h.shape) >= dropout) / (1.0 - dropout)
                h = h * mask
            masks.append(mask)
        delta = 2.0 * (h - x) / x.size
        grads = []
        for i in reversed(range(len(layers))):
            delta = delta * masks[i]
            grads.append(np.concatenate([(inputs[i].T @ delta).ravel(), delta.sum(axis=0)]))
            delta = delta @ layers[i][0].T
        return np.concatenate(grads[::-1])


@dataclass
class State:
    """Weights, Adam's two moments and the number of steps taken."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: float = 0.0

    def update(self, grad: np.ndarray, rate: float) -> None:
        grad = grad + WEIGHT_DECAY * self.w
        self.step += 1
        b1, b2 = ADAM_BETAS
        self.m = b1 * self.m + (1 - b1) * grad
        self.v = b2 * self.v + (1 - b2) * grad * grad
        unbiased_m = self.m / (1 - b1**self.step)
        unbiased_v = self.v / (1 - b2**self.step)
        self.w = self.w - rate * unbiased_m / (np.sqrt(unbiased_v) + ADAM_EPS)


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray
    history: list[float] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)
    epochs: list[int] = field(default_factory=list)
    last: State | None = None

    def weights_frame(self, spark: SparkSession) -> DataFrame:
        """(position, weight): 6 618 rows for ten features."""
        return spark.createDataFrame(
            pd.DataFrame({"position": np.arange(len(self.weights)), "weight": self.weights}),
            "position int, weight double")

    def history_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(zip(self.epochs, self.history, self.rates)),
            "epoch int, val_loss double, learning_rate double")

    def save(self, scaler: DataFrame, path: str) -> None:
        """Weights, history and the scaler they belong to, as Parquet."""
        spark = scaler.sparkSession
        parts = {"weights": self.weights_frame(spark), "history": self.history_frame(spark), "scaler": scaler}
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{path}/{name}")


def load_weights(spark: SparkSession, path: str) -> np.ndarray:
    return spark.read.parquet(f"{path}/weights").orderBy("position").toPandas()["weight"].to_numpy()


def _training_table(scaled: DataFrame, features: list[str], tasks: int) -> DataFrame:
    """Control rows dealt out over the tasks by hash. The executors keep them; those of a lost one are made again from files."""
    split = stage(split_controls(scaled).select("taker", "is_validation", *features), "training")
    return split.repartition(tasks, F.xxhash64("taker")).persist()


def _passes(table: DataFrame, first: int, count: int, seed: int) -> DataFrame:
    """A task's training rows once per epoch, each time in another order, and its validation rows once.

    The order comes from a hash, so it is the same however many rows are sent to Python at a time; sorting spills, so that a
    task needs no memory for its rows.
    """
    epochs = F.sequence(F.lit(first), F.lit(first + max(count, 1) - 1))
    rows = table.withColumn("epoch", F.explode(F.when(F.col("is_validation"), F.array(F.lit(first))).otherwise(epochs)))
    return rows.where("is_validation" if not count else "true").sortWithinPartitions(
        "epoch", F.xxhash64("taker", "epoch", F.lit(seed)), "taker").drop("taker")


STATE_SCHEMA = "task int, train_rows long, val_rows long, val_sum double, step double, state binary"


def merge_states(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for several: sums of the counts and losses, states and steps averaged by training rows."""
    share = rows["train_rows"].to_numpy(dtype=float)
    share = share / share.sum() if share.sum() else np.full(len(rows), 1.0 / len(rows))
    state = sum(s * np.frombuffer(packed) for s, packed in zip(share, rows["state"]))
    return pd.DataFrame({
        "task": [int(rows["task"].min())], "train_rows": [int(rows["train_rows"].sum())],
        "val_rows": [int(rows["val_rows"].sum())], "val_sum": [float(rows["val_sum"].sum())],
        "step": [float((share * rows["step"]).sum())], "state": [state.tobytes()]})


class _Portions:
    """Rows that come in pieces of any size, handed on so many at a time."""

    def __init__(self, rows: int):
        self.rows, self.rest = rows, None

    def add(self, x: np.ndarray) -> Iterator[np.ndarray]:
        x = x if self.rest is None else np.concatenate([self.rest, x])
        whole = len(x) // self.rows * self.rows
        self.rest = x[whole:]
        for at in range(0, whole, self.rows):
            yield x[at:at + self.rows]

    def end(self) -> Iterator[np.ndarray]:
        if self.rest is not None and len(self.rest):
            yield self.rest
        self.rest = None


def _portions(batches: Iterator[pa.RecordBatch], features: list[str], rows: int) -> Iterator[tuple[bool, np.ndarray]]:
    """(is_validation, rows) in order: training rows as mini-batches, of which none holds rows of two epochs."""
    train, held, epoch = _Portions(rows), _Portions(LOSS_ROWS), None
    for batch in batches:
        x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
        checks = batch.column("is_validation").to_numpy(zero_copy_only=False)
        epochs = batch.column("epoch").to_numpy(zero_copy_only=False)
        for e in np.unique(epochs):
            if e != epoch:
                yield from ((False, p) for p in train.end())
                epoch = e
            yield from ((True, p) for p in held.add(x[checks & (epochs == e)]))
            yield from ((False, p) for p in train.add(x[~checks & (epochs == e)]))
    yield from ((False, p) for p in train.end())
    yield from ((True, p) for p in held.end())


def fit_autoencoder(scaled: DataFrame, features: list[str] = MODEL_FEATURES, epochs: int = EPOCHS,
                    seed: int = SEED, tasks: int = TASKS, local_epochs: int = LOCAL_EPOCHS, step_rows: int | None = None,
                    rate: float | None = None, dropout: float | None = None, hidden: list[int] = HIDDEN,
                    initial: np.ndarray | None = None) -> Model:
    """Train on the control wallets of a scaled table; weights with the lowest validation loss win.

    One Spark job per round: every task measures the validation loss of the weights it was given, takes Adam steps of
    `step_rows` rows over its rows for `local_epochs` epochs, each in another order, and returns its state. States are
    averaged by row count: first in groups on the cluster, so that at most 32 of them (about 160 kB each) reach the
    driver. The loss of a round is thus known one job later, which is when the learning rate and the early
    stop, both counted in epochs, react. An epoch passes over all training rows once, at any size of the table, and a
    task's memory does not grow with its rows. `initial` gives the weights to start from.
    """
    table = _training_table(scaled, features, tasks)
    # Averaging smooths as a large batch does: with a quarter of its share of a batch, a task loses nothing by it.
    step = step_rows or max(16, BATCH_ROWS // (4 * tasks))
    net = Network(len(features), hidden)
    start = net.initial(seed) if initial is None else np.asarray(initial, float)
    try:
        return _fit(table, features, net, start, epochs, seed, tasks, local_epochs, step,
                    LEARNING_RATE if rate is None else rate, DROPOUT if dropout is None else dropout)
    finally:
        table.unpersist()


def _fit(table: DataFrame, features: list[str], net: Network, start: np.ndarray, epochs: int, seed: int, tasks: int,
         local_epochs: int, step: int, rate: float, dropout: float) -> Model:
    def run_round(state: State, rate: float, first: int, count: int) -> pd.Series:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = State(state.w, state.m, state.v, state.step)
            task = TaskContext.get().partitionId()
            rng = np.random.default_rng([seed, first, task])
            train_rows, val_rows, val_sum = 0, 0, 0.0
            for is_validation, x in _portions(batches, features, step):
                if is_validation:
                    val_sum += float(((x - net.forward(state.w, x)) ** 2).mean(axis=1).sum())
                    val_rows += len(x)
                else:
                    mine.update(net.gradient(mine.w, x, rng, dropout), rate)
                    train_rows += len(x)
            packed = np.concatenate([mine.w, mine.m, mine.v])
            yield pa.RecordBatch.from_pandas(pd.DataFrame({
                "task": np.array([task], np.int32), "train_rows": [train_rows // max(count, 1)], "val_rows": [val_rows],
                "val_sum": [val_sum], "step": [float(mine.step)], "state": [packed.tobytes()]}), preserve_index=False)

        states = _passes(table, first, count, seed).mapInArrow(work, STATE_SCHEMA)
        if tasks > MERGED_STATES:
            group = F.pmod("task", F.lit(MERGED_STATES))
            states = states.groupBy(group).applyInPandas(lambda rows: merge_states(rows.sort_values("task")), STATE_SCHEMA)
        found = states.toPandas()
        if found.empty:
            raise ValueError("no control wallets to train on")
        return merge_states(found.sort_values("task")).iloc[0]

    zeros = np.zeros(net.size)
    state = State(start, zeros, zeros)
    model = Model(features, state.w)
    best, since_best, since_gain, gain_mark = np.inf, 0, 0, np.inf
    done, taken = 0, 0
    while True:
        count = min(local_epochs, epochs - done)
        result = run_round(state, rate, done, count)
        if count and result.train_rows == 0:
            raise ValueError("no training rows")
        if done:
            loss = float(result.val_sum / result.val_rows) if result.val_rows else 0.0
            model.epochs.append(done)
            model.history.append(loss)
            model.rates.append(rate)
            if loss < best:
                best, since_best, model.weights = loss, 0, state.w
            else:
                since_best += taken
                if since_best >= PATIENCE:
                    break
            if loss < gain_mark * (1 - PLATEAU_THRESHOLD):
                gain_mark, since_gain = loss, 0
            else:
                since_gain += taken
                if since_gain > PLATEAU_PATIENCE:
                    rate, since_gain = rate * PLATEAU_FACTOR, 0
        if not count:
            break
        done, taken = done + count, count
        w, m, v = np.split(np.frombuffer(result.state), 3)
        model.last = state = State(w, m, v, float(result.step))
    return model


def reconstruction_error(scaled: DataFrame, weights: np.ndarray, features: list[str] = MODEL_FEATURES,
                         out: str = "anomaly_score_ae", hidden: list[int] = HIDDEN) -> DataFrame:
    """Add the mean squared reconstruction error of each row."""
    net = Network(len(features), hidden)

    @F.pandas_udf("double")
    def error(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in batch])
            yield pd.Series(((x - net.forward(weights, x)) ** 2).mean(axis=1))

    return scaled.withColumn(out, error(*features))


def rank_errors(scaled: DataFrame, weights: np.ndarray) -> DataFrame:
    scores = reconstruction_error(scaled, weights).select("taker", LABEL, "case_id", "anomaly_score_ae")
    return with_rank(stage(scores, "ae_scores"), "anomaly_score_ae", "rank_ae")


def run_autoencoder(profiles: DataFrame, model_path: str | None = None, epochs: int = EPOCHS) -> DataFrame:
    """Profiles in, scores out; scaler, weights and history are saved as Parquet when a path is given."""
    scaler = stage(fit_scaler(profiles), "scaler")
    scaled = model_input(profiles, scaler=scaler)
    model = fit_autoencoder(scaled, epochs=epochs)
    if model_path is not None:
        model.save(scaler, model_path)
    return rank_errors(scaled, model.weights)


def score_saved_autoencoder(profiles: DataFrame, model_path: str) -> DataFrame:
    """Scores of new profiles under saved weights."""
    spark = profiles.sparkSession
    scaler = spark.read.parquet(f"{model_path}/scaler")
    return rank_errors(model_input(profiles, scaler=scaler), load_weights(spark, model_path))
