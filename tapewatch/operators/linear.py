"""Reconstruction error under a few main directions of the control wallets: a baseline without random numbers.

The second moments of the scaled features are one aggregate over the controls, the directions are eigenvectors of
a matrix with a row per feature, and the error of a wallet is arithmetic on its columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.constants import LABEL, MODEL_FEATURES
from tapewatch.operators.curves import with_rank
from tapewatch.operators.scaling import fit_scaler, is_control, model_input
from tapewatch.session import stage

#: Directions kept of ten features.
DIRECTIONS = 5


def second_moments(scaled: DataFrame, features: Sequence[str] = MODEL_FEATURES) -> np.ndarray:
    """Means of the products of all pairs of features over the controls, in one pass."""
    x = [F.col(f).cast("double") for f in features]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = scaled.where(is_control()).agg(*[F.avg(x[i] * x[j]) for i, j in pairs]).first()
    if row[0] is None:
        raise ValueError("no control wallets to fit on")
    matrix = np.zeros((len(x), len(x)))
    for (i, j), value in zip(pairs, row):
        matrix[i, j] = matrix[j, i] = value
    return matrix


def main_directions(matrix: np.ndarray, count: int = DIRECTIONS) -> np.ndarray:
    """Unit eigenvectors of the largest eigenvalues as rows, the largest entry of each positive."""
    vectors = np.linalg.eigh(matrix)[1][:, ::-1][:, :count].T
    return vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]


def linear_error(scaled: DataFrame, directions: np.ndarray, features: Sequence[str] = MODEL_FEATURES,
                 out: str = "anomaly_score_linear") -> DataFrame:
    """Add the mean square of what is left of a row when its parts along the directions are taken away."""
    x = [F.col(f).cast("double") for f in features]

    def dot(weights: Sequence[float], values: list[Column]) -> Column:
        return sum((float(w) * v for w, v in zip(weights, values)), F.lit(0.0))

    parts = [f"_part{k}" for k in range(len(directions))]
    placed = scaled.withColumns({name: dot(d, x) for name, d in zip(parts, directions)})
    left = [v - dot(column, [F.col(p) for p in parts]) for v, column in zip(x, np.asarray(directions).T)]
    return placed.withColumn(out, sum((r * r for r in left), F.lit(0.0)) / len(x)).drop(*parts)


def run_linear(profiles: DataFrame, model_path: str | None = None, count: int = DIRECTIONS) -> DataFrame:
    """Profiles in, scores and ranks out; scaler and directions are saved as Parquet when a path is given."""
    scaler = stage(fit_scaler(profiles), "scaler")
    scaled = model_input(profiles, scaler=scaler)
    directions = main_directions(second_moments(scaled), count)
    if model_path is not None:
        rows = [(k, i, float(w)) for k, line in enumerate(directions) for i, w in enumerate(line)]
        frame = profiles.sparkSession.createDataFrame(rows, "direction int, position int, weight double")
        for name, part in (("scaler", scaler), ("directions", frame)):
            part.write.mode("overwrite").parquet(f"{model_path}/{name}")
    return _ranked(scaled, directions)


def _ranked(scaled: DataFrame, directions: np.ndarray) -> DataFrame:
    scores = linear_error(scaled, directions).select("taker", LABEL, "case_id", "anomaly_score_linear")
    return with_rank(stage(scores, "linear_scores"), "anomaly_score_linear", "rank_linear")


def load_directions(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/directions").orderBy("direction", "position").collect()
    return np.array([r.weight for r in rows]).reshape(max((r.direction for r in rows), default=-1) + 1, -1)


def score_saved_linear(profiles: DataFrame, model_path: str) -> DataFrame:
    """Scores of new profiles under saved directions."""
    spark = profiles.sparkSession
    scaler = spark.read.parquet(f"{model_path}/scaler")
    return _ranked(model_input(profiles, scaler=scaler), load_directions(spark, model_path))
