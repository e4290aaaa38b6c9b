"""Embedding whitening from a weighted multiplicity covariance.

Entries become integers x. Equal x vectors are grouped first; a group's weight in the fit is its number of rows, or one
with `weights="one"`. The sums S of all fitted vectors are exact integers, so a vector is centred exactly, as
(n * x - S) / n, before anything is multiplied. Each task multiplies its centred rows, scaled by their weights, with
themselves and hands on one matrix; the sum of these is the covariance, whose eigenvectors the driver finds. Each
distinct vector is then whitened once and joined back to its rows; groups with many rows are dealt out in that join.

What reaches the driver is one matrix of dim x dim numbers, dim at most `MAX_DIM`.

Defined results: null vectors and vectors with null or non-finite entries are left out. Shorter vectors count as
padded with zero entries. Rows with null or repeated ids stay rows of their own. Entries are cut to +-2^62 before the
shift, deviations to the range of a long. A component whose eigenvalue is zero to double precision cannot be whitened:
`whitened` is null there; with all vectors equal `explained` is null too, and `identity_error` is null when no component is
whitened. No rows, or vectors without entries, give no rows. Other columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.llm.common import read_table, usable
from tapewatch.operators.joins import counted_join
from tapewatch.session import stage

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: The covariance and its eigenvectors are dim x dim numbers on the driver.
MAX_DIM = 4096
LIMIT = 2 ** 62
RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.int64)


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: int, shift: int) -> tuple[DataFrame, int]:
    """(vec_id, x) with x as an array of integers, the narrowest that hold all; and their dimension."""
    rows = vectors.where(usable(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(
        vector, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)) + shift
    ).alias("x"))
    dim, low, high = rows.agg(F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not dim:
        return rows, 0
    kind = "int" if -2 ** 31 <= min(low, shift) and max(high, shift) < 2 ** 31 else "long"
    padded = F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.lit(dim) - F.size("x")))
    return rows.select("vec_id", padded.cast(f"array<{kind}>").alias("x")), dim


def _sums(dim: int):
    """Exact sums of weight * x per dimension, one set of rows per task."""
    def run(batches):
        import pyarrow as pa

        total = [0] * dim
        for batch in batches:
            x, w = _matrix(batch.column("x"), dim), batch.column("w").to_numpy(zero_copy_only=False)
            if batch.num_rows and int(np.abs(x).max()) * int(w.sum()) >= LIMIT:
                x, w = x.astype(object), w.astype(object)
            total = [t + int(s) for t, s in zip(total, (x * w[:, None]).sum(axis=0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["at", "total"])

    return run


class Centre:
    """n * x - S as exact integers: about whole means first, so that the products stay small."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = [s // n for s in sums]
        self.rest = [s - n * m for s, m in zip(sums, self.whole)]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        near = x - np.array(self.whole)
        if near.size and (int(np.abs(near).max()) + 1) * self.n >= LIMIT:
            return x.astype(object) * self.n - np.array([self.n * m + r for m, r in zip(self.whole, self.rest)], object)
        return near * self.n - np.array(self.rest)

    def centred(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(np.float64)

    def squares(self, deviations: np.ndarray) -> list[int]:
        """The sum of squares of each row, cut to the range of a long."""
        most = int(np.abs(deviations).max()) if deviations.size else 0
        if most * most * deviations.shape[1] >= LIMIT:
            deviations = deviations.astype(object)
        return [min(int(s), 2 ** 63 - 1) for s in (deviations * deviations).sum(axis=1)]


def _products(dim: int, centre: Centre):
    """Weighted products of the centred rows of a task: a row per dimension."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros((dim, dim))
        for batch in batches:
            x = centre.centred(centre.deviations(_matrix(batch.column("x"), dim)))
            total += (x * batch.column("w").to_numpy(zero_copy_only=False)[:, None]).T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim), pa.int32()), pa.array([line.tobytes() for line in total], pa.binary())], ["at", "line"])

    return run


def _added(table):
    import pyarrow as pa

    lines = [np.frombuffer(line) for line in table.column("line").to_pylist()]
    return pa.table({"at": table.column("at").slice(0, 1), "line": pa.array([np.sum(lines, axis=0).tobytes()], pa.binary())})


def covariance(groups: DataFrame, dim: int, centre: Centre) -> np.ndarray:
    """The covariance of groups (x, w), divisor n; only one matrix per task and the sum of all are moved."""
    lines = groups.mapInArrow(_products(dim, centre), "at int, line binary").groupBy("at").applyInArrow(
        _added, "at int, line binary").collect()
    total = np.zeros((dim, dim))
    for row in lines:
        total[row["at"]] = np.frombuffer(row["line"])
    return total / centre.n


def components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns, largest entry positive."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * sign


def _whitened(dim: int, centre: Centre, directions: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            deviations = centre.deviations(_matrix(batch.column("x"), dim))
            out = centre.centred(deviations) @ directions
            lines = pa.ListArray.from_arrays(
                pa.array(np.arange(0, out.size + 1, max(1, out.shape[1]))[:len(out) + 1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(centre.squares(deviations), pa.int64()), lines],
                [*batch.schema.names, "deviation", "white"])

    return run


def identity_error(white: DataFrame, count: int, n: int) -> float | None:
    """The largest entry, without sign, of the covariance of the whitened values minus the identity."""
    if not count:
        return None
    at = [F.col("white")[i] for i in range(count)]
    means = white.agg(*[F.sum(v * F.col("w")) / n for v in at]).first()
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    sums = white.agg(*[F.sum((at[i] - means[i]) * (at[j] - means[j]) * F.col("w")) / n for i, j in pairs]).first()
    return max(abs(s - (i == j)) for s, (i, j) in zip(sums, pairs))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS,
           scale: int = SCALE, shift: int = SHIFT, weights: str = "counts") -> DataFrame:
    """A row per vector and component, see `RESULT`; equal vectors are fitted by their number or, with "one", once."""
    if weights not in ("counts", "one"):
        raise ValueError(f"weights must be counts or one, not {weights}")
    rows, dim = integer_vectors(vectors, vec_id, vector, scale, shift)
    if not dim:
        return vectors.sparkSession.createDataFrame([], RESULT)
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} entries; {MAX_DIM} at most")
    weight = F.col("rows") if weights == "counts" else F.lit(1).cast("long")
    groups = stage(rows.groupBy("x").agg(F.count("*").alias("rows")).withColumn("w", weight), "groups")
    n = groups.agg(F.sum("w")).first()[0]
    sums = groups.mapInArrow(_sums(dim), "at int, total decimal(38,0)").groupBy("at").agg(F.sum("total").alias("total"))
    centre = Centre(n, [int(r.total) for r in sums.orderBy("at").collect()])
    matrix = covariance(groups, dim, centre)
    values, directions = components(matrix, count)
    whole = float(matrix.trace())
    proper = int((values > max(whole, 0.0) * dim * np.finfo(float).eps).sum())
    # A zero column for a component that cannot be whitened; it becomes null below.
    factors = np.array([1 / np.sqrt(e) if i < proper else 0.0 for i, e in enumerate(values)])
    white = stage(groups.mapInArrow(
        _whitened(dim, centre, directions * factors),
        T.StructType([*groups.schema, T.StructField("deviation", T.LongType()),
                      T.StructField("white", T.ArrayType(T.DoubleType()))])), "white")
    error = identity_error(white, proper, n)
    explained = F.array(*[F.lit(max(float(e), 0.0) / whole if whole > 0 else None).cast("double") for e in values])
    joined = counted_join(rows, white.drop("w"), ["x"], groups.drop("w"), "rows")
    return joined.select("vec_id", "deviation", F.posexplode("white").alias("at", "value")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(F.col("at") < proper, F.col("value")).alias("whitened"), explained[F.col("at")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on their 8 main directions, with variance one."""
    return whiten(read_table(spark, sf_dir, "embeddings"))
