"""Exact top-k search by inner product with a pivot-distance index.

Components are quantised to integers. A vector x of squared norm n gets one more component, sqrt(M - n) with M the
largest squared norm, and a query one more zero; then |q - x|^2 = |q|^2 + M - 2 q.x, so the nearest vectors are
those with the largest inner products. Index: each vector lies in the cell of its nearest pivot, in an annulus of
distances from it; an annulus is stored in blocks of bounded size. Search: a query visits annuli in the order of
their triangle-inequality bounds. First come the nearest ones until they hold enough vectors; their k-th best
score is a bound, and of all other annuli only those are visited whose bound allows that score or a better one.
All bounds have a margin for rounding, scores are exact integers.

Queries are packed in groups and vectors in blocks, some blocks of neighbouring annuli to a bucket. They meet per bucket
and group: the group's vectors come once, the blocks with a bit for each query that visits them. A task multiplies one
block at a time and hands on only the best scores that reach the bound.

Defined results: rows without id, null vectors and vectors with null or non-finite components take no part.
Shorter vectors are padded with zeros. A candidate never answers a query of its own id. Repeated ids: every row is a
candidate, and each query row is answered by itself. Ties go to the smaller id. Scores beyond a long are cut to its
range, components beyond a double after scaling to that of a double; where squares of components overflow, distances are
measured in a larger unit, in which nothing may be excluded, and scores stay exact. Fewer candidates than k give fewer rows, an empty table none. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewatch.llm.common import numbered, read_table, usable
from tapewatch.session import stage

K, SCALE, EVERY = 10, 1024, 100
#: Pivots, vectors that they are chosen from, and annuli per pivot at most.
PIVOTS, CHOICE, RINGS = 64, 1024, 64
#: Vectors in a block, blocks in a bucket, and queries in a group, expected.
BLOCK, BUCKET, GROUP = 1024, 16, 8192
#: Keys that the blocks of an annulus, and the buckets that a group visits, are dealt over at most.
SALTS = 32
#: Scores that a task holds before it drops all but the best.
HELD = 1 << 20
#: Vectors that the annuli of the first round should hold, as a multiple of k.
FIRST = 8
MOST = float(np.finfo(np.float64).max)


def _quantise(scale: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, norms, peaks, sizes = [], [], [], []
            for row in batch.column(1):
                with np.errstate(over="ignore"):
                    v = np.clip(np.floor(scale * np.array(row.as_py(), np.float64)), -MOST, MOST)
                    norms.append(float(v @ v))
                data.append(v.astype("<f8").tobytes())
                peaks.append(float(np.abs(v).max(initial=0)))
                sizes.append(len(v))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(data, pa.binary()), pa.array(norms, pa.float64()), pa.array(peaks, pa.float64()),
                pa.array(sizes, pa.int32())], ["vec_id", "v", "norm", "peak", "size"])

    return run


def _matrix(vectors: list[bytes], dim: int) -> np.ndarray:
    if all(len(v) == 8 * dim for v in vectors):
        return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), dim)
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v) // 8] = np.frombuffer(v, "<f8")
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the sample vector farthest from those chosen before."""
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


class Geometry:
    """Pivots in the space with the added component, and distances to them; all vectors are multiplied by `factor`."""

    def __init__(self, pivots: np.ndarray, most: float, factor: float = 1.0):
        self.dim, self.most, self.factor = pivots.shape[1], most, factor
        self.pivots = pivots
        self.norms = (pivots ** 2).sum(axis=1)
        self.extra = np.sqrt(np.maximum(0.0, most - self.norms))

    def of_vectors(self, x: np.ndarray) -> np.ndarray:
        x = x * self.factor
        extra = np.sqrt(np.maximum(0.0, self.most - (x ** 2).sum(axis=1)))
        return np.sqrt(np.maximum(0.0, 2 * self.most - 2 * (x @ self.pivots.T + extra[:, None] * self.extra)))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q * self.factor
        return np.sqrt(np.maximum(0.0, (q ** 2).sum(axis=1)[:, None] + self.most - 2 * q @ self.pivots.T))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products as integers, cut to the range of a long; pairs too large for doubles are multiplied as integers."""
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.outer(np.abs(q).max(axis=1, initial=0), np.abs(x).max(axis=1, initial=0)) * max(1, q.shape[1])
        large = top >= 2 ** 53
        out = np.where(large, 0, q @ x.T).astype(np.int64)
    low, high = -2 ** 63, 2 ** 63 - 1
    for i, j in zip(*np.nonzero(large)):
        out[i, j] = min(max(sum(int(a) * int(b) for a, b in zip(q[i], x[j])), low), high)
    return out


def _assign(geometry: Geometry):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v").to_pylist(), geometry.dim)
                d = geometry.of_vectors(x)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])],
                    [*batch.schema.names, "pivot", "dist"])

    return run


def _packed(keys: tuple[str, ...], dim: int, columns: dict[str, str]):
    """Rows of a group to one row: vectors and `columns` one after the other, in order of `rid`."""
    def run(table):
        import pyarrow as pa

        table = table.sort_by("rid")
        first = table.slice(0, 1)
        out = {k: first.column(k) for k in keys}
        for name, column in columns.items():
            out[name] = pa.array([table.column(column).to_numpy().astype("<i8").tobytes()], pa.binary())
        vectors = b"".join(v.ljust(8 * dim, b"\0") for v in table.column("v").to_pylist())
        return pa.table(out | {"vectors": pa.array([vectors], pa.binary())})

    return run


@dataclass
class Annulus:
    """Vectors nearest to a pivot within a range of distances from it: their number, and the blocks they are in."""

    pivot: int
    ring: int
    low: float
    high: float
    n: int
    blocks: int = 1
    first: int = 0  # blocks of the annuli before
    buckets: tuple[int, int] = (0, 0)  # the first and the last that hold some of them


def build_index(vectors: DataFrame, geometry: Geometry) -> tuple[DataFrame, list[Annulus]]:
    """Blocks (annulus, block, bucket, ids, vectors), where a bucket holds `BUCKET` blocks in order; and the annuli."""
    spark = vectors.sparkSession
    cells = stage(vectors.select("vec_id", "v", "rid").mapInArrow(
        _assign(geometry), "vec_id long, v binary, rid long, pivot int, dist double"), "cells")
    span = cells.groupBy("pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n"))
    rings = F.least(F.lit(RINGS), F.ceil(F.col("n") / F.lit(BLOCK)))
    # At most one row per pivot.
    width = F.broadcast(stage(span.select(
        "pivot", "low", F.greatest((F.col("high") - F.col("low")) / rings, F.lit(1e-9)).alias("width"),
        rings.alias("rings")), "pivots"))
    ring = F.least(F.floor((F.col("dist") - F.col("low")) / F.col("width")), F.col("rings") - 1).cast("int")
    placed = cells.join(width, "pivot").withColumn("ring", ring).drop("low", "width", "rings")
    # At most `PIVOTS` x `RINGS` annuli.
    counted = placed.groupBy("pivot", "ring").agg(
        F.min("dist").alias("low"), F.max("dist").alias("high"), F.count("*").alias("n")).orderBy("pivot", "ring")
    annuli = [Annulus(r.pivot, r.ring, r.low, r.high, r.n, -(-r.n // BLOCK)) for r in counted.collect()]
    blocks = 0
    for a in annuli:
        a.first, a.buckets = blocks, (blocks // BUCKET, (blocks + a.blocks - 1) // BUCKET)
        blocks += a.blocks
    table = F.broadcast(spark.createDataFrame(
        [(a.pivot, a.ring, i, a.blocks, a.first) for i, a in enumerate(annuli)],
        "pivot int, ring int, annulus int, blocks long, first long"))
    dealt = placed.join(table, ["pivot", "ring"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks"))).withColumn(
        "bucket", F.floor((F.col("first") + F.col("block")) / F.lit(BUCKET)))
    keys = ("annulus", "block", "bucket")
    packed = dealt.groupBy(*keys).applyInArrow(
        _packed(keys, geometry.dim, {"ids": "vec_id"}), "annulus int, block long, bucket long, ids binary, vectors binary")
    return stage(packed, "index"), annuli


def visited(geometry: Geometry, annuli: list[Annulus], q: np.ndarray, bounds: np.ndarray, k: int, first: bool) -> np.ndarray:
    """Which annuli each query visits: by bound, the first ones only or all that can still hold a result."""
    pivot, n = np.array([a.pivot for a in annuli], np.int64), np.array([a.n for a in annuli], np.int64)
    low, high = np.array([a.low for a in annuli]), np.array([a.high for a in annuli])
    d = geometry.of_queries(q)[:, pivot]
    norm = ((q * geometry.factor) ** 2).sum(axis=1)[:, None] + geometry.most
    gap = np.maximum(0.0, np.maximum(d - high, low - d))
    best = (norm - gap ** 2) / 2 + 1e-9 * norm + 1e-3 * geometry.factor  # no vector there has a larger inner product
    if not first:
        return best >= bounds[:, None].astype(np.float64) * geometry.factor * geometry.factor
    order = np.argsort(-best, axis=1, kind="stable")
    before = np.cumsum(n[order], axis=1) - n[order]
    out = np.zeros(best.shape, bool)
    np.put_along_axis(out, order, before < FIRST * k, axis=1)
    return out


def _visits(geometry: Geometry, annuli: list[Annulus], k: int, first: bool):
    """Per packed group of queries a row for each annulus that some of them visit, with a bit per query."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["vectors"], "<f8").reshape(-1, geometry.dim)
                bounds = np.frombuffer(row["bounds"], "<i8")
                which = np.concatenate([visited(geometry, annuli, q[i:i + 256], bounds[i:i + 256], k, first)
                                        for i in range(0, len(q), 256)])
                at = np.flatnonzero(which.any(axis=0))
                masks = [np.packbits(which[:, i]).tobytes() for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), row["g"], np.int32)), pa.array(at.astype(np.int32)),
                     *[pa.array([annuli[i].buckets[end] for i in at], pa.int64()) for end in (0, 1)],
                     pa.array([min(SALTS, annuli[i].blocks) for i in at], pa.int32()), pa.array(masks, pa.binary())],
                    ["g", "annulus", "from", "to", "salts", "mask"])

    return run


class _Best:
    """The k best scores per query row, of many blocks."""

    def __init__(self, k: int):
        self.k, self.held, self.size = k, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size > HELD:
            self.held = [self.all()]
            self.size = len(self.held[0][0])

    def all(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        row, ids, score = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ids, ~score, row))  # the least long has no negative
        row, ids, score = row[order], ids[order], score[order]
        start = np.searchsorted(row, row)
        top = np.arange(len(row)) - start < self.k
        return row[top], ids[top], score[top]


def _multiply(k: int, dim: int):
    """Units of a group of queries and then blocks to the k best of each query, as far as they reach its bound."""
    def run(batches):
        import pyarrow as pa

        def answers():
            row, ids, score = best.all()
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[row]), pa.array(own[row]), pa.array(ids), pa.array(score)], ["rid", "query_id", "vec_id", "score"])

        best = None
        for batch in batches:
            for i in range(batch.num_rows):
                part = {name: batch.column(name)[i].as_py() for name in ("kind", "ids", "vectors", "rows", "bounds", "mask")}
                ids = np.frombuffer(part["ids"], "<i8")
                x = np.frombuffer(part["vectors"], "<f8").reshape(len(ids), dim)
                if part["kind"] == 0:
                    if best is not None:
                        yield answers()
                    best, own, q = _Best(k), ids, x
                    rows, bounds = (np.frombuffer(part[name], "<i8") for name in ("rows", "bounds"))
                    continue
                asking = np.flatnonzero(np.unpackbits(np.frombuffer(part["mask"], np.uint8), count=len(rows)))
                for some in np.array_split(asking, -(-len(asking) // 256)):
                    s = scores(q[some], x)
                    good = (s >= bounds[some][:, None]) & (ids[None, :] != own[some][:, None])
                    at, hit = np.nonzero(good)
                    best.add(some[at], ids[hit], s[at, hit])
        if best is not None:
            yield answers()

    return run


def _round(queries: DataFrame, index: DataFrame, geometry: Geometry, annuli: list[Annulus], groups: int, k: int,
           first: bool) -> DataFrame:
    """The k best candidates of each query row (rid, vec_id, v, bound) in the annuli that it visits, with `rank`.

    Queries are packed in groups once. A unit is a bucket of blocks and a group that visits some of them: the group's
    vectors come once per unit, the blocks with a bit per query that visits them.
    """
    packed = stage(queries.withColumn("g", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int")).groupBy("g").applyInArrow(
        _packed(("g",), geometry.dim, {"ids": "vec_id", "rows": "rid", "bounds": "bound"}),
        "g int, ids binary, rows binary, bounds binary, vectors binary"), "groups")
    visits = stage(packed.mapInArrow(
        _visits(geometry, annuli, k, first), "g int, annulus int, from long, to long, salts int, mask binary"), "visits")
    # Annuli with many blocks, and groups that visit many buckets, are dealt out over several keys.
    spread = visits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    salts = F.lit(min(SALTS, 1 + annuli[-1].buckets[1]))
    blocks = index.withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int")).join(spread, ["annulus", "salt"])
    pairs = visits.select("g", F.explode(F.sequence("from", "to")).alias("bucket")).distinct()
    asked = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).join(
        pairs.withColumn("salt", F.pmod("bucket", salts).cast("int")), ["g", "salt"])
    none = F.lit(None).cast("binary")
    units = asked.select("bucket", "g", F.lit(0).alias("kind"), "ids", "vectors", "rows", "bounds", none.alias("mask")).unionByName(
        blocks.select("bucket", "g", F.lit(1).alias("kind"), "ids", "vectors", none.alias("rows"), none.alias("bounds"), "mask"))
    found = units.repartition("bucket", "g").sortWithinPartitions("bucket", "g", "kind").mapInArrow(
        _multiply(k, geometry.dim), "rid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K,
          scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products for each row that satisfies `is_query`."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(vector)).select(
        F.col(vec_id).cast("long").alias("vec_id"), vector)
    table = numbered(rows.mapInArrow(_quantise(scale), "vec_id long, v binary, norm double, peak double, size int"))
    most, peak, dim = table.agg(F.max("norm"), F.max("peak"), F.max("size")).first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = [bytes(r["v"]) for r in table.orderBy(F.xxhash64("vec_id", "rid")).limit(CHOICE).select("v").collect()]
    # Squares that overflow: all is measured in units of the largest component's power of two, with the largest norm possible.
    factor = 1.0 if np.isfinite(most) else float(np.ldexp(1.0, -int(np.frexp(peak)[1])))
    geometry = Geometry(choose_pivots(_matrix(sample, max(dim, 1)) * factor, PIVOTS),
                        float(most) if factor == 1.0 else float(dim), factor)
    index, annuli = build_index(table, geometry)
    queries = stage(table.where(is_query).select("rid", "vec_id", "v").withColumn(
        "bound", F.lit(-2 ** 63).cast("long")), "queries")
    groups = max(1, -(-queries.count() // GROUP))
    first = stage(_round(queries, index, geometry, annuli, groups, k, first=True).where(F.col("rank") == k).select(
        "rid", F.col("score").alias("_bound")), "bounds")
    bounded = queries.join(first, "rid", "left").withColumn("bound", F.coalesce("_bound", "bound")).drop("_bound")
    return _round(bounded, index, geometry, annuli, groups, k, first=False).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_pivot_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best inner products for every vector whose id is divisible by 100, against all vectors."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
