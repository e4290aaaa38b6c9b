"""Sharding along a Hilbert curve, with DataFrame functions only.

Metadata dimensions are quantised to cells of about equal row counts, a row's cells give its index on the
Hilbert curve through the grid, rows are sorted by it and the order is cut into shards of equal row counts. Rows
near each other on the curve are near in every dimension, so the files of a shard span a small range of each
and readers skip files by their minimum and maximum, whichever dimensions a filter names.

Defined results: NULL in a dimension lies in a cell before all values; a null text has no bytes. Ties on the curve
go by text checksum, document id and row number; rows that are equal in all of them are interchangeable. An
empty table gives no rows. Only the named columns are read, others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.llm.common import numbered, read_table, running
from tapewatch.session import stage

SHARDS = 24
#: Cells per dimension: 2 ** BITS.
BITS = 6


def _curve_tables(n: int) -> tuple[list[int], list[int]]:
    """Digit and next state for each (state, bits of the n dimensions) of a Hilbert curve in n dimensions.

    A state is the entry corner and direction of a sub-cube; within one, corners are visited in Gray code order.
    """
    corners, mask = 2 ** n, 2 ** n - 1

    def gray(i):
        return i ^ (i >> 1)

    def rotate_left(x, k):
        k %= n
        return ((x << k) | (x >> (n - k))) & mask

    order = {gray(i): i for i in range(corners)}
    digits, states = [], []
    for state in range(corners * n):
        entry, direction = divmod(state, n)
        for bits in range(corners):
            w = order[rotate_left(bits ^ entry, n - (direction + 1) % n)]
            corner = gray(2 * ((w - 1) // 2)) if w else 0
            odd = w if w % 2 else w - 1
            turn = ((odd ^ (odd + 1)).bit_length() - 1) % n if w else 0
            digits.append(w)
            states.append((entry ^ rotate_left(corner, direction + 1)) * n + (direction + turn + 1) % n)
    return digits, states


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """Position of a grid cell on the Hilbert curve: a digit per level, looked up by state, as a long."""
    n = len(cells)
    if not 2 <= n <= 4 or n * bits > 62:
        raise ValueError("two to four dimensions of at most 62 bits in all")
    digits, states = _curve_tables(n)
    digits, states = F.array(*map(F.lit, digits)), F.array(*map(F.lit, states))
    levels = F.array(*[F.struct(*[F.shiftright(c, b).bitwiseAND(1).cast("int").alias(f"b{i}")
                                  for i, c in enumerate(cells)]) for b in reversed(range(bits))])

    def step(state: Column, level: Column) -> Column:
        corner = sum((level[f"b{i}"] * 2 ** i for i in range(1, n)), level["b0"])
        at = state["state"] * 2 ** n + corner
        return F.struct((state["h"] * 2 ** n + F.get(digits, at)).alias("h"), F.get(states, at).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("state"))
    return F.aggregate(levels, start, step, lambda state: state["h"])


def _numeric_cell(rows: DataFrame, name: str, bits: int) -> Column:
    """Cells between quantiles (of a sketch over all rows)."""
    probs = [i / 2 ** bits for i in range(1, 2 ** bits)]
    cuts = rows.agg(F.percentile_approx(name, probs, 10_000)).first()[0] or []
    line = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    return F.coalesce(F.size(F.filter(line, lambda c: c <= F.col(name))), F.lit(0))


def _value_cells(rows: DataFrame, name: str, bits: int) -> DataFrame:
    """Cells for the distinct values of a text column, in their order and of about equal row counts."""
    counts = stage(rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n")), "values")
    total = counts.agg(F.sum("_n")).first()[0] or 1
    upto = running(counts, [F.col(name)], {"_before": "_n"})
    middle = (F.col("_before") + F.col("_n") / 2) * 2 ** bits / F.lit(total)
    cell = F.least(middle.cast("int"), F.lit(2 ** bits - 1))
    return stage(upto.select(F.col(name).alias("_value"), cell.alias("_cell")), "cells")


def along_curve(rows: DataFrame, dimensions: Sequence[str], bits: int = BITS) -> DataFrame:
    """Add `curve`, the index of each row on the Hilbert curve through the grid of its dimensions."""
    kept, cells = rows.columns, []
    for i, name in enumerate(dimensions):
        if isinstance(rows.schema[name].dataType, T.NumericType):
            cells.append(_numeric_cell(rows, name, bits))
            continue
        lookup = _value_cells(rows, name, bits).withColumnRenamed("_cell", f"_cell{i}")
        rows = rows.join(lookup, F.col(name) == F.col("_value"), "left").drop("_value")
        cells.append(F.coalesce(f"_cell{i}", F.lit(0)))
    return rows.select(*kept, hilbert_index(cells, bits).alias("curve"))


def cut(rows: DataFrame, order: Sequence[Column], shards: int = SHARDS) -> DataFrame:
    """Cut the order into shards whose row counts differ by one at most: `shard` and the `slot` in it."""
    n = rows.count()
    placed = running(rows.withColumn("_one", F.lit(1)), list(order), {"_rank": "_one"})
    total = F.lit(max(n, 1)).cast("long")
    shard = F.expr(f"_rank * {shards} div {max(n, 1)}")
    first = F.ceil(F.col("shard") * total / F.lit(shards))
    return (placed.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_rank") - first).cast("long"))
            .drop("_one", "_rank"))


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write one folder per shard, each file a run of the curve, so that its column ranges are narrow."""
    (placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path))


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of equal row counts, along the curve over source, language and size."""
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = numbered(docs.select("doc_id", "source", "lang", (F.octet_length(text).cast("long") + 8).alias("size"),
                                F.crc32(text.cast("binary")).alias("text_crc32")))
    lined = stage(along_curve(rows, ["source", "lang", "size"]), "curve")
    placed = cut(lined, [F.col("curve"), F.col("text_crc32"), F.col("doc_id"), F.col("rid")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "curve", "source", "lang")
