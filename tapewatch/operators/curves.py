"""Running totals and ranks over a whole table without one task seeing it all.

Rows are first summed per distinct value, so ties cannot pile up. The distinct values are split by
range into ordered parts, written once so that every later pass sees the same parts, and each part is
accumulated by itself on top of the totals of the parts before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.operators.joins import counted_join
from tapewatch.session import stage


def split_by_range(steps: DataFrame, value: str, by: list[str], descending: bool) -> DataFrame:
    order = F.desc(value) if descending else F.asc(value)
    ranged = steps.repartitionByRange(*[F.asc(b) for b in by], order)
    return stage(ranged.withColumn("_part", F.spark_partition_id()), "parts")


def accumulate(parts: DataFrame, value: str, sums: list[str], by: list[str], descending: bool) -> DataFrame:
    """Add `cum_x` (up to and with this value), `total_x` and `next_x` for each summed column x."""
    order = F.desc(value) if descending else F.asc(value)
    first = F.max_by if descending else F.min_by
    totals = parts.groupBy(*by, "_part").agg(
        *[F.sum(s).alias(f"_sum_{s}") for s in sums],
        *[first(s, value).alias(f"_first_{s}") for s in sums],
    )
    line = Window.partitionBy(*by).orderBy("_part")
    offsets = totals.select(
        *by, "_part",
        *[F.coalesce(F.sum(f"_sum_{s}").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
          .alias(f"_before_{s}") for s in sums],
        *[F.sum(f"_sum_{s}").over(Window.partitionBy(*by)).alias(f"total_{s}") for s in sums],
        *[F.lead(f"_first_{s}").over(line).alias(f"_after_{s}") for s in sums],
    )
    run = Window.partitionBy(*by, "_part").orderBy(order)
    upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = parts.join(offsets, [*by, "_part"])
    return joined.select(
        *by, value, *sums,
        *[(F.col(f"_before_{s}") + F.sum(s).over(upto)).alias(f"cum_{s}") for s in sums],
        *[f"total_{s}" for s in sums],
        *[F.coalesce(F.lead(s).over(run), F.col(f"_after_{s}")).alias(f"next_{s}") for s in sums],
    )


def score_curve(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """One row per distinct score, best first: `n` rows and `pos` positives, running and in total."""
    by = by or []
    steps = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    parts = split_by_range(steps, score, by, descending=True)
    return accumulate(parts, score, ["n", "pos"], by, descending=True)


def with_rank(df: DataFrame, score: str, rank: str, by: list[str] | None = None) -> DataFrame:
    """Rank by descending score; tied rows all get the lowest rank."""
    by = by or []
    steps = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("n"))
    parts = split_by_range(steps, score, by, descending=True)
    curve = accumulate(parts, score, ["n"], by, descending=True)
    ranks = curve.select(*by, score, "n", (F.col("cum_n") - F.col("n") + 1).alias(rank))
    return counted_join(df, ranks, [*by, score], parts, "n")


def unpivot(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Columns to rows: (feature, value), values as double."""
    return df.select(*(keep or []), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        keep or [], cols, "feature", "value")
