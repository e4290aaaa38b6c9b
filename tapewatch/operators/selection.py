"""Exact order statistics by radix histograms.

A double becomes a whole number of 64 bits that orders as it does. A first pass counts rows per leading 20 bits, a
second one the next 22 bits of the rows that share the leading bits of a wanted place, a third one the last 22. So a
table is read three times for any number of columns and places, and no value is shuffled, only counts: at most 2^22 per
place, in fact far fewer. What reaches the driver are some numbers per place.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewatch.session import stage

#: Bits that the second and the third pass tell apart, each.
DIGIT = 22
LEAST_NORMAL = 2.0 ** -1022


def order_key(value: Column) -> Column:
    """A double as a long in the same order; both zeros are equal, NaN is the largest."""
    size = F.abs(value)
    guess = F.floor(F.log2(size))
    power = F.pow(F.lit(2.0), guess)
    # The logarithm is rounded, powers of two are exact.
    exponent = guess + F.when(size < power, -1).when(size / 2.0 >= power, 1).otherwise(0)
    one = 1 << 52
    part = ((size / F.pow(F.lit(2.0), exponent) - 1.0) * F.lit(float(one))).cast("long")
    bits = (
        F.when(F.isnan(value), F.lit(2047 * one + one // 2))
        .when(size == float("inf"), F.lit(2047 * one))
        .when(size < LEAST_NORMAL, (size * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long"))
        .when(value.isNotNull(), (exponent + 1023) * F.lit(one) + part))
    return F.when(value < 0, -bits).otherwise(bits)


def value_of(key: int) -> float:
    """The double that a key stands for."""
    (size,) = struct.unpack(">d", abs(key).to_bytes(8, "big"))
    return -size if key < 0 else size


def first_counts(df: DataFrame, cols: list[str], *more: Column) -> DataFrame:
    """(feature, digit, n) of the leading bits per column, with further aggregates of `value`; NULLs have no digit."""
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    digit = F.shiftright(order_key(F.col("value")), 2 * DIGIT).alias("digit")
    return stage(long.groupBy("feature", digit).agg(F.count("value").alias("n"), *more), "digits")


def _placed(spark: SparkSession, counts: DataFrame, wanted: list[tuple[str, int]]) -> list[tuple[int, int]]:
    """For each (group, place) the digit that holds the place, and the place among the rows of that digit."""
    before = Window.partitionBy("group").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    places = F.broadcast(spark.createDataFrame(  # some per column
        [(i, group, place) for i, (group, place) in enumerate(wanted)], "i int, of string, place long"))
    inside = (F.col("group") == F.col("of")) & (F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + F.col("n"))
    found = {r.i: (r.digit, r.left) for r in below.join(places, inside).select(
        "i", "digit", (F.col("place") - F.col("below")).alias("left")).collect()}
    return [found[i] for i in range(len(wanted))]


def order_statistics(df: DataFrame, first: DataFrame, wanted: list[tuple[str, int]]) -> list[float]:
    """The value at each (feature, place), places from 0 over the known values in ascending order.

    `first` are the counts of the leading bits of these features.
    """
    if not wanted:
        return []
    spark = df.sparkSession
    counts = first.where(F.col("digit").isNotNull()).select(F.col("feature").alias("group"), "digit", "n")
    placed = _placed(spark, counts, wanted)
    for level in (1, 0):
        # Rows with the leading bits found so far, counted by their next bits.
        groups = sorted({(feature, lead) for (feature, _), (lead, _) in zip(wanted, placed)})
        names = {feature: f"key{i}" for i, feature in enumerate(sorted({f for f, _ in groups}))}
        keys = df.select(*[order_key(F.col(f"`{feature}`").cast("double")).alias(name) for feature, name in names.items()])
        hits = [F.when(F.shiftright(names[feature], (level + 1) * DIGIT) == lead, F.struct(
            F.lit(str(i)).alias("group"),
            F.shiftright(names[feature], level * DIGIT).bitwiseAND((1 << DIGIT) - 1).alias("digit")))
            for i, (feature, lead) in enumerate(groups)]
        counts = keys.select(F.explode(F.array_compact(F.array(*hits))).alias("hit")).groupBy("hit.group", "hit.digit").agg(
            F.count("*").alias("n"))
        number = {group: str(i) for i, group in enumerate(groups)}
        asked = [(number[feature, lead], place) for (feature, _), (lead, place) in zip(wanted, placed)]
        placed = [((lead << DIGIT) + digit, place)
                  for (lead, _), (digit, place) in zip(placed, _placed(spark, counts, asked))]
    return [value_of(key) for key, _ in placed]


def quantiles_of(df: DataFrame, first: DataFrame, probs: list[float]) -> DataFrame:
    """Linear-interpolation quantiles of the features counted in `first`: (feature, prob, quantile)."""
    totals = {r.feature: r.n for r in first.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    at = [(feature, float(p), float(p) * (n - 1)) for feature, n in sorted(totals.items()) if n for p in probs]
    wanted = [(feature, end(x)) for feature, _, x in at for end in (math.floor, math.ceil)]
    found = order_statistics(df, first, wanted)
    rows = [(feature, p, low if low == high else low + (high - low) * (x - math.floor(x)))
            for (feature, p, x), low, high in zip(at, found[::2], found[1::2])]
    return df.sparkSession.createDataFrame(rows, "feature string, prob double, quantile double")


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Linear-interpolation quantiles of several columns: (feature, prob, quantile), NULLs left out.

    The table is read three times; stage it where it is dear to compute.
    """
    return quantiles_of(df, first_counts(df, cols), probs)
