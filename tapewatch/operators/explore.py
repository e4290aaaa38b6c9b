"""Tables behind the exploratory plots."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.constants import PROFILE_FEATURES
from tapewatch.operators.curves import unpivot
from tapewatch.operators.joins import lookup_join
from tapewatch.operators.selection import exact_quantiles, first_counts, quantiles_of
from tapewatch.session import stage


def category_crosstab(index: DataFrame) -> DataFrame:
    """Markets per category, one column per label; 0 where there are none."""
    return index.groupBy("category").agg(
        F.count_if(F.col("is_leaked") == 0).alias("n_control"), F.count_if(F.col("is_leaked") == 1).alias("n_leaked"))


def market_date_range(index: DataFrame) -> DataFrame:
    """First and last news time, as UTC timestamps."""
    return index.agg(
        F.timestamp_seconds(F.min("news_timestamp")).alias("first_news"),
        F.timestamp_seconds(F.max("news_timestamp")).alias("last_news"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """One row: leaked, control and total."""
    return df.agg(F.count_if(F.col(label) == 1).alias("n_leaked"), F.count_if(F.col(label) == 0).alias("n_control"),
                  F.count("*").alias("n_total"))


def stage_counts(trades: DataFrame) -> DataFrame:
    """Trades, wallets, and trades of leaked markets."""
    takers = trades.groupBy("taker").agg(F.count("*").alias("n"), F.sum("is_leaked").alias("leaked"))
    return takers.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_trades"), F.count("taker").alias("n_takers"),
        F.coalesce(F.sum("leaked"), F.lit(0)).alias("n_leaked_trades"))


def describe_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, exact quartiles and max per numeric column.

    The columns are staged and read three times: moments come with the first counts of the quartiles.
    """
    if cols is None:
        cols = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    table = stage(df.select(*[F.col(f"`{c}`") for c in cols]), "described")
    value = F.col("value")
    first = first_counts(table, cols, F.avg(value).alias("part_mean"), F.var_pop(value).alias("part_var"),
                         F.min(value).alias("low"), F.max(value).alias("high"))
    # Parts to the whole: deviations within the parts, and of the parts' means.
    n, mean = F.col("n"), F.col("part_mean")
    whole = first.groupBy("feature").agg(
        F.sum("n").alias("n"), (F.sum(n * mean) / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.min("low").alias("min"),
        F.max("high").alias("max"))
    gap = first.join(F.broadcast(whole.select("feature", F.col("mean").alias("all"))), "feature")  # a row per column
    spread = gap.groupBy("feature").agg(F.sum(n * (F.col("part_var") + (mean - F.col("all")) ** 2)).alias("m2"))
    quartiles = quantiles_of(table, first, [0.25, 0.5, 0.75]).groupBy("feature").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name)
        for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    std = F.when(n > 1, F.sqrt(F.col("m2") / (n - 1)))
    return whole.join(spread, "feature").join(quartiles, "feature", "left").select(
        "feature", "n", "mean", std.alias("std"), "min", "q25", "q50", "q75", "max")


def feature_corr(df: DataFrame, cols: list[str] = PROFILE_FEATURES) -> DataFrame:
    """Pearson correlations of all pairs, both ways: (f1, f2, r); NULL for constants."""
    vectors = VectorAssembler(inputCols=cols, outputCol="vector").transform(df.select(*cols)).select("vector")
    matrix = Correlation.corr(vectors, "vector").first()[0].toArray()
    rows = [(a, b, None if math.isnan(matrix[i, j]) else float(matrix[i, j]))
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "f1 string, f2 string, r double")


def histogram(df: DataFrame, value: str, keys: list[str], bins: int, low: Column | float | None = None,
              high: Column | float | None = None) -> DataFrame:
    """Equal-width bins over each group's own range: (keys, bin, lo, hi, n, density); empty bins included.

    `low` and `high` clip the values first. The last bin is closed; a single value gets a range of one.
    """
    v = F.col(value).cast("double")
    if low is not None:
        v = F.greatest(v, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        v = F.least(v, high if isinstance(high, Column) else F.lit(float(high)))
    rows = df.where(F.col(value).isNotNull()).select(*keys, v.alias("v"))
    span = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    flat = F.col("lo") == F.col("hi")
    span = stage(span.select(
        *keys, "total", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")), "span")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    placed = lookup_join(rows, span, keys).withColumn(
        "bin", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("lo") + F.col("bin") * width).alias("lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"), n.alias("n"),
        (n / (F.col("total") * width)).alias("density"))


def feature_histogram(profiles: DataFrame, label: str, cols: list[str] = PROFILE_FEATURES, bins: int = 30,
                      tails: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Histograms of all features per label, clipped at quantiles taken over both labels."""
    bounds = exact_quantiles(profiles, cols, list(tails)).groupBy("feature").agg(
        F.max(F.when(F.col("prob") == tails[0], F.col("quantile"))).alias("low"),
        F.max(F.when(F.col("prob") == tails[1], F.col("quantile"))).alias("high"))
    # The bounds table has one row per named column.
    long = unpivot(profiles, cols, [label]).join(F.broadcast(bounds), "feature")
    return histogram(long, "value", ["feature", label], bins, F.col("low"), F.col("high"))
