"""Repeatable samples and splits, by hash of the wallet instead of a random stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.operators.scaling import is_control

# Seed, share held out for validation, most controls in an evaluation set.
SEED = 42
VALIDATION_SHARE = 0.2
SAMPLE_SIZE = 5_000


def _digest(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col("taker")))


def sample_controls(profiles: DataFrame, size: int | None = SAMPLE_SIZE, seed: int = SEED,
                    by: list[str] | None = None) -> DataFrame:
    """At most `size` control wallets (per group): those with the least digests; all of them without a size."""
    controls = profiles.where(is_control())
    if size is None:
        return controls
    if not by:
        return controls.orderBy(_digest(seed), "taker").limit(size)
    window = Window.partitionBy(*by).orderBy(_digest(seed), "taker")
    return controls.withColumn("_place", F.row_number().over(window)).where(F.col("_place") <= size).drop("_place")


def split_controls(profiles: DataFrame, share: float = VALIDATION_SHARE, seed: int = SEED) -> DataFrame:
    """Control wallets with `is_validation`, true for about `share` of them."""
    slot = F.conv(F.substring(_digest(seed), 1, 7), 16, 10).cast("long")
    return profiles.where(is_control()).withColumn("is_validation", slot < F.lit(int(share * 16**7)))
