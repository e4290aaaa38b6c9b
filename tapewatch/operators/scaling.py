"""Standard scaling fitted on control wallets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.constants import LABEL, MODEL_FEATURES
from tapewatch.session import stage

ROWS_PER_FILE = 50_000


def is_control() -> Column:
    return F.col(LABEL) == 0


def fit_scaler(profiles: DataFrame, features: list[str] = MODEL_FEATURES) -> DataFrame:
    """One row: a struct (mean, std) per feature over the controls; population deviation, 0 becomes 1."""
    stats = []
    for f in features:
        x = F.col(f).cast("double")
        std = F.coalesce(F.nullif(F.stddev_pop(x), F.lit(0.0)), F.lit(1.0))
        stats.append(F.struct(F.avg(x).alias("mean"), std.alias("std")).alias(f))
    return profiles.where(is_control()).agg(F.struct(*stats).alias("scaler"))


def scale_features(profiles: DataFrame, features: list[str] = MODEL_FEATURES,
                   keep: tuple[str, ...] = ("taker", LABEL, "case_id"), scaler: DataFrame | None = None) -> DataFrame:
    """All rows scaled by the controls' mean and deviation, or by a `scaler` fitted before."""
    fitted = fit_scaler(profiles, features) if scaler is None else scaler
    scaled = profiles.withColumn("_scaler", fitted.select("scaler").scalar())
    return scaled.select(*keep, *[
        ((F.col(f).cast("double") - F.col(f"_scaler.{f}.mean")) / F.col(f"_scaler.{f}.std")).alias(f)
        for f in features])


def model_input(profiles: DataFrame, features: list[str] = MODEL_FEATURES, scaler: DataFrame | None = None) -> DataFrame:
    """Scaled features as a stored table that the models' passes read, in files of a few seconds' work."""
    return stage(scale_features(profiles, features, scaler=scaler), "scaled", ROWS_PER_FILE)
