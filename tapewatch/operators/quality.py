"""Checks that stop a run on bad data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class QualityError(ValueError):
    """A table failed its checks; `counts` tells how."""

    def __init__(self, message: str, counts: dict[str, int]):
        super().__init__(f"{message}: {counts}")
        self.counts = counts


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: number of rows, and NULL or NaN values per column."""
    aggs = [F.count("*").alias("row_count")]
    for field in df.schema:
        missing = F.col(f"`{field.name}`").isNull()
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            missing = missing | F.isnan(f"`{field.name}`")
        aggs.append(F.count_if(missing).alias(field.name))
    return df.agg(*aggs)


def require_complete(df: DataFrame, what: str = "profiles") -> DataFrame:
    """`df` itself, or QualityError when it is empty or has missing values."""
    counts = missing_counts(df).first().asDict()
    if counts.pop("row_count") == 0:
        raise QualityError(f"{what} is empty", {})
    bad = {c: n for c, n in counts.items() if n}
    if bad:
        raise QualityError(f"{what} has missing values", bad)
    return df
