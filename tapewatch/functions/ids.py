"""Market identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.constants import PREFIX_LENGTH


def normalise_id(col: Column) -> Column:
    """Identifiers compare without regard to case."""
    return F.lower(col)


def market_prefix(col: Column, length: int = PREFIX_LENGTH) -> Column:
    """The first characters, lower-cased; cut first, which is cheaper on every trade."""
    return F.lower(F.substring(col, 1, length))


def prefix_lengths(dim: DataFrame, prefix: str) -> list[int]:
    """The distinct prefix lengths in use. An identifier has 66 characters, so the list is short."""
    rows = dim.select(F.length(prefix).alias("n")).where("n > 0").distinct().collect()
    return sorted(r.n for r in rows)


def prefix_keys(id_col: Column, lengths: list[int], with_id: bool = False) -> Column:
    """Every start of the identifier that could equal a prefix, as a duplicate-free array."""
    starts = [market_prefix(id_col, n) for n in lengths]
    if with_id:
        starts.append(F.lower(id_col))
    return F.array_distinct(F.array(*starts))
