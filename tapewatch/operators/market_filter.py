"""Keep the trades of chosen markets, and tell which prefix a trade belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.constants import PREFIX_LENGTH
from tapewatch.functions.ids import market_prefix
from tapewatch.operators.joins import is_small, lookup_join, survey


def _starts(prefixes: DataFrame, prefix_col: str, extra: list[str]) -> DataFrame:
    return prefixes.select(F.lower(prefix_col).alias("prefix"), *extra).where("prefix <> ''")


def market_filter(trades: DataFrame, ids: DataFrame | None = None, prefixes: DataFrame | None = None,
                  id_col: str = "condition_id", prefix_col: str = "market_id_prefix") -> DataFrame:
    """Trades whose id is one of `ids` (first column) or starts with one of `prefixes`.

    Each trade comes out once however many terms match; without any term nothing does. Every term is
    a lookup of one distinct key, so `trades` is scanned once and not shuffled while the lists are small.
    """
    checks = []
    if ids is not None:
        keys = ids.select(F.lower(ids.columns[0]).alias("_k")).where("_k is not null").distinct()
        checks.append((F.lower(id_col), keys, is_small(keys)))
    if prefixes is not None:
        starts = _starts(prefixes, prefix_col, []).distinct()
        facts = survey(starts, "prefix")
        for n in facts.lengths:
            keys = starts.where(F.length("prefix") == n).select(F.col("prefix").alias("_k"))
            checks.append((market_prefix(F.col(id_col), n), keys, facts.small or None))
    if not checks:
        return trades.where(F.lit(False))
    if len(checks) == 1:
        key, keys, small = checks[0]
        return lookup_join(trades.withColumn("_k", key), keys, ["_k"], "left_semi", small=small).drop("_k")
    hit = F.lit(False)
    marked = trades
    for i, (key, keys, small) in enumerate(checks):
        marked = lookup_join(marked.withColumn("_k", key), keys.withColumn(f"_hit{i}", F.lit(True)), ["_k"], "left",
                             small=small)
        hit = hit | F.coalesce(F.col(f"_hit{i}"), F.lit(False))
    return marked.where(hit).select(*[F.col(f"`{c}`") for c in trades.columns])


def route_prefix(trades: DataFrame, prefixes: DataFrame, order_col: str, id_col: str = "condition_id",
                 prefix_col: str = "market_id_prefix", out: str = "routed_prefix") -> DataFrame:
    """The first prefix in list order that the id starts with, else its first ten characters."""
    listed = _starts(prefixes, prefix_col, [order_col]).groupBy("prefix").agg(F.min(order_col).alias("ord"))
    routed, found = trades, []
    facts = survey(listed, "prefix")
    for n in facts.lengths:
        keys = listed.where(F.length("prefix") == n).select(
            F.col("prefix").alias("_k"), F.struct("ord", "prefix").alias(f"_first{n}"))
        keyed = routed.withColumn("_k", market_prefix(F.col(id_col), n))
        routed = lookup_join(keyed, keys, ["_k"], "left", small=facts.small or None).drop("_k")
        found.append(F.col(f"_first{n}"))
    if not found:
        return routed.withColumn(out, market_prefix(F.col(id_col), PREFIX_LENGTH))
    first = found[0] if len(found) == 1 else F.least(*found)
    chosen = F.coalesce(first["prefix"], market_prefix(F.col(id_col), PREFIX_LENGTH))
    return routed.select(*[F.col(f"`{c}`") for c in trades.columns], chosen.alias(out))
