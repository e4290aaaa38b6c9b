"""Trades in the window before the news."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tapewatch.constants import PREFIX_LENGTH
from tapewatch.functions.timestamps import utc_date
from tapewatch.operators.joins import prefix_join, survey

WINDOW_24H = "window_start_24h"
WINDOW_48H = "window_start_48h"


def prenews_trades(trades: DataFrame, index: DataFrame, window_col: str = WINDOW_48H,
                   date_col: str | None = None, prefix_col: str | None = None) -> DataFrame:
    """Trades of indexed markets with window start <= block_timestamp < news_timestamp.

    A trade that falls under several index rows is repeated. The index columns replace columns of the
    same name in `trades`; `resolved_at` and `category` are dropped when present. The span of all
    windows reaches the scan as a plain filter on time, which skips row groups. Name the table's partition
    column of UTC days in `date_col` to skip whole days, or that of ten-character market prefixes in
    `prefix_col` to skip whole markets.
    """
    taken = ["is_leaked", "case_id", "case_title", "news_timestamp", "market_id_prefix"]
    have = [c for c in taken if c in index.columns]
    dim = index.select(*have, F.col(window_col).cast("long").alias("window_start"))
    facts = survey(dim, "market_id_prefix", first=F.min("window_start"), last=F.max("news_timestamp"))
    if facts.first is None or facts.last is None:
        return _joined(trades.where(F.lit(False)), dim, have, taken, facts)
    time = F.col("block_timestamp")
    spanned = trades.where((time >= facts.first) & (time < facts.last))
    if date_col is not None:
        ends = [utc_date(F.lit(facts.first)), utc_date(F.lit(facts.last - 1))]
        spanned = spanned.where(F.col(date_col).between(*ends))
    if prefix_col is not None and facts.lengths == [PREFIX_LENGTH]:
        # The filter makes the planner prune the partitions by this join, for any number of markets.
        listed = dim.select(F.col("market_id_prefix").alias("_listed")).where(F.length("_listed") > 0).distinct()
        spanned = spanned.join(listed, F.col(prefix_col) == F.col("_listed"), "left_semi")
    return _joined(spanned, dim, have, taken, facts)


def _joined(trades: DataFrame, dim: DataFrame, have: list[str], taken: list[str], facts: Row) -> DataFrame:
    trades = trades.drop("resolved_at", "category", "window_start", *taken)
    in_window = (F.col("block_timestamp") >= F.col("window_start")) & (
        F.col("block_timestamp") < F.col("news_timestamp"))
    spread = [c for c in ("taker", "block_timestamp", "usdc_amount") if c in trades.columns]
    joined = prefix_join(trades, dim, "condition_id", "market_id_prefix", in_window, facts=facts, spread=spread)
    return joined.select(*[F.col(f"`{c}`") for c in trades.columns], *have, "window_start")


def mins_before_news(trades: DataFrame, out: str = "mins_before_news") -> DataFrame:
    return trades.withColumn(out, (F.col("news_timestamp") - F.col("block_timestamp")) / F.lit(60.0))
