"""One behavioural profile per wallet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.constants import EPS, LABEL, PROFILE_FEATURES


def buy_flag(trades: DataFrame) -> Column:
    """1 for a buy, else 0 (NULL is no buy); 0.5 when the table has no direction column."""
    if "D" in trades.columns:
        is_buy = F.col("D") == 1
    elif "taker_direction" in trades.columns:
        is_buy = F.col("taker_direction") == "BUY"
    else:
        return F.lit(0.5)
    return F.when(is_buy, F.lit(1.0)).otherwise(F.lit(0.0))


def amount() -> Column:
    return F.coalesce(F.col("usdc_amount").cast("double"), F.lit(0.0))


def hhi(volume: Column) -> Column:
    """Sum of squared volume shares over the grouped rows; 0 when there is no volume."""
    total = F.sum(volume)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.sum(volume * volume) / F.nullif(total * total, F.lit(0.0)))


def volume_by_market(trades: DataFrame) -> DataFrame:
    """Traded volume per (taker, market)."""
    return trades.where("taker is not null and condition_id is not null").groupBy(
        "taker", F.lower("condition_id").alias("condition_id")).agg(F.sum(amount()).alias("volume"))


def trader_hhi(trades: DataFrame) -> DataFrame:
    return volume_by_market(trades).groupBy("taker").agg(hhi(F.col("volume")).alias("market_concentration_hhi"))


def unique_markets(trades: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct markets per wallet, NULL ids not counted."""
    market = F.lower("condition_id")
    named = trades.where("taker is not null")
    if approximate:
        return named.groupBy("taker").agg(F.approx_count_distinct(market).alias("unique_markets"))
    pairs = named.groupBy("taker", market.alias("condition_id")).agg(F.lit(1).alias("one"))
    return pairs.groupBy("taker").agg(F.count("condition_id").alias("unique_markets"))


def buy_fraction(trades: DataFrame, keys: tuple[str, ...] = ("taker", "is_leaked")) -> DataFrame:
    named = trades.where("taker is not null")
    return named.groupBy(*keys).agg(F.avg(buy_flag(trades)).alias("buy_fraction"))


def build_profiles(trades: DataFrame, timing: str = "first_market") -> DataFrame:
    """Thirteen features, label and case for every wallet with pre-news trades.

    Trades are summed per (taker, market) before they meet per taker, so neither a busy wallet nor a
    busy market ends up raw in one task, and both sums stay hash aggregates over plain numbers.

    A wallet's case and news time are those of its first market: that of its earliest trade, ties in
    order of market id, news time and case. `timing="per_trade"` measures each trade against its own
    news and takes the shortest time instead.
    """
    has_case = "case_id" in trades.columns
    case = F.coalesce(F.col("case_id"), F.lit("")) if has_case else F.lit("")
    rows = trades.where("taker is not null").select(
        "taker", F.lower("condition_id").alias("condition_id"), case.alias("case_id"),
        F.col("is_leaked").cast("int").alias("is_leaked"), F.col("news_timestamp").cast("long").alias("news_timestamp"),
        F.col("block_timestamp").cast("long").alias("ts"), amount().alias("amount"), buy_flag(trades).alias("buy"),
    )
    entries = rows.groupBy("taker", "condition_id", "case_id", "is_leaked", "news_timestamp").agg(
        F.sum("amount").alias("volume"), F.max("amount").alias("largest"), F.count("*").alias("trades"),
        F.sum("buy").alias("buys"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    # From here on a wallet has at most one row per index entry; one exchange serves both groupings.
    first = F.struct("first_ts", "condition_id", "news_timestamp", "case_id")
    markets = entries.repartition("taker").groupBy("taker", "condition_id").agg(
        F.sum("volume").alias("volume"), F.max("largest").alias("largest"), F.sum("trades").alias("trades"),
        F.sum("buys").alias("buys"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.max("is_leaked").alias("is_leaked"), F.min(first).alias("first"),
        F.min(F.col("news_timestamp") - F.col("last_ts")).alias("shortest"),
    )
    named = F.when(F.col("condition_id").isNotNull(), F.col("volume"))
    wallets = markets.groupBy("taker").agg(
        F.max("is_leaked").alias(LABEL), F.min("first").alias("first"),
        F.sum("volume").alias("total_volume_usdc"), F.max("largest").alias("max_bet_usdc"),
        F.sum("trades").alias("trade_count"), F.sum("buys").alias("buys"),
        F.count("condition_id").alias("unique_markets"),
        F.coalesce(hhi(named), F.lit(0.0)).alias("market_concentration_hhi"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min("shortest").alias("shortest"),
    )
    ahead = F.col("shortest") if timing == "per_trade" else F.col("first.news_timestamp") - F.col("last_ts")
    features = wallets.withColumns({
        "case_id": F.col("first.case_id"),
        "avg_bet_usdc": F.col("total_volume_usdc") / F.col("trade_count"),
        "direction_bias": F.col("buys") / F.col("trade_count"),
        "time_to_news_min": ahead / F.lit(60.0),
        "time_span_hours": (F.col("last_ts") - F.col("first_ts")) / F.lit(3600.0),
        "log_total_volume": F.log1p("total_volume_usdc"),
        "log_max_bet": F.log1p("max_bet_usdc"),
        "log_trade_count": F.log1p(F.col("trade_count").cast("double")),
    }).withColumn("bet_size_ratio", F.col("max_bet_usdc") / (F.col("avg_bet_usdc") + F.lit(EPS)))
    return features.select("taker", LABEL, "case_id", *PROFILE_FEATURES)
