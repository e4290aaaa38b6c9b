"""Trade tables derived from the `events` table; `oracles.py` holds the same definitions as SQL."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.functions.ids import market_prefix
from tapewatch.sources.trades import scan_trades

#: Every `BLOCK` events have `MARKETS` markets of their own, of which the first `LEAKED` are leaked.
BLOCK = 5_000
MARKETS = 97
LEAKED = 32
FIRST_NEWS = 1_704_412_800
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


def _hex(*parts: Column) -> Column:
    return F.concat(F.lit("0x"), F.md5(F.concat(*parts)))


def market_number(e: Column) -> Column:
    return e % MARKETS + MARKETS * F.floor(e / F.lit(BLOCK))


def is_leaked(m: Column) -> Column:
    return m % MARKETS < LEAKED


def case_number(m: Column) -> Column:
    return m % MARKETS % 8 + 8 * F.floor(m / F.lit(MARKETS))


def market_columns(m: Column) -> dict[str, Column]:
    """All columns of market number `m`."""
    cid = _hex(F.lit("mkt-"), m.cast("string"))
    kind = m % MARKETS % 8 % 3
    news = F.lit(FIRST_NEWS) + m % MARKETS * 21600
    return {
        "condition_id": cid,
        "market_id_prefix": F.substring(cid, 1, 10),
        "is_leaked": F.when(is_leaked(m), 1).otherwise(0),
        "case_id": F.when(is_leaked(m), F.concat(F.lit("case-"), case_number(m).cast("string"))).otherwise(""),
        "category": F.when(kind == 0, "regulatory_decision").when(kind == 1, "military_geopolitics")
        .otherwise("corporate_disclosure"),
        "tag": F.when(kind == 0, "Politics").when(kind == 1, "World").otherwise("Business"),
        "news_timestamp": news,
        "window_start_24h": news - 86400,
        "window_start_48h": news - 172800,
    }


def events(spark: SparkSession, sf: str) -> DataFrame:
    return scan_trades(spark, os.path.join(sf, "events.parquet"), schema=EVENT_SCHEMA)


def fx_markets(spark: SparkSession, sf: str) -> DataFrame:
    m = events(spark, sf).select(market_number(F.col("event_id")).alias("m")).distinct()
    return m.select("m", *[c.alias(n) for n, c in market_columns(F.col("m")).items()])


def trades_of(source: DataFrame) -> DataFrame:
    """Events as trades. The market follows from the event number, so nothing needs joining."""
    m, e = F.col("m"), F.col("event_id")
    k = market_columns(m)
    buys = F.col("event_type").isin("purchase", "signup")
    day = F.date_add(F.lit("2024-01-05").cast("date"), F.floor(m % MARKETS / F.lit(4)).cast("int"))
    return source.withColumn("m", market_number(e)).select(
        e.alias("trade_id"),
        F.when(m % 2 == 0, F.upper(k["condition_id"])).otherwise(k["condition_id"]).alias("condition_id"),
        _hex(F.lit("usr-"), F.col("user_id").cast("string"), F.lit("-"), (e % 2).cast("string")).alias("taker"),
        F.when(e % 53 == 0, None).otherwise(F.col("value")).alias("usdc_amount"),
        F.when(buys, 1).otherwise(-1).alias("D"),
        F.when(buys, "BUY").otherwise("SELL").alias("taker_direction"),
        F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("block_timestamp"),
        F.col("ts").cast("date").alias("trade_date"),
        F.when(e % 11 == 0, None).otherwise(k["tag"]).alias("category"),
        F.concat(F.lit("market-"), m.cast("string")).alias("market_slug"),
        F.when(m % 10 == 7, None).when(m % 10 == 3, day.cast("string"))
        .otherwise(k["news_timestamp"].cast("string")).alias("resolved_at"),
    )


def fx_trades(spark: SparkSession, sf: str) -> DataFrame:
    return trades_of(events(spark, sf))


def fx_cases(spark: SparkSession, sf: str) -> DataFrame:
    """The inventory as the reader gives it: one row per case with its markets in order."""
    k = fx_markets(spark, sf).where(is_leaked(F.col("m")))
    m = F.col("m")
    market = F.struct(
        m.alias("m"),
        F.when(m % 2 == 0, F.upper("market_id_prefix")).otherwise(F.col("market_id_prefix")).alias("market_id_prefix"),
        F.concat(F.lit("Market "), m.cast("string")).alias("label"),
        F.when(m % 4 == 0, F.col("news_timestamp").cast("string")).when(m % 4 == 1, "2024-01-08T12:00:00Z")
        .when(m % 4 == 2, "2024-01-08").otherwise("").alias("resolution_date"),
        F.when(m % 3 == 0, "YES").when(m % 3 == 1, "NO").otherwise("INVALID").alias("resolution_outcome"),
        F.when(m % 5 == 0, "false").when(m % 5 == 1, "partial").otherwise("true").alias("trade_history_available"),
    )
    grouped = k.groupBy("case_id", case_number(m).alias("c"), "category").agg(F.sort_array(F.collect_list(market)).alias("ms"))
    return grouped.select(
        "case_id", F.concat(F.lit("Case "), F.col("c").cast("string")).alias("title"), F.lit("2024-01-09").alias("date"),
        "category", F.transform("ms", lambda x: x.dropFields("m")).alias("markets"))


def fx_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("m")
    return fx_markets(spark, sf).where(m % 7 != 0).select(
        F.when(m % 3 == 0, F.upper("condition_id")).otherwise(F.col("condition_id")).alias("condition_id"),
        F.when(m % 5 == 0, None).when(m % 2 == 0, F.array(F.lit(1), F.lit(0)))
        .otherwise(F.array(F.lit(0), F.lit(1))).alias("payout_numerators"),
        F.concat(F.lit("q-"), m.cast("string")).alias("question_id"), F.lit("oracle-a").alias("oracle"))


def fx_index(spark: SparkSession, sf: str) -> DataFrame:
    """The markets as a finished index."""
    return fx_markets(spark, sf).select(
        "market_id_prefix", "condition_id", "is_leaked", "case_id",
        F.when(is_leaked(F.col("m")), F.concat(F.lit("Case "), case_number(F.col("m")).cast("string"))).otherwise("")
        .alias("case_title"), "category", "news_timestamp", "window_start_24h", "window_start_48h",
        F.when(~is_leaked(F.col("m")), "").when(F.col("m") % 3 == 0, "YES").when(F.col("m") % 3 == 1, "NO")
        .otherwise("INVALID").alias("resolution_outcome"),
        (~is_leaked(F.col("m")) | (F.col("m") % 5 != 0)).alias("trade_available"))


def fx_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Full ids are known for every other leaked market."""
    return fx_markets(spark, sf).where(is_leaked(F.col("m")) & (F.col("m") % 2 == 0)).select(
        "market_id_prefix", "condition_id")


def fx_scores(spark: SparkSession, sf: str) -> DataFrame:
    k = fx_markets(spark, sf).select("market_id_prefix", "is_leaked", "case_id", "window_start_48h", "news_timestamp")
    t = fx_trades(spark, sf).select(
        "taker", "usdc_amount", "block_timestamp", market_prefix(F.col("condition_id")).alias("market_id_prefix"))
    inside = (F.col("block_timestamp") >= F.col("window_start_48h")) & (F.col("block_timestamp") < F.col("news_timestamp"))
    return t.join(k, "market_id_prefix").where(inside).groupBy("taker").agg(
        F.max("is_leaked").alias("is_leaked_market"), F.min("case_id").alias("case_id"),
        F.round(F.log(1 + F.sum(F.coalesce("usdc_amount", F.lit(0.0)))), 6).alias("score_a"),
        F.count("*").cast("double").alias("score_b"))
