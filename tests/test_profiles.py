import math

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from tapewatch.constants import PROFILE_FEATURES
from tapewatch.operators import profiles
from tapewatch.operators.quality import QualityError, require_complete

SCHEMA = ("taker string, condition_id string, usdc_amount double, D int, block_timestamp long, "
          "news_timestamp long, is_leaked int, case_id string")


def trades(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def profile(spark, *data):
    got = profiles.build_profiles(trades(spark, *data)).collect()
    assert len(got) == 1
    return got[0].asDict()


def test_one_trade(spark):
    p = profile(spark, ("w", "0xA", 100.0, 1, 940, 1000, 1, "c"))
    assert list(p) == ["taker", "is_leaked_market", "case_id", *PROFILE_FEATURES]
    assert (p["total_volume_usdc"], p["avg_bet_usdc"], p["max_bet_usdc"]) == (100.0, 100.0, 100.0)
    assert (p["direction_bias"], p["unique_markets"], p["market_concentration_hhi"], p["trade_count"]) == (1.0, 1, 1.0, 1)
    assert (p["time_to_news_min"], p["time_span_hours"]) == (1.0, 0.0)
    assert p["bet_size_ratio"] == pytest.approx(1.0) and p["log_max_bet"] == pytest.approx(math.log1p(100))
    assert (p["is_leaked_market"], p["case_id"]) == (1, "c")


def test_missing_amounts_and_directions(spark):
    p = profile(spark, ("w", "0xA", None, None, 100, 1000, 0, ""), ("w", "0xA", None, 1, 200, 1000, 0, ""))
    assert (p["total_volume_usdc"], p["market_concentration_hhi"], p["direction_bias"]) == (0.0, 0.0, 0.5)
    assert (p["bet_size_ratio"], p["log_total_volume"]) == (0.0, 0.0)


def test_null_wallet_and_null_market(spark):
    df = trades(spark, (None, "0xA", 1.0, 1, 1, 10, 0, ""), ("w", None, 5.0, 1, 1, 10, 0, ""), ("w", "0xA", 1.0, 1, 1, 10, 0, ""))
    got = profiles.build_profiles(df)
    assert rows(got, "taker", "unique_markets", "market_concentration_hhi", "trade_count") == [("w", 1, 1.0, 2)]
    assert rows(profiles.unique_markets(df)) == [("w", 1)]
    assert rows(profiles.unique_markets(df, approximate=True)) == [("w", 1)]


def test_two_markets(spark):
    p = profile(spark, ("w", "0xa", 30.0, -1, 300, 4000, 0, ""), ("w", "0xA", 30.0, 1, 3900, 4000, 0, ""),
                ("w", "0xb", 40.0, 1, 200, 9000, 1, "c1"))
    assert p["unique_markets"] == 2 and p["market_concentration_hhi"] == pytest.approx(0.36 + 0.16)
    # First market is 0xb (earliest trade); the last trade is in the other one.
    assert (p["case_id"], p["is_leaked_market"]) == ("c1", 1)
    assert p["time_to_news_min"] == pytest.approx((9000 - 3900) / 60)
    assert p["direction_bias"] == pytest.approx(2 / 3)


def test_timing_per_trade(spark):
    df = trades(spark, ("w", "0xa", 1.0, 1, 100, 160, 0, ""), ("w", "0xb", 1.0, 1, 400, 1000, 0, ""))
    assert rows(profiles.build_profiles(df), "time_to_news_min") == [(-4.0,)]
    assert rows(profiles.build_profiles(df, timing="per_trade"), "time_to_news_min") == [(1.0,)]


def test_market_in_index_twice_counts_once_for_concentration(spark):
    p = profile(spark, ("w", "0xa", 10.0, 1, 100, 1000, 1, "c"), ("w", "0xa", 10.0, 1, 100, 1000, 0, ""),
                ("w", "0xb", 20.0, 1, 500, 1000, 0, ""))
    assert p["unique_markets"] == 2 and p["trade_count"] == 3
    assert p["market_concentration_hhi"] == pytest.approx(0.5)


def test_direction_columns(spark):
    df = spark.createDataFrame([("w", "BUY", 1), ("w", None, None)], "taker string, taker_direction string, D int")
    for table, expected in ((df.drop("D"), 0.5), (df.drop("taker_direction"), 0.5), (df.select("taker"), 0.5)):
        assert table.agg(F.avg(profiles.buy_flag(table))).first()[0] == expected
    assert rows(df.select("taker").select(profiles.buy_flag(df.select("taker")).alias("b"))) == [(0.5,), (0.5,)]


def test_raw_trades_meet_a_hash_aggregate(spark):
    text = plan(profiles.build_profiles(trades(spark, ("w", "0xa", 1.0, 1, 1, 2, 0, ""))))
    partial = [line for line in text.splitlines() if "partial_count(1)" in line]
    assert partial and all("HashAggregate" in line for line in partial)


def test_quality(spark):
    good = spark.createDataFrame([("w", 1.0)], "taker string, x double")
    assert require_complete(good) is good
    with pytest.raises(QualityError) as error:
        require_complete(spark.createDataFrame([("w", float("nan")), (None, None)], "taker string, x double"))
    assert error.value.counts == {"taker": 1, "x": 2}
    with pytest.raises(QualityError):
        require_complete(good.where("false"))
