import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from tapewatch.operators import joins
from tapewatch.operators.market_filter import market_filter, route_prefix
from tapewatch.operators.market_index import matching_controls, near_news, not_leaked, select_controls
from tapewatch.operators.prenews import mins_before_news, prenews_trades
from tapewatch.operators.resolutions import match_resolutions, resolution_consistency, validate_resolutions

P1, P2 = "0xaaaaaaaa", "0xbbbbbbbb"
INDEX = "market_id_prefix string, is_leaked int, case_id string, case_title string, news_timestamp long, " \
        "window_start_24h long, window_start_48h long"
TRADES = "trade_id int, condition_id string, taker string, block_timestamp long, category string"


@pytest.fixture(params=["broadcast", "salted"])
def mode(request, monkeypatch):
    if request.param == "salted":
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    return request.param


def small_index(spark, *extra):
    return spark.createDataFrame([(P1, 1, "c1", "Case", 1000, 600, 200), *extra], INDEX)


def small_trades(spark, *times, cid=P1.upper().replace("X", "x") + "01"):
    return spark.createDataFrame([(i, cid, "w", t, "cat") for i, t in enumerate(times)], TRADES)


def test_window_is_half_open(spark, mode):
    trades = small_trades(spark, 199, 200, 999, 1000)
    got = prenews_trades(trades, small_index(spark))
    assert rows(got, "block_timestamp", "window_start") == [(200, 200), (999, 200)]
    assert "category" not in got.columns
    assert rows(prenews_trades(trades, small_index(spark), "window_start_24h"), "block_timestamp") == [(999,)]


def test_trade_under_two_index_rows_is_repeated(spark, mode):
    index = small_index(spark, (P1, 0, "", "", 900, 500, 100))
    got = prenews_trades(small_trades(spark, 150, 700), index)
    assert rows(got, "block_timestamp", "is_leaked") == [(150, 0), (700, 0), (700, 1)]


def test_prefixes_of_several_lengths(spark, mode):
    index = small_index(spark, ("0xaaaa", 0, "", "", 1000, 600, 200))
    got = prenews_trades(small_trades(spark, 500), index)
    assert rows(got, "market_id_prefix") == [("0xaaaa",), (P1,)]
    short = small_trades(spark, 500, cid="0xAAAA")
    assert rows(prenews_trades(short, index), "market_id_prefix") == [("0xaaaa",)]


def test_null_ids_and_empty_index(spark, mode):
    trades = small_trades(spark, 500, cid=None)
    assert prenews_trades(trades, small_index(spark)).count() == 0
    assert prenews_trades(small_trades(spark, 500), small_index(spark).where("false")).count() == 0


def test_minutes_before_news(spark):
    df = spark.createDataFrame([(1000, 910)], "news_timestamp long, block_timestamp long")
    assert rows(mins_before_news(df), "mins_before_news") == [(1.5,)]


def test_plans(spark):
    trades = small_trades(spark, 500)
    text = plan(prenews_trades(trades, small_index(spark)))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_span_of_windows_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    trades = small_trades(spark, 199, 200, 999, 1000).withColumn("day", F.lit("1970-01-01").cast("date"))
    trades.unionByName(trades.withColumn("day", F.lit("1970-01-02").cast("date"))).write.partitionBy("day").parquet(path)
    got = prenews_trades(spark.read.parquet(path), small_index(spark), date_col="day")
    text = plan(got)
    assert "GreaterThanOrEqual(block_timestamp,200)" in text and "LessThan(block_timestamp,1000)" in text
    assert "PartitionFilters: [isnotnull(day" in text
    assert rows(got, "block_timestamp", "trade_id") == [(200, 1), (999, 2)]
    columns = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "category" not in columns


def test_markets_are_pruned_by_partition(spark, tmp_path):
    from tapewatch.sources.sinks import append_by_market
    both = small_trades(spark, 500).unionByName(small_trades(spark, 500, 600, cid=P2 + "01").withColumn(
        "trade_id", F.col("trade_id") + 10))
    table = append_by_market(both, str(tmp_path / "m"), ["trade_id"])
    got = prenews_trades(table, small_index(spark), prefix_col="market_id_prefix")
    filters = plan(got).split("PartitionFilters: [")[1].split("]")[0]
    assert "market_id_prefix" in filters and "dynamicpruning" in filters
    assert rows(got, "trade_id", "market_id_prefix") == [(0, P1)]


def test_plans_beyond_the_broadcast_bound(spark, salted):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(prenews_trades(small_trades(spark, 500), small_index(spark)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "_salt" in text
    # Only the list of hot keys is broadcast, which arithmetic bounds.
    assert all("_hot_" in line for line in text.split("\n") if "BroadcastHashJoin" in line)


def test_salting_does_not_read_more_columns(spark, salted, tmp_path):
    small_trades(spark, 500).withColumn("market_slug", F.lit("s")).write.parquet(str(tmp_path / "t"))
    got = prenews_trades(spark.read.parquet(str(tmp_path / "t")), small_index(spark)).select("taker", "case_id")
    columns = plan(got).split("ReadSchema: ")[1].split("\n")[0]
    assert "block_timestamp" in columns and "market_slug" not in columns


def test_salts_spread_one_hot_key(spark, salted):
    trades = spark.range(20_000).select(
        F.col("id").cast("int").alias("trade_id"), F.lit(P1 + "01").alias("condition_id"), F.lit("w").alias("taker"),
        (F.col("id") % 2000).alias("block_timestamp"), F.lit("x").alias("category"))
    dealt = trades.select(F.pmod(joins.row_hash(trades), F.lit(joins.SALTS)).alias("s")).groupBy("s").count()
    sizes = [r["count"] for r in dealt.collect()]
    assert len(sizes) == joins.SALTS and max(sizes) < 2 * 20_000 / joins.SALTS
    assert prenews_trades(trades, small_index(spark)).count() == 20_000 * 800 // 2000


def test_market_filter(spark, mode):
    trades = spark.createDataFrame(
        [(1, P1 + "01"), (2, P1.upper() + "02"), (3, P2 + "03"), (4, "0xcc"), (5, None), (1, P1 + "01")],
        "trade_id int, condition_id string")
    trades = trades.withColumn("condition_id", F.regexp_replace("condition_id", "^0X", "0x"))
    ids = spark.createDataFrame([(P1 + "01",), ("0xCC",), (None,)], "id string")
    starts = spark.createDataFrame([(P1,), (P1.upper().replace("X", "x"),), ("0xaaaa",), ("",)], "market_id_prefix string")
    assert rows(market_filter(trades, ids, starts), "trade_id") == [(1,), (1,), (2,), (4,)]
    assert rows(market_filter(trades, ids), "trade_id") == [(1,), (1,), (4,)]
    assert rows(market_filter(trades, prefixes=starts), "trade_id") == [(1,), (1,), (2,)]
    assert market_filter(trades).count() == 0
    assert market_filter(trades, ids.where("false"), starts.where("false")).count() == 0


def test_route_prefix_takes_the_first_in_list_order(spark, mode):
    trades = spark.createDataFrame([(1, P1 + "01"), (2, P2 + "02"), (3, "0xCCCCCCCCCC")], "trade_id int, condition_id string")
    listed = spark.createDataFrame([(P1, 2), ("0xaaaa", 1), (P2, 3), ("0xbbbb", 4)], "market_id_prefix string, ord int")
    assert rows(route_prefix(trades, listed, "ord"), "trade_id", "routed_prefix") == [
        (1, "0xaaaa"), (2, P2), (3, "0xcccccccc")]


MARKETS = "condition_id string, category string, news_timestamp long"
DAY = 86_400


def test_band_includes_both_ends(spark, mode):
    news = spark.createDataFrame([("a", 100 * DAY), ("b", 0)], "category string, news_timestamp long")
    times = [70 * DAY - 1, 70 * DAY, 100 * DAY, 130 * DAY, 130 * DAY + 1]
    markets = spark.createDataFrame([(f"m{i}", "a", t) for i, t in enumerate(times)] + [("x", "b", 100 * DAY)], MARKETS)
    assert rows(near_news(markets, news, 30), "condition_id") == [("m1",), ("m2",), ("m3",)]


def test_band_equals_brute_force(spark, mode):
    import random
    rng = random.Random(7)
    news = [(rng.choice("ab"), rng.randrange(-10 * DAY, 400 * DAY)) for _ in range(12)]
    markets = [(f"m{i}", rng.choice("abc"), rng.randrange(-10 * DAY, 400 * DAY)) for i in range(300)]
    expected = sorted((m,) for m, c, t in markets if any(k == c and abs(t - n) <= 9 * DAY for k, n in news))
    got = near_news(spark.createDataFrame(markets, MARKETS),
                    spark.createDataFrame(news, "category string, news_timestamp long"), 9)
    assert rows(got, "condition_id") == expected


LEAKED = "market_id_prefix string, condition_id string, category string, news_timestamp long, trade_available boolean"


def test_controls_leave_out_leaked_markets(spark, mode):
    leaked = spark.createDataFrame([(P1, P1 + "01", "a", 100 * DAY, True), (P2, P2, "a", 100 * DAY, False),
                                    ("0xdddddddd", "0xeeeeeeee99", "a", 100 * DAY, True)], LEAKED)
    markets = spark.createDataFrame(
        [(P1 + "01",), (P1 + "02",), (P2 + "03",), ("0xeeeeeeee99",), ("0xcccccccc04",)], "condition_id string")
    assert rows(not_leaked(markets, leaked), "condition_id") == [("0xcccccccc04",)]
    metadata = spark.createDataFrame(
        [("0xcccccccc04", "a", str(100 * DAY)), ("0xcccccccc05", "a", None), ("0xcccccccc06", "b", str(100 * DAY)),
         ("0xcccccccc07", "a", "1970-04-11"), ("0xcccccccc08", "a", "no time")],
        "condition_id string, category string, resolved_at string")
    assert rows(matching_controls(leaked, metadata), "condition_id") == [("0xcccccccc04",), ("0xcccccccc07",)]
    chosen = select_controls(leaked, metadata, 1)
    assert rows(chosen, "condition_id", "is_leaked", "window_start_24h") == [("0xcccccccc04", 0, 99 * DAY)]
    assert select_controls(leaked, metadata, 0).count() == 0


def test_resolutions(spark, mode):
    index = spark.createDataFrame(
        [(P1, P1 + "01", 1, "YES"), (P2, P2, 1, "NO"), ("0xcccccccc", "0xdddddddd05", 1, "YES"),
         ("0xeeeeeeee", "0xeeeeeeee09", 0, "")],
        "market_id_prefix string, condition_id string, is_leaked int, resolution_outcome string")
    index = index.selectExpr("*", "'c' AS case_id", "'t' AS case_title", "'k' AS category", "1L AS news_timestamp")
    chain = spark.createDataFrame(
        [(P1 + "01", [1, 0], "both ways"), (P2 + "A1", [1, 0], "prefix one"), (P2 + "a2", [], "prefix two"),
         ("0xDDDDDDDD05", None, "id only"), ("0xffffffff01", [1, 0], "none")],
        "condition_id string, payout_numerators array<int>, question_id string").withColumn("oracle", F.lit("o"))
    chain = chain.withColumn("condition_id", F.regexp_replace("condition_id", "^0X", "0x"))
    assert match_resolutions(index, chain).count() == 5
    report = resolution_consistency(validate_resolutions(index, chain))
    assert rows(report, "market_id_prefix", "question_id", "ctf_resolved", "consistency") == [
        (P1, "both ways", True, "consistent"), (P2, "prefix one", True, "inconsistent"),
        (P2, "prefix two", False, "unknown"), ("0xcccccccc", "id only", False, "unknown"),
        ("0xeeeeeeee", None, False, "unknown")]


def test_wide_lookups_are_not_small(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 10_000)
    table = spark.range(50).selectExpr("id", "repeat('x', 300) as note")
    assert not joins.is_small(table) and joins.is_small(table.select("id")) and not joins.is_small(table.select("id"), 49)


def test_only_hot_keys_of_a_large_lookup_are_repeated(spark):
    fact = spark.range(30_000).selectExpr("if(id % 3 = 0, 0, id) as k", "id as row")
    dim = spark.range(30_000).selectExpr("id as k", "id * 2 as v")
    joined = joins.lookup_join(fact, dim, ["k"], small=False)
    assert joined.where("v = k * 2").count() == joined.count() == 30_000
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_hot_k" in text and "Cartesian" not in plan(joined)
