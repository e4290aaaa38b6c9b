"""Volume windows over a stream: late trades, open windows, restarts."""

from helpers import rows
from pyspark.sql import functions as F

from tapewatch.streaming import volume
from tapewatch.streaming.ingest import stream_trades

SCHEMA = "condition_id string, usdc_amount double, block_timestamp long"
HOUR = 3_600
COLUMNS = ["market_id_prefix", "window_start", "trades", "volume", "largest"]


def feed(spark, tmp_path, data, **options):
    table = spark.createDataFrame(data, SCHEMA)
    table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_trades(spark, str(tmp_path / "in"), table.schema)
    volume.stream_volume(stream, str(tmp_path / "out"), **options).awaitTermination()
    return rows(volume.read_volume(spark, str(tmp_path / "out")), *COLUMNS)


def test_batch_windows(spark):
    table = spark.createDataFrame([
        ("0xAAAAAAAA01", 2.0, 0), ("0xaaaaaaaa02", None, HOUR - 1), ("0xaaaaaaaa01", 5.0, HOUR), ("0xb", 1.0, 7 * HOUR),
        (None, 1.0, 0), ("0xaaaaaaaa01", 1.0, None)], SCHEMA)
    assert rows(volume.market_volume(table), *COLUMNS) == [
        ("0xaaaaaaaa", 0, 2, 2.0, 2.0), ("0xaaaaaaaa", HOUR, 1, 5.0, 5.0), ("0xb", 7 * HOUR, 1, 1.0, 1.0)]
    assert rows(volume.market_volume(table, "2 hours"), "window_start", "window_end", "trades") == [
        (0, 2 * HOUR, 3), (6 * HOUR, 8 * HOUR, 1)]
    assert volume.market_volume(table.limit(0)).count() == 0


def test_windows_close_behind_the_watermark(spark, tmp_path):
    a = "0xaaaaaaaa01"
    # The watermark is at 3 h after this: the windows before are closed, the others stay open.
    assert feed(spark, tmp_path, [(a, 1.0, 10), (a, 2.0, 2 * HOUR), (a, 4.0, 3 * HOUR), (a, 8.0, 4 * HOUR)]) == [
        ("0xaaaaaaaa", 0, 1, 1.0, 1.0), ("0xaaaaaaaa", 2 * HOUR, 1, 2.0, 2.0)]
    # Late for hours 0 and 2, in time for hour 3, also in another market; nothing closes that is not past.
    first = feed(spark, tmp_path, [(a, 100.0, 20), (a, 100.0, 3 * HOUR - 1), (a, 16.0, 3 * HOUR + 5), ("0xb", 1.0, 3 * HOUR)])
    assert first == [("0xaaaaaaaa", 0, 1, 1.0, 1.0), ("0xaaaaaaaa", 2 * HOUR, 1, 2.0, 2.0)]
    assert feed(spark, tmp_path, [("0xb", 1.0, 9 * HOUR)]) == [
        ("0xaaaaaaaa", 0, 1, 1.0, 1.0), ("0xaaaaaaaa", 2 * HOUR, 1, 2.0, 2.0),
        ("0xaaaaaaaa", 3 * HOUR, 2, 20.0, 16.0), ("0xaaaaaaaa", 4 * HOUR, 1, 8.0, 8.0), ("0xb", 3 * HOUR, 1, 1.0, 1.0)]


def test_one_trade_more_closes_no_window_twice(spark, tmp_path):
    """Fed trade by trade in order, the stream gives the closed windows of the whole table."""
    data = [(f"0xaaaaaaa{i % 3}", float(i), i * 1_700) for i in range(12)]
    for at in range(0, 12, 4):
        got = feed(spark, tmp_path, data[at:at + 4], lateness="30 minutes", partitions=2)
    assert spark.conf.get(volume.PARTITIONS) == "4"
    assert len([p for p in (tmp_path / "out" / "_checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]) == 2
    closed = volume.market_volume(spark.createDataFrame(data, SCHEMA)).where(F.col("window_end") <= 11 * 1_700 - 1_800)
    assert got == rows(closed, *COLUMNS) and len(got) > 8
