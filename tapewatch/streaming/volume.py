"""Traded volume per market and hour, over a stream of trades or a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapewatch.functions.ids import market_prefix

#: Width of a window, and how far behind the latest trade seen a trade may still come.
WIDTH, LATENESS = "1 hour", "1 hour"
PARTITIONS = "spark.sql.shuffle.partitions"


def _event_time(trades: DataFrame, time_col: str) -> DataFrame:
    return trades.where(F.col("condition_id").isNotNull()).select(
        market_prefix(F.col("condition_id")).alias("market_id_prefix"),
        F.timestamp_seconds(time_col).alias("event_time"),
        F.coalesce(F.col("usdc_amount").cast("double"), F.lit(0.0)).alias("amount"))


def _windows(rows: DataFrame, width: str) -> DataFrame:
    def seconds(edge: str) -> Column:
        return F.unix_seconds(F.col("window")[edge])

    return rows.groupBy(F.window("event_time", width), "market_id_prefix").agg(
        F.count("*").alias("trades"), F.sum("amount").alias("volume"), F.max("amount").alias("largest")).select(
        "market_id_prefix", seconds("start").alias("window_start"), seconds("end").alias("window_end"), "trades",
        "volume", "largest")


def market_volume(trades: DataFrame, width: str = WIDTH, time_col: str = "block_timestamp") -> DataFrame:
    """Trades, volume and largest trade per market and tumbling window of event time; hours without trades have no row.

    Trades without market or time belong to no window, those without amount count with zero.
    """
    return _windows(_event_time(trades, time_col), width)


def stream_volume(trades: DataFrame, path: str, width: str = WIDTH, lateness: str = LATENESS,
                  time_col: str = "block_timestamp", partitions: int | None = None) -> StreamingQuery:
    """The same over a stream: a window is appended to the table at `path`, once, when no trade may come for it any more.

    That is when its end is not after the watermark, which runs `lateness` behind the latest trade of the batches
    before; a trade that comes for such a window is dropped. The state holds a row per market and open window,
    however many trades there are. Runs over all files not seen before and stops; the next run goes on
    from the state of the last one, which lies in the table's folder with the checkpoint. The sink commits
    files per batch, so a repeated batch leaves no second row. The state is kept in as many parts as the session has shuffle
    partitions, or in `partitions`, at the first run; later runs keep their number.
    """
    open_ = _event_time(trades, time_col).withWatermark("event_time", lateness)
    writer = (
        _windows(open_, width).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{path.rstrip('/')}/_checkpoint").trigger(availableNow=True)
    )
    conf, before = trades.sparkSession.conf, trades.sparkSession.conf.get(PARTITIONS)
    try:
        conf.set(PARTITIONS, str(partitions or before))
        return writer.start(path)  # the query keeps the settings it starts with
    finally:
        conf.set(PARTITIONS, before)


def read_volume(spark: SparkSession, path: str) -> DataFrame:
    """The windows closed so far."""
    return spark.read.parquet(path)
