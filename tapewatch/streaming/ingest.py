"""Incremental ingest of daily trade files."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tapewatch.functions.ids import market_prefix
from tapewatch.operators.market_filter import market_filter
from tapewatch.session import stage
from tapewatch.sources.ledger import MARKET, ROWS_PER_TASK, Ledger, commit, read_ledger, united, write_batch
from tapewatch.sources.sinks import read_markets


def stream_trades(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None,
                  name_filter: str | None = None) -> DataFrame:
    """New Parquet files below `path` as a stream."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(path)


def ingest(trades: DataFrame, path: str, ids: DataFrame | None = None, prefixes: DataFrame | None = None,
           rows_per_task: int = ROWS_PER_TASK) -> StreamingQuery:
    """Filter the stream to the chosen markets and append to a table of batches, partitioned by market.

    Runs over all files not seen before and stops. The checkpoint lies in the table's own folder, so the two can't
    come apart: leaving out or mixing up a checkpoint would skip files or write them again. The table's ledger names the last
    batch that went in, so one that is attempted again is neither lost nor added twice, also after
    `ledger.compact` has merged it with others. Busy markets are split over as many tasks and files as their rows need.
    """
    path = path.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = read_ledger(spark, path)
        if before is not None and batch_id <= before.streamed:
            return
        kept = market_filter(batch, ids, prefixes).withColumn(MARKET, market_prefix(F.col("condition_id")))
        rows = stage(kept, "batch")
        state = Ledger(rows.schema) if before is None else replace(before, schema=united(before.schema, rows.schema))
        if not rows.isEmpty():
            name = f"stream-{batch_id}"
            write_batch(rows, path, name, MARKET, rows_per_task=rows_per_task)
            state = replace(state, batches=[*state.batches, name])
        commit(spark, path, replace(state, streamed=batch_id))

    return (
        trades.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()
    )


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """The table that `ingest` has written, as it is now."""
    return read_markets(spark, path)
