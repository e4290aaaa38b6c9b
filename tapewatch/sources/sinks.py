"""Writing stage outputs and reports."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.functions.ids import market_prefix
from tapewatch.session import stage
from tapewatch.sources.ledger import (MARKET, ROWS_PER_TASK, Ledger, commit, files_with, read_batches, read_ledger, united,
                                      write_batch)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Replace a stage's Parquet output and hand it back for the next stage."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """A stage's output; a missing one raises an AnalysisException that names the path."""
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def prefix_document(prefixes: DataFrame, resolved: DataFrame) -> DataFrame:
    """One JSON line per prefix with its resolved id, if there is one."""
    ids = resolved.select(F.lower("market_id_prefix").alias("market_id_prefix"), "condition_id")
    wanted = prefixes.select(F.lower("market_id_prefix").alias("market_id_prefix")).distinct()
    return wanted.join(ids, "market_id_prefix", "left")


def write_prefixes(prefixes: DataFrame, resolved: DataFrame, path: str) -> None:
    prefix_document(prefixes, resolved).write.mode("overwrite").json(path)


def append_by_market(trades: DataFrame, path: str, key: list[str], prefix_col: str = MARKET,
                     time_col: str = "block_timestamp", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Append trades to the partition of their market, once per `key`; returns the whole table.

    A trade already present is not written again, so a repeated run changes nothing; a NULL in `key` or in the prefix raises. Only
    files are opened that may hold a trade of the batch, as the table's manifests tell: those of its markets whose
    times, and values of the first key column, overlap with the batch's on some day. The same trade is taken to
    have the same time. A busy market is split over as many tasks and files as its rows need, a small one is written by
    one. The table has the columns of all batches.
    """
    spark = trades.sparkSession
    if prefix_col not in trades.columns:
        trades = trades.withColumn(prefix_col, market_prefix(F.col("condition_id")))
    known = {k: F.when(F.col(k).isNull(), F.raise_error(F.lit(f"key column {k} must not be NULL"))).otherwise(F.col(k))
             for k in dict.fromkeys([prefix_col, *key])}
    fresh = stage(trades.withColumns(known).dropDuplicates(key), "fresh")
    ledger = read_ledger(spark, path)
    near = [] if ledger is None else files_with(fresh, path, ledger, key[0], time_col)
    if near:
        keys = list(dict.fromkeys([prefix_col, *key]))
        fresh = stage(fresh.join(read_batches(spark, path, ledger, near).select(*keys), keys, "left_anti"), "fresh")
    schema = united(None if ledger is None else ledger.schema, fresh.schema)
    state = replace(ledger, schema=schema) if ledger is not None else Ledger(schema, prefix_col)
    if not fresh.isEmpty():
        name = uuid.uuid4().hex
        write_batch(fresh, path, name, prefix_col, key[0], time_col, rows_per_task)
        state = replace(state, batches=[*state.batches, name])
    if state != ledger:
        state = commit(spark, path, state)
    return read_batches(spark, path, state)


def read_markets(spark: SparkSession, path: str) -> DataFrame:
    """A table that `append_by_market` or `ingest` has written, as it is now; a missing one raises."""
    ledger = read_ledger(spark, path)
    if ledger is None:
        raise FileNotFoundError(f"no table of markets at {path}")
    return read_batches(spark, path, ledger)
