"""Reading trade tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.functions.timestamps import utc_date


def scan_trades(spark: SparkSession, *paths: str, merge: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """All Parquet files below the paths in one scan.

    `merge=True` unites files with differing columns by name; absent columns are NULL.
    """
    reader = spark.read.option("mergeSchema", str(merge).lower())
    return (reader.schema(schema) if schema is not None else reader).parquet(*paths)


def union_by_name(*frames: DataFrame, as_text: tuple[str, ...] = ()) -> DataFrame:
    """All rows of all frames, columns matched by name and filled with NULL where absent.

    Columns in `as_text` become text first; `resolved_at`, for one, is a number in some files.
    """
    united = None
    for df in frames:
        df = df.withColumns({c: F.col(c).cast("string") for c in as_text if c in df.columns})
        united = df if united is None else united.unionByName(df, allowMissingColumns=True)
    return united


def with_trade_date(trades: DataFrame, date_col: str = "trade_date") -> DataFrame:
    """The UTC day of each trade, for tables that do not carry it as a partition column."""
    if date_col in trades.columns:
        return trades
    return trades.withColumn(date_col, utc_date(F.col("block_timestamp")))


def days_before(date: dt.date | str, first: int, last: int = 1) -> tuple[dt.date, dt.date]:
    """The days from `first` to `last` days ahead of `date`."""
    day = dt.date.fromisoformat(date) if isinstance(date, str) else date
    return day - dt.timedelta(days=first), day - dt.timedelta(days=last)


def discovery_days(trades: DataFrame, date: dt.date | str, date_col: str = "trade_date") -> DataFrame:
    """Trades of the day itself and of the day a week earlier."""
    week_ago, day = days_before(date, 7, 0)
    return trades.where(F.col(date_col).isin(week_ago, day))


def trading_days(trades: DataFrame, date: dt.date | str, days: int = 5, date_col: str = "trade_date") -> DataFrame:
    """Trades of the `days` days ahead of the date; a table partitioned by date reads those only."""
    first, last = days_before(date, days)
    return trades.where(F.col(date_col).between(first, last))


def tolerant_scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan that passes over what it cannot read and fills absent columns with NULL.

    Checksums of pages are looked at, so that damaged values do not pass for good ones. Of a damaged file the rows before
    the damage come, per split; `file_report` tells how many are lost.
    """
    return (
        spark.read.schema(schema)
        .option("ignoreCorruptFiles", "true")
        .option("ignoreMissingFiles", "true")
        .option("recursiveFileLookup", "true")
        .option("parquet.page.verify-checksum.enabled", "true")
        .parquet(path)
    )


def file_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(path, rows_promised, rows_read, rows_lost) of every Parquet file below `path`.

    The footer tells how many rows a file promises, NULL where it can't be read or promises none; the rows read are those that
    `tolerant_scan` gives, with all values of all columns decoded. Both are counted where the files are read.
    """
    scan = tolerant_scan(spark, path, schema)
    plain_path = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
    # Paths come with escaped characters; a plus sign is one of its own there.
    file = F.url_decode(F.replace(plain_path, F.lit("+"), F.lit("%2B"))).alias("path")
    maps = [F.size(f"`{f.name}`") for f in schema if isinstance(f.dataType, T.MapType)]
    plain = [F.col(f"`{f.name}`") for f in schema if not isinstance(f.dataType, T.MapType)]
    # A scan of no column takes its number of rows from the footers; a digest of all columns needs every page.
    promised = scan.select(file).groupBy("path").agg(F.count("*").alias("rows_promised"))
    digest = scan.select(file, F.xxhash64(*plain, *maps).alias("digest"))
    decoded = digest.groupBy("path").agg((F.count_if(F.col("digest") % 2 == 0) + F.count_if(F.col("digest") % 2 != 0)).alias("rows_read"))
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").load(path).select(file)
    )
    found = listed.join(promised, "path", "left").join(decoded, "path", "left")
    return found.select("path", "rows_promised", F.coalesce("rows_read", F.lit(0)).alias("rows_read"),
                        (F.col("rows_promised") - F.coalesce("rows_read", F.lit(0))).alias("rows_lost"))


def skipped_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The files of which `tolerant_scan` passes over some rows, and those that give none; as `file_report` has them."""
    return file_report(spark, path, schema).where("rows_promised is null or rows_lost > 0")
