"""Helpers that several operators share: row numbers that stay, and running totals without one big window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewatch.session import stage

#: White space of the contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a part that is accumulated by itself.
PART_ROWS = 4096
#: Rows of whole texts that go to Python at a time.
BATCH_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Send whole texts to Python in small batches, unless the session names a smaller number itself.

    Batches of the usual 10 000 rows take up to 64 MB each, several at a time in the executor and its workers. The
    setting stays, as plans read it when they run.
    """
    if int(spark.conf.get(BATCH_SETTING, "10000")) > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def numbered(df: DataFrame, name: str = "rid") -> DataFrame:
    """Write `df` once with a distinct number per row.

    The numbers are made while the table is written, so every later read sees the same ones, also after a
    lost executor; rows that are equal in all columns still differ in it.
    """
    return stage(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality join condition on `keys` in which null equals null."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def running(df: DataFrame, order: list[Column], sums: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Add, per group `by`, the total of each column over the rows *before* this one in `order`.

    `sums` maps new names to summed columns. `df` should be a written table (it is read several times). Rows are split
    by range of (by, order) into parts of about `PART_ROWS` rows, two per task slot of a shuffle at most; the parts are
    written once with their number; totals per part and group are accumulated (a row per part and group), and each part
    is then accumulated by itself. A group may span any number of parts, so a hot one is no problem; `order` should be
    without ties for the same result on every run. NULL is a group of its own. A table of one part is accumulated at once.
    """
    by = list(by)
    n = min(2 * partitions(df.sparkSession), -(-df.count() // PART_ROWS))
    if n <= 1:
        line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*df.columns, *[F.coalesce(F.sum(c).over(line), F.lit(0)).alias(k) for k, c in sums.items()])
    keys = [F.col(b) for b in by] + order
    parts = stage(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), "parts")
    totals = parts.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(totals.select(
        *[F.col(b).alias(f"_by_{b}") for b in by], F.col("_part").alias("_at"),
        *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums]), "offsets")
    here = F.col("_part") == F.col("_at")
    for b in by:
        here = here & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    line = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parts.join(offsets, here)
    return joined.select(
        *df.columns,
        *[(F.col(f"_b_{k}") + F.coalesce(F.sum(c).over(line), F.lit(0))).alias(k) for k, c in sums.items()])
