"""Reading the case inventory and its lookup of resolved market ids."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.functions.timestamps import or_else, parse_timestamp

TEXT = T.StringType()
MARKET = T.StructType([
    T.StructField("market_id_prefix", TEXT),
    T.StructField("label", TEXT),
    T.StructField("resolution_date", TEXT),
    T.StructField("resolution_outcome", TEXT),
    T.StructField("trade_history_available", TEXT),  # true, false or "partial": read as text
])
CASE = T.StructType([
    T.StructField("case_id", TEXT),
    T.StructField("title", TEXT),
    T.StructField("date", TEXT),
    T.StructField("category", TEXT),
    T.StructField("markets", T.ArrayType(MARKET)),
])


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per case of a JSON-lines inventory; blank lines are skipped, a broken line raises when it is read."""
    return spark.read.schema(CASE).option("mode", "FAILFAST").json(path)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def flatten_inventory(cases: DataFrame, parser=parse_timestamp) -> DataFrame:
    """One row per market with a prefix, its time of news and whether its trades can be had.

    `ordinal` is the market's place in its case; absent text fields are empty. The market's own
    resolution date goes before the date of the case.
    """
    rows = cases.select("case_id", "title", "date", "category", F.posexplode("markets").alias("ordinal", "market"))
    return rows.select(
        _text("case_id").alias("case_id"),
        F.col("ordinal"),
        _text("title").alias("case_title"),
        _text("category").alias("category"),
        F.lower(_text("market.market_id_prefix")).alias("market_id_prefix"),
        _text("market.label").alias("label"),
        or_else(parser(F.col("market.resolution_date")), parser(F.col("date"))).alias("news_timestamp"),
        _text("market.resolution_outcome").alias("resolution_outcome"),
        F.coalesce(F.col("market.trade_history_available").isin("true", "partial"), F.lit(False))
        .alias("trade_available"),
    ).where("market_id_prefix <> ''")


def read_resolved_ids(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(market_id_prefix, condition_id) of a JSON object, lower-cased; no file gives no rows, a broken one raises.

    The object is a hand-made list and read by one task. For a long list write JSON lines, each an object of
    one or more pairs, and say so with `lines`; they are read by many.
    """
    try:
        text = spark.read.text(path, wholetext=not lines)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "market_id_prefix string, condition_id string")
    pairs = text.where(F.trim("value") != "").select(
        F.explode(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})).alias("k", "v"))
    return pairs.select(F.lower("k").alias("market_id_prefix"), F.lower("v").alias("condition_id")).distinct()


def inventory_summary(cases: DataFrame) -> DataFrame:
    """Markets and fully available markets per case, and in total (all case columns NULL)."""
    markets = F.coalesce(F.col("markets"), F.array().cast(cases.schema["markets"].dataType))
    whole = F.filter(markets, lambda m: m["trade_history_available"] == "true")
    sizes = cases.select(
        F.struct("case_id", "date", "category", "title").alias("case"),
        F.size(markets).cast("long").alias("markets"), F.size(whole).cast("long").alias("available"))
    return sizes.rollup("case").agg(
        F.count("*").alias("cases"), F.sum("markets").alias("markets"), F.sum("available").alias("available"),
    ).select("case.*", "cases", "markets", "available")
