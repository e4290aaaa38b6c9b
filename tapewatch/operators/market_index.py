"""The index of leaked markets and matched control markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.constants import BAND_DAYS, CONTROL_MULTIPLIER, DAY_SECONDS, PREFIX_LENGTH
from tapewatch.functions.ids import market_prefix
from tapewatch.functions.timestamps import parse_timestamp
from tapewatch.operators.joins import lookup_join, prefix_join, survey

INDEX_COLUMNS = [
    "market_id_prefix", "condition_id", "is_leaked", "case_id", "case_title", "category",
    "news_timestamp", "window_start_24h", "window_start_48h", "resolution_outcome", "trade_available",
]


def with_windows(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "window_start_24h": F.col("news_timestamp") - DAY_SECONDS,
        "window_start_48h": F.col("news_timestamp") - 2 * DAY_SECONDS,
    })


def market_metadata(trades: DataFrame, tags: tuple[str, ...] = ("category", "category_refined", "resolved_at",
                                                              "market_slug")) -> DataFrame:
    """One row per market: the least non-NULL value of each descriptive column."""
    have = [c for c in tags if c in trades.columns]
    rows = trades.where("condition_id is not null").select(
        F.lower("condition_id").alias("condition_id"), *[F.col(c).cast("string").alias(c) for c in have])
    metadata = least_values(rows, ["condition_id"], have)
    absent = [F.lit(None).cast("string").alias(c) for c in tags if c not in have]
    return metadata.select("condition_id", *have, *absent).select("condition_id", *tags)


def least_values(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """The least value of string columns per key.

    Equal rows are counted first: that is a hash aggregate that shrinks the trades of a market to a few
    rows, before the minima of strings, which sort their input. The count is asked for above so
    that the optimizer keeps this order; without it, it drops the first step as needless for a minimum.
    """
    counted = rows.groupBy(*keys, *cols).agg(F.count("*").alias("_rows"))
    least = counted.groupBy(*keys).agg(*[F.min(c).alias(c) for c in cols], F.sum("_rows").alias("_rows"))
    return least.where("_rows > 0").drop("_rows")


def resolve_ids(inventory: DataFrame, metadata: DataFrame) -> DataFrame:
    """The full id of each inventory prefix, found in a catalogue of markets; the least one on ties."""
    wanted = inventory.select(F.lower("market_id_prefix").alias("market_id_prefix")).where(
        "market_id_prefix <> ''").distinct()
    found = prefix_join(metadata.select(F.lower("condition_id").alias("condition_id")), wanted,
                        "condition_id", "market_id_prefix")
    return found.groupBy("market_id_prefix").agg(F.min("condition_id").alias("condition_id"))


def leaked_markets(inventory: DataFrame, resolved: DataFrame) -> DataFrame:
    """Index rows of a flattened inventory; without a resolved id the prefix stands for the market."""
    ids = resolved.groupBy("market_id_prefix").agg(F.min("condition_id").alias("full_id"))
    rows = lookup_join(inventory, ids, ["market_id_prefix"], "left")
    return with_windows(rows.withColumns({
        "condition_id": F.coalesce("full_id", "market_id_prefix"),
        "is_leaked": F.lit(1),
    })).select(*INDEX_COLUMNS, "ordinal")


def near_news(markets: DataFrame, news: DataFrame, days: int, time_col: str = "news_timestamp",
              keys: tuple[str, ...] = ("category",), small: bool | None = None) -> DataFrame:
    """Markets with some `news` row of the same keys at most `days` days away, both ends included.

    `news` is cut into slots of that length. A market always matches news of its own slot, and
    beyond it only the last news of the slot before and the first of the slot after can be near
    enough. So one row per slot decides, with an equality join and no pairs of rows.
    """
    keys = list(keys)
    band = days * DAY_SECONDS
    slot = F.floor(F.col(time_col) / F.lit(band)).cast("long")
    slots = news.groupBy(*keys, slot.alias("_own")).agg(F.min(time_col).alias("_lo"), F.max(time_col).alias("_hi"))
    offset = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_offset")
    seen_from = slots.select("*", offset).groupBy(*keys, (F.col("_own") + F.col("_offset")).alias("_slot")).agg(
        F.max(F.col("_offset") == 0).alias("_same"),
        F.max(F.when(F.col("_offset") == 1, F.col("_hi"))).alias("_before"),
        F.min(F.when(F.col("_offset") == -1, F.col("_lo"))).alias("_after"),
    )
    near = (
        F.col("_same")
        | F.coalesce(F.col(time_col) - F.col("_before") <= band, F.lit(False))
        | F.coalesce(F.col("_after") - F.col(time_col) <= band, F.lit(False))
    )
    slotted = markets.withColumn("_slot", slot)
    return lookup_join(slotted, seen_from, [*keys, "_slot"], "left_semi", near, small=small).drop("_slot")


def not_leaked(markets: DataFrame, leaked: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Drop markets that are leaked by id, or whose id starts with a leaked prefix."""
    ids = (leaked if ids is None else ids).select("condition_id").where("condition_id is not null").distinct()
    starts = leaked.select(F.col("market_id_prefix").alias("_start")).where("_start <> ''").distinct()
    facts = survey(starts, "_start")
    kept = lookup_join(markets, ids, ["condition_id"], "left_anti")
    for n in facts.lengths:
        cut = kept.withColumn("_start", market_prefix(F.col("condition_id"), n))
        kept = lookup_join(cut, starts.where(F.length("_start") == n), ["_start"], "left_anti",
                           small=facts.small or None).drop("_start")
    return kept


def matching_controls(leaked: DataFrame, metadata: DataFrame, days: int = BAND_DAYS) -> DataFrame:
    """Every market that qualifies as a control: category and time match, and it is not leaked itself."""
    available = leaked.where("trade_available")
    markets = metadata.select(
        F.lower("condition_id").alias("condition_id"), "category",
        parse_timestamp(F.col("resolved_at")).alias("news_timestamp"),
    ).where("news_timestamp <> 0")
    return near_news(not_leaked(markets, leaked, available), available, days)


def select_controls(leaked: DataFrame, metadata: DataFrame, n_controls: int | None = None,
                    days: int = BAND_DAYS) -> DataFrame:
    """Control rows of the index, the first `n_controls` in order of id (three per available leaked market)."""
    if n_controls is None:
        n_controls = leaked.where("trade_available").count() * CONTROL_MULTIPLIER
    chosen = matching_controls(leaked, metadata, days).orderBy("condition_id").limit(n_controls)
    blank = F.lit("")
    return with_windows(chosen.withColumns({
        "market_id_prefix": F.substring("condition_id", 1, PREFIX_LENGTH),
        "is_leaked": F.lit(0), "case_id": blank, "case_title": blank, "resolution_outcome": blank,
        "trade_available": F.lit(True),
    })).select(*INDEX_COLUMNS)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Keep the first row per key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def build_market_index(inventory: DataFrame, resolved: DataFrame, metadata: DataFrame,
                       n_controls: int | None = None, days: int = BAND_DAYS) -> DataFrame:
    """Leaked rows and control rows, one per (prefix, is_leaked)."""
    leaked = leaked_markets(inventory, resolved)
    controls = select_controls(leaked, metadata, n_controls, days).withColumn("ordinal", F.lit(0))
    rows = leaked.unionByName(controls)
    order = [F.asc("case_id"), F.asc("ordinal"), F.asc("condition_id")]
    return first_per(rows, ["market_id_prefix", "is_leaked"], order).drop("ordinal")
