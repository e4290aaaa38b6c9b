"""Finding control markets in the daily trades, and fetching their trades."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewatch.constants import CATEGORY_TAGS, CONTROL_MULTIPLIER, DEFAULT_TAGS, PREFIX_LENGTH
from tapewatch.functions.ids import market_prefix
from tapewatch.functions.timestamps import or_else, parse_timestamp, utc_date
from tapewatch.operators.curves import accumulate, split_by_range
from tapewatch.operators.joins import lookup_join
from tapewatch.operators.market_index import least_values
from tapewatch.session import stage

#: Markets that the clusters of a component choose together in a round, and tasks that join the conflicts of all others.
TOGETHER, FORESTS = 2_000, 8

register_pickle_by_value(sys.modules[__name__])


def category_tags(category: Column) -> Column:
    """The market tags that count as an inventory category."""
    lists = {c: F.array(*[F.lit(t) for t in tags]) for c, tags in CATEGORY_TAGS.items()}
    table = F.create_map(*[x for c, tags in lists.items() for x in (F.lit(c), tags)])
    return F.coalesce(F.try_element_at(table, category), F.array(*[F.lit(t) for t in DEFAULT_TAGS]))


def tag_category(tag: Column) -> Column:
    """The inventory category a market tag belongs to; NULL for any other tag."""
    found = F.lit(None).cast("string")
    for category, tags in CATEGORY_TAGS.items():
        found = F.when(tag.isin(*tags), F.lit(category)).otherwise(found)
    return found


def case_clusters(inventory: DataFrame) -> DataFrame:
    """Available leaked markets per (category, day), how many controls each wants, in file order."""
    place = F.struct("case_id", "ordinal")
    clusters = inventory.where("trade_available").groupBy(
        "category", utc_date(F.col("news_timestamp")).alias("cluster_date")).agg(
        F.count("*").alias("n_markets"), F.min(place).alias("place"),
        F.min_by("news_timestamp", place).alias("cluster_news"))
    # Numbered by a running count over ordered parts; the place comes first, so it decides the order.
    line = F.struct("place", "category", "cluster_date", "n_markets", "cluster_news")
    parts = split_by_range(clusters.select(line.alias("cluster"), F.lit(1).alias("n")), "cluster", [], descending=False)
    return accumulate(parts, "cluster", ["n"], [], descending=False).select(
        F.col("cum_n").cast("int").alias("cluster_no"), "cluster.category", "cluster.cluster_date", "cluster.n_markets",
        (F.col("cluster.n_markets") * CONTROL_MULTIPLIER).alias("n_needed"), "cluster.cluster_news")


def on_days(trades: DataFrame, days: list[dt.date]) -> DataFrame:
    """Trades of these UTC days.

    The days reach the scan twice: as values of the day column, which skips partitions, and, when the table has
    the time of trades, as ranges of it, which skip row groups where the day is no partition column.
    """
    kept = trades.where(F.col("trade_date").isin(*sorted(days)) if days else F.lit(False))
    if "block_timestamp" not in trades.columns or not days:
        return kept
    runs: list[list[dt.date]] = []
    for day in sorted(days):
        if runs and day - runs[-1][1] == dt.timedelta(days=1):
            runs[-1][1] = day
        else:
            runs.append([day, day])
    epoch, time = dt.date(1970, 1, 1), F.col("block_timestamp")
    ranges = F.lit(False)
    for first, last in runs:
        ranges = ranges | ((time >= (first - epoch).days * 86_400) & (time < ((last - epoch).days + 1) * 86_400))
    return kept.where(ranges)


def wanted_days(clusters: DataFrame, days_ago: list[int]) -> list[dt.date]:
    """The distinct days so many days before the clusters; at most as many as clusters times days."""
    ago = F.explode(F.array(*[F.lit(d) for d in days_ago]))
    days = clusters.select("cluster_date", ago.alias("ago")).select(F.date_sub("cluster_date", F.col("ago")).alias("day"))
    return [r.day for r in days.where("day is not null").distinct().collect()]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs to the pairs of a spanning forest: one fewer than there are clusters, at most."""
    up: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            _unite(up, a, b)
    pairs = [(a, _root(up, a)) for a in up]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int32()) for i in (0, 1)], ["a", "b"])


def _root(up: dict[int, int], x: int) -> int:
    while (above := up.setdefault(x, x)) != x:
        up[x] = x = up[above]
    return x


def _unite(up: dict[int, int], a: int, b: int) -> None:
    a, b = _root(up, a), _root(up, b)
    up[max(a, b)] = min(a, b)


def conflicts(offers: DataFrame) -> dict[int, int]:
    """The component of each cluster that shares an offered market with others, by its lowest cluster number.

    Each task reduces the clusters of its markets to a spanning forest; `FORESTS` tasks reduce these once more.
    """
    first = offers.groupBy("market_id_prefix").agg(F.min("cluster_no").alias("a")).withColumnRenamed("market_id_prefix", "_m")
    pairs = offers.join(first, F.col("market_id_prefix") == F.col("_m")).where("cluster_no > a").select(
        "a", F.col("cluster_no").alias("b"))
    trees = pairs.mapInArrow(_forest, "a int, b int").distinct().repartition(FORESTS).mapInArrow(_forest, "a int, b int")
    up: dict[int, int] = {}
    for a, b in trees.collect():
        _unite(up, a, b)
    return {c: _root(up, c) for c in list(up)}


@dataclass
class Turn:
    """A cluster's place in the order of choosing: its round, whom it shares markets with, and how far it may look."""

    cluster_no: int
    round: int
    component: int
    reach: int
    alone: bool = True


def turns(asked: list[tuple[int, int]], component: dict[int, int], most: int) -> list[Turn]:
    """Rounds of clusters (number, markets it can get), given in order.

    In a component, clusters go together up to `most` markets in all. What a cluster takes is among its first offers:
    as many as it wants, and those that the clusters before it in the round may have taken.
    """
    out: list[Turn] = []
    last: dict[int, tuple[Turn, int]] = {}
    for number, wanted in asked:
        own = component.get(number, number)
        before, sum_ = last.get(own, (None, 0))
        if before is None or sum_ + wanted > most:
            turn, sum_ = Turn(number, before.round + 1 if before else 0, own, wanted), 0
        else:
            turn = Turn(number, before.round, own, sum_ + wanted, alone=False)
            before.alone = False
        out.append(turn)
        last[own] = (turn, sum_ + wanted)
    return out


def _in_turn(table: pa.Table) -> pa.Table:
    """The offers that are taken when the clusters of a component choose one after the other."""
    table = table.sort_by([("cluster_no", "ascending"), ("place", "ascending")])
    taken: set[str] = set()
    got: dict[int, int] = {}
    kept = []
    for i, (cluster, needed, market) in enumerate(zip(*(
            table.column(c).to_pylist() for c in ("cluster_no", "n_needed", "market_id_prefix")))):
        if got.get(cluster, 0) < needed and market not in taken:
            taken.add(market)
            got[cluster] = got.get(cluster, 0) + 1
            kept.append(i)
    return table.take(pa.array(kept, pa.int64()))


def _first_offers(offers: DataFrame, reach: DataFrame) -> DataFrame:
    """Each cluster's first `reach` offers with their `place`, by running counts over ordered parts of all offers.

    No task holds a whole cluster: a part ends where the range does, and later parts start from the counts before.
    """
    ahead = ["days_ago", "condition_id", "market_id_prefix"]
    rest = [c for c in offers.columns if c not in ("cluster_no", *ahead)]
    lines = offers.select("cluster_no", F.struct(*ahead, *rest).alias("offer"), F.lit(1).alias("one"))
    parts = split_by_range(lines, "offer", ["cluster_no"], descending=False)
    placed = accumulate(parts, "offer", ["one"], ["cluster_no"], descending=False)
    near = placed.join(reach, "cluster_no").where(F.col("cum_one") <= F.col("reach"))
    return near.select("cluster_no", "offer.*", F.col("cum_one").alias("place"), "component", "alone")


def hand_out(offers: DataFrame, most: int = TOGETHER) -> DataFrame:
    """Each cluster's first `n_needed` offers that no earlier cluster has taken.

    Clusters that share markets, directly or through others, form a component; components choose side by side. Within one,
    clusters go together as long as they want at most `most` markets in all, so there are about as many rounds as the
    largest component wants markets, by `most`. In a round a cluster can only get offers among its first ones (see
    `turns`); these few are chosen from in turn by one task per component, at most `most` for each of at most `most`
    clusters. A cluster that goes alone takes its first offers without any task seeing them all.
    """
    spark = offers.sparkSession
    offers = stage(offers, "offers")
    # A row per cluster, that is per category and day.
    asked = sorted((r.cluster_no, r.wanted) for r in offers.groupBy("cluster_no").agg(
        F.least(F.max("n_needed").cast("long"), F.count("*")).alias("wanted")).collect())
    small = sum(wanted for _, wanted in asked) <= most
    order = turns(asked, dict.fromkeys((c for c, _ in asked), 0) if small else conflicts(offers), most)
    schema = offers.withColumn("place", F.lit(1).cast("long")).schema
    taken = None
    for number in range(max((t.round for t in order), default=0) + 1):
        now = [t for t in order if t.round == number]
        reach = F.broadcast(spark.createDataFrame(  # a row per cluster
            [(t.cluster_no, t.component, t.reach, t.alone) for t in now],
            "cluster_no int, component int, reach long, alone boolean"))
        left = offers if len(now) == len(order) else offers.join(reach.select("cluster_no"), "cluster_no", "left_semi")
        if taken is not None:
            left = left.join(taken.select("market_id_prefix"), "market_id_prefix", "left_anti").select(*offers.columns)
        near = _first_offers(left, reach).select(*schema.names, "component", "alone")
        alone = {t.alone for t in now}
        near = stage(near, "near") if len(alone) > 1 else near
        parts = []
        if True in alone:
            parts.append(near.where("alone").select(*schema.names))
        if False in alone:
            parts.append(near.where("not alone").drop("alone").groupBy("component").applyInArrow(
                lambda table: _in_turn(table.drop(["component"])), schema))
        got = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0] if parts else near.select(*schema.names)
        got = stage(got, "taken")
        taken = got if taken is None else taken.unionByName(got)
    return taken.drop("place")


def control_candidates(trades: DataFrame, clusters: DataFrame, leaked_prefixes: DataFrame) -> DataFrame:
    """Control markets per cluster: traded under one of its tags on its day, or else a week before.

    Each cluster is offered all markets but leaked ones, those of the day itself first, in order of id. The clusters
    choose in turn: each takes the first n it needs of those that no earlier one has taken.
    """
    wanted = clusters.select(
        "cluster_no", F.col("category").alias("cluster_category"), "n_needed", "cluster_news", "cluster_date",
        F.explode(category_tags(F.col("category"))).alias("category"),
    ).select("*", F.explode(F.array(F.lit(0), F.lit(7))).alias("days_ago")).withColumn(
        "trade_date", F.date_sub("cluster_date", F.col("days_ago")))
    in_reach = on_days(trades, wanted_days(clusters, [0, 7])).select(
        F.lower("condition_id").alias("condition_id"), "category", "trade_date", "market_slug",
        F.col("resolved_at").cast("string").alias("resolved_at"))
    offered = lookup_join(in_reach, wanted.drop("cluster_date"), ["category", "trade_date"])
    keys = ["cluster_no", "cluster_category", "n_needed", "cluster_news", "days_ago", "condition_id"]
    markets = least_values(offered.select(*keys, "category", "market_slug", "resolved_at"), keys,
                           ["category", "market_slug", "resolved_at"])
    starts = leaked_prefixes.select(F.lower("market_id_prefix").alias("market_id_prefix")).distinct()
    open_ones = lookup_join(
        markets.withColumn("market_id_prefix", F.substring("condition_id", 1, PREFIX_LENGTH)), starts,
        ["market_id_prefix"], "left_anti")
    # A market is offered to a cluster once: for its first day, by its least id.
    rest = [c for c in open_ones.columns if c not in ("cluster_no", "market_id_prefix")]
    once = open_ones.groupBy("cluster_no", "market_id_prefix").agg(
        F.min_by(F.struct(*rest), F.struct("days_ago", "condition_id")).alias("offer")).select(
        "cluster_no", "market_id_prefix", "offer.*")
    return hand_out(once).select(
        "cluster_no", "market_id_prefix", "condition_id", F.col("cluster_category").alias("category"),
        F.col("category").alias("market_category"), F.col("market_slug").alias("slug"),
        or_else(parse_timestamp(F.col("resolved_at")), F.col("cluster_news")).alias("resolved_at"))


def control_trades(trades: DataFrame, clusters: DataFrame, candidates: DataFrame, days: int = 5) -> DataFrame:
    """Trades of the chosen controls on the days ahead of their cluster, under its category and time."""
    chosen = candidates.join(clusters.select("cluster_no", "cluster_date"), "cluster_no").select(
        "market_id_prefix", "cluster_date", F.col("category").alias("_category"),
        F.col("resolved_at").alias("_resolved_at"))
    in_reach = on_days(trades.drop("market_id_prefix"), wanted_days(clusters, list(range(1, days + 1))))
    keyed = in_reach.withColumn("market_id_prefix", market_prefix(F.col("condition_id")))
    ahead = (F.col("trade_date") >= F.date_sub("cluster_date", days)) & (F.col("trade_date") < F.col("cluster_date"))
    found = lookup_join(keyed, chosen, ["market_id_prefix"], "inner", ahead)
    return found.withColumns({"category": F.col("_category"), "resolved_at": F.col("_resolved_at")}).drop(
        "_category", "_resolved_at", "cluster_date")
