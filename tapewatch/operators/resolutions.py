"""The index against on-chain resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.functions.ids import prefix_keys, prefix_lengths
from tapewatch.operators.joins import lookup_join


def match_resolutions(index: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Every index row with each resolution that has its id, or whose id starts with its prefix.

    Index rows must be unique by (market_id_prefix, condition_id, is_leaked). The two ways to match
    become one lookup of keys, so the resolutions are read once; a pair that matches both ways counts
    by its id only.
    """
    key = ["market_id_prefix", "condition_id", "is_leaked"]
    ids = index.select(*key, F.lower("condition_id").alias("_key"), F.lit(True).alias("_by_id"))
    starts = index.select(*key, F.lower("market_id_prefix").alias("_key"), F.lit(False).alias("_by_id"))
    terms = ids.unionByName(starts).where("_key <> ''").withColumnRenamed("condition_id", "_index_id")
    lengths = prefix_lengths(index, "market_id_prefix")
    payouts = resolutions.select(
        F.col("condition_id").alias("_chain_id"), "payout_numerators", "question_id", "oracle",
        F.explode(prefix_keys(F.col("condition_id"), lengths, with_id=True)).alias("_key"))
    same_id = F.coalesce(F.lower("_index_id") == F.lower("_chain_id"), F.lit(False))
    once = F.when(F.col("_by_id"), same_id).otherwise(~same_id)
    pairs = lookup_join(payouts, terms, ["_key"], "inner", once).select(
        "market_id_prefix", F.col("_index_id").alias("condition_id"), "is_leaked",
        "payout_numerators", "question_id", "oracle")
    pairs = pairs.withColumnsRenamed({k: f"_{k}" for k in key})
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return index.join(pairs, on, "left").drop(*[f"_{k}" for k in key])


def validate_resolutions(index: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The validation report: index columns, the resolution, and whether it has a payout."""
    return match_resolutions(index, resolutions).select(
        "market_id_prefix", "condition_id", "is_leaked", "case_id", "case_title", "category", "news_timestamp",
        F.col("resolution_outcome").alias("inventory_outcome"), "payout_numerators", "question_id", "oracle",
        F.coalesce(F.size("payout_numerators") > 0, F.lit(False)).alias("ctf_resolved"))


def leaked_sample(report: DataFrame, n: int = 15) -> DataFrame:
    """The first rows of leaked markets, in order of case and market."""
    return report.where("is_leaked = 1").orderBy("case_id", "market_id_prefix", "question_id").limit(n).select(
        "market_id_prefix", "case_id", "inventory_outcome", "payout_numerators", "ctf_resolved")


def resolution_consistency(report: DataFrame) -> DataFrame:
    """`consistency`: does the inventory's outcome agree with the payout (first number: YES)?"""
    yes = F.try_element_at("payout_numerators", F.lit(1))
    no = F.try_element_at("payout_numerators", F.lit(2))
    paid = F.when(yes > no, "YES").when(no > yes, "NO")
    outcome = F.upper("inventory_outcome")
    verdict = F.when(paid.isNull() | ~outcome.isin("YES", "NO"), "unknown").when(
        outcome == paid, "consistent").otherwise("inconsistent")
    return report.withColumn("consistency", F.coalesce(verdict, F.lit("unknown")))
