"""Ranks, and the mean of two scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewatch.constants import LABEL
from tapewatch.operators.curves import with_rank
from tapewatch.session import stage


def min_max(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add each column scaled to 0..1 under a new name; a constant column becomes 0."""
    ends = df.agg(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols]).alias("ends"))
    with_ends = df.withColumn("_ends", ends.scalar())
    scaled = {}
    for c, out in cols.items():
        lo, hi = F.col(f"_ends.{c}.lo"), F.col(f"_ends.{c}.hi")
        scaled[out] = F.coalesce((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)), F.col(c) * 0.0)
    return with_ends.withColumns(scaled).drop("_ends")


def ensemble_scores(if_scores: DataFrame, ae_scores: DataFrame) -> DataFrame:
    """Wallets in both tables, each score scaled to 0..1, their mean and its rank."""
    both = if_scores.select("taker", LABEL, "case_id", "anomaly_score_if").join(
        ae_scores.select("taker", "anomaly_score_ae"), "taker")
    scaled = min_max(stage(both, "both"), {"anomaly_score_if": "score_if_norm", "anomaly_score_ae": "score_ae_norm"})
    mean = scaled.withColumn("anomaly_score_ensemble", (F.col("score_if_norm") + F.col("score_ae_norm")) / 2.0)
    return with_rank(mean, "anomaly_score_ensemble", "rank_ensemble")


def top_anomalies(scores: DataFrame, score: str, k: int = 20) -> DataFrame:
    """The k highest scores, ties in order of wallet."""
    return scores.orderBy(F.desc(score), F.asc("taker")).limit(k)
