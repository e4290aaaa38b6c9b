"""Ranking quality of a score against a 0/1 label, optionally for several models at once (`by`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewatch.constants import K_VALUES, LABEL
from tapewatch.operators.curves import score_curve


def top_k(df: DataFrame, score: str, k: int, by: list[str] | None = None, tie: str = "taker") -> DataFrame:
    """The k best rows (per group), ties in order of `tie`, with their place `position`."""
    by = by or []
    order = [F.desc(score), F.asc(tie)]
    if not by:
        df = df.where(F.col(score).isNotNull()).orderBy(*order).limit(k)
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("position", F.row_number().over(window)).where(F.col("position") <= k)


def precision_at_k(df: DataFrame, score: str, label: str = LABEL, k_values: list[int] = K_VALUES,
                   by: list[str] | None = None, tie: str = "taker") -> DataFrame:
    """Mean label of the k best rows, for all k in one pass; (k, precision) in long form."""
    by = by or []
    top = top_k(df, score, max(k_values), by, tie)
    means = top.groupBy(*by).agg(*[
        F.avg(F.when(F.col("position") <= k, F.col(label).cast("double"))).alias(str(k)) for k in k_values])
    long = means.unpivot(by, [str(k) for k in k_values], "k", "precision")
    return long.withColumn("k", F.col("k").cast("int"))


def precision_rank_cut(df: DataFrame, rank: str, label: str = LABEL, cut: int = 100) -> DataFrame:
    """Positives with rank <= cut over the fixed number `cut`; ties may bring in more rows."""
    hits = df.where(F.col(rank) <= cut).agg(F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("hits"))
    return hits.select("hits", (F.col("hits") / F.lit(float(cut))).alias("precision"))


def _negatives(prefix: str = "") -> Column:
    return F.col(f"{prefix}n") - F.col(f"{prefix}pos")


def _share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole.cast("double"), F.lit(0.0))


def _on_roc() -> Column:
    """Ends of the curve and every point where the step changes; straight runs keep their ends only."""
    ends = (F.col("cum_n") == F.col("n")) | (F.col("cum_n") == F.col("total_n"))
    return ends | (F.col("next_pos") != F.col("pos")) | (_negatives("next_") != _negatives())


def _groups(curve: DataFrame, by: list[str]) -> DataFrame:
    return curve.select(*by).distinct() if by else curve.sparkSession.range(1)


def roc_points(curve: DataFrame, score: str, by: list[str] | None = None, origin: bool = True) -> DataFrame:
    """ROC points of a score curve; points on a straight run of equal steps are left out."""
    by = by or []
    points = curve.where(_on_roc()).select(
        *by, F.col(score).alias("threshold"),
        _share(_negatives("cum_"), _negatives("total_")).alias("fpr"),
        _share(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
    )
    if not origin:
        return points
    start = _groups(curve, by).select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def pr_points(curve: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """Precision-recall points, one per distinct score, and the closing point (recall 0, precision 1)."""
    by = by or []
    points = curve.select(
        *by, F.col(score).alias("threshold"),
        _share(F.col("cum_pos"), F.col("cum_n")).alias("precision"),
        _share(F.col("cum_pos"), F.col("total_pos")).alias("recall"),
    )
    end = _groups(curve, by).select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def curve_metrics(curve: DataFrame, score: str, by: list[str] | None = None, target_fpr: float = 0.01) -> DataFrame:
    """ROC-AUC, average precision and recall at a false positive rate, all from one pass over the curve.

    Undefined values (no positives, or no negatives for ROC-AUC) are NULL.
    """
    by = by or []
    area = _negatives() * (F.col("cum_pos") - F.col("pos") / F.lit(2.0))
    steps = F.col("pos") * F.col("cum_pos") / F.col("cum_n")
    fpr = _share(_negatives("cum_"), _negatives("total_"))
    tpr = _share(F.col("cum_pos"), F.col("total_pos"))
    point = F.struct(F.abs(fpr - target_fpr).alias("gap"), fpr.alias("fpr"), tpr.alias("tpr"))
    start = F.struct(F.lit(float(target_fpr)).alias("gap"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    sums = curve.groupBy(*by).agg(
        F.max("total_n").alias("n_total"), F.max("total_pos").alias("n_positive"),
        F.sum(area).alias("area"), F.sum(steps).alias("steps"),
        F.min(F.when(_on_roc() & fpr.isNotNull(), point)).alias("nearest"),
    )
    has_positive = F.col("n_positive") > 0
    pairs = F.col("n_positive") * (F.col("n_total") - F.col("n_positive"))
    # Equal gaps go to the lower rate, and the origin comes before every point of the curve.
    recall = F.coalesce(F.least(F.col("nearest"), start), start)["tpr"]
    return sums.select(
        *by, "n_positive", "n_total",
        _share(F.col("area"), pairs).alias("roc_auc"),
        _share(F.col("steps"), F.col("n_positive")).alias("pr_auc"),
        F.when(has_positive, recall).alias("recall_at_fpr"),
    )


def roc_auc(df: DataFrame, score: str, label: str = LABEL, by: list[str] | None = None) -> DataFrame:
    metrics = curve_metrics(score_curve(df, score, label, by), score, by)
    return metrics.select(*(by or []), "roc_auc")


def pr_auc(df: DataFrame, score: str, label: str = LABEL, by: list[str] | None = None) -> DataFrame:
    metrics = curve_metrics(score_curve(df, score, label, by), score, by)
    return metrics.select(*(by or []), "pr_auc")


def recall_at_fpr(df: DataFrame, score: str, label: str = LABEL, target_fpr: float = 0.01,
                  by: list[str] | None = None) -> DataFrame:
    metrics = curve_metrics(score_curve(df, score, label, by), score, by, target_fpr)
    return metrics.select(*(by or []), "recall_at_fpr")


def evaluate_model(df: DataFrame, score: str, label: str = LABEL, name: str | None = "model",
                   k_values: list[int] = K_VALUES, tie: str = "taker") -> DataFrame:
    """The report row of a model; with `name=None`, one row per value of the column `model`."""
    by = [] if name is not None else ["model"]
    metrics = curve_metrics(score_curve(df, score, label, by), score, by)
    means = F.struct(*[
        F.avg(F.when(F.col("position") <= k, F.col(label).cast("double"))).alias(f"precision_at_{k}") for k in k_values])
    top = top_k(df, score, max(k_values), by, tie).groupBy(*by).agg(means.alias("top"))
    report = metrics.join(top, by) if by else metrics.select(F.lit(name).alias("model"), "*", top.scalar().alias("top"))
    base = _share(F.col("n_positive"), F.col("n_total"))
    return report.select(
        "model", "n_positive", "n_total", base.alias("base_rate"), "roc_auc", "pr_auc",
        F.col("recall_at_fpr").alias("recall_at_1pct_fpr"),
        *[F.col(f"top.precision_at_{k}") for k in k_values],
        *[_share(F.col(f"top.precision_at_{k}"), base).alias(f"lift_at_{k}") for k in k_values],
    )


def stack_models(scores: dict[str, tuple[DataFrame, str]], label: str = LABEL) -> DataFrame:
    """Score tables of several models as one: (model, taker, label, score)."""
    stacked = None
    for name, (df, score) in scores.items():
        part = df.select(F.lit(name).alias("model"), "taker", label, F.col(score).alias("score"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def align_models(scores: dict[str, tuple[DataFrame, str]], label: str = LABEL) -> DataFrame:
    """Like `stack_models`, for the wallets all models have scored, under the labels of the first."""
    names = list(scores)
    joined = None
    for name, (df, score) in scores.items():
        part = df.select("taker", F.col(score).cast("double").alias(name), *([label] if joined is None else []))
        joined = part if joined is None else joined.join(part, "taker")
    return joined.unpivot(["taker", label], names, "model", "score")


def model_summary(scores: dict[str, tuple[DataFrame, str]], label: str = LABEL) -> DataFrame:
    """One report row per model."""
    return evaluate_model(stack_models(scores, label), "score", label, name=None)
