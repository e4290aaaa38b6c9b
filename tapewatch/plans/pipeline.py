"""The stages chained: controls, index, pre-news trades, profiles, scores, reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.operators import autoencoder, iforest
from tapewatch.operators.controls import case_clusters, control_candidates, control_trades
from tapewatch.operators.ensemble import ensemble_scores
from tapewatch.operators.market_filter import market_filter
from tapewatch.operators.loco import evaluate_cases
from tapewatch.operators.market_index import build_market_index, market_metadata, resolve_ids
from tapewatch.operators.metrics import model_summary
from tapewatch.operators.prenews import WINDOW_48H, prenews_trades
from tapewatch.operators.profiles import build_profiles
from tapewatch.operators.quality import require_complete
from tapewatch.operators.resolutions import resolution_consistency, validate_resolutions
from tapewatch.session import stage
from tapewatch.sources.sinks import append_by_market, read_stage, write_report, write_stage
from tapewatch.sources.trades import union_by_name, with_trade_date


@dataclass
class Run:
    """Tables of one run, in order of the stages."""

    market_index: DataFrame
    trades: DataFrame
    profiles: DataFrame
    if_scores: DataFrame
    ae_scores: DataFrame
    ensemble: DataFrame
    summary: DataFrame
    cases: DataFrame
    case_means: DataFrame
    resolutions: DataFrame | None = None


def market_trades(trades: DataFrame, inventory: DataFrame, resolved: DataFrame) -> DataFrame:
    """Trades of the leaked markets and of the controls found for them."""
    trades = with_trade_date(trades)
    clusters = stage(case_clusters(inventory), "clusters")
    leaked = market_filter(trades, resolved.select("condition_id"), inventory.select("market_id_prefix"))
    candidates = stage(control_candidates(trades, clusters, inventory), "candidates")
    controls = control_trades(trades, clusters, candidates).drop("market_id_prefix")
    return union_by_name(leaked, controls, as_text=("resolved_at",))


def summarise(if_scores: DataFrame, ae_scores: DataFrame, ensemble: DataFrame) -> DataFrame:
    """The report rows of both models and their ensemble."""
    return model_summary({
        "isolation_forest": (if_scores, "anomaly_score_if"),
        "autoencoder": (ae_scores, "anomaly_score_ae"),
        "ensemble": (ensemble, "anomaly_score_ensemble"),
    })


def score_models(profiles: DataFrame, epochs: int = autoencoder.EPOCHS,
                 model_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of both models, which are saved below `model_path` when it is given."""
    forest_path, weights_path = (f"{model_path}/{m}" if model_path else None for m in ("forest", "autoencoder"))
    if_scores = stage(iforest.run_isolation_forest(profiles, forest_path), "if_scores")
    return if_scores, stage(autoencoder.run_autoencoder(profiles, weights_path, epochs), "ae_scores")


def by_case(if_scores: DataFrame, ae_scores: DataFrame, ensemble: DataFrame) -> DataFrame:
    """Precision and ROC-AUC of each model with one case left out at a time.

    The models train on control wallets, which belong to no case, so their scores hold for every turn.
    """
    models = {"isolation_forest": (if_scores, "anomaly_score_if"), "autoencoder": (ae_scores, "anomaly_score_ae"),
              "ensemble": (ensemble, "anomaly_score_ensemble")}
    parts = [evaluate_cases(scores, score).select(F.lit(model).alias("model"), "*") for model, (scores, score) in models.items()]
    return union_by_name(*parts)


def save(run: Run, folder: str) -> None:
    """Write every table of the run: Parquet per stage, and the resolution report as CSV."""
    for name in ("market_index", "trades", "profiles", "if_scores", "ae_scores", "ensemble", "summary", "cases", "case_means"):
        write_stage(getattr(run, name), f"{folder}/{name}")
    if run.resolutions is not None:
        write_report(run.resolutions, f"{folder}/resolutions")


def load_and_evaluate(spark: SparkSession, folder: str) -> DataFrame:
    """The summary once more from saved scores, without training."""
    if_scores, ae_scores = (read_stage(spark, f"{folder}/{name}") for name in ("if_scores", "ae_scores"))
    return summarise(if_scores, ae_scores, stage(ensemble_scores(if_scores, ae_scores), "ensemble"))


def load_and_report(spark: SparkSession, folder: str, resolutions: DataFrame) -> DataFrame:
    """The resolution report once more, for the saved index."""
    return resolution_consistency(validate_resolutions(read_stage(spark, f"{folder}/market_index"), resolutions))


def run(trades: DataFrame, inventory: DataFrame, resolved: DataFrame | None = None, resolutions: DataFrame | None = None,
        window_col: str = WINDOW_48H, n_controls: int | None = None, epochs: int = autoencoder.EPOCHS,
        model_path: str | None = None, market_path: str | None = None, trade_key: str = "trade_id") -> Run:
    """From raw trades and a flattened inventory to scores, summary and resolution report.

    Without `resolved` the full ids are looked up among the markets of the trades. With `market_path` the selected
    trades are appended to a table with one partition per market, once per `trade_key`, and the windows are read from
    it, markets outside the index being skipped.
    """
    inventory = stage(inventory, "inventory")
    if resolved is None:
        resolved = stage(resolve_ids(inventory, market_metadata(trades)), "resolved")
    selected = market_trades(trades, inventory, resolved)
    if market_path is None:
        selected = stage(selected, "selected")
    else:
        selected = append_by_market(selected, market_path, [trade_key])
    index = stage(build_market_index(inventory, resolved, market_metadata(selected), n_controls), "index")
    prefix_col = None if market_path is None else "market_id_prefix"
    windowed = stage(prenews_trades(selected, index, window_col, prefix_col=prefix_col), "windowed")
    profiles = require_complete(stage(build_profiles(windowed), "profiles"))
    if_scores, ae_scores = score_models(profiles, epochs, model_path)
    ensemble = stage(ensemble_scores(if_scores, ae_scores), "ensemble")
    summary = summarise(if_scores, ae_scores, ensemble)
    cases = stage(by_case(if_scores, ae_scores, ensemble), "cases")
    means = cases.groupBy("model").agg(F.avg("precision_at_20").alias("mean_precision"), F.avg("roc_auc").alias("mean_roc_auc"))
    report = resolution_consistency(validate_resolutions(index, resolutions)) if resolutions is not None else None
    return Run(index, windowed, profiles, if_scores, ae_scores, ensemble, summary, cases, means, report)
