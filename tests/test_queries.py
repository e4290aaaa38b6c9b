"""Every registered query against its SQL in a second engine."""

import pytest
from helpers import plan
from pyspark.sql import DataFrameWriter

from checks.compare import connect, differences
from checks.oracles import oracles
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
MODELS = {"iforest_fit", "iforest_score", "iforest_flag", "autoencoder_fit", "autoencoder_score", "autoencoder_history"}
JOINS = ["prenews_trades", "market_filter", "route_prefix", "select_controls", "select_controls_1d", "market_index",
         "control_candidates", "control_trades", "validate_resolutions", "resolve_ids", "histogram_clip", "stream_ingest"]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_only_models_go_without_sql():
    assert set(QUERIES) - set(oracles()) == MODELS
    assert set(oracles()) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(oracles()))
def test_query_equals_sql(spark, duck, monkeypatch, key):
    """Equal rows, and neither the result nor a table written on the way is planned as a product of rows."""
    plans, write = [], DataFrameWriter.parquet

    def parquet(self, *args, **kwargs):
        plans.append(plan(self._df))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    df = QUERIES[key](spark, SF)
    assert differences(df, duck, oracles()[key]) is None
    for text in [*plans, plan(df)]:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("key", JOINS)
def test_query_equals_sql_without_broadcast(spark, duck, salted, key):
    assert differences(QUERIES[key](spark, SF), duck, oracles()[key]) is None


def test_top_k_is_cut_before_the_shuffle(spark):
    from checks import fixtures as fx
    from tapewatch.operators.metrics import top_k
    scores = fx.fx_scores(spark, SF)
    assert "TakeOrderedAndProject" in plan(top_k(scores, "score_a", 200))
    assert "WindowGroupLimit" in plan(top_k(scores, "score_a", 200, ["case_id"]))


def test_entry(spark):
    import __spark_entry__ as entry
    top = entry.entry(spark)
    assert top.count() == 20
    assert top.columns[:3] == ["taker", "is_leaked_market", "case_id"]
