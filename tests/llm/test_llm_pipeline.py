"""The pipeline's stages on small tables, and that the queries cover their whole tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tapewatch.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture
def labels_dir(spark, tmp_path):
    spark.createDataFrame([(1, 0), (3, 0), (6, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name,function", corpus_pipeline.STAGES)
def test_stage_on_odd_documents(spark, odd_docs, labels_dir, name, function):
    out = function(spark, odd_docs, labels_dir)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == odd_docs.columns
    assert out.count() > 0


@pytest.mark.parametrize("name,function", corpus_pipeline.STAGES)
def test_stage_on_no_documents(spark, make_docs, labels_dir, name, function):
    assert function(spark, make_docs([]), labels_dir).count() == 0


def test_whole_pipeline(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, function in corpus_pipeline.STAGES[:3]:
        before = docs.count()
        docs = docs.sparkSession.createDataFrame(function(spark, docs, SF).collect(), docs.schema)
        assert docs.count() <= before
        kept = docs
    assert kept.select(F.translate("text", " \t\n\x0b\x0c\r", "")).distinct().count() == kept.count()
    pieces = corpus_pipeline.run(spark, SF)
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert rows.where("n != end or n > 2048").count() == 0
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} <= {r.doc_id for r in kept.collect()}


def test_queries_and_sql_agree(spark):
    import duckdb
    from checks.compare import connect, differences
    assert ORACLES.keys() <= QUERIES.keys()
    con = connect(SF)
    assert isinstance(con, duckdb.DuckDBPyConnection)
    for key, sql in ORACLES.items():
        assert differences(QUERIES[key](spark, SF), con, sql) is None, key
