"""The corpus pipeline: stages from documents to packed sequences, each written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last keep the columns of documents; the
last returns the placed token pieces. Rows with nulls, empty tables and extra columns are treated as each
operator's docstring says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tapewatch.llm.common import read_table
from tapewatch.llm.exact_dedup import drop_copies
from tapewatch.llm.mixing import mixed_documents
from tapewatch.llm.packing import pack, token_pieces
from tapewatch.llm.simhash import drop_near_copies
from tapewatch.llm.toxicity import drop_toxic
from tapewatch.session import drop_tables, recorded, stage, use_local_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Words that a worker keeps for packing; less than alone, as workers also serve the other stages.
CACHED_WORDS = 500_000
#: Tables staged by the stage called last.
_left: list[str] = []


def _clean(function: Stage) -> Stage:
    """Drop the tables that the stage before this one has staged: its result is written by now.

    Tables that `docs` still reads stay.
    """
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        use_local_folder(spark)
        _left[:] = drop_tables(spark, _left, used_by=docs)
        with recorded() as paths:
            result = function(spark, docs, sf_dir)
        _left.extend(paths)
        return result
    return run_stage


@_clean
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


@_clean
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


@_clean
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


@_clean
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


@_clean
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(token_pieces(docs, cached=CACHED_WORDS))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing),
          ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_local_folder(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
