"""Token counts by an exact histogram of document lengths.

Documents are counted by encoded length; suffix sums over the lengths then answer, for every context limit,
how many documents and tokens are at least that long and what truncating to the limit would keep. Only
the histogram is summed, a row per distinct length.

Null and empty texts have length 0. Repeated rows count each. An empty table gives an empty histogram.
Columns other than the text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import read_table, running, text_batches
from tapewatch.llm.tokens import shared_encoder, utf8
from tapewatch.session import stage


def document_lengths(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per document: its number of tokens, `length`."""
    def lengths(batches):
        import pyarrow as pa
        encoder = shared_encoder(vocabulary)
        for batch in batches:
            counts = [len(ids) // 4 for ids in encoder.each(utf8(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["length"])

    text_batches(docs.sparkSession)
    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lengths, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per distinct `length`: documents of it, sums over longer ones, and totals under a limit of it.

    `docs_at_least`, `tokens_at_least`: documents of this length or more and their tokens. `docs_shorter`:
    documents below it. `truncated_total`: tokens left if every document is cut to this length.
    """
    counts = stage(lengths.groupBy("length").agg(F.count("*").alias("n_docs")), "lengths").withColumn(
        "tokens", F.col("length") * F.col("n_docs"))
    whole = counts.agg(F.sum("n_docs"), F.sum("tokens")).first()
    sums = running(counts, [F.col("length")], {"docs_shorter": "n_docs", "tokens_shorter": "tokens"})
    at_least = F.lit(whole[0]).cast("long") - F.col("docs_shorter")
    return sums.select(
        "length", "n_docs", "docs_shorter", at_least.alias("docs_at_least"),
        (F.lit(whole[1]).cast("long") - F.col("tokens_shorter")).alias("tokens_at_least"),
        (F.col("tokens_shorter") + F.col("length") * at_least).alias("truncated_total"))


def quantiles(histogram: DataFrame, probs: Sequence[float]) -> dict[float, int | None]:
    """The exact lower quantiles: the least length with at least prob x n documents up to it."""
    upto = F.col("docs_shorter") + F.col("n_docs")
    n = F.col("docs_shorter") + F.col("docs_at_least")
    row = histogram.agg(*[F.min(F.when(upto >= F.lit(float(p)) * n, F.col("length"))) for p in probs]).first()
    return dict(zip(probs, row, strict=True))


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> dict[int, int]:
    """Tokens left if every document is cut to the limit, for any limits, also between the lengths."""
    cut = [F.sum(F.least(F.col("length"), F.lit(int(x)).cast("long")) * F.col("n_docs")) for x in limits]
    row = histogram.agg(*cut).first()
    return {x: total or 0 for x, total in zip(limits, row, strict=True)}


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of all documents by their number of tokens, with suffix sums."""
    return length_histogram(document_lengths(read_table(spark, sf_dir, "documents")))
