"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a share of a token budget. As many complete epochs of it as fit come first; what is left of its
target is a weighted sample without replacement: document i gets the exponential key -ln(u_i) / w_i, with
u_i from a hash of the document and w_i its quality weight, and the documents of the source are taken in order
of the key until the target is reached. The order is accumulated over range parts, so a hot source is
spread over tasks. The one document in which the target falls is taken if that comes nearer to it.

Defined results: a null or empty text has size 0 and is taken by every complete epoch. NULL is a source of its
own, last. Repeated document ids are separate rows; rows equal in id and text are interchangeable. An
empty table gives no rows. Weights must be positive; null counts as 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import numbered, read_table, running
from tapewatch.session import stage

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = 2024
#: Characters that text is made of least; their share lowers a document's quality weight. Fixed values.
SYMBOLS = "0123456789!\"#$%&*+/<=>@[\\]^_`{|}~"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality(text: Column) -> Column:
    """Weight from 0.05 to 1: the share of characters that are no digits or symbols, squared."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(F.translate(text, SYMBOLS, "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(plain * plain, F.lit(0.05))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in order of code points, null last, get the weights in turn. Targets are proportional to the
    weights, except for sources whose proportional target would be above `most` times their size: these
    stop there, and the others share what is left. A round is one aggregate over the table of sources.
    """
    sums = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources").select(
        "source", "source_size", F.col("source").isNull().alias("_last"), F.lit(1).alias("_one"))
    place = F.col("_place") % len(weights)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int"))
    ranked = stage(running(sums, [F.col("_last"), F.col("source")], {"_place": "_one"}).select(
        "source", "source_size", weight.alias("weight")), "sources")
    limit = F.col("source_size") * F.lit(float(most))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        at_limit = F.lit(stopped >= 0) & (limit <= F.col("weight") * F.lit(level))
        row = ranked.agg(F.sum(F.when(at_limit, limit)), F.sum(F.when(~at_limit, F.col("weight"))),
                         F.count(F.when(at_limit, 1))).first()
        if row[2] == stopped or not row[1]:
            break
        level, stopped = (share * total - (row[0] or 0.0)) / row[1], row[2]
    if stopped >= 0 and not row[1]:
        return ranked.select("source", "source_size", limit.alias("target"))
    return ranked.select("source", "source_size",
                         F.least(limit, F.col("weight") * F.lit(level)).alias("target"))


def exponential_key(draw: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / w with u from 53 bits of the hash of `draw`, in (0, 1)."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), draw), 11) + F.lit(0.5)) / F.lit(float(2 ** 53))
    return -F.log(uniform) / F.coalesce(weight, F.lit(1.0))


def _chosen(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Rows of (source, size, weight, draw, rid) with `_key`, `copies`, `taken`, and `_more` for those of the fraction."""
    keyed = stage(rows.withColumn("_key", exponential_key(F.col("draw"), F.col("weight"), seed)), "keyed")
    ordered = running(keyed, [F.col("_key"), F.col("rid")], {"_before": "size"}, by=["source"])
    goals = stage(targets.withColumnRenamed("source", "_source"), "targets")
    joined = ordered.join(goals, F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(1)
    left = F.col("target") - F.col("_epochs") * F.col("source_size")
    nearer = F.col("_before") + F.col("size") / 2 <= F.col("_left")
    return (joined.withColumn("_epochs", epochs.cast("long")).withColumn("_left", left)
            .withColumn("_more", (F.col("_left") > 0) & (F.col("_before") < F.col("_left")) & nearer)
            .withColumn("copies", (F.col("_epochs") + F.col("_more").cast("int")).cast("long"))
            .withColumn("taken", F.col("copies") * F.col("size")))


def mix(rows: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """Add `source_size`, `target` and `taken` to rows of (source, size, weight, draw, rid).

    `draw` is a hash that tells documents apart. `taken` is the document's size times how often it is in the mix.
    """
    return _chosen(rows, targets, seed).drop("_key", "_before", "_source", "_epochs", "_left", "_more")


def sized(docs: DataFrame, payload: Sequence[Column], doc_id: str, text: str, source: str) -> DataFrame:
    """Rows for `mix`: the payload with source, size, weight and draw, written once with row numbers."""
    body = F.col(text)
    return numbered(docs.select(
        *payload, F.col(source).cast("string").alias("source"), word_count(body).alias("size"),
        quality(body).alias("weight"), F.xxhash64(F.col(doc_id), body).alias("draw")))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    seed: int = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns.

    What a source takes of its last epoch are the documents with the least keys, so the largest key taken decides for
    each document; documents aren't moved. Rows equal in id and text share a key and are taken together.
    """
    rows = sized(docs, [], doc_id, text, source)
    chosen = _chosen(rows, source_targets(rows), seed)
    limits = stage(chosen.groupBy("source").agg(
        F.min("_epochs").alias("_epochs"), F.max(F.when(F.col("_more"), F.col("_key"))).alias("_last"))
        .withColumnRenamed("source", "_source"), "limits")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    key = exponential_key(F.xxhash64(F.col(doc_id), F.col(text)), quality(F.col(text)), seed)
    keyed = docs.select(whole, F.col(source).cast("string").alias("_own"), key.alias("_key"))
    copies = F.col("_epochs") + F.coalesce(F.col("_key") <= F.col("_last"), F.lit(False)).cast("int")
    placed = keyed.join(limits, F.col("_own").eqNullSafe(F.col("_source"))).select("row", copies.alias("_copies"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return placed.where("_copies > 0").select("row", copy.alias("_copy")).select("row.*")


def op2_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it."""
    rows = sized(read_table(spark, sf_dir, "documents"), [F.col("doc_id")], "doc_id", "text", "source")
    return mix(rows, source_targets(rows)).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")
