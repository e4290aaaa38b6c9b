"""Exact dedup by distributed most-significant-digit radix partitioning.

Documents are equal when their texts are, without the white space `[\\x20\\x09-\\x0D]`. Groups are split by
successive bytes: first by length and the first bytes, then each group by its next bytes, `GROWTH` times as many
per level. A group with one member is done; so is one whose members have ended, and those are equal. No
digest decides anything. At each level the members of a group are counted with partial sums and the counts
joined back, so a group of a third of all rows is never in one task. After the first level only documents with
a companion go on, so most texts are moved once.

Defined results: null text counts as empty, and empty texts are equal. Of equal texts the one with the most code
points stays, then the smallest document id (null last); rows that tie in both are interchangeable, one stays.
Repeated document ids are separate rows. An empty table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import SPACES, read_table
from tapewatch.session import stage

#: Bytes in the first digit, and how many times more each later one takes.
FIRST, GROWTH = 16, 64


def normal_text(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _split(members: DataFrame, digit: list[str]) -> DataFrame:
    """Members with `_n`, the size of their group, and `_group`, its smallest row number."""
    # Written first: then both sides of the join come straight from a shuffle and a hot group can be split.
    counts = stage(members.groupBy(*digit).agg(F.count("*").alias("_n"), F.min("_rid").alias("_least")), "groups")
    return members.join(counts, digit)


def radix_groups(docs: DataFrame, payload: list[Column], text: str = "text", doc_id: str = "doc_id",
                 text_in: Column | None = None) -> DataFrame:
    """One row per document: the payload columns, `keep_id`, `group_size`, `kept`.

    The payload is carried along with each document; its names must not begin with an underscore. `text_in` finds the
    text in the payload, if it is there, so that it isn't carried twice.
    """
    rows = docs.select(
        *payload, F.col(doc_id).cast("long").alias("_id"), F.length(F.coalesce(text, F.lit(""))).alias("_points"),
        *([F.col(text).alias("_text")] if text_in is None else []), F.col(text).alias("_key"))
    body = normal_text(F.col("_text") if text_in is None else text_in).cast("binary")
    carried = [c for c in rows.columns if c not in ("_text", "_key")]

    # Level 1 from the source itself: the digit is the length and the first bytes.
    bytes_ = normal_text(F.col("_key")).cast("binary")
    first = rows.withColumn("_length", F.octet_length(bytes_)).withColumn(
        "_digit", F.substring(bytes_, 1, FIRST)).drop("_key")
    several = stage(first.groupBy("_length", "_digit").agg(F.count("*").alias("_n")).where("_n > 1").select(
        "_length", "_digit", F.lit(True).alias("_several")), "groups")
    width = FIRST * GROWTH
    level = stage(
        first.join(several, ["_length", "_digit"], "left")
        .withColumn("_rid", F.monotonically_increasing_id()).withColumn("_bytes", body)
        .select(*carried, "_rid", "_several", "_length", *[
            F.when(F.col("_several"), part).alias(name) for name, part in (
                ("_digit", F.col("_digit")), ("_next", F.substring("_bytes", FIRST + 1, width)),
                ("_rest", F.expr(f"substring(_bytes, {FIRST + width + 1})")))]), "radix")
    done = [level.where("_several is null").select(
        *payload_names(rows), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"))]
    members, key, ended = level.where("_several").drop("_several"), ["_length", "_digit", "_next"], FIRST + width
    while members.agg(F.max("_length")).first()[0] is not None:
        # A group is named by its smallest row number; those that go on get their next digit.
        named = _split(members, key).withColumn("_over", (F.col("_n") == 1) | (F.col("_length") <= ended))
        width *= GROWTH
        ended += width
        parts = stage(named.select(
            *carried, "_rid", "_length", "_over", F.col("_least").alias("_group"),
            F.when(~F.col("_over"), F.substring("_rest", 1, width)).alias("_digit"),
            F.when(~F.col("_over"), F.expr(f"substring(_rest, {width + 1})")).alias("_rest")), "radix")
        done.append(_decided(parts.where("_over"), payload_names(rows)))
        members, key = parts.where("not _over").drop("_over"), ["_group", "_digit"]
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def payload_names(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if not c.startswith("_")]


def _decided(members: DataFrame, names: list[str]) -> DataFrame:
    """Which member of each finished group stays."""
    order = F.struct((-F.col("_points")).alias("points"), F.col("_id").isNull().alias("unknown"), "_id", "_rid")
    best = stage(members.groupBy("_group").agg(F.count("*").alias("_size"), F.min(order).alias("_best")), "kept")
    return members.join(best, "_group").select(
        *names, F.col("_best._id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_rid") == F.col("_best._rid")).alias("kept"))


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    groups = radix_groups(docs, [whole], text, doc_id, F.col("row").getField(text))
    return groups.where("kept").select("row.*")


def op1_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays, its group's size and the digest of its normalised text."""
    docs = read_table(spark, sf_dir, "documents")
    digest = F.sha2(normal_text(F.col("text")).cast("binary"), 256).alias("text_sha256")
    return radix_groups(docs, [F.col("doc_id"), digest]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
