"""Packing token pieces into sequences by minimum bin slack.

Documents are encoded, ended with an id and cut into pieces of at most the capacity. For each sequence the
longest piece left is taken, and a subset-sum dynamic programme over the lengths still available, on the bits of an
integer, finds the combination that fills the rest best. Only lengths matter: pieces of one length are
interchangeable. So the programme runs on the histogram of lengths (at most `capacity` numbers), and a
combination is repeated until one of its lengths runs out, which is what solving sequence by sequence would
repeat. There are at most as many combinations as lengths, whatever the number of documents. The cluster then
numbers the pieces of each length and looks up their places.

Defined results: a null or empty text is its end id alone. Repeated rows are packed each. Null document ids stay
null. An empty table packs to nothing. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import numbered, read_table, running, text_batches
from tapewatch.llm.tokens import LIMIT, shared_encoder, utf8

CAPACITY = 2048
END = 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 end: int = END, vocabulary: str | None = None, cached: int = LIMIT) -> DataFrame:
    """One row per piece of at most `capacity` tokens of each document; `cached` words are kept per worker."""
    def pieces(batches):
        import pyarrow as pa

        encoder, stop, step = shared_encoder(vocabulary, cached), struct.pack("<I", end), 4 * capacity
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, ids in zip(batch.column(0).to_pylist(), encoder.each(utf8(batch.column(1))), strict=True):
                data = memoryview(ids + stop)
                for piece, at in enumerate(range(0, len(data), step)):
                    part = data[at:at + step]
                    for column, value in zip(out, (key, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    text_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(pieces, PIECE)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length fill `room` best, found with a bit per reachable sum, longest lengths first."""
    reach, mask = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        copies = 1
        while left and not reach >> room & 1:
            copies = min(copies, left)
            added = (reach << length * copies) & mask & ~reach
            if added:
                steps.append((length, copies, added))
                reach |= added
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    chosen: dict[int, int] = {}
    total = reach.bit_length() - 1
    for length, copies, added in reversed(steps):
        if added >> total & 1:
            chosen[length] = chosen.get(length, 0) + copies
            total -= length * copies
    return chosen


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """The sequences to make: how many pieces of each length, and how often."""
    left = {length: n for length, n in histogram.items() if n}
    found = []
    while left:
        longest = max(left)
        rest = {k: n - (k == longest) for k, n in left.items() if n > (k == longest) and k <= capacity - longest}
        content = fullest(rest, capacity - longest)
        content[longest] = content.get(longest, 0) + 1
        times = min(left[k] // n for k, n in content.items())
        found.append((content, times))
        for k, n in content.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return found


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to rows with a `length` from 1 to `capacity`."""
    spark = pieces.sparkSession
    rows = numbered(pieces, "_rid").withColumn("_one", F.lit(1))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for content, times in combinations(histogram, capacity):
        offset = 0
        for length in sorted(content, reverse=True):
            n = content[length]
            places.append((length, used[length], used[length] + n * times, sequence, n, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    table = spark.createDataFrame(
        places, "_length long, _from long, _to long, _sequence long, _each long, _offset long")
    ranked = running(rows, [F.col("_rid")], {"_rank": "_one"}, by=["length"])
    # A row per combination and length in it: bounded by the capacity, not by the input.
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    at = "(_rank - _from)"
    return ranked.join(F.broadcast(table), here).select(
        *pieces.columns, F.expr(f"_sequence + {at} div _each").alias("sequence_id"),
        F.expr(f"_offset + {at} % _each * length").alias("offset"))


def op4_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 tokens, each with its sequence and place."""
    return pack(token_pieces(read_table(spark, sf_dir, "documents")))
