"""Binary output of token ids, with document boundaries in Elias-Fano code.

Documents go out in ascending order of id, split into segments. A segment holds the ids of its documents one
after the other, and two non-decreasing sequences in Elias-Fano code: where each document starts, and the
document ids. Per value a sequence takes about 2 + log2(range / count) bits instead of 64, and any value is
found by a select on its bit vector, from sampled positions.

File format: a folder of Parquet files, a row per segment (see `SEGMENT`). Binary columns: `ids` are unsigned
little-endian integers of `width` bytes; `starts` and `doc_ids` are sequences as packed by `EliasFano.pack`.
Parquet is the container so that Spark's committer and any file system of the cluster can be used.

Null and empty texts have no ids but the end id. Null document ids sort first and come back as null; rows that
share a document id stay separate rows, in an order fixed by their texts. An empty table gives an empty
folder that reads back as no rows. Other columns are not read. One very long text makes a segment of its own.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewatch.llm.common import partitions, read_table, text_batches
from tapewatch.llm.tokens import shared_encoder, utf8
from tapewatch.session import drop_tables, new_path

END = 1
#: A segment is closed with so many ids or documents, or with a longer single text.
SEGMENT_IDS, SEGMENT_DOCS = 256 * 1024, 64 * 1024
#: Every so many ones of the upper bits their position is kept.
SAMPLE = 64
SEGMENT = ("part int, segment int, n_docs long, n_null long, n_ids long, start_in_part long, first_id long, last_id long, "
           "width int, ids binary, starts binary, doc_ids binary")
#: Bytes of a row group of files that hold ids.
BLOCK = 16 << 20


class EliasFano:
    """A non-decreasing sequence of integers; `select(i)` returns one, `all()` every one."""

    HEADER = struct.Struct("<qqiii")

    def __init__(self, first: int, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.first, self.n, self.low_bits = first, n, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, 0, *(np.zeros(0, t) for t in (np.uint8, np.uint8, np.uint32)))
        first = int(values[0])
        # Unsigned differences: right also where a signed one would overflow.
        rest = values.astype(np.int64).view(np.uint64) - np.uint64(first % 2**64)
        low_bits = max(0, (int(rest[-1]) // n).bit_length() - 1)
        shift = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((rest[:, None] >> shift) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        return cls(first, n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def pack(self) -> bytes:
        head = self.HEADER.pack(self.first, self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> EliasFano:
        first, n, low_bits, a, b = cls.HEADER.unpack_from(data)
        at = cls.HEADER.size
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(first, n, low_bits, low, high, np.frombuffer(data, "<u4", -1, at + a + b))

    def _low(self, start: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.uint64)
        a, b = start * self.low_bits, (start + count) * self.low_bits
        bits = np.unpackbits(self.low[a // 8:(b + 7) // 8], bitorder="little")[a % 8:a % 8 + b - a]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (bits.reshape(count, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def _value(self, ones: np.ndarray, start: int) -> np.ndarray:
        upper = (ones - np.arange(start, start + len(ones))).astype(np.uint64) << np.uint64(self.low_bits)
        return ((upper | self._low(start, len(ones))) + np.uint64(self.first % 2**64)).view(np.int64)

    def select(self, i: int) -> int:
        """Value number i: the position of the i-th one, from the nearest sample on, and its low bits."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word, skip = int(self.high[byte]) >> (at % 8) << (at % 8), left
        while word.bit_count() <= skip:
            skip -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(skip):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return int(self._value(np.array([one]), i)[0])

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        return self._value(np.flatnonzero(np.unpackbits(self.high, bitorder="little")), 0)


def _encoded(vocabulary: str | None):
    """Texts to their ids, two bytes each where all fit."""
    def encode(batches):
        import pyarrow as pa

        encoder = shared_encoder(vocabulary)
        for batch in batches:
            ids = [np.frombuffer(i, "<u4") for i in encoder.each(utf8(batch.column("text")))]
            width = [2 if not len(i) or i.max() < 2 ** 16 else 4 for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("spread"), pa.array(width, pa.int32()),
                 pa.array([i.astype(f"<u{w}").tobytes() for i, w in zip(ids, width)], pa.binary())],
                ["doc_id", "spread", "width", "ids"])

    return encode


def _segments(end: int):
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shared_encoder.cache_clear()  # the words of the stage before are needed no more
        part = TaskContext.get().partitionId()
        number = done = 0
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        starts: list[int] = [0]

        def segment():
            nonlocal number, done
            data = np.concatenate(ids)
            width = 2 if data.max() < 2**16 else 4
            known = np.array([k for k in keys if k is not None], np.int64)
            row = {"part": part, "segment": number, "n_docs": len(keys), "n_null": len(keys) - len(known),
                   "n_ids": len(data), "start_in_part": done, "first_id": int(known[0]) if len(known) else None,
                   "last_id": int(known[-1]) if len(known) else None, "width": width,
                   "ids": data.astype(f"<u{width}").tobytes(),
                   "starts": EliasFano.encode(np.array(starts, np.int64)).pack(),
                   "doc_ids": EliasFano.encode(known).pack()}
            number, done = number + 1, done + len(data)
            ids.clear(), keys.clear()
            starts[:] = [0]
            types = {"part": pa.int32(), "segment": pa.int32(), "width": pa.int32()}
            return pa.RecordBatch.from_arrays([
                pa.array([v], types.get(k, pa.binary() if isinstance(v, bytes) else pa.int64()))
                for k, v in row.items()], list(row))

        for batch in batches:
            for i in range(batch.num_rows):
                width, own = batch.column("width")[i].as_py(), batch.column("ids")[i].as_py()
                keys.append(batch.column("doc_id")[i].as_py())
                ids.append(np.append(np.frombuffer(own, f"<u{width}"), [end]).astype("<u4"))
                starts.append(starts[-1] + len(ids[-1]))
                if starts[-1] >= SEGMENT_IDS or len(keys) >= SEGMENT_DOCS:
                    yield segment()
        if keys:
            yield segment()

    return write


def _write(rows: DataFrame, path: str) -> None:
    rows.write.option("parquet.block.size", BLOCK).option("compression", "zstd").parquet(path)


def write_ids(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text",
              vocabulary: str | None = None, end: int = END) -> None:
    """Encode all texts and write them to `path` in ascending order of `doc_id`.

    Texts are encoded where they are read, and written as ids; only these are sorted, and sorting them again after the
    loss of an executor encodes nothing twice.
    """
    spark = docs.sparkSession
    text_batches(spark)
    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("spread"), body.alias("text"))
    encoded = new_path(spark, "encoded")
    schema = "doc_id long, spread long, width int, ids binary"
    _write(rows.mapInArrow(_encoded(vocabulary), schema), encoded)
    order = [F.asc("doc_id"), F.asc("spread")]  # the hash only spreads rows that share a document id
    ranged = spark.read.schema(schema).parquet(encoded).repartitionByRange(partitions(spark), *order)
    _write(ranged.sortWithinPartitions(*order, "width", "ids").mapInArrow(_segments(end), SEGMENT), path)
    drop_tables(spark, [encoded])


def _rows(batches):
    """A segment at a time as Python values."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _documents(batches):
    import pyarrow as pa

    for row in _rows(batches):
        starts = EliasFano.unpack(row["starts"]).all()
        ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4").data.cast("B")
        crc = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        known = EliasFano.unpack(row["doc_ids"]).all().tolist()
        yield pa.RecordBatch.from_arrays([
            pa.array([None] * row["n_null"] + known, pa.int64()), pa.array(starts[:-1] + row["base"]),
            pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in the files: its id, where it starts over all files, its ids' number and crc32."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    # One row per writing task.
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = segments.join(F.broadcast(offsets), "part").select(
        "n_null", "width", "ids", "starts", "doc_ids", (F.col("offset") + F.col("start_in_part")).alias("base"))
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of single documents, by binary search over the ids and two selects per document.

    Only segments whose first and last id leave room for one of the documents are read.
    """
    def lookup(batches):
        import pyarrow as pa

        for row in _rows(batches):
            keys, starts = EliasFano.unpack(row["doc_ids"]), EliasFano.unpack(row["starts"])
            ids = np.frombuffer(row["ids"], f"<u{row['width']}")
            for wanted in doc_ids:
                a = bisect_left(range(keys.n), wanted, key=keys.select)
                while a < keys.n and keys.select(a) == wanted:
                    i = a + row["n_null"]
                    part = ids[starts.select(i):starts.select(i + 1)].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([wanted], pa.int64()), pa.array([part.tolist()], pa.list_(pa.int64()))],
                        ["doc_id", "ids"])
                    a += 1

    near = F.lit(False)
    for wanted in doc_ids:
        near = near | ((F.col("first_id") <= wanted) & (F.col("last_id") >= wanted))
    segments = spark.read.schema(SEGMENT).parquet(path).where(near).select("n_null", "width", "ids", "starts", "doc_ids")
    return segments.mapInArrow(lookup, "doc_id long, ids array<long>")


def op10_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids, written in the file format and read back."""
    path = new_path(spark, "token-ids")
    write_ids(read_table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path)
