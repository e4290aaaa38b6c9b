"""Hilbert sharding: the curve, the law of the shards, and files that can be skipped."""

import itertools
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tapewatch.llm import sharding
from tapewatch.llm.common import numbered
from tapewatch.session import new_path, stage


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 2), (3, 3), (4, 2)])
def test_the_curve_visits_each_cell_once_by_single_steps(spark, n, bits):
    cells = [(*c,) for c in itertools.product(range(2 ** bits), repeat=n)]
    names = [f"x{i}" for i in range(n)]
    df = spark.createDataFrame(cells, ", ".join(f"{c} int" for c in names))
    rows = sorted(df.select(*names, sharding.hilbert_index([F.col(c) for c in names], bits).alias("h")).collect(),
                  key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(2 ** (n * bits)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[c] - b[c]) for c in names) == 1


def check(rows, docs):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, ())) for s in range(sharding.SHARDS)]
    assert max(counts) - min(counts) <= 1
    assert set(slots) <= set(range(sharding.SHARDS))


@pytest.mark.parametrize("rows", [0, 1, 23, 24, 25, 700])
def test_shards_differ_by_one_row(spark, make_docs, tmp_path, rows):
    docs = make_docs([(i, "copy" if i % 3 else f"text {i}" * (i % 50), f"src{i % 4}") for i in range(rows)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(sharding.op5_hilbert_sharding(spark, str(tmp_path)).collect(), docs.collect())


def test_odd_documents(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(sharding.op5_hilbert_sharding(spark, str(tmp_path)).collect(), odd_docs.collect())


def test_shards_span_small_ranges_of_each_dimension(spark, tmp_path):
    rows = spark.range(20_000).select(
        "id", (F.xxhash64("id") % 1000).alias("a"), F.concat(F.lit("k"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90)) + 100).alias("b"))
    lined = stage(sharding.along_curve(numbered(rows), ["a", "b"], bits=4))
    path = new_path(spark, "shards")
    placed = sharding.cut(lined, [F.col("curve"), F.col("rid")], 16)
    sharding.write_shards(placed, path, 10_000)
    files = spark.read.parquet(path).groupBy("shard").agg(
        F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"), F.count("*").alias("n"))
    got = files.collect()
    assert sum(r.n for r in got) == 20_000 and len(got) == 16
    # A quarter of each dimension per shard, up to the cells at the borders; one alone would span it all.
    assert sum(r.a1 - r.a0 for r in got) / 16 < 0.45 * 2000
    assert sum(int(r.b1[1:]) - int(r.b0[1:]) for r in got) / 16 < 0.45 * 90


def test_no_python_in_the_plan(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    text = sharding.op5_hilbert_sharding(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Cartesian" not in text


def plain_curve(cells, bits):
    """The index of a cell by rotations and Gray codes, level by level, without tables."""
    n, entry, direction, index = len(cells), 0, 0, 0
    mask = 2 ** n - 1

    def turned(x, k):
        k %= n
        return (x << k | x >> n - k) & mask

    for b in reversed(range(bits)):
        corner = turned(sum((c >> b & 1) << i for i, c in enumerate(cells)) ^ entry, n - (direction + 1) % n)
        digit = corner
        for shift in range(1, n):
            digit ^= corner >> shift
        index = index << n | digit
        first = 0 if not digit else (digit - 1) // 2 * 2
        ones, rest = 0, digit if digit % 2 else digit - 1
        while digit and rest & 1:
            ones, rest = ones + 1, rest >> 1
        entry ^= turned(first ^ first >> 1, direction + 1)
        direction = (direction + ones + 1) % n
    return index


def test_query_against_a_plain_curve(spark):
    """Cells, curve and cut computed row by row in plain Python, over the whole table."""
    sf, bits = "/root/testdata/sf0.001", sharding.BITS
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for d in docs:
        data = (d["text"] or "").encode()
        d |= {"size": len(data) + 8, "crc": zlib.crc32(data)}
    sizes = sorted(d["size"] for d in docs)
    cuts = [sizes[max(0, -(-i * len(docs) // 2 ** bits) - 1)] for i in range(1, 2 ** bits)]

    def value_cells(name):
        counts, before, out = Counter(d[name] for d in docs if d[name] is not None), 0, {None: 0}
        total = sum(counts.values())
        for value in sorted(counts, key=lambda v: v.encode()):
            out[value] = min(2 ** bits - 1, int((before + counts[value] / 2) * 2 ** bits / total))
            before += counts[value]
        return out

    sources, langs = value_cells("source"), value_cells("lang")
    for d in docs:
        d["curve"] = plain_curve([sources[d["source"]], langs[d["lang"]], sum(c <= d["size"] for c in cuts)], bits)
    docs.sort(key=lambda d: (d["curve"], d["crc"], d["doc_id"]))
    want, slots = {}, Counter()
    for place, d in enumerate(docs):
        shard = place * sharding.SHARDS // len(docs)
        want[d["doc_id"]] = (d["size"], d["crc"], d["curve"], shard, slots[shard])
        slots[shard] += 1
    got = {r.doc_id: (r.size, r.text_crc32, r.curve, r.shard, r.slot) for r in sharding.op5_hilbert_sharding(spark, sf).collect()}
    assert got == want
