"""The table of batches: pruned appends, compaction, and what a reader sees meanwhile."""

import random
from dataclasses import replace

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tapewatch.session import stage
from tapewatch.sources import ledger as lg
from tapewatch.sources import sinks
from tapewatch.streaming import ingest

DAY = 86_400


def trades(spark, ids, market="0xaaaaaaaa", day=0):
    return spark.createDataFrame([(i, f"{market}{i:02d}", day * DAY + i) for i in ids],
                                 "trade_id long, condition_id string, block_timestamp long")


def test_append_opens_only_files_that_can_hold_its_trades(spark, tmp_path, monkeypatch):
    path, opened = str(tmp_path / "m"), []
    read = lg.read_batches

    def watched(spark, path, state, files=None):
        if files is not None:
            opened.append([f.split("batch=")[1] for f in files])
        return read(spark, path, state, files)

    monkeypatch.setattr(sinks, "read_batches", watched)
    for day in range(4):
        for market in ("0xaaaaaaaa", "0xbbbbbbbb"):
            sinks.append_by_market(trades(spark, range(100 * day, 100 * day + 20), market, day), path, ["condition_id"])
    state = lg.read_ledger(spark, path)
    assert len(state.batches) == 8 and opened == [] and state.number == 8
    # Day 2 of one market: one file of eight; trades of no file's day: none.
    again = sinks.append_by_market(trades(spark, range(190, 225), "0xbbbbbbbb", 2), path, ["condition_id"])
    assert len(opened) == 1 and len(opened[0]) == 1 and "market_id_prefix=0xbbbbbbbb" in opened[0][0]
    assert again.count() == 160 + 15
    sinks.append_by_market(trades(spark, [7], "0xaaaaaaaa", 9), path, ["condition_id"])
    assert len(opened) == 1
    # Days 0 and 3 together: the spans of the days between are left out.
    both = trades(spark, [5], day=0).union(trades(spark, [305], day=3))
    before = lg.read_ledger(spark, path)
    sinks.append_by_market(both, path, ["condition_id"])
    assert len(opened[1]) == 2 and lg.read_ledger(spark, path) == before


def test_spans_of_numeric_keys(spark, tmp_path):
    path = str(tmp_path / "m")
    for start in (0, 100, 200):
        sinks.append_by_market(trades(spark, range(start, start + 10)), path, ["trade_id"], time_col="no_time")
    state = lg.read_ledger(spark, path)

    def near(ids):
        new = trades(spark, ids).withColumn("market_id_prefix", F.lit("0xaaaaaaaa"))
        return len(lg.files_with(new, path, state, "trade_id", "no_time"))

    assert [near([50]), near([105]), near([105, 250]), near([300])] == [0, 1, 2, 0]


def test_markets_with_odd_names(spark, tmp_path):
    path = str(tmp_path / "a b+c%20d")
    for _ in range(2):
        odd = trades(spark, [1, 2]).withColumn("market_id_prefix", F.when(F.col("trade_id") == 1, "x y+z%20/ü").otherwise("plain"))
        got = sinks.append_by_market(odd, path, ["trade_id"])
    assert rows(got, "trade_id", "market_id_prefix") == [(1, "x y+z%20/ü"), (2, "plain")]


def test_trades_without_time_may_be_anywhere(spark, tmp_path):
    path = str(tmp_path / "m")
    for i in range(3):
        timed = trades(spark, range(10 * i, 10 * i + 5), day=i)
        sinks.append_by_market(timed if i else timed.withColumn("block_timestamp", F.lit(None).cast("long")), path, ["condition_id"])
    assert sinks.append_by_market(trades(spark, [0, 11], day=2), path, ["condition_id"]).count() == 16
    none = trades(spark, [21, 22]).withColumn("block_timestamp", F.lit(None).cast("long"))
    assert sinks.append_by_market(none, path, ["condition_id"]).count() == 16


def test_changed_types_raise(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.append_by_market(trades(spark, [1]), path, ["trade_id"])
    with pytest.raises(ValueError, match="trade_id is bigint"):
        sinks.append_by_market(trades(spark, [2]).withColumn("trade_id", F.lit("x")), path, ["trade_id"])
    assert sinks.read_markets(spark, path).count() == 1
    with pytest.raises(FileNotFoundError):
        sinks.read_markets(spark, str(tmp_path / "none"))


def test_empty_append(spark, tmp_path):
    path = str(tmp_path / "m")
    for _ in range(2):
        got = sinks.append_by_market(trades(spark, [1]).limit(0), path, ["trade_id"])
        assert got.count() == 0 and got.columns == ["trade_id", "condition_id", "block_timestamp", "market_id_prefix"]
    assert lg.read_ledger(spark, path).number == 1 and lg.compact(spark, path).number == 1


def test_batches_merge_into_ones_half_as_large_again():
    assert lg.to_merge({}) == lg.to_merge({"a": 5}) == lg.to_merge({"a": 1, "b": 100}) == []
    assert lg.to_merge({"a": 1, "b": 2, "c": 100}) == ["a", "b"] and lg.to_merge({"a": 0, "b": 0}) == ["a", "b"]
    rng, sizes, written, total = random.Random(1), {}, 0, 0
    for i in range(400):
        sizes[f"b{i}"] = rng.randrange(1, 100)
        total += sizes[f"b{i}"]
        if merged := lg.to_merge(sizes):
            new = sum(sizes.pop(b) for b in merged)
            sizes[f"m{i}"] = new
            written += new
    assert sum(sizes.values()) == total and len(sizes) < 8 and written < 14 * total


def stream(spark, tmp_path, table, **options):
    table.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    prefixes = spark.createDataFrame([("0xaaaaaaaa",), ("0xbbbbbbbb",)], "market_id_prefix string")
    rows_in = ingest.stream_trades(spark, str(tmp_path / "in"), table.schema, **options)
    ingest.ingest(rows_in, str(tmp_path / "out"), prefixes=prefixes, rows_per_task=200).awaitTermination()


def test_compaction_after_many_batches(spark, tmp_path, monkeypatch):
    """50 batches of a busy and a small market become files by size; a killed compaction changes nothing."""
    path = str(tmp_path / "m")
    state = None
    for i in range(50):
        both = trades(spark, range(i * 10, i * 10 + 9)).union(trades(spark, [i * 10 + 9], "0xbbbbbbbb"))
        batch = stage(both.withColumn("market_id_prefix", F.substring("condition_id", 1, 10)).coalesce(1))
        lg.write_batch(batch, path, f"b{i}", "market_id_prefix")
        state = lg.commit(spark, path, replace(state or lg.Ledger(batch.schema, streamed=7), batches=[f"b{k}" for k in range(i + 1)]))
    want = [(i,) for i in range(500)]
    reader = sinks.read_markets(spark, path)
    assert rows(reader, "trade_id") == want
    with monkeypatch.context() as patch:
        patch.setattr(lg, "commit", lambda *args: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            lg.compact(spark, path, rows_per_task=200)
    assert lg.read_ledger(spark, path) == state and rows(sinks.read_markets(spark, path), "trade_id") == want
    merged = lg.compact(spark, path, rows_per_task=200)
    assert len(merged.batches) == 1 and merged.streamed == 7
    files = [f.split("market_id_prefix=")[1].split("/")[0] for f in sinks.read_markets(spark, path).inputFiles()]
    assert files.count("0xbbbbbbbb") == 1 and 3 <= files.count("0xaaaaaaaa") <= 5
    # The table from before goes on being readable, and the new one is complete.
    assert rows(reader, "trade_id") == rows(sinks.read_markets(spark, path), "trade_id") == want
    assert lg.compact(spark, path, rows_per_task=200) == merged
    # What the killed one has left goes; then the old batches go with the states that name them.
    assert len(lg.drop_unused(spark, path)) == 1 and len(lg.drop_unused(spark, path, keep=1)) == 50
    assert rows(sinks.read_markets(spark, path), "trade_id") == want


def test_stream_goes_on_after_compaction(spark, tmp_path):
    path = str(tmp_path / "out")
    for i in range(3):
        stream(spark, tmp_path, trades(spark, [i]))
    assert len(lg.compact(spark, path).batches) == 1
    stream(spark, tmp_path, trades(spark, [900], "0xbbbbbbbb"))
    assert rows(sinks.read_markets(spark, path), "trade_id") == [(0,), (1,), (2,), (900,)]
    assert lg.read_ledger(spark, path).streamed == 3


def test_a_repeated_stream_batch_is_not_added_twice(spark, tmp_path):
    stream(spark, tmp_path, trades(spark, [1, 2]))
    path, state = str(tmp_path / "out"), lg.read_ledger(spark, str(tmp_path / "out"))
    lg.commit(spark, path, state)
    # As if the stream had died between the table's commit and its own.
    for file in (tmp_path / "out" / "_checkpoint" / "commits").glob("*0*"):
        file.unlink()
    stream(spark, tmp_path, trades(spark, [3]))
    assert rows(sinks.read_markets(spark, path), "trade_id") == [(1,), (2,), (3,)]


def test_second_writer_raises(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.append_by_market(trades(spark, [1]), path, ["trade_id"])
    state = lg.read_ledger(spark, path)
    lg.commit(spark, path, state)
    with pytest.raises(RuntimeError, match="another writer"):
        lg.commit(spark, path, state)
    assert lg.numbers(spark, path) == [1, 2] and sinks.read_markets(spark, path).count() == 1


def many(spark, ids):
    """A trade in each of many small markets, and a busy one."""
    small = spark.createDataFrame([(i, f"0x{i:08x}ff", DAY + i) for i in ids], "trade_id long, condition_id string, block_timestamp long")
    return small.union(trades(spark, range(90_000, 90_050), "0xffffffff"))


def test_small_markets_share_files(spark, tmp_path, monkeypatch):
    """Files follow the rows, not the markets; an append opens those whose markets and times it has."""
    path, opened, read = str(tmp_path / "a b%20c"), [], lg.read_batches

    def watched(spark, path, state, files=None):
        opened.extend(files or [])
        return read(spark, path, state, files)

    monkeypatch.setattr(sinks, "read_batches", watched)
    got = sinks.append_by_market(many(spark, range(600)), path, ["trade_id"], rows_per_task=100)
    assert got.count() == 650 and got.select("market_id_prefix").distinct().count() == 601
    files = [f for f in got.inputFiles()]
    assert len(files) <= 4 + 8 and all("market_id_prefix=0xffffffff" in f or "/shared/" in f for f in files)
    entries = lg.manifest(spark, path, lg.read_ledger(spark, path))
    assert entries.agg(F.sum("rows")).first()[0] == 650 and entries.select("market").distinct().count() == 601
    again = sinks.append_by_market(many(spark, [5, 700]).where("trade_id < 90000"), path, ["trade_id"])
    assert len(opened) == 1 and rows(again, "trade_id") == [(i,) for i in (*range(600), 700, *range(90_000, 90_050))]
    assert rows(again.where("market_id_prefix = '0x00000005'"), "trade_id", "condition_id") == [(5, "0x00000005ff")]
    # Merged and cleaned up, the table is whole; a batch that is gone raises.
    sinks.append_by_market(many(spark, range(700, 1300)), path, ["trade_id"])
    merged = lg.compact(spark, path)
    assert len(merged.batches) == 1 and len(lg.drop_unused(spark, path, keep=1)) == 3
    assert rows(sinks.read_markets(spark, path), "trade_id") == rows(many(spark, [*range(600), *range(700, 1300)]), "trade_id")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read(spark, path, replace(merged, batches=[*merged.batches, "gone"]))


def test_a_batch_replaces_shared_files_of_an_attempt_before(spark, tmp_path):
    path = str(tmp_path / "m")
    for ids in (range(400), range(3), range(500)):
        batch = stage(many(spark, ids).withColumn("market_id_prefix", F.substring("condition_id", 1, 10)))
        lg.write_batch(batch, path, "b", "market_id_prefix")
        assert lg.read_batches(spark, path, lg.Ledger(batch.schema, batches=["b"])).count() == len(ids) + 50
