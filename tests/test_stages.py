"""Sources, sinks, streaming and the whole pipeline."""

import datetime as dt
import json
import random

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from checks import fixtures as fx
from tapewatch.operators import controls
from tapewatch.operators.controls import (case_clusters, category_tags, control_candidates, control_trades, hand_out, on_days,
                                          tag_category, wanted_days)
from tapewatch.operators.market_index import build_market_index, leaked_markets, market_metadata, resolve_ids
from tapewatch.operators.prenews import prenews_trades
from tapewatch.plans import pipeline
from tapewatch.session import checkpoint_root, stage
from tapewatch.sources import inventory, sinks, trades
from tapewatch.streaming import ingest

SF = "/root/testdata/sf0.001"


def cases(tmp_path, spark, *docs):
    path = tmp_path / "cases.jsonl"
    path.write_text("\n\n".join(json.dumps(d) for d in docs) + "\n")
    return inventory.read_inventory(spark, str(path))


def market(prefix, date="", available=True, outcome="YES"):
    return {"market_id_prefix": prefix, "label": "m", "resolution_date": date, "resolution_outcome": outcome,
            "trade_history_available": available}


def test_inventory(spark, tmp_path):
    df = cases(tmp_path, spark, {
        "case_id": "c1", "title": "One", "date": "2024-01-09", "category": "k",
        "markets": [market("0xAA"), market("0xBB", "1700000000", "partial"), market("", "2024-01-01"),
                    {"market_id_prefix": "0xCC"}]}, {"case_id": "c2", "markets": []}, {"case_id": "c3"})
    flat = inventory.flatten_inventory(df)
    assert rows(flat, "market_id_prefix", "ordinal", "news_timestamp", "trade_available", "label") == [
        ("0xaa", 0, 1704758400, True, "m"), ("0xbb", 1, 1700000000, True, "m"), ("0xcc", 3, 1704758400, False, "")]
    assert rows(inventory.inventory_summary(df)) == [
        (None, None, None, None, 3, 4, 2), ("c1", "2024-01-09", "k", "One", 1, 4, 2), ("c2", None, None, None, 1, 0, 0),
        ("c3", None, None, None, 1, 0, 0)]


def test_resolved_ids(spark, tmp_path):
    path = tmp_path / "ids.json"
    assert inventory.read_resolved_ids(spark, str(path)).count() == 0
    path.write_text(json.dumps({"0xAA": "0xAA01", "0xbb": "0xBB02"}, indent=2))
    assert rows(inventory.read_resolved_ids(spark, str(path))) == [("0xaa", "0xaa01"), ("0xbb", "0xbb02")]


def test_date_filter_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "daily")
    fx.fx_trades(spark, SF).write.partitionBy("trade_date").parquet(path)
    daily = trades.scan_trades(spark, path)
    for df in (trades.trading_days(daily, "2024-01-16"), trades.discovery_days(daily, "2024-01-16")):
        assert "PartitionFilters: [isnotnull(trade_date" in plan(df) or "PartitionFilters: [trade_date" in plan(df)
    got = trades.trading_days(daily, "2024-01-16").agg(F.min("trade_date"), F.max("trade_date")).first()
    assert [str(d) for d in got] == ["2024-01-11", "2024-01-15"]


def test_broken_lists_raise(spark, tmp_path):
    (tmp_path / "cut.jsonl").write_text('{"case_id": "a", "markets": []}\n\n{"case_id": "b", "mark')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        inventory.read_inventory(spark, str(tmp_path / "cut.jsonl")).collect()
    (tmp_path / "ids.json").write_text('{"0xA": "0xA1"')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        inventory.read_resolved_ids(spark, str(tmp_path / "ids.json")).collect()
    (tmp_path / "ids.jsonl").write_text('{"0xA": "0xA1"}\n\n{"0xB": "0xB1", "0xC": "0xC1"}\n')
    got = inventory.read_resolved_ids(spark, str(tmp_path / "ids.jsonl"), lines=True)
    assert rows(got) == [("0xa", "0xa1"), ("0xb", "0xb1"), ("0xc", "0xc1")]
    assert inventory.read_resolved_ids(spark, str(tmp_path / "absent.json")).count() == 0


def test_unreadable_files_are_passed_over_and_reported(spark, tmp_path):
    good = spark.createDataFrame([(1, "a")], "x int, y string")
    good.coalesce(1).write.parquet(str(tmp_path / "t" / "good"))
    (tmp_path / "t" / "broken.parquet").write_text("no parquet")
    schema = good.withColumn("z", F.lit(None).cast("double")).schema
    assert rows(trades.tolerant_scan(spark, str(tmp_path / "t"), schema)) == [(1, "a", None)]
    skipped = trades.skipped_files(spark, str(tmp_path / "t"), schema).collect()
    assert [r.path.endswith("broken.parquet") for r in skipped] == [True]


def damage(path, at, size):
    """Overwrite part of a file, and drop the checksum file beside it."""
    data = bytearray(path.read_bytes())
    data[at:at + size] = random.Random(3).randbytes(len(data[at:at + size]))
    path.write_bytes(data)
    path.with_name(f".{path.name}.crc").unlink()


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9])
def test_lost_rows_of_damaged_files_are_reported(spark, tmp_path, share):
    table = spark.range(200_000).selectExpr("id", "uuid() as note", "id % 7 as small", "array(id) as list")
    table.repartition(3).write.parquet(str(tmp_path / "t"))
    files = sorted((tmp_path / "t").glob("*.parquet"))
    size = files[1].stat().st_size
    damage(files[1], max(4, int(size * share)), 4_000)
    read = trades.tolerant_scan(spark, str(tmp_path / "t"), table.schema).selectExpr("count(*)", "max(note)", "max(id)",
                                                                                     "max(small)", "max(list)").first()[0]
    lost = trades.skipped_files(spark, str(tmp_path / "t"), table.schema).collect()
    assert [r.path for r in lost] == [str(files[1])]
    assert lost[0].rows_lost == 200_000 - read == lost[0].rows_promised - lost[0].rows_read > 0
    assert trades.file_report(spark, str(tmp_path / "t"), table.schema).where("rows_lost = 0").count() == 2


def test_report_of_files_with_odd_names(spark, tmp_path):
    folder = tmp_path / "a b+c%20d"
    spark.range(5).coalesce(1).write.parquet(str(folder))
    report = trades.file_report(spark, str(folder), spark.range(1).schema).collect()
    assert [(r.rows_promised, r.rows_read, r.rows_lost) for r in report] == [(5, 5, 0)]
    assert report[0].path.startswith(str(folder)) and trades.skipped_files(spark, str(folder), spark.range(1).schema).count() == 0


def test_flipped_values_do_not_pass(spark, tmp_path):
    """Damage that still decodes is found by the checksum of its page."""
    spark.range(1000).selectExpr("cast(id as double) / 3 as x").coalesce(1).write.option("compression", "none").option(
        "parquet.enable.dictionary", "false").parquet(str(tmp_path / "t"))
    (file,) = (tmp_path / "t").glob("*.parquet")
    damage(file, 4_000, 8)
    schema = spark.read.parquet(str(tmp_path / "t")).schema
    assert spark.read.schema(schema).parquet(str(tmp_path / "t")).selectExpr("count(x)").first()[0] == 1000
    report = trades.skipped_files(spark, str(tmp_path / "t"), schema).collect()
    assert [(r.rows_promised, r.rows_read, r.rows_lost) for r in report] == [(1000, 0, 1000)]
    assert trades.tolerant_scan(spark, str(tmp_path / "t"), schema).selectExpr("count(x)").first()[0] == 0


def test_union_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, a string"), spark.createDataFrame([(2, 0.5)], "k int, b double")
    assert rows(trades.union_by_name(a, b)) == [(1, "x", None), (2, None, 0.5)]


def test_mixed_types_become_text(spark):
    a, b = spark.createDataFrame([(1, 5)], "k int, r long"), spark.createDataFrame([(2, "2024-01-05")], "k int, r string")
    assert rows(trades.union_by_name(a, b, as_text=("r", "absent"))) == [(1, "5"), (2, "2024-01-05")]


def test_trade_date(spark):
    df = spark.createDataFrame([(1704412799,), (1704412800,)], "block_timestamp long")
    assert [str(r[0]) for r in rows(trades.with_trade_date(df), "trade_date")] == ["2024-01-04", "2024-01-05"]
    given = df.withColumn("trade_date", F.lit("x"))
    assert trades.with_trade_date(given) is given


def test_append_is_repeatable_and_widens(spark, tmp_path):
    path = str(tmp_path / "m")
    first = spark.createDataFrame([(1, "0xAAAAAAAA01"), (2, "0xbbbbbbbb01")], "id int, condition_id string")
    sinks.append_by_market(first, path, ["id"])
    sinks.append_by_market(first, path, ["id"])
    wider = spark.createDataFrame([(2, "0xbbbbbbbb01", 1.0), (3, "0xbbbbbbbb01", 2.0)],
                                  "id int, condition_id string, usd double")
    got = sinks.append_by_market(wider, path, ["id"])
    assert rows(got, "id", "market_id_prefix", "usd") == [
        (1, "0xaaaaaaaa", None), (2, "0xbbbbbbbb", None), (3, "0xbbbbbbbb", 2.0)]
    pruned = plan(sinks.read_markets(spark, path).where("market_id_prefix = '0xaaaaaaaa'"))
    assert "PartitionFilters: [isnotnull(market_id_prefix" in pruned


def test_report_and_stage(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 0]), ("b", None)], "k string, v array<int>")
    sinks.write_report(df, str(tmp_path / "r"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "r"))) == [("a", "[1,0]"), ("b", None)]
    path = str(tmp_path / "s")
    sinks.write_stage(df, path)
    assert rows(sinks.write_stage(df.limit(1), path)) == [("a", [1, 0])]


def test_stage_is_below_the_shared_folder(spark):
    df = stage(spark.range(3), "x")
    assert df.inputFiles()[0].removeprefix("file://").startswith(checkpoint_root(spark).removeprefix("file:"))


FLAT = "case_id string, ordinal int, case_title string, category string, market_id_prefix string, label string, " \
       "news_timestamp long, resolution_outcome string, trade_available boolean"
DAY = 86_400


def flat(spark, *data):
    return spark.createDataFrame([(c, i, "t", k, p, "l", t, "YES", ok) for c, i, k, p, t, ok in data], FLAT)


def test_index_keeps_the_first_row_per_prefix(spark):
    inv = flat(spark, ("c2", 0, "a", "0xaaaaaaaa", 100 * DAY, True), ("c1", 1, "a", "0xaaaaaaaa", 101 * DAY, True),
               ("c1", 2, "a", "0xbbbbbbbb", 100 * DAY, False))
    resolved = spark.createDataFrame([("0xaaaaaaaa", "0xaaaaaaaa01")], "market_id_prefix string, condition_id string")
    metadata = spark.createDataFrame(
        [("0xcccccccc01", "a", str(100 * DAY)), ("0xcccccccc02", "a", str(100 * DAY)), ("0xaaaaaaaa09", "a", str(100 * DAY))],
        "condition_id string, category string, resolved_at string")
    got = build_market_index(inv, resolved, metadata)
    assert rows(got, "market_id_prefix", "condition_id", "is_leaked", "case_id") == [
        ("0xaaaaaaaa", "0xaaaaaaaa01", 1, "c1"), ("0xbbbbbbbb", "0xbbbbbbbb", 1, "c1"), ("0xcccccccc", "0xcccccccc01", 0, "")]
    assert leaked_markets(inv, resolved).count() == 3


def test_metadata_ignores_nulls(spark):
    df = spark.createDataFrame([("0xA", None, "s"), ("0xa", "k", None), (None, "z", "z")],
                               "condition_id string, category string, market_slug string")
    assert rows(market_metadata(df)) == [("0xa", "k", None, None, "s")]
    inv = flat(spark, ("c", 0, "a", "0xa", 0, True))
    assert rows(resolve_ids(inv, spark.createDataFrame([("0xA2",), ("0xa1",)], "condition_id string"))) == [("0xa", "0xa1")]


def test_category_tags(spark):
    df = spark.createDataFrame([("corporate_disclosure",), ("else",), (None,)], "c string")
    got = [r.t for r in df.select(category_tags(F.col("c")).alias("t")).collect()]
    assert got[0][:2] == ["Business", "AI"] and got[1] == got[2] == ["World", "Politics", "Business"]
    tags = spark.createDataFrame([("SEC",), ("Weather",)], "t string")
    assert [r.c for r in tags.select(tag_category(F.col("t")).alias("c")).collect()] == ["regulatory_decision", None]


def test_control_discovery(spark):
    day = 19_737  # 2024-01-15
    inv = flat(spark, ("c1", 0, "regulatory_decision", "0xaaaaaaaa", day * DAY + 5, True),
               ("c2", 0, "other", "0xbbbbbbbb", day * DAY + 9, True))
    clusters = case_clusters(inv)
    assert rows(clusters, "cluster_no", "n_needed", "cluster_news") == [(1, 3, day * DAY + 5), (2, 3, day * DAY + 9)]
    schema = "trade_id int, condition_id string, category string, trade_date string, market_slug string, resolved_at string"
    data = [(i, f"0xcccccc{i:02d}01", "Politics", "2024-01-15", "s", None) for i in range(5)]
    data += [(10, "0xdddddddd01", "Politics", "2024-01-08", "s", "1700000000"), (11, "0xAAAAAAAA01".lower(), "SEC", "2024-01-15", "s", None),
             (12, "0xeeeeeeee01", "World", "2024-01-08", "s", "2024-01-20"), (13, "0xcccccc0001", None, "2024-01-12", "s", None),
             (14, "0xcccccc0001", "Politics", "2024-01-09", "s", None), (15, "0xcccccc0001", "x", "2024-01-10", "s", None)]
    table = spark.createDataFrame(data, schema).withColumn("trade_date", F.col("trade_date").cast("date"))
    chosen = control_candidates(table, clusters, inv)
    # Cluster 1 takes the first three of its day; cluster 2 the two left over, then one of a week before.
    assert rows(chosen, "cluster_no", "market_id_prefix", "resolved_at") == [
        (1, "0xcccccc00", day * DAY + 5), (1, "0xcccccc01", day * DAY + 5), (1, "0xcccccc02", day * DAY + 5),
        (2, "0xcccccc03", day * DAY + 9), (2, "0xcccccc04", day * DAY + 9), (2, "0xdddddddd", 1700000000)]
    got = control_trades(table, clusters, chosen)
    assert rows(got, "trade_id", "category", "resolved_at") == [
        (13, "regulatory_decision", day * DAY + 5), (15, "regulatory_decision", day * DAY + 5)]


OFFERS = "trade_id int, condition_id string, category string, trade_date date, market_slug string, resolved_at string, block_timestamp long"


def test_leaked_markets_do_not_use_up_the_offers(spark):
    """The first 40 markets of the day are leaked ones; a cluster that wants 3 gets the 3 after them."""
    day = 19_737
    date = dt.date(1970, 1, 1) + dt.timedelta(days=day)
    inv = flat(spark, ("c1", 0, "regulatory_decision", "0xffffffff", day * DAY, True),
               *[("c0", i, "x", f"0xaaaaaa{i:02d}", day * DAY, False) for i in range(40)])
    data = [(i, f"0xaaaaaa{i:02d}01", "Politics", date, "s", None, day * DAY) for i in range(40)]
    data += [(100 + i, f"0xbbbbbb{i:02d}01", "Politics", date, "s", None, day * DAY) for i in range(5)]
    chosen = control_candidates(spark.createDataFrame(data, OFFERS), case_clusters(inv), inv)
    assert rows(chosen, "market_id_prefix") == [("0xbbbbbb00",), ("0xbbbbbb01",), ("0xbbbbbb02",)]


def offered(spark, offers, needed):
    return spark.createDataFrame([(c, p, needed[c], *o) for (c, p), o in offers.items()],
                                 "cluster_no int, market_id_prefix string, n_needed int, days_ago int, condition_id string")


def chosen_in_turn(offers, needed):
    taken, found = set(), []
    for c in sorted(needed):
        free = sorted((o, p) for (k, p), o in offers.items() if k == c and p not in taken)[:needed[c]]
        found += [(c, p) for _, p in free]
        taken |= {p for _, p in free}
    return sorted(found)


@pytest.mark.parametrize("most", [2_000, 12])
def test_hand_out_equals_choosing_in_turn(spark, most):
    rng = random.Random(6)
    offers = {(c, f"p{rng.randrange(60):02d}"): (rng.choice([0, 7]), f"x{rng.randrange(10**6)}") for c in range(1, 13)
              for _ in range(30)}
    needed = {c: rng.randrange(1, 9) for c in range(1, 13)}
    got = hand_out(offered(spark, offers, needed), most)
    assert rows(got, "cluster_no", "market_id_prefix") == chosen_in_turn(offers, needed)


@pytest.mark.parametrize("most", [2_000, 200])
def test_hand_out_along_a_chain_of_conflicts(spark, most):
    """200 clusters, each of which shares markets with the next; a few rounds, whatever the depth of the chain."""
    rng = random.Random(8)
    offers = {(c, f"p{3 * c + i:04d}"): (rng.choice([0, 7]), f"x{rng.randrange(10**6)}") for c in range(1, 201) for i in range(7)}
    needed = {c: rng.randrange(2, 6) for c in range(1, 201)}
    df = offered(spark, offers, needed)
    assert rows(hand_out(df, most), "cluster_no", "market_id_prefix") == chosen_in_turn(offers, needed)
    assert set(controls.conflicts(df).values()) == {1}
    rounds = max(t.round for t in controls.turns([(c, n) for c, n in sorted(needed.items())], dict.fromkeys(needed, 1), most)) + 1
    assert rounds == 1 if most == 2_000 else rounds <= 5


def test_components_choose_side_by_side(spark):
    """Clusters without a market in common need no round after another, nor a task that sees a whole cluster."""
    offers = {(c, f"p{c % 3}-{c // 3 % 20 + i}"): (0, f"x{c}-{i}") for c in range(60) for i in range(4)}
    offers |= {(100, f"q{i}"): (0, f"x{i:03d}") for i in range(300)}
    needed = dict.fromkeys(range(60), 2) | {100: 250}
    df = offered(spark, offers, needed)
    component = controls.conflicts(df)
    assert component.keys() == set(range(60)) and {c % 3 for c in set(component.values())} == {0, 1, 2} and len(set(component.values())) == 3
    order = controls.turns([(c, needed[c]) for c in sorted(needed)], component, 20)
    assert max(t.round for t in order) == 1 and [t.alone for t in order if t.cluster_no == 100] == [True]
    for turn in order:
        assert turn.reach <= 20 or turn.alone
    assert rows(hand_out(df, 20), "cluster_no", "market_id_prefix") == chosen_in_turn(offers, needed)
    assert hand_out(df.limit(0)).count() == 0


def test_control_scans_read_the_wanted_days_only(spark, tmp_path):
    day = 19_737
    date = [dt.date(1970, 1, 1) + dt.timedelta(days=day + i) for i in range(-20, 20)]
    data = [(i, f"0xbbbbbb{i:02d}01", "Politics", d, "s", None, (day - 20 + i) * DAY) for i, d in enumerate(date)]
    spark.createDataFrame(data, OFFERS).write.partitionBy("trade_date").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    inv = flat(spark, ("c1", 0, "regulatory_decision", "0xffffffff", day * DAY, True),
               ("c2", 0, "regulatory_decision", "0xfffffffe", (day + 15) * DAY, True))
    kept = on_days(table, wanted_days(case_clusters(inv), [0, 7]))
    text = plan(kept)
    assert len(kept.inputFiles()) and "PartitionFilters" in text and "block_timestamp" in text.split("PushedFilters")[1]
    assert sorted(str(r.trade_date) for r in kept.collect()) == ["2024-01-08", "2024-01-15", "2024-01-23", "2024-01-30"]
    found = plan(control_candidates(table, case_clusters(inv), inv))
    assert "Python" not in found and "Pandas" not in found


def test_stream_equals_batch_on_a_growing_folder(spark, tmp_path):
    rows_in = fx.fx_trades(spark, SF).select("trade_id", "condition_id", "taker")
    prefixes = fx.fx_index(spark, SF).where("is_leaked = 1").select("market_id_prefix")
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = ingest.stream_trades(spark, source, rows_in.schema, files_per_batch=1)
        ingest.ingest(stream, sink, prefixes=prefixes).awaitTermination()
        return ingest.read_ingested(spark, sink)

    rows_in.where("trade_id < 400").repartition(3).write.parquet(source)
    first = run().count()
    assert run().count() == first > 0
    rows_in.where("trade_id >= 400").write.mode("append").parquet(source)
    from tapewatch.operators.market_filter import market_filter
    batch = market_filter(rows_in, prefixes=prefixes)
    assert rows(run(), "trade_id", "condition_id", "taker") == rows(batch)


def test_second_ingest_loses_nothing(spark, tmp_path):
    """10 rows, then 20 more with the same arguments, give 30; a busy market is written by several tasks."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    table = spark.range(30).selectExpr("id as trade_id", "concat('0xaaaaaaaa', id) as condition_id")
    for part in ("trade_id < 10", "trade_id >= 10"):
        table.where(part).write.mode("append").parquet(source)
        prefixes = spark.createDataFrame([("0xaaaaaaaa",)], "market_id_prefix string")
        ingest.ingest(ingest.stream_trades(spark, source, table.schema), sink, prefixes=prefixes).awaitTermination()
    assert rows(ingest.read_ingested(spark, sink), "trade_id") == [(i,) for i in range(30)]
    assert ingest.read_ingested(spark, sink).columns == ["trade_id", "condition_id", "market_id_prefix"]


def test_hot_market_is_written_by_many_tasks(spark, tmp_path):
    """A market with nine tenths of the rows is split, a tiny one is one file, and a column absent later survives."""
    path = str(tmp_path / "m")
    table = spark.range(200_000).selectExpr(
        "id", "if(id % 10 = 0, concat('0x', lpad(id % 70, 8, '0')), '0xhothotho') as condition_id", "uuid() as note")
    got = sinks.append_by_market(table, path, ["id"], rows_per_task=20_000)
    files = [f.split("market_id_prefix=")[1].split("/")[0] for f in got.inputFiles()]
    assert files.count("0xhothotho") >= 9 and files.count("0x00000010") == 1
    more = sinks.append_by_market(table.where("id < 5").drop("note").withColumn("id", F.col("id") + 200_000), path, ["id"])
    assert "note" in more.columns and more.count() == 200_005


def test_append_refuses_null_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, "0xa"), (None, "0xb")], "id int, condition_id string")
    with pytest.raises(Exception, match="must not be NULL"):
        sinks.append_by_market(df, str(tmp_path / "m"), ["id"])


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    inv = inventory.flatten_inventory(fx.fx_cases(spark, sf))
    run = pipeline.run(fx.fx_trades(spark, sf), inv, None, fx.fx_resolutions(spark, sf), epochs=3,
                       model_path=str(tmp_path / "models"), market_path=str(tmp_path / "markets"))
    market_table = sinks.read_markets(spark, str(tmp_path / "markets"))
    pruned = plan(prenews_trades(market_table, run.market_index.limit(3), prefix_col="market_id_prefix"))
    assert "dynamicpruning" in pruned
    assert run.cases.select("model").distinct().count() == run.case_means.count() == 3
    assert rows(run.summary, "model") == [("autoencoder",), ("ensemble",), ("isolation_forest",)]
    n = run.profiles.count()
    assert n == run.if_scores.count() == run.ae_scores.count() == run.ensemble.count() > 100
    assert run.market_index.where("is_leaked = 1").count() == 64
    assert run.market_index.where("is_leaked = 0").count() > 0
    assert run.resolutions.count() >= run.market_index.count()
    pipeline.save(run, str(tmp_path / "out"))
    assert rows(pipeline.load_and_evaluate(spark, str(tmp_path / "out"))) == rows(run.summary)
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "resolutions")).count() == run.resolutions.count()
    assert pipeline.load_and_report(spark, str(tmp_path / "out"), fx.fx_resolutions(spark, sf)).count() == run.resolutions.count()
    with pytest.raises(Exception, match="nothing/if_scores"):
        pipeline.load_and_evaluate(spark, str(tmp_path / "nothing"))
    with pytest.raises(Exception, match="empty"):
        pipeline.run(fx.fx_trades(spark, sf).where("false"), inv, fx.fx_resolved(spark, sf), epochs=1)
