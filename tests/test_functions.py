import pytest
from helpers import rows
from pyspark.sql import functions as F

from tapewatch.functions.ids import market_prefix, normalise_id
from tapewatch.functions.timestamps import SHORT_FORMATS, or_else, parse_timestamp, utc_date

DAY = 1_704_412_800  # 2024-01-05
CASES = [
    (None, 0, 0), ("", 0, 0), ("1700000000", 1_700_000_000, 0), ("1.7e9", 1_700_000_000, 0), ("5.5", 0, 0),
    ("2024-01-05", DAY, DAY), ("2024-1-5", DAY, DAY), ("2024-01-05T10:00:00Z", DAY + 36000, DAY + 36000),
    ("2024-01-05T10:00:00ZZ", DAY + 36000, DAY + 36000), (" 2024-01-05 ", DAY, DAY),
    ("2024-01-05 10:00:00", DAY + 36000, 0), ("2024-01-05T10:00:00.5", 0, 0), ("2024-13-01", 0, 0),
    ("2024-02-30", 0, 0), ("abc", 0, 0), ("inf", 0, 0), ("99999999999999999999999", 0, 0), ("20240105", 20240105, 0),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_parse_timestamp(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(CASES)], "i int, s string")
        got = {r.i: (r.a, r.b) for r in df.select(
            "i", parse_timestamp(F.col("s")).alias("a"),
            parse_timestamp(F.col("s"), SHORT_FORMATS, numeric=False).alias("b")).collect()}
        assert got == {i: (a, b) for i, (_, a, b) in enumerate(CASES)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_zero_means_missing(spark):
    df = spark.createDataFrame([(0, 7), (3, 7)], "a long, b long")
    assert rows(df.select(or_else(F.col("a"), F.col("b")).alias("x"))) == [(3,), (7,)]


def test_utc_date(spark):
    df = spark.createDataFrame([(DAY - 1,), (DAY,)], "s long")
    assert [str(r[0]) for r in df.orderBy("s").select(utc_date(F.col("s"))).collect()] == ["2024-01-04", "2024-01-05"]


def test_ids(spark):
    df = spark.createDataFrame([("0xABCDEF0123456789",), (None,), ("0xA",)], "c string")
    got = rows(df.select(normalise_id(F.col("c")).alias("a"), market_prefix(F.col("c")).alias("b")))
    assert got == [(None, None), ("0xa", "0xa"), ("0xabcdef0123456789", "0xabcdef01")]
