"""Running totals over parts."""

import random

import pytest
from pyspark.sql import functions as F
from tapewatch.llm import common
from tapewatch.session import stage


@pytest.mark.parametrize("rows,part", [(0, 50), (40, 50), (1000, 50), (1000, 300), (1000, 4096)])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals(spark, monkeypatch, rows, part, by):
    """The same in one part and in many, for groups with null, one with a third of all rows, and clashing columns."""
    monkeypatch.setattr(common, "PART_ROWS", part)
    rng = random.Random(rows)
    data = [(i, None if i % 7 == 0 else "hot" if i % 3 == 0 else f"g{i % 5}", rng.randrange(9), rng.random()) for i in range(rows)]
    df = stage(spark.createDataFrame(data, "id long, g string, n long, x double").withColumns({c: F.lit(1) for c in ("part", "b", "key")}))
    got = common.running(df, [F.desc("x"), F.col("id")], {"before": "n", "ones": "b"}, by=by)
    assert got.columns == [*df.columns, "before", "ones"]
    want, totals = {}, {}
    for i, g, n, x in sorted(data, key=lambda r: (-r[3], r[0])):
        key = g if by else 0
        want[i] = totals.get(key, (0, 0))
        totals[key] = (want[i][0] + n, want[i][1] + 1)
    assert {r.id: (r.before, r.ones) for r in got.collect()} == want
