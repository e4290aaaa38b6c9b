"""Small tables and plan inspection."""


def rows(df, *cols):
    got = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in got.collect()), key=lambda t: tuple((x is not None, x) for x in t))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scores(spark, pairs, column="score"):
    data = [(f"w{i:03d}", int(y), float(s)) for i, (s, y) in enumerate(pairs)]
    return spark.createDataFrame(data, f"taker string, is_leaked_market int, {column} double")
