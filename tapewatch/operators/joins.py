"""Joins of a large table with a lookup table whose size is not known beforehand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewatch.functions.ids import market_prefix, prefix_keys

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 32


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: the length of its texts, eight per plain value, nested ones as JSON."""
    size = F.lit(0).cast("long")
    for f in df.schema:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(column), F.lit(0)) + 8
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            size = size + 8
    return size


def _fits(df: DataFrame, max_rows: int | None) -> Column:
    limit = BROADCAST_ROWS if max_rows is None else max_rows
    return (F.count("*") <= limit) & (F.coalesce(F.sum(row_bytes(df)), F.lit(0)) <= BROADCAST_BYTES)


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether `df` has at most `max_rows` rows and few enough bytes to be broadcast."""
    return df.agg(_fits(df, max_rows)).first()[0]


def survey(dim: DataFrame, prefix: str, max_rows: int | None = None, **extra: Column) -> Row:
    """One job over a lookup table: is it `small`, the prefix `lengths` in use, and `extra` aggregates."""
    length = F.length(prefix)
    found = dim.agg(
        _fits(dim, max_rows).alias("small"),
        F.sort_array(F.collect_set(F.when(length > 0, length))).alias("lengths"),
        *[column.alias(name) for name, column in extra.items()])
    return found.first()


def row_hash(df: DataFrame, cols: list[str] | None = None) -> Column:
    """A repeatable hash of the row (or of `cols`), so that a retried task deals rows out as before."""
    plain = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in cols or plain])


def lookup_join(fact: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner",
                condition: Column | None = None, max_rows: int | None = None,
                small: bool | None = None, spread: list[str] | None = None) -> DataFrame:
    """Join `fact` with `dim` on equal `keys` (and `condition`), safe against hot keys.

    A lookup table proven small is broadcast: no shuffle of `fact`. Beyond that, keys with more than a thousandth of
    all rows of `fact` (fewer than a thousand can) are dealt out over `SALTS` groups there and repeated that
    often on the lookup side, so one key with a third of all rows is spread; all others shuffle as they are. `how` is inner, left, left_semi or left_anti. Columns of the
    two tables must differ but for the keys, which come out once. `small` passes on a count already made; `spread` names
    columns that tell the rows of a key apart, so that the others need not be read for dealing them out.
    """
    if small is None:
        small = is_small(dim, max_rows)
    if not small:
        counts = fact.groupBy(*keys).agg(F.count("*").alias("_n"))
        often = counts.where(F.col("_n") * 1000 > F.coalesce(counts.agg(F.sum("_n")).scalar(), F.lit(0)))
        hot = F.broadcast(often.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.lit(SALTS).alias("_salts")))
        is_hot = F.lit(True)
        for k in keys:
            is_hot = is_hot & (F.col(k) == F.col(f"_hot_{k}"))
        marks = [f"_hot_{k}" for k in keys]
        salt = F.coalesce(F.pmod("_hash", "_salts"), F.lit(0)).cast("int")
        fact = fact.withColumn("_hash", row_hash(fact, spread)).join(hot, is_hot, "left").withColumn("_salt", salt).drop(
            "_hash", "_salts", *marks)
        dim = dim.join(hot, is_hot, "left").withColumn("_salt", F.explode(F.sequence(
            F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts", *marks)
        keys = [*keys, "_salt"]
    dim = dim.withColumnsRenamed({k: f"_dim_{k}" for k in keys})
    on = F.lit(True) if condition is None else condition
    for k in keys:
        on = on & (F.col(k) == F.col(f"_dim_{k}"))
    joined = fact.join(F.broadcast(dim) if small else dim, on, how)
    return joined.drop("_salt", *[f"_dim_{k}" for k in keys])


def prefix_join(fact: DataFrame, dim: DataFrame, id_col: str, prefix_col: str, condition: Column | None = None,
                max_rows: int | None = None, facts: Row | None = None, spread: list[str] | None = None) -> DataFrame:
    """Inner join where the identifier starts with the prefix, planned as an equality join.

    The start of the identifier is cut to each prefix length in use (normally one), which turns the
    LIKE of a nested loop into a hash join. `prefix_col` must not be a column of `fact`; `facts` passes on
    a survey already made.
    """
    facts = facts or survey(dim, prefix_col, max_rows)
    lengths = facts.lengths
    if not lengths:
        keyed = fact.withColumn("_key", F.lit(None).cast("string"))
    elif len(lengths) == 1:
        keyed = fact.withColumn("_key", market_prefix(F.col(id_col), lengths[0]))
    else:
        keyed = fact.withColumn("_key", F.explode(prefix_keys(F.col(id_col), lengths)))
    dim = dim.withColumn("_key", F.col(prefix_col))
    return lookup_join(keyed, dim, ["_key"], "inner", condition, max_rows, facts.small, spread).drop("_key")


def counted_join(fact: DataFrame, dim: DataFrame, keys: list[str], counts: DataFrame, rows: str) -> DataFrame:
    """Left join where `counts` tells in column `rows` how many rows of `fact` each key has.

    `dim` holds one row per key and the same column `rows`, which is dropped. Keys with more than a
    thousandth of all rows (fewer than a thousand can) are dealt out over as many groups as they
    have thousandths; all others shuffle as they are.
    """
    total = counts.agg(F.sum(rows)).scalar()
    share = F.ceil(F.col(rows) * F.lit(1000) / F.greatest(total, F.lit(1)))
    deals = F.greatest(F.least(F.col(rows), share), F.lit(1)).cast("int")
    hot = counts.withColumn("_deals", deals).where("_deals > 1")
    hot = F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_deals"))
    is_hot = F.lit(True)
    for k in keys:
        is_hot = is_hot & (F.col(k) == F.col(f"_hot_{k}"))
    dealt = fact.withColumn("_hash", row_hash(fact)).join(hot, is_hot, "left")
    dealt = dealt.withColumn("_salt", F.coalesce(F.pmod("_hash", "_deals"), F.lit(0)).cast("int"))
    dealt = dealt.drop("_hash", "_deals", *[f"_hot_{k}" for k in keys])
    spread = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), deals - 1))).drop(rows)
    added = [c for c in dim.columns if c not in (*keys, rows)]
    return dealt.join(spread, [*keys, "_salt"], "left").select(*[F.col(f"`{c}`") for c in (*fact.columns, *added)])
