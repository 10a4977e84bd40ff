"""Many columns at once: values as rows (row, column, value), so that the number of exchanges does not grow with the number of columns.

A wide row is written once with a number; narrow rows carry that number through counts and lookups, and come back as one wide row of results
per number, which is joined once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.store import save
from .joins import attach

ROW = "_row"


def numbered(df: DataFrame) -> DataFrame:
    """Rows with a number, written: the numbers stay the same however often the table is read."""
    return save(df.withColumn(ROW, F.monotonically_increasing_id()))


def stack(df: DataFrame, entries: list[dict[str, Column]], keep: list[str] = ()) -> DataFrame:
    """A row per entry: its number `_c` and its columns. All entries have the same names, and texts as values."""
    items = F.array(*[F.struct(F.lit(i).alias("_c"), *[v.alias(n) for n, v in e.items()]) for i, e in enumerate(entries)])
    return df.select(*keep, F.explode(items).alias("_s")).select(*keep, "_s.*")


def widen(rows: DataFrame, long: DataFrame, outs: dict[str, tuple[int, Column]]) -> DataFrame:
    """`outs`: name -> (entry number, value on the long rows); each entry has one long row per row at most."""
    wide = long.groupBy(ROW).agg(*[F.max(F.when(F.col("_c") == i, v)).alias(n) for n, (i, v) in outs.items()])
    return rows.join(wide, ROW, "left").drop(ROW)


def distinct_per_key(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row per key: `_u`, an array with the number of distinct present values of every column."""
    kinds = dict(df.dtypes)
    number = lambda c: F.col(c) + F.lit(0.0) if kinds[c] in ("float", "double") else F.col(c)      # -0.0 is 0.0
    long = stack(df, [{"_v": number(c).cast("string")} for c in columns], list(key)).filter(F.col("_v").isNotNull())
    once = long.groupBy(*key, "_c", "_v").agg(F.lit(1).alias("_1"))
    return once.groupBy(*key).agg(F.array(*[F.count_if(F.col("_c") == i) for i in range(len(columns))]).alias("_u"))


def with_distinct(df: DataFrame, table: DataFrame, key: list[str], outs: list[str]) -> DataFrame:
    """The counts of `distinct_per_key` as columns; 0 where a key has no present value."""
    d = attach(df, table, key)
    return d.withColumns({n: F.coalesce(F.get("_u", F.lit(i)), F.lit(0)) for i, n in enumerate(outs)}).drop("_u")
