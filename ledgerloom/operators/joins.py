"""Null-safe lookup joins: missing key parts pool together, as they do in the group statistics."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def null_safe(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)))


def attach(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join `table` (one row per `on`) to `df`; Spark picks the strategy, AQE splits skewed row sides."""
    keys = [f"_on{i}" for i in range(len(on))]
    rest = [c for c in table.columns if c not in on]
    right = table.select(*[F.col(c).alias(k) for c, k in zip(on, keys)], *rest)
    return df.join(right, null_safe(list(on), keys), how).drop(*keys)


def attach_rows(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """`attach` for a table about as long as `df`. Spark judges a saved table by its compressed files and would broadcast millions of
    rows through the driver; a sort-merge join never does."""
    return attach(df, table.hint("merge"), on, how)


def attach_bounded(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left lookup with a broadcast; only for tables whose size is bounded by construction."""
    keys = [f"_on{i}" for i in range(len(on))]
    rest = [c for c in table.columns if c not in on]
    right = table.select(*[F.col(c).alias(k) for c, k in zip(on, keys)], *rest)
    return df.join(F.broadcast(right), null_safe(list(on), keys), "left").drop(*keys)


def keep_matching(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left semi join on null-safe equality."""
    keys = [f"_on{i}" for i in range(len(on))]
    right = table.select(*[F.col(c).alias(k) for c, k in zip(on, keys)])
    return df.join(right, null_safe(list(on), keys), "left_semi")


def drop_matching(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left anti join on null-safe equality."""
    keys = [f"_on{i}" for i in range(len(on))]
    right = table.select(*[F.col(c).alias(k) for c, k in zip(on, keys)])
    return df.join(right, null_safe(list(on), keys), "left_anti")
