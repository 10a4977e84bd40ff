"""How often a value occurs, and statistics of other columns per value."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tokens import token
from ..sources.store import save
from .joins import attach, attach_bounded
from .stacked import ROW, distinct_per_key, numbered, stack, widen, with_distinct


def with_total(table: DataFrame, rows: DataFrame, out: str, count: Column | None = None) -> DataFrame:
    """Add one number counted over `rows` to every row of a table."""
    n = rows.agg((F.count(F.lit(1)) if count is None else count).alias(out)).withColumn("_one", F.lit(1))
    return attach_bounded(table.withColumn("_one", F.lit(1)), n, ["_one"]).drop("_one")     # one row


def value_counts(source: DataFrame, columns: list[str], value: Callable[[str], Column]) -> DataFrame:
    """(_c column name, _t value, _n rows): all columns in one scan, one shuffle, written once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), value(c).alias("_t")) for c in columns])
    return save(source.select(F.explode(pairs).alias("_s")).select("_s.*").groupBy("_c", "_t").agg(F.count(F.lit(1)).alias("_n")))


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _shares(df: DataFrame, counts: DataFrame, columns: list[str], value: Callable[[str], Column], suffix: str, missing: float) -> DataFrame:
    """{column}{suffix}: `_q` of the row's value; `counts` is (_c column name, _t value, _q). One lookup serves all columns."""
    rows = numbered(df)
    long = stack(rows, [{"_t": value(c)} for c in columns], [ROW])
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    found = long.join(counts.select(place[F.col("_c")].alias("_c"), "_t", "_q"), ["_c", "_t"])
    out = widen(rows, found, {c + suffix: (i, F.col("_q")) for i, c in enumerate(columns)})
    return out.withColumns({c + suffix: F.coalesce(c + suffix, F.lit(missing)) for c in columns})


def frequency(df: DataFrame, source: DataFrame, columns: list[str], suffix: str = "_freq") -> DataFrame:
    """Share of `source` rows with the same value; missing is a value, unseen is 0."""
    if not columns:
        return df
    counts = value_counts(source, columns, token)
    one = counts.filter(F.col("_c") == columns[0])      # missing is a value, so every column adds up to all rows
    counts = with_total(counts, one, "_all", F.sum("_n"))
    return _shares(df, counts.withColumn("_q", F.col("_n") / F.col("_all")), columns, token, suffix, 0.0)


def informative(history: DataFrame, source: DataFrame, columns: list[str]) -> list[str]:
    """Columns whose frequency takes at least two values on the history; one job for all of them."""
    counts = value_counts(source, columns, _text)
    used = attach(value_counts(history, columns, _text).select("_c", "_t"), counts, ["_c", "_t"])
    tests = used.groupBy("_c").agg(F.min("_n").alias("lo"), F.max("_n").alias("hi"))
    varied = {r["_c"] for r in tests.filter("lo < hi").collect()}       # one row per column
    return [c for c in columns if c in varied]


def frequency_by_mode(history: DataFrame, query: DataFrame, columns: list[str], mode: str) -> DataFrame:
    """`all-train` counts on history, `all-joint` on both; constant frequencies are left out."""
    both = history.unionByName(query)
    source = {"all-train": history, "all-joint": both}[mode]
    return frequency(both, source, informative(history, source, columns))


def normalized_frequency(df: DataFrame, columns: list[str], suffix: str = "_fe") -> DataFrame:
    """Share among present values; missing is -1."""
    if not columns:
        return df
    counts = value_counts(df, columns, _text).filter(F.col("_t").isNotNull())
    counts = attach_bounded(counts, counts.groupBy("_c").agg(F.sum("_n").alias("_all")), ["_c"])      # one row per column
    return _shares(df, counts.withColumn("_q", F.col("_n") / F.col("_all")), columns, _text, suffix, -1.0)


AGGREGATES = {"mean": F.avg, "std": F.stddev_samp}


def value_aggregates(df: DataFrame, columns: list[str], keys: list[str], aggs: tuple = ("mean", "std"),
                     minus_one_is_missing: bool = True) -> DataFrame:
    """{column}_{key}_{agg} for every pair; one aggregation per key serves all columns; missing result is -1."""
    base = df
    for k in keys:
        x = lambda c: F.when(F.col(c) != -1, F.col(c)) if minus_one_is_missing else F.col(c)
        table = base.groupBy(k).agg(*[AGGREGATES[a](x(c)).alias(f"{c}_{k}_{a}") for c in columns for a in aggs])
        df = attach(df, table, [k])
        names = [f"{c}_{k}_{a}" for c in columns for a in aggs]
        df = df.withColumns({n: F.coalesce(F.col(n), F.lit(-1.0)) for n in names})
    return df


def distinct_counts(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """{key}_{column}_ct: distinct present values of the column in the key."""
    base = df
    for k in keys:
        df = with_distinct(df, distinct_per_key(base, [k], columns), [k], [f"{k}_{c}_ct" for c in columns])
    return df
