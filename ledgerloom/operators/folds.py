"""Forward folds with an embargo, hold-outs, month groups, samples, horizons."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.tokens import seeded
from .joins import attach_bounded
from .ranks import ordinal, quantiles


def windows(df: DataFrame, day: str, history_end: float, valid_start: float,
            valid_end: float | None) -> tuple[DataFrame, DataFrame]:
    """History and validation rows; the rows between are in neither, so no feature can see them."""
    valid = F.col(day) >= valid_start
    if valid_end is not None:
        valid = valid & (F.col(day) < valid_end)
    return df.filter(F.col(day) < history_end), df.filter(valid)


def assign_folds(df: DataFrame, day: str, folds: tuple) -> DataFrame:
    """One row per (row, fold, side). A row may be history in several folds."""
    sides = []
    for n, (end, start, stop) in enumerate(folds):
        inside = F.col(day) >= start if stop is None else (F.col(day) >= start) & (F.col(day) < stop)
        side = F.when(F.col(day) < end, "history").when(inside, "valid")
        sides.append(F.when(side.isNotNull(), F.struct(F.lit(n).alias("fold"), side.alias("side"))))
    return (df.withColumn("_f", F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())))
            .withColumns({"fold": F.col("_f.fold"), "side": F.col("_f.side")}).drop("_f"))


def fold_table(df: DataFrame, day: str, label: str, folds: tuple) -> DataFrame:
    """Rows and label rates per fold, in one pass without copying rows."""
    aggs = []
    for n, (end, start, stop) in enumerate(folds):
        history = F.col(day) < end
        valid = (F.col(day) >= start) & (F.lit(True) if stop is None else F.col(day) < stop)
        aggs.append(F.struct(
            F.lit(n).alias("fold"), F.lit(start - end).alias("embargo_days"),
            F.count_if(history).alias("history_rows"), F.count_if(valid).alias("valid_rows"),
            F.avg(F.when(history, F.col(label))).alias("history_rate"),
            F.avg(F.when(valid, F.col(label))).alias("valid_rate")).alias(f"f{n}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*one.columns)).alias("_f")).select("_f.*")


def time_holdout(df: DataFrame, dt: str, share: float = 0.8) -> DataFrame:
    """Flag the rows after the `share` quantile of time."""
    cut = quantiles(df.withColumn("_one", F.lit(1)), ["_one"], dt, {"_cut": share})
    d = attach_bounded(df.withColumn("_one", F.lit(1)), cut, ["_one"])      # one row
    return d.withColumn("holdout", (F.col(dt) > F.col("_cut")).cast("int")).drop("_one", "_cut")


def month_groups(df: DataFrame, month: str) -> list:
    """The months present, for leave-one-month-out; at most one entry per month of data."""
    return sorted(r[0] for r in df.select(month).distinct().collect())


def stratified_folds(df: DataFrame, label: str, row_id: str, folds: int, seed: int) -> DataFrame:
    """Random folds of equal size within each label value, by rank of a seeded hash."""
    d = df.withColumn("_h", F.xxhash64(F.lit(seed), row_id))
    return (ordinal(d, ["_h", row_id], "_k", [label])
            .withColumn("fold", F.pmod(F.col("_k") - 1, F.lit(folds))).drop("_h", "_k"))


def hash_sample(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows (or all), the ones with the smallest seeded hash; the same rows on every run."""
    d = df.withColumn("_h", seeded(seed, row_id))
    total = df.count()
    if n >= total:
        return df
    # a threshold that leaves a few more than n rows; only those are ordered
    share = (n + 8 * n ** 0.5 + 50) / total
    low = d.filter(F.col("_h") < int(share * 16**15)) if share < 0.9 else d
    if share < 0.9 and low.count() < n:
        low = d
    return ordinal(low, ["_h", row_id], "_k").filter(F.col("_k") <= n).drop("_h", "_k")


def horizon(query: DataFrame, history: DataFrame, dt: str, out: str = "horizon") -> DataFrame:
    """Days from the end of the history."""
    last = history.agg(F.max(dt).alias("_last")).withColumn("_one", F.lit(1))
    d = attach_bounded(query.withColumn("_one", F.lit(1)), last, ["_one"])  # one row
    return d.withColumn(out, (F.col(dt) - F.col("_last")) / F.lit(86400.0)).drop("_one", "_last")


def pair_counts(df: DataFrame, day: str, pairs: tuple) -> DataFrame:
    """History, future and skipped rows of every back-test pair, in one pass."""
    aggs = []
    for i, (name, stage, h, end, start, stop) in enumerate(pairs):
        d = F.col(day)
        aggs.append(F.struct(F.lit(name).alias("name"), F.lit(stage).alias("stage"), F.lit(h).alias("horizon"),
                             F.count_if(d < end).alias("history_rows"), F.count_if((d >= start) & (d < stop)).alias("future_rows"),
                             F.count_if((d >= end) & (d < start)).alias("skipped")).alias(f"p{i}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*one.columns)).alias("_p")).select("_p.*")
