"""Ranks, ROC AUC, quantiles and rank matching without a single-task global sort."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.store import save
from .joins import attach, attach_rows
from .timeline import Timeline

ALL = "_all"


def _grouped(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn(ALL, F.lit(0)), [ALL])


def _rank_table(d: DataFrame, value: str, out: str, keys: list[str], pct: bool, max_rows: int) -> DataFrame:
    counts = (d.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    tl = Timeline(counts, keys, ["_v"], max_rows)
    below = tl.prefix({"_below": F.col("_n")})
    rank = F.col("_below") + (F.col("_n") + 1) / F.lit(2.0)
    if pct:
        below = tl.total({"_total": F.sum("_n")}, below)
        rank = rank / F.col("_total")
    return below.select(*keys, F.col("_v").alias(value), rank.alias(out))


def rank_many(df: DataFrame, wanted: list[tuple[str, str, list[str]]], pct: bool = True,
              max_rows: int | None = None) -> DataFrame:
    """Several ranks (value, out, by). All tables are made from `df` itself, so the plan grows by one branch each."""
    d = df.withColumn(ALL, F.lit(0))
    out = d
    for value, name, by in wanted:
        keys = list(by) or [ALL]
        out = attach(out, _rank_table(d, value, name, keys, pct, max_rows), keys + [value])
    return out.drop(ALL)


def average_rank(df: DataFrame, value: str, out: str, by: list[str] = (), pct: bool = True,
                 max_rows: int | None = None) -> DataFrame:
    """Rank with ties averaged, divided by the count; missing values get no rank.

    Equal values are one row after the first aggregation, so a tie never crosses a slice boundary.
    """
    return rank_many(df, [(value, out, by)], pct, max_rows)


def auc(df: DataFrame, label: str, score: str, by: list[str] = (), out: str = "auc", weight: str | None = None,
        max_rows: int | None = None) -> DataFrame:
    """Area under the ROC curve per `by`; NULL with one class. Rank-sum form with tied scores halved."""
    d, keys = _grouped(df, by)
    n = F.col(weight) if weight else F.lit(1)
    counts = (d.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("_v"))
              .agg(F.sum(F.when(F.col(label) == 1, n).otherwise(0)).alias("_pos"),
                   F.sum(F.when(F.col(label) == 1, 0).otherwise(n)).alias("_neg")))
    below = Timeline(counts, keys, ["_v"], max_rows).prefix({"_below": F.col("_neg")})
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0)))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return (below.groupBy(*keys).agg(
        (F.sum("_pos") + F.sum("_neg")).alias("rows"), F.sum("_pos").alias("positives"),
        F.try_divide(wins, pairs).alias(out)).drop(ALL))


def ordinal(df: DataFrame, order: list[str], out: str, by: list[str] = (), max_rows: int | None = None) -> DataFrame:
    """Row number from 1 in a total order."""
    d, keys = _grouped(df, by)
    tl = Timeline(d, keys, order, max_rows)
    d = tl.settle(tl.prefix({out: F.lit(1)})).withColumn(out, F.col(out) + 1)
    return d if by else d.drop(ALL)


def rank_match(df: DataFrame, signal: str, reference: str, row_id: str, out: str, by: list[str] = (),
               max_rows: int | None = None) -> DataFrame:
    """The row with the k-th smallest signal gets the k-th smallest reference value; ties by row id."""
    d, keys = _grouped(df, by)
    placed = ordinal(d, [signal, row_id], "_k", keys, max_rows)
    values = ordinal(d.select(*keys, reference, row_id), [reference, row_id], "_k", keys, max_rows)
    values = values.select(*keys, "_k", F.col(reference).alias(out))
    return attach_rows(placed, values, keys + ["_k"]).drop("_k", ALL)


def spearman(df: DataFrame, a: str, b: str, by: list[str] = (), out: str = "spearman",
             max_rows: int | None = None) -> DataFrame:
    d = rank_many(df, [(a, "_ra", by), (b, "_rb", by)], max_rows=max_rows)
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.corr("_ra", "_rb").alias(out))


def quantiles(df: DataFrame, key: list[str], value: str | Column, probs: dict[str, float],
              max_rows: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one row per key.

    `percentile` keeps the distinct values of a group in one task, so it serves keys up to `max_rows` distinct
    values; larger keys are counted per value and read off the running count of the sorted values.
    """
    rows = df.select(*key, (F.col(value) if isinstance(value, str) else value).alias("_v"))
    d, keys = _grouped(rows, key)
    named = d.filter(F.col("_v").isNotNull())
    tl = Timeline(named.select(*keys, "_v"), keys, ["_v"], max_rows)
    light, heavy = tl.light_and_heavy()
    out = light.groupBy(*keys).agg(*[F.percentile("_v", q).alias(n) for n, q in probs.items()])
    if heavy is not None:
        hot = save(heavy.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))     # each value once, however often it occurs
        below = attach(tl.on(hot).prefix({"_below": F.col("_n")}),
                       hot.groupBy(*keys).agg(F.sum("_n").alias("_total")), keys)
        picks = []
        for n, q in probs.items():
            at = (F.col("_total") - 1) * F.lit(q)
            lo, hi = F.floor(at), F.ceil(at)
            holds = lambda p: (F.col("_below") <= p) & (p < F.col("_below") + F.col("_n"))
            low, high = F.max(F.when(holds(lo), F.col("_v"))), F.max(F.when(holds(hi), F.col("_v")))
            share = F.max(at - lo)
            picks.append((low + (high - low) * share).alias(n))
        out = out.unionByName(below.groupBy(*keys).agg(*picks))
    return out.drop(ALL)


def attach_quantiles(df: DataFrame, key: list[str], value: str, probs: dict[str, float],
                     max_rows: int | None = None) -> DataFrame:
    return attach(df, quantiles(df, key, value, probs, max_rows), key)
