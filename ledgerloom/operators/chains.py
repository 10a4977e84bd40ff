"""Transaction chains: a row continues the row whose end counter (start + amount) is its start counter.

Counters are whole thousandths; ends within one of the start match. Every row looks up the latest earlier matching
row of its entity. That lookup does not depend on how chains were formed, so it is a distributed as-of lookup, and a
chain is a tree of these links. (A limit on a chain's size, or votes of several counters, would make every choice depend on
all earlier ones of a family of rows; that rule has no distributed form here and is left out.)
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.store import save
from .joins import attach
from .timeline import Timeline


def _latest(df: DataFrame, uid: str, dt: str, row_id: str, start: str, end: str, max_rows: int) -> DataFrame:
    """(row, offset -1/0/1, at): latest earlier row (time, id) of the entity whose end is start + offset.

    Probes and ends meet in one ordering, so no pair of rows is ever formed.
    """
    rows = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    ends = rows.select(uid, F.col(end).cast("long").alias("_v"), dt, row_id, F.lit(1).alias("_kind"), F.lit(0).alias("_off"))
    probes = (rows.select(uid, F.col(start).cast("long").alias("_s"), dt, row_id, F.lit(0).alias("_kind"),
                          F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("_off"))
              .withColumn("_v", F.col("_s") + F.col("_off")).drop("_s"))
    end_at = F.when(F.col("_kind") == 1, F.struct(F.col(dt).alias("t"), F.col(row_id).alias("i")))
    seen = Timeline(ends.unionByName(probes), [uid, "_v"], [dt, row_id, "_kind"], max_rows).apart(
        lambda part: part.settle(part.prefix(maxes={"_at": end_at})))
    return seen.filter((F.col("_kind") == 0) & F.col("_at").isNotNull()).select(row_id, "_off", "_at")


def parents(df: DataFrame, uid: str, dt: str, row_id: str, start: str, end: str, out: str = "parent",
            max_rows: int | None = None) -> DataFrame:
    """Latest earlier row of the entity whose end lies within one of the row's start."""
    best = _latest(df, uid, dt, row_id, start, end, max_rows).groupBy(row_id).agg(F.max("_at").alias("_at"))
    return attach(df, best.select(row_id, F.col("_at.i").alias(out)), [row_id])


def roots(links: DataFrame, row_id: str, parent: str, out: str) -> DataFrame:
    """Root of every row by pointer doubling: rounds grow with the logarithm of the longest chain."""
    up = save(links.select(row_id, F.coalesce(parent, row_id).alias(out)))
    while True:
        higher = up.select(F.col(row_id).alias("_p"), F.col(out).alias("_up"))
        step = save(up.join(higher, F.col(out) == F.col("_p")).select(
            row_id, F.col("_up").alias(out), (F.col("_up") != F.col(out)).alias("_moved")))
        up = step.drop("_moved")
        if step.filter("_moved").isEmpty():
            return up


def counter_chains(df: DataFrame, uid: str, dt: str, row_id: str, start: str, end: str, out: str = "chain",
                   max_rows: int | None = None) -> DataFrame:
    """Chain of every row, named by its first row."""
    links = parents(df.select(uid, dt, row_id, start, end), uid, dt, row_id, start, end, "_p", max_rows)
    return attach(df, roots(links.select(row_id, "_p"), row_id, "_p", out), [row_id])


def link_rate(df: DataFrame, chain: str, split: str) -> DataFrame:
    """Share of query rows whose chain occurs in history."""
    known = df.filter(F.col(split) == "history").select(chain).distinct().withColumn("_known", F.lit(1))
    q = attach(df.filter(F.col(split) == "query"), known, [chain])
    return q.agg(F.count(F.lit(1)).alias("rows"), F.count("_known").alias("linked"),
                 F.avg(F.coalesce("_known", F.lit(0))).alias("rate"))


def chain_statistics(df: DataFrame, chain: str) -> DataFrame:
    """Chains, linked rows (all but the first of a chain), chains of several rows, their rows, rows of the largest. Sizes are counted once."""
    n, several = F.col("_n"), F.col("_n") > 1
    return df.groupBy(chain).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count(F.lit(1)).alias("chains"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("linked_rows"), F.count_if(several).alias("multirow_chains"),
        F.coalesce(F.sum(F.when(several, n)), F.lit(0)).alias("rows_in_multirow_chains"), F.max(n).alias("max_chain_size"))
