"""Statistics of an entity on each of its rows. They look at all rows of the entity, later ones too."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rowwise import divide
from ..functions.tokens import token
from .joins import attach
from .ranks import quantiles
from .stacked import distinct_per_key, with_distinct
from .timeline import HALO, Timeline


def _z(x: str | Column, mean: str, std: str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return divide(x - F.col(mean), F.nullif(std, F.lit(0.0)))


def sequence(df: DataFrame, key: list[str], dt: str, row_id: str, amount: str, prefix: str,
             counters: list[str] = (), max_rows: int | None = None, tl: Timeline | None = None) -> DataFrame:
    """Position, gaps, span, amount statistics and neighbour amounts; with `counters`, their steps to the neighbours.

    A counter step that equals the amount between two rows (within 0.011) marks the rows as consecutive.
    """
    tl = tl or Timeline(df, key, [dt, row_id], max_rows)
    return tl.apart(lambda part: _sequence(part, dt, amount, prefix, counters))


def _sequence(tl: Timeline, dt: str, amount: str, prefix: str, counters: list[str]) -> DataFrame:
    p = lambda n: f"{prefix}_{n}"
    d = tl.with_neighbours(1, 1, tl.prefix({p("order"): F.lit(1)}))
    w = tl.window
    d = d.withColumns({p("previous_dt"): F.col(dt) - F.lag(dt).over(w), p("next_dt"): F.lead(dt).over(w) - F.col(dt),
                       p("previous_amt"): F.lag(amount).over(w), p("next_amt"): F.lead(amount).over(w)})
    for c in counters:
        before, after = F.col(c) - F.lag(c).over(w), F.lead(c).over(w) - F.col(c)
        d = d.withColumns({p(f"{c}_previous_delta"): before, p(f"{c}_next_delta"): after})
        d = d.withColumns({p(f"{c}_previous_error"): F.col(p(f"{c}_previous_delta")) - F.col(p("previous_amt")),
                           p(f"{c}_next_error"): F.col(p(f"{c}_next_delta")) - F.col(amount)})
        close = lambda n: F.coalesce(F.abs(p(n)) <= 0.011, F.lit(False)).cast("int")
        d = d.withColumns({p(f"{c}_previous_match"): close(f"{c}_previous_error"),
                           p(f"{c}_next_match"): close(f"{c}_next_error"),
                           p(f"{c}_previous_same"): close(f"{c}_previous_delta"),
                           p(f"{c}_next_same"): close(f"{c}_next_delta")})
    if counters:
        d = d.withColumns({p(f"{side}_{what}es" if what == "match" else f"{side}_unchanged"):
                           sum((F.col(p(f"{c}_{side}_{what}")) for c in counters), F.lit(0))
                           for side in ("previous", "next") for what in ("match", "same")})
    d = d.filter(~F.col(HALO))
    d = tl.total({p("count"): F.count(F.lit(1)), p("first_dt"): F.min(dt), p("last_dt"): F.max(dt),
                  p("mean_dt"): F.avg(p("previous_dt")), p("std_dt"): F.stddev_samp(p("previous_dt")),
                  p("mean_amt"): F.avg(amount), p("std_amt"): F.stddev_samp(amount),
                  p("min_amt"): F.min(amount), p("max_amt"): F.max(amount)}, d)
    d = tl.median({p("median_dt"): p("previous_dt"), p("median_amt"): amount}, d)
    d = d.withColumns({
        p("order_from_end"): F.col(p("count")) - F.col(p("order")) - 1,
        p("order_fraction"): divide(F.col(p("order")), F.nullif(F.col(p("count")) - 1, F.lit(0))),
        p("time_span"): F.col(p("last_dt")) - F.col(p("first_dt")),
        p("since_first"): F.col(dt) - F.col(p("first_dt")), p("to_last"): F.col(p("last_dt")) - F.col(dt),
        p("amt_to_mean"): divide(F.col(amount), F.nullif(p("mean_amt"), F.lit(0.0))),
        p("amt_zscore"): _z(amount, p("mean_amt"), p("std_amt")),
        p("has_previous"): (F.col(p("order")) > 0).cast("int"),
        p("has_next"): (F.col(p("order")) < F.col(p("count")) - 1).cast("int")})
    return tl.settle(d).drop(p("first_dt"), p("last_dt"))


def profile(df: DataFrame, key: list[str], dt: str, row_id: str, amount: str, ids: list[str], numerics: list[str],
            with_range: list[str] = (), prefix: str = "user", max_rows: int | None = None) -> DataFrame:
    """Sequence features plus same-amount share, active days, per-id spread and per-number mean and deviation."""
    return Timeline(df, key, [dt, row_id], max_rows).apart(
        lambda part: _profile(part, dt, row_id, amount, ids, numerics, with_range, prefix, max_rows))


def _profile(tl: Timeline, dt: str, row_id: str, amount: str, ids: list[str], numerics: list[str], with_range: list[str], prefix: str,
             max_rows: int | None) -> DataFrame:
    """What needs another order than time comes first, while rows are narrow; the rest shares the order of the sequence."""
    p = lambda n: f"{prefix}_{n}"
    d = tl.total({p("same_amount_count"): F.count(F.lit(1))}, tl.rows, [amount])
    for c in ids:       # in this order one sort serves both
        d = tl.distinct({p(f"{c}_nunique"): c}, d)
        d = tl.total({p(f"{c}_same"): F.count(F.lit(1))}, d, [c])
    d = sequence(d, tl.key, dt, row_id, amount, prefix, (), max_rows, tl.on(d)).withColumn("_day", F.floor(F.col(dt) / 86400))
    if tl.cuts is None:     # rows of a day are neighbours
        new = F.col("_day").isNotNull() & ~F.col("_day").eqNullSafe(F.lag("_day").over(tl.window))
        d = d.withColumn("_new", new.cast("int"))
        d = tl.total({p("active_days"): F.sum("_new")}, d).drop("_new")
    else:
        d = tl.distinct({p("active_days"): "_day"}, d)
    aggs = {}
    for c in numerics:
        aggs |= {p(f"{c}_mean"): F.avg(c), p(f"{c}_std"): F.stddev_samp(c)}
    for c in with_range:
        aggs |= {p(f"{c}_min"): F.min(c), p(f"{c}_max"): F.max(c)}
    d = tl.total(aggs, d) if aggs else d
    n = F.col(p("count"))
    d = d.withColumns({p("same_amount_fraction"): F.col(p("same_amount_count")) / n,
                       p("is_multirow"): (n > 1).cast("int")}
                      | {p(f"{c}_same_fraction"): F.col(p(f"{c}_same")) / n for c in ids})
    return tl.settle(d).drop("_day", *[p(f"{c}_same") for c in ids])


def wide_profile(df: DataFrame, key: list[str], full: list[str], short: list[str], prefix: str = "wide") -> DataFrame:
    """Mean, deviation, z-score of every column in the entity; for `full` also range, distinct rate, difference.

    One partially aggregated group-by holds all statistics of all columns, one more the distinct values of all columns.
    """
    p = lambda c, n: f"{prefix}_{c}_{n}"
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in [*full, *short]:
        aggs += [F.avg(c).alias(p(c, "mean")), F.stddev_samp(c).alias(p(c, "std"))]
    for c in full:
        aggs += [(F.max(c) - F.min(c)).alias(p(c, "range"))]
    table = df.groupBy(*key).agg(*aggs)
    if full:
        table = with_distinct(table, distinct_per_key(df, key, full), key, [f"_u{i}" for i in range(len(full))])
        table = table.withColumns({p(c, "nunique_rate"): F.col(f"_u{i}") / F.col("_n") for i, c in enumerate(full)}).drop(*[f"_u{i}" for i in range(len(full))])
    d = attach(df, table.drop("_n"), key)
    return d.withColumns({p(c, "diff_mean"): F.col(c) - F.col(p(c, "mean")) for c in full}
                         | {p(c, "zscore"): _z(c, p(c, "mean"), p(c, "std")) for c in [*full, *short]})


def rate_profile(df: DataFrame, key: list[str], rates: list[str], prefix: str = "wide") -> DataFrame:
    """Entity mean of a per-row rate and the row's difference to it."""
    table = df.groupBy(*key).agg(*[F.avg(c).alias(f"{prefix}_{c}_mean") for c in rates])
    return attach(df, table, key).withColumns({f"{prefix}_{c}_diff": F.col(c) - F.col(f"{prefix}_{c}_mean") for c in rates})


def amount_groups(df: DataFrame, key: list[str], amount: str, prefix: str, max_rows: int | None = None) -> DataFrame:
    """Log count, mean, deviation, median, difference, z-score, share of rows with the same amount in cents."""
    p = lambda n: f"{prefix}_{n}"
    d = df.withColumn("_cents", F.rint(F.col(amount) * 100))
    names = [f"_k{i}" for i in range(len(key))]
    d = d.withColumns({n: token(k) for n, k in zip(names, key)})
    stats = d.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.avg(amount).alias(p("mean")),
                                  F.stddev_samp(amount).alias(p("std")))
    stats = attach(stats, quantiles(d, names, amount, {p("median"): 0.5}, max_rows), names)
    same = d.groupBy(*names, "_cents").agg(F.count(F.lit(1)).alias("_same"))
    d = attach(attach(d, same, [*names, "_cents"]), stats, names)
    return d.withColumns({p("log_count"): F.log1p("_n"), p("diff_mean"): F.col(amount) - F.col(p("mean")),
                          p("zscore"): _z(amount, p("mean"), p("std")),
                          p("same_amount_fraction"): F.col("_same") / F.col("_n")}).drop("_cents", "_n", "_same", *names)


def client_profile(df: DataFrame, key: list[str], dt: str, row_id: str, day: str, means: list[str],
                   details: list[str]) -> DataFrame:
    """One row per client: means; deviation, min, max, first and last present value of the details; activity.

    First and last are order statistics of an aggregation, so a client's rows need not meet in one task.
    """
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(dt, row_id))
    aggs = [F.avg(c).alias(f"mean_{c}") for c in means]
    for name, make in (("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
        aggs += [make(c).alias(f"{name}_{c}") for c in details]
    aggs += [F.min_by(c, at(c)).alias(f"first_{c}") for c in details]
    aggs += [F.max_by(c, at(c)).alias(f"last_{c}") for c in details]
    t = df.groupBy(*key).agg(*aggs, F.count(F.lit(1)).alias("client_count"),
                             (F.max(day) - F.min(day)).alias("client_day_span"),
                             F.stddev_samp(day).alias("client_day_std"))
    return t.withColumns({"client_log_count": F.log1p("client_count"),
                          "client_per_day": F.col("client_count") / (F.col("client_day_span") + 1)})


def pool_tables(rows: DataFrame, key: list[str], score: str, methods: dict[str, str], max_rows: int | None = None) -> DataFrame:
    """Pooled scores (output name -> mean, max, q75, …) and row count `_n` per entity: one aggregation for all but the
    quantiles, one for all quantiles."""
    plain = [{"mean": F.avg, "max": F.max}[m](score).alias(out) for out, m in methods.items() if not m.startswith("q")]
    table = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *plain)
    probs = {out: int(m[1:]) / 100 for out, m in methods.items() if m.startswith("q")}
    return attach(table, quantiles(rows, key, score, probs, max_rows), key) if probs else table


def pool_table(rows: DataFrame, key: list[str], score: str, method: str, out: str, max_rows: int | None = None) -> DataFrame:
    """Pooled score of one method and row count `_n` per entity."""
    return pool_tables(rows, key, score, {out: method}, max_rows)


def pooled(df: DataFrame, key: list[str], score: str, method: str, out: str, valid: Column | None = None,
           size: tuple[int, int | None] = (1, None), max_rows: int | None = None) -> DataFrame:
    """Score pooled in an entity (mean, max, q75, q90). Invalid rows and entities outside `size` keep their score."""
    ok = F.lit(True) if valid is None else valid
    fits = ok & (F.col("_n") >= size[0])
    if size[1] is not None:
        fits = fits & (F.col("_n") <= size[1])
    table = pool_table(df.filter(ok), key, score, method, "_pool", max_rows)
    return attach(df, table, key).withColumn(out, F.when(fits, F.col("_pool")).otherwise(F.col(score))).drop("_pool", "_n")


def pull(df: DataFrame, score: str, pool: str, weight: float, out: str) -> DataFrame:
    return df.withColumn(out, (1 - weight) * F.col(score) + weight * F.col(pool))

