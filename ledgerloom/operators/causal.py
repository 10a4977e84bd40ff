"""What was known before a row: velocity, label history, running behaviour."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import VELOCITY, VELOCITY_SUMS
from ..functions.rowwise import divide
from ..functions.tokens import token
from ..sources.store import save
from .frequency import with_total
from .joins import attach, attach_rows
from .timeline import HALO, Timeline, earlier


def _before_cutoff(df: DataFrame, key: list[str], dt: str, windows: dict[str, int], sums: dict[str, Column]) -> DataFrame:
    """For every window: totals over the rows older than the window, `_{name}_{window}`.

    A sliding frame is re-added for every row. The growing frame "everything up to the cut-off" is not, and the
    window is its difference to the total.
    """
    w = Window.partitionBy(*key).orderBy(dt)
    return df.withColumns({f"_{n}_{name}": F.coalesce(F.sum(c).over(w.rangeBetween(Window.unboundedPreceding, -s - 1)),
                                                      F.lit(0)) for name, s in windows.items() for n, c in sums.items()})


def _before_cutoffs(df: DataFrame, key: list[str], dt: str, windows: dict[str, tuple[int, list[str]]], sums: dict[str, Column],
                    maxes: dict[str, Column], max_rows: int) -> DataFrame:
    """For rows of oversized keys: sums and maxes over all earlier times (`{name}`) and, for every window (seconds, sums wanted), over the
    rows older than the window (`{name}_{window}`).

    Cut-offs are rows of their own (probes), placed before the events of their time, that read the running totals: one ordered pass serves
    the row's own time and all windows.
    """
    heavy = save(df)
    events = save(heavy.groupBy(*key, F.col(dt).alias("_t")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()],
                                                                 *[F.max(c).alias(n) for n, c in maxes.items()])
                  .withColumn("_kind", F.lit(1)))
    back = [0, *[s for s, _ in windows.values()]]
    probes = events.select(*key, F.lit(0).alias("_kind"), F.col("_t").alias("_of"), F.posexplode(F.array(*map(F.lit, back))).alias("_w", "_s"))
    probes = probes.withColumn("_t", F.col("_of") - F.col("_s")).drop("_s")
    rows = Timeline(events, key, ["_t", "_kind"], max_rows).on(events.unionByName(probes, allowMissingColumns=True))
    read = rows.prefix({f"_r_{n}": F.coalesce(F.col(n), F.lit(0)) for n in sums}, {f"_r_{n}": F.col(n) for n in maxes})
    pick = lambda n, i: F.max(F.when(F.col("_w") == i, F.col(f"_r_{n}")))
    read = read.filter(F.col("_kind") == 0).groupBy(*key, F.col("_of").alias(dt)).agg(
        *[pick(n, 0).alias(n) for n in (*sums, *maxes)],
        *[pick(n, i + 1).alias(f"{n}_{name}") for i, (name, (_, wanted)) in enumerate(windows.items()) for n in wanted])
    return attach_rows(heavy, read, [*key, dt])


def velocity(df: DataFrame, key: list[str], dt: str, row_id: str, amount: str, prefix: str = "velocity",
             windows: dict[str, int] = VELOCITY, amount_windows: tuple = VELOCITY_SUMS,
             max_rows: int | None = None) -> DataFrame:
    """Counts, amounts and times of the earlier rows of the key; 16 columns with the default windows.

    Windows include their left edge; rows of equal time do not see each other. Deviations are population ones,
    from moments about the key's mean amount, which do not cancel.
    """
    p = lambda n: f"{prefix}_{n}"
    a = F.col(amount)
    valid = a.isNotNull().cast("int")
    around = F.coalesce(a - F.col("_c"), F.lit(0.0))
    sums = {"_n": F.lit(1), "_v": valid, "_s": F.coalesce(a, F.lit(0.0)), "_d": around, "_q": around * around}
    maxes = {"_last": F.struct(F.col(dt).alias("t"), F.col(row_id).alias("i"), a.alias("a"))}

    def before(tl: Timeline) -> DataFrame:
        d = tl.total({"_c": F.avg(amount), "_first": F.min(dt)}, tl.rows)
        if tl.cuts is not None:
            return _before_cutoffs(d, key, dt, {w: (s, ["_n", "_v", "_s"] if w in amount_windows else ["_n"]) for w, s in windows.items()},
                                   sums, maxes, max_rows)
        d = earlier(d, key, dt, row_id, sums, maxes, max_rows, tl.on(d))
        d = _before_cutoff(d, key, dt, windows, {"n": sums["_n"]})
        return _before_cutoff(d, key, dt, {w: windows[w] for w in amount_windows}, {"v": valid, "s": sums["_s"]})

    d = Timeline(df, key, [dt, row_id], max_rows).apart(before)
    known = F.when(F.col("_v") > 0, F.col("_v"))
    drift = F.col("_d") / known
    variance = F.greatest(F.col("_q") / known - drift * drift, F.lit(0.0))
    out = {p("prior_count"): F.col("_n"), p("since_previous"): F.col(dt) - F.col("_last.t"),
           p("since_first"): F.when(F.col("_n") > 0, F.col(dt) - F.col("_first")),
           p("prior_mean"): F.col("_s") / known, p("prior_std"): F.sqrt(F.when(F.col("_v") > 0, variance)),
           p("diff_previous"): a - F.col("_last.a")}
    out |= {p(f"count_{w}"): F.col("_n") - F.col(f"_n_{w}") for w in windows}
    for w in amount_windows:
        n = F.col("_v") - F.col(f"_v_{w}")
        out[p(f"sum_{w}")] = F.when(n > 0, F.col("_s") - F.col(f"_s_{w}")).otherwise(0.0)
        out[p(f"mean_{w}")] = F.when(n > 0, (F.col("_s") - F.col(f"_s_{w}")) / n)
    d = d.withColumns(out)
    d = d.withColumn(p("zscore"), F.when(F.col(p("prior_std")) > 1e-9, (a - F.col(p("prior_mean"))) / F.col(p("prior_std"))))
    return d.drop("_c", "_first", "_n", "_v", "_s", "_d", "_q", "_last", *[f"_n_{w}" for w in windows],
                  *[f"_{x}_{w}" for w in amount_windows for x in "vs"])


def label_history(history: DataFrame, query: DataFrame, key: list[str], dt: str, row_id: str, label: str,
                  smoothing: tuple = (20.0,), prefix: str = "known", max_rows: int | None = None) -> DataFrame:
    """Known rows, positives, rates and time since the last positive of the entity.

    A history row knows the strictly earlier history rows; a query row knows the whole history of its entity.
    """
    p = lambda n: f"{prefix}_{n}"
    y = F.col(label).cast("int")
    positive_at = F.when(F.col(label) == 1, F.col(dt))
    past = earlier(history, key, dt, row_id, {"_n": F.lit(1), "_y": y}, {"_at": positive_at}, max_rows)
    totals = history.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_y"), F.max(positive_at).alias("_at"))
    ahead = attach(query, totals, key).withColumns({"_n": F.coalesce("_n", F.lit(0)), "_y": F.coalesce("_y", F.lit(0))})
    d = past.withColumn("_side", F.lit("history")).unionByName(ahead.withColumn("_side", F.lit("query")),
                                                               allowMissingColumns=True)
    d = with_total(d, history, "_rate", F.avg(y))
    out = {p("rows"): F.col("_n"), p("positives"): F.col("_y"), p("negatives"): F.col("_n") - F.col("_y"),
           p("rate"): divide(F.col("_y"), F.nullif("_n", F.lit(0))), p("any"): (F.col("_y") > 0).cast("int"),
           p("since_positive"): F.col(dt) - F.col("_at")}
    out |= {p(f"rate_smoothed_{s:g}"): (F.col("_y") + s * F.col("_rate")) / (F.col("_n") + s) for s in smoothing}
    return d.withColumns(out).withColumnRenamed("_side", "side").drop("_n", "_y", "_at", "_rate")


def activity(df: DataFrame, key: list[str], dt: str, row_id: str, counter: str, stated_gap: str, prefix: str = "adv",
             rolling: tuple = (2, 3, 4, 5, 10, 20), max_rows: int | None = None) -> DataFrame:
    """Rows and active days so far, rolling gap statistics, counter step, stated against real gap."""
    return Timeline(df, key, [dt, row_id], max_rows).apart(lambda part: _activity(part, dt, counter, stated_gap, prefix, rolling))


def _activity(tl: Timeline, dt: str, counter: str, stated_gap: str, prefix: str, rolling: tuple) -> DataFrame:
    p = lambda n: f"{prefix}_{n}"
    d = tl.with_neighbours(max(rolling), 0, tl.df.withColumn("_day", F.floor(F.col(dt) / 86400)))
    w = tl.window
    d = d.withColumns({"_gap": F.col(dt) - F.lag(dt).over(w), p("counter_step"): F.col(counter) - F.lag(counter).over(w),
                       "_new": F.coalesce((F.col("_day") != F.lag("_day").over(w)).cast("int"), F.lit(1))})
    for k in rolling:
        recent = w.rowsBetween(-(k - 1), 0)
        d = d.withColumns({p(f"gap_mean_{k}"): F.avg("_gap").over(recent), p(f"gap_std_{k}"): F.stddev_samp("_gap").over(recent)})
    d = tl.prefix({p("prior_count"): F.lit(1), "_days": F.col("_new")}, df=d.filter(~F.col(HALO)))
    d = tl.total({p("total_count"): F.count(F.lit(1))}, d)
    error = F.col(stated_gap) - F.col("_gap") / F.lit(86400.0)
    d = d.withColumns({p("active_days"): F.col("_days") + F.col("_new"), p("gap_error"): error,
                       p("gap_match"): F.coalesce(F.abs(error) <= 1.5, F.lit(False)).cast("int")})
    d = d.withColumn(p("rows_per_day"), (F.col(p("prior_count")) + 1) / F.col(p("active_days")))
    return tl.settle(d).drop("_day", "_gap", "_new", "_days")


def value_memory(df: DataFrame, key: list[str], dt: str, row_id: str, column: str, prefix: str,
                 recent: int = 30 * 86400, max_rows: int | None = None) -> DataFrame:
    """How the row's value relates to the values the entity showed before; missing is a value."""
    p = lambda n: f"{prefix}_{n}"

    def same(tl: Timeline) -> DataFrame:
        d = tl.with_neighbours(1, 0, tl.prefix({p("prior_count"): F.lit(1)}))
        return tl.settle(d.withColumn(p("since_same"), F.col(dt) - F.lag(dt).over(tl.window)))

    def whole(tl: Timeline) -> DataFrame:
        d = tl.with_neighbours(1, 0, tl.prefix({"_order": F.lit(1)}, {"_mode": F.col(p("prior_count")) + 1}))
        return tl.settle(d.withColumn("_was", F.lag("_v").over(tl.window)))

    d = Timeline(df.withColumn("_v", token(column)), [*key, "_v"], [dt, row_id], max_rows).apart(same)
    d = Timeline(d, key, [dt, row_id], max_rows).apart(whole)
    n = F.col(p("prior_count"))
    d = d.withColumns({p("prior_fraction"): divide(n, F.nullif("_order", F.lit(0))), p("seen_before"): (n > 0).cast("int"),
                       p("seen_recently"): F.coalesce(F.col(p("since_same")).between(0, recent), F.lit(False)).cast("int"),
                       p("changed"): (F.col("_was").isNotNull() & (F.col("_was") != F.col("_v"))).cast("int"),
                       p("is_prior_mode"): ((n >= F.coalesce("_mode", F.lit(0))) & (F.col("_order") > 0)).cast("int")})
    return d.drop("_v", "_order", "_mode", "_was")
