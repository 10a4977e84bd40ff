"""Back-test pairs: for every pair, its history and future rows with what they may know, without a job per pair.

A pair (name, stage, horizon, end, start, stop) has the rows before `end` as history and those from `start` to `stop` as future; the rows
between are unknown to both. Cut-offs are nested, so the histories are prefixes of one timeline: one ordered pass per entity gives every row
its causal state, and one aggregation per entity gives the state at all cut-offs, an array with an element per pair. A history row knows what
the pass says. A future row knows the state at its pair's cut-off and the future rows before it: its place is that of the pass less the rows
before `start`, and its last rows are those of the pass from `start` on, after the last ones before `end`. So rows are copied only into the
pairs whose frame they belong to, and an entity with a third of all rows is cut by its timeline and aggregated before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rowwise import divide
from ..sources.store import save
from .joins import attach, attach_bounded
from .timeline import HALO, Timeline, earlier

ROLLING = (2, 3, 4, 5, 10, 20)


def bounds(pairs: tuple, day: int) -> list[tuple]:
    """(name, stage, horizon, end, start, stop) in seconds."""
    return [(n, s, h, end * day, start * day, stop * day) for n, s, h, end, start, stop in pairs]


def first_seen(df: DataFrame, uid: str, valid: str, dt: str, out: str) -> DataFrame:
    """Time of the first valid row with the row's key: whether a key is known at a cut-off is a comparison, for any cut-off."""
    first = df.filter(F.col(valid)).groupBy(uid).agg(F.min(dt).alias(out))
    return attach(df, first, [uid]).withColumn(out, F.when(F.col(valid), F.col(out)))


def states(rows: DataFrame, key: list[str], dt: str, row_id: str, label: str, amount: str, ids: list[str], cuts: list[tuple]) -> DataFrame:
    """Per entity an array `_state` with one element per pair: the history at its cut-off, and statistics over history and future together."""
    t, y = F.col(dt), F.col(label).cast("int")
    inside = [(t < end) | ((t >= start) & (t < stop)) for *_, end, start, stop in cuts]
    aggs = {}
    for end in {c[3] for c in cuts}:
        past = t < end
        aggs |= {f"n{end}": F.count_if(past), f"y{end}": F.coalesce(F.sum(F.when(past, y)), F.lit(0)), f"at{end}": F.max(F.when(past & (F.col(label) == 1), t)),
                 f"last{end}": F.max(F.when(past, F.struct(t.alias("t"), F.col(row_id).alias("i"), F.col("_recent").alias("r"))))}
    aggs |= {f"b{start}": F.count_if(t < start) for start in {c[4] for c in cuts}}
    for i, ok in enumerate(inside):
        aggs |= {f"rows{i}": F.count_if(ok), f"mean{i}": F.avg(F.when(ok, F.col(amount))), f"std{i}": F.stddev_samp(F.when(ok, F.col(amount))),
                 f"span{i}": F.max(F.when(ok, t)) - F.min(F.when(ok, t))}
    table = rows.groupBy(*key).agg(*[a.alias(n) for n, a in aggs.items()])
    if ids:
        # which pairs see a value is a bit mask, so one aggregation counts distinct values for all columns and pairs
        mask = sum((F.when(ok, F.lit(1 << i)).otherwise(0) for i, ok in enumerate(inside)), F.lit(0))
        long = rows.select(*key, mask.alias("_m"), F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.col(c).cast("string").alias("v")) for k, c in enumerate(ids)])).alias("_s"))
        seen = long.filter("_s.v IS NOT NULL").groupBy(*key, "_s.c", "_s.v").agg(F.bit_or("_m").alias("_m"))
        counts = seen.groupBy(*key).agg(*[F.count_if((F.col("c") == k) & (F.col("_m").bitwiseAND(1 << i) != 0)).alias(f"u{k}_{i}")
                                          for k in range(len(ids)) for i in range(len(cuts))])
        table = attach(table, counts, key)
    element = lambda i, end, start: F.struct(
        F.col(f"n{end}").alias("n"), F.col(f"y{end}").alias("y"), F.col(f"at{end}").alias("at"), F.coalesce(F.col(f"last{end}.r"), F.array().cast("array<bigint>")).alias("recent"),
        F.col(f"b{start}").alias("before"), F.col(f"rows{i}").alias("rows"), F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("std"), F.col(f"span{i}").alias("span"),
        *[F.coalesce(F.col(f"u{k}_{i}"), F.lit(0)).alias(f"u{k}") for k in range(len(ids))])
    return table.select(*key, F.array(*[element(i, c[3], c[4]) for i, c in enumerate(cuts)]).alias("_state"))


def _gaps(seq: Column) -> Column:
    n = F.size(seq)
    return F.zip_with(F.slice(seq, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(seq, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: a - b)


def _last(array: Column, k: int) -> Column:
    return F.slice(array, F.greatest(F.size(array) - (k - 1), F.lit(1)), F.lit(k))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _mean(array: Column) -> Column:
    return divide(_total(array), F.nullif(F.size(array), F.lit(0)))


def _latest(array: Column) -> Column:
    return F.element_at(F.when(F.size(array) > 0, array), -1)


def _deviation(array: Column, mean: Column) -> Column:
    squares = F.aggregate(array, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.size(array) > 1, F.sqrt(squares / (F.size(array) - 1)))


def pair_frames(df: DataFrame, key: list[str], dt: str, row_id: str, label: str, amount: str, ids: list[str], pairs: tuple, day: int = 86400,
                rolling: tuple = ROLLING, smoothing: float = 20.0, uids: tuple = ("strict", "card", "mail"), max_rows: int | None = None) -> DataFrame:
    """One row per (pair, history or future row): pair, stage, horizon, side, the row's id, and

    * segment of future rows: strict, partial, cold by the keys `{name}_uid` / `{name}_valid` of `uids` (the first is the strict one);
    * known_*: label history of the entity (A13), strictly earlier rows for history, the cut-off's totals for future rows;
    * order, since_previous, gap_mean_k, gap_std_k: place and rolling gaps in history and future (W8, W9);
    * entity_*: rows, mean and deviation of the amount, span, distinct values of `ids` over history and future (A7), and the row's z-score.
    """
    cuts, deep = bounds(pairs, day), max(rolling)
    y, t = F.col(label).cast("int"), F.col(dt)
    d = df.select(*dict.fromkeys([row_id, *key, dt, label, amount, *ids, *[f"{u}_{x}" for u in uids for x in ("uid", "valid")]]))
    d = d.withColumns({"_k": F.lit(0)})
    for u in uids:
        d = first_seen(d, f"{u}_uid", f"{u}_valid", dt, f"_first_{u}")
    d = d.drop(*[f"{u}_{x}" for u in uids for x in ("uid", "valid") if f"{u}_{x}" not in (*key, *ids)])
    tl = Timeline(d, key, [dt, row_id], max_rows)
    d = tl.with_neighbours(deep, 0)
    d = d.withColumn("_recent", F.collect_list(dt).over(tl.window.rowsBetween(-deep, 0)))
    d = tl.settle(tl.prefix({"_before": F.lit(1)}, df=d.filter(~F.col(HALO))))
    d = save(earlier(d, key, dt, row_id, {"_n": F.lit(1), "_y": y}, {"_at": F.when(F.col(label) == 1, t)}, max_rows, tl.on(d)))
    rates = d.agg(F.array(*[F.avg(F.when(t < c[3], y)) for c in cuts]).alias("_rates"))
    table = states(d, key, dt, row_id, label, amount, ids, cuts)
    # the gaps of a history row are the same in all its pairs: computed once, before rows are copied
    d = d.withColumn("_own", _gaps(_last(F.col("_recent"), deep + 1)))
    d = d.withColumns({"_own_last": _latest(F.col("_own"))} | {f"_own_{k}": _mean(_last(F.col("_own"), k)) for k in rolling})
    d = d.withColumns({f"_own_std_{k}": _deviation(_last(F.col("_own"), k), F.col(f"_own_{k}")) for k in rolling}).drop("_own")
    d = attach_bounded(attach(d, table, key), rates.withColumn("_k", F.lit(0)), ["_k"]).drop("_k")      # one row
    frame = lambda i, c: F.when((t < c[3]) | ((t >= c[4]) & (t < c[5])), F.struct(
        F.lit(c[0]).alias("pair"), F.lit(c[1]).alias("stage"), F.lit(c[2]).alias("horizon"), (t < c[3]).alias("past"), F.lit(c[3]).alias("end"), F.lit(c[4]).alias("start"),
        F.get("_state", F.lit(i)).alias("s"), F.get("_rates", F.lit(i)).alias("rate")))
    d = d.withColumn("_p", F.explode(F.filter(F.array(*[frame(i, c) for i, c in enumerate(cuts)]), lambda x: x.isNotNull()))).drop("_state", "_rates")
    past, s = F.col("_p.past"), F.col("_p.s")
    known = [F.coalesce(F.col(f"_first_{u}") < F.col("_p.end"), F.lit(False)) for u in uids]
    wider = F.lit(False)
    for k in known[1:]:
        wider = wider | k
    d = d.withColumns({"_n": F.when(past, F.col("_n")).otherwise(s["n"]), "_y": F.when(past, F.col("_y")).otherwise(s["y"]), "_at": F.when(past, F.col("_at")).otherwise(s["at"]),
                       "order": F.when(past, F.col("_before")).otherwise(s["n"] + F.col("_before") - s["before"]),
                       "_seq": F.when(~past, F.concat(s["recent"], F.filter("_recent", lambda x: x >= F.col("_p.start"))))})
    d = d.withColumn("_gaps", F.when(~past, _gaps(_last(F.col("_seq"), deep + 1))))
    out = {"pair": F.col("_p.pair"), "stage": F.col("_p.stage"), "horizon": F.col("_p.horizon"), "side": F.when(past, "history").otherwise("future"),
           "segment": F.when(~past, F.when(known[0], "strict").when(wider, "partial").otherwise("cold")),
           "known_rows": F.col("_n"), "known_positives": F.col("_y"), "known_since_positive": t - F.col("_at"),
           "known_rate_smoothed": (F.col("_y") + smoothing * F.col("_p.rate")) / (F.col("_n") + smoothing),
           "since_previous": F.when(past, F.col("_own_last")).otherwise(_latest(F.col("_gaps"))),
           "entity_rows": s["rows"], "entity_mean_amt": s["mean"], "entity_std_amt": s["std"], "entity_span": s["span"],
           "amt_zscore": F.when(s["std"] > 1e-9, (F.col(amount) - s["mean"]) / s["std"])}
    out |= {f"{c}_nunique": s[f"u{k}"] for k, c in enumerate(ids)}
    for k in rolling:
        out[f"gap_mean_{k}"] = F.when(past, F.col(f"_own_{k}")).otherwise(_mean(_last(F.col("_gaps"), k)))
    d = d.withColumns(out)
    d = d.withColumns({f"gap_std_{k}": F.when(past, F.col(f"_own_std_{k}")).otherwise(_deviation(_last(F.col("_gaps"), k), F.col(f"gap_mean_{k}")))
                       for k in rolling})
    names = ["pair", "stage", "horizon", "side", "segment", "known_rows", "known_positives", "known_rate_smoothed", "known_since_positive", "order", "since_previous",
             *[f"gap_{x}_{k}" for k in rolling for x in ("mean", "std")], "entity_rows", "entity_mean_amt", "entity_std_amt", "entity_span", "amt_zscore",
             *[f"{c}_nunique" for c in ids]]
    return d.select(row_id, *names)
