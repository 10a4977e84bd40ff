"""Blending of scores: only order counts for the metric, so most layers work on ranks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.store import save
from .entity import pool_tables, pooled, pull
from .joins import attach, attach_bounded
from .ranks import average_rank, rank_many, rank_match


def residual_layers(df: DataFrame, base: str, layers: Sequence[tuple[str, float, Column]], out: str,
                    max_rows: int | None = None) -> DataFrame:
    """Rank the base; mix each layer's rank into its mask; rank again between layers, not after the last."""
    d = rank_many(df, [(base, out, ())] + [(c, f"_l{n}", ()) for n, (c, _, _) in enumerate(layers)], max_rows=max_rows)
    for n, (_, weight, mask) in enumerate(layers):
        if n:
            d = average_rank(save(d.withColumnRenamed(out, "_stage")), "_stage", out, max_rows=max_rows).drop("_stage")
        d = d.withColumn(out, F.when(mask, (1 - weight) * F.col(out) + weight * F.col(f"_l{n}")).otherwise(F.col(out)))
    return d.drop(*[f"_l{n}" for n in range(len(layers))])


def rank_blend(df: DataFrame, weights: dict[str, float], out: str, by: list[str] = (), max_rows: int | None = None) -> DataFrame:
    """Weighted sum of the ranks of the sources, ranked within `by`."""
    d = rank_many(df, [(c, f"_r{i}", by) for i, c in enumerate(weights)], max_rows=max_rows)
    mix = sum((w * F.col(f"_r{i}") for i, w in enumerate(weights.values())), F.lit(0.0))
    return d.withColumn(out, mix).drop(*[f"_r{i}" for i in range(len(weights))])


def by_segment(segment: str, values: dict[str, float], default: float = 0.0) -> Column:
    c = F.lit(default)
    for name, v in values.items():
        c = F.when(F.col(segment) == name, F.lit(float(v))).otherwise(c)
    return c


def segmented_blend(df: DataFrame, current: str, stacked: str, segment: str, row_id: str, weights: dict[str, float],
                    out: str, max_rows: int | None = None) -> DataFrame:
    """Mix the two orders inside each segment, but give every segment exactly the rank values it had."""
    narrow = df.select(row_id, segment, F.col(current).alias("_a"), F.col(stacked).alias("_b"))
    d = rank_many(narrow, [("_a", "_cur", ()), ("_a", "_cs", [segment]), ("_b", "_ss", [segment])], max_rows=max_rows)
    w = by_segment(segment, weights)
    d = save(d.select(row_id, segment, "_cur", ((1 - w) * F.col("_cs") + w * F.col("_ss")).alias("_signal")))
    return attach(df, rank_match(d, "_signal", "_cur", row_id, out, [segment], max_rows).select(row_id, out), [row_id])


def direct_blend(df: DataFrame, baseline: str, signal: str, segment: str, weights: dict[str, float], out: str) -> DataFrame:
    w = by_segment(segment, weights)
    return df.withColumn(out, (1 - w) * F.col(baseline) + w * F.col(signal))


def segment_mix(df: DataFrame, segment: str, weights: dict[str, dict[str, float]], out: str) -> DataFrame:
    """Linear mix of sources with weights per segment."""
    sources = list(next(iter(weights.values())))
    mix = [by_segment(segment, {s: w[c] for s, w in weights.items()}) * F.col(c) for c in sources]
    return df.withColumn(out, sum(mix[1:], mix[0]))


def horizon_mix(df: DataFrame, segment: str, horizon: str, weights: dict[float, dict[str, dict[str, float]]],
                out: str) -> DataFrame:
    """Mix with weights interpolated between the grid horizons, clamped outside, normalised per row."""
    grid = sorted(weights)
    sources = list(next(iter(weights[grid[0]].values())))
    steps = [(float("-inf"), grid[0], grid[0])] + list(zip(grid, grid, grid[1:])) + [(grid[-1], grid[-1], grid[-1])]
    rows = []
    for s in weights[grid[0]]:
        for n, (start, lo, hi) in enumerate(steps):
            stop = steps[n + 1][0] if n + 1 < len(steps) else float("inf")
            rows.append((s, float(start), float(stop), float(lo), float(hi), [float(weights[lo][s][c]) for c in sources],
                         [float(weights[hi][s][c]) for c in sources]))
    table = df.sparkSession.createDataFrame(rows, "_seg string, _start double, _stop double, _lo double, _hi double, "
                                                  "_wl array<double>, _wh array<double>")
    h = F.col(horizon)
    d = df.join(F.broadcast(table), (F.col(segment) == F.col("_seg")) & (h >= F.col("_start")) & (h < F.col("_stop")), "left")
    share = F.coalesce(F.try_divide(h - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    w = [F.col("_wl")[i] + (F.col("_wh")[i] - F.col("_wl")[i]) * share for i in range(len(sources))]
    mix = sum((x * F.col(c) for x, c in zip(w[1:], sources[1:])), w[0] * F.col(sources[0]))
    return d.withColumn(out, F.try_divide(mix, sum(w[1:], w[0]))).drop("_seg", "_start", "_stop", "_lo", "_hi", "_wl", "_wh")


def variants(df: DataFrame, score: str, key: list[str], method: str, weight: float, size: tuple, valid: Column,
             max_rows: int | None = None) -> DataFrame:
    """probability, rank, and both pooled in the entity and pulled to it."""
    d = save(average_rank(df.withColumn("probability", F.col(score)), score, "rank", max_rows=max_rows))
    for c in ("probability", "rank"):
        d = pull(pooled(d, key, c, method, "_p", valid, size, max_rows), c, "_p", weight, f"pooled_{c}").drop("_p")
    return d


def two_source_signals(df: DataFrame, left: str, right: str, prefix: str, steps: tuple = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Convex steps, max, min and geometric mean of two scores."""
    a, b = F.col(left), F.col(right)
    out = {f"{prefix}_{int(round(s * 100)):03d}": s * a + (1 - s) * b for s in steps}
    positive = lambda c: F.greatest(c, F.lit(0.0))
    return df.withColumns(out | {f"{prefix}_max": F.greatest(a, b), f"{prefix}_min": F.least(a, b),
                                 f"{prefix}_geo": F.sqrt(positive(a) * positive(b))})


def source_signals(df: DataFrame, sources: list[str], max_rows: int | None = None) -> DataFrame:
    """Mean score, mean and max rank of all sources, mean rank of every pair."""
    d = rank_many(df, [(c, f"_{c}", ()) for c in sources], max_rows=max_rows)
    r = {c: F.col(f"_{c}") for c in sources}
    total = lambda cs: sum(cs[1:], cs[0])
    out = {"all_score_mean": total([F.col(c) for c in sources]) / len(sources),
           "all_rank_mean": total(list(r.values())) / len(sources), "all_rank_max": F.greatest(*r.values())}
    out |= {f"rank_mean_{a}_{b}": 0.5 * (r[a] + r[b]) for i, a in enumerate(sources) for b in sources[i + 1:]}
    return d.withColumns(out).drop(*[f"_{c}" for c in sources])


def pooling_signals(df: DataFrame, keys: dict[str, list[str]], score: str, methods: tuple = ("mean", "max", "q75"),
                    primary: str | None = None, max_rows: int | None = None) -> DataFrame:
    """Score pooled over every key and method; mean and max of their ranks over keys, and over methods of one key."""
    d = df
    for k, cols in keys.items():
        d = attach(d, pool_tables(df, cols, score, {f"{k}_{m}": m for m in methods}, max_rows).drop("_n"), cols)
    names = {(k, m): f"_r_{k}_{m}" for k in keys for m in methods}
    # sums of the same rows in another order differ in the last bits: equal pools must stay ties
    d = save(d.withColumns({f"_x_{k}_{m}": F.round(f"{k}_{m}", 12) for k, m in names}))
    d = rank_many(d, [(f"_x_{k}_{m}", r, ()) for (k, m), r in names.items()], max_rows=max_rows)
    names = {key: F.col(r) for key, r in names.items()}
    total = lambda cs: sum(cs[1:], cs[0])
    out = {}
    for m in methods:
        rs = [names[k, m] for k in keys]
        out |= {f"multi_{m}_meanrank": total(rs) / len(rs), f"multi_{m}_maxrank": F.greatest(*rs) if len(rs) > 1 else rs[0]}
    first = [names[primary or next(iter(keys)), m] for m in methods]
    out["method_meanrank"] = total(first) / len(first)
    return d.withColumns(out).drop(*[f"{x}_{k}_{m}" for x in ("_r", "_x") for k in keys for m in methods])


def meta_features(df: DataFrame, sources: list[str], by: list[str] = (), max_rows: int | None = None) -> DataFrame:
    """Clipped score, logit, rank, squared rank per source; rank mean, deviation, range and differences across sources."""
    d = df.withColumns({f"{c}_prob": F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6)) for c in sources})
    d = rank_many(d, [(f"{c}_prob", f"{c}_rank", by) for c in sources], max_rows=max_rows)
    r = [F.col(f"{c}_rank") for c in sources]
    mean = sum(r[1:], r[0]) / len(r)
    spread = [(x - mean) * (x - mean) for x in r]
    out = {f"{c}_logit": F.log(F.col(f"{c}_prob") / (1 - F.col(f"{c}_prob"))) for c in sources}
    out |= {f"{c}_rank_sq": F.col(f"{c}_rank") * F.col(f"{c}_rank") for c in sources}
    out |= {"rank_mean": mean, "rank_std": F.sqrt(sum(spread[1:], spread[0]) / (len(r) - 1)), "rank_min": F.least(*r),
            "rank_max": F.greatest(*r)}
    out |= {f"rank_{a}_{b}_diff": F.abs(F.col(f"{a}_rank") - F.col(f"{b}_rank")) for i, a in enumerate(sources) for b in sources[i + 1:]}
    return d.withColumns(out)


def entity_pull(df: DataFrame, key: list[str], score: str, weight: float, out: str, valid: Column | None = None,
                method: str = "max", size: tuple = (1, None), max_rows: int | None = None) -> DataFrame:
    """Score moved towards the pooled score of its entity; without `valid`, missing keys pool as one entity."""
    return pull(pooled(df, key, score, method, "_p", valid, size, max_rows), score, "_p", weight, out).drop("_p")


def layer(df: DataFrame, current: str, source: str, variant: str, segment: str, row_id: str, weights: dict[str, float],
          pool: dict, out: str, max_rows: int | None = None) -> DataFrame:
    """A recipe step: transform the source to the chosen variant, then blend it by segment."""
    d = variants(df, source, pool["key"], pool["method"], pool["weight"], pool["size"], pool["valid"], max_rows)
    d = segmented_blend(d, current, variant, segment, row_id, weights, out, max_rows)
    return d.drop("probability", "rank", "pooled_probability", "pooled_rank")


def with_bounded(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table to every row."""
    return attach_bounded(df.withColumn("_one", F.lit(1)), one_row.withColumn("_one", F.lit(1)), ["_one"]).drop("_one")
