"""Choosing weights by ROC AUC over grids.

Three segments with w weights each give w^3 blends. They are not scored one by one: with P[g,a] and N[g,a] the
positives and negatives of segment g under weight a at a score, the wins of a blend are the sum over segment pairs
of sum_v P[g,a](v) * (N[h,b] below v + half of N[h,b] at v). One ordered pass over the scores fills that small
matrix for all (g,a) x (h,b); any blend is then a sum of nine of its cells.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import SEGMENTS
from ..sources.store import save
from .blend import with_bounded
from .entity import pool_tables
from .joins import attach, attach_rows
from .ranks import auc, ordinal, quantiles, rank_many
from .timeline import Timeline


def simplex(spark: SparkSession, names: list[str], denominator: int) -> DataFrame:
    """All weight vectors in steps of 1/denominator that sum to one; built source by source, nothing is rejected."""
    d = spark.range(1).select(F.lit(denominator).alias("_left"))
    for n in names[:-1]:
        d = d.withColumn(n, F.explode(F.sequence(F.lit(0), F.col("_left")))).withColumn("_left", F.col("_left") - F.col(n))
    d = d.withColumn(names[-1], F.col("_left")).drop("_left")
    return d.select(*[(F.col(n) / F.lit(float(denominator))).alias(n) for n in names])


def halves(df: DataFrame, time: str, out: str = "half", max_rows: int | None = None) -> DataFrame:
    """first / second half by the median time."""
    middle = quantiles(df.withColumn("_o", F.lit(1)), ["_o"], time, {"_mid": 0.5}, max_rows).drop("_o")
    return with_bounded(df, middle).withColumn(out, F.when(F.col(time) <= F.col("_mid"), "first").otherwise("second")).drop("_mid")


def in_parts(df: DataFrame, half: str = "half", out: str = "part") -> DataFrame:
    """Every row twice: in the whole and in its half."""
    return df.withColumn(out, F.explode(F.array(F.lit("all"), F.col(half))))


def candidate_auc(df: DataFrame, label: str, sources: list[str], weights: list[dict], by: list[str] = (),
                  max_rows: int | None = None) -> DataFrame:
    """AUC of every linear candidate within `by`: columns candidate, by…, rows, positives, auc.

    Rows with equal sources and label are counted first; only then are they multiplied by the candidates.
    """
    tallied = df.groupBy(*by, label, *sources).agg(F.count(F.lit(1)).alias("_count"))
    table = F.array(*[F.array(*[F.lit(float(w[s])) for s in sources]) for w in weights])
    d = tallied.select("*", F.posexplode(table).alias("candidate", "_w"))
    parts = [F.col("_w")[i] * F.col(s) for i, s in enumerate(sources)]
    d = d.withColumn("_score", F.round(sum(parts[1:], parts[0]), 12))
    return auc(d, label, "_score", ["candidate", *by], weight="_count", max_rows=max_rows)


# bounds -------------------------------------------------------------------------------------------------------
BINS = 2048


def _histograms(matrix: np.ndarray, low: float, width: float, bins: int):
    """(g, c, b, pos, neg): rows of each class per group, candidate and bin of the candidate's score; one table per task."""
    weights, size = matrix.T, len(matrix) * bins * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for g, table in held.items():
                table = table.reshape(-1, 2)
                at = np.flatnonzero(table.any(1))
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array((at // bins).astype(np.int32)), pa.array((at % bins).astype(np.int32)),
                                                  pa.array(table[at, 1]), pa.array(table[at, 0])], names=["g", "c", "b", "pos", "neg"])
            held.clear()

        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            code, label = groups.indices.to_numpy(), batch.column(1).to_numpy()
            x = np.stack([c.to_numpy() for c in batch.columns[2:]], 1)
            for k, g in enumerate(groups.dictionary.to_pylist()):
                mine = np.flatnonzero(code == k)
                if g not in held and (len(held) + 1) * size > 1 << 24:
                    yield from emptied()
                table = held.setdefault(g, np.zeros(size, np.int64))
                for a in range(0, len(mine), 2048):
                    rows = mine[a:a + 2048]
                    b = np.clip(((x[rows] @ weights - low) / width).astype(np.int64), 0, bins - 1)
                    table += np.bincount(((np.arange(len(matrix)) * bins + b) * 2 + label[rows, None]).ravel(), minlength=size)
        yield from emptied()
    return run


def auc_bounds(df: DataFrame, label: str, sources: list[str], weights: list[dict], by: list[str], bins: int = BINS) -> dict[tuple, tuple[float, float]]:
    """{(*by as text, candidate): (low, high)} that hold the AUC of every convex candidate, from one scan.

    Only histograms are shuffled. Pairs in bins that are two or more apart are certain, the others may count for nothing or for one; so neither
    ties nor the last digits of a score matter.
    """
    rows = df.filter(reduce(lambda a, b: a & b, (F.col(s).isNotNull() for s in sources)) & F.col(label).isNotNull())
    edge = rows.agg(F.min(F.least(*sources) if len(sources) > 1 else F.col(sources[0])), F.max(F.greatest(*sources) if len(sources) > 1 else F.col(sources[0]))).first()
    if edge[0] is None:
        return {}
    low, width = float(edge[0]), max(float(edge[1]) - float(edge[0]), 1e-300) / bins
    group = F.concat_ws("\x1f", F.lit(""), *[F.coalesce(F.col(b).cast("string"), F.lit("")) for b in by])
    matrix = np.array([[float(w[s]) for s in sources] for w in weights])
    tally = (rows.select(group.alias("_g"), (F.col(label) == 1).cast("int").alias("_y"), *[F.col(s).cast("double").alias(f"_x{i}") for i, s in enumerate(sources)])
             .mapInArrow(_histograms(matrix, low, width, bins), "g string, c int, b int, pos bigint, neg bigint")
             .groupBy("g", "c", "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    w = Window.partitionBy("g", "c").orderBy("b")
    sure = F.coalesce(F.sum("neg").over(w.rangeBetween(Window.unboundedPreceding, -2)), F.lit(0))
    most = F.sum("neg").over(w.rangeBetween(Window.unboundedPreceding, 1))
    found = (tally.select("g", "c", "pos", "neg", sure.alias("sure"), most.alias("most")).groupBy("g", "c").agg(
        F.sum(F.col("pos").cast("double") * F.col("sure")).alias("low"), F.sum(F.col("pos").cast("double") * F.col("most")).alias("high"),
        (F.sum("pos").cast("double") * F.sum("neg")).alias("pairs")).filter("pairs > 0").collect())     # a row per group and candidate
    return {(*r["g"].split("\x1f")[1:], r["c"]): (r["low"] / r["pairs"], r["high"] / r["pairs"]) for r in found}


def reaching(bounds: list[tuple[float, float] | None], top: int = 1) -> list[int]:
    """Candidates whose interval reaches the `top`-th largest lower end: the best `top` are among them."""
    ends = sorted((b[0] for b in bounds if b is not None), reverse=True)
    least = ends[min(top, len(ends)) - 1] if ends else 0.0
    return [i for i, b in enumerate(bounds) if b is not None and b[1] >= least - 1e-12]


def best_mean_auc(df: DataFrame, label: str, sources: list[str], weights: list[dict], fold: str,
                  max_rows: int | None = None) -> list[tuple[float, dict]]:
    """The best candidates by mean fold AUC, best first; equal ones in grid order. Bounds leave few candidates, only these are scored."""
    found = auc_bounds(df, label, sources, weights, [fold])
    per = [[b for (_, c), b in found.items() if c == i] for i in range(len(weights))]
    left = reaching([tuple(sum(x) / len(p) for x in zip(*p)) if p else None for p in per])
    if not left:
        return []
    scored = candidate_auc(df, label, sources, [weights[i] for i in left], [fold], max_rows)
    rows = scored.groupBy("candidate").agg(F.avg("auc").alias("m")).filter("m is not null").collect()   # one per candidate left
    return sorted(((round(r["m"], 12), weights[left[r["candidate"]]], left[r["candidate"]]) for r in rows), key=lambda r: (-r[0], r[2]))


def coarse_to_fine(df: DataFrame, label: str, sources: list[str], fold: str, denominator: int = 10, coarse: int = 5,
                   max_rows: int | None = None) -> tuple[float, dict]:
    """Full coarse simplex, then the fine one within the coarse step around its best; two jobs."""
    spark = df.sparkSession
    grid = lambda d: [r.asDict() for r in simplex(spark, sources, d).orderBy(*sources).collect()]
    first = best_mean_auc(df, label, sources, grid(min(coarse, denominator)), fold, max_rows)
    if not first:
        return float("-inf"), {s: 1 / len(sources) for s in sources}
    best = first[0]
    if denominator > coarse:
        near = [w for w in grid(denominator) if sum(abs(w[s] - best[1][s]) for s in sources) <= 2 / coarse + 1e-12]
        fine = best_mean_auc(df, label, sources, near, fold, max_rows)
        best = fine[0] if fine[0][0] > best[0] + 1e-12 else best
    return best[0], best[1]


def shrink(local: DataFrame, common: DataFrame, key: list[str], columns: list[str], n: str, k: float) -> DataFrame:
    """Local weights pulled to the common ones by n/(n+k), normalised to sum one."""
    d = attach(local, common.select(*key, *[F.col(c).alias(f"_g_{c}") for c in columns]), key)
    a = F.col(n) / (F.col(n) + k)
    d = d.withColumns({c: a * F.col(c) + (1 - a) * F.col(f"_g_{c}") for c in columns}).drop(*[f"_g_{c}" for c in columns])
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    return d.withColumn("_t", total).withColumns({c: F.col(c) / F.col("_t") for c in columns}).drop("_t")


# segment grids ----------------------------------------------------------------------------------------------
HALVES = ("first", "second")


def _products(size: int):
    """Per half and for the whole, the sum over scores of positives of one cell times wins of another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {p: np.zeros((size, size)) for p in ("all", *HALVES)}
        for batch in batches:
            p0, p1, w0, w1 = (batch.column(c).flatten().to_numpy().reshape(-1, size) for c in ("p0", "p1", "w0", "w1"))
            for part, p, w in (("all", p0 + p1, w0 + w1), ("first", p0, w0), ("second", p1, w1)):
                total[part] += p.T @ w
        for part, m in total.items():
            i, j = np.nonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])],
                                             names=["part", "i", "j", "x"])
    return run


class BlendMatrix:
    """AUC of any combination of one option per segment, from the pair matrix."""

    def __init__(self, options: DataFrame, label: str, score: str, segment: str, option: str, segments: Iterable[str],
                 n_options: int, half: str = "half", max_rows: int | None = None):
        """`options`: rows repeated per option index of their segment, with the score they have under it and their half.

        Halves are counted side by side, so the whole is their sum and rows are not copied; the cells are sums of products of two arrays,
        added up per task.
        """
        self.segments, self.n = list(segments), n_options
        cells = [(g, a) for g in range(len(self.segments)) for a in range(n_options)]
        at = lambda h, g, a: (F.col(half) == HALVES[h]) & (F.col(segment) == self.segments[g]) & (F.col(option) == a)
        tally = options.groupBy(F.lit(0).alias("_one"), F.col(score).alias("_v")).agg(
            *[F.count_if(at(h, g, a) & (F.col(label) == 1)).alias(f"p{h}_{g}_{a}") for h in (0, 1) for g, a in cells],
            *[F.count_if(at(h, g, a) & (F.col(label) == 0)).alias(f"n{h}_{g}_{a}") for h in (0, 1) for g, a in cells])
        below = Timeline(tally, ["_one"], ["_v"], max_rows).prefix({f"b{h}_{g}_{a}": F.col(f"n{h}_{g}_{a}") for h in (0, 1) for g, a in cells})
        number = lambda c: c.cast("double")
        arrays = below.select(*[F.array(*[number(F.col(f"p{h}_{g}_{a}")) for g, a in cells]).alias(f"p{h}") for h in (0, 1)],
                              *[F.array(*[number(F.col(f"b{h}_{g}_{a}")) + F.col(f"n{h}_{g}_{a}") / 2.0 for g, a in cells]).alias(f"w{h}") for h in (0, 1)])
        got = arrays.mapInArrow(_products(len(cells)), "part string, i int, j int, x double").groupBy("part", "i", "j").agg(F.sum("x").alias("x")).collect()     # options^2 rows
        counts = options.filter(F.col(option) == 0).groupBy(half).agg(
            F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).collect()
        self.wins = {(r["part"], r["i"], r["j"]): r["x"] for r in got}
        sides = {r[half]: (r["p"], r["n"]) for r in counts}
        both = [sum(x) for x in zip(*sides.values())] or [0, 0]
        self.pairs = {h: p * n for h, (p, n) in sides.items()} | {"all": both[0] * both[1]}

    def auc(self, choice: tuple[int, ...], part: str = "all") -> float | None:
        if not self.pairs.get(part):
            return None
        at = [g * self.n + a for g, a in enumerate(choice)]
        return sum(self.wins.get((part, i, j), 0.0) for i in at for j in at) / self.pairs[part]

    def row(self, choice: tuple[int, ...], base: dict[str, float]) -> dict:
        score = self.auc(choice)
        gains = [self.auc(choice, h) - base[h] for h in ("first", "second")]
        return {"choice": choice, "auc": score, "gain": score - base["all"], "min_half_gain": min(gains)}


def base_aucs(df: DataFrame, label: str, score: str, max_rows: int | None = None) -> dict[str, float]:
    return {r["part"]: r["auc"] for r in auc(in_parts(df), label, score, ["part"], max_rows=max_rows).collect()}


def rank_options(df: DataFrame, current: str, stacked: str, segment: str, row_id: str, weights: tuple,
                 max_rows: int | None = None) -> DataFrame:
    """Rows repeated per weight index (`option`) with the rank-matched blend (`score`) of their segment."""
    d = save(rank_many(df, [(current, "_cur", ()), (current, "_cs", [segment]), (stacked, "_ss", [segment])], max_rows=max_rows))
    values = ordinal(d.select(segment, "_cur", row_id), ["_cur", row_id], "_k", [segment], max_rows).select(
        segment, "_k", F.col("_cur").alias("score"))
    d = d.select("*", F.posexplode(F.array(*[F.lit(float(w)) for w in weights])).alias("option", "_w"))
    d = d.withColumn("_signal", F.round((1 - F.col("_w")) * F.col("_cs") + F.col("_w") * F.col("_ss"), 12))
    d = ordinal(d, ["_signal", row_id], "_k", [segment, "option"], max_rows)
    return attach_rows(d, values, [segment, "_k"]).drop("_cs", "_ss", "_w", "_signal", "_k")


def direct_options(df: DataFrame, baseline: str, signal: str, weights: tuple) -> DataFrame:
    """Rows repeated per weight index with the plain mix."""
    d = df.select("*", F.posexplode(F.array(*[F.lit(float(w)) for w in weights])).alias("option", "_w"))
    return d.withColumn("score", F.round((1 - F.col("_w")) * F.col(baseline) + F.col("_w") * F.col(signal), 12)).drop("_w")


def pick(rows: list[dict]) -> dict:
    """Best gain, then best worse half, among the rows that lose in no half; equal ones by the first choice."""
    stable = [r for r in rows if r["min_half_gain"] >= 0]
    if not stable:
        raise ValueError("no candidate is stable in both halves")
    return min(stable, key=lambda r: (-round(r["gain"], 12), -round(r["min_half_gain"], 12), r["choice"]))


def grid_search(options: DataFrame, label: str, segment: str, weights: tuple, base: dict[str, float],
                segments: tuple = SEGMENTS, max_rows: int | None = None) -> tuple[dict, list[dict]]:
    """All combinations of weights over the segments."""
    m = BlendMatrix(options, label, "score", segment, "option", segments, len(weights), max_rows=max_rows)
    rows = [m.row(c, base) for c in product(range(len(weights)), repeat=len(segments))]
    return pick(rows), rows


def coordinate_search(options: DataFrame, label: str, segment: str, weights: tuple, base: dict[str, float],
                      starts: tuple, segments: tuple = SEGMENTS, max_rows: int | None = None) -> tuple[dict, list[dict]]:
    """Two sweeps over the segments from every start, then the neighbours of where they end."""
    m = BlendMatrix(options, label, "score", segment, "option", segments, len(weights), max_rows=max_rows)
    seen: dict[tuple, dict] = {}

    def visit(choice: tuple) -> dict:
        return seen.setdefault(choice, m.row(choice, base))

    for start in starts:
        at = tuple(weights.index(w) for w in start)
        visit(at)
        for _ in range(2):
            for g in range(len(segments)):
                line = [visit((*at[:g], a, *at[g + 1:])) for a in range(len(weights))]
                at = max(line, key=lambda r: (r["auc"], r["min_half_gain"]))["choice"]
        near = [range(max(0, a - 1), min(len(weights), a + 2)) for a in at]
        for choice in product(*near):
            visit(choice)
    return pick(list(seen.values())), list(seen.values())


def candidate_search(df: DataFrame, label: str, segment: str, weights: tuple, blend: Callable[[DataFrame, Column], DataFrame],
                     base: dict[str, float], segments: tuple = SEGMENTS, max_rows: int | None = None) -> DataFrame:
    """All combinations one by one, for blends whose last step (such as pooling) mixes segments.

    `blend(rows, keys)` sees rows repeated per `candidate` with their weight `w` and adds `score`.
    """
    combos = list(product(range(len(weights)), repeat=len(segments)))
    table = F.array(*[F.array(*[F.lit(float(weights[a])) for a in c]) for c in combos])
    place = F.lit(None)
    for i, s in enumerate(segments):
        place = F.when(F.col(segment) == s, F.lit(i)).otherwise(place)
    d = df.select("*", F.posexplode(table).alias("candidate", "_ws")).withColumn("w", F.col("_ws")[place]).drop("_ws")
    scored = auc(in_parts(blend(d, ["candidate"])), label, "score", ["candidate", "part"], max_rows=max_rows)
    wide = scored.groupBy("candidate").pivot("part", ["all", "first", "second"]).agg(F.first("auc"))
    return wide.select("candidate", F.col("all").alias("auc"), (F.col("all") - base["all"]).alias("gain"),
                       F.least(F.col("first") - base["first"], F.col("second") - base["second"]).alias("min_half_gain"))


def _may_be_chosen(bounds: dict, n: int, own: int, segments: tuple, top: int) -> list[int]:
    """Candidates that can be among the `top` of a segment: not surely worse than `own` in a half, nor than `top` others that surely are not."""
    left = {own}
    for g in segments:
        none = (-1.0, 2.0)
        get = lambda i, p: bounds.get((g, p, i), none)
        gain = {i: [(get(i, p)[0] - get(own, p)[1], get(i, p)[1] - get(own, p)[0]) for p in ("all", "first", "second")] for i in range(n)}
        gain[own] = [(0.0, 0.0)] * 3
        may = [i for i in range(n) if min(gain[i][1][1], gain[i][2][1]) >= -1e-12]
        sure = sorted((gain[i][0][0] for i in may if min(gain[i][1][0], gain[i][2][0]) >= 0), reverse=True)
        least = sure[top - 1] if len(sure) >= top else -2.0
        left |= {i for i in may if gain[i][0][1] >= least - 1e-12}
    return sorted(left)


def two_stage_recipe(df: DataFrame, label: str, sources: list[str], baseline: str, segment: str, denominator: int, top: int,
                     segments: tuple = SEGMENTS, max_rows: int | None = None) -> tuple[dict, dict]:
    """Best stable mixes per segment, then the best combination of them. `df` needs `half`."""
    weights = [r.asDict() for r in simplex(df.sparkSession, sources, denominator).orderBy(*sources).collect()]
    parts = in_parts(df)
    own = next(i for i, w in enumerate(weights) if w[baseline] == 1.0)
    left = _may_be_chosen(auc_bounds(parts, label, sources, weights, [segment, "part"]), len(weights), own, segments, top)
    scored = candidate_auc(parts, label, sources, [weights[i] for i in left], [segment, "part"], max_rows).collect()    # left x segments x 3
    table = {(left[r["candidate"]], r[segment], r["part"]): r["auc"] for r in scored}
    chosen = {}
    for g in segments:
        rows = []
        for i in range(len(weights)):
            gain = [None if table.get((i, g, p)) is None or table.get((own, g, p)) is None else
                    table[i, g, p] - table[own, g, p] for p in ("all", "first", "second")]
            worst = min((x for x in gain[1:] if x is not None), default=float("nan"))
            if gain[0] is not None and worst >= 0:
                rows.append((-round(gain[0], 12), -round(worst, 12), i))
        chosen[g] = [i for _, _, i in sorted(rows)[:top]] or [own]
    pad = max(len(c) for c in chosen.values())
    options = {g: c + [c[-1]] * (pad - len(c)) for g, c in chosen.items()}
    lookup = F.create_map(*[x for g, c in options.items() for x in (F.lit(g), F.array(*[
        F.array(*[F.lit(float(weights[i][s])) for s in sources]) for i in c]))])
    d = df.select("*", F.posexplode(lookup[F.col(segment)]).alias("option", "_w"))
    mix = [F.col("_w")[i] * F.col(s) for i, s in enumerate(sources)]
    d = d.withColumn("score", F.round(sum(mix[1:], mix[0]), 12)).drop("_w")
    m = BlendMatrix(d, label, "score", segment, "option", segments, pad, max_rows=max_rows)
    base = base_aucs(df, label, baseline, max_rows)
    rows = [m.row(c, base) for c in product(*[range(len(chosen[g])) for g in segments])]
    best = pick(rows)
    return best | {"weights": {g: weights[options[g][a]] for g, a in zip(segments, best["choice"])}}, chosen


def line_search(df: DataFrame, label: str, first: str, second: str, steps: int, max_rows: int | None = None) -> DataFrame:
    """AUC of (1-w)*rank(first) + w*rank(second) for w in equal steps."""
    d = rank_many(df, [(first, "_a", ()), (second, "_b", ())], max_rows=max_rows)
    weights = [{"_a": 1 - i / (steps - 1), "_b": i / (steps - 1)} for i in range(steps)]
    scored = candidate_auc(d.select(label, "_a", "_b"), label, ["_a", "_b"], weights, [], max_rows)
    return scored.select((F.col("candidate") / F.lit(float(steps - 1))).alias("weight"), "auc")


def pooling_search(df: DataFrame, label: str, score: str, groups: dict[str, tuple[list[str], Column, int]],
                   methods: tuple, weights: tuple, max_rows: int | None = None) -> DataFrame:
    """Key group x method x weight: AUC gain overall and in the worse half. `df` needs `half`."""
    d, names = df, []
    for g, (key, valid, cap) in groups.items():
        table = pool_tables(df.filter(valid), list(key), score, {f"_p_{g}_{m}": m for m in methods}, max_rows)
        fits = valid & F.col("_n").between(2, cap)
        d = attach(d, table, list(key)).withColumns({f"_p_{g}_{m}": F.when(fits, F.col(f"_p_{g}_{m}")).otherwise(F.col(score)) for m in methods}).drop("_n")
        names += [(g, m) for m in methods]
    signal = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(m).alias("method"), F.lit(float(w)).alias("weight"),
                                F.round((1 - w) * F.col(score) + w * F.col(f"_p_{g}_{m}"), 12).alias("x"))
                       for g, m in names for w in weights])
    long = in_parts(d.select(label, "half", F.explode(signal).alias("_s"))).select(label, "part", "_s.*")
    scored = auc(long, label, "x", ["group", "method", "weight", "part"], max_rows=max_rows)
    wide = scored.groupBy("group", "method", "weight").pivot("part", ["all", "first", "second"]).agg(F.first("auc"))
    base = base_aucs(df, label, score, max_rows)
    return wide.select("group", "method", "weight", F.col("all").alias("auc"), (F.col("all") - base["all"]).alias("gain"),
                       F.least(F.col("first") - base["first"], F.col("second") - base["second"]).alias("min_half_gain"))


def fallbacks(gains: DataFrame, segment: str, horizon: str, gain: str, needed: int, unseen: int) -> DataFrame:
    """Segments and horizons that go back to the anchor source, from gains per (segment, horizon)."""
    per = gains.groupBy(segment).agg(F.count_if(F.col(gain) > 0).alias("positive"), F.avg(gain).alias("mean_gain"),
                                     F.max(F.when(F.col(horizon) == unseen, F.col(gain))).alias("_u"))
    whole = (F.col("positive") < needed) | (F.col("mean_gain") <= 0)
    return per.select(segment, "positive", "mean_gain", F.when(whole, "all").when(
        F.coalesce("_u", F.lit(0.0)) <= 0, "unseen").otherwise("none").alias("fallback"))


def apply_fallbacks(weights: dict[float, dict[str, dict[str, float]]], decided: DataFrame, segment: str, anchor: str,
                    unseen: float) -> dict[float, dict[str, dict[str, float]]]:
    """The recipe (horizon -> segment -> source -> weight) with the anchor source alone where `fallbacks` decided so. `decided` has a row per
    segment; a segment without any row has no gain to show and falls back as a whole."""
    fall = {r[segment]: r["fallback"] for r in decided.select(segment, "fallback").collect()}

    def settled(h: float, s: str, w: dict[str, float]) -> dict[str, float]:
        back = fall.get(s, "all")
        return {c: float(c == anchor) for c in w} if back == "all" or (back == "unseen" and h == unseen) else dict(w)
    return {h: {s: settled(h, s, w) for s, w in per.items()} for h, per in weights.items()}


def accepted(dev_gain: float | None, lock_gain: float | None, least: float = 0.0) -> bool:
    return dev_gain is not None and lock_gain is not None and dev_gain > least and lock_gain > least

