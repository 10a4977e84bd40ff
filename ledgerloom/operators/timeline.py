"""Ordered work on the rows of one key, when one key may hold a third of the table.

`Window.partitionBy(key)` sends a whole key to one task. A `Timeline` first looks for keys with more than
`max_rows` rows (one narrow scan; a hash of the order columns picks about eight rows per `max_rows`, so the
pass shuffles almost nothing). Without such keys the plan is the plain window. With them, the rows of those
keys only are cut into slices, windows run per (key, slice), and what a slice needs from its neighbours is carried
over: running totals as one row per slice, neighbouring rows as copies ("halo" rows) that are removed again. No row is
dropped and the result does not depend on the cuts.

Rows are looked up in a key's list of boundaries, so the list must stay short. Slices of `BLOCK` rows or more are cut at
picked rows. Smaller ones are counted out by rank inside blocks of about `BLOCK` rows; only the blocks have boundaries.
"""
from __future__ import annotations

import copy
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.store import save
from .joins import attach, attach_bounded, attach_rows, drop_matching, keep_matching

MAX_ROWS = 4_000_000    # rows of one key that one task may sort
BLOCK = 500_000         # rows of one key that are ranked together where slices are smaller
PICKS = 8               # picked rows per slice or block: their sizes vary by about a third
SLICE, HALO = "_slice", "_halo"
_limit: ContextVar[int] = ContextVar("rows_per_slice", default=MAX_ROWS)


@contextmanager
def rows_per_slice(n: int):
    """Plans built inside cut keys of more than about `n` rows, where the operator is not told otherwise."""
    token = _limit.set(n)
    try:
        yield
    finally:
        _limit.reset(token)


def cut_points(df: DataFrame, key: list[str], order: list[str], max_rows: int) -> DataFrame | None:
    """One row per oversized key: its slice or block boundaries in two levels. None if no key is oversized."""
    period = max(max_rows // PICKS, 1)
    wide = period * max(BLOCK // PICKS // period, 1)     # a multiple: every boundary is a picked row
    rows = df.select(*key, F.struct(*order).alias("_at"))
    rows = rows.withColumn("_h", F.xxhash64("_at", *key)).filter(F.pmod("_h", F.lit(period)) == 0)
    bound = F.collect_list(F.when(F.pmod("_h", F.lit(wide)) == 0, F.col("_at")))
    per_key = (rows.distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.sort_array(bound).alias("_cuts"))
               .filter(F.col("_n") >= PICKS).drop("_n")
               .withColumn("_cuts", F.filter("_cuts", lambda x, i: i % PICKS == PICKS - 1)))
    cuts = save(per_key)       # stays distributed: it has a row per oversized key
    if cuts.isEmpty():
        return None
    # two levels, so that a row compares with about 2*sqrt(cuts) boundaries
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("_cuts"))).cast("int"))
    return (cuts.withColumn("_width", width)
            .withColumn("_blocks", F.transform(
                F.sequence(F.lit(0), F.greatest(F.floor((F.size("_cuts") - 1) / F.col("_width")).cast("int"), F.lit(0))),
                lambda b: F.slice("_cuts", (b * F.col("_width") + 1).cast("int"), F.col("_width"))))
            .withColumn("_firsts", F.transform("_blocks", lambda b: F.get(b, F.lit(0))))
            .select(*key, "_width", "_blocks", "_firsts"))


class Timeline:
    """Rows of each key in the total order `order`."""

    def __init__(self, df: DataFrame, key: list[str], order: list[str], max_rows: int | None = None):
        self.key, self.order = list(key), list(order)
        self.max_rows = _limit.get() if max_rows is None else max_rows
        self.cuts = cut_points(df, self.key, self.order, self.max_rows)
        self.rows, self.all_heavy, self._sliced = df, False, None

    @property
    def df(self) -> DataFrame:
        """The rows with their slice."""
        if self._sliced is None:
            self._sliced = self.slice(self.rows)
        return self._sliced

    def on(self, df: DataFrame) -> "Timeline":
        """The same keys, order and cuts for another frame with these rows (no second search for large keys)."""
        other = copy.copy(self)
        other.rows, other._sliced = df, None
        return other

    def apart(self, work: Callable[["Timeline"], DataFrame]) -> DataFrame:
        """`work` on the ordinary keys, as if there were no others, and on the oversized ones: ordinary keys pay nothing for the cuts."""
        if self.cuts is None or self.all_heavy:
            return work(self)
        whole = self.on(save(self.rows))
        light, heavy = whole.light_and_heavy()
        few, many = self.on(light), self.on(heavy)
        few.cuts, many.all_heavy = None, True
        return work(few).unionByName(work(many))

    @property
    def parts(self) -> list[str]:
        return self.key + ([SLICE] if self.cuts is not None else [])

    @property
    def window(self):
        return Window.partitionBy(*(self.parts or [F.lit(0)])).orderBy(*self.order)

    def slice(self, df: DataFrame) -> DataFrame:
        """Add the slice number: 0.. in an oversized key, NULL elsewhere."""
        if self.cuts is None:
            return df
        at = F.struct(*self.order)
        if self.key:
            joined = attach(df, self.cuts, self.key)
        else:
            joined = attach_bounded(df.withColumn("_one", F.lit(0)), self.cuts.withColumn("_one", F.lit(0)),
                                    ["_one"]).drop("_one")
        block = F.size(F.filter("_firsts", lambda f: f <= at)) - 1
        inside = F.size(F.filter(F.get("_blocks", block), lambda c: c <= at))
        number = F.when(F.col("_firsts").isNull(), None).when(block < 0, 0).otherwise(
            block * F.col("_width") + inside)
        out = joined.withColumn(SLICE, number.cast("long")).drop("_width", "_blocks", "_firsts")
        if self.max_rows >= BLOCK:
            return out
        # equal rows have one rank, so they stay together
        rank = F.rank().over(Window.partitionBy(*self.key, SLICE).orderBy(*self.order))
        return (out.withColumn("_rank", rank)
                .withColumn(SLICE, F.col(SLICE) * (1 << 40) + F.floor((F.col("_rank") - 1) / F.lit(self.max_rows))).drop("_rank"))

    def _carry(self, df: DataFrame, aggs: list[Column], names: list[str], fold) -> DataFrame:
        per_slice = df.filter(F.col(SLICE).isNotNull()).groupBy(*self.key, SLICE).agg(*aggs)
        before = Window.partitionBy(*(self.key or [F.lit(0)])).orderBy(SLICE).rowsBetween(
            Window.unboundedPreceding, -1)
        return per_slice.select(*self.key, SLICE, F.lit(True).alias("_is_carry"), *[fold(n).over(before).alias(f"_c_{n}") for n in names])

    def prefix(self, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None,
               df: DataFrame | None = None) -> DataFrame:
        """Sum (0 if none) and max (NULL if none) over all earlier rows of the key, the row itself left out."""
        sums, maxes = sums or {}, maxes or {}
        d = self.df if df is None else df
        if self.cuts is None:
            before = self.window.rowsBetween(Window.unboundedPreceding, -1)
            return d.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()}
                                 | {n: F.max(c).over(before) for n, c in maxes.items()})
        d = save(d)     # read twice below; without the cut every step would double the plan
        # one row per slice, the first of its slice
        carry = self._carry(d, [F.sum(c).alias(n) for n, c in sums.items()]
                            + [F.max(c).alias(n) for n, c in maxes.items()], [*sums, *maxes],
                            lambda n: F.sum(n) if n in sums else F.max(n))
        d = d.withColumns({"_is_carry": F.lit(False)} | {f"_c_{n}": c for n, c in (sums | maxes).items()})
        before = Window.partitionBy(*self.parts).orderBy(F.desc("_is_carry"), *self.order).rowsBetween(Window.unboundedPreceding, -1)
        out = d.unionByName(carry, allowMissingColumns=True).withColumns(
            {n: F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)) for n in sums} | {n: F.max(f"_c_{n}").over(before) for n in maxes})
        return out.filter(~F.col("_is_carry")).drop("_is_carry", *[f"_c_{n}" for n in (*sums, *maxes)])

    def with_neighbours(self, back: int = 1, ahead: int = 1, df: DataFrame | None = None) -> DataFrame:
        """Rows plus copies (`_halo`) of up to `back` rows before and `ahead` rows after each slice."""
        d = (self.df if df is None else df)
        if self.cuts is None:
            return d.withColumn(HALO, F.lit(False))
        d = save(d)
        row = [c for c in d.columns if c not in (*self.key, SLICE)]
        hot = d.filter(F.col(SLICE).isNotNull())
        down = Window.partitionBy(*self.parts).orderBy(*[F.desc(c) for c in self.order])
        by_slice = Window.partitionBy(*(self.key or [F.lit(0)])).orderBy(SLICE)
        packed = F.struct(*self.order, *[c for c in row if c not in self.order])
        sides = []
        for n, position, frame in ((back, down, (-back, -1)), (ahead, self.window, (1, ahead))):
            if n == 0:
                continue
            edge = (hot.withColumn("_n", F.row_number().over(position)).filter(F.col("_n") <= n)
                    .groupBy(*self.key, SLICE).agg(F.sort_array(F.collect_list(packed)).alias("_edge")))
            near = F.flatten(F.collect_list("_edge").over(by_slice.rowsBetween(*frame)))
            near = F.slice(F.reverse(near) if frame[0] < 0 else near, 1, n)
            sides.append(edge.withColumn("_near", near)
                         .select(*self.key, SLICE, F.explode("_near").alias("_r"))
                         .select(*self.key, SLICE, *[F.col(f"_r.{c}").alias(c) for c in row],
                                 F.lit(True).alias(HALO)))
        out = d.withColumn(HALO, F.lit(False))
        for side in sides:
            out = out.unionByName(side)
        return out

    def total(self, aggs: dict[str, Column], df: DataFrame, sub: list[str] = ()) -> DataFrame:
        """Aggregate over all rows of the key (and `sub` columns), on every row.

        One exchange serves all windows of a key. Oversized keys aggregate before the shuffle and join back.
        """
        over = self.key + list(sub)
        if self.cuts is None:
            return df.withColumns({n: a.over(Window.partitionBy(*(over or [F.lit(0)]))) for n, a in aggs.items()})
        df = save(df)
        rows = df.filter(~F.col(HALO)) if HALO in df.columns else df
        return attach(df, rows.groupBy(*over).agg(*[a.alias(n) for n, a in aggs.items()]), over)

    def distinct(self, columns: dict[str, str], df: DataFrame) -> DataFrame:
        """Number of distinct present values of a column in the key, on every row."""
        for out, c in columns.items():
            if self.cuts is None:
                first = Window.partitionBy(*self.key, c).orderBy(*self.order)
                df = df.withColumn("_1st", ((F.row_number().over(first) == 1) & F.col(c).isNotNull()).cast("int"))
                df = df.withColumn(out, F.sum("_1st").over(Window.partitionBy(*self.key))).drop("_1st")
            else:
                df = save(df)
                rows = df.filter(~F.col(HALO)) if HALO in df.columns else df
                n = rows.groupBy(*self.key, c).agg(F.lit(1).alias("_1")).groupBy(*self.key).agg(
                    F.count(c).alias(out))
                df = attach(df, n, self.key)
        return df

    def median(self, columns: dict[str, str], df: DataFrame) -> DataFrame:
        if self.cuts is None:
            return df.withColumns({n: F.median(c).over(Window.partitionBy(*self.key)) for n, c in columns.items()})
        from .ranks import quantiles
        df = save(df)
        rows = df.filter(~F.col(HALO)) if HALO in df.columns else df
        for n, c in columns.items():
            df = attach(df, quantiles(rows, self.key, c, {n: 0.5}), self.key)
        return df

    def light_and_heavy(self) -> tuple[DataFrame | None, DataFrame | None]:
        """Rows of ordinary keys and rows of oversized keys, uncut; None where there are none."""
        if self.cuts is None:
            return self.rows, None
        if self.all_heavy:
            return None, self.rows
        one = self.key or ["_one"]      # without a key all rows are one
        rows, cuts = (self.rows, self.cuts) if self.key else (x.withColumn("_one", F.lit(0)) for x in (self.rows, self.cuts))
        light, heavy = drop_matching(rows, cuts, one), keep_matching(rows, cuts, one)
        return (light, heavy) if self.key else (light.drop("_one"), heavy.drop("_one"))

    def settle(self, df: DataFrame) -> DataFrame:
        """Remove the halo rows and helper columns."""
        if HALO in df.columns:
            df = df.filter(~F.col(HALO)).drop(HALO)
        return df.drop(SLICE)


def earlier(df: DataFrame, key: list[str], time: str, row_id: str, sums: dict[str, Column],
            maxes: dict[str, Column] | None = None, max_rows: int | None = None, tl: Timeline | None = None) -> DataFrame:
    """Sum (0 if none) and max over the rows of the key with a strictly smaller `time`.

    Rows of equal time do not see each other. Ordinary keys use a growing RANGE frame; oversized ones are first
    aggregated per time, so that a time shared by many rows is one row, and then read off the running totals.
    """
    maxes = maxes or {}
    light, heavy = (tl or Timeline(df, key, [time, row_id], max_rows)).light_and_heavy()
    before = Window.partitionBy(*key).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    out = None if light is None else light.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()}
                                                       | {n: F.max(c).over(before) for n, c in maxes.items()})
    if heavy is None:
        return out
    heavy = save(heavy)
    per_time = heavy.groupBy(*key, time).agg(*[F.sum(c).alias(n) for n, c in sums.items()],
                                             *[F.max(c).alias(n) for n, c in maxes.items()])
    tl = Timeline(per_time, key, [time], max_rows)
    names = [*sums, *maxes]
    running = tl.prefix({f"_p_{n}": F.coalesce(F.col(n), F.lit(0)) for n in sums},
                        {f"_p_{n}": F.col(n) for n in maxes})
    running = running.select(*key, time, *[F.col(f"_p_{n}").alias(n) for n in names])
    read = attach_rows(heavy, running, [*key, time])
    return read if out is None else out.unionByName(read)
