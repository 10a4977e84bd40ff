import random

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from ledgerloom.operators import ranks, timeline
from ledgerloom.operators.timeline import SLICE, Timeline


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else (None if i % 3 == 1 and i % 2 else f"k{i % 40}")
        data.append((i, key, rng.randint(0, 120), None if i % 17 == 0 else float(rng.randint(0, 50))))
    return spark.createDataFrame(data, "id long, key string, dt long, amt double").cache()


def frame(df, by):
    p = df.toPandas().sort_values(by).reset_index(drop=True)
    return p[sorted(p.columns)]


def test_prefix_does_not_depend_on_slices(rows):
    out = {}
    for size in (10**6, 64):
        tl = Timeline(rows, ["key"], ["dt", "id"], size)
        assert (tl.cuts is not None) == (size == 64)
        if size == 64:
            sizes = tl.df.filter("key = 'hot'").groupBy(SLICE).count().agg(F.max("count"), F.count("*")).first()
            assert sizes[0] < 300 and sizes[1] > 5
        out[size] = frame(tl.settle(tl.prefix({"n": F.lit(1), "s": F.col("amt")}, {"m": F.col("amt")})), "id")
    pd.testing.assert_frame_equal(out[10**6], out[64])


@pytest.mark.parametrize("size", [40, 8])
def test_neighbours_do_not_depend_on_slices(rows, size):
    w = Window.partitionBy("key").orderBy("dt", "id")
    plain = rows.withColumns({"a": F.lag("amt").over(w), "b": F.lead("dt").over(w),
                              "c": F.sum("amt").over(w.rowsBetween(-5, 0))})
    tl = Timeline(rows, ["key"], ["dt", "id"], size)
    d = tl.with_neighbours(5, 1)
    cut = tl.settle(d.withColumns({"a": F.lag("amt").over(tl.window), "b": F.lead("dt").over(tl.window),
                                   "c": F.sum("amt").over(tl.window.rowsBetween(-5, 0))}))
    pd.testing.assert_frame_equal(frame(plain, "id"), frame(cut, "id"))


def test_ranks_match_pandas(rows):
    p = rows.toPandas()
    for by in ([], ["key"]):
        for size in (10**6, 8):
            got = frame(ranks.average_rank(rows, "amt", "r", by, True, size), "id")
            want = (p.groupby("key", dropna=False)["amt"] if by else p["amt"]).rank(pct=True)
            want = want.to_numpy()[p["id"].argsort()]
            pd.testing.assert_series_equal(got["r"], pd.Series(want, name="r"))


def test_auc_counts_pairs(rows):
    d = rows.filter("amt is not null").withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    p = d.toPandas()
    pos, neg = p[p.y == 1].amt.to_numpy(), p[p.y == 0].amt.to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    for size in (10**6, 8):
        assert ranks.auc(d, "y", "amt", max_rows=size).first()["auc"] == pytest.approx(want, abs=1e-12)
    one = ranks.auc(d.filter("y = 1"), "y", "amt").first()
    assert one["auc"] is None


def test_quantiles_match_pandas(rows):
    d = rows.withColumn("v", F.col("amt") + F.col("id") / 7000)
    p = d.toPandas()
    want = p.groupby("key", dropna=False)["v"].quantile([.5, .9]).unstack()
    for size in (10**6, 64):
        got = ranks.quantiles(d, ["key"], "v", {"q50": .5, "q90": .9}, size).toPandas().set_index("key")
        for k in want.index:
            row = got.loc[k] if isinstance(k, str) else got[got.index.isna()].iloc[0]
            assert row.q50 == pytest.approx(want.loc[k, .5] if isinstance(k, str) else want[want.index.isna()].iloc[0][.5])
            assert row.q90 == pytest.approx(want.loc[k, .9] if isinstance(k, str) else want[want.index.isna()].iloc[0][.9])


def test_rank_match_keeps_the_values(rows):
    d = rows.filter("amt is not null").withColumn("sig", -F.col("amt"))
    for size in (10**6, 64):
        p = ranks.rank_match(d, "sig", "amt", "id", "out", ["key"], size).toPandas()
        for _, g in p.groupby("key", dropna=False):
            assert sorted(g.amt) == sorted(g.out)
            s = g.sort_values(["sig", "id"])
            assert s.out.is_monotonic_increasing


def test_small_slices_keep_few_boundaries(rows):
    """Slices far smaller than a block are counted out by rank: what a row is compared with must not grow with the number of slices."""
    tl = Timeline(rows, ["key"], ["dt", "id"], 8)
    assert tl.cuts.agg(F.max(F.size(F.flatten("_blocks")))).first()[0] == 0
    sizes = tl.df.filter("key = 'hot'").groupBy(SLICE).count().agg(F.max("count"), F.count("*")).first()
    assert tuple(sizes) == (8, 125)


def test_slices_inside_several_blocks(rows, monkeypatch):
    monkeypatch.setattr(timeline, "BLOCK", 200)
    want = Timeline(rows, ["key"], ["dt", "id"], 10**6).prefix({"n": F.lit(1), "s": F.col("amt")}, {"m": F.col("amt")})
    tl = Timeline(rows, ["key"], ["dt", "id"], 8)
    assert tl.cuts.agg(F.max(F.size(F.flatten("_blocks")))).first()[0] > 1
    got = tl.settle(tl.prefix({"n": F.lit(1), "s": F.col("amt")}, {"m": F.col("amt")}))
    pd.testing.assert_frame_equal(frame(want, "id"), frame(got, "id"))


def test_equal_rows_share_a_slice(rows):
    d = rows.select("key", "dt")
    tl = Timeline(d, ["key"], ["dt"], 8)
    assert tl.df.filter(F.col(SLICE).isNotNull()).groupBy("key", "dt").agg(F.count_distinct(SLICE).alias("n")).filter("n > 1").isEmpty()


def test_apart_leaves_ordinary_keys_uncut(rows):
    tl, seen = Timeline(rows, ["key"], ["dt", "id"], 64), []

    def work(part):
        seen.append((part.cuts is None, part.rows.count()))
        return part.settle(part.prefix({"n": F.lit(1)}))

    want = Timeline(rows, ["key"], ["dt", "id"], 10**6).prefix({"n": F.lit(1)})
    pd.testing.assert_frame_equal(frame(want, "id"), frame(tl.apart(work), "id"))
    assert seen[0][0] and not seen[1][0] and seen[0][1] > 0 and seen[0][1] + seen[1][1] == 3000


def test_values_as_long_as_the_rows_are_not_broadcast(rows):
    from ledgerloom.sources.store import save
    d = save(rows.filter("amt is not null"))
    plan = ranks.rank_match(d, "amt", "amt", "id", "out", ["key"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_profile_and_velocity_do_not_depend_on_slices(rows):
    from ledgerloom.operators import causal, entity
    d = rows.withColumns({"c": (F.col("id") % 5).cast("string"), "x": (F.col("id") % 7).cast("double")})
    for make in (lambda n: entity.profile(d, ["key"], "dt", "id", "amt", ["c"], ["x"], ["x"], max_rows=n),
                 lambda n: causal.velocity(d, ["key"], "dt", "id", "amt", windows={"a": 5, "b": 40}, amount_windows=("b",), max_rows=n),
                 lambda n: causal.value_memory(d, ["key"], "dt", "id", "c", "m", 30, max_rows=n)):
        pd.testing.assert_frame_equal(frame(make(10**6), "id"), frame(make(16), "id"))
