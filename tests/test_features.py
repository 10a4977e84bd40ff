import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import blend as bl, causal, entity as en, search as se, segments as sg


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = [(i, "hot" if i % 3 == 0 else (None if i % 7 == 1 else f"k{i % 60}"), rng.randint(0, 40) * 20000,
             None if i % 13 == 0 else float(rng.randint(0, 4000)) / 100, rng.choice("abc") if i % 5 else None,
             int(rng.random() < .2), float(rng.randint(0, 9)), "history" if i % 4 else "query") for i in range(1500)]
    return spark.createDataFrame(data, "id long, key string, dt long, amt double, v string, y int, c double, split string").cache()


def table(df):
    p = df.toPandas().sort_values("id").reset_index(drop=True)
    return p[sorted(p.columns)]


BUILDS = {
    "velocity": lambda d, n: causal.velocity(d, ["key"], "dt", "id", "amt", max_rows=n),
    "labels": lambda d, n: causal.label_history(d.filter("split = 'history'"), d.filter("split = 'query'"), ["key"], "dt", "id", "y",
                                                (5.0, 20.0), max_rows=n),
    "activity": lambda d, n: causal.activity(d, ["key"], "dt", "id", "c", "c", max_rows=n),
    "memory": lambda d, n: causal.value_memory(d, ["key"], "dt", "id", "v", "m", max_rows=n),
    "sequence": lambda d, n: en.sequence(d, ["key"], "dt", "id", "amt", "s", ["c"], max_rows=n),
    "profile": lambda d, n: en.profile(d, ["key"], "dt", "id", "amt", ["v"], ["c"], ["c"], max_rows=n),
    "pool": lambda d, n: bl.entity_pull(d, ["key"], "c", 0.5, "p", method="q75", max_rows=n),
    "blend": lambda d, n: bl.segmented_blend(d.withColumn("seg", F.coalesce("v", F.lit("z"))), "c", "dt", "seg", "id", {"a": 0.3, "b": 1.0}, "p", n),
}


@pytest.mark.parametrize("name", BUILDS)
def test_an_oversized_key_gives_the_same_rows(rows, name):
    pd.testing.assert_frame_equal(table(BUILDS[name](rows, 10**6)), table(BUILDS[name](rows, 100)), check_exact=False, rtol=1e-9, atol=1e-9)


def test_velocity_edges(spark):
    d = spark.createDataFrame([(1, "a", 0, 5.0), (2, "a", 86400, None), (3, "a", 86400, 7.0), (4, "a", 172800, 9.0), (5, "b", 3, 1.0)],
                              "id long, key string, dt long, amt double")
    r = {x["id"]: x for x in causal.velocity(d, ["key"], "dt", "id", "amt").collect()}
    assert r[1]["velocity_prior_count"] == 0 and r[1]["velocity_sum_1d"] == 0.0 and r[1]["velocity_prior_mean"] is None
    assert r[2]["velocity_prior_count"] == r[3]["velocity_prior_count"] == 1         # equal times do not see each other
    assert r[3]["velocity_count_1d"] == 1                                             # left edge is inside
    assert r[4]["velocity_diff_previous"] == 2.0 and r[3]["velocity_diff_previous"] == 2.0
    assert r[4]["velocity_prior_std"] == pytest.approx(1.0) and r[4]["velocity_zscore"] == pytest.approx(3.0)
    assert r[5]["velocity_since_first"] is None and r[3]["velocity_zscore"] is None   # one value: zero deviation
    last = spark.createDataFrame([(1, "a", 0, 5.0), (2, "a", 10, None), (3, "a", 20, 7.0)], "id long, key string, dt long, amt double")
    assert causal.velocity(last, ["key"], "dt", "id", "amt").filter("id = 3").first()["velocity_diff_previous"] is None


def test_segment_fixture(spark):
    data = list(zip(range(6), "aabcax", ["aa", "aa", "bb", "cc", "aa", "xx"], ["da", "da", "db", "dc", "da", "dx"], [True] * 5 + [False]))
    d = spark.createDataFrame(data, "id int, strict_uid string, card_uid string, mail_uid string, strict_valid boolean")
    d = d.withColumns({"card_valid": F.col("strict_valid"), "mail_valid": F.col("strict_valid")})
    got = sg.segments(d.filter("id >= 3"), d.filter("id < 3")).orderBy("id").collect()
    assert [r["segment"] for r in got] == ["cold", "strict", "cold"]
    assert sorted(r["id"] for r in sg.repeated_rows(d.filter("id < 3"), ["strict_uid"], "strict_valid").collect()) == [0, 1]


def test_pool_fixture(spark):
    d = spark.createDataFrame([(0, .1, "u"), (1, .9, "u"), (2, .4, "v")], "id int, p double, uid string")
    got = bl.entity_pull(d, ["uid"], "p", 1.0, "q", method="q90").orderBy("id").collect()
    assert [r["q"] for r in got] == pytest.approx([.82, .82, .4])


def test_simplex_and_interpolation_fixtures(spark):
    w = se.simplex(spark, list("abcd"), 10)
    assert w.count() == 286 and w.filter(F.abs(F.col("a") + F.col("b") + F.col("c") + F.col("d") - 1) > 1e-12).count() == 0
    assert se.simplex(spark, list("abc"), 5).count() == 21
    one = {h: {s: {"x": 1.0, "y": 0.0} for s in ("strict", "partial", "cold")} for h in (30.0, 45.0, 60.0, 75.0)}
    d = spark.createDataFrame([(30.0, "strict", .2, .9), (37.5, "partial", .3, .9), (75.0, "cold", .4, .9), (99.0, "cold", .5, .9), (1.0, "cold", .6, .9)],
                              "h double, segment string, x double, y double")
    got = bl.horizon_mix(d, "segment", "h", one, "p").collect()
    assert len(got) == 5 and all(r["p"] == pytest.approx(r["x"]) for r in got)


def test_blend_matrix_equals_scoring_each_blend(rows):
    from ledgerloom.operators import ranks as rk
    d = rows.select("id", "dt", F.col("y").alias("label"), F.coalesce("v", F.lit("c")).alias("segment"), (F.col("c") / 9).alias("s1"),
                    (F.col("id") * 37 % 101 / 101).alias("s2"))
    d = se.halves(d, "dt")
    ws = (0.0, 0.5, 1.0)
    base = se.base_aucs(d, "label", "s1")
    _, grid = se.grid_search(se.rank_options(d, "s1", "s2", "segment", "id", ws), "label", "segment", ws, base, ("a", "b", "c"))
    by_choice = {r["choice"]: r for r in grid}
    for choice in ((0, 0, 0), (2, 1, 0), (1, 2, 2)):
        p = bl.segmented_blend(d, "s1", "s2", "segment", "id", dict(zip("abc", (ws[i] for i in choice))), "p")
        assert by_choice[choice]["auc"] == pytest.approx(rk.auc(p, "label", "p").first()["auc"], abs=1e-12)
    best, _ = se.coordinate_search(se.rank_options(d, "s1", "s2", "segment", "id", ws), "label", "segment", ws, base, ((0.0, 0.0, 0.0),), ("a", "b", "c"))
    assert best["gain"] <= max(r["gain"] for r in grid if r["min_half_gain"] >= 0) + 1e-12


def test_searches_return_what_they_scored(rows):
    from ledgerloom.operators import ranks as rk
    d = rows.select("id", "dt", F.col("y").alias("label"), F.coalesce("v", F.lit("c")).alias("segment"), (F.col("c") / 9).alias("s1"),
                    (F.col("id") * 37 % 101 / 101).alias("s2"), (F.col("id") % 2).alias("fold"))
    best, w = se.coarse_to_fine(d, "label", ["s1", "s2"], "fold")
    mixed = d.withColumn("x", F.round(w["s1"] * F.col("s1") + w["s2"] * F.col("s2"), 12))
    assert rk.auc(mixed, "label", "x", ["fold"]).agg(F.avg("auc")).first()[0] == pytest.approx(best, abs=1e-10)
    alone = rk.auc(d, "label", "s1", ["fold"]).agg(F.avg("auc")).first()[0]
    assert best >= alone - 1e-12
    d = se.halves(d, "dt")
    best, _ = se.two_stage_recipe(d, "label", ["s1", "s2"], "s1", "segment", 5, 3, ("a", "b", "c"))
    p = bl.segment_mix(d, "segment", best["weights"], "p").withColumn("p", F.round("p", 12))
    assert rk.auc(p, "label", "p").first()["auc"] == pytest.approx(best["auc"], abs=1e-12)
    assert best["min_half_gain"] >= 0
