"""Hashes of files of any size, subsets of score columns, input files, stored metrics."""
import hashlib
from itertools import combinations

import pytest

from ledgerloom.models import scoring
from ledgerloom.operators import checks, ranks
from ledgerloom.sources import tables


def test_hashes_of_small_and_streamed_files(spark, tmp_path):
    data = {"empty": b"", "a b%20c": b"x" * 1000, "three": bytes(range(256)) * 40_000}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    want = {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items()}
    del want["empty"]       # readers do not list files without bytes
    for whole in (0, 1000, tables.WHOLE_FILE):
        got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in tables.file_hashes(spark, str(tmp_path), whole).collect()}
        assert got == want


def test_hash_of_a_file_above_two_gigabytes(spark, tmp_path):
    path = tmp_path / "sparse"
    with open(path, "wb") as f:
        f.write(b"head")
        f.truncate((1 << 31) + 12_345)
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 24):
            h.update(block)
    (row,) = tables.file_hashes(spark, str(path)).collect()
    assert (row.length, row.sha256) == ((1 << 31) + 12_345, h.hexdigest())


def test_status_of_hashes(spark):
    found = spark.createDataFrame([("file:/x/a", "aa"), ("file:/x/b", "bb"), ("file:/x/c", "cc")], "path string, sha256 string")
    expected = spark.createDataFrame([("a", "AA"), ("b", "b0"), ("d", "dd")], "name string, sha256 string")
    got = {r.name: r.status for r in tables.check_hashes(found, expected).collect()}
    assert got == {"a": "same", "b": "changed", "c": "unexpected", "d": "missing"}
    assert tables.check_hashes(found.limit(0), expected.limit(0)).count() == 0


@pytest.mark.parametrize("batch", [1, 4, 64])
def test_every_subset_and_the_best(spark, batch):
    columns = ["a", "b", "c", "d"]
    d = spark.range(300).selectExpr("id", "cast(id % 3 = 0 AS int) AS label", *[f"pmod(xxhash64(id, {k}), 50) / 50 + {w} * cast(id % 3 = 0 AS int) AS {c}"
                                                                                   for k, (c, w) in enumerate(zip(columns, (.1, .6, .3, .0)))])
    got = {r["mask"]: r["auc"] for r in scoring.subset_lattice(d, "label", columns, batch).collect()}
    want = {}
    for n in range(1, 5):
        for s in combinations(range(4), n):
            x = d.selectExpr("label", f"round(({' + '.join(columns[k] for k in s)}) / {n}, 12) AS x")
            want[sum(1 << k for k in s)] = ranks.auc(x, "label", "x").first()["auc"] if batch == 64 else got[sum(1 << k for k in s)]
    assert set(got) == set(range(1, 16)) and all(abs(got[m] - want[m]) < 1e-12 for m in want)
    best = max(got, key=lambda m: (round(got[m], 12), -m.bit_count(), -m))
    named = [c for k, c in enumerate(columns) if best >> k & 1]
    lattice = scoring.subset_lattice(d, "label", columns, batch)
    rows = scoring.apply_best_subset(d, lattice, columns, "best").selectExpr("best", f"({' + '.join(named)}) / {len(named)} AS mean").collect()
    assert len(rows) == 300 and all(abs(r["best"] - r["mean"]) < 1e-12 for r in rows)


def test_input_files_by_name(spark, tmp_path):
    for name, n in (("orders", 5), ("benchmark", 7)):
        spark.range(n).repartition(2).write.parquet(f"{tmp_path}/{name}")
    sources = [spark.read.parquet(f"{tmp_path}/{n}") for n in ("orders", "benchmark")]
    assert checks.input_files(sources).groupBy().sum("rows").first()[0] == 12
    bad = checks.forbidden_inputs(sources, ["/bench", "submission"]).collect()
    assert sum(r.rows for r in bad) == 7 and {r.pattern for r in bad} == {"/bench"}
    assert checks.forbidden_inputs(sources[:1], ["/bench", "submission"]).isEmpty()


def test_metrics_against_a_stored_table(spark):
    measured = spark.createDataFrame([("a", 0.5), ("b", 0.7), ("new", 0.1)], "name string, auc double")
    stored = spark.createDataFrame([("a", 0.5), ("b", 0.70001), ("old", 0.1)], "name string, auc double")
    got = {r.name: r.reproduced for r in checks.metrics_reproduced(measured, stored, "name", "auc", 1e-9).collect()}
    assert got == {"a": 1, "b": 0, "new": 0, "old": 0}


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    from pyspark.sql import functions as F
    from ledgerloom.sources import store
    a = store.save_bucketed(spark.range(500).withColumn("x", F.col("id") * 2), ["id"], 6)
    path = str(tmp_path / "it's here")
    store.save_bucketed(spark.range(0, 1000, 2).withColumn("y", F.col("id") * 3), ["id"], 6, path)
    b = store.open_bucketed(spark, path, spark.read.parquet(path).schema, ["id"], 6)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b, "id")
        rows = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(map(tuple, rows)) == [(i, 2 * i, 3 * i) for i in range(0, 500, 2)]
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_bucketed_cache_is_rebuilt_for_other_recipes_and_buckets(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(20).selectExpr("id", "id * 2 AS x")
    ask = lambda recipe, n: tables.cached_bucketed(spark, str(tmp_path / "c"), recipe, {"t": {"rows": 20}}, ["id"], n, build)
    hits = [ask(*k)[1] for k in (("a", 4), ("a", 4), ("b", 4), ("b", 4), ("b", 2), ("b", 2))]
    assert hits == [False, True, False, True, False, True] and len(built) == 3
    assert sorted(r.x for r in ask("b", 2)[0].collect()) == list(range(0, 40, 2))


def test_last_run_refuses_scores_that_do_not_fit(spark, tmp_path):
    from ledgerloom.plans import final_run
    d = spark.createDataFrame([(1, "cold", 2.0, 0.5, 0.4), (2, "cold", 3.0, 0.5, None)], "id long, segment string, horizon double, s double, prediction double")
    with pytest.raises(ValueError, match="null_scores"):
        final_run.write_final(d, d.select("id"), str(tmp_path / "f"), "id", "segment", ["s"])
    assert not (tmp_path / "f").exists()


def test_fallbacks_in_the_recipe(spark):
    from ledgerloom.operators import search
    recipe = {30.0: {g: {"a": 0.2, "b": 0.8} for g in "xyzu"}, 75.0: {g: {"a": 0.6, "b": 0.4} for g in "xyzu"}}
    decided = spark.createDataFrame([("x", "all"), ("y", "unseen"), ("z", "none")], "segment string, fallback string")
    got = search.apply_fallbacks(recipe, decided, "segment", "a", 75.0)
    anchor = {"a": 1.0, "b": 0.0}
    assert got[30.0] == {"x": anchor, "y": {"a": 0.2, "b": 0.8}, "z": {"a": 0.2, "b": 0.8}, "u": anchor}
    assert got[75.0] == {"x": anchor, "y": anchor, "z": {"a": 0.6, "b": 0.4}, "u": anchor} and recipe[75.0]["x"] == {"a": 0.6, "b": 0.4}
