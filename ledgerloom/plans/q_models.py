"""Bindings: model scores (M), sources and sinks (S). Model scores have no SQL; S has where rows can be compared."""
from pyspark.sql import functions as F

from ..models import scoring as sc
from ..operators import blend as bl, checks as ck, ranks as rk
from ..sources import store, tables as tb
from ..operators.joins import attach_bounded
from .q_scores import auc_sql
from .registry import query

FEATURES = ["amt", "card1", "card2", "addr1", "d1", "d15", "d3", "c13", "day"]
FOLDS = ((700, 900, 1200), (1200, 1400, 1600))


def frames(t):
    """History and query with a planted signal: the label follows the amount and the counter with noise from a hash."""
    noise = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1000)) / 1000
    signal = F.coalesce(F.col("amt") / 500000, F.lit(0.5)) * 0.6 + F.col("c13") / 11 * 0.3 + noise * 0.4
    d = t.tx().withColumn("label", (signal > 0.85).cast("int"))
    return d.filter("split = 'history'"), d.filter("split = 'query'")


@query("M1_tree_scores", "id:i score:f")
def _(t):
    h, q = frames(t)
    fit = sc.fit_trees(h.filter("day < 1300"), FEATURES, "label", valid=h.filter("day >= 1400"))
    return sc.score(fit, q, FEATURES, ["id"], "score")


def oof(t):
    h, _ = frames(t)
    return sc.out_of_fold(h, "day", FOLDS, FEATURES, "label", "id", "s_trees", maxIter=5)


@query("M2_out_of_fold", "id:i fold:i s_trees:f")
def _(t):
    return oof(t)


@query("M3_final_scores", "id:i score:f")
def _(t):
    h, q = frames(t)
    return sc.score(sc.fit_trees(h, FEATURES, "label"), q, FEATURES, ["id"], "score")


@query("M4_seed_subsets", "subset:s rows:i auc:f")
def _(t):
    h, q = frames(t)
    d = store.save(sc.bagged(h, q, FEATURES, "label", "id", (1, 2), "b", ["label"], maxIter=4))
    return sc.seed_subsets(d, "label", ["b_1", "b_2"])


MASKS = ((1, "s1"), (2, "s2"), (3, "(s1 + s2) / 2"), (4, "s3"), (5, "(s1 + s3) / 2"), (6, "(s2 + s3) / 2"), (7, "(s1 + s2 + s3) / 3"))
LATTICE = "WITH s AS (SELECT id, label, s1, s2, (s1 + 2 * s2 * s2) / 3 AS s3 FROM {tx})"
SCORED = [auc_sql(f"(SELECT label, round({e}, 12) AS x FROM s)", "x") for _, e in MASKS]


def lattice(t):
    return t.tx().select("id", "label", "s1", "s2", ((F.col("s1") + 2 * F.col("s2") * F.col("s2")) / 3).alias("s3"))


@query("M4_subset_lattice", "mask:i auc:f", f"{LATTICE} " + " UNION ALL ".join(f"SELECT {m} AS mask, auc FROM ({a})" for (m, _), a in zip(MASKS, SCORED)))
def _(t):
    return sc.subset_lattice(lattice(t), "label", ["s1", "s2", "s3"], batch=3)


@query("M4_best_subset", "id:i best:f", f"{LATTICE}, g AS (" + " UNION ALL ".join(f"SELECT {m} AS mask, {m.bit_count()} AS n, auc FROM ({a})" for (m, _), a in zip(MASKS, SCORED)) + "), "
       "b AS (SELECT mask FROM g ORDER BY round(auc, 12) DESC, n, mask LIMIT 1) SELECT id, CASE mask " + " ".join(f"WHEN {m} THEN {e}" for m, e in MASKS) + " END AS best FROM s, b")
def _(t):
    d = lattice(t)
    return sc.apply_best_subset(d, sc.subset_lattice(d, "label", ["s1", "s2", "s3"]), ["s1", "s2", "s3"], "best")


@query("M5_month_bagging", "id:i m:f")
def _(t):
    h, q = frames(t)
    months = [0, 1, 2, 3]
    h = h.withColumn("month", F.floor(F.col("day") / 400))
    return sc.leave_one_month(h, q, "month", months, FEATURES, "label", "id", "m", maxIter=3)


@query("M6_drift_weights", "id:i weight:f")
def _(t):
    h, q = frames(t)
    return sc.drift_weights(h, q, [f for f in FEATURES if f != "day"], "id", maxIter=4)


META = [f"{s}_{k}" for s in ("s1", "s2") for k in ("prob", "logit", "rank", "rank_sq")] + ["rank_mean", "rank_std", "rank_min", "rank_max", "rank_s1_s2_diff"]


def meta(t):
    return store.save(bl.meta_features(t.tx().filter("split <> 'gap'"), ["s1", "s2"], ["split"]))


@query("M7_linear_meta", "id:i meta:f")
def _(t):
    d = meta(t)
    return sc.linear_meta(d.filter("split = 'history'"), d.filter("split = 'query'"), META, "label", "id", "meta")


@query("M8_meta_views", "id:i plain:f with_raw:f")
def _(t):
    d = meta(t)
    h, q = d.filter("split = 'history'"), d.filter("split = 'query'")
    a = sc.linear_meta(h, q, META, "label", "id", "plain")
    b = sc.linear_meta(h, q, [*META, "amt", "c13"], "label", "id", "with_raw")
    return a.join(b.drop("label"), "id")


@query("M9_view_grid", "view:s config:i features:i auc:f")
def _(t):
    h, _ = frames(t)
    rows = sc.grid(h.filter("day < 1000"), h.filter("day >= 1200"), {"small": FEATURES[:4], "all": FEATURES},
                   [{"maxDepth": 2, "maxIter": 3}, {"maxDepth": 3, "maxIter": 3}], "label", "id")
    return t.spark.createDataFrame([(r["view"], r["config"], r["features"], r["auc"]) for r in rows], "view string, config int, features int, auc double")


@query("M10_champion_rebuild", "auc:f reproduced:i")
def _(t):
    q = t.part3()
    build = lambda: rk.auc(bl.segmented_blend(q, "s1", "s2", "segment", "id", {"strict": 0.2, "partial": 0.4, "cold": 0.6}, "p"), "label", "p")
    stored = build().first()["auc"]
    return ck.metric_reproduced(build(), "auc", stored, 1e-12)


# sources and sinks ------------------------------------------------------------------------------------------
def folder(t, name):
    import uuid
    return f"{store.shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("S1_read_and_merge", "o_custkey:i o_orderkey:i o_totalprice:f c_name:s", """SELECT o_custkey, o_orderkey, o_totalprice, c_name FROM orders
       LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON c_custkey = o_custkey""")
def _(t):
    facts = t.read("orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("Unnamed: 0", F.lit(1))
    details = t.read("customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    out = []
    for d in (facts, details):
        path = folder(t, "csv")
        d.write.option("header", True).csv(path)
        out.append(tb.read_csv(t.spark, path, d.schema))
    return tb.read_split(*out, "o_custkey")


@query("S2_label_placement", "labelled:i unlabelled:i columns:i", """SELECT count(*) FILTER (split = 'history') AS labelled, count(*) FILTER (split = 'query') AS unlabelled,
       21 AS columns FROM {tx}""")
def _(t):
    q = tb.unlabelled(t.query(), "label")
    n = tb.labelled(t.history(), "label").agg(F.count(F.lit(1)).alias("labelled"))
    return bl.with_bounded(n, q.agg(F.count(F.lit(1)).alias("unlabelled"))).withColumn("columns", F.lit(len(q.columns) + 2))


@query("S3_pruned_scan", "o_orderkey:i o_totalprice:f", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    return t.read("orders").select("o_orderkey", "o_totalprice")


@query("S4_reader_contract", "rows:i steps_back:i has_label:i", "SELECT count(*) AS rows, count(*) FILTER (b) AS steps_back, 1 AS has_label FROM (SELECT lag(dt) OVER (ORDER BY id) > dt AS b FROM {tx})")
def _(t):
    return ck.reader_contract(t.tx(), "dt", "id", "label")


@query("S5_matrix_cache", "first_cached:i second_cached:i third_cached:i rows:i", "SELECT 0 AS first_cached, 1 AS second_cached, 0 AS third_cached, count(*) AS rows FROM {tx}")
def _(t):
    path = folder(t, "matrix")
    inputs = {"orders": tb.fingerprint(t.read("orders").select("o_orderkey", "o_totalprice"))}
    make = lambda: t.tx().select("id", "amt", "label")
    hits = [tb.cached_matrix(t.spark, path, v, inputs, make)[1] for v in ("v1", "v1", "v2")]
    d = tb.cached_matrix(t.spark, path, "v2", inputs, make)[0]
    return d.agg(F.count(F.lit(1)).alias("rows")).withColumns({f"{n}_cached": F.lit(int(h)) for n, h in zip(("first", "second", "third"), hits)})


@query("S5_bucketed_families", "id:i amt:f same_card:i first_cached:i second_cached:i other_buckets_cached:i",
       "SELECT id, amt, count(*) OVER (PARTITION BY card1) AS same_card, 0 AS first_cached, 1 AS second_cached, 0 AS other_buckets_cached FROM {tx}")
def _(t):
    """Two feature families kept bucketed by id, one of them read back from its cache; they join without an exchange."""
    path, inputs = folder(t, "bucketed"), {"orders": tb.fingerprint(t.read("orders").select("o_orderkey", "o_totalprice"))}
    make = lambda: t.tx().select("id", "amt", "card1")
    cached = [tb.cached_bucketed(t.spark, f"{path}/{n}", "v1", inputs, ["id"], n, make) for n in (8, 8)]
    other = tb.cached_bucketed(t.spark, f"{path}/8", "v1", inputs, ["id"], 4, make)[1]
    tx = t.tx().select("id", "card1")
    counts = store.save_bucketed(tx.join(tx.groupBy("card1").agg(F.count(F.lit(1)).alias("same_card")), "card1").select("id", "same_card"), ["id"], 8)
    return cached[1][0].join(counts, "id").withColumns({"first_cached": F.lit(int(cached[0][1])), "second_cached": F.lit(int(cached[1][1])),
                                                        "other_buckets_cached": F.lit(int(other))})


@query("S6_fold_cache", "id:i s1:f fold:i", "SELECT id, s1, 2 AS fold FROM {tx} WHERE day % 3 = 2")
def _(t):
    path = folder(t, "folds")
    tb.write_folds(t.tx().select("id", "s1", (F.col("day") % 3).cast("int").alias("fold")), path, "fold")
    assert tb.read_fold(t.spark, path, "fold", 2, ["absent"]) is None
    return tb.read_fold(t.spark, path, "fold", 2, ["id", "s1"])


@query("S7_input_manifest", "name:s rows:i same:i", "SELECT 'orders' AS name, count(*) AS rows, 1 AS same FROM orders UNION ALL SELECT 'events', count(*), 1 FROM events")
def _(t):
    out = None
    for name in ("orders", "events"):
        prints = [tb.fingerprint_row(d) for d in (t.read(name), t.read(name).repartition(3))]
        same = (F.count_distinct("rows", "hash") == 1) & F.bool_and("hashed")
        hashed = tb.file_hashes(t.spark, f"{t.dir}/{name}.parquet").agg((F.count_if(F.length("sha256") == 64) >= 1).alias("hashed"))
        d = attach_bounded(prints[0].unionByName(prints[1]).withColumn("_one", F.lit(1)), hashed.withColumn("_one", F.lit(1)), ["_one"])
        d = d.agg(F.max("rows").alias("rows"), same.cast("int").alias("same")).withColumn("name", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


@query("S7_streamed_hashes", "files:i same:i changed:i missing:i", "SELECT 2 AS files, 1 AS same, 1 AS changed, 1 AS missing")
def _(t):
    """Hashes streamed block by block against those of whole files, one of them stored wrongly, one file gone."""
    found = [tb.file_hashes(t.spark, f"{t.dir}/{n}.parquet", whole=w) for w in (0, tb.WHOLE_FILE) for n in ("orders", "customer")]
    known = found[2].unionByName(found[3]).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    stored = known.withColumn("sha256", F.when(F.col("name").startswith("customer"), F.reverse("sha256")).otherwise(F.col("sha256")))
    stored = stored.unionByName(known.filter("name LIKE 'orders%'").withColumn("name", F.concat(F.lit("lost-"), "name")))
    d = tb.check_hashes(found[0].unionByName(found[1]), stored)
    return d.agg(F.count_if(F.col("status") != "missing").alias("files"), *[F.count_if(F.col("status") == s).alias(s) for s in ("same", "changed", "missing")])


@query("S8_prediction_sink", "id:i s1:f", "SELECT id, s1 FROM {tx} WHERE split = 'query'")
def _(t):
    path = folder(t, "predictions")
    tb.write_predictions(t.query(), path, "id", "s1")
    return tb.read_csv(t.spark, path, t.query().select("id", "s1").schema)


@query("S9_report_sink", "segment:s rows:i", "SELECT segment, count(*) AS rows FROM {part3} GROUP BY segment")
def _(t):
    path = folder(t, "report")
    tb.write_report(t.part3().groupBy("segment").agg(F.count(F.lit(1)).alias("rows")), path)
    return t.spark.read.schema("segment string, rows long").json(path)


@query("S10_template", "id:i p:f", "SELECT id, 0.5 AS p FROM {tx} WHERE split = 'query'")
def _(t):
    return tb.template(t.query(), "id", "p")


@query("S11_overview", "name:s rows:i columns:i", "SELECT 'orders' AS name, count(*) AS rows, 6 AS columns FROM orders UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem")
def _(t):
    return tb.overview(t.spark, {n: f"{t.dir}/{n}.parquet" for n in ("orders", "lineitem")})
