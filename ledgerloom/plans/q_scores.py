"""Bindings: score statistics (A18-A32), ranks (R), segments and folds (V), graph (G), blends (B), checks (K)."""
import uuid
from itertools import product

from pyspark.sql import functions as F

from ..config import DEV_PAIRS, LOCK_PAIRS, PURGED_FOLDS, SEGMENTS, STACK_FOLDS
from ..functions import tokens as tk
from ..operators import backtest as bt, blend as bl, chains, checks as ck, entity as en, folds as fo, graph as gr, ranks as rk, report as rp, search as se
from ..operators import segments as sg
from ..operators.joins import attach_bounded
from ..sources.store import save, shared_dir
from . import final_run as fr
from .q_rows import OR, POOL, POOL_SQL, cat, itok, pool_keys, tok
from .q_stats import CH, CHAIN, CLIENT, GROUPS, counters, membership_sql
from .registry import query


def rank_sql(x, by="", source_count="count(*)"):
    p = f"PARTITION BY {by} " if by else ""
    q = f"{by}, {x}" if by else x
    return f"((rank() OVER ({p}ORDER BY {x}) + (count(*) OVER (PARTITION BY {q}) - 1) / 2.0) / {source_count} OVER ({p.strip()}))"


def auc_sql(source, x, by="", extra=""):
    p = f"PARTITION BY {by} " if by else ""
    q = f"{by}, {x}" if by else x
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}count(*) AS rows, sum(label) AS positives, (sum(CASE WHEN label = 1 THEN _r END) - sum(label) * (sum(label) + 1) / 2.0)
      / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc{extra} FROM (SELECT *, rank() OVER ({p}ORDER BY {x})
      + (count(*) OVER (PARTITION BY {q}) - 1) / 2.0 AS _r FROM {source}) {group}"""


HALF = "CASE WHEN dt <= (SELECT median(dt) FROM part3) THEN 'first' ELSE 'second' END"


def halved(t):
    return se.halves(t.part3(), "dt")


def parts_sql(rows):
    return f"(SELECT *, unnest(['all', half]) AS part FROM {rows})"


def list_frame(t, rows, schema):
    return t.spark.createDataFrame(rows, schema)


# pooling ----------------------------------------------------------------------------------------------------
@query("A18_pooled_score", "id:i mean:f max:f q75:f q90:f", """WITH g AS (SELECT *, addr1 IS NOT NULL AS ok FROM {part3}),
       t AS (SELECT card1, addr1, avg(s1) AS a, max(s1) AS b, quantile_cont(s1, 0.75) AS c, quantile_cont(s1, 0.9) AS d FROM g WHERE ok GROUP BY ALL)
       SELECT id, COALESCE(0.5 * s1 + 0.5 * a, s1) AS mean, COALESCE(0.5 * s1 + 0.5 * b, s1) AS max, COALESCE(0.5 * s1 + 0.5 * c, s1) AS q75,
       COALESCE(0.5 * s1 + 0.5 * d, s1) AS q90 FROM g LEFT JOIN t USING (card1, addr1)""")
def _(t):
    d = t.part3()
    for m in ("mean", "max", "q75", "q90"):
        d = bl.entity_pull(d, ["card1", "addr1"], "s1", 0.5, m, F.col("addr1").isNotNull(), m)
    return d


@query("A19_pooled_by_size", "id:i p:f", """SELECT id, CASE WHEN count(*) OVER w BETWEEN 2 AND 4 THEN 0.7 * s1 + 0.3 * avg(s1) OVER w ELSE s1 END AS p
       FROM {part3} WINDOW w AS (PARTITION BY card1)""")
def _(t):
    return bl.entity_pull(t.part3(), ["card1"], "s1", 0.3, "p", method="mean", size=(2, 4))


@query("A20_entity_maximum", "id:i masked:f pooled:f", f"""SELECT id, CASE WHEN addr1 IS NOT NULL AND d1 IS NOT NULL THEN 0.5 * s1 + 0.5 * max(s1) OVER w
       ELSE s1 END AS masked, 0.75 * s1 + 0.25 * max(s1) OVER w AS pooled FROM (SELECT *, {cat(tok('card1'), tok('addr1'), itok(OR['round']))} AS u FROM {{part3}})
       WINDOW w AS (PARTITION BY u)""")
def _(t):
    d = t.part3().withColumn("u", tk.compose("card1", "addr1", tk.integer_token(tk.origin_day("dt", "d1", "round"))))
    d = bl.entity_pull(d, ["u"], "s1", 0.5, "masked", tk.all_present("addr1", "d1"))
    return bl.entity_pull(d, ["u"], "s1", 0.25, "pooled")


TWO = list(POOL)[:2]


@query("A21_pooling_signals", "id:i " + " ".join(f"{k}_{m}:f" for k in TWO for m in ("mean", "max", "q75"))
       + " multi_mean_meanrank:f multi_max_maxrank:f method_meanrank:f",
       "WITH k AS (SELECT id, s1, " + ", ".join(f"{POOL_SQL[k]} AS {k}" for k in TWO) + " FROM {part3}), p AS (SELECT id, " + ", ".join(
       f"{a} OVER (PARTITION BY {k}) AS {k}_{m}" for k in TWO for m, a in (("mean", "avg(s1)"), ("max", "max(s1)"), ("q75", "quantile_cont(s1, 0.75)")))
       + f""" FROM k), r AS (SELECT *, {', '.join(f"{rank_sql(f'round({k}_{m}, 12)')} AS r_{k}_{m}" for k in TWO for m in ('mean', 'max', 'q75'))} FROM p)
       SELECT *, (r_{TWO[0]}_mean + r_{TWO[1]}_mean) / 2 AS multi_mean_meanrank, greatest(r_{TWO[0]}_max, r_{TWO[1]}_max) AS multi_max_maxrank,
       (r_{TWO[0]}_mean + r_{TWO[0]}_max + r_{TWO[0]}_q75) / 3 AS method_meanrank FROM r""")
def _(t):
    d = pool_keys(t.part3()).select("id", "s1", *TWO)
    return bl.pooling_signals(d, {k: [k] for k in TWO}, "s1")


@query("A22_key_statistics", "key:s valid_rows:i linked_groups:i oversized_groups:i edges:i", """SELECT 'card_d1' AS key, sum(n) AS valid_rows,
       count(*) FILTER (n BETWEEN 2 AND 3) AS linked_groups, count(*) FILTER (n > 3) AS oversized_groups, COALESCE(sum(n - 1) FILTER (n BETWEEN 2 AND 3), 0) AS edges
       FROM (SELECT count(*) AS n FROM {tx} WHERE d1 IS NOT NULL GROUP BY card2, d1, product)""")
def _(t):
    return gr.key_statistics(t.tx(), "id", ["card2", "d1", "product"], 3, "card_d1")


@query("A23_missing_rates", "family:s columns:i missing_rate:f", """SELECT 'days' AS family, 3 AS columns, avg(((d1 IS NULL)::INT + (d15 IS NULL)::INT
       + (d3 IS NULL)::INT) / 3.0) AS missing_rate FROM {tx} UNION ALL SELECT 'mail', 2, avg(((email IS NULL)::INT + (r_email IS NULL)::INT) / 2.0) FROM {tx}""")
def _(t):
    return rp.missing_rates(t.tx(), {"days": ["d1", "d15", "d3"], "mail": ["email", "r_email"]})


@query("A24_block_missingness", "block:s lowest:f highest:f all_or_nothing:f", """SELECT 'v24' AS block, least(avg((v2 IS NULL)::INT), avg((v4 IS NULL)::INT)) AS lowest,
       greatest(avg((v2 IS NULL)::INT), avg((v4 IS NULL)::INT)) AS highest, avg(((v2 IS NULL) = (v4 IS NULL))::INT) AS all_or_nothing FROM {li}""")
def _(t):
    return rp.block_missingness(t.li(), {"v24": ["v2", "v4"]})


@query("A25_weekly_rate", "week:i rows:i rate:f", "SELECT day // 7 AS week, count(*) AS rows, avg(label) AS rate FROM {li} GROUP BY 1")
def _(t):
    return rp.rate_by(t.li(), F.floor(F.col("day") / 7), "label", "week")


@query("A26_contagion", "rate_with:f rate_without:f", """WITH g AS (SELECT label, sum(label) OVER w - label AS others, count(*) OVER w AS n FROM {ev}
       WINDOW w AS (PARTITION BY usr, dt // 43200)) SELECT avg(label) FILTER (others > 0) AS rate_with, avg(label) FILTER (others = 0) AS rate_without FROM g WHERE n > 1""")
def _(t):
    return rp.contagion(t.ev().withColumn("h", F.floor(F.col("dt") / 43200)), ["usr", "h"], "label")


@query("A26_contagion_placebo", "groups:i rows:i", "SELECT count(DISTINCT usr) AS groups, count(*) AS rows FROM {ev}")
def _(t):
    d = rp.shuffled_key(t.ev(), "usr", "id", 0, "dealt")
    assert rp.contagion(d, ["dealt"], "label").columns == ["rate_with", "rate_without"]
    return d.agg(F.count_distinct("dealt").alias("groups"), F.count(F.lit(1)).alias("rows"))


@query("A26_placebo_rates", "rate_with:f rate_without:f", """WITH k AS (SELECT usr AS dealt, row_number() OVER (ORDER BY id) AS k FROM {ev}),
       h AS (SELECT label, row_number() OVER (ORDER BY substr(md5('0:' || id), 1, 15), id) AS k FROM {ev}),
       g AS (SELECT label, sum(label) OVER w - label AS others, count(*) OVER w AS n FROM h JOIN k USING (k) WINDOW w AS (PARTITION BY dealt))
       SELECT avg(label) FILTER (others > 0) AS rate_with, avg(label) FILTER (others = 0) AS rate_without FROM g WHERE n > 1""")
def _(t):
    return rp.contagion(rp.shuffled_key(t.ev(), "usr", "id", 0, "dealt"), ["dealt"], "label")


FOLD_COLS = "fold:i embargo_days:i history_rows:i valid_rows:i history_rate:f valid_rate:f"


def fold_sql(folds):
    return " UNION ALL ".join(f"""SELECT {n} AS fold, {b - a} AS embargo_days, count(*) FILTER (u < {a}) AS history_rows,
      count(*) FILTER (u >= {b} AND u < {c or 99999}) AS valid_rows, avg(label) FILTER (u < {a}) AS history_rate,
      avg(label) FILTER (u >= {b} AND u < {c or 99999}) AS valid_rate FROM f""" for n, (a, b, c) in enumerate(folds))


UNIT = "f AS (SELECT *, day // 22 AS u FROM {tx})"


def unit(t):
    return t.tx().withColumn("u", F.floor(F.col("day") / 22))


@query("A27_fold_table", FOLD_COLS, f"WITH {UNIT} {fold_sql(PURGED_FOLDS)}")
def _(t):
    return rp_fold(t, PURGED_FOLDS)


def rp_fold(t, folds):
    return fo.fold_table(unit(t), "u", "label", folds)


@query("A28_segment_metrics", "segment:s rows:i positives:i rate:f auc:f", f"SELECT *, positives / rows AS rate FROM ({auc_sql('{part3}', 's1', 'segment')})")
def _(t):
    return rp.segment_metrics(t.part3(), "label", "s1", ["segment"])


@query("A29_weight_summary", "min:f max:f mean:f q05:f q95:f", """SELECT min(amt) AS min, max(amt) AS max, avg(amt) AS mean, quantile_cont(amt, 0.05) AS q05,
       quantile_cont(amt, 0.95) AS q95 FROM {tx}""")
def _(t):
    from ..models.scoring import weight_summary
    return weight_summary(t.tx(), "amt")


@query("A30_fold_segment_pivot", "fold:i strict:f partial:f cold:f", "WITH m AS (SELECT *, day % 2 AS fold FROM {part3}), a AS ("
       + auc_sql("m", "s1", "fold, segment") + """) SELECT fold, max(auc) FILTER (segment = 'strict') AS strict, max(auc) FILTER (segment = 'partial') AS partial,
       max(auc) FILTER (segment = 'cold') AS cold FROM a WHERE rows >= 200 GROUP BY fold""")
def _(t):
    m = rp.segment_metrics(t.part3().withColumn("fold", F.col("day") % 2), "label", "s1", ["fold", "segment"], 200)
    return rp.metric_pivot(m, "fold", "segment", list(SEGMENTS))


@query("A31_rank_movement", "segment:s rows:i spearman:f max_move:f median_move:f", f"""WITH r AS (SELECT segment, abs({rank_sql('s2')} - {rank_sql('s1')}) AS m,
       {rank_sql('s1', 'segment')} AS a, {rank_sql('s2', 'segment')} AS b FROM {{part3}})
       SELECT segment, count(*) AS rows, corr(a, b) AS spearman, max(m) AS max_move, median(m) AS median_move FROM r GROUP BY segment""")
def _(t):
    return rp.rank_movement(t.part3(), "s1", "s2", "segment")


@query("A32_recipe_table", "recipe:s part:s rows:i auc:f", "WITH m AS (SELECT label, unnest(['all', CASE WHEN segment = 'cold' THEN 'cold' ELSE 'rest' END]) AS part, "
       + f"{rank_sql('s1')} AS a, {rank_sql('s2')} AS b, segment FROM {{part3}}), l AS (SELECT label, part, 'base' AS recipe, a AS x FROM m UNION ALL "
       "SELECT label, part, 'mixed', CASE WHEN segment = 'cold' THEN 0.8 * a + 0.2 * b ELSE a END FROM m) " + auc_sql("l", "x", "recipe, part"))
def _(t):
    d = bl.residual_layers(t.part3(), "s1", [], "base")
    d = bl.residual_layers(d, "s1", [("s2", 0.2, F.col("segment") == "cold")], "mixed")
    return rp.recipe_table(d, "label", ["base", "mixed"], F.when(F.col("segment") == "cold", "cold").otherwise("rest"))


# ranks ------------------------------------------------------------------------------------------------------
@query("R1_percentile_rank", "id:i r:f", f"SELECT id, {rank_sql('s1')} AS r FROM {{tx}}")
def _(t):
    return rk.average_rank(t.tx(), "s1", "r")


@query("R2_rank_in_segment", "id:i r:f q:f", f"SELECT id, {rank_sql('s1', 'segment')} AS r, {rank_sql('s2', 'day')} AS q FROM {{part3}}")
def _(t):
    return rk.average_rank(rk.average_rank(t.part3(), "s1", "r", ["segment"]), "s2", "q", ["day"])


@query("R3_rank_match", "id:i x:f", """WITH a AS (SELECT id, row_number() OVER (ORDER BY s1, id) AS k FROM {part3}),
       b AS (SELECT s2, row_number() OVER (ORDER BY s2, id) AS k FROM {part3}) SELECT id, s2 AS x FROM a JOIN b USING (k)""")
def _(t):
    return rk.rank_match(t.part3(), "s1", "s2", "id", "x")


@query("R4_auc", "rows:i positives:i auc:f", "WITH m AS (SELECT quality AS label, n_chars FROM labels JOIN documents USING (doc_id)) " + auc_sql("m", "n_chars"))
def _(t):
    d = t.read("labels").join(t.read("documents").select("doc_id", "n_chars"), "doc_id")
    return rk.auc(d, "quality", "n_chars")


@query("R5_half_gains", "part:s rows:i auc:f", f"WITH h AS (SELECT *, {HALF} AS half FROM {{part3}}) " + auc_sql(parts_sql("h"), "s1", "part"))
def _(t):
    return rk.auc(se.in_parts(halved(t)), "label", "s1", ["part"])


@query("R6_spearman", "rows:i spearman:f", f"SELECT count(*) AS rows, corr(a, b) AS spearman FROM (SELECT {rank_sql('s1')} AS a, {rank_sql('s3')} AS b FROM {{tx}})")
def _(t):
    return rk.spearman(t.tx(), "s1", "s3")


IMP = "i AS (SELECT unnest(['c13', 'card1', 'card2', 'day', 's1', 's3']) AS name, unnest([" + ", ".join(
    f"abs(corr({c}, label))" for c in ("c13", "card1", "card2", "day", "s1", "s3")) + "]) AS importance FROM {tx})"


def importances(t):
    return rp.label_correlation(t.tx(), ["c13", "card1", "card2", "day", "s1", "s3"], "label")


@query("R7_top_columns", "name:s importance:f", f"""WITH {IMP} SELECT name, importance FROM i ORDER BY CASE name WHEN 's3' THEN 1 WHEN 'day' THEN 2 ELSE 3 END,
       importance DESC, name LIMIT 4""")
def _(t):
    return rp.top_columns(importances(t), 4, ["s3", "day"])


@query("R8_best_stable", "segment:s weight:f score:f", """WITH c AS (SELECT segment, w / 10.0 AS weight, avg(label * ((1 - w / 10.0) * s1 + w / 10.0 * s2)) AS score FROM {part3}, (SELECT unnest(range(11)) AS w) GROUP BY ALL)
       SELECT segment, weight, score FROM c QUALIFY row_number() OVER (PARTITION BY segment ORDER BY score DESC, weight) = 1""")
def _(t):
    d = t.part3().select("segment", "label", "s1", "s2", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("w"))
    w = F.col("w") / 10
    rows = d.groupBy("segment", w.alias("weight")).agg(F.avg(F.col("label") * ((1 - w) * F.col("s1") + w * F.col("s2"))).alias("score"))
    return (rows.withColumn("_s", F.struct(F.round("score", 12).alias("a"), (-F.col("weight")).alias("b")))
            .groupBy("segment").agg(F.max_by(F.struct("weight", "score"), "_s").alias("_b")).select("segment", "_b.*"))


@query("R9_importance_places", "name:s place:i", f"WITH {IMP} SELECT name, place FROM (SELECT name, row_number() OVER (ORDER BY importance DESC, name) AS place FROM i) WHERE name IN ('day', 'c13')")
def _(t):
    return rp.importance_places(importances(t), ["day", "c13"])


@query("R10_family_share", "family:s share:f", f"""WITH {IMP} SELECT family, sum(importance) / (SELECT sum(importance) FROM i) AS share FROM (
       SELECT CASE WHEN name LIKE 'card%' THEN 'card' WHEN name LIKE 's_' THEN 'score' ELSE 'other' END AS family, importance FROM i) GROUP BY family""")
def _(t):
    n = F.col("name")
    return rp.family_share(importances(t), F.when(n.like("card%"), "card").when(n.like("s_"), "score").otherwise("other"))


@query("R11_time_order", "id:i place:i", "SELECT id, row_number() OVER (ORDER BY dt, id) AS place FROM {tx}")
def _(t):
    return rk.ordinal(t.tx(), ["dt", "id"], "place")


@query("U2_fold_union", "fold:i n:i", "SELECT day % 4 AS fold, count(*) AS n FROM {tx} GROUP BY 1")
def _(t):
    parts = [t.tx().filter(F.col("day") % 4 == i).select("id", F.lit(i).alias("fold")) for i in range(4)]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return d.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


# segments and folds -----------------------------------------------------------------------------------------
@query("V1_segments", "id:i segment:s", f"""WITH k AS (SELECT *, {cat(tok('card1'), tok('addr1'), itok(OR['round']), tok('email'))} AS a,
       {cat(tok('card1'), tok('addr1'), itok(OR['round']))} AS b, {cat(itok(OR['round']), tok('email'))} AS c, addr1 IS NOT NULL AND d1 IS NOT NULL AS v,
       d1 IS NOT NULL AND email IS NOT NULL AS w FROM (SELECT * REPLACE (card1 % 20 AS card1, addr1 % 4 AS addr1, dt % 8640000 AS dt) FROM {{tx}})),
       h AS (SELECT * FROM k WHERE split = 'history') SELECT id, CASE WHEN v AND a IN (SELECT a FROM h WHERE v) THEN 'strict'
       WHEN (v AND b IN (SELECT b FROM h WHERE v)) OR (w AND c IN (SELECT c FROM h WHERE w)) THEN 'partial' ELSE 'cold' END AS segment FROM k WHERE split = 'query'""")
def _(t):
    d = t.tx().withColumns({"card1": F.col("card1") % 20, "addr1": F.col("addr1") % 4, "dt": F.col("dt") % 8640000})
    d = sg.uid_metadata(d, "dt", "d1", ["card1", "addr1"], "email", "round")
    return sg.segments(d.filter("split = 'query'"), d.filter("split = 'history'"))


@query("V2_segment_labels", "segment:s n:i", f"WITH {CLIENT} SELECT CASE WHEN segment_strict = 1 THEN 'strict' WHEN segment_partial = 1 THEN 'partial' ELSE 'cold' END AS segment, "
       f"count(*) AS n FROM ({membership_sql('h', 'q')}) GROUP BY 1")
def _(t):
    d = sg.with_client_keys(t.tx(), "dt", "d1", "email")
    m = sg.membership(d.filter("split = 'query'"), d.filter("split = 'history'"), GROUPS)
    return sg.segment_label(m).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def assigned_sql(folds):
    return " UNION ALL ".join(f"""SELECT {n} AS fold, CASE WHEN u < {a} THEN 'history' ELSE 'valid' END AS side, count(*) AS n, min(u) AS first, max(u) AS last
      FROM f WHERE u < {a} OR (u >= {b} AND u < {c or 99999}) GROUP BY ALL""" for n, (a, b, c) in enumerate(folds))


def assigned(t, folds):
    d = fo.assign_folds(unit(t), "u", folds)
    return d.groupBy("fold", "side").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("first"), F.max("u").alias("last"))


@query("V3_purged_folds", "fold:i side:s n:i first:i last:i", f"WITH {UNIT} {assigned_sql(PURGED_FOLDS)}")
def _(t):
    return assigned(t, PURGED_FOLDS)


@query("V4_stack_folds", "fold:i side:s n:i first:i last:i", f"WITH {UNIT} {assigned_sql(STACK_FOLDS)}")
def _(t):
    return assigned(t, STACK_FOLDS)


@query("V5_horizon_pairs", "name:s horizon:i history_rows:i future_rows:i skipped:i", f"WITH {UNIT} " + " UNION ALL ".join(
       f"SELECT '{n}' AS name, {h} AS horizon, count(*) FILTER (u < {a}) AS history_rows, count(*) FILTER (u >= {b} AND u < {c}) AS future_rows, "
       f"count(*) FILTER (u >= {a} AND u < {b}) AS skipped FROM f" for n, _, h, a, b, c in DEV_PAIRS + LOCK_PAIRS))
def _(t):
    return fo.pair_counts(unit(t), "u", DEV_PAIRS + LOCK_PAIRS)


ROLL = (2, 3, 4, 5, 10, 20)
PAIR_DAY = 22 * 86400      # the bounds of the pairs are in units of 22 days of the test tables
PAIR_COLUMNS = ("pair:s id:i side:s segment:s known_rows:i known_positives:i known_rate_smoothed:f known_since_positive:i order:i since_previous:i "
                + " ".join(f"gap_mean_{k}:f gap_std_{k}:f" for k in ROLL) + " entity_rows:i entity_mean_amt:f entity_std_amt:f entity_span:i amt_zscore:f addr1_nunique:i email_nunique:i")


@query("V5_pair_features", PAIR_COLUMNS, f"""WITH x AS (SELECT *, card1 % 200 AS entity, card1 % 20 AS c20, addr1 % 4 AS a4, dt % 8640000 AS back FROM {{tx}}),
       u AS (SELECT *, {cat(tok('c20'), tok('a4'), f"COALESCE(CAST(CAST(round_even(back / 86400 - d1, 0) AS BIGINT) AS VARCHAR), '<MISSING>')", tok('email'))} AS strict,
         {cat(tok('c20'), tok('a4'), "COALESCE(CAST(CAST(round_even(back / 86400 - d1, 0) AS BIGINT) AS VARCHAR), '<MISSING>')")} AS card,
         {cat("COALESCE(CAST(CAST(round_even(back / 86400 - d1, 0) AS BIGINT) AS VARCHAR), '<MISSING>')", tok('email'))} AS mail,
         a4 IS NOT NULL AND d1 IS NOT NULL AS v, d1 IS NOT NULL AND email IS NOT NULL AS w FROM x),
       pairs(pair, e, s, t) AS (VALUES {', '.join(f"('{n}', {a * PAIR_DAY}, {b * PAIR_DAY}, {c * PAIR_DAY})" for n, _, _, a, b, c in DEV_PAIRS + LOCK_PAIRS)}),
       m AS (SELECT *, dt < e AS past FROM pairs JOIN u ON dt < e OR (dt >= s AND dt < t)),
       h AS (SELECT pair, entity, count(*) AS n, sum(label) AS y, max(CASE WHEN label = 1 THEN dt END) AS at FROM m WHERE past GROUP BY ALL),
       r AS (SELECT pair, avg(label) AS rate FROM m WHERE past GROUP BY pair),
       g AS (SELECT *, dt - lag(dt) OVER o AS gap, row_number() OVER o - 1 AS "order", count(*) OVER q AS cn, COALESCE(sum(label) OVER q, 0) AS cy,
         max(CASE WHEN label = 1 THEN dt END) OVER q AS cat FROM m WINDOW o AS (PARTITION BY pair, entity ORDER BY dt, id),
         q AS (PARTITION BY pair, entity ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
       f AS (SELECT *, gap AS since_previous, {', '.join(f'avg(gap) OVER (o ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS gap_mean_{k}, '
                                                     f'stddev_samp(gap) OVER (o ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS gap_std_{k}' for k in ROLL)},
         CASE WHEN past THEN cn ELSE COALESCE(h.n, 0) END AS known_rows, CASE WHEN past THEN cy ELSE COALESCE(h.y, 0) END AS known_positives,
         dt - CASE WHEN past THEN cat ELSE h.at END AS known_since_positive, rate FROM g LEFT JOIN h USING (pair, entity) JOIN r USING (pair) WINDOW o AS (PARTITION BY pair, entity ORDER BY dt, id)),
       a AS (SELECT pair, entity, count(*) AS entity_rows, avg(amt) AS entity_mean_amt, stddev_samp(amt) AS entity_std_amt, max(dt) - min(dt) AS entity_span,
         count(DISTINCT addr1) AS addr1_nunique, count(DISTINCT email) AS email_nunique FROM m GROUP BY ALL),
       ks AS (SELECT DISTINCT pair, strict FROM m WHERE past AND v), kc AS (SELECT DISTINCT pair, card FROM m WHERE past AND v), km AS (SELECT DISTINCT pair, mail FROM m WHERE past AND w)
       SELECT f.*, a.* EXCLUDE (pair, entity), CASE WHEN past THEN 'history' ELSE 'future' END AS side, (known_positives + 20 * rate) / (known_rows + 20) AS known_rate_smoothed,
         CASE WHEN entity_std_amt > 1e-9 THEN (amt - entity_mean_amt) / entity_std_amt END AS amt_zscore,
         CASE WHEN past THEN NULL WHEN v AND ks.strict IS NOT NULL THEN 'strict' WHEN (v AND kc.card IS NOT NULL) OR (w AND km.mail IS NOT NULL) THEN 'partial' ELSE 'cold' END AS segment
       FROM f JOIN a USING (pair, entity) LEFT JOIN ks ON ks.pair = f.pair AND ks.strict = f.strict LEFT JOIN kc ON kc.pair = f.pair AND kc.card = f.card
       LEFT JOIN km ON km.pair = f.pair AND km.mail = f.mail""")
def _(t):
    d = t.tx().withColumns({"entity": F.col("card1") % 200, "c20": F.col("card1") % 20, "a4": F.col("addr1") % 4, "back": F.col("dt") % 8640000})
    d = sg.uid_metadata(d, "back", "d1", ["c20", "a4"], "email", "round")
    return bt.pair_frames(d, ["entity"], "dt", "id", "label", "amt", ["addr1", "email"], DEV_PAIRS + LOCK_PAIRS, PAIR_DAY)


@query("V6_time_holdout", "holdout:i n:i", "SELECT dt > (SELECT quantile_cont(dt, 0.8) FROM {tx}) AS holdout, count(*) AS n FROM {tx} GROUP BY 1")
def _(t):
    return fo.time_holdout(t.tx(), "dt").groupBy("holdout").agg(F.count(F.lit(1)).alias("n"))


@query("V7_month_groups", "month:i kept:i", "SELECT m AS month, (SELECT count(*) FROM {tx}) - count(*) AS kept FROM (SELECT day // 400 AS m FROM {tx}) GROUP BY m")
def _(t):
    d = t.tx().withColumn("month", F.floor(F.col("day") / 400))
    parts = [d.filter(F.col("month") != m).agg(F.count(F.lit(1)).alias("kept")).withColumn("month", F.lit(m)) for m in fo.month_groups(d, "month")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("V8_stratified_folds", "label:i fold:i n:i", """SELECT label, (k - 1) % 5 AS fold, count(*) AS n FROM (
       SELECT label, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM {tx}) GROUP BY ALL""")
def _(t):
    return fo.stratified_folds(t.tx(), "label", "id", 5, 0).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("V9_history_sample", "n:i ids:i history:i", "SELECT 700 AS n, 700 AS ids, 700 AS history FROM (SELECT count(*) FROM {tx})")
def _(t):
    d = fo.hash_sample(t.history(), "id", 700, 3)
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("split") == "history").alias("history"))


@query("V9_sample_rows", "id:i", "SELECT id FROM {tx} WHERE split = 'history' QUALIFY row_number() OVER (ORDER BY substr(md5('3:' || id), 1, 15), id) <= 300")
def _(t):
    return fo.hash_sample(t.history(), "id", 300, 3)


@query("V10_forecast_horizon", "id:i horizon:f", "SELECT id, (dt - (SELECT max(dt) FROM {tx} WHERE split = 'history')) / 86400.0 AS horizon FROM {tx} WHERE split = 'query'")
def _(t):
    return fo.horizon(t.query(), t.history(), "dt")


# graph ------------------------------------------------------------------------------------------------------
KEYS = [(["card1", "d1"], 3), (["card2", "product", "day"], 4), (["card1", "email", "d15"], 2)]
PAIRS = " UNION ".join("SELECT x.id AS a, y.id AS b FROM tx x JOIN tx y ON " + " AND ".join(f"x.{c} = y.{c}" for c in k)
                       + f" JOIN (SELECT {', '.join(k)} FROM tx GROUP BY ALL HAVING count(*) BETWEEN 2 AND {cap}) g ON " + " AND ".join(f"x.{c} = g.{c}" for c in k)
                       for k, cap in KEYS)
REACH = "reach AS (SELECT id, id AS r FROM {tx} UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.r = e.a), comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"


def component_frame(t):
    return gr.entity_components(t.tx(), "id", KEYS, 500)


@query("G1_star_edges", "a:i b:i", "SELECT hub AS a, id AS b FROM (SELECT id, min(id) OVER w AS hub, count(*) OVER w AS n FROM {tx} WHERE d1 IS NOT NULL WINDOW w AS (PARTITION BY card1, d1)) WHERE n BETWEEN 2 AND 3 AND id <> hub")
def _(t):
    return gr.star_edges(t.tx(), "id", ["card1", "d1"], 3)


@query("G2_entity_components", "id:i component:i", f"WITH e AS ({PAIRS}), {REACH} SELECT * FROM comp")
def _(t):
    return component_frame(t)


@query("G2_component_statistics", "rows:i components:i singletons:i multirow:i rows_in_multirow:i largest:i", f"""WITH e AS ({PAIRS}), {REACH}, n AS (
       SELECT count(*) AS n FROM comp GROUP BY component) SELECT sum(n) AS rows, count(*) AS components, count(*) FILTER (n = 1) AS singletons,
       count(*) FILTER (n > 1) AS multirow, sum(n) FILTER (n > 1) AS rows_in_multirow, max(n) AS largest FROM n""")
def _(t):
    return gr.component_statistics(component_frame(t), "component")


@query("G2_capped_components", "size:i components:i")
def _(t):
    d = gr.entity_components(t.tx(), "id", KEYS, 6)
    return d.groupBy("component").count().groupBy(F.col("count").alias("size")).agg(F.count(F.lit(1)).alias("components"))


@query("G3_key_support", "id:i support:i", "SELECT id, (d1 IS NOT NULL)::INT + 1 + (email IS NOT NULL AND d15 IS NOT NULL)::INT AS support FROM {tx}")
def _(t):
    return t.tx().withColumn("support", gr.key_support([k for k, _ in KEYS]))


FUZZY = f"""o AS (SELECT *, {OR['round']} AS origin, lower(email) AS mail FROM {{tx}}), z AS (SELECT *, lag(id) OVER w AS pid, (dt - lag(dt) OVER w) / 86400.0 AS gap,
       abs(origin - lag(origin) OVER w) AS shift, c13 - lag(c13) OVER w AS step, mail = lag(mail) OVER w AS same_mail, product IS NOT DISTINCT FROM lag(product) OVER w AS same_product
       FROM o WINDOW w AS (PARTITION BY card1, addr1 ORDER BY dt, id)), fz AS (SELECT pid AS a, id AS b FROM z WHERE pid IS NOT NULL AND gap BETWEEN 0 AND 120
       AND abs(gap - d3) <= 1.5 AND shift <= 35 AND (same_product OR COALESCE(same_mail, false) OR COALESCE(step BETWEEN -1 AND 10, false)))"""


def fuzzy(t):
    d = t.tx().withColumns({"origin": tk.origin_day("dt", "d1", "round"), "mail": tk.clean_mail("email")})
    return d, gr.fuzzy_edges(d, "id", ["card1", "addr1"], "dt", "d3", "origin", "product", "mail", "c13")


@query("G5_fuzzy_edges", "a:i b:i", f"WITH {FUZZY} SELECT a, b FROM fz")
def _(t):
    return fuzzy(t)[1]


@query("G4_second_graph", "id:i component:i", f"""WITH {FUZZY}, e0 AS (SELECT x.id AS a, y.id AS b FROM o x JOIN o y ON x.card1 = y.card1 AND x.addr1 = y.addr1 AND x.origin = y.origin
       UNION SELECT x.id, y.id FROM o x JOIN o y ON x.card1 = y.card1 AND x.origin = y.origin AND x.mail = y.mail UNION SELECT a, b FROM fz UNION SELECT b, a FROM fz),
       e AS (SELECT * FROM e0 WHERE a <> b), {REACH} SELECT * FROM comp""")
def _(t):
    d, extra = fuzzy(t)
    return gr.entity_components(d, "id", [(["card1", "addr1", "origin"], 200), (["card1", "origin", "mail"], 150)], 500, extra)


@query("G6_derived_uids", "id:i uid_component:s uid_clean_mail:s uid_product:s", f"""WITH e AS ({PAIRS}), {REACH} SELECT id, 'u' || component AS uid_component,
       {cat(tok('card1'), tok('addr1'), itok(OR['round']), tok('lower(email)'))} AS uid_clean_mail, {cat(tok('card1'), tok('addr1'), itok(OR['round']), tok('product'))} AS uid_product
       FROM comp JOIN {{tx}} USING (id)""")
def _(t):
    d = component_frame(t).withColumns({"origin": tk.origin_day("dt", "d1", "round"), "mail": tk.clean_mail("email")})
    return gr.derived_uids(d, "component", ["card1", "addr1"], "origin", "mail", "product")


@query("G7_counter_chains", "id:i chain:i", f"WITH {CHAIN} SELECT id, chain FROM chain")
def _(t):
    return chains.counter_chains(counters(t), "uid", "dt", "id", "s", "e")


@query("G7_chain_statistics", "chains:i linked_rows:i multirow_chains:i rows_in_multirow_chains:i max_chain_size:i", f"""WITH {CHAIN}, n AS (SELECT chain, count(*) AS n FROM chain GROUP BY chain)
       SELECT count(*) AS chains, (SELECT count(pid) FROM par) AS linked_rows, count(*) FILTER (n > 1) AS multirow_chains, sum(n) FILTER (n > 1) AS rows_in_multirow_chains,
       max(n) AS max_chain_size FROM n""")
def _(t):
    return chains.chain_statistics(chains.counter_chains(counters(t), "uid", "dt", "id", "s", "e"), "chain")


@query("G9_link_rate", "rows:i linked:i rate:f", f"WITH {CHAIN}, k AS (SELECT id, chain IN (SELECT chain FROM chain WHERE split = 'history') AS l FROM chain WHERE split = 'query') "
       "SELECT count(*) AS rows, sum(l::INT) AS linked, avg(l::INT) AS rate FROM k")
def _(t):
    return chains.link_rate(chains.counter_chains(counters(t), "uid", "dt", "id", "s", "e"), "chain", "split")


# blends -----------------------------------------------------------------------------------------------------
@query("F27_meta_features", "id:i s1_prob:f s1_logit:f s1_rank:f s1_rank_sq:f rank_mean:f rank_std:f rank_min:f rank_max:f rank_s1_s2_diff:f rank_s2_s3_diff:f",
       f"""WITH c AS (SELECT id, {', '.join(f'least(greatest({s}, 1e-6), 1 - 1e-6) AS {s}' for s in ('s1', 's2', 's3'))}, day % 3 AS fold FROM {{part3}}),
       r AS (SELECT *, {', '.join(f"{rank_sql(s, 'fold')} AS r{s}" for s in ('s1', 's2', 's3'))} FROM c)
       SELECT id, s1 AS s1_prob, ln(s1 / (1 - s1)) AS s1_logit, rs1 AS s1_rank, rs1 * rs1 AS s1_rank_sq, (rs1 + rs2 + rs3) / 3 AS rank_mean,
       sqrt(((rs1 - (rs1 + rs2 + rs3) / 3) ** 2 + (rs2 - (rs1 + rs2 + rs3) / 3) ** 2 + (rs3 - (rs1 + rs2 + rs3) / 3) ** 2) / 2) AS rank_std,
       least(rs1, rs2, rs3) AS rank_min, greatest(rs1, rs2, rs3) AS rank_max, abs(rs1 - rs2) AS rank_s1_s2_diff, abs(rs2 - rs3) AS rank_s2_s3_diff FROM r""")
def _(t):
    return bl.meta_features(t.part3().withColumn("fold", F.col("day") % 3), ["s1", "s2", "s3"], ["fold"])


@query("B1_residual_layers", "id:i p:f", f"""WITH a AS (SELECT *, {rank_sql('s1')} AS b, {rank_sql('s2')} AS l1, {rank_sql('s3')} AS l2 FROM {{part3}}),
       m AS (SELECT *, CASE WHEN segment = 'cold' THEN (1 - 0.1125) * b + 0.1125 * l1 ELSE b END AS m FROM a), n AS (SELECT *, {rank_sql('m')} AS n FROM m)
       SELECT id, CASE WHEN segment = 'cold' THEN (1 - 0.025) * n + 0.025 * l2 ELSE n END AS p FROM n""")
def _(t):
    cold = F.col("segment") == "cold"
    return bl.residual_layers(t.part3(), "s1", [("s2", 0.1125, cold), ("s3", 0.025, cold)], "p")


@query("B2_rank_blend", "id:i p:f", f"SELECT id, 0.7 * {rank_sql('s1', 'fold')} + 0.3 * {rank_sql('s2', 'fold')} AS p FROM (SELECT *, day % 3 AS fold FROM {{part3}})")
def _(t):
    return bl.rank_blend(t.part3().withColumn("fold", F.col("day") % 3), {"s1": 0.7, "s2": 0.3}, "p", ["fold"])


SEG_W = {"strict": 0.2, "partial": 0.4, "cold": 0.6}
W_SQL = "CASE segment " + " ".join(f"WHEN '{s}' THEN CAST({w} AS DOUBLE)" for s, w in SEG_W.items()) + " END"


@query("B3_segmented_blend", "id:i p:f", f"""WITH a AS (SELECT *, {rank_sql('s1')} AS cur FROM {{part3}}), b AS (SELECT *, {rank_sql('cur', 'segment')} AS cs, {rank_sql('s2', 'segment')} AS ss FROM a),
       c AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY (1 - {W_SQL}) * cs + {W_SQL} * ss, id) AS k, row_number() OVER (PARTITION BY segment ORDER BY cur, id) AS j FROM b)
       SELECT c.id, d.cur AS p FROM c JOIN c d ON c.segment = d.segment AND c.k = d.j""")
def _(t):
    return bl.segmented_blend(t.part3(), "s1", "s2", "segment", "id", SEG_W, "p")


@query("B4_direct_blend", "id:i p:f", f"SELECT id, (1 - {W_SQL}) * s1 + {W_SQL} * s2 AS p FROM {{part3}}")
def _(t):
    return bl.direct_blend(t.part3(), "s1", "s2", "segment", SEG_W, "p")


MIX = {"strict": {"s1": 0.5, "s2": 0.3, "s3": 0.2}, "partial": {"s1": 0.2, "s2": 0.2, "s3": 0.6}, "cold": {"s1": 0.0, "s2": 1.0, "s3": 0.0}}


@query("B5_segment_mix", "id:i p:f", "SELECT id, CASE segment " + " ".join(f"WHEN '{g}' THEN " + " + ".join(f"{w} * {s}" for s, w in m.items()) for g, m in MIX.items()) + " END AS p FROM {part3}")
def _(t):
    return bl.segment_mix(t.part3(), "segment", MIX, "p")


HW = {30.0: MIX, 45.0: {g: {"s1": 0.1, "s2": 0.6, "s3": 0.3} for g in SEGMENTS}, 60.0: MIX, 75.0: {g: {"s1": 1.0, "s2": 0.0, "s3": 0.0} for g in SEGMENTS}}


def interpolate_sql(g, s, weights=HW):
    hs = sorted(weights)
    e = f"WHEN h < {hs[0]} THEN {weights[hs[0]][g][s]} "
    for a, b in zip(hs, hs[1:]):
        e += f"WHEN h < {b} THEN {weights[a][g][s]} + ({weights[b][g][s]} - {weights[a][g][s]}) * (h - {a}) / {b - a} "
    return f"CASE {e} ELSE {weights[hs[-1]][g][s]} END"


@query("B6_horizon_mix", "id:i p:f", "WITH h AS (SELECT *, (day % 120) * 0.8 AS h FROM {part3}), w AS (SELECT *, " + ", ".join(
       "CASE segment " + " ".join(f"WHEN '{g}' THEN {interpolate_sql(g, s)}" for g in SEGMENTS) + f" END AS w{s}" for s in ("s1", "s2", "s3"))
       + " FROM h) SELECT id, (ws1 * s1 + ws2 * s2 + ws3 * s3) / (ws1 + ws2 + ws3) AS p FROM w")
def _(t):
    return bl.horizon_mix(t.part3().withColumn("h", F.col("day") % 120 * 0.8), "segment", "h", HW, "p")


SIMPLEX = "w AS (SELECT a / 5.0 AS w1, b / 5.0 AS w2, (5 - a - b) / 5.0 AS w3 FROM range(6) x(a), range(6) y(b) WHERE a + b <= 5)"


@query("B7_simplex_grid", "s1:f s2:f s3:f mean:f", f"WITH {SIMPLEX} SELECT w1 AS s1, w2 AS s2, w3 AS s3, avg(w1 * p.s1 + w2 * p.s2 + w3 * p.s3) AS mean FROM w, {{part3}} p GROUP BY ALL")
def _(t):
    grid = se.simplex(t.spark, ["s1", "s2", "s3"], 5)
    means = t.part3().agg(*[F.avg(s).alias(f"m_{s}") for s in ("s1", "s2", "s3")])
    return bl.with_bounded(grid, means).withColumn("mean", F.col("s1") * F.col("m_s1") + F.col("s2") * F.col("m_s2") + F.col("s3") * F.col("m_s3"))


def weights_of(t, d):
    return [r.asDict() for r in se.simplex(t.spark, ["s1", "s2", "s3"], d).orderBy("s1", "s2", "s3").collect()]


@query("B8_segment_weights", "candidate:i segment:s mean_auc:f", f"""WITH {SIMPLEX}, c AS (SELECT *, row_number() OVER (ORDER BY w1, w2, w3) - 1 AS candidate FROM w),
       l AS (SELECT candidate, segment, day % 2 AS fold, label, round(w1 * s1 + w2 * s2 + w3 * s3, 12) AS x FROM c, {{part3}}), a AS ({auc_sql('l', 'x', 'candidate, segment, fold')})
       SELECT candidate, segment, avg(auc) AS mean_auc FROM a GROUP BY ALL""")
def _(t):
    d = t.part3().withColumn("fold", F.col("day") % 2)
    scored = se.candidate_auc(d, "label", ["s1", "s2", "s3"], weights_of(t, 5), ["segment", "fold"])
    return scored.groupBy("candidate", "segment").agg(F.avg("auc").alias("mean_auc"))


@query("B8_coarse_to_fine", "s1:f s2:f s3:f auc:f", f"""WITH g AS (SELECT d, a / d AS w1, b / d AS w2, (d - a - b) / d AS w3, row_number() OVER (PARTITION BY d ORDER BY a, b) AS k
       FROM (SELECT unnest([5.0, 10.0]) AS d), range(11) x(a), range(11) y(b) WHERE a + b <= d), l AS (SELECT d, k, day % 2 AS fold, label, round(w1 * s1 + w2 * s2 + w3 * s3, 12) AS x
       FROM g, {{part3}}), a AS ({auc_sql('l', 'x', 'd, k, fold')}), m AS (SELECT g.*, round(avg(auc), 12) AS auc FROM a JOIN g USING (d, k) GROUP BY ALL),
       c AS (SELECT * FROM m WHERE d = 5 ORDER BY auc DESC, k LIMIT 1), f AS (SELECT m.* FROM m, c WHERE m.d = 10 AND abs(m.w1 - c.w1) + abs(m.w2 - c.w2) + abs(m.w3 - c.w3) <= 0.4 + 1e-12
       ORDER BY m.auc DESC, m.k LIMIT 1) SELECT CASE WHEN b THEN f.w1 ELSE c.w1 END AS s1, CASE WHEN b THEN f.w2 ELSE c.w2 END AS s2, CASE WHEN b THEN f.w3 ELSE c.w3 END AS s3,
       CASE WHEN b THEN f.auc ELSE c.auc END AS auc FROM (SELECT f.auc > c.auc + 1e-12 AS b FROM f, c) t, f, c""")
def _(t):
    d = t.part3().withColumn("fold", F.col("day") % 2)
    best, w = se.coarse_to_fine(d, "label", ["s1", "s2", "s3"], "fold")
    return list_frame(t, [(w["s1"], w["s2"], w["s3"], best)], "s1 double, s2 double, s3 double, auc double")


@query("B9_shrunk_weights", "segment:s fold:i s1:f s2:f", """WITH l AS (SELECT segment, day % 3 AS fold, avg(s1) AS a, avg(s2) AS b, count(DISTINCT day) AS n FROM {part3} GROUP BY ALL),
       g AS (SELECT segment, avg(s1) AS ga, avg(s2) AS gb FROM {part3} GROUP BY segment), m AS (SELECT segment, fold, n / (n + 3.0) * a + (1 - n / (n + 3.0)) * ga AS a,
       n / (n + 3.0) * b + (1 - n / (n + 3.0)) * gb AS b FROM l JOIN g USING (segment)) SELECT segment, fold, a / (a + b) AS s1, b / (a + b) AS s2 FROM m""")
def _(t):
    d = t.part3().withColumn("fold", F.col("day") % 3)
    means = [F.avg("s1").alias("s1"), F.avg("s2").alias("s2")]
    local = d.groupBy("segment", "fold").agg(*means, F.count_distinct("day").alias("n"))
    return se.shrink(local, d.groupBy("segment").agg(*means), ["segment"], ["s1", "s2"], "n", 3.0)


WS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
OPTIONS = f"""h AS (SELECT *, {HALF} AS half FROM {{part3}}), a AS (SELECT *, {rank_sql('s1')} AS cur FROM h), b AS (SELECT *, {rank_sql('cur', 'segment')} AS cs, {rank_sql('s2', 'segment')} AS ss FROM a),
       v AS (SELECT segment, cur AS score, row_number() OVER (PARTITION BY segment ORDER BY cur, id) AS k FROM b),
       g AS (SELECT *, row_number() OVER (PARTITION BY segment, o ORDER BY round((1 - o / 5.0) * cs + o / 5.0 * ss, 12), id) AS k FROM b, (SELECT unnest(range(6)) AS o)),
       opt AS (SELECT id, g.segment, o, label, half, score FROM g JOIN v ON g.segment = v.segment AND g.k = v.k),
       cand AS (SELECT x * 36 + y * 6 + z AS candidate, x, y, z FROM range(6) t1(x), range(6) t2(y), range(6) t3(z)),
       rowsc AS (SELECT candidate, label, half, score FROM cand JOIN opt ON (segment = 'strict' AND o = x) OR (segment = 'partial' AND o = y) OR (segment = 'cold' AND o = z)),
       scored AS ({auc_sql(parts_sql('rowsc'), 'score', 'candidate, part')}), base AS ({auc_sql(parts_sql('h'), 's1', 'part')})"""


@query("B10_segment_grid", "candidate:i auc:f gain:f min_half_gain:f", f"""WITH {OPTIONS} SELECT candidate, max(s.auc) FILTER (part = 'all') AS auc, max(s.auc - b.auc) FILTER (part = 'all') AS gain,
       min(s.auc - b.auc) FILTER (part <> 'all') AS min_half_gain FROM scored s JOIN base b USING (part) GROUP BY candidate""")
def _(t):
    d = halved(t)
    _, rows = se.grid_search(se.rank_options(d, "s1", "s2", "segment", "id", WS), "label", "segment", WS, se.base_aucs(d, "label", "s1"))
    return list_frame(t, [(c["choice"][0] * 36 + c["choice"][1] * 6 + c["choice"][2], c["auc"], c["gain"], c["min_half_gain"]) for c in rows],
                      "candidate long, auc double, gain double, min_half_gain double")


POOLED = """p AS (SELECT candidate, label, half, CASE WHEN count(*) OVER e >= 2 THEN 0.7 * x + 0.3 * avg(x) OVER e ELSE x END AS score FROM (
       SELECT w.candidate, label, half, card1, (1 - wt) * s1 + wt * s2 AS x FROM h JOIN w ON w.segment = h.segment) WINDOW e AS (PARTITION BY candidate, card1))"""


@query("B10_pooled_grid", "candidate:i auc:f gain:f min_half_gain:f", f"""WITH h AS (SELECT *, {HALF} AS half FROM {{part3}}), w AS (
       SELECT x * 4 + y * 2 + z AS candidate, unnest(['strict', 'partial', 'cold']) AS segment, unnest([x * 0.5, y * 0.5, z * 0.5]) AS wt FROM range(2) t1(x), range(2) t2(y), range(2) t3(z)),
       {POOLED}, r AS (SELECT candidate, label, half, round(score, 12) AS score FROM p), scored AS ({auc_sql(parts_sql('r'), 'score', 'candidate, part')}), base AS ({auc_sql(parts_sql('h'), 's1', 'part')})
       SELECT candidate, max(s.auc) FILTER (part = 'all') AS auc, max(s.auc - b.auc) FILTER (part = 'all') AS gain, min(s.auc - b.auc) FILTER (part <> 'all') AS min_half_gain
       FROM scored s JOIN base b USING (part) GROUP BY candidate""")
def _(t):
    d = halved(t)

    def blend(rows, keys):
        rows = rows.withColumn("x", (1 - F.col("w")) * F.col("s1") + F.col("w") * F.col("s2"))
        rows = bl.entity_pull(rows, [*keys, "card1"], "x", 0.3, "score", method="mean", size=(2, None))
        return rows.withColumn("score", F.round("score", 12))

    return se.candidate_search(d, "label", "segment", (0.0, 0.5), blend, se.base_aucs(d, "label", "s1"))


TENTHS = tuple(round(i / 10, 2) for i in range(11))


@query("B11_coordinate_search", "variant:s strict:f partial:f cold:f auc:f gain:f")
def _(t):
    d = rk.average_rank(halved(t), "s1", "base")
    base, best = se.base_aucs(d, "label", "base"), []
    for v in ("s2", "s3"):
        options = se.rank_options(d, "base", v, "segment", "id", TENTHS)
        r, _ = se.coordinate_search(options, "label", "segment", TENTHS, base, ((0.0, 0.0, 0.0), (0.2, 0.2, 0.4)))
        best.append((v, *[TENTHS[i] for i in r["choice"]], r["auc"], r["gain"]))
    return list_frame(t, best, "variant string, strict double, partial double, cold double, auc double, gain double")


@query("B11_direct_search", "strict:f partial:f cold:f auc:f gain:f")
def _(t):
    d = bl.entity_pull(halved(t), ["card1"], "s1", 1.0, "signal", method="mean")
    r, _ = se.coordinate_search(se.direct_options(d, "s1", "signal", TENTHS), "label", "segment", TENTHS, se.base_aucs(d, "label", "s1"),
                                ((0.0, 0.0, 0.0), (0.0, 0.0, 0.3), (0.2, 0.2, 0.2), (0.5, 0.5, 0.5)))
    return list_frame(t, [(*[TENTHS[i] for i in r["choice"]], r["auc"], r["gain"])], "strict double, partial double, cold double, auc double, gain double")


@query("B12_two_stage_recipe", "segment:s s1:f s2:f s3:f auc:f gain:f", f"""WITH {SIMPLEX}, c AS (SELECT *, row_number() OVER (ORDER BY w1, w2, w3) - 1 AS i FROM w), h AS (SELECT *, {HALF} AS half FROM {{part3}}),
       l AS (SELECT i, segment, label, half, round(w1 * s1 + w2 * s2 + w3 * s3, 12) AS x FROM c, h), sc AS ({auc_sql(parts_sql('l'), 'x', 'i, segment, part')}),
       o AS (SELECT segment, part, auc FROM sc JOIN c USING (i) WHERE w1 = 1), gs AS (SELECT i, segment, max(sc.auc - o.auc) FILTER (part = 'all') AS gain, min(sc.auc - o.auc) FILTER (part <> 'all') AS worst
         FROM sc JOIN o USING (segment, part) GROUP BY ALL),
       top AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY round(gain, 12) DESC, round(worst, 12) DESC, i) AS r FROM gs WHERE gain IS NOT NULL AND worst >= 0 QUALIFY r <= 4),
       k AS (SELECT x.i AS a, y.i AS b, z.i AS d, x.r AS ra, y.r AS rb, z.r AS rd FROM top x, top y, top z WHERE x.segment = 'strict' AND y.segment = 'partial' AND z.segment = 'cold'),
       rw AS (SELECT a, b, d, label, half, x AS score FROM k JOIN l ON (segment = 'strict' AND i = a) OR (segment = 'partial' AND i = b) OR (segment = 'cold' AND i = d)),
       s2 AS ({auc_sql(parts_sql('rw'), 'score', 'a, b, d, part')}), base AS ({auc_sql(parts_sql('h'), 's1', 'part')}),
       e AS (SELECT a, b, d, max(s2.auc) FILTER (part = 'all') AS auc, max(s2.auc - base.auc) FILTER (part = 'all') AS gain, min(s2.auc - base.auc) FILTER (part <> 'all') AS worst FROM s2 JOIN base USING (part) GROUP BY ALL),
       best AS (SELECT e.* FROM e JOIN k USING (a, b, d) WHERE worst >= 0 ORDER BY round(gain, 12) DESC, round(worst, 12) DESC, ra, rb, rd LIMIT 1)
       SELECT segment, w1 AS s1, w2 AS s2, w3 AS s3, auc, gain FROM (SELECT unnest(['strict', 'partial', 'cold']) AS segment, unnest([a, b, d]) AS i, auc, gain FROM best) JOIN c USING (i)""")
def _(t):
    best, _ = se.two_stage_recipe(halved(t), "label", ["s1", "s2", "s3"], "s1", "segment", 5, 4)
    return list_frame(t, [(g, w["s1"], w["s2"], w["s3"], best["auc"], best["gain"]) for g, w in best["weights"].items()],
                      "segment string, s1 double, s2 double, s3 double, auc double, gain double")


@query("B13_score_variants", "id:i probability:f rank:f pooled_probability:f pooled_rank:f", f"""WITH r AS (SELECT *, {rank_sql('s1')} AS rank FROM {{part3}})
       SELECT id, s1 AS probability, rank, CASE WHEN addr1 IS NOT NULL AND count(*) OVER w BETWEEN 2 AND 6 THEN 0.7 * s1 + 0.3 * max(s1) OVER w ELSE s1 END AS pooled_probability,
       CASE WHEN addr1 IS NOT NULL AND count(*) OVER w BETWEEN 2 AND 6 THEN 0.7 * rank + 0.3 * max(rank) OVER w ELSE rank END AS pooled_rank FROM r WINDOW w AS (PARTITION BY card1, addr1)""")
def _(t):
    return bl.variants(t.part3(), "s1", ["card1", "addr1"], "max", 0.3, (2, 6), F.col("addr1").isNotNull())


@query("B14_source_signals", "id:i x_000:f x_025:f x_100:f x_max:f x_min:f x_geo:f all_score_mean:f all_rank_mean:f all_rank_max:f rank_mean_s1_s3:f",
       f"""SELECT id, s2 AS x_000, 0.25 * s1 + 0.75 * s2 AS x_025, s1 AS x_100, greatest(s1, s2) AS x_max, least(s1, s2) AS x_min, sqrt(s1 * s2) AS x_geo, (s1 + s2 + s3) / 3 AS all_score_mean,
       ({rank_sql('s1')} + {rank_sql('s2')} + {rank_sql('s3')}) / 3 AS all_rank_mean, greatest({rank_sql('s1')}, {rank_sql('s2')}, {rank_sql('s3')}) AS all_rank_max,
       0.5 * ({rank_sql('s1')} + {rank_sql('s3')}) AS rank_mean_s1_s3 FROM {{part3}}""")
def _(t):
    return bl.source_signals(bl.two_source_signals(t.part3(), "s1", "s2", "x"), ["s1", "s2", "s3"])


@query("B15_line_search", "weight:f auc:f", f"""WITH r AS (SELECT label, {rank_sql('s1')} AS a, {rank_sql('s2')} AS b FROM {{part3}}), l AS (
       SELECT i / 20.0 AS weight, label, round((1 - i / 20.0) * a + i / 20.0 * b, 12) AS x FROM r, (SELECT unnest(range(21)) AS i)) {auc_sql('l', 'x', 'weight')}""")
def _(t):
    return se.line_search(t.part3(), "label", "s1", "s2", 21)


@query("B16_pooling_search", "method:s weight:f auc:f gain:f min_half_gain:f", f"""WITH h AS (SELECT *, {HALF} AS half FROM {{part3}}), g AS (SELECT *, count(*) OVER w BETWEEN 2 AND 50 AS ok,
       avg(s1) OVER w AS mean, max(s1) OVER w AS max, quantile_cont(s1, 0.75) OVER w AS q75 FROM h WINDOW w AS (PARTITION BY card1)),
       l AS (SELECT label, half, unnest(['mean', 'max', 'q75']) AS method, s1, CASE WHEN ok THEN unnest([mean, max, q75]) ELSE s1 END AS p FROM g),
       m AS (SELECT label, half, method, w / 10.0 AS weight, round((1 - w / 10.0) * s1 + w / 10.0 * p, 12) AS x FROM l, (SELECT unnest([1, 3, 10]) AS w)),
       scored AS ({auc_sql(parts_sql('m'), 'x', 'method, weight, part')}), base AS ({auc_sql(parts_sql('h'), 's1', 'part')})
       SELECT method, weight, max(s.auc) FILTER (part = 'all') AS auc, max(s.auc - b.auc) FILTER (part = 'all') AS gain, min(s.auc - b.auc) FILTER (part <> 'all') AS min_half_gain
       FROM scored s JOIN base b USING (part) GROUP BY ALL""")
def _(t):
    return se.pooling_search(halved(t), "label", "s1", {"card": (["card1"], F.lit(True), 50)}, ("mean", "max", "q75"), (0.1, 0.3, 1.0))


@query("B17_lock_fallbacks", "segment:s positive:i mean_gain:f fallback:s", "WITH f AS (SELECT *, (day % 4) * 15 + 30 AS horizon FROM {part3}), a AS (" + auc_sql("f", "s1", "segment, horizon")
       + "), b AS (" + auc_sql("f", "s2", "segment, horizon") + """), g AS (SELECT segment, horizon, a.auc - b.auc AS gain FROM a JOIN b USING (segment, horizon))
       SELECT segment, count(*) FILTER (gain > 0) AS positive, avg(gain) AS mean_gain, CASE WHEN count(*) FILTER (gain > 0) < 3 OR avg(gain) <= 0 THEN 'all'
       WHEN COALESCE(max(gain) FILTER (horizon = 75), 0) <= 0 THEN 'unseen' ELSE 'none' END AS fallback FROM g GROUP BY segment""")
def _(t):
    d = t.part3().withColumn("horizon", F.col("day") % 4 * 15 + 30)
    a = rk.auc(d, "label", "s1", ["segment", "horizon"], "a").select("segment", "horizon", "a")
    b = rk.auc(d, "label", "s2", ["segment", "horizon"], "b").select("segment", "horizon", "b")
    return se.fallbacks(a.join(b, ["segment", "horizon"]).withColumn("gain", F.col("a") - F.col("b")), "segment", "horizon", "gain", 3, 75)


FALLBACK = ("WITH f AS (SELECT *, (day % 4) * 15 + 30 AS horizon FROM {part3}), a AS (" + auc_sql("f", "s1", "segment, horizon") + "), b AS (" + auc_sql("f", "s2", "segment, horizon")
            + """), g AS (SELECT segment, horizon, a.auc - b.auc AS gain FROM a JOIN b USING (segment, horizon)),
            d AS (SELECT segment, CASE WHEN count(*) FILTER (gain > 0) < 3 OR avg(gain) <= 0 THEN 'all' WHEN COALESCE(max(gain) FILTER (horizon = 75), 0) <= 0 THEN 'unseen' ELSE 'none' END AS back
              FROM g GROUP BY segment)""")


@query("B17_recipe_after_fallbacks", "horizon:f segment:s s1:f s2:f s3:f", FALLBACK + ", w(horizon, segment, s1, s2, s3) AS (VALUES "
       + ", ".join(f"({h}, '{g}', {m['s1']}, {m['s2']}, {m['s3']})" for h, per in HW.items() for g, m in per.items()) + """),
       e AS (SELECT w.*, COALESCE(back, 'all') = 'all' OR (back = 'unseen' AND horizon = 75) AS gone FROM w LEFT JOIN d USING (segment))
       SELECT horizon, segment, CASE WHEN gone THEN 0 ELSE s1 END AS s1, CASE WHEN gone THEN 1 ELSE s2 END AS s2, CASE WHEN gone THEN 0 ELSE s3 END AS s3 FROM e""")
def _(t):
    """The decisions of the lock folds, carried into the recipe."""
    d = t.part3().withColumn("horizon", F.col("day") % 4 * 15 + 30)
    a, b = (rk.auc(d, "label", s, ["segment", "horizon"], n).select("segment", "horizon", n) for s, n in (("s1", "a"), ("s2", "b")))
    gains = a.join(b, ["segment", "horizon"]).withColumn("gain", F.col("a") - F.col("b"))
    recipe = se.apply_fallbacks(HW, se.fallbacks(gains, "segment", "horizon", "gain", 3, 75), "segment", "s2", 75.0)
    return list_frame(t, [(h, g, *(float(w[s]) for s in ("s1", "s2", "s3"))) for h, per in recipe.items() for g, w in per.items()],
                      "horizon double, segment string, s1 double, s2 double, s3 double")


@query("B18_acceptance", "accepted:i dev:f lock:f", "WITH d AS (SELECT * FROM {part3} WHERE day < 2000), k AS (SELECT * FROM {part3} WHERE day >= 2000), g AS (SELECT "
       + ", ".join(f"(SELECT auc FROM ({auc_sql(s, 's1')})) - (SELECT auc FROM ({auc_sql(s, 's2')})) AS {n}" for s, n in (("d", "dev"), ("k", "lock")))
       + ") SELECT dev > 1e-4 AND lock > 1e-4 AS accepted, dev, lock FROM g")
def _(t):
    gain = {}
    for name, d in (("dev", t.part3().filter("day < 2000")), ("lock", t.part3().filter("day >= 2000"))):
        gain[name] = rk.auc(d, "label", "s1").first()["auc"] - rk.auc(d, "label", "s2").first()["auc"]
    return list_frame(t, [(int(se.accepted(gain["dev"], gain["lock"], 1e-4)), gain["dev"], gain["lock"])], "accepted int, dev double, lock double")


@query("B19_recipe_layer", "id:i p:f", f"""WITH r AS (SELECT *, {rank_sql('s2')} AS k FROM {{part3}}), q AS (SELECT *, CASE WHEN addr1 IS NOT NULL AND count(*) OVER w BETWEEN 2 AND 6
       THEN 0.7 * k + 0.3 * max(k) OVER w ELSE 0.7 * k + 0.3 * k END AS pk FROM r WINDOW w AS (PARTITION BY card1, addr1)), a AS (SELECT *, {rank_sql('s1')} AS cur FROM q),
       b AS (SELECT *, {rank_sql('cur', 'segment')} AS cs, {rank_sql('pk', 'segment')} AS ss FROM a),
       c AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY (1 - {W_SQL}) * cs + {W_SQL} * ss, id) AS k2, row_number() OVER (PARTITION BY segment ORDER BY cur, id) AS j FROM b)
       SELECT c.id, d.cur AS p FROM c JOIN c d ON c.segment = d.segment AND c.k2 = d.j""")
def _(t):
    pool = {"key": ["card1", "addr1"], "method": "max", "weight": 0.3, "size": (2, 6), "valid": F.col("addr1").isNotNull()}
    return bl.layer(t.part3(), "s1", "s2", "pooled_rank", "segment", "id", SEG_W, pool, "p")


@query("J11_weight_grid", "candidate:i rows:i auc:f", f"""WITH l AS (SELECT w AS candidate, label, round((1 - w / 10.0) * s1 + w / 10.0 * s3, 12) AS x
       FROM {{part3}}, (SELECT unnest(range(11)) AS w)) {auc_sql('l', 'x', 'candidate')}""")
def _(t):
    return se.candidate_auc(t.part3(), "label", ["s1", "s3"], [{"s1": 1 - w / 10, "s3": w / 10} for w in range(11)])


# checks -----------------------------------------------------------------------------------------------------
@query("K1_required_columns", "n:i", "SELECT count(*) AS n FROM orders")
def _(t):
    return ck.require_columns(t.read("orders"), ["o_orderkey", "o_custkey"]).agg(F.count(F.lit(1)).alias("n"))


@query("K2_no_label", "n:i", "SELECT count(*) AS n FROM {tx} WHERE split = 'query'")
def _(t):
    return ck.require_no_label(t.query().drop("label"), "label").agg(F.count(F.lit(1)).alias("n"))


@query("K3_output_contract", "rows:i duplicate_ids:i null_scores:i outside_scores:i missing_ids:i extra_ids:i", """WITH s AS (SELECT id, CASE WHEN id % 50 <> 0 THEN s1 * 1.1 END AS p FROM {tx}
       WHERE split = 'query' AND id % 9 <> 0 UNION ALL SELECT id, s1 FROM {tx} WHERE split = 'gap' AND id % 2 = 0), t AS (SELECT id FROM {tx} WHERE split = 'query')
       SELECT count(*) AS rows, count(*) - count(DISTINCT id) AS duplicate_ids, count(*) FILTER (p IS NULL) AS null_scores, count(*) FILTER (p < 0 OR p > 1) AS outside_scores,
       (SELECT count(*) FROM t WHERE id NOT IN (SELECT id FROM s)) AS missing_ids, count(*) FILTER (id NOT IN (SELECT id FROM t)) AS extra_ids FROM s""")
def _(t):
    s = t.query().filter("id % 9 <> 0").select("id", F.when(F.col("id") % 50 != 0, F.col("s1") * 1.1).alias("p"))
    s = s.unionByName(t.tx().filter("split = 'gap' AND id % 2 = 0").select("id", F.col("s1").alias("p")))
    return ck.output_contract(s, t.query().select("id"), "id", "p")


@query("K4_same_ids", "only_left:i only_right:i", "SELECT (SELECT count(*) FROM {tx} WHERE split = 'gap') AS only_left, (SELECT count(*) FROM {tx} WHERE split = 'history' AND id % 3 = 0) AS only_right")
def _(t):
    a = t.tx().filter("NOT (split = 'history' AND id % 3 = 0)")
    return ck.same_ids(a, t.tx().filter("split <> 'gap'"), "id")


@query("K5_day_range", "first_day:i last_day:i outside:i", "SELECT min(day) AS first_day, max(day) AS last_day, count(*) FILTER (day < 1750 OR day >= 2300) AS outside FROM {tx} WHERE split = 'query'")
def _(t):
    return ck.day_range(t.query(), "day", 1750, 2300)


@query("K6_score_difference", "rows:i differ:i max_delta:f", "SELECT count(*) AS rows, count(*) FILTER (s1 <> s2) AS differ, max(abs(s1 - s2)) AS max_delta FROM {tx}")
def _(t):
    return ck.score_difference(t.tx().select("id", F.col("s1").alias("p")), t.tx().select("id", F.col("s2").alias("p")), "id", "p")


@query("K7_metric_reproduced", "auc:f reproduced:i", f"SELECT auc, 1 AS reproduced FROM ({auc_sql('{part3}', 's1')})")
def _(t):
    stored = rk.auc(t.part3(), "label", "s1").first()["auc"]
    return ck.metric_reproduced(rk.auc(t.part3(), "label", "s1"), "auc", stored, 1e-12)


@query("K8_forbidden_inputs", "n:i forbidden:i", "SELECT count(*) AS n, 0 AS forbidden FROM orders")
def _(t):
    bad = ck.forbidden_inputs([t.read("orders")], ["benchmark", "submission"]).agg(F.count(F.lit(1)).alias("forbidden"))
    n = t.read("orders").agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    return attach_bounded(n, bad.withColumn("_one", F.lit(1)), ["_one"])


@query("K8_forbidden_report", "table_name:s pattern:s rows:i", """SELECT 'benchmark.parquet' AS table_name, 'benchmark' AS pattern, count(*) AS rows FROM benchmark
       UNION ALL SELECT 'labels.parquet', '/lab', count(*) FROM labels""")
def _(t):
    """A forbidden table among the inputs is found, with the rows that come from it."""
    d = ck.forbidden_inputs([t.read(n).select("*") for n in ("orders", "benchmark", "labels")], ["benchmark", "submission", "/lab"])
    name = F.regexp_extract("path", "([^/]+[.]parquet)(/[^/]*)?$", 1)
    return d.groupBy(name.alias("table_name"), "pattern").agg(F.sum("rows").alias("rows"))


@query("K7_stored_metrics", "name:s auc:f reproduced:i", f"""SELECT 's1' AS name, auc, 1 AS reproduced FROM ({auc_sql('{tx}', 's1')}) UNION ALL
       SELECT 's2', auc, 0 FROM ({auc_sql('{tx}', 's2')}) UNION ALL SELECT 'gone', NULL, 0 FROM (SELECT count(*) FROM {{tx}})""")
def _(t):
    """Two metrics measured anew against a stored table, in which one is off by a millionth and one belongs to a score that is gone."""
    measured = [rk.auc(t.tx(), "label", s).select(F.lit(s).alias("name"), "auc") for s in ("s1", "s2")]
    measured = measured[0].unionByName(measured[1])
    off = F.when(F.col("name") == "s2", F.col("auc") + 1e-6).otherwise(F.col("auc"))
    stored = measured.withColumn("auc", off)
    stored = save(stored.unionByName(stored.filter("name = 's1'").withColumn("name", F.lit("gone"))))
    return ck.metrics_reproduced(measured, stored, "name", "auc", 1e-9)


# the last run -----------------------------------------------------------------------------------------------
FINAL_W = {150.0: MIX, 300.0: {g: {"s1": 0.1, "s2": 0.6, "s3": 0.3} for g in SEGMENTS}, 450.0: {g: {"s1": 0.5, "s2": 0.0, "s3": 0.5} for g in SEGMENTS},
           600.0: {"strict": {"s1": 1.0, "s2": 0.0, "s3": 0.0}, "partial": {"s1": 0.2, "s2": 0.8, "s3": 0.0}, "cold": {"s1": 0.3, "s2": 0.3, "s3": 0.4}}}
FINAL = ("h AS (SELECT *, (dt - (SELECT max(dt) FROM {tx} WHERE split = 'history')) / 86400.0 AS h FROM {part3}), r AS (SELECT *, "
         + ", ".join(f"{rank_sql(s)} AS r{s}" for s in ("s1", "s2", "s3")) + " FROM h), w AS (SELECT *, " + ", ".join(
             "CASE segment " + " ".join(f"WHEN '{g}' THEN {interpolate_sql(g, s, FINAL_W)}" for g in SEGMENTS) + f" END AS w{s}" for s in ("s1", "s2", "s3"))
         + """ FROM r), m AS (SELECT *, round(CAST((ws1 * rs1 + ws2 * rs2 + ws3 * rs3) / (ws1 + ws2 + ws3) AS DOUBLE), 12) AS mix FROM w),
         p AS (SELECT *, round(CASE WHEN addr1 IS NOT NULL AND count(*) OVER u BETWEEN 2 AND 6 THEN CAST(0.7 AS DOUBLE) * mix + CAST(0.3 AS DOUBLE) * max(mix) OVER u ELSE mix END, 12) AS pulled
           FROM m WINDOW u AS (PARTITION BY card1, addr1)), fin AS (SELECT *, h AS horizon, """ + rank_sql("pulled") + " AS prediction FROM p)")


def finished(t):
    """The folder of a last run."""
    pool = {"key": ["card1", "addr1"], "method": "max", "weight": 0.3, "size": (2, 6), "valid": F.col("addr1").isNotNull()}
    q, folder = t.part3(), f"{shared_dir(t.spark)}/final-{uuid.uuid4().hex}"
    scores = fr.final_scores(q, t.history(), "dt", "segment", ["s1", "s2", "s3"], FINAL_W, pool)
    fr.write_final(scores, q.select("id"), folder, "id", "segment", ["s1", "s2", "s3"])
    return folder


@query("final_run", "id:i segment:s horizon:f prediction:f submitted:f", f"WITH {FINAL} SELECT id, segment, horizon, prediction, prediction AS submitted FROM fin")
def _(t):
    folder = finished(t)
    sent = t.spark.read.schema("id long, submitted double").option("header", True).csv(f"{folder}/predictions")
    return t.spark.read.parquet(f"{folder}/sources").join(sent, "id")


@query("final_report", "segment:s rows:i first_horizon:f last_horizon:f least:f most:f mean:f", f"""WITH {FINAL} SELECT segment, count(*) AS rows, min(horizon) AS first_horizon,
       max(horizon) AS last_horizon, min(prediction) AS least, max(prediction) AS most, avg(prediction) AS mean FROM fin GROUP BY segment""")
def _(t):
    return t.spark.read.schema("segment string, rows long, first_horizon double, last_horizon double, least double, most double, mean double").json(f"{finished(t)}/report")
