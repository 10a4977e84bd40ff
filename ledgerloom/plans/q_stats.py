"""Bindings: joins (J), group statistics (A1-A17), ordered windows (W)."""
from pyspark.sql import functions as F

from ..config import VELOCITY, VELOCITY_SUMS
from ..operators import causal, chains, distribution as di, entity as en, frequency as fq, segments as sg
from ..operators.joins import attach
from ..functions import rowwise as rw, tokens as tk
from .q_rows import OR, cat, itok, tok
from ..operators.timeline import Timeline
from .registry import query

NOGAP = "{tx} WHERE split <> 'gap'"


def f(names, kind="f"):
    return " ".join(f"{n}:{kind}" for n in names.split())


# joins ------------------------------------------------------------------------------------------------------
@query("J1_left_join", "o_orderkey:i c_name:s c_acctbal:f", """SELECT o_orderkey, c_name, c_acctbal FROM orders
       LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def _(t):
    c = t.read("customer").filter("c_acctbal > 0").select("c_custkey", "c_name", "c_acctbal")
    return t.read("orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")


@query("J2_one_to_one", "id:i s1:f s2:f ok:i", "SELECT id, s1, s2, 1 AS ok FROM {tx} WHERE split = 'query'")
def _(t):
    from ..operators.checks import one_to_one
    q = t.query()
    return one_to_one(q.select("id", "s1"), q.select("id", "s2"), ["id"]).withColumn("ok", F.lit(1))


@query("J3_covering_join", "fold:i rows:i uncovered:i fold_mismatch:i", """WITH w AS (SELECT id, day % 3 AS fold, s1 FROM {tx}
       WHERE split = 'query'), v AS (SELECT id, CASE WHEN id % 50 = 0 THEN 9 ELSE fold END AS fold FROM w WHERE id % 20 <> 1)
       SELECT w.fold, count(*) AS rows, count(*) FILTER (v.id IS NULL) AS uncovered,
       count(*) FILTER (v.fold <> w.fold) AS fold_mismatch FROM w LEFT JOIN v ON w.id = v.id GROUP BY w.fold""")
def _(t):
    from ..operators.checks import coverage
    w = t.query().select("id", (F.col("day") % 3).alias("fold"), "s1")
    v = w.filter("id % 20 <> 1").select("id", F.when(F.col("id") % 50 == 0, 9).otherwise(F.col("fold")).alias("fold"))
    return coverage(w, v, "id", "fold")


@query("J4_totals_to_query", "id:i n:i positives:i", """WITH h AS (SELECT card1, count(*) AS n, sum(label) AS positives FROM {tx}
       WHERE split = 'history' GROUP BY card1) SELECT id, COALESCE(n, 0) AS n, COALESCE(positives, 0) AS positives
       FROM {tx} LEFT JOIN h ON tx.card1 = h.card1 WHERE split = 'query'""")
def _(t):
    h = t.history().groupBy("card1").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))
    return attach(t.query(), h, ["card1"]).fillna(0, ["n", "positives"])


@query("J5_seen_before", "id:i seen:i", """SELECT id, d1 IS NOT NULL AND EXISTS (SELECT 1 FROM {tx} h WHERE h.split = 'history'
       AND h.card1 = q.card1 AND h.d1 = q.d1) AS seen FROM {tx} q WHERE split = 'query'""")
def _(t):
    return sg.seen(t.query(), t.history(), ["card1", "d1"], tk.all_present("card1", "d1"), "seen")


@query("J6_repeated_history", "id:i", """SELECT id FROM {tx} WHERE split = 'history' AND d1 IS NOT NULL AND (card1, d1) IN (
       SELECT (card1, d1) FROM {tx} WHERE split = 'history' AND d1 IS NOT NULL GROUP BY card1, d1 HAVING count(*) >= 2)""")
def _(t):
    h = t.history().withColumn("ok", F.col("d1").isNotNull())
    return sg.repeated_rows(h, ["card1", "d1"], "ok")


@query("J7_lookup", "id:i share:f", """WITH h AS (SELECT card2, count(*) / (SELECT count(*) FROM {tx} WHERE split = 'history')
       AS share FROM {tx} WHERE split = 'history' GROUP BY card2)
       SELECT id, COALESCE(share, 0) AS share FROM {tx} LEFT JOIN h ON h.card2 = tx.card2 WHERE split = 'query'""")
def _(t):
    h = t.history()
    table = fq.with_total(h.groupBy("card2").agg(F.count(F.lit(1)).alias("n")), h, "all")
    table = table.select("card2", (F.col("n") / F.col("all")).alias("share"))
    return attach(t.query(), table, ["card2"]).fillna(0.0, ["share"])


# counters whose end meets the next row's start, broken now and then; whole thousandths
CH = """ch0 AS (SELECT id, dt, card1 % 60 AS uid, label, split, CAST(round_even(amt * 100, 0) AS BIGINT) * 10 AS a,
       id % 6 = 0 AS cut, CAST(round_even(COALESCE(amt, 0) * 100, 0) AS BIGINT) * 10 AS a0 FROM {tx}),
     ch1 AS (SELECT *, COALESCE(sum(a0) OVER (PARTITION BY uid, id % 2 ORDER BY dt, id ROWS BETWEEN UNBOUNDED PRECEDING
       AND 1 PRECEDING), 0) + CASE WHEN cut THEN 7 ELSE id % 3 - 1 END AS s FROM ch0),
     ch AS (SELECT *, s + a AS e, row_number() OVER (PARTITION BY uid ORDER BY dt, id) AS k FROM ch1)"""
PARENT = f"""{CH}, pairs AS (SELECT c.id, p.id AS pid, row_number() OVER (PARTITION BY c.id ORDER BY p.k DESC) AS r
     FROM ch c JOIN ch p ON c.uid = p.uid AND p.k < c.k AND p.e BETWEEN c.s - 1 AND c.s + 1 WHERE c.a IS NOT NULL),
     par AS (SELECT ch.id, ch.dt, ch.uid, ch.label, ch.split, ch.a, pid FROM ch LEFT JOIN pairs ON ch.id = pairs.id AND r = 1)"""
CHAIN = PARENT + """,
     walk AS (SELECT id, id AS chain FROM par WHERE pid IS NULL UNION ALL
              SELECT par.id, walk.chain FROM par JOIN walk ON par.pid = walk.id),
     chain AS (SELECT par.*, walk.chain FROM par JOIN walk USING (id))"""


def counters(t):
    d = t.tx().select("id", "dt", (F.col("card1") % 60).alias("uid"), "label", "split",
                      (F.rint(F.col("amt") * 100).cast("long") * 10).alias("a"))
    tl = Timeline(d.withColumn("_odd", F.col("id") % 2), ["uid", "_odd"], ["dt", "id"])
    d = tl.settle(tl.prefix({"_total": F.coalesce("a", F.lit(0))}))
    d = d.withColumn("s", F.col("_total") + F.when(F.col("id") % 6 == 0, 7).otherwise(F.col("id") % 3 - 1))
    return d.withColumn("e", F.col("s") + F.col("a")).drop("_odd", "_total")


@query("J8_band_self_join", "id:i pid:i", f"WITH {PARENT} SELECT id, pid FROM par")
def _(t):
    return chains.parents(counters(t), "uid", "dt", "id", "s", "e", "pid")


@query("J9_as_of", "id:i last_at:i", """SELECT id, max(CASE WHEN label = 1 THEN dt END) OVER (PARTITION BY addr1 ORDER BY dt
       RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_at FROM {tx}""")
def _(t):
    from ..operators.timeline import earlier
    return earlier(t.tx(), ["addr1"], "dt", "id", {}, {"last_at": F.when(F.col("label") == 1, F.col("dt"))})


@query("J10_adjacent_row", "id:i previous_id:i gap:i", """SELECT id, lag(id) OVER w AS previous_id, dt - lag(dt) OVER w AS gap
       FROM {tx} WINDOW w AS (PARTITION BY card1, addr1 ORDER BY dt, id)""")
def _(t):
    from ..operators.timeline import Timeline
    tl = Timeline(t.tx().select("id", "dt", "card1", "addr1"), ["card1", "addr1"], ["dt", "id"])
    d = tl.with_neighbours(1, 0)
    return tl.settle(d.withColumns({"previous_id": F.lag("id").over(tl.window), "gap": F.col("dt") - F.lag("dt").over(tl.window)}))


@query("J12_attach_by_id", "id:i log1p:f same_amount_fraction:f", """SELECT id, ln(1 + amt) AS log1p,
       count(*) OVER (PARTITION BY amt) / count(*) OVER () AS same_amount_fraction FROM {tx}""")
def _(t):
    one = rw.amount_shape(t.tx(), "amt").select("id", "log1p")
    two = fq.frequency(t.tx().select("id", "amt"), t.tx(), ["amt"]).select("id", F.col("amt_freq").alias("same_amount_fraction"))
    return attach(one, two, ["id"])


# frequencies and group values -------------------------------------------------------------------------------
@query("A1_history_frequency", "id:i card2_freq:f addr1_freq:f email_freq:f",
       "WITH h AS (SELECT * FROM {tx} WHERE split = 'history'), n AS (SELECT count(*) AS n FROM h)"
       + "".join(f", {c}_t AS (SELECT {tok(c)} AS v, count(*) / (SELECT n FROM n) AS q FROM h GROUP BY 1)" for c in ("card2", "addr1", "email"))
       + " SELECT id, " + ", ".join(f"COALESCE({c}_t.q, 0) AS {c}_freq" for c in ("card2", "addr1", "email")) + " FROM {tx}"
       + "".join(f" LEFT JOIN {c}_t ON {c}_t.v = {tok('tx.' + c)}" for c in ("card2", "addr1", "email")) + " WHERE split = 'query'")
def _(t):
    return fq.frequency(t.query(), t.history(), ["card2", "addr1", "email"])


@query("A2_joint_frequency", "id:i card2_freq:f email_freq:f", """SELECT id, count(*) OVER (PARTITION BY card2) / count(*) OVER ()
       AS card2_freq, count(*) OVER (PARTITION BY email) / count(*) OVER () AS email_freq FROM """ + NOGAP)
def _(t):
    h, q = (d.withColumn("same", F.lit(1)) for d in (t.history(), t.query()))
    d = fq.frequency_by_mode(h, q, ["card2", "email", "same"], "all-joint")
    assert "same_freq" not in d.columns
    return d


@query("A3_normalized_frequency", "id:i addr1_fe:f email_fe:f", """SELECT id, CASE WHEN addr1 IS NULL THEN -1 ELSE
       count(*) OVER (PARTITION BY addr1) / count(addr1) OVER () END AS addr1_fe, CASE WHEN email IS NULL THEN -1 ELSE
       count(*) OVER (PARTITION BY email) / count(email) OVER () END AS email_fe FROM {tx}""")
def _(t):
    return fq.normalized_frequency(t.tx(), ["addr1", "email"])


@query("A4_value_aggregates", "id:i d1_card2_mean:f d1_card2_std:f amt_addr1_mean:f", """WITH w AS (SELECT *, COALESCE(d1, -1) AS x,
       COALESCE(amt, -1) AS y FROM {tx}) SELECT id, COALESCE(avg(nullif(x, -1)) OVER (PARTITION BY card2), -1) AS d1_card2_mean,
       COALESCE(stddev_samp(nullif(x, -1)) OVER (PARTITION BY card2), -1) AS d1_card2_std,
       COALESCE(avg(nullif(y, -1)) OVER (PARTITION BY addr1), -1) AS amt_addr1_mean FROM w""")
def _(t):
    d = t.tx().fillna(-1.0, ["d1", "amt"])
    return fq.value_aggregates(fq.value_aggregates(d, ["d1"], ["card2"]), ["amt"], ["addr1"])


@query("A5_distinct_counts", "id:i card1_d1_ct:i addr1_email_ct:i", """SELECT id, count(DISTINCT d1) OVER (PARTITION BY card1) AS card1_d1_ct,
       count(DISTINCT email) OVER (PARTITION BY addr1) AS addr1_email_ct FROM {tx}""")
def _(t):
    return fq.distinct_counts(fq.distinct_counts(t.tx(), ["d1"], ["card1"]), ["email"], ["addr1"])


@query("A6_amount_groups", "id:i " + f("g_log_count g_mean g_std g_median g_diff_mean g_zscore g_same_amount_fraction"),
       """SELECT id, ln(1 + count(*) OVER w) AS g_log_count, avg(amt) OVER w AS g_mean, stddev_samp(amt) OVER w AS g_std,
       median(amt) OVER w AS g_median, amt - avg(amt) OVER w AS g_diff_mean,
       (amt - avg(amt) OVER w) / nullif(stddev_samp(amt) OVER w, 0) AS g_zscore,
       count(*) OVER (PARTITION BY card1, addr1, round_even(amt * 100, 0)) / count(*) OVER w AS g_same_amount_fraction
       FROM {tx} WINDOW w AS (PARTITION BY card1, addr1)""")
def _(t):
    return en.amount_groups(t.tx(), ["card1", "addr1"], "amt", "g")


SEQ = {"count": "i", "order": "i", "order_from_end": "i", "previous_dt": "f", "next_dt": "f", "mean_dt": "f", "std_dt": "f",
       "median_dt": "f", "time_span": "f", "mean_amt": "f", "std_amt": "f", "median_amt": "f", "previous_amt": "f",
       "next_amt": "f", "amt_to_mean": "f", "amt_zscore": "f"}
MORE = {"order_fraction": "f", "since_first": "f", "to_last": "f", "min_amt": "f", "max_amt": "f", "has_previous": "i", "has_next": "i"}


def seq_sql(p, key, source="{tx}", extra="", amt="amt", keep="id"):
    return f"""SELECT *, ({amt} - {p}_mean_amt) / nullif({p}_std_amt, 0) AS {p}_amt_zscore, {amt} / nullif({p}_mean_amt, 0) AS {p}_amt_to_mean,
      {p}_count - {p}_order - 1 AS {p}_order_from_end, {p}_order / nullif({p}_count - 1, 0) AS {p}_order_fraction,
      {p}_order > 0 AS {p}_has_previous, {p}_order < {p}_count - 1 AS {p}_has_next FROM (
      SELECT *, avg({p}_previous_dt) OVER e AS {p}_mean_dt, stddev_samp({p}_previous_dt) OVER e AS {p}_std_dt, median({p}_previous_dt) OVER e AS {p}_median_dt
      FROM (SELECT *, count(*) OVER e AS {p}_count, row_number() OVER w - 1 AS {p}_order, dt - lag(dt) OVER w AS {p}_previous_dt,
        lead(dt) OVER w - dt AS {p}_next_dt, max(dt) OVER e - min(dt) OVER e AS {p}_time_span, dt - min(dt) OVER e AS {p}_since_first,
        max(dt) OVER e - dt AS {p}_to_last, avg({amt}) OVER e AS {p}_mean_amt, stddev_samp({amt}) OVER e AS {p}_std_amt,
        median({amt}) OVER e AS {p}_median_amt, min({amt}) OVER e AS {p}_min_amt, max({amt}) OVER e AS {p}_max_amt,
        lag({amt}) OVER w AS {p}_previous_amt, lead({amt}) OVER w AS {p}_next_amt{extra}
        FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY dt, id), e AS (PARTITION BY {key}))
      WINDOW e AS (PARTITION BY {key}))"""


def spec(p, cols):
    return "id:i " + " ".join(f"{p}_{c}:{k}" for c, k in cols.items())


@query("A7_entity_profile", spec("user", SEQ | MORE | {"same_amount_count": "i", "same_amount_fraction": "f", "active_days": "i",
       "is_multirow": "i", "product_nunique": "i", "product_same_fraction": "f", "email_nunique": "i", "email_same_fraction": "f",
       "d1_mean": "f", "d1_std": "f", "c13_mean": "f", "c13_std": "f", "c13_min": "f", "c13_max": "f"}),
       seq_sql("user", "card1", extra=""", count(*) OVER (PARTITION BY card1, amt) AS user_same_amount_count,
         count(*) OVER (PARTITION BY card1, amt) / count(*) OVER e AS user_same_amount_fraction,
         count(DISTINCT dt // 86400) OVER e AS user_active_days, count(*) OVER e > 1 AS user_is_multirow,
         count(DISTINCT product) OVER e AS user_product_nunique, count(*) OVER (PARTITION BY card1, product) / count(*) OVER e AS user_product_same_fraction,
         count(DISTINCT email) OVER e AS user_email_nunique, count(*) OVER (PARTITION BY card1, email) / count(*) OVER e AS user_email_same_fraction,
         avg(d1) OVER e AS user_d1_mean, stddev_samp(d1) OVER e AS user_d1_std, avg(c13) OVER e AS user_c13_mean,
         stddev_samp(c13) OVER e AS user_c13_std, min(c13) OVER e AS user_c13_min, max(c13) OVER e AS user_c13_max"""))
def _(t):
    return en.profile(t.tx(), ["card1"], "dt", "id", "amt", ["product", "email"], ["d1", "c13"], ["c13"])


WIDE = [f"wide_{c}_{n}" for c in ("v1", "v2") for n in ("mean", "std", "range", "nunique_rate", "diff_mean", "zscore")] + [
    f"wide_v3_{n}" for n in ("mean", "std", "zscore")]


@query("A8_wide_profile", "okey:i pkey:i " + " ".join(f"{c}:f" for c in WIDE), "SELECT okey, pkey, " + ", ".join(
       f"""avg({c}) OVER w AS wide_{c}_mean, stddev_samp({c}) OVER w AS wide_{c}_std, max({c}) OVER w - min({c}) OVER w AS wide_{c}_range,
       count(DISTINCT {c}) OVER w / count(*) OVER w AS wide_{c}_nunique_rate, {c} - avg({c}) OVER w AS wide_{c}_diff_mean,
       ({c} - avg({c}) OVER w) / nullif(stddev_samp({c}) OVER w, 0) AS wide_{c}_zscore""" for c in ("v1", "v2", "v3"))
       + " FROM {li} WINDOW w AS (PARTITION BY skey)")
def _(t):
    return en.wide_profile(t.li(), ["skey"], ["v1", "v2"], ["v3"])


@query("A9_rate_profile", "okey:i pkey:i r:f wide_r_mean:f wide_r_diff:f", """SELECT okey, pkey, r, avg(r) OVER w AS wide_r_mean,
       r - avg(r) OVER w AS wide_r_diff FROM (SELECT *, ((v1 IS NULL)::INT + (v2 IS NULL)::INT + (v3 IS NULL)::INT
       + (v4 IS NULL)::INT) / 4.0 AS r FROM {li}) WINDOW w AS (PARTITION BY skey)""")
def _(t):
    d = rw.missing_count(t.li(), ["v1", "v2", "v3", "v4"], "m").withColumn("r", F.col("m") / 4)
    return en.rate_profile(d, ["skey"], ["r"])


@query("A10_mean_view", "okey:i pkey:i wide_v1_mean:f wide_v2_mean:f", """SELECT okey, pkey, avg(v1) OVER w AS wide_v1_mean,
       avg(v2) OVER w AS wide_v2_mean FROM {li} WINDOW w AS (PARTITION BY skey)""")
def _(t):
    from ..operators.encode import columns_like
    d = en.wide_profile(t.li(), ["skey"], ["v1", "v2"], ["v3"])
    return d.select("okey", "pkey", *columns_like(d.columns, r"wide_v[12]_mean"))


DIST = "nunique:i share:f surprise:f mode_share:f is_mode:i entropy:f normalized_entropy:f".split()


@query("A11_value_distribution", "id:i " + " ".join("b_" + c for c in DIST), """WITH p AS (SELECT card1, card4, count(*) AS c FROM {tx} GROUP BY ALL),
       q AS (SELECT *, sum(c) OVER w AS n, count(*) OVER w AS u, max(c) OVER w AS m FROM p WINDOW w AS (PARTITION BY card1)),
       h AS (SELECT card1, sum(-(c / n) * ln(c / n)) AS h FROM q GROUP BY card1)
       SELECT id, u AS b_nunique, c / n AS b_share, -ln(c / n) AS b_surprise, m / n AS b_mode_share, c = m AS b_is_mode, h AS b_entropy,
       h / ln(greatest(u, 2)) AS b_normalized_entropy FROM {tx} JOIN q USING (card1, card4) JOIN h USING (card1)""")
def _(t):
    return di.value_distribution(t.tx(), ["card1"], "card4", "b")


@query("A12_cooccurrence", "id:i c_log_pairs:f c_given_first:f c_given_second:f c_first_nunique:i c_second_nunique:i",
       f"""SELECT id, ln(1 + count(*) OVER (PARTITION BY card2, email)) AS c_log_pairs,
       count(*) OVER (PARTITION BY card2, email) / count(*) OVER (PARTITION BY card2) AS c_given_first,
       count(*) OVER (PARTITION BY card2, email) / count(*) OVER (PARTITION BY email) AS c_given_second,
       count(DISTINCT {tok('email')}) OVER (PARTITION BY card2) AS c_first_nunique, count(DISTINCT card2) OVER (PARTITION BY email)
       AS c_second_nunique FROM {{tx}}""")
def _(t):
    return di.cooccurrence(t.tx(), "card2", "email", "c")


HIST = {"rows": "i", "positives": "i", "negatives": "i", "rate": "f", "any": "i", "since_positive": "i"}


def history_sql(p, key, source, smooth):
    past = "OVER (PARTITION BY {k} ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)".replace("{k}", key)
    rates = ", ".join(f"(y + {s} * (SELECT avg(label) FROM h)) / (n + {s}) AS {p}_rate_smoothed_{s}" for s in smooth)
    return f"""h AS (SELECT * FROM {source} WHERE split = 'history'),
      tot AS (SELECT {key}, count(*) AS n, sum(label) AS y, max(CASE WHEN label = 1 THEN dt END) AS last_at FROM h GROUP BY {key}),
      k AS (SELECT id, 'history' AS side, dt, count(*) {past} AS n, COALESCE(sum(label) {past}, 0) AS y,
        max(CASE WHEN label = 1 THEN dt END) {past} AS last_at FROM h
        UNION ALL SELECT id, 'query', dt, COALESCE(n, 0), COALESCE(y, 0), last_at FROM {source} q LEFT JOIN tot ON q.{key} IS NOT DISTINCT FROM tot.{key}
        WHERE split = 'query')
      SELECT id, side, n AS {p}_rows, y AS {p}_positives, n - y AS {p}_negatives, y / nullif(n, 0) AS {p}_rate, y > 0 AS {p}_any,
        dt - last_at AS {p}_since_positive, {rates} FROM k"""


@query("A13_label_history", "id:i side:s " + " ".join(f"known_{c}:{k}" for c, k in HIST.items()) + " known_rate_smoothed_20:f",
       "WITH " + history_sql("known", "addr1", "{tx}", [20]))
def _(t):
    return causal.label_history(t.history(), t.query(), ["addr1"], "dt", "id", "label")


@query("A14_chain_label_history", "id:i side:s " + " ".join(f"chain_{c}:{k}" for c, k in HIST.items())
       + " chain_rate_smoothed_5:f chain_rate_smoothed_20:f", f"WITH {CHAIN}, " + history_sql("chain", "chain", "chain", [5, 20]))
def _(t):
    d = chains.counter_chains(counters(t), "uid", "dt", "id", "s", "e", "chain")
    return causal.label_history(d.filter("split = 'history'"), d.filter("split = 'query'"), ["chain"], "dt", "id", "label",
                                (5.0, 20.0), "chain")


GROUPS = {"strict": (("card1", "addr1", "origin", "clean_email"), 500), "card": (("card1", "addr1"), 500),
          "mail": (("origin", "clean_email"), 150)}
MEM_SPEC = " ".join(f"{g}_valid:i {g}_seen:i {g}_history_count:f {g}_query_count:f" for g in GROUPS) + \
    " segment_strict:i segment_partial:i segment_cold:i seen_keys:i"


def membership_sql(h, q):
    parts, joins = [], []
    for g, (keys, _) in GROUPS.items():
        ok = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        on = " AND ".join(f"{g}_c.{k} = q.{k}" for k in keys)
        parts.append(f"({' AND '.join(f'q.{k} IS NOT NULL' for k in keys)})::INT AS {g}_valid, (COALESCE({g}_c.h, 0) > 0)::INT AS {g}_seen, "
                     f"ln(1 + COALESCE({g}_c.h, 0)) AS {g}_history_count, ln(1 + COALESCE({g}_c.q, 0)) AS {g}_query_count")
        joins.append(f"LEFT JOIN (SELECT {', '.join(keys)}, count(*) FILTER (s = 'h') AS h, count(*) FILTER (s = 'q') AS q FROM "
                     f"(SELECT 'h' AS s, * FROM {h} UNION ALL SELECT 'q', * FROM {q}) WHERE {ok} GROUP BY ALL) {g}_c ON {on}")
    return f"""SELECT *, (strict_seen = 1)::INT AS segment_strict, (strict_seen = 0 AND greatest(card_seen, mail_seen) = 1)::INT AS segment_partial,
      (greatest(strict_seen, card_seen, mail_seen) = 0)::INT AS segment_cold, strict_seen + card_seen + mail_seen AS seen_keys FROM (
      SELECT q.id, q.day, {', '.join(parts)} FROM {q} q {' '.join(joins)})"""


CLIENT = f"""cl AS (SELECT *, {OR['round']} AS origin, CASE WHEN lower(email) IN ('mail.com', 'anonymous.com', '<missing>') THEN NULL
       ELSE lower(email) END AS clean_email FROM {{tx}}), h AS (SELECT * FROM cl WHERE split = 'history'),
       q AS (SELECT * FROM cl WHERE split = 'query')"""


@query("A15_membership", "id:i " + MEM_SPEC, f"WITH {CLIENT} {membership_sql('h', 'q')}")
def _(t):
    d = sg.with_client_keys(t.tx(), "dt", "d1", "email")
    return sg.membership(d.filter("split = 'query'"), d.filter("split = 'history'"), GROUPS)


MFOLDS = ((600, 800, 1000), (1000, 1200, 1400), (1400, 1600, None))


@query("A16_fold_membership", "fold:i id:i " + MEM_SPEC, f"WITH {CLIENT.split(', h AS')[0]}, " + ", ".join(
       f"h{n} AS (SELECT * FROM cl WHERE day < {a}), q{n} AS (SELECT * FROM cl WHERE day >= {b} AND day < {c or 99999})"
       for n, (a, b, c) in enumerate(MFOLDS)) + " " + " UNION ALL ".join(
       f"SELECT {n} AS fold, * FROM ({membership_sql(f'h{n}', f'q{n}')})" for n in range(3)))
def _(t):
    return sg.fold_membership(sg.with_client_keys(t.tx(), "dt", "d1", "email"), "day", MFOLDS, GROUPS)


PROF = [f"mean_{c}" for c in ("amt", "d1", "d3", "c13")] + [f"{n}_{c}" for n in ("std", "min", "max", "first", "last") for c in ("amt", "d1")]


@query("A17_client_profile", "card1:i " + " ".join(f"{c}:f" for c in PROF) + " client_count:i client_log_count:f client_day_span:f client_day_std:f client_per_day:f",
       "SELECT card1, " + ", ".join(f"avg({c}) AS mean_{c}" for c in ("amt", "d1", "d3", "c13")) + ", " + ", ".join(
       f"stddev_samp({c}) AS std_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}, first({c} ORDER BY dt, id) FILTER ({c} IS NOT NULL) AS first_{c}, "
       f"last({c} ORDER BY dt, id) FILTER ({c} IS NOT NULL) AS last_{c}" for c in ("amt", "d1")) + """, count(*) AS client_count,
       ln(1 + count(*)) AS client_log_count, max(day) - min(day) AS client_day_span, stddev_samp(day) AS client_day_std,
       count(*) / (max(day) - min(day) + 1) AS client_per_day FROM {tx} WHERE split = 'history' GROUP BY card1""")
def _(t):
    return en.client_profile(t.history(), ["card1"], "dt", "id", "day", ["amt", "d1", "d3", "c13"], ["amt", "d1"])


# ordered windows --------------------------------------------------------------------------------------------
def seq(t, key="card1", p="s"):
    return en.sequence(t.tx(), [key], "dt", "id", "amt", p)


@query("W1_positions", spec("s", {k: SEQ.get(k) or MORE[k] for k in ("count", "order", "order_from_end", "order_fraction")}), seq_sql("s", "card1"))
def _(t):
    return seq(t)


@query("W2_gaps_and_span", spec("s", {k: SEQ.get(k) or MORE[k] for k in ("previous_dt", "next_dt", "since_first", "to_last", "time_span")}), seq_sql("s", "addr1"))
def _(t):
    return seq(t, "addr1")


@query("W3_gap_statistics", spec("s", {k: SEQ[k] for k in ("mean_dt", "std_dt", "median_dt")}), seq_sql("s", "card2"))
def _(t):
    return seq(t, "card2")


@query("W4_amount_statistics", spec("s", {k: SEQ[k] for k in ("mean_amt", "std_amt", "median_amt", "previous_amt", "next_amt", "amt_to_mean", "amt_zscore")}), seq_sql("s", "card1"))
def _(t):
    return seq(t)


UID = cat(itok(OR["floor_day"]), tok("email"))
UID2 = cat(tok("card1"), tok("addr1"), itok(OR["floor_day"]), tok("email"))


@query("W5_two_uid_sequences", "id:i " + " ".join(f"{p}_{c}:{k}" for p in ("a", "b") for c, k in SEQ.items()),
       f"WITH u AS (SELECT *, {UID} AS ua, {UID2} AS ub FROM {{tx}}), a AS ({seq_sql('a', 'ua', 'u')}), b AS ({seq_sql('b', 'ub', 'u')}) "
       "SELECT a.id, " + ", ".join(f"{p}_{c}" for p in ("a", "b") for c in SEQ) + " FROM a JOIN b ON a.id = b.id")
def _(t):
    i = tk.integer_token(tk.origin_day("dt", "d1", "floor_day"))
    d = t.tx().withColumns({"ua": tk.compose(i, "email"), "ub": tk.compose("card1", "addr1", i, "email")})
    return en.sequence(en.sequence(d, ["ua"], "dt", "id", "amt", "a"), ["ub"], "dt", "id", "amt", "b")


def delta_sql(p, counters_, source, key):
    steps = "".join(f", {c} - lag({c}) OVER w AS {p}_{c}_previous_delta, lead({c}) OVER w - {c} AS {p}_{c}_next_delta, "
                    f"{c} - lag({c}) OVER w - lag(amt) OVER w AS {p}_{c}_previous_error, lead({c}) OVER w - {c} - amt AS {p}_{c}_next_error" for c in counters_)
    flags = ", ".join(f"COALESCE(abs({p}_{c}_{s}_error) <= 0.011, false)::INT AS {p}_{c}_{s}_match, COALESCE(abs({p}_{c}_{s}_delta) <= 0.011, false)::INT AS {p}_{c}_{s}_same"
                      for c in counters_ for s in ("previous", "next"))
    totals = ", ".join(" + ".join(f"{p}_{c}_{s}_{k}" for c in counters_) + f" AS {p}_{s}_{'matches' if k == 'match' else 'unchanged'}"
                       for s in ("previous", "next") for k in ("match", "same"))
    return f"SELECT *, {totals} FROM (SELECT *, {flags} FROM (SELECT *{steps} FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY dt, id)))"


def delta_spec(p, counters_):
    return "id:i " + " ".join(f"{p}_{c}_{s}_delta:f {p}_{c}_{s}_error:f {p}_{c}_{s}_match:i {p}_{c}_{s}_same:i" for c in counters_ for s in ("previous", "next"))


MC = f"{CH}, mc AS (SELECT id, dt, uid, a / 1000 AS amt, s / 1000 AS k1, floor(s / 3000) * 3 AS k2, CASE WHEN id % 9 <> 0 THEN s / 1000 + 5 END AS k3 FROM ch)"


def multi(t):
    return counters(t).select("id", "dt", "uid", (F.col("a") / 1000).alias("amt"), (F.col("s") / 1000).alias("k1"),
                              (F.floor(F.col("s") / 3000) * 3).alias("k2"),
                              F.when(F.col("id") % 9 != 0, F.col("s") / 1000 + 5).alias("k3"))


@query("W6_counter_steps", delta_spec("c", ["k1"]), f"WITH {MC} " + delta_sql("c", ["k1"], "mc", "uid"))
def _(t):
    return en.sequence(multi(t), ["uid"], "dt", "id", "amt", "c", ["k1"])


@query("W7_multi_counter_steps", delta_spec("c", ["k1", "k2", "k3"]) + " c_previous_matches:i c_next_matches:i c_previous_unchanged:i c_next_unchanged:i",
       f"WITH {MC} " + delta_sql("c", ["k1", "k2", "k3"], "mc", "uid"))
def _(t):
    return en.sequence(multi(t), ["uid"], "dt", "id", "amt", "c", ["k1", "k2", "k3"])


ACT = """WITH g AS (SELECT *, dt - lag(dt) OVER w AS gap, c13 - lag(c13) OVER w AS step, COALESCE((dt // 86400 <> lag(dt // 86400) OVER w)::INT, 1) AS fresh
       FROM {tx} WINDOW w AS (PARTITION BY card2 ORDER BY dt, id)),
       k AS (SELECT *, sum(fresh) OVER w AS adv_active_days, row_number() OVER w - 1 AS adv_prior_count, count(*) OVER (PARTITION BY card2) AS adv_total_count, """ + ", ".join(
       f"avg(gap) OVER (w ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS adv_gap_mean_{k}, stddev_samp(gap) OVER (w ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS adv_gap_std_{k}"
       for k in (2, 3, 4, 5, 10, 20)) + """ FROM g WINDOW w AS (PARTITION BY card2 ORDER BY dt, id))
       SELECT *, (adv_prior_count + 1) / adv_active_days AS adv_rows_per_day, step AS adv_counter_step, d3 - gap / 86400 AS adv_gap_error,
       COALESCE(abs(d3 - gap / 86400) <= 1.5, false) AS adv_gap_match FROM k"""


def act(t):
    return causal.activity(t.tx(), ["card2"], "dt", "id", "c13", "d3")


@query("W8_activity_so_far", "id:i adv_total_count:i adv_prior_count:i adv_active_days:i adv_rows_per_day:f", ACT)
def _(t):
    return act(t)


@query("W9_rolling_gaps", "id:i " + " ".join(f"adv_gap_{s}_{k}:f" for k in (2, 3, 4, 5, 10, 20) for s in ("mean", "std")), ACT)
def _(t):
    return act(t)


@query("W10_stated_gap", "id:i adv_counter_step:f adv_gap_error:f adv_gap_match:i", ACT)
def _(t):
    return act(t)


MEMORY = f"""WITH m AS (SELECT *, {tok('email')} AS v FROM {{tx}}), k AS (SELECT *, row_number() OVER p - 1 AS n, dt - lag(dt) OVER p AS since,
       lag(v) OVER e AS was, row_number() OVER e - 1 AS o FROM m WINDOW p AS (PARTITION BY card1, v ORDER BY dt, id), e AS (PARTITION BY card1 ORDER BY dt, id)),
       z AS (SELECT *, COALESCE(max(n + 1) OVER (PARTITION BY card1 ORDER BY dt, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mode FROM k)
       SELECT id, n AS m_prior_count, n / nullif(o, 0) AS m_prior_fraction, n > 0 AS m_seen_before, since AS m_since_same,
       COALESCE(since BETWEEN 0 AND 2592000, false) AS m_seen_recently, was IS NOT NULL AND was <> v AS m_changed, n >= mode AND o > 0 AS m_is_prior_mode FROM z"""


@query("W11_value_memory", "id:i m_prior_count:i m_prior_fraction:f m_seen_before:i m_since_same:i m_seen_recently:i m_changed:i", MEMORY)
def _(t):
    return causal.value_memory(t.tx(), ["card1"], "dt", "id", "email", "m")


@query("W12_running_mode", "id:i m_is_prior_mode:i", MEMORY)
def _(t):
    return causal.value_memory(t.tx(), ["card1"], "dt", "id", "email", "m")


def velocity_sql(key, source, amt="amt", p="velocity"):
    past = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    cols = [f"count(*) OVER (w {past}) AS {p}_prior_count", f"dt - max(dt) OVER (w {past}) AS {p}_since_previous", f"dt - min(dt) OVER (w {past}) AS {p}_since_first",
            f"avg({amt}) OVER (w {past}) AS {p}_prior_mean", f"stddev_pop({amt}) OVER (w {past}) AS {p}_prior_std",
            f"{amt} - (max(row(dt, id, {amt})) OVER (w {past}))[3] AS {p}_diff_previous"]
    cols += [f"count(*) OVER (w RANGE BETWEEN {s} PRECEDING AND 1 PRECEDING) AS {p}_count_{n}" for n, s in VELOCITY.items()]
    for n in VELOCITY_SUMS:
        r = f"(w RANGE BETWEEN {VELOCITY[n]} PRECEDING AND 1 PRECEDING)"
        cols += [f"COALESCE(sum({amt}) OVER {r}, 0) AS {p}_sum_{n}", f"avg({amt}) OVER {r} AS {p}_mean_{n}"]
    return (f"SELECT *, CASE WHEN {p}_prior_std > 1e-9 THEN ({amt} - {p}_prior_mean) / {p}_prior_std END AS {p}_zscore FROM (SELECT id, {amt}, {key}, {', '.join(cols)} "
            f"FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY dt))")


VEL = {"prior_count": "i", "since_previous": "i", "since_first": "i", "prior_mean": "f", "prior_std": "f", "zscore": "f", "diff_previous": "f"} | {
    f"count_{w}": "i" for w in VELOCITY} | {f"{s}_{w}": "f" for w in VELOCITY_SUMS for s in ("sum", "mean")}


@query("W13_velocity", spec("velocity", VEL), velocity_sql("usr", "{ev}"))
def _(t):
    return causal.velocity(t.ev(), ["usr"], "dt", "id", "amt")


@query("W13_velocity_ties", spec("velocity", VEL), velocity_sql("addr1", "{tx}"))
def _(t):
    return causal.velocity(t.tx(), ["addr1"], "dt", "id", "amt")


CHAIN_SHAPE = {k: (SEQ | MORE)[k] for k in ("count", "order", "order_from_end", "previous_dt", "next_dt", "time_span", "previous_amt", "next_amt", "has_previous", "has_next")}


@query("W14_chain_shape", "chain:i " + spec("c", CHAIN_SHAPE), f"WITH {CHAIN}, shape AS ({seq_sql('c', 'chain', 'chain', amt='a')}) SELECT * FROM shape")
def _(t):
    d = chains.counter_chains(counters(t), "uid", "dt", "id", "s", "e", "chain")
    return en.sequence(d, ["chain"], "dt", "id", "a", "c")


@query("W16_derived_uid_frequency", "id:i u_freq:f", f"""WITH u AS (SELECT *, {cat(tok('card1'), tok('addr1'), itok(OR['round']), tok('product'))} AS u FROM {{tx}}),
       n AS (SELECT u, count(*) / (SELECT count(*) FROM u WHERE split = 'history') AS q FROM u WHERE split = 'history' GROUP BY u)
       SELECT id, COALESCE(q, 0) AS u_freq FROM u LEFT JOIN n USING (u)""")
def _(t):
    d = t.tx().withColumn("u", tk.compose("card1", "addr1", tk.integer_token(tk.origin_day("dt", "d1", "round")), "product"))
    return fq.frequency(d, d.filter("split = 'history'"), ["u"])


@query("segment_velocity", "segment:s n:i mean_count_30d:f mean_prior:f", f"""WITH k AS (SELECT *, {cat(tok('card1'), tok('addr1'))} AS uid FROM {{tx}}),
       v AS ({velocity_sql('uid', 'k')}), h AS (SELECT DISTINCT uid FROM k WHERE split = 'history' AND addr1 IS NOT NULL)
       SELECT CASE WHEN h.uid IS NOT NULL AND addr1 IS NOT NULL THEN 'known' ELSE 'cold' END AS segment, count(*) AS n, avg(velocity_count_30d) AS mean_count_30d,
       avg(velocity_prior_count) AS mean_prior FROM k JOIN v ON k.id = v.id LEFT JOIN h ON h.uid = k.uid WHERE split = 'query' GROUP BY 1""")
def _(t):
    d = causal.velocity(t.tx().withColumn("uid", tk.compose("card1", "addr1")), ["uid"], "dt", "id", "amt")
    d = sg.seen(d.filter("split = 'query'"), t.history().withColumn("uid", tk.compose("card1", "addr1")), ["uid"],
                F.col("addr1").isNotNull(), "known")
    return (d.groupBy(F.when(F.col("known"), "known").otherwise("cold").alias("segment"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg("velocity_count_30d").alias("mean_count_30d"),
                 F.avg("velocity_prior_count").alias("mean_prior")))
