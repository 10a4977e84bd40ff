"""Bindings: keys, encodings (P), per-row functions (F), set operations (U)."""
from pyspark.sql import functions as F

from ..config import GENERIC_MAIL
from ..functions import rowwise as rw, tokens as tk
from ..operators import encode as en
from .registry import query

MAIL = "CASE WHEN lower(email) IN ('building', 'mail.com', 'anonymous.com', '<missing>') THEN NULL ELSE lower(email) END"
DAYS = "CAST(dt AS DOUBLE) / 86400"
OR = {"floor_day": f"(floor({DAYS}) - d1)", "round": f"round_even({DAYS} - d1, 0)", "floor": f"floor({DAYS} - d1)"}


def tok(e, missing="<MISSING>"):
    return f"COALESCE(CAST({e} AS VARCHAR), '{missing}')"


def itok(e, missing="<MISSING>"):
    return f"COALESCE(CAST(CAST(round_even({e}, 0) AS BIGINT) AS VARCHAR), '{missing}')"


def cat(*parts):
    return " || '|' || ".join(parts)


@query("P1_token", "id:i a:s m:s", f"SELECT id, {tok('addr1')} AS a, {tok('email')} AS m FROM {{tx}}")
def _(t):
    return t.tx().select("id", tk.token("addr1").alias("a"), tk.token("email").alias("m"))


@query("P2_integer_token", "id:i a:s b:s",
       f"SELECT id, {itok('s1 * 1000 + 0.5')} AS a, {itok('d1', 'NA')} AS b FROM {{tx}}")
def _(t):
    return t.tx().select("id", tk.integer_token(F.col("s1") * 1000 + 0.5).alias("a"),
                         tk.integer_token("d1", "NA").alias("b"))


@query("P3_composite_key", "id:i k:s", f"SELECT id, {cat(tok('card1'), tok('addr1'), itok(OR['floor_day']))} AS k FROM {{tx}}")
def _(t):
    return t.tx().select("id", tk.compose("card1", "addr1", tk.integer_token(
        tk.origin_day("dt", "d1", "floor_day"))).alias("k"))


COARSE = {"card_addr": ["card1", "addr1"], "card_mail": ["card1", "addr1", "email"],
          "card_full": ["card1", "card2", "card4"], "card_product": ["card1", "addr1", "product"],
          "mail_pair": ["email", "r_email"]}


@query("P4_coarse_keys", "id:i " + " ".join(f"{k}:s" for k in COARSE),
       "SELECT id, " + ", ".join(f"{cat(*map(tok, c))} AS {k}" for k, c in COARSE.items()) + " FROM {tx}")
def _(t):
    return t.tx().select("id", *[tk.compose(*c).alias(k) for k, c in COARSE.items()])


@query("P5_origin_keys", "id:i o:f uid_mail:s uid_card:s uid_card_mail:s",
       f"""SELECT id, {OR['floor_day']} AS o, {cat(itok(OR['floor_day']), tok('email'))} AS uid_mail,
       {cat(tok('card1'), tok('addr1'), itok(OR['floor_day']))} AS uid_card,
       {cat(tok('card1'), tok('addr1'), itok(OR['floor_day']), tok('email'))} AS uid_card_mail FROM {{tx}}""")
def _(t):
    o = tk.origin_day("dt", "d1", "floor_day")
    i = tk.integer_token(o)
    return t.tx().select("id", o.alias("o"), tk.compose(i, "email").alias("uid_mail"),
                         tk.compose("card1", "addr1", i).alias("uid_card"),
                         tk.compose("card1", "addr1", i, "email").alias("uid_card_mail"))


@query("P6_round_and_floor_uid", "id:i strict:s magic:s",
       f"""SELECT id, {cat(tok('card1'), tok('addr1'), itok(OR['round']), tok('email'))} AS strict,
       card1 || '_' || {tok('addr1')} || '_' || {itok(OR['floor'])} AS magic FROM {{tx}}""")
def _(t):
    return t.tx().select(
        "id", tk.compose("card1", "addr1", tk.integer_token(tk.origin_day("dt", "d1", "round")), "email").alias("strict"),
        tk.compose("card1", "addr1", tk.integer_token(tk.origin_day("dt", "d1", "floor")), sep="_").alias("magic"))


POOL = {"floor_card_addr": ("card1", "addr1", "floor"), "floor_card_addr_mail": ("card1", "addr1", "floor", "email"),
        "round_card_addr_mail": ("card1", "addr1", "round", "email"), "floor_card_mail": ("card1", "floor", "email"),
        "floor_card_addr_product": ("card1", "addr1", "floor", "product"),
        "round_card_addr_product_mail": ("card1", "addr1", "round", "product", "email")}


def pool_keys(df):
    part = lambda p: (tk.integer_token(tk.origin_day("dt", "d1", p), "NA") if p in ("floor", "round")
                      else tk.token(p, "NA"))
    return df.withColumns({k: F.concat_ws("|", *map(part, ps)) for k, ps in POOL.items()})


POOL_SQL = {k: cat(*[itok(OR[p], "NA") if p in OR else tok(p, "NA") for p in ps]) for k, ps in POOL.items()}


@query("P7_pooling_keys", "id:i " + " ".join(f"{k}:s" for k in POOL),
       "SELECT id, " + ", ".join(f"{e} AS {k}" for k, e in POOL_SQL.items()) + " FROM {tx}")
def _(t):
    return pool_keys(t.tx())


@query("P8_key_validity", "id:i strict_valid:i card_valid:i mail_valid:i",
       f"""SELECT id, card1 IS NOT NULL AND addr1 IS NOT NULL AND d1 IS NOT NULL AS strict_valid,
       card1 IS NOT NULL AND addr1 IS NOT NULL AND d1 IS NOT NULL AS card_valid,
       d1 IS NOT NULL AND email IS NOT NULL AS mail_valid FROM {{tx}}""")
def _(t):
    return t.tx().select("id", tk.all_present("card1", "addr1", "d1").alias("strict_valid"),
                         tk.all_present("card1", "addr1", "d1").alias("card_valid"),
                         tk.all_present("d1", "email").alias("mail_valid"))


@query("P9_uid_metadata", "strict_valid:i mail_valid:i n:i uids:i",
       f"""SELECT strict_valid, mail_valid, count(*) AS n, count(DISTINCT uid) AS uids FROM (
       SELECT {cat(tok('card1'), tok('addr1'), itok(OR['floor_day']), tok('email'))} AS uid,
       card1 IS NOT NULL AND addr1 IS NOT NULL AND d1 IS NOT NULL AS strict_valid,
       d1 IS NOT NULL AND email IS NOT NULL AS mail_valid FROM {{tx}}) GROUP BY ALL""")
def _(t):
    from ..operators.segments import uid_metadata
    d = uid_metadata(t.tx(), "dt", "d1", ["card1", "addr1"], "email", "floor_day")
    return (d.groupBy("strict_valid", "mail_valid")
            .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("strict_uid").alias("uids")))


@query("P10_clean_mail", "id:i m:s", f"SELECT id, {MAIL} AS m FROM {{tx}}")
def _(t):
    return t.tx().select("id", tk.clean_mail("email", (*GENERIC_MAIL, "building")).alias("m"))


@query("P11_narrow_types", "id:i amt:f card1:i addr1:i day:i",
       "SELECT id, amt, card1, addr1, day FROM {tx}")
def _(t):
    return en.narrow(t.tx().select("id", "amt", "card1", "addr1", "day"), keep=("id",))


@query("P12_column_families", "l_quantity:f l_discount:f l_tax:f",
       "SELECT l_quantity, l_discount, l_tax FROM lineitem")
def _(t):
    d = t.read("lineitem")
    return d.select(*en.columns_like(d.columns, "l_.*", exclude=("l_.*key", "l_.*date", "l_.*(flag|status|number|price)")))


@query("P13_raw_selection", "name:s n:i", """WITH w AS (SELECT id, addr1, card1, d1 FROM {tx})
       SELECT 'D1' AS name, count(d1) AS n FROM w UNION ALL SELECT 'addr1', count(addr1) FROM w
       UNION ALL SELECT 'card1', count(card1) FROM w""")
def _(t):
    d = t.tx().select("card1", "addr1", F.col("d1").alias("D1"), F.col("amt").alias("V330"), F.col("dt").alias("other"))
    keep = en.raw_selection(d.columns)
    counts = d.select(*keep).agg(*[F.count(c).alias(c) for c in keep])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, keep)), F.array(*keep))).alias("name", "n"))


@query("P14_column_union", "id:i dt:i amt:f", "SELECT id, dt, amt FROM {tx}")
def _(t):
    return t.tx().select(*en.union_columns(["id", "dt"], ["dt", "amt"], ["id"]))


@query("P15_align_columns", "id:i absent:i amt:f", "SELECT id, NULL AS absent, amt FROM {tx} WHERE split = 'query'")
def _(t):
    return en.align(t.query(), ["id", "absent", "amt"])


@query("P16_first_seen_codes", "id:i code:i", """WITH f AS (
       SELECT email, row_number() OVER (ORDER BY min((dt * 100000000 + id))) - 1 AS code FROM {tx}
       WHERE email IS NOT NULL GROUP BY email)
       SELECT id, COALESCE(code, -1) AS code FROM {tx} LEFT JOIN f ON f.email = tx.email""")
def _(t):
    return en.first_seen_codes(t.tx(), "email", ["dt", "id"], "code")


@query("P17_sorted_codes", "id:i code:i", """SELECT id, CASE WHEN addr1 IS NULL THEN -1
       ELSE dense_rank() OVER (ORDER BY addr1 NULLS LAST) - 1 END AS code FROM {tx}""")
def _(t):
    return en.sorted_codes(t.tx(), "addr1", "code")


@query("P18_pair_codes", "id:i p:s p_code:i", """SELECT id, p, dense_rank() OVER (ORDER BY p) - 1 AS p_code FROM (
       SELECT id, card2 || '_' || product AS p FROM {tx})""")
def _(t):
    return en.pair_codes(t.tx(), "card2", "product", "p")


@query("P19_history_domain", "id:i card1:i", """SELECT id, CASE WHEN card1 IN (
       SELECT card1 FROM {tx} WHERE split = 'history') THEN card1 END AS card1
       FROM {tx} WHERE split = 'query'""")
def _(t):
    return en.history_domain(t.query(), t.history(), "card1")


@query("P20_shift_to_zero", "id:i d1:f amt:f", """SELECT id, COALESCE(d1 - min(d1) OVER (), -1) AS d1,
       COALESCE(amt - min(amt) OVER (), -1) AS amt FROM {tx}""")
def _(t):
    return en.shift_to_zero(t.tx().select("id", "d1", "amt"), ["d1", "amt"])


@query("P21_infinite_to_missing", "id:i x:f", "SELECT id, CASE WHEN id % 10 <> 0 THEN amt END AS x FROM {tx}")
def _(t):
    d = t.tx().select("id", F.when(F.col("id") % 10 == 0, float("inf")).otherwise(F.col("amt")).alias("x"))
    return en.finite(d, ["x"])


@query("P22_time_windows", "side:s n:i first_day:i last_day:i", """SELECT CASE WHEN day < 900 THEN 'history' ELSE 'valid' END
       AS side, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM {tx}
       WHERE day < 900 OR (day >= 1200 AND day < 1500) GROUP BY 1""")
def _(t):
    from ..operators.folds import windows
    h, v = windows(t.tx(), "day", 900, 1200, 1500)
    both = h.withColumn("side", F.lit("history")).unionByName(v.withColumn("side", F.lit("valid")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("first_day"),
                                    F.max("day").alias("last_day"))


@query("P23_drop_columns", "id:i amt:f", "SELECT id, amt FROM {tx}")
def _(t):
    return t.tx().drop(*[c for c in t.tx().columns if c not in ("id", "amt")])


# row functions ----------------------------------------------------------------------------------------------
@query("F1_clock", "id:i day:i week:i hour:i dayofweek:i", """SELECT id, dt // 86400 AS day, dt // 604800 AS week,
       (dt // 3600) % 24 AS hour, (dt // 86400) % 7 AS dayofweek FROM {tx}""")
def _(t):
    return rw.clock(t.tx(), "dt")


@query("F2_calendar", "id:i month:i dayofmonth:i weekofyear:i is_weekend:i minute:i second_of_day:i",
       """SELECT id, month(a) AS month, day(a) AS dayofmonth, week(a) AS weekofyear, isodow(a) >= 6 AS is_weekend,
       minute(a) AS minute, dt % 86400 AS second_of_day
       FROM (SELECT id, dt, TIMESTAMP '2017-12-01' + to_seconds(dt) AS a FROM {ev_small})""".replace("{ev_small}",
       "(SELECT id, dt - 1704067200 AS dt FROM {ev})"))
def _(t):
    return rw.calendar(t.ev().withColumn("dt", F.col("dt") - 1704067200), "dt", "2017-12-01")


@query("F3_cycles", "id:i hour_sin:f hour_cos:f week_sin:f week_cos:f", """SELECT id, sin(2 * pi() * dt / 86400) AS hour_sin,
       cos(2 * pi() * dt / 86400) AS hour_cos, sin(2 * pi() * dt / 604800) AS week_sin,
       cos(2 * pi() * dt / 604800) AS week_cos FROM (SELECT id, dt - 1704067200 AS dt FROM {ev})""")
def _(t):
    return rw.cycles(t.ev().withColumn("dt", F.col("dt") - 1704067200), "dt")


@query("F4_month_index", "id:i month_index:i", """SELECT id, (year(a) - 2017) * 12 + month(a) AS month_index
       FROM (SELECT id, TIMESTAMP '2017-11-30' + to_seconds(dt) AS a FROM {tx})""")
def _(t):
    return rw.month_index(t.tx(), "dt", "2017-11-30")


@query("F5_amount_shape", "id:i log1p:f cents:f is_integer:i is_round_10:i", """SELECT id, ln(1 + amt) AS log1p,
       round_even((amt - floor(amt)) * 100, 0) % 100 AS cents, amt % 1 <= 1e-8 AS is_integer,
       amt % 10 <= 1e-8 AS is_round_10 FROM {tx}""")
def _(t):
    return rw.amount_shape(t.tx(), "amt")


@query("F6_amount_digits", "id:i log10:f magnitude:i thousandths:f to_integer:f cent_ending:f ends_00:i ends_25:i ends_50:i ends_95:i ends_99:i",
       """SELECT *, floor(log10) AS magnitude, cent_ending = 0 AS ends_00, cent_ending = 25 AS ends_25,
       cent_ending = 50 AS ends_50, cent_ending = 95 AS ends_95, cent_ending = 99 AS ends_99 FROM (
       SELECT id, log10(CASE WHEN amt < 0 THEN 0 ELSE amt END + 0.01) AS log10,
       round_even(amt * 1000, 0) % 1000 AS thousandths, abs(amt - round_even(amt, 0)) AS to_integer,
       round_even(amt * 100, 0) % 100 AS cent_ending FROM {tx})""")
def _(t):
    return rw.amount_digits(t.tx(), "amt")


MODS = (1, 5, 10, 25, 500)


@query("F7_multiple_distance", "id:i " + " ".join(f"mod_{m}_distance:f" for m in MODS) + " mod_50_is_zero:i mod_50_distance:f",
       "SELECT id, " + ", ".join(f"least(amt % {m}, {m} - amt % {m}) AS mod_{m}_distance" for m in (*MODS, 50))
       + ", amt % 50 <= 0.011 AS mod_50_is_zero FROM {tx}")
def _(t):
    return rw.multiple_distance(rw.multiple_distance(t.tx(), "amt", MODS), "amt", (50, 100, 200), 0.011)


@query("F8_fraction", "id:i fraction:f", "SELECT id, amt - floor(amt) AS fraction FROM {tx}")
def _(t):
    return rw.fraction(t.tx(), "amt")


@query("F9_minus_day", "id:i d1_minus_day:f d15_minus_day:f",
       f"SELECT id, d1 - {DAYS} AS d1_minus_day, d15 - {DAYS} AS d15_minus_day FROM {{tx}}")
def _(t):
    return rw.minus_day(t.tx(), "dt", ["d1", "d15"])


@query("F10_origins", "id:i d1_origin:f d1_origin_week:f d1_origin_distance:f",
       f"""SELECT id, {OR['round']} AS d1_origin, floor({OR['round']} / 7) AS d1_origin_week,
       abs({DAYS} - d1 - {OR['round']}) AS d1_origin_distance FROM {{tx}}""")
def _(t):
    return rw.origins(t.tx(), "dt", ["d1", "d15"])


@query("F11_origin_spread", "id:i origin_mean:f origin_std:f origin_range:f origin_nunique:i origin_matches:i",
       f"""WITH o AS (SELECT id, c, round_even({DAYS} - v, 0) AS o FROM (
         SELECT id, dt, unnest(['d1', 'd15', 'd3']) AS c, unnest([d1, d15, d3]) AS v FROM {{tx}})),
       f AS (SELECT id, o AS f FROM o WHERE c = 'd1')
       SELECT o.id, avg(o) AS origin_mean, stddev_samp(o) AS origin_std, max(o) - min(o) AS origin_range,
       count(DISTINCT o) AS origin_nunique, count(*) FILTER (abs(o - f) <= 1) AS origin_matches
       FROM o JOIN f ON o.id = f.id GROUP BY o.id""")
def _(t):
    return rw.origin_spread(t.tx(), "dt", ["d1", "d15", "d3"])


@query("F12_counter_shape", "id:i c13_log1p:f card2_log1p:f card2_to_c13:f",
       """SELECT id, ln(1 + c13) AS c13_log1p, ln(1 + card2) AS card2_log1p,
       CAST(card2 AS DOUBLE) / nullif(c13, 0) AS card2_to_c13 FROM {tx}""")
def _(t):
    return rw.counter_shape(t.tx(), ["c13", "card2"], [("card2", "c13")])


VS = ["v1", "v2", "v3", "v4"]
LI_STATS = """SELECT rn, any_value(okey) AS okey, any_value(pkey) AS pkey, count(*) - count(v) AS x_missing, avg(v) AS x_mean,
  stddev_samp(v) AS x_std, min(v) AS x_min, max(v) AS x_max, max(v) - min(v) AS x_range,
  (count(*) - count(v)) / 4.0 AS x_missing_rate, count(DISTINCT v) AS x_nunique,
  count(*) FILTER (v = 0) AS x_zeros, count(*) FILTER (v = 1) AS x_ones, count(*) FILTER (v = 2) AS x_twos
  FROM (SELECT rn, okey, pkey, unnest([v1, v2, v3, v4]) AS v FROM (SELECT *, row_number() OVER () AS rn FROM {li})) GROUP BY rn"""


@query("F13_row_stats", "okey:i pkey:i x_missing:i x_mean:f x_std:f x_min:f x_max:f", LI_STATS)
def _(t):
    return rw.row_stats(t.li(), VS, "x")


@query("F14_row_missing", "okey:i pkey:i row_missing:i", """SELECT okey, pkey, (v1 IS NULL)::INT + (v2 IS NULL)::INT
       + (v3 IS NULL)::INT + (v4 IS NULL)::INT AS row_missing FROM {li}""")
def _(t):
    return rw.missing_count(t.li())


@query("F15_block_summary", "okey:i pkey:i x_missing_rate:f x_mean:f x_std:f x_min:f x_max:f x_range:f x_nunique:i x_zeros:i x_ones:i x_twos:i", LI_STATS)
def _(t):
    return rw.block_summary(t.li(), VS, "x")


@query("F16_mail_match", "id:i mail_match:i p_suffix:s r_suffix:s",
       f"""SELECT id, {tok('p_email')} = {tok('r_email')} AS mail_match,
       string_split({tok('p_email')}, '.')[-1] AS p_suffix, string_split({tok('r_email')}, '.')[-1] AS r_suffix FROM {{dv}}""")
def _(t):
    return rw.mail_match(t.dv(), "p_email", "r_email")


@query("F17_mail_state", "id:i mail_state:s", """SELECT id, CASE WHEN email IS NULL AND r_email IS NULL THEN 'both_missing'
       WHEN email IS NULL OR r_email IS NULL THEN 'one_missing' WHEN email = r_email THEN 'same' ELSE 'different' END
       AS mail_state FROM {tx}""")
def _(t):
    return rw.mail_state(t.tx(), "email", "r_email")


@query("F18_device_family", "id:i device_family:s browser_family:s",
       f"""SELECT id, string_split({tok('device')}, '/')[1] AS device_family,
       trim(regexp_replace({tok('browser')}, '[\\d._-]+$', '')) AS browser_family FROM {{dv}}""")
def _(t):
    return rw.device_family(t.dv(), "device", "browser")


BRAND_SQL = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for p, n in reversed(rw.DEVICE_BRANDS))


@query("F19_device_brand", "id:i brand:s", f"""SELECT id, CASE {BRAND_SQL} ELSE regexp_split_to_array(x, '[/ ]')[1] END AS brand
       FROM (SELECT id, lower({tok('device')}) AS x FROM {{dv}})""")
def _(t):
    return rw.device_brand(t.dv(), "device")


@query("F20_device_flags", "id:i is_mobile:i has_build:i", f"""SELECT id, regexp_matches(x, '{rw.MOBILE_DEVICE}') AS is_mobile,
       contains(x, 'build') AS has_build FROM (SELECT id, lower({tok('device')}) AS x FROM {{dv}})""")
def _(t):
    return rw.device_flags(t.dv(), "device")


@query("F21_software", "id:i os_name:s os_major:f browser_name:s browser_major:f browser_mobile:i browser_generic:i",
       f"""SELECT id, trim(regexp_replace(o, '[\\d._-]+.*$', '')) AS os_name,
       TRY_CAST(regexp_extract(o, '(\\d+)', 1) AS DOUBLE) AS os_major,
       trim(regexp_replace(b, '[\\d._-]+.*$', '')) AS browser_name,
       TRY_CAST(regexp_extract(b, '(\\d+)', 1) AS DOUBLE) AS browser_major,
       regexp_matches(b, '{rw.MOBILE_BROWSER}') AS browser_mobile, contains(b, 'generic') AS browser_generic
       FROM (SELECT id, lower({tok('os')}) AS o, lower({tok('browser')}) AS b FROM {{dv}})""")
def _(t):
    return rw.software(t.dv(), "os", "browser")


@query("F22_screen_size", "id:i width:f height:f pixels:f aspect:f known:i portrait:i",
       f"""SELECT id, w AS width, h AS height, w * h AS pixels, w / nullif(h, 0) AS aspect,
       w IS NOT NULL AND h IS NOT NULL AS known, COALESCE(w < h, false) AS portrait FROM (
       SELECT id, TRY_CAST(regexp_extract(x, '^(\\d+)x(\\d+)$', 1) AS DOUBLE) AS w,
       TRY_CAST(regexp_extract(x, '^(\\d+)x(\\d+)$', 2) AS DOUBLE) AS h
       FROM (SELECT id, lower({tok('screen')}) AS x FROM {{dv}}))""")
def _(t):
    return rw.screen_size(t.dv(), "screen")


@query("F23_trailing_number", "id:i n:f",
       f"SELECT id, TRY_CAST(regexp_extract({tok('status')}, '(-?\\d+)$', 1) AS DOUBLE) AS n FROM {{dv}}")
def _(t):
    return rw.trailing_number(t.dv(), "status", "n")


@query("F21_software_text", "id:i os_name:s os_major:f browser_name:s browser_major:f browser_mobile:i browser_generic:i",
       f"""SELECT id, trim(regexp_replace(o, '[\\d._-]+.*$', '')) AS os_name, TRY_CAST(regexp_extract(o, '(\\d+)', 1) AS DOUBLE) AS os_major,
       trim(regexp_replace(b, '[\\d._-]+.*$', '')) AS browser_name, TRY_CAST(regexp_extract(b, '(\\d+)', 1) AS DOUBLE) AS browser_major,
       regexp_matches(b, '{rw.MOBILE_BROWSER}') AS browser_mobile, contains(b, 'generic') AS browser_generic
       FROM (SELECT page_id AS id, lower(split_part(url, '/', 3)) AS o, lower(url) AS b FROM pages)""")
def _(t):
    d = t.read("pages").select(F.col("page_id").alias("id"), F.split_part("url", F.lit("/"), F.lit(3)).alias("os"), F.col("url").alias("browser"))
    return rw.software(d, "os", "browser")


@query("F22_size_text", "id:i width:f height:f pixels:f aspect:f known:i portrait:i", """SELECT id, w AS width, h AS height, w * h AS pixels, w / nullif(h, 0) AS aspect,
       w IS NOT NULL AND h IS NOT NULL AS known, COALESCE(w < h, false) AS portrait FROM (SELECT id, TRY_CAST(regexp_extract(x, '^(\\d+)x(\\d+)$', 1) AS DOUBLE) AS w,
       TRY_CAST(regexp_extract(x, '^(\\d+)x(\\d+)$', 2) AS DOUBLE) AS h FROM (SELECT doc_id AS id, lower(len(string_split(text, ' ')) || 'X' || len(string_split(text, chr(10)))) AS x FROM documents))""")
def _(t):
    """Words and lines of every text, written as a size."""
    size = F.concat(F.size(F.split("text", " ")), F.lit("X"), F.size(F.split("text", "\n")))
    return rw.screen_size(t.read("documents").select(F.col("doc_id").alias("id"), size.alias("screen")), "screen")


@query("F23_trailing_number_text", "id:i n:f", "SELECT page_id AS id, TRY_CAST(regexp_extract(url, '(-?\\d+)$', 1) AS DOUBLE) AS n FROM pages")
def _(t):
    return rw.trailing_number(t.read("pages").select(F.col("page_id").alias("id"), "url"), "url", "n")


@query("F24_flag_summary", "id:i flags_true:i flags_false:i flags_missing:i flags_pattern:s", """SELECT id,
       COALESCE(m1 = 'T', false)::INT + COALESCE(m2 = 'T', false)::INT + COALESCE(m3 = 'T', false)::INT AS flags_true,
       COALESCE(m1 = 'F', false)::INT + COALESCE(m2 = 'F', false)::INT + COALESCE(m3 = 'F', false)::INT AS flags_false,
       (m1 IS NULL)::INT + (m2 IS NULL)::INT + (m3 IS NULL)::INT AS flags_missing,
       COALESCE(m1, 'N') || COALESCE(m2, 'N') || COALESCE(m3, 'N') AS flags_pattern FROM {dv}""")
def _(t):
    return rw.flag_summary(t.dv(), ["m1", "m2", "m3"])


@query("F25_presence_mask", "id:i mask:i present:i", """SELECT id, (d1 IS NOT NULL)::INT + 2 * (d15 IS NOT NULL)::INT
       + 4 * (d3 IS NOT NULL)::INT + 8 * (email IS NOT NULL)::INT AS mask, (d1 IS NOT NULL)::INT
       + (d15 IS NOT NULL)::INT + (d3 IS NOT NULL)::INT + (email IS NOT NULL)::INT AS present FROM {tx}""")
def _(t):
    cols = ["d1", "d15", "d3", "email"]
    d = rw.presence_mask(t.tx(), cols, "mask")
    return rw.missing_count(d, cols, "m").withColumn("present", len(cols) - F.col("m"))


@query("F26_drift_flag", "id:i outlier:i", """SELECT id, abs(COALESCE(d1 - min(d1) OVER (), -1)
       - COALESCE(d15 - min(d15) OVER (), -1)) > 3 AS outlier FROM {tx}""")
def _(t):
    return rw.drift_flag(en.shift_to_zero(t.tx().select("id", "d1", "d15"), ["d1", "d15"]), "d1", "d15", 3, "outlier")


# set operations ---------------------------------------------------------------------------------------------
@query("U1_history_with_query", "split:s n:i size_max:i", """WITH g AS (SELECT split, card2, count(*) OVER (PARTITION BY card2)
       AS size FROM {tx} WHERE split <> 'gap') SELECT split, count(*) AS n, max(size) AS size_max FROM g GROUP BY split""")
def _(t):
    from ..operators.joins import attach
    both = t.history().unionByName(t.query())
    d = attach(both, both.groupBy("card2").agg(F.count(F.lit(1)).alias("size")), ["card2"])
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size_max"))


@query("U3_distinct_keys", "card1:i addr1:i", "SELECT DISTINCT card1, addr1 FROM {tx} WHERE split = 'history'")
def _(t):
    return t.history().select("card1", "addr1").distinct()


@query("U4_missing_columns", "name:s n:i", "SELECT 'absent' AS name, count(*) AS n FROM orders")
def _(t):
    from ..operators.checks import missing_columns
    d = t.read("orders")
    gone = missing_columns(d, ["o_orderkey", "absent"])
    return d.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*map(F.lit, gone))).alias("name"), "n")
