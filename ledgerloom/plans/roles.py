"""Test tables in the roles of transactions, a timed stream, and wide numeric families (see FIXTURES.md).

Each role is stated twice, as a DataFrame and as a common table expression. `expand` puts the expressions a
query uses (`{tx}`, `{ev}`, …) in front of it. The tables hold no NULLs; the roles make some.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

HISTORY_END, QUERY_START = 1600, 1700     # days; the rows between are embargoed
SOURCES = ["s1", "s2", "s3"]

SQL = {
    "tx": """tx0 AS (
  SELECT o.*, c.c_nationkey, c.c_acctbal, c.c_mktsegment,
         date_diff('day', TIMESTAMP '1995-01-01', o.o_orderdate) AS d
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey),
tx AS (
  SELECT o_orderkey AS id, d * 86400 + (o_orderkey % 24) * 3600 AS dt, d AS day,
         CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice END AS amt,
         o_custkey AS card1, o_custkey % 50 AS card2, NULLIF(c_nationkey, 7) AS addr1,
         o_orderstatus AS product, o_orderpriority AS card4,
         NULLIF(c_mktsegment, 'HOUSEHOLD') AS email,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'mail.com' ELSE c_mktsegment END AS r_email,
         CASE WHEN o_orderkey % 13 <> 0 THEN CAST(d % 45 AS DOUBLE) END AS d1,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(d % 60 AS DOUBLE) END AS d15,
         CASE WHEN o_orderkey % 5 <> 0 THEN CAST((o_orderkey % 11) AS DOUBLE) END AS d3,
         CAST(o_custkey % 9 + d % 4 AS DOUBLE) AS c13,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
         CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000 AS s1,
         CAST((o_orderkey * 104729 + 17) % 499 AS DOUBLE) / 499 AS s2,
         CAST((o_custkey * 31 + d) % 211 AS DOUBLE) / 211 AS s3,
         CASE WHEN d < 1600 THEN 'history' WHEN d >= 1700 THEN 'query' ELSE 'gap' END AS split
  FROM tx0)""",
    "ev": """ev AS (
  SELECT event_id AS id, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS dt, user_id AS usr, event_type AS kind,
         CASE WHEN event_id % 31 <> 0 THEN value END AS amt, json_extract_string(props, '$.k') AS k,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'history' ELSE 'query' END AS split
  FROM events)""",
    "li": """li AS (
  SELECT l_orderkey AS okey, l_partkey AS pkey, l_suppkey AS skey, l_linenumber AS line,
         NULLIF(l_quantity, 1) AS v1, CASE WHEN l_partkey % 11 <> 0 THEN l_extendedprice END AS v2,
         NULLIF(l_discount, 0) AS v3, CASE WHEN l_partkey % 11 <> 0 THEN NULLIF(l_tax, 0) END AS v4,
         l_returnflag AS flag, l_linestatus AS status,
         date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) AS day,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM lineitem)""",
    "part3": """part3 AS (
  SELECT *, CASE WHEN card2 < 10 THEN 'strict' WHEN card2 < 25 THEN 'partial' ELSE 'cold' END AS segment
  FROM tx WHERE split = 'query')""",
    "dv": """dv AS (
  SELECT page_id AS id,
         CASE page_id % 12 WHEN 0 THEN 'SM-G' || page_id || ' Build/NRD' WHEN 1 THEN 'iOS Device'
           WHEN 2 THEN 'Windows' WHEN 3 THEN 'rv:' || (page_id % 60) || '.0' WHEN 4 THEN NULL
           WHEN 5 THEN 'Moto G Build/' || page_id WHEN 6 THEN 'MacOS' WHEN 7 THEN 'Redmi Note ' || (page_id % 9)
           WHEN 8 THEN 'LG-M' || page_id WHEN 9 THEN 'ALE-L21 Build' WHEN 10 THEN 'Pixel 2' ELSE url END AS device,
         CASE page_id % 5 WHEN 0 THEN 'Windows 10' WHEN 1 THEN 'iOS 11.' || (page_id % 7) || '.1'
           WHEN 2 THEN 'Android 7.0' WHEN 3 THEN 'Linux' ELSE NULL END AS os,
         CASE page_id % 6 WHEN 0 THEN 'chrome ' || (50 + page_id % 20) || '.0 for android'
           WHEN 1 THEN 'mobile safari 11.0' WHEN 2 THEN 'ie 11.0 for desktop' WHEN 3 THEN 'Generic/Android'
           WHEN 4 THEN 'safari generic' ELSE NULL END AS browser,
         CASE page_id % 4 WHEN 0 THEN (320 + page_id % 700) || 'x' || (480 + page_id % 900) WHEN 1 THEN '0x0'
           WHEN 2 THEN NULL ELSE 'unknown' END AS screen,
         CASE page_id % 3 WHEN 0 THEN 'match_status:' || (page_id % 5 - 2) WHEN 1 THEN 'match' ELSE NULL END AS status,
         split_part(split_part(url, '/', 3), '.', 1) || '.' || split_part(split_part(url, '/', 3), '.', 2)
           || CASE WHEN page_id % 9 = 0 THEN '' ELSE '.com' END AS p_email,
         CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 2 = 0 THEN
           split_part(split_part(url, '/', 3), '.', 1) || '.' || split_part(split_part(url, '/', 3), '.', 2)
           || CASE WHEN page_id % 9 = 0 THEN '' ELSE '.com' END ELSE 'Mail.com' END AS r_email,
         CASE WHEN page_id % 3 <> 0 THEN CASE WHEN length(html) % 2 = 0 THEN 'T' ELSE 'F' END END AS m1,
         CASE WHEN page_id % 5 <> 0 THEN CASE WHEN length(url) % 2 = 0 THEN 'T' ELSE 'F' END END AS m2,
         CASE WHEN page_id % 4 <> 1 THEN 'M' || (page_id % 3) END AS m3
  FROM pages)""",
}


def expand(sql: str) -> str:
    used = [n for n in SQL if re.search(r"\{" + n + r"\}", sql)]
    if "part3" in used and "tx" not in used:
        used.insert(0, "tx")
    used.sort(key=list(SQL).index)
    for n in SQL:
        sql = sql.replace("{" + n + "}", n)
    if not used:
        return sql
    head = ",\n".join(SQL[n] for n in used)
    body = sql.strip()
    return f"WITH RECURSIVE {head}, {body[4:].removeprefix(' RECURSIVE')}" if body.upper().startswith("WITH") else \
        f"WITH {head}\n{body}"


class Tables:
    """The test tables of one scale factor in their roles."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def tx(self) -> DataFrame:
        c = self.read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        o = self.read("orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        k, day = F.col("o_orderkey"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("bigint")
        return o.select(
            k.alias("id"), (day * 86400 + (k % 24) * 3600).alias("dt"), day.alias("day"),
            F.when(k % 97 != 0, F.col("o_totalprice")).alias("amt"), F.col("o_custkey").alias("card1"),
            (F.col("o_custkey") % 50).alias("card2"), F.nullif("c_nationkey", F.lit(7)).alias("addr1"),
            F.col("o_orderstatus").alias("product"), F.col("o_orderpriority").alias("card4"),
            F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("email"),
            F.when(k % 4 == 0, None).when(k % 3 == 0, "mail.com").otherwise(F.col("c_mktsegment")).alias("r_email"),
            F.when(k % 13 != 0, (day % 45).cast("double")).alias("d1"),
            F.when(k % 7 != 0, (day % 60).cast("double")).alias("d15"),
            F.when(k % 5 != 0, (k % 11).cast("double")).alias("d3"),
            (F.col("o_custkey") % 9 + day % 4).cast("double").alias("c13"),
            (F.col("o_orderstatus") == "F").cast("int").alias("label"),
            ((k * 7919) % 1000 / F.lit(1000.0)).alias("s1"), ((k * 104729 + 17) % 499 / F.lit(499.0)).alias("s2"),
            ((F.col("o_custkey") * 31 + day) % 211 / F.lit(211.0)).alias("s3"),
            F.when(day < HISTORY_END, "history").when(day >= QUERY_START, "query").otherwise("gap").alias("split"))

    def history(self) -> DataFrame:
        return self.tx().filter("split = 'history'")

    def query(self) -> DataFrame:
        return self.tx().filter("split = 'query'")

    def part3(self) -> DataFrame:
        """Query rows with a stand-in segment."""
        return self.query().withColumn("segment", F.when(F.col("card2") < 10, "strict")
                                       .when(F.col("card2") < 25, "partial").otherwise("cold"))

    def ev(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        us = F.unix_micros(ts)
        return self.read("events").select(
            F.col("event_id").alias("id"), us.alias("us"), F.floor(us / 1000000).alias("dt"),
            F.col("user_id").alias("usr"), F.col("event_type").alias("kind"),
            F.when(F.col("event_id") % 31 != 0, F.col("value")).alias("amt"),
            F.get_json_object("props", "$.k").alias("k"), (F.col("event_type") == "error").cast("int").alias("label"),
            F.when(ts < F.lit("2024-01-20").cast("timestamp"), "history").otherwise("query").alias("split"))

    def li(self) -> DataFrame:
        full = F.col("l_partkey") % 11 != 0
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("okey"), F.col("l_partkey").alias("pkey"), F.col("l_suppkey").alias("skey"),
            F.col("l_linenumber").alias("line"), F.nullif("l_quantity", F.lit(1.0)).alias("v1"),
            F.when(full, F.col("l_extendedprice")).alias("v2"), F.nullif("l_discount", F.lit(0.0)).alias("v3"),
            F.when(full, F.nullif("l_tax", F.lit(0.0))).alias("v4"), F.col("l_returnflag").alias("flag"),
            F.col("l_linestatus").alias("status"),
            F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("bigint").alias("day"),
            (F.col("l_returnflag") == "R").cast("int").alias("label"))

    def dv(self) -> DataFrame:
        """Device, browser, screen and mail texts derived from `pages`."""
        k, url = F.col("page_id"), F.col("url")
        s = lambda e: e.cast("string")
        host = F.split_part(url, F.lit("/"), F.lit(3))
        mail = F.concat(F.split_part(host, F.lit("."), F.lit(1)), F.lit("."),
                        F.split_part(host, F.lit("."), F.lit(2)), F.when(k % 9 == 0, "").otherwise(".com"))
        flag = lambda e: F.when(F.length(e) % 2 == 0, "T").otherwise("F")
        return self.read("pages").select(
            k.alias("id"),
            F.when(k % 12 == 0, F.concat(F.lit("SM-G"), s(k), F.lit(" Build/NRD"))).when(k % 12 == 1, "iOS Device")
            .when(k % 12 == 2, "Windows").when(k % 12 == 3, F.concat(F.lit("rv:"), s(k % 60), F.lit(".0")))
            .when(k % 12 == 4, None).when(k % 12 == 5, F.concat(F.lit("Moto G Build/"), s(k)))
            .when(k % 12 == 6, "MacOS").when(k % 12 == 7, F.concat(F.lit("Redmi Note "), s(k % 9)))
            .when(k % 12 == 8, F.concat(F.lit("LG-M"), s(k))).when(k % 12 == 9, "ALE-L21 Build")
            .when(k % 12 == 10, "Pixel 2").otherwise(url).alias("device"),
            F.when(k % 5 == 0, "Windows 10").when(k % 5 == 1, F.concat(F.lit("iOS 11."), s(k % 7), F.lit(".1")))
            .when(k % 5 == 2, "Android 7.0").when(k % 5 == 3, "Linux").alias("os"),
            F.when(k % 6 == 0, F.concat(F.lit("chrome "), s(50 + k % 20), F.lit(".0 for android")))
            .when(k % 6 == 1, "mobile safari 11.0").when(k % 6 == 2, "ie 11.0 for desktop")
            .when(k % 6 == 3, "Generic/Android").when(k % 6 == 4, "safari generic").alias("browser"),
            F.when(k % 4 == 0, F.concat(s(320 + k % 700), F.lit("x"), s(480 + k % 900))).when(k % 4 == 1, "0x0")
            .when(k % 4 == 3, "unknown").alias("screen"),
            F.when(k % 3 == 0, F.concat(F.lit("match_status:"), s(k % 5 - 2))).when(k % 3 == 1, "match")
            .alias("status"),
            mail.alias("p_email"),
            F.when(k % 7 == 0, None).when(k % 2 == 0, mail).otherwise("Mail.com").alias("r_email"),
            F.when(k % 3 != 0, flag(F.col("html"))).alias("m1"), F.when(k % 5 != 0, flag(url)).alias("m2"),
            F.when(k % 4 != 1, F.concat(F.lit("M"), s(k % 3))).alias("m3"))
