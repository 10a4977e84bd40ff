"""Secret scan with corpus-wide ownership frequency (operator 2). DataFrame functions only.

Base spans come from three patterns, leftmost and non-overlapping per kind. Positions are code points: the texts between
matches and the matches themselves alternate, so running sums of their lengths give start and end.

The method looks at values, not only at their surroundings. Every base value, and every other long run of key characters that
holds letters and digits, is a candidate. Its hash is counted over the corpus by distinct repositories and distinct
owners. A value that many owners hold is a copied example; one that at most `max_owners` hold, with many different characters, is a
live-looking credential of that owner. Such a run becomes a span of kind `owned` unless a base span overlaps it. Base spans
always stay; `n_live` and `n_example` say how many of a document's spans are of either sort.

Counts start from distinct (value, owner, repository), so a value in a third of all rows is aggregated before it is shuffled.
NULL and empty texts have no spans; a NULL owner or repository is one of its own; repeated rows are scanned row by row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import columns, save, text_or_empty

#: A run that is too short for access or hex holds no span at all, so the least length may stand in the pattern; a short assign
#: match does hide what it covers, so there it may not.
#: Kinds in order, their pattern, the group whose length counts, the least length
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: cheap tests that any text with a span of the kind passes
HINTS = (r"(?i)password|passwd|secret|token|api_?key", r"AKIA[A-Z0-9]{14}", r"[0-9a-f]{16}")
RUN, RUN_HINT = r"[A-Za-z0-9+/_=-]{16,}", r"[A-Za-z0-9+/_=-]{16}"
NAMES = [k[0] for k in KINDS] + ["owned"]


def _matches(text: Column, pattern: str, hint: str, group: int) -> Column:
    """All matches of a text in order: length of the gap before, length, value."""
    found = F.zip_with(F.split(text, pattern, -1), F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["all"]).alias("size"), m["value"].alias("value")))
    return F.when(text.rlike(hint), F.filter(found, lambda m: m["size"].isNotNull()))


def _spans(rows: DataFrame, name: str, kind: int, least: int, value_length: Column) -> DataFrame:
    """(row, kind, start, end, value) of one kind. A text's matches are ordered within the text only."""
    m = rows.filter(F.size(name) > 0).select("row", "owner", "repo", F.posexplode(name).alias("at", "m"))
    upto = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto).cast("bigint"))
    return m.filter(value_length >= least).select(
        "row", "owner", "repo", F.lit(kind).alias("kind"), (F.col("end") - F.col("m.size")).alias("start"), "end", F.col("m.value").alias("value"))


def find_secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repositories: int = 3,
                 least_distinct: int = 8) -> DataFrame:
    """One row per row of `docs`: doc_id and `found`, its spans in order (start, kind, end, owners, repos, live)."""
    d = columns(docs, *dict.fromkeys(["doc_id", "text", owner, *repository])).select(
        "doc_id", F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("")).alias("owner"),
        F.xxhash64(*[F.coalesce(F.col(f"`{r}`").cast("string"), F.lit("")) for r in repository]).alias("repo"), text_or_empty().alias("text"))
    text = F.col("text")
    d = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", *[
        _matches(text, pattern, hint, group).alias(name) for (name, pattern, group, _), hint in zip(KINDS, HINTS)],
        _matches(text, RUN, RUN_HINT, 0).alias("owned"))
    rows = save(d)
    parts = [_spans(rows, name, k, least, F.length("m.value") if group else F.col("m.size")) for k, (name, _, group, least) in enumerate(KINDS)]
    value = F.col("m.value")
    runs = _spans(rows, "owned", len(KINDS), 0, F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), 0).otherwise(-1))
    all_spans = runs
    for p in parts:
        all_spans = all_spans.unionByName(p)
    spans = save(all_spans.withColumn("h", F.xxhash64("value")).withColumn("varied", F.size(F.array_distinct(F.split("value", ""))) >= least_distinct)
                 .drop("value"))
    spread = (spans.select("h", "owner", "repo").distinct().groupBy("h")
              .agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos")))
    judged = spans.join(spread, "h").withColumn(
        "live", F.col("varied") & (F.col("owners") <= max_owners) & (F.col("repos") <= max_repositories))
    base = F.col("kind") < len(KINDS)
    order = Window.partitionBy("row").orderBy("start", "kind")
    judged = judged.withColumns({
        "before": F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "after": F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))})
    free = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    found = (judged.filter(base | F.col("live") & free)
             .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repos", "live"))).alias("found")))
    return rows.select("row", "doc_id").join(found, "row", "left").select("doc_id", "found")


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts by kind, digest of the base spans, all spans as text, and how many are owner-specific or copied."""
    f = find_secrets(docs, **options)
    count = lambda test: F.coalesce(F.size(F.filter("found", test)), F.lit(0)).cast("bigint")
    of_kind = lambda k: lambda s: s["kind"] == k
    return f.select(
        "doc_id", *[count(of_kind(k)).alias(f"n_{name}") for k, name in enumerate(NAMES[:3])],
        F.sha2(_written(F.filter("found", lambda s: s["kind"] < len(KINDS))), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_example"))


def _sql_spans(kind: int, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, owner, repo, {kind} AS kind, stop - size AS start, stop AS "end", value FROM (
  SELECT *, CAST(sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS stop FROM (
    SELECT doc_id, owner, repo, i, length(gaps[i]) AS gap, length(found[i]) AS size, vals[i] AS value FROM (
      SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, owner, repo, regexp_split_to_array(text, '{p}') AS gaps,
        regexp_extract_all(text, '{p}') AS found, regexp_extract_all(text, '{p}', {group}) AS vals FROM d)))) WHERE {keep}"""


#: the same in DuckDB, for the default parameters
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repo FROM documents),
s AS ({" UNION ALL ".join(_sql_spans(k, p, g, f"length(value) >= {n}") for k, (_, p, g, n) in enumerate(KINDS))}
  UNION ALL {_sql_spans(3, RUN, 0, "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')")}),
spread AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM s GROUP BY 1),
j AS (SELECT s.*, len(list_distinct(string_split(value, ''))) >= 8 AND owners <= 1 AND repos <= 3 AS live,
  CASE kind {" ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES))} END || ':' || start || ':' || "end" AS said
  FROM s JOIN spread USING (value)),
k AS (SELECT * FROM j WHERE kind < 3 OR live AND NOT EXISTS (SELECT 1 FROM j b WHERE b.doc_id = j.doc_id AND b.kind < 3 AND b.start < j."end" AND j.start < b."end")),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  string_agg(said, ',' ORDER BY start, kind) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM k GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live,
  CAST(coalesce(n_example, 0) AS BIGINT) AS n_example FROM d LEFT JOIN a USING (doc_id)
"""
