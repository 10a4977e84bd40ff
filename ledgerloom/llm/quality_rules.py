"""Quality rules with cross-document line frequency (operator 5). DataFrame functions only.

Per document: words, word characters, symbols, repeated lines and words inside five-word windows that occur twice. Across
documents: lines, normalised (lower case, white space as one space, ends trimmed) and hashed, are counted per host by the
distinct documents that hold them (copies of a text are documents like any other). A line in more than `max_documents` of a
host is removed wherever it stands in that host, however large the host is; a document that loses more than `max_removed`
of its words is depleted and rejected.

Counting starts with a partial aggregation by (host, line, document), so a host with a third of all rows or a line in a third of
all documents is spread over many tasks. NULL and empty texts have no words and fail the base rule; a NULL host is one host
of its own; a row with a NULL doc_id is kept and is a document of its own; rows that repeat a doc_id are one document in
counts and are judged row by row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import columns, save, text_or_empty

SEPARATORS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measured(docs: DataFrame, host: str) -> DataFrame:
    """One row per row of `docs`: the counts, a hash of the text, and hash and words of each line that has a word."""
    blank = "[ \\t-\\r]+"
    d = docs.select(F.col("doc_id"), F.col(f"`{host}`").alias("host"), text_or_empty().alias("text"))
    d = d.withColumns({
        "words": F.transform(F.array_remove(F.split("text", blank), ""), lambda w: F.xxhash64(w)),
        "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
    })
    word = [lambda i, j=j: F.get("words", i + j) for j in range(WINDOW)]
    d = d.withColumns({
        "n_words": F.size("words").cast("bigint"),
        "grams": F.when(F.size("words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[w(i) for w in word]))),
    })
    d = d.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "host", "n_words",
        _without(F.col("text"), SEPARATORS).cast("bigint").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        # sorted only where a window repeats at all
        F.when(F.size("grams") > F.size(F.array_distinct("grams")), F.sort_array(
            F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("ordered"),
        F.transform("lines", lambda x: F.struct(
            F.xxhash64(F.lower(F.array_join(F.array_remove(F.split(x, blank), ""), " "))).alias("h"),
            F.size(F.array_remove(F.split(x, blank), "")).alias("w"))).alias("lines"))
    again = F.sort_array(F.transform(F.filter("ordered", lambda x, k: (
        F.get("ordered", k - 1)["g"].eqNullSafe(x["g"])) | (F.get("ordered", k + 1)["g"].eqNullSafe(x["g"]))), lambda x: x["i"]))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(again, none, lambda a, p: F.struct(
        (a["n"] + p + WINDOW - F.greatest(a["end"], p)).cast("bigint").alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])
    return d.select(*[c for c in d.columns if c != "ordered"], F.coalesce(covered, F.lit(0).cast("bigint")).alias("n_repeat_words"))


def quality_rules(docs: DataFrame, host: str = "source", max_documents: int = 5, max_removed: float = 0.8,
                  min_words: int = 10, max_repeat_pct: int = 20) -> DataFrame:
    """doc_id, the counts, base_failed, removed_words (in lines above the limit), kept."""
    m = save(measured(columns(docs, *dict.fromkeys(["doc_id", "text", host])), host))
    lines = m.select("host", "doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("alone"),
                     F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    above = (lines.distinct().groupBy("host", "h").count().filter(F.col("count") > max_documents)
             .select(F.col("host").alias("at_host"), "h"))
    held = m.select("row", "host", F.explode("lines").alias("line")).select("row", "host", F.col("line.h").alias("of_line"), "line.w")
    removed = (held.join(above, (F.col("of_line") == F.col("h")) & F.col("host").eqNullSafe(F.col("at_host")))
               .groupBy("row").agg(F.sum("w").cast("bigint").alias("removed_words")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return (m.drop("lines").join(removed, "row", "left")
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("bigint")))
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= max_removed * F.col("n_words")))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept"))


#: the same in DuckDB, for the default parameters
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS words FROM d),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
grams AS (SELECT doc_id, i, words[i:i + 4] AS g FROM pos),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) AS r(j) GROUP BY 1),
lines AS (SELECT doc_id, source, line,
    lower(array_to_string(list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda x: x <> ''), ' ')) AS norm,
    len(list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^ \t-\r]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY 1),
above AS (SELECT source, norm FROM lines GROUP BY source, norm HAVING count(DISTINCT doc_id) > 5),
gone AS (SELECT l.doc_id, sum(l.n) AS n FROM lines l JOIN above a ON a.norm = l.norm AND a.source IS NOT DISTINCT FROM l.source GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \t-\r]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM d JOIN w USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND removed_words <= 0.8 * n_words AS kept FROM f
"""
