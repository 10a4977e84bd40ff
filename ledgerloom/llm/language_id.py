"""Language identification by Bayesian evidence fusion (operator 7).

Four kinds of evidence are added as logarithms: the text, the language that markup or metadata declares, the suffix of the
address, and what its host usually publishes.

* Text: naive Bayes over hashed byte trigrams of the whole text. Trigrams of one text depend on each other, so the sum is divided by the root of
  their number.
* Declared language and suffix: how often each value goes with each language, counted by grouped aggregation over all rows, a row's
  language being what its text alone says; smoothed. Missing values say nothing.
* Host: counts of its rows by language, smoothed towards its domain (the last two labels of its name), which is smoothed towards all rows. A
  row's own count is left out, so a text does not vote for itself.

The trigram table is learned from rows with a declared language that the fold by CRC-32 of the id does not hold out; it has 2 ** `bits` cells for
each language. Counts are sums with partial aggregation, so a host with a third of all rows is no burden. A NULL or empty text leaves the
decision to the other evidence; ties go to the first language by name; NULL doc_ids are kept; repeated rows are judged row by row. Without any
declared language there is nothing to learn and the language is NULL.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .byte_cnn import held_out
from .common import save, slices, utf8

STRONG = 20.0              # rows that a parent's distribution counts as


def trigrams(raw: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram that lies inside one text, and the text."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = raw.astype(np.uint32)
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761) >> np.uint32(32 - bits)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = text[2:] == text[:-2]
    return code[inside].astype(np.int64), text[2:][inside]


def _learned(langs: list[str], bits: int):
    number = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) << bits, np.int64)
        for batch in batches:
            for part in slices(batch):
                code, text = trigrams(*utf8(part.column("text")), bits)
                lang = np.array([number[x] for x in part.column("declared").to_pylist()], np.int64)
                total += np.bincount(lang[text] << bits | code, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])
    return run


def _likelihoods(table: np.ndarray, bits: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                code, text = trigrams(*utf8(part.column("text")), bits)
                n = np.bincount(text, minlength=part.num_rows)
                sums = np.stack([np.bincount(text, row[code], part.num_rows) for row in table], 1) / np.sqrt(np.maximum(n, 1))[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * len(table)), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists], names=[*keep, "text_log"])
    return run


def _best(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def _sum(*logs: Column) -> Column:
    out = logs[0]
    for x in logs[1:]:
        out = F.zip_with(out, x, lambda a, b: a + b)
    return out


def identify(rows: DataFrame, bits: int = 15) -> DataFrame:
    """`rows` has doc_id, text, declared, suffix, host (any of the last four may be NULL), and may have `kind`, which is passed on.
    Gives doc_id, lang, posterior, text_lang (by the text alone), declared, and `kind` where there is one."""
    kind = [c for c in rows.columns if c == "kind"]
    # the domain of www.a.example is a.example; a name without dots is its own
    domain = F.substring_index("host", ".", -2)
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "declared", "suffix", "host", domain.alias("domain"), *kind)
    langs = [r[0] for r in rows.filter("declared IS NOT NULL").select("declared").distinct().orderBy("declared").limit(1001).collect()]
    if len(langs) > 1000:
        raise ValueError("over 1,000 declared languages: map them to codes first")
    if not langs:
        return rows.select("doc_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"),
                           F.lit(None).cast("string").alias("text_lang"), "declared", *kind)
    size = len(langs)
    names = F.array(*[F.lit(x) for x in langs])
    learn = rows.filter(F.col("declared").isNotNull() & ~held_out()).select("text", "declared")
    counted = learn.mapInArrow(_learned(langs, bits), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()    # at most size << bits
    table = np.zeros(size << bits)
    table[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    table = table.reshape(size, -1) + 0.5
    table = np.log(table / table.sum(1, keepdims=True))

    keep = ["doc_id", "declared", "suffix", "host", "domain", *kind]
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    d = save(rows.mapInArrow(_likelihoods(table, bits, keep), f"{schema}, text_log array<double>")
             .withColumn("own", _best(F.col("text_log"))))

    def counts(frame: DataFrame, *by: str) -> DataFrame:
        per = [F.count_if(F.col("own") == k).cast("double") for k in range(size)]
        return frame.groupBy(*by).agg(F.array(*per).alias("n"))

    everywhere = counts(d).first()["n"]
    base = F.array(*[F.lit((x + 1.0) / (sum(everywhere) + size)) for x in everywhere])

    def of_language(column: str) -> DataFrame:
        """log P(value | language), per value."""
        share = lambda x, k: F.log((x + 1.0) / (F.get(F.array(*[F.lit(float(n)) for n in everywhere]), k) + F.lit(float(size))))
        return counts(d.filter(F.col(column).isNotNull()), column).select(F.col(column), F.transform("n", share).alias(f"{column}_log"))

    hosts = counts(d.filter("host IS NOT NULL"), "domain", "host")
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.get("n", F.lit(k))) for k in range(size)]).alias("of_domain"))
    hosts = hosts.join(domains, "domain").select("host", F.col("n").alias("of_host"), "of_domain")
    flat = F.array(*[F.lit(0.0)] * size)
    less = lambda c: F.transform(c, lambda x, k: x - (k == F.col("own")).cast("double"))
    towards = lambda n, parent: F.zip_with(n, parent, lambda x, p: (x + STRONG * p) / (F.aggregate(n, F.lit(0.0), lambda a, y: a + y) + STRONG))
    d = (d.join(of_language("declared"), "declared", "left").join(of_language("suffix"), "suffix", "left").join(hosts, "host", "left")
         .withColumn("prior", F.when(F.col("of_host").isNull(), base).otherwise(towards(less("of_host"), towards(less("of_domain"), base)))))
    d = d.withColumn("logs", _sum(F.col("text_log"), F.transform("prior", lambda x: F.log(x)), F.coalesce("declared_log", flat), F.coalesce("suffix_log", flat)))
    return d.select("doc_id", F.get(names, _best(F.col("logs"))).alias("lang"),
                    (1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("logs")))).alias("posterior"),
                    F.get(names, "own").alias("text_lang"), "declared", *kind)


def of_documents(docs: DataFrame) -> DataFrame:
    """The evidence of a table of documents: `lang` is what was declared, `source` the host; its suffix counts where it has one."""
    c = lambda n: F.col(f"`{n}`")
    suffix = F.nullif(F.regexp_extract(c("source"), r"\.([a-z]{2,})$", 1), F.lit(""))
    return docs.select(c("doc_id"), c("text"), c("lang").alias("declared"), suffix.alias("suffix"), c("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """The evidence of a table of web pages: the language in the markup, the suffix and host of the address, the text without markup."""
    c = lambda n: F.col(f"`{n}`")
    first = lambda col, pattern: F.nullif(F.lower(F.regexp_extract(col, pattern, 1)), F.lit(""))
    host = first(c("url"), r"^[a-zA-Z]+://([^/:?#]+)")
    text = F.regexp_replace(F.regexp_replace(c("html"), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return pages.select(c("page_id").alias("doc_id"), text.alias("text"), first(c("html"), r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([a-z]+)""").alias("declared"),
                        F.nullif(F.substring_index(host, ".", -1), host).alias("suffix"), host.alias("host"))


def identify_all(docs: DataFrame, pages: DataFrame, **options) -> DataFrame:
    """Both tables as one table of evidence: doc_id (NULL for pages), lang, posterior, text_lang, declared, kind (document or page), page_id
    (NULL for documents)."""
    d, p = of_documents(docs), of_pages(pages)
    own = lambda rows, kind: rows.withColumns({"doc_id": F.col("doc_id").cast("string"), "kind": F.lit(kind)})
    found = identify(own(d, "document").unionByName(own(p, "page")), **options)
    of = lambda kind, rows: F.when(F.col("kind") == kind, F.col("doc_id").cast(rows.schema["doc_id"].dataType))
    return found.select(of("document", d).alias("doc_id"), "lang", "posterior", "text_lang", "declared", "kind", of("page", p).alias("page_id"))
