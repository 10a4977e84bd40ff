"""Small tables about data and scores: missing rates, label rates, contagion, metrics per segment, importances."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tokens import seeded
from .joins import attach
from .ranks import auc, ordinal, quantiles, rank_many


def missing_rates(df: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Columns and mean missing rate per family, from one pass over the rows."""
    one = df.agg(*[F.struct(F.lit(name).alias("family"), F.lit(len(cols)).alias("columns"),
                            F.avg(sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)) / len(cols)).alias("missing_rate"))
                   .alias(f"f{i}") for i, (name, cols) in enumerate(families.items())])
    return one.select(F.explode(F.array(*one.columns)).alias("_f")).select("_f.*")


def block_missingness(df: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """Lowest and highest missing rate of a block's columns, and share of rows that are all or nothing."""
    aggs = []
    for i, (name, cols) in enumerate(blocks.items()):
        filled = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
        rates = [F.avg(F.col(c).isNull().cast("double")) for c in cols]
        aggs.append(F.struct(F.lit(name).alias("block"), F.least(*rates).alias("lowest"), F.greatest(*rates).alias("highest"),
                             F.avg(filled.isin(0, len(cols)).cast("double")).alias("all_or_nothing")).alias(f"b{i}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*one.columns)).alias("_b")).select("_b.*")


def rate_by(df: DataFrame, bucket: Column, label: str, out: str = "bucket") -> DataFrame:
    return df.groupBy(bucket.alias(out)).agg(F.count(F.lit(1)).alias("rows"), F.avg(label).alias("rate"))


def contagion(df: DataFrame, key: list[str], label: str) -> DataFrame:
    """Label rate of rows in entities of several rows, with and without another positive row in the entity.

    Counted per entity: an entity with n rows and p positives has p positive rows, which see p-1 others.
    """
    e = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p")).filter("n > 1")
    seeing = F.when(F.col("p") >= 2, F.col("n")).when(F.col("p") == 1, F.col("n") - 1).otherwise(0)
    seeing_pos = F.when(F.col("p") >= 2, F.col("p")).otherwise(0)
    return e.agg(F.try_divide(F.sum(seeing_pos), F.sum(seeing)).alias("rate_with"),
                 F.try_divide(F.sum(F.col("p") - seeing_pos), F.sum(F.col("n") - seeing)).alias("rate_without"))


def shuffled_key(df: DataFrame, key: str, row_id: str, seed: int, out: str) -> DataFrame:
    """The same key values dealt to the rows in random order (a placebo); group sizes stay."""
    values = ordinal(df.select(row_id, key), [row_id], "_k").select("_k", F.col(key).alias(out))
    d = df.withColumn("_h", seeded(seed, row_id))
    return attach(ordinal(d, ["_h", row_id], "_k"), values, ["_k"]).drop("_k", "_h")


def segment_metrics(df: DataFrame, label: str, score: str, by: list[str], least: int = 0, max_rows: int | None = None) -> DataFrame:
    """Rows, positives, rate and AUC per group; small groups or those with one class can be left out."""
    d = auc(df, label, score, by, max_rows=max_rows).withColumn("rate", F.col("positives") / F.col("rows"))
    return d.filter((F.col("rows") >= least) & (F.col("positives") > 0)) if least else d


def metric_pivot(metrics: DataFrame, row: str, column: str, values: list[str], metric: str = "auc") -> DataFrame:
    return metrics.groupBy(row).pivot(column, values).agg(F.first(metric))


def rank_movement(df: DataFrame, base: str, candidate: str, by: str, max_rows: int | None = None) -> DataFrame:
    """Rows, Spearman with the base, median and largest absolute change of the rank, per group."""
    d = rank_many(df, [(base, "_b", ()), (candidate, "_c", ()), (base, "_sb", [by]), (candidate, "_sc", [by])], max_rows=max_rows)
    d = d.withColumn("_move", F.abs(F.col("_c") - F.col("_b")))
    t = d.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.corr("_sb", "_sc").alias("spearman"),
                          F.max("_move").alias("max_move"))
    return attach(t, quantiles(d, [by], "_move", {"median_move": 0.5}, max_rows), [by])


def recipe_table(df: DataFrame, label: str, recipes: list[str], part: Column, max_rows: int | None = None) -> DataFrame:
    """AUC of every recipe column over all rows and over each part, in one job."""
    long = df.select(label, F.explode(F.array(F.lit("all"), part)).alias("part"), F.explode(F.array(*[
        F.struct(F.lit(r).alias("recipe"), F.col(r).alias("x")) for r in recipes])).alias("_r")).select(label, "part", "_r.*")
    return auc(long, label, "x", ["recipe", "part"], max_rows=max_rows)


def label_correlation(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Absolute correlation with the label per column, as a stand-in importance."""
    one = df.agg(*[F.abs(F.corr(c, label)).alias(c) for c in columns])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("name", "importance"))


def top_columns(importance: DataFrame, k: int, forced: list[str]) -> DataFrame:
    """The forced columns first, then by importance, k in all. One row per column, so small."""
    first = F.array_position(F.array(*map(F.lit, forced)), F.col("name"))
    return (importance.withColumn("_f", F.when(first > 0, first).otherwise(len(forced) + 1))
            .orderBy("_f", F.desc("importance"), "name").limit(k).drop("_f"))


def importance_places(importance: DataFrame, names: list[str]) -> DataFrame:
    ranked = ordinal(importance.withColumn("_i", -F.col("importance")), ["_i", "name"], "place").drop("_i")
    return ranked.filter(F.col("name").isin(*names))


def family_share(importance: DataFrame, family: Column) -> DataFrame:
    from .blend import with_bounded
    t = importance.groupBy(family.alias("family")).agg(F.sum("importance").alias("_s"))
    return with_bounded(t, t.agg(F.sum("_s").alias("_t"))).select("family", (F.col("_s") / F.col("_t")).alias("share"))
