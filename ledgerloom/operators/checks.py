"""Contracts between stages, each as one small aggregate row or a column test."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .joins import attach_bounded, drop_matching
from .timeline import HALO, Timeline


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    gone = missing_columns(df, required)
    if gone:
        raise ValueError(f"missing columns: {gone}")
    return df


def require_no_label(df: DataFrame, label: str) -> DataFrame:
    if label in df.columns:
        raise ValueError(f"label {label} must not be in the query frame")
    return df


def output_contract(scores: DataFrame, template: DataFrame, row_id: str, score: str) -> DataFrame:
    """One row of counts, all zero for a valid output (apart from `rows`)."""
    gone = drop_matching(template, scores, [row_id]).agg(F.count(F.lit(1)).alias("missing_ids"))
    extra = drop_matching(scores, template, [row_id]).agg(F.count(F.lit(1)).alias("extra_ids"))
    own = scores.agg(F.count(F.lit(1)).alias("rows"),
                     (F.count(F.lit(1)) - F.count_distinct(row_id)).alias("duplicate_ids"),
                     F.count_if(F.col(score).isNull()).alias("null_scores"),
                     F.count_if((F.col(score) < 0) | (F.col(score) > 1)).alias("outside_scores"))
    out = own.withColumn("_one", F.lit(1))
    for part in (gone, extra):
        out = attach_bounded(out, part.withColumn("_one", F.lit(1)), ["_one"])      # one row each
    return out.drop("_one")


def same_ids(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    both = a.select(row_id, F.lit(1).alias("s")).unionByName(b.select(row_id, F.lit(-1).alias("s")))
    return (both.groupBy(row_id).agg(F.sum("s").alias("s")).agg(
        F.count_if(F.col("s") > 0).alias("only_left"), F.count_if(F.col("s") < 0).alias("only_right")))


def day_range(df: DataFrame, day: str, start: float, end: float) -> DataFrame:
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_if(
        (F.col(day) < start) | (F.col(day) >= end)).alias("outside"))


def score_difference(a: DataFrame, b: DataFrame, row_id: str, score: str) -> DataFrame:
    """Rows that differ and the largest difference between two score sets."""
    pair = a.select(row_id, F.col(score).alias("_a")).join(b.select(row_id, F.col(score).alias("_b")), row_id)
    delta = F.abs(F.col("_a") - F.col("_b"))
    return pair.agg(F.count(F.lit(1)).alias("rows"), F.count_if(delta > 0).alias("differ"),
                    F.max(delta).alias("max_delta"))


def metric_reproduced(measured: DataFrame, metric: str, stored: float, tolerance: float) -> DataFrame:
    return measured.withColumn("reproduced", (F.abs(F.col(metric) - F.lit(stored)) <= tolerance).cast("int"))


def metrics_reproduced(measured: DataFrame, stored: DataFrame, name: str, metric: str, tolerance: float) -> DataFrame:
    """Measured metrics against a stored table of them; a name that one side lacks is not reproduced."""
    s = stored.select(F.col(name).alias("_name"), F.col(metric).alias("stored"))
    d = measured.select(name, metric).join(s, F.col(name) == F.col("_name"), "full")
    near = F.coalesce(F.abs(F.col(metric) - F.col("stored")) <= tolerance, F.lit(False))
    return d.select(F.coalesce(name, "_name").alias(name), metric, "stored", near.cast("int").alias("reproduced"))


def input_files(sources: list[DataFrame]) -> DataFrame:
    """(path, rows) of every file the tables as read (`spark.read`, no further step) consist of. No column of the files is read, and
    the list of files stays a table. A file without rows does not show."""
    paths = [d.select(F.col("_metadata.file_path").alias("path")) for d in sources]
    d = paths[0]
    for p in paths[1:]:
        d = d.unionByName(p)
    return d.groupBy("path").agg(F.count(F.lit(1)).alias("rows"))


def forbidden_inputs(sources: list[DataFrame], patterns: list[str]) -> DataFrame:
    """(path, rows, pattern) of input files whose name matches a forbidden pattern, one row per pattern."""
    hits = F.array(*[F.when(F.col("path").rlike(p), F.lit(p)) for p in patterns])
    return input_files(sources).withColumn("pattern", F.explode(F.filter(hits, lambda h: h.isNotNull())))


def reader_contract(df: DataFrame, dt: str, row_id: str, label: str | None) -> DataFrame:
    """Rows, label placement and steps back in time when rows are taken in id order."""
    tl = Timeline(df.select(row_id, dt).withColumn("_all", F.lit(0)), ["_all"], [row_id])
    d = tl.with_neighbours(1, 0)
    d = d.withColumn("_back", F.lag(dt).over(Window.partitionBy(*tl.parts).orderBy(row_id)) > F.col(dt))
    return (d.filter(~F.col(HALO)).agg(F.count(F.lit(1)).alias("rows"), F.count_if("_back").alias("steps_back"))
            .withColumn("has_label", F.lit(int(label is not None and label in df.columns))))


def one_to_one(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join after a check that neither side repeats a key."""
    for side in (a, b):
        n = side.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*on).alias("u")).first()
        if n["n"] != n["u"]:
            raise ValueError(f"{n['n'] - n['u']} repeated keys")
    return a.join(b, on)


def coverage(df: DataFrame, table: DataFrame, row_id: str, fold: str) -> DataFrame:
    """Per fold: rows the table does not hold, and rows it holds in another fold."""
    right = table.select(F.col(row_id).alias("_id"), F.col(fold).alias("_fold"))
    d = df.join(right, F.col(row_id) == F.col("_id"), "left")
    return d.groupBy(fold).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_id").isNull()).alias("uncovered"),
                               F.count_if(F.col("_fold") != F.col(fold)).alias("fold_mismatch"))
