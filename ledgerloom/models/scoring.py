"""Scores from Spark MLlib: boosted trees over a feature view, out-of-fold scores, bagging, drift weights, a linear meta
model. Missing numbers are -1, as the trees have no notion of missing."""
from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..operators.blend import with_bounded
from ..operators.folds import hash_sample, windows
from ..operators.joins import attach_bounded
from ..operators.ranks import auc, quantiles
from ..sources.store import save

TREES = {"maxIter": 10, "maxDepth": 4, "stepSize": 0.2, "subsamplingRate": 0.8, "minInstancesPerNode": 20}


def assemble(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    d = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"_f_{c}") for c in features])
    made = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features").transform(d)
    return made.select(*keep, "features")


def fit_trees(history: DataFrame, features: list[str], label: str, seed: int = 42, weight: str | None = None,
              valid: DataFrame | None = None, **params):
    """Trees on the history; with `valid`, training stops when the later window stops improving."""
    keep = [label] + ([weight] if weight else [])
    rows = assemble(history, features, keep)
    model = GBTClassifier(labelCol=label, featuresCol="features", seed=seed, **(TREES | params))
    if weight:
        model = model.setWeightCol(weight)
    if valid is not None:
        rows = rows.withColumn("_valid", F.lit(False)).unionByName(
            assemble(valid, features, keep).withColumn("_valid", F.lit(True)))
        model = model.setValidationIndicatorCol("_valid")
    return model.fit(save(rows.withColumn(label, F.col(label).cast("double"))))


def score(model, df: DataFrame, features: list[str], keep: list[str], out: str) -> DataFrame:
    d = model.transform(assemble(df, features, keep))
    return d.select(*keep, vector_to_array("probability")[1].alias(out))


def out_of_fold(df: DataFrame, day: str, folds: tuple, features: list[str], label: str, row_id: str, out: str,
                seed: int = 42, **params) -> DataFrame:
    """Scores of every fold's validation rows by a model of that fold's history."""
    parts = []
    for n, (end, start, stop) in enumerate(folds):
        history, valid = windows(df, day, end, start, stop)
        model = fit_trees(history, features, label, seed, **params)
        parts.append(score(model, valid, features, [row_id, label], out).withColumn("fold", F.lit(n)))
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return save(d)


def bagged(history: DataFrame, query: DataFrame, features: list[str], label: str, row_id: str, seeds: Iterable[int],
           out: str, extra: list[str] = (), **params) -> DataFrame:
    """One score column per seed and their mean."""
    d = None
    for s in seeds:
        one = score(fit_trees(history, features, label, s, **params), query, features, [row_id, *extra], f"{out}_{s}")
        d = one if d is None else d.join(one.drop(*extra), row_id)
    cols = [F.col(f"{out}_{s}") for s in seeds]
    return d.withColumn(out, sum(cols[1:], cols[0]) / len(cols))


def seed_subsets(scores: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """AUC of the mean of every subset of score columns, in one job."""
    subsets = [s for n in range(1, len(columns) + 1) for s in combinations(columns, n)]
    means = [F.struct(F.lit("+".join(s)).alias("subset"),
                      F.round(sum((F.col(c) for c in s[1:]), F.col(s[0])) / len(s), 12).alias("x")) for s in subsets]
    long = scores.select(label, F.explode(F.array(*means)).alias("_s")).select(label, "_s.*")
    return auc(long, label, "x", ["subset"])


def _subset_means(columns: list[str], low: int, high: int):
    """(mask, mean of its columns) of the subsets low..high-1, bit k of a mask for column k. Masks share their sums: the sum of a mask is that of
    the mask without its highest bit plus one column, built up as one array."""
    sums = F.array(F.lit(0.0))
    for c in columns:
        value = F.col(c).cast("double")
        sums = F.concat(sums, F.transform(sums, lambda s: s + value))
    part = F.slice(sums, low + 1, high - low)
    mask = lambda i: i + F.lit(low)
    return F.transform(part, lambda s, i: F.struct(mask(i).alias("mask"), F.round(s / F.bit_count(mask(i)), 12).alias("x")))


def subset_lattice(scores: DataFrame, label: str, columns: list[str], batch: int = 64) -> DataFrame:
    """(mask, rows, auc) for the mean of every subset of score columns.

    Subsets are scored `batch` at a time, each batch's result written before the next, so rows are never multiplied by more than `batch`.
    """
    d, out = scores.select(label, *columns), None
    for low in range(1, 1 << len(columns), batch):
        high = min(low + batch, 1 << len(columns))
        long = d.select(label, F.explode(_subset_means(columns, low, high)).alias("_s")).select(label, "_s.*")
        one = save(auc(long, label, "x", ["mask"]))
        out = one if out is None else out.unionByName(one)
    return out


def apply_best_subset(scores: DataFrame, lattice: DataFrame, columns: list[str], out: str) -> DataFrame:
    """The mean of the subset of the largest AUC (to 12 digits; of equals the fewest columns, then the smallest mask) on every row."""
    key = F.struct(F.round("auc", 12), -F.bit_count("mask"), -F.col("mask"))
    best = lattice.agg(F.max_by("mask", key).alias("_mask")).withColumn("_one", F.lit(1))
    d = attach_bounded(scores.withColumn("_one", F.lit(1)), best, ["_one"])
    bits = [F.col("_mask").bitwiseAND(F.lit(1 << k)) != 0 for k in range(len(columns))]
    total = sum((F.when(b, F.col(c)).otherwise(0.0) for b, c in zip(bits, columns)), F.lit(0.0))
    return d.withColumn(out, total / F.bit_count("_mask")).drop("_mask", "_one")


def leave_one_month(history: DataFrame, query: DataFrame, month: str, months: list, features: list[str], label: str,
                    row_id: str, out: str, extra: list[str] = (), **params) -> DataFrame:
    """Mean score of models that each leave one month of the history out."""
    d, cols = None, []
    for i, m in enumerate(months):
        model = fit_trees(history.filter(F.col(month) != m), features, label, 42 + i, **params)
        one = score(model, query, features, [row_id, *extra], f"{out}_{m}")
        d = one if d is None else d.join(one.drop(*extra), row_id)
        cols.append(F.col(f"{out}_{m}"))
    return d.withColumn(out, sum(cols[1:], cols[0]) / len(cols))


def drift_weights(history: DataFrame, query: DataFrame, features: list[str], row_id: str, seed: int = 7, out: str = "weight",
                  max_history_rows: int | None = None, **params) -> DataFrame:
    """Odds that a history row looks like the query, clipped and scaled to mean one, clipped and scaled again.

    The classifier is fitted on the query and on `max_history_rows` rows of the history, chosen by hash; None takes all. Every
    history row gets a weight either way.
    """
    n_query, n_history = query.count(), history.count()
    used = n_history if max_history_rows is None else min(n_history, max_history_rows)
    sample = history if used == n_history else hash_sample(history, row_id, used, seed)
    both = sample.withColumn("_side", F.lit(0)).unionByName(query.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    model = fit_trees(both, features, "_side", seed, **params)
    ratio = used / max(n_query, 1)
    d = save(score(model, history, features, [row_id], "_p"))
    p = F.least(F.greatest(F.col("_p"), F.lit(0.02)), F.lit(0.98))
    d = d.withColumn(out, ratio * p / (1 - p))
    for clip in (True, False):
        d = with_bounded(d, d.agg(F.avg(out).alias("_m"))).withColumn(out, F.col(out) / F.col("_m")).drop("_m")
        if clip:
            d = d.withColumn(out, F.least(F.greatest(F.col(out), F.lit(0.25)), F.lit(4.0)))
    return d.select(row_id, out)


def weight_summary(df: DataFrame, weight: str) -> DataFrame:
    one = df.withColumn("_one", F.lit(1))
    q = quantiles(one, ["_one"], weight, {"q05": 0.05, "q95": 0.95}).drop("_one")
    return with_bounded(df.agg(F.min(weight).alias("min"), F.max(weight).alias("max"), F.avg(weight).alias("mean")), q)


def linear_meta(train: DataFrame, query: DataFrame, features: list[str], label: str, row_id: str, out: str, c: float = 0.2,
                extra: list[str] = ()) -> DataFrame:
    """Logistic regression on standardised features with balanced classes; the penalty is 1/(c * rows)."""
    n, positives = train.agg(F.count(F.lit(1)), F.sum(label)).first()
    share = {1: n / (2.0 * positives), 0: n / (2.0 * (n - positives))}
    rows = assemble(train, features, [label]).withColumn("_w", F.when(F.col(label) == 1, share[1]).otherwise(share[0]))
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    rows = save(rows.withColumn(label, F.col(label).cast("double")))
    fitted = scaler.fit(rows)
    model = LogisticRegression(labelCol=label, featuresCol="scaled", weightCol="_w", regParam=1.0 / (c * n),
                               standardization=False, maxIter=100).fit(fitted.transform(rows))
    d = model.transform(fitted.transform(assemble(query, features, [row_id, label, *extra])))
    return d.select(row_id, label, *extra, vector_to_array("probability")[1].alias(out))


def grid(train: DataFrame, dev: DataFrame, views: dict[str, list[str]], params: list[dict], label: str, row_id: str) -> list[dict]:
    """Dev AUC of every view and parameter set, best first; the folds are temporal, so no CrossValidator."""
    rows = []
    for view, features in views.items():
        for i, p in enumerate(params):
            d = score(fit_trees(train, features, label, 42, **p), dev, features, [row_id, label], "s")
            rows.append({"view": view, "config": i, "features": len(features), "auc": auc(d, label, "s").first()["auc"]})
    return sorted(rows, key=lambda r: (-r["auc"], r["features"], r["view"], r["config"]))
