"""Searches by bounds against the full grid, and the pair matrix against blends scored one by one."""
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import search as se


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y == 0]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(11)
    data = []
    for i in range(240):
        y = int(rng.random() < 0.4)
        a, b = round(rng.random() * 0.8 + 0.2 * y, 2), round(rng.random() * 0.5 + 0.3 * y, 1)
        data.append((i, y, a, b, rng.random(), rng.choice(["f1", "f2", None]), rng.choice(["strict", "partial", "cold"]), rng.choice(["first", "second"])))
    data.append((900, 1, None, 0.5, 0.5, "f1", "cold", "first"))
    return data, spark.createDataFrame(data, "id long, label int, a double, b double, c double, fold string, segment string, half string")


def grid(spark, d):
    return [r.asDict() for r in se.simplex(spark, ["a", "b", "c"], d).orderBy("a", "b", "c").collect()]


@pytest.mark.parametrize("bins", [4, 2048])
def test_bounds_hold_the_auc(spark, scores, bins):
    data, df = scores
    weights = grid(spark, 5)
    found = se.auc_bounds(df, "label", ["a", "b", "c"], weights, ["fold"], bins)
    for fold in ("f1", "f2", None):
        for i, w in enumerate(weights):
            rows = [(r[1], round(w["a"] * r[2] + w["b"] * r[3] + w["c"] * r[4], 12)) for r in data if r[5] == fold and r[2] is not None]
            low, high = found[(fold or "", i)]
            assert low - 1e-12 <= brute_auc(rows) <= high + 1e-12
            assert w["c"] == 0 or high - low <= (1 if bins == 4 else 0.05)      # without c most scores are tied


def test_best_mean_equals_the_full_grid(spark, scores):
    _, df = scores
    weights = grid(spark, 10)
    every = se.candidate_auc(df, "label", ["a", "b", "c"], weights, ["fold"]).groupBy("candidate").agg(F.avg("auc").alias("m")).collect()
    want = min(((-round(r.m, 12), r.candidate) for r in every))
    score, best = se.best_mean_auc(df, "label", ["a", "b", "c"], weights, "fold")[0][:2]
    assert (score, best) == (-want[0], weights[want[1]])
    assert len(se.best_mean_auc(df, "label", ["a", "b", "c"], weights, "fold")) < len(weights) / 2        # the others were not scored
    assert se.best_mean_auc(df.filter("label = 1"), "label", ["a", "b", "c"], weights, "fold") == []
    assert se.best_mean_auc(df.filter("id < 0"), "label", ["a", "b", "c"], weights, "fold") == []


def test_pair_matrix_equals_single_blends(scores):
    data, df = scores
    weights = (0.0, 0.5, 1.0)
    d = df.filter("a IS NOT NULL")
    matrix = se.BlendMatrix(se.direct_options(d, "a", "b", weights), "label", "score", "segment", "option", ("strict", "partial", "cold"), 3)
    cut = se.BlendMatrix(se.direct_options(d, "a", "b", weights), "label", "score", "segment", "option", ("strict", "partial", "cold"), 3, max_rows=16)
    for choice in product(range(3), repeat=3):
        w = dict(zip(("strict", "partial", "cold"), (weights[i] for i in choice)))
        for part in ("all", "first", "second"):
            rows = [(r[1], round((1 - w[r[6]]) * r[2] + w[r[6]] * r[3], 12)) for r in data if r[2] is not None and part in ("all", r[7])]
            assert abs(matrix.auc(choice, part) - brute_auc(rows)) < 1e-12
            assert matrix.auc(choice, part) == cut.auc(choice, part)
