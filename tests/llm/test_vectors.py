"""Near-duplicate vectors against all pairs."""
import math

import numpy as np
import pytest

from ledgerloom.llm import vector_dedup

SCHEMA = "vec_id bigint, embedding array<float>, label int, cell string, id string, w int"


def brute(data, threshold=0.93):
    """{row: (vec_id, n_links, component_id, kept)}"""
    good = [i for i, (v, e, g, *_) in enumerate(data) if v is not None and g is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    x = {i: np.array(data[i][1], np.float32).astype(float) for i in good}
    x = {i: v / np.abs(v).max() for i, v in x.items()}
    x = {i: v / np.sqrt((v * v).sum()) for i, v in x.items()}
    near = {i: [j for j in good if j != i and data[i][2] == data[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold] for i in good}
    out = []
    for i, r in enumerate(data):
        if i not in x:
            out.append((r[0], 0, r[0], True))
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(data[j][0] for j in seen)
        out.append((r[0], len(near[i]), least, r[0] == least))
    return sorted(out, key=str)


def sample(seed=3, groups=40, dim=24, labels=3):
    """Groups of near copies around random centres, some at the threshold, and single vectors."""
    rng = np.random.default_rng(seed)
    data = []
    for _ in range(groups):
        base, label = rng.normal(size=dim), int(rng.integers(labels))
        for _ in range(int(rng.integers(1, 9))):
            data.append((base + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.25])).astype(np.float32).tolist() + [label])
    order = rng.permutation(len(data))
    return [(i, data[k][:-1], int(data[k][-1]), "x", "y", 1) for i, k in enumerate(order)]


def found(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)


def test_equals_all_pairs(spark):
    data = sample()
    n = len(data)
    odd = [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [1e-30] * 24, [1e30] * 24, [-0.0, 1.0] + [0.0] * 22, [0.0, 1.0] + [0.0] * 22,
           [1.0] * 23]
    data += [(n + i, v, 1, "x", "y", 1) for i, v in enumerate(odd)]
    data += [(None, data[0][1], data[0][2], "x", "y", 1), (n + 50, data[0][1], None, "x", "y", 1), (2, data[0][1], data[0][2], "x", "y", 1), data[0], data[0]]
    df = spark.createDataFrame(data, SCHEMA)
    assert found(vector_dedup.near_vectors(df)) == brute(data)                                              # one cell a label
    assert found(vector_dedup.near_vectors(df, cell_rows=20, fit_rows=200, reach=50)) == brute(data)        # cells that overlap fully


def test_recall_of_cells(spark):
    """Links found with production reach in cells of a few dozen vectors, many of them near the threshold; none is made up."""
    data = sample(5, groups=300, dim=64, labels=1)
    want = brute(data)
    got = found(vector_dedup.near_vectors(spark.createDataFrame(data, SCHEMA), cell_rows=200, fit_rows=400))
    total, seen = sum(r[1] for r in want), sum(r[1] for r in got)
    assert 0.97 * total <= seen <= total
    assert sum(a != b for a, b in zip(sorted(got, key=lambda r: r[0]), sorted(want, key=lambda r: r[0]))) <= 0.03 * len(want)


def test_dense_group_and_empty(spark):
    """A group that no split can shrink is compared block by block."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    data = [(i, (base + rng.normal(size=16) * 0.01).astype(np.float32).tolist(), 4, None, None, None) for i in range(120)]
    got = found(vector_dedup.near_vectors(spark.createDataFrame(data, SCHEMA), cell_rows=30))
    assert got == brute(data) and {r[1] for r in got} == {119}
    assert vector_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
