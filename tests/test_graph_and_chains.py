import random
from collections import defaultdict

import pytest

from ledgerloom.operators import chains, graph as gr


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, rng.randint(0, 40) if rng.random() > .1 else None, rng.randint(0, 30), rng.randint(0, 6)) for i in range(300)]
    return spark.createDataFrame(data, "id long, a int, b int, c int").cache()


KEYS = [(["a", "c"], 5), (["b", "c"], 4), (["a", "b"], 9)]


def greedy(stages, ids, cap):
    """Sequential rule: links in the order (stage, order, hub), members by id, refused above the cap."""
    parent = {i: i for i in ids}
    size = dict.fromkeys(ids, 1)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, _, hub, node in sorted(stages):
        x, y = find(hub), find(node)
        if x != y and size[x] + size[y] <= cap:
            parent[max(x, y)] = min(x, y)
            size[min(x, y)] += size[max(x, y)]
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("cap", [500, 12, 5])
def test_components_follow_the_sequential_rule(rows, cap):
    links = [(n, r["_order"], r["a"], r["b"]) for n, (k, c) in enumerate(KEYS) for r in gr.star_edges(rows, "id", k, c).collect()]
    ids = [r["id"] for r in rows.select("id").collect()]
    want = greedy(links, ids, cap)
    got = {r["id"]: r["component"] for r in gr.entity_components(rows, "id", KEYS, cap).collect()}
    assert got == want
    sizes = defaultdict(int)
    for c in got.values():
        sizes[c] += 1
    assert max(sizes.values()) <= cap


def test_group_limits(rows):
    r = gr.key_statistics(rows, "id", ["a", "c"], 2, "k").first()
    p = rows.toPandas().dropna()
    n = p.groupby(["a", "c"]).size()
    assert (r["valid_rows"], r["linked_groups"], r["oversized_groups"], r["edges"]) == (
        len(p), (n == 2).sum(), (n > 2).sum(), (n == 2).sum())


@pytest.fixture(scope="module")
def steps(spark):
    rng = random.Random(9)
    data, total = [], defaultdict(int)
    for i in range(400):
        uid, amount = rng.randint(0, 3), rng.choice([0, 1, 2, 3, 5])
        start = total[uid] + rng.choice([-1, 0, 0, 0, 1, 40])
        data.append((i, uid, rng.randint(0, 150), None if i % 23 == 0 else start, start + amount, start * 2, start * 2 + amount))
        total[uid] = start + amount if rng.random() > .3 else total[uid]
    return spark.createDataFrame(data, "id long, uid int, dt long, s long, e long, s2 long, e2 long").cache()


def walk(rows, start, end):
    """A dictionary of ends per uid, one row after the other in time order."""
    out = {}
    ends = defaultdict(dict)
    for pos, r in enumerate(sorted(rows, key=lambda r: (r["dt"], r["id"]))):
        known, found = ends[r["uid"]], []
        if r[start] is not None and r[end] is not None:
            found = [known[v] for v in (r[start] - 1, r[start], r[start] + 1) if v in known]
        out[r["id"]] = max(found)[1] if found else r["id"]
        if r[start] is not None and r[end] is not None:
            known[r[end]] = (pos, out[r["id"]])
    return out


@pytest.mark.parametrize("max_rows", [10**6, 16])
def test_counter_chains(steps, max_rows):
    got = chains.counter_chains(steps, "uid", "dt", "id", "s", "e", "chain", max_rows).collect()
    assert {r["id"]: r["chain"] for r in got} == walk(steps.collect(), "s", "e")
