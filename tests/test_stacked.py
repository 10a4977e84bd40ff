"""Operators on many columns: values by brute force, and plans that do not grow with the number of columns."""
import math
import random
import re
from collections import Counter

import pytest

from ledgerloom.operators import distribution as di, entity as en, frequency as fq, segments as sg

COLUMNS = ["a", "b", "c", "d", "e", "f"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(5)
    data = [(i, rng.choice(["x", "x", "x", "y", None]), *[rng.choice([None, 0.0, -0.0, 1.0, float(rng.randrange(9))]) for _ in COLUMNS]) for i in range(120)]
    return data, spark.createDataFrame(data, "id long, k string, " + ", ".join(f"{c} double" for c in COLUMNS))


def exchanges(df):
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))


def norm(v):
    return None if v is None else v + 0.0


def test_distributions(frame):
    data, df = frame
    wanted = [(["k"], c, f"z_{c}") for c in COLUMNS]
    got = {r.id: r for r in di.value_distributions(df, wanted).collect()}
    assert len(got) == len(data)
    for i, c in enumerate(COLUMNS):
        counts = Counter((r[1], str(r[2 + i])) for r in data)
        for r in data:
            mine = {v: n for (k, v), n in counts.items() if k == r[1]}
            total, own = sum(mine.values()), counts[r[1], str(r[2 + i])]
            row = got[r[0]]
            assert (row[f"z_{c}_nunique"], row[f"z_{c}_is_mode"]) == (len(mine), int(own == max(mine.values())))
            assert row[f"z_{c}_share"] == pytest.approx(own / total)
            assert row[f"z_{c}_entropy"] == pytest.approx(-sum(n / total * math.log(n / total) for n in mine.values()), abs=1e-9)
    few = di.value_distributions(df, wanted[:2])
    assert exchanges(few) == exchanges(di.value_distributions(df, wanted))


def test_cooccurrences(frame):
    data, df = frame
    wanted = [(a, b, f"{a}{b}") for a, b in zip(COLUMNS, COLUMNS[1:])]
    got = {r.id: r for r in di.cooccurrences(df, wanted).collect()}
    for i, (_, _, p) in enumerate(wanted):
        pairs = Counter((str(r[2 + i]), str(r[3 + i])) for r in data)
        for r in data:
            x, y = str(r[2 + i]), str(r[3 + i])
            first = sum(n for (a, _), n in pairs.items() if a == x)
            assert got[r[0]][f"{p}_given_first"] == pytest.approx(pairs[x, y] / first)
            assert got[r[0]][f"{p}_second_nunique"] == sum(b == y for _, b in pairs)
    assert exchanges(di.cooccurrences(df, wanted[:2])) == exchanges(di.cooccurrences(df, wanted))


def test_frequencies(frame):
    data, df = frame
    history = df.filter("id < 60")
    got = {r.id: r for r in fq.frequency(df, history, COLUMNS).collect()}
    back = {r.id: r for r in fq.normalized_frequency(df, COLUMNS).collect()}
    for i, c in enumerate(COLUMNS):
        n, every = Counter(str(r[2 + i]) for r in data if r[0] < 60), Counter(str(r[2 + i]) for r in data if r[2 + i] is not None)
        for r in data:
            assert got[r[0]][f"{c}_freq"] == pytest.approx(n[str(r[2 + i])] / 60)
            assert back[r[0]][f"{c}_fe"] == pytest.approx(-1.0 if r[2 + i] is None else every[str(r[2 + i])] / sum(every.values()))
    assert exchanges(fq.frequency(df, history, COLUMNS[:2])) == exchanges(fq.frequency(df, history, COLUMNS))


def test_distinct_counts_and_wide_profile(frame):
    data, df = frame
    got = {r.id: r for r in fq.distinct_counts(df, COLUMNS, ["k"]).collect()}
    wide = {r.id: r for r in en.wide_profile(df, ["k"], COLUMNS, []).collect()}
    for i, c in enumerate(COLUMNS):
        for r in data:
            mine = [norm(x[2 + i]) for x in data if x[1] == r[1]]
            n = len({v for v in mine if v is not None})
            assert got[r[0]][f"k_{c}_ct"] == n and wide[r[0]][f"wide_{c}_nunique_rate"] == pytest.approx(n / len(mine))
    assert exchanges(fq.distinct_counts(df, COLUMNS[:2], ["k"])) == exchanges(fq.distinct_counts(df, COLUMNS, ["k"]))
    assert exchanges(en.wide_profile(df, ["k"], COLUMNS[:2], [])) == exchanges(en.wide_profile(df, ["k"], COLUMNS, []))


def test_fold_membership_equals_one_fold_at_a_time(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, rng.randrange(100), rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "p", "q"])) for i in range(200)], "id long, day int, u int, w string")
    groups, folds = {"s": (("u", "w"), 5), "t": (("u",), 5), "v": (("w",), 5)}, ((30, 40, 60), (50, 55, None), (30, 50, 70))
    want = None
    for n, (end, start, stop) in enumerate(folds):
        valid = df.filter(f"day >= {start}" + (f" AND day < {stop}" if stop else ""))
        part = sg.membership(valid, df.filter(f"day < {end}"), groups).selectExpr("*", f"{n} AS fold")
        want = part if want is None else want.unionByName(part)
    got = sg.fold_membership(df, "day", folds, groups)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda d: sorted(map(str, (r.asDict() for r in d.select(*sorted(d.columns)).collect())))
    assert key(got) == key(want)
    assert exchanges(got) == exchanges(sg.fold_membership(df, "day", folds[:1], groups))
