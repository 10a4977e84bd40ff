"""Operators 3 and 10 against brute force over all pairs."""
import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import line_dedup, near_dup

from .helpers import docs, plain, rows, words

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def brute_components(data, k, percent):
    sets = {}
    for r in data:
        w = split(r[1])
        sets[r[0]] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    ids = sorted(i for i in sets if i is not None)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in ids:
        for j in ids:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,percent,bands", [(3, 85, 10), (5, 80, 12)])
def test_components_against_all_pairs(spark, k, percent, bands):
    data = rows(seed=8, n=120)
    got = near_dup.near_duplicates(docs(spark, data), k, percent, bands).collect()
    want = brute_components(data, k, percent)
    assert len(got) == len(data)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_a_large_group_of_near_copies(spark):
    import random
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    texts = []
    for _ in range(300):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = f"n{rng.randrange(99999)}"
        texts.append(" ".join(t))
    data = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(plain(spark, *texts)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(data, 3, 85).items()}


def test_components_of_near_copies_are_formed_at_the_end(spark, monkeypatch):
    """Components are formed for the buckets left open and at the end, not once a round."""
    import random
    rng = random.Random(12)
    base, texts = [f"w{k}" for k in range(120)], []
    for _ in range(400):
        t = list(base)
        for _ in range(rng.randint(1, 6)):
            t[rng.randrange(len(t))] = f"n{rng.randrange(99999)}"
        texts.append(" ".join(t))
    calls, components = [], near_dup.components
    monkeypatch.setattr(near_dup, "components", lambda edges: calls.append(1) or components(edges))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(plain(spark, *texts)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(texts)), 3, 85).items()}
    assert len(calls) <= 2


def test_buckets_that_leaders_and_neighbours_do_not_settle(spark, monkeypatch):
    """Pairs of near copies of one template, in a single table of small and large buckets: every similar pair of a bucket is linked."""
    import random
    rng = random.Random(15)
    texts = []
    for group, pairs in enumerate([40, 3, 3, 3, 3, 3]):
        base = [f"g{group}w{k}" for k in range(90)]
        for pair in range(pairs):
            t = base[:70] + [f"g{group}p{pair}w{k}" for k in range(20)]
            texts += [" ".join(t), " ".join(t[:-1] + [f"end{pair}"])]
    rng.shuffle(texts)
    sets = [set(near_dup.shingle_sets(pa.array([t]), 3).__next__().tolist()) for t in texts]
    hashes = [tuple(near_dup.minhashes(np.array(sorted(s), np.uint64), 2).tolist()) for s in sets]
    want = {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if hashes[i] == hashes[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                want[i] = want[j]
    size = collections.Counter(hashes).values()
    assert max(size) > 40 and any(3 <= n <= 8 for n in size) and len(set(want.values())) < len(texts) - 20
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 16, raising=False)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(plain(spark, *texts), bands=1, rows=1).collect()}
    assert got == want


def test_one_id_with_different_texts(spark):
    """Rows are judged by their own text: links of texts that share a doc_id are not lost, and none of them takes the other along."""
    rng = random.Random(31)
    x, y, z = (words(rng, 60) for _ in range(3))
    near = lambda t: t + " one"
    data = [(3, x), (5, near(x)), (5, y), (7, near(y)), (8, z), (9, near(z)), (5, near(x)), (None, x)]
    d = docs(spark, [(i, t, "en", "s0", None, None, None, None) for i, t in data])
    got = sorted((r.doc_id if r.doc_id is not None else -1, -1 if r.component_id is None else r.component_id, r.kept) for r in near_dup.near_duplicates(d).collect())
    assert got == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False), (5, 5, True), (7, 5, False), (8, 8, True), (9, 8, False)]
    kept = near_dup.keep_first(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(-1, x), (3, x), (5, y), (8, z)])


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(docs(spark).limit(0)).count() == 0
    r = near_dup.near_duplicates(plain(spark, None, "", "a")).orderBy("doc_id").collect()
    assert [(x.n_shingles, x.component_id, x.kept) for x in r] == [(0, 0, True), (0, 1, True), (1, 2, True)]


def test_minhashes_estimate_similarity():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 1000).astype(np.uint64)
    b = a.copy()
    b[:100] = r.integers(0, 2**63, 100).astype(np.uint64)
    agree = (near_dup.minhashes(a, 600) == near_dup.minhashes(b, 600)).mean()
    assert abs(agree - 900 / 1100) < 0.06


def brute_lines(data, least=1):
    """Removed line numbers by (doc_id, text)."""
    records = sorted({(r[0], r[1] or "") for r in data if r[0] is not None})
    lines = sorted((d, i, t) for d, t in records for i in range(t.count("\n") + 1))
    gone, seen = collections.defaultdict(list), []
    for d, i, t in lines:
        s = set(split(t.split("\n")[i]))
        if len(s) < least:
            continue
        if any(9 * len(s & x) >= 4 * (len(s) + len(x)) for x in seen):
            gone[d, t].append(i)
        seen.append(s)
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_all_pairs(spark, seed):
    data = rows(seed, 90)
    d = docs(spark, data)
    want = brute_lines(data)
    got = line_dedup.removed_lines(d).collect()
    hashes = {r.h: r.text for r in d.selectExpr("coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS h").collect()}
    assert {(r.doc_id, hashes[r.of_text]): list(r.removed) for r in got} == dict(want)
    assert line_dedup.dedup_report(d).count() == len(data)


def test_the_query_takes_short_lines(spark, tmp_path):
    from ledgerloom.llm.queries import QUERIES
    texts = ["all rights reserved.\nhome\na b c d", "Home\nall rights reserved.\nhome page", "a b c d e\na b c\nd\n\n", "a b c x\nreserved. ALL rights\na b c d f g", "c b a\nhome\n\nx y\na b c"]
    plain(spark, *texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed for r in QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()}
    want = brute_lines(list(enumerate(texts)), least=1)
    assert got == {i: ",".join(map(str, want.get((i, t), []))) for i, t in enumerate(texts)}
    assert want[1, texts[1]] == [0, 1] and want[2, texts[2]] == [0]


def test_lines_of_a_large_group(spark):
    import random
    rng = random.Random(6)
    base = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(400):
        t = list(base)
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(40)] = f"n{rng.randrange(9999)}"
        texts.append(" ".join(t))
    data = [(i, t) for i, t in enumerate(texts)]
    got = {(r.doc_id, texts[r.doc_id]): list(r.removed) for r in line_dedup.removed_lines(plain(spark, *texts)).collect()}
    assert got == dict(brute_lines(data))


def test_lines_cut_out(spark):
    a = "one two three four five six\nshort line"
    d = plain(spark, a, "new words here that nobody else has\none two three four five SIX\n\nend", "one two three four five six", "", None)
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.dedup_lines(d).collect()}
    assert got == {0: (a, None), 1: ("new words here that nobody else has\n\nend", 40), 3: ("", None), 4: (None, None)}
    assert line_dedup.dedup_lines(d).columns == d.columns
    assert line_dedup.dedup_report(d.limit(0)).count() == 0


def test_lines_whose_nearest_by_bitmap_are_not_similar(spark, monkeypatch):
    """The first candidates of most lines fail, so that the second round has to find the match."""
    rng = random.Random(4)
    monkeypatch.setattr(line_dedup, "NEAREST", 1)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(250):
        t = list(base)
        for k in rng.sample(range(60), rng.randint(2, 12)):
            t[k] = f"n{rng.randrange(400)}"
        texts.append(" ".join(t) + "\n" + " ".join(rng.sample(t, rng.randint(45, 60))))
    data = list(enumerate(texts))
    got = {(r.doc_id, texts[r.doc_id]): list(r.removed) for r in line_dedup.removed_lines(plain(spark, *texts)).collect()}
    assert got == dict(brute_lines(data))


def test_lines_cut_out_beside_clashing_columns(spark):
    d = plain(spark, "one two three four five six", "new words\none two three four five SIX")
    for extra in ("_removed", "_of_text", "_doc_id_of", "_row", "_text", "removed", "a.b"):
        d = d.withColumn(extra, d.doc_id * 10)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert got[1].text == "new words" and got[1]["_row"] == got[1]["_removed"] == got[1]["a.b"] == 10
    assert line_dedup.dedup_lines(d).columns == d.columns


@pytest.mark.parametrize("everything", [False, True])
def test_bucket_pairs_in_any_batches(everything):
    import pyarrow as pa
    r = np.random.default_rng(9)
    n = 500
    token = np.sort(r.integers(0, 40, n))
    c = {"token": token, "id": np.arange(n), "doc_id": np.arange(n), "number": np.zeros(n, np.int64), "shape": np.int64(1) << 62 | r.integers(5, 9, n) << 32, "b0": r.integers(0, 4, n), "b1": np.zeros(n, np.int64)}
    batch = pa.RecordBatch.from_arrays([pa.array(v) for v in c.values()], names=list(c))
    if everything:
        batch = batch.append_column("items", pa.array([sorted({int(x) for x in r.integers(0, 3, 6)}) for _ in range(n)], pa.list_(pa.int64())))
    run = line_dedup._candidates(everything)
    key = lambda v: tuple(-1 if x is None else x for x in v)
    whole = sorted((x for b in run([batch]) for x in zip(*(b.column(k).to_pylist() for k in line_dedup.PAIR_NAMES))), key=key)
    parts = sorted((x for b in run([batch.slice(i, 37) for i in range(0, n, 37)]) for x in zip(*(b.column(k).to_pylist() for k in line_dedup.PAIR_NAMES))), key=key)
    assert whole == parts and len(whole) > 100


def first_round(texts, groups=4):
    """Batches of the first round's rows for texts, each a block of its own, in order of their groups as Spark deals them out."""
    class Sent:
        value = np.arange(1 << 10)
    parts = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], names=["doc_id", "text"]) for i, t in enumerate(texts)]
    return list(line_dedup._buckets(Sent, 1, groups)(iter(parts)))


def test_first_round_rows_travel_in_groups():
    """A block of texts has one row for each group of buckets, however many words it has; opened, no row that can meet another is missing."""
    rng = random.Random(8)
    base = [words(rng, 30) for _ in range(6)]
    texts = ["\n".join(rng.choice(base) + f" own{i}x{k} more{i}x{k}" for k in range(5)) for i in range(20)]
    sent = first_round(texts)
    assert all(b.num_rows <= 4 and b.schema.names == ["grp", "rows"] for b in sent)
    rows_of = lambda b: line_dedup._unpacked(b.column("rows"), len(line_dedup.ROW_NAMES))
    everything = sorted(map(tuple, np.concatenate([rows_of(b) for b in sent]).tolist()), key=lambda r: (r[0], r[2], r[3], r[1]))
    assert len(everything) > 300 > sum(b.num_rows for b in sent)
    often = collections.Counter(r[0] for r in everything)
    dealt = pa.Table.from_batches(sent).sort_by("grp")
    for size in (1, 7, 1000):
        opened = list(line_dedup._in_order(iter(dealt.to_batches(max_chunksize=size))))
        got = [r for b in opened for r in zip(*(b.column(k).to_pylist() for k in line_dedup.ROW_NAMES))]
        for b in opened:
            own = list(zip(*(b.column(k).to_pylist() for k in ("token", "doc_id", "number", "id"))))
            assert own == sorted(own)
        assert sorted(got, key=lambda r: (r[0], r[2], r[3], r[1])) == [r for r in everything if often[r[0]] > 1]
        assert len({t for b in opened for t in set(b.column("token").to_pylist())}) == sum(len(set(b.column("token").to_pylist())) for b in opened)


@pytest.mark.parametrize("bits", [4, 18])
def test_word_counts_travel_in_blocks(spark, bits):
    """Counts of many tasks come to as many as there are words, in a row for each 1,024 places."""
    texts = [" ".join(f"v{k}" for k in range(i, i + 50)) for i in range(40)] + ["", None]
    d = plain(spark, *texts).select("text").repartition(5)
    got = line_dedup.token_counts_by_bucket(d, bits)
    assert len(got) == 1 << bits and got.sum() == 2000
    if bits == 18:
        assert sorted(got[got > 0].tolist()) == sorted(collections.Counter(w for t in texts for w in split(t)).values())
    sent = list(line_dedup._counted(bits)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert sum(b.num_rows for b in sent) <= max(1, (1 << bits) >> 10)


def test_no_shuffle_of_a_row_for_each_word(spark, monkeypatch):
    """What the first round sends has rows by blocks and groups, not by words; a pair's later line goes without a look at all classes."""
    rng = random.Random(3)
    made = []
    monkeypatch.setattr(line_dedup, "save", lambda df, save=line_dedup.save: made.append(df) or save(df))
    base = [words(rng, 60) for _ in range(20)]
    texts = ["\n".join(rng.choice(base) + f" own{i}" for _ in range(4)) for i in range(60)]
    got = {(r.doc_id, texts[r.doc_id]): list(r.removed) for r in line_dedup.removed_lines(plain(spark, *texts)).collect()}
    assert got == dict(brute_lines(list(enumerate(texts)))) and got
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(grp" in plan and "hashpartitioning(token" not in plan
    assert not any("named_struct" in df._jdf.queryExecution().analyzed().toString() for df in made)


def test_words_as_numbers():
    import pyarrow as pa
    from ledgerloom.llm.common import utf8
    from ledgerloom.llm.words import word_hashes
    texts = ["a b  c a", None, "", " b\ta ", "B", "long" * 5 + " " + "long" * 5 + "x", "x" * 8 + " " + "x" * 9, "ab", "a"]
    h, first = word_hashes(*utf8(pa.array(texts)), lower=True)
    words = [w for t in texts for w in split(t)]
    assert first.tolist() == np.concatenate([[0], np.cumsum([len(split(t)) for t in texts])]).tolist()
    assert len({(w, int(x)) for w, x in zip(words, h)}) == len(set(words)) == len(set(h.tolist()))
