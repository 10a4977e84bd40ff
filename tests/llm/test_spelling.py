"""Spelling variants against a comparison of all pairs of words."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerloom.llm import spelling

from .helpers import DOCS, docs, rows


def brute(data, least=3):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    n = Counter()
    for r in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(by[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] is not None else None))
    return out


def found(df):
    got = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def variants(seed=2):
    """Words, their variants and chains of variants, with letters of one and of two bytes, upper case, and long words."""
    rng = random.Random(seed)
    letters = "abcdenoéÉ÷ÿ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(40)] + ["z" * 300, "nanana", "ananan", "ééééé"]
    for _ in range(150):
        w = rng.choice(words)
        i = rng.randrange(len(w))
        words.append(w[:i] + rng.choice(["", rng.choice(letters), w[i] + rng.choice(letters)]) + w[i + 1:])
    data = []
    for d in range(60):
        text = " ".join(rng.choice([w, w.upper() if w.isascii() else w]) for w in (words[int(len(words) * rng.random() ** 3)] for _ in range(60)))
        data.append((d, rng.choice([text, text.replace(" ", "-中"), text.replace(" ", "\n")]), "en", "s", None, None, None, None))
    return data


def test_equals_all_pairs(spark):
    data = variants() + rows()
    want = brute(data)
    assert sum(w[1] is not None for w in want) > 30 and any(w[2] not in (w[0], w[1]) for w in want)
    assert found(spelling.spelling_variants(docs(spark, data))) == want
    assert found(spelling.spelling_variants(docs(spark, data), shard_words=5)) == want         # many shards


def test_words_with_the_same_letters(spark):
    """One leaf of the trie holds all words; none is compared with all of them."""
    rng = random.Random(4)
    base = "aaaaannnnn"
    words = {"".join(rng.sample(base, 10)) for _ in range(150)}
    data = [(None, " ".join(w for w in sorted(words) for _ in range(3)), None, None, None, None, None, None)]
    assert found(spelling.spelling_variants(docs(spark, data), shard_words=5)) == brute(data)


def test_words_of_bytes():
    texts = ["Straße Été abcdeé 中abcdefĀÿghijk", "", None, "x", "abcdef"]
    got = spelling.words_of(pa.array(texts), [1, 2, 3, 4, 5]).to_pylist()
    assert got == ["straße", "abcdeé", "abcdef", "ÿghijk", "abcdef"]


def test_trie_reaches_what_the_budget_allows():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 3, (200, 1 + spelling.GROUPS)).astype(np.int32)
    v[:, 0] = v[:, 1:].sum(1)
    v = np.unique(v, axis=0)
    row, leaf = spelling.Trie(v, np.full(len(v), v.shape[1])).search(v)
    gap = v[:, None, 1:] - v[None, :, 1:]
    more, less = np.maximum(gap, 0).sum(2), np.maximum(-gap, 0).sum(2)
    want = (more <= 1) & (less <= 1) & (more >= less)
    assert set(zip(row.tolist(), leaf.tolist())) == set(zip(*[x.tolist() for x in np.nonzero(want)]))


def test_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.spelling_variants(docs(spark, [(1, None, None, None, None, None, None, None)])).count() == 0
