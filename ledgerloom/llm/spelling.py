"""Spelling variants by a trie over letter-group counts (operator 13).

The letters are dealt into groups; a word's vector is its length and then the number of its letters in each group. The trie orders words by
these counts, one level per group. One inserted, deleted or replaced letter changes one count by one (insertion, deletion), or two counts by
one in opposite directions, or none (a replacement within a group). So a depth-first search for the variants of a word may pass a child whose
count is one lower (spending a surplus of one) or one higher (a deficit of one), each once; what it reaches at the leaves is verified.

1. `occurrences`: runs of letters of whole texts, cut and counted from the bytes of whole Arrow columns; then summed per word.
2. The trie is split at its nodes: a shard is the subtree of the highest node with at most `limit` words (`shards`, from prefix sums of the
   counted vectors), so a common length or letter does not make a long task. The limit grows with the vocabulary, so the top of the trie, which
   goes to all tasks, has a bounded number of nodes.
3. Each word lies in one shard and is sent to the shards that the search of the top reaches for it.
4. A task searches its subtree for all words sent there, level by level; of a leaf's words only those are compared that share the word's
   first or last half, one of which an edit leaves alone. So a leaf with very many words is not compared pair by pair.
5. A pair is found by its longer word, or by both if they are equally long; near words are counted and the form chosen per word.
6. Roots: forms have at least twice the count, so chains are short; pointers are doubled until none moves.

Defined cases: NULL texts have no runs; a NULL doc_id is the empty text before the colon; runs of any length are words; equal rows count as
often as they occur; ties of the form go to the smallest word in code-point order; an empty table gives no rows.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import columns, mix, save, slices, text_or_empty, utf8

LEAST_LETTERS = 5
GROUPS = 13               # a and n, b and o, ..: common and rare letters mix; other code points by their number
SHARD_WORDS = 20_000      # words of a shard, or the 8192nd part of the vocabulary
HELD_WORDS = 400_000      # words counted before they are handed on
QUERIES_AT_ONCE = 8192

_crc = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _crc = np.where(_crc & 1, (_crc >> np.uint32(1)) ^ np.uint32(0xEDB88320), _crc >> np.uint32(1))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- words and their counts

def runs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of letters, and the text it lies in. U+00C0 to U+00FF are the byte C3 and one more."""
    n = len(raw)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    lead = raw == 0xC3
    inside = _LETTER[raw] | lead
    inside[1:] |= lead[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts_at = off[:-1][off[:-1] < n]
    first[starts_at] = inside[starts_at]
    ends_at = off[1:][off[1:] > 0] - 1
    last[ends_at] = inside[ends_at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def words_of(texts: pa.Array, ids: list) -> pa.Array:
    """The words of at least LEAST_LETTERS code points that the runs of texts give, repeats included."""
    raw, off = utf8(texts)
    start, end, text = runs(raw, off)
    raw = _LOWER[raw]
    leads = np.concatenate([[0], np.cumsum(raw == 0xC3)])
    letters = end - start - (leads[end] - leads[start])
    long = letters >= LEAST_LETTERS
    start, end, text, letters = start[long], end[long], text[long], letters[long]
    # CRC-32 of "<doc_id>:" per text, carried on over the bytes of all runs at once, longest first
    begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(start - end, kind="stable")
    crc, at, size = begun[text[order]], start[order], (end - start)[order]
    left = len(order)
    for j in range(int(size[0]) if left else 0):
        left = int(np.searchsorted(-size[:left], -j, side="left"))
        c = crc[:left]
        crc[:left] = _crc[(c ^ raw[at[:left] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    h = np.empty(len(order), np.uint32)
    h[order] = crc ^ np.uint32(0xFFFFFFFF)
    keep = np.ones(len(raw), bool)
    size = end - start
    cut = np.flatnonzero(h % 97 == 0)
    if len(cut):
        # the byte of the code point to delete: the one at which so many code points of the run have begun
        begins = np.flatnonzero((raw & 0xC0) != 0x80)
        gone = begins[np.searchsorted(begins, start[cut]) + h[cut] % letters[cut]]
        wide = raw[gone] == 0xC3
        keep[gone] = False
        keep[gone[wide] + 1] = False
        size[cut] -= 1 + wide
        letters[cut] -= 1
    first = np.zeros(len(raw) + 1, np.int32)
    first[start] += 1
    first[end] -= 1
    data = raw[(np.cumsum(first[:-1]) > 0) & keep]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))
    return words if (letters >= LEAST_LETTERS).all() else words.filter(pa.array(letters >= LEAST_LETTERS))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in batches:
        for part in slices(batch):
            found = pc.value_counts(words_of(part.column("text"), part.column("doc_id").to_pylist()))
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            rows += len(found)
            if rows > HELD_WORDS:
                held = [summed()]
                rows = held[0].num_rows
                if rows > HELD_WORDS // 2:
                    yield from held[0].combine_chunks().to_batches(max_chunksize=20_000)
                    held, rows = [], 0
    if held:
        yield from summed().combine_chunks().to_batches(max_chunksize=20_000)


def occurrences(docs: DataFrame) -> DataFrame:
    """word, n."""
    d = columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text")).filter("text <> ''")
    return d.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# ---- the trie

def vectors(words: pa.Array) -> np.ndarray:
    """(words, 1 + GROUPS): code points, then letters of each group."""
    raw, off = utf8(words)
    out = np.zeros((len(off) - 1, 1 + GROUPS), np.int32)
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    row = np.searchsorted(off, begins, side="right") - 1
    code = raw[begins].astype(np.int64)
    wide = np.flatnonzero(code >= 0xC0)
    code[wide] = (code[wide] << 6) + raw[begins[wide] + 1]
    out[:, 1:] = np.bincount(row * GROUPS + (code - 97) % GROUPS, minlength=len(out) * GROUPS).reshape(-1, GROUPS)
    out[:, 0] = out[:, 1:].sum(1)
    return out


class Trie:
    """Nodes of each level as sorted codes parent * BASE + count; the leaves may lie at any level."""
    BASE = np.int64(1 << 32)

    def __init__(self, paths: np.ndarray, depth: np.ndarray):
        """`paths`: counts of each leaf, (leaves, levels); `depth`: how many of them count. No leaf is a prefix of another; leaves are numbered
        as given."""
        self.levels, self.leaf, self.root = [], [], -1
        node, alive = np.zeros(len(paths), np.int64), np.arange(len(paths))
        if len(paths) and not depth.all():          # the root is a leaf
            self.root = 0
            return
        for d in range(depth.max(initial=0)):
            codes, at = np.unique(node[alive] * self.BASE + paths[alive, d], return_inverse=True)
            leaf = np.full(len(codes), -1, np.int64)
            ends = depth[alive] == d + 1
            leaf[at[ends]] = alive[ends]
            self.levels.append(codes)
            self.leaf.append(leaf)
            node[alive] = at
            alive = alive[~ends]

    def home(self, vector: np.ndarray) -> np.ndarray:
        """The leaf on each row's own path."""
        found, node, alive = np.full(len(vector), max(self.root, 0)), np.zeros(len(vector), np.int64), np.arange(len(vector))
        for d, (codes, leaf) in enumerate(zip(self.levels, self.leaf)):
            node[alive] = np.searchsorted(codes, node[alive] * self.BASE + vector[alive, d])
            ends = leaf[node[alive]] >= 0
            found[alive[ends]] = leaf[node[alive[ends]]]
            alive = alive[~ends]
        return found

    def search(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of `vector`, leaf) for all leaves whose counts differ by a surplus of at most one and a deficit of at most one, for words that
        are as long as the row's or one shorter (level 0 is the length)."""
        rows = np.arange(len(vector))
        if self.root >= 0:
            return rows, np.full(len(rows), self.root)
        if not self.levels:
            return rows[:0], rows[:0]
        node, surplus, deficit = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        shorter = deficit
        out = []
        for d, (codes, leaf) in enumerate(zip(self.levels, self.leaf)):
            parts = []
            for step in ((-1, 0) if d == 0 else (-1, 0, 1)):
                may = ~surplus if d and step < 0 else ~deficit & ~shorter if step > 0 else np.ones(len(rows), bool)
                at = np.flatnonzero(may)
                code = node[at] * self.BASE + vector[rows[at], d] + step
                found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                ok = codes[found] == code
                at, found = at[ok], found[ok]
                if d == 0:
                    parts.append((rows[at], found, surplus[at], deficit[at], np.full(len(at), step < 0)))
                else:
                    parts.append((rows[at], found, surplus[at] | (step < 0), deficit[at] | (step > 0), shorter[at]))
            rows, node, surplus, deficit, shorter = (np.concatenate(x) for x in zip(*parts))
            done = leaf[node] >= 0
            out.append((rows[done], leaf[node[done]]))
            go = ~done
            rows, node, surplus, deficit, shorter = rows[go], node[go], surplus[go], deficit[go], shorter[go]
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def is_near(a: str, b: str) -> bool:
    """`a`, as long as `b` or one longer, and `b` differ by exactly one code point."""
    i, n = 0, len(b)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1:] == (b[i + 1:] if len(a) == n else b[i:]) and a != b


def _keys(words: list[str], shorter: int, side: int) -> np.ndarray:
    """Hash of the first half of a word that is `shorter` code points shorter (side 0), or of as many last code points as its second half."""
    if side == 0:
        part = (hash(w[:(len(w) - shorter) // 2]) for w in words)
    else:
        part = (hash(w[len(w) - (len(w) - shorter + 1) // 2:]) for w in words)
    return np.fromiter(part, np.int64, len(words)).view(np.uint64)


def _at_leaf(part: np.ndarray, leaf: np.ndarray, side: int) -> np.ndarray:
    return mix(part ^ mix(leaf.astype(np.uint64) * np.uint64(2) + np.uint64(side)))


def near_pairs(indexed: list[str], vectors_in: np.ndarray, queries: list[str], vectors_q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, indexed) numbers of near words, the query being as long or one longer."""
    leaves, leaf = np.unique(vectors_in, axis=0, return_inverse=True)
    leaf = leaf.reshape(-1)
    trie = Trie(leaves, np.full(len(leaves), leaves.shape[1]))
    index = []
    for side in (0, 1):
        key = _at_leaf(_keys(indexed, 0, side), leaf, side)
        order = np.argsort(key, kind="stable")
        index.append((key[order], order))
    for a in range(0, len(queries), QUERIES_AT_ONCE):
        words, vector = queries[a:a + QUERIES_AT_ONCE], vectors_q[a:a + QUERIES_AT_ONCE]
        row, at = trie.search(vector)
        short = vector[row, 0] != leaves[at, 0]
        pairs = []
        for side, (keys, order) in enumerate(index):
            key = _at_leaf(np.where(short, _keys(words, 1, side)[row], _keys(words, 0, side)[row]), at, side)
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            n = high - low
            some = np.flatnonzero(n)
            n = n[some]
            to = order[np.repeat(low[some] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pairs.append(np.repeat(row[some], n) * len(indexed) + to)
        both = np.unique(np.concatenate(pairs))
        q, i = both // len(indexed), both % len(indexed)
        ok = np.fromiter((is_near(words[x], indexed[y]) for x, y in zip(q.tolist(), i.tolist())), bool, len(q))
        yield q[ok] + a, i[ok]


# ---- Spark

def _vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v, n = np.unique(vectors(batch.column("word")), axis=0, return_counts=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.reshape(-1)))
        yield pa.RecordBatch.from_arrays([lists, pa.array(n)], names=["v", "n"])


def shards(vocabulary: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest trie nodes with at most `limit` words (paths and depths), and the lowest nodes where vectors can't be split further.
    A level has at most words / limit larger nodes, so what comes to the driver is bounded by the caller's limit."""
    counted = save(vocabulary.mapInArrow(_vectors_of, "v array<int>, n bigint").groupBy("v").agg(F.sum("n").alias("n")))
    spark, levels = vocabulary.sparkSession, 1 + GROUPS
    total = counted.agg(F.sum("n")).first()[0] or 0
    if total <= limit:
        return np.zeros((1, levels), np.int64), np.zeros(1, np.int64)
    found, large = [], None
    for depth in range(1, levels + 1):
        here = counted
        if large is not None:
            table = spark.createDataFrame([(p,) for p in large], "p array<int>")
            here = counted.join(table, F.slice("v", 1, depth - 1) == F.col("p"), "left_semi")
        nodes = here.groupBy(F.slice("v", 1, depth).alias("p")).agg(F.sum("n").alias("n")).collect()
        found += [list(r.p) for r in nodes if r.n <= limit or depth == levels]
        large = [list(r.p) for r in nodes if r.n > limit and depth < levels]
        if not large:
            break
    found.sort()
    return np.array([p + [0] * (levels - len(p)) for p in found], np.int64), np.array([len(p) for p in found])


def _route(paths: np.ndarray, depth: np.ndarray):
    """(shard, word, n, home): a row for each shard that the search of the top of the trie reaches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Trie(paths, depth)
        for batch in batches:
            v = vectors(batch.column("word"))
            home = top.home(v)
            for a in range(0, len(v), QUERIES_AT_ONCE):
                row, shard = top.search(v[a:a + QUERIES_AT_ONCE])
                row = row + a
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), batch.column("word").take(take), batch.column("n").take(take),
                                                  pa.array(shard == home[row])], names=["shard", "word", "n", "home"])
    return run


def _search(t: pa.Table) -> pa.Table:
    """For each word sent to the shard: near words found, and the best of them."""
    t = t.combine_chunks()
    words, n, home = t.column("word").to_pylist(), t.column("n").to_numpy(), np.flatnonzero(t.column("home").to_numpy())
    v = vectors(t.column("word").combine_chunks() if isinstance(t.column("word"), pa.ChunkedArray) else t.column("word"))
    to, other = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q, i in near_pairs([words[k] for k in home.tolist()], v[home], words, v):
        i = home[i]
        longer = v[q, 0] > v[i, 0]
        to += [q, i[longer]]
        other += [i, q[longer]]
    to, other = np.concatenate(to), np.concatenate(other)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], to))
    to, other = to[order], other[order]
    at, begin, count = np.unique(to, return_index=True, return_counts=True)
    best = other[begin]
    return pa.table({"word": t.column("word").take(pa.array(at)), "near": pa.array(count.astype(np.int64)), "best_n": pa.array(n[best]),
                     "best": t.column("word").take(pa.array(best))})


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n_near, best (its near word of largest n, ties to the smallest) and best_n, of words that have a near word."""
    limit = max(shard_words, vocabulary.count() // 8192)
    sent = vocabulary.mapInArrow(_route(*shards(vocabulary, limit)), "shard int, word string, n bigint, home boolean")
    found = sent.groupBy("shard").applyInArrow(_search, "word string, near bigint, best_n bigint, best string")
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b"))
            .select("word", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): `forms` (word, form) followed to the last. Counts double from form to form, so a few rounds do."""
    now = save(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        now = save(now.join(ahead, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame, least: int = 3, ratio: int = 2, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with at least `least` occurrences."""
    vocabulary = save(occurrences(docs).filter(F.col("n") >= least))
    best = F.col("best_n") >= ratio * F.col("n")
    words = save(vocabulary.join(near_words(vocabulary, shard_words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(best, F.col("best")).alias("form"), F.when(best, F.col("best_n")).alias("form_n")))
    return (words.join(roots(words.filter("form IS NOT NULL")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


SQL = r"""
WITH RECURSIVE bits AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)),
found AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
runs AS (SELECT id, run, count(*) AS n FROM found WHERE length(run) >= 5 GROUP BY id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || ':' || run, ''), lambda x:
      CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64] END))),
    lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295) AS h FROM runs, bits),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN
      substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed) w
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
near AS (SELECT x.word, y.word AS other, y.n FROM gaps x JOIN gaps y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM gaps x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM gaps x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place FROM near),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 2 * w.n THEN b.other END AS form, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
chain AS (SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""
