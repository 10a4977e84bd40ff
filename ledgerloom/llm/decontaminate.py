"""Benchmark decontamination by latent semantic retrieval (operator 1).

1. Words (letters and digits, A-Z as a-z) that benchmark items hold make the vocabulary. Their frequencies are counted over the passages
   (blocks of 16 words) of all documents.
2. A randomised singular value decomposition of the TF-IDF matrix of all passages of all documents and of the items gives the latent space.
   The scan that counts the frequencies also counts how often two vocabulary words share a passage (AᵀA before weights); an aggregation adds
   these cells up, and a round multiplies their table with a random matrix; one more round sharpens the space.
3. All passages of all documents (windows of about an item's length that overlap by half) are projected and compared with all items by cosine.
4. Near items (cosine `near` or more) whose words the passage and its surroundings hold often enough are compared word by word: a longest common subsequence of
   `same` of the item's words is a leak; from `paraphrase` on it is one if the item's answer (its `answer` column) is there as well. An item
   without an answer has nothing apart from its words that could be asked for: the subsequence alone decides.

Documents never meet each other and nothing is shuffled: a passage is judged in the task that reads it. Items are a query set, taken in
blocks of `block_items`, each of which is broadcast as a few MB; a larger benchmark means more passes. Items of under five words, for which
there is no latent space to speak of, leak where their words stand one after the other. NULL or empty texts and an empty benchmark give no leaks. Repeated item_ids are items of their own with one name; NULL doc_ids
are kept.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import columns, save, slices, utf8
from .words import word_hashes

BLOCK = 16                 # words; passages are two or four blocks
SLICE_BYTES = 256 << 10
LEAST_WORDS = 5
DENSE = 4096               # words of a vocabulary whose square is counted in a dense table (64 MB)
HEAD = np.uint64(48)       # words are looked up by their first 16 bits
_plain = np.array([not (chr(b).isalnum() and b < 128 or b >= 128) for b in range(256)])


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*utf8(texts), lower=True, separators=_plain)


def blocks_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first block of each text (one more than texts), and the block of each word."""
    count = np.diff(first)
    begin = np.concatenate([[0], np.cumsum(-(-count // BLOCK))])
    within = np.arange(first[-1]) - np.repeat(first[:-1], count)
    return begin, np.repeat(begin[:-1], count) + within // BLOCK


def passages(begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first block and end of windows of `size` blocks, every half window, that cover each text to its end."""
    blocks = np.diff(begin)
    step = size // 2
    count = np.where(blocks > 0, 1 + np.maximum(0, -(-(blocks - size) // step)), 0)
    text = np.repeat(np.arange(len(blocks)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = begin[text] + k * step
    return text, start, np.minimum(start + size, begin[text + 1])


@dataclass
class Items:
    """One block of benchmark items, as tasks get it. `ids` has the items of `words`, then those of `short_words`, of under five words."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: np.ndarray             # sorted hashes
    weights: np.ndarray | None = None  # inverse document frequency
    space: np.ndarray | None = None    # weighted term vectors
    vectors: np.ndarray | None = None  # of the items, of length 1
    sizes: np.ndarray | None = None    # blocks of the passages that an item is compared with
    counts: np.ndarray | None = None   # how often each item has each vocabulary word
    short_words: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        heads = np.searchsorted(self.vocabulary, np.arange(1 << 64 - int(HEAD), dtype=np.uint64) << HEAD)
        self.heads = heads.astype(np.int32)     # number of the first word not before each head
        self.deepest = int(np.diff(heads, append=len(self.vocabulary)).max())

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are in the vocabulary, and their numbers."""
        last = len(self.vocabulary) - 1
        at = np.minimum(self.heads[h >> HEAD], last).astype(np.int64)
        for _ in range(self.deepest - 1):       # past the words of this head that stand before
            at += (self.vocabulary[at] < h) & (at < last)
        known = np.flatnonzero(self.vocabulary[at] == h)
        return known, at[known]


def sums_of(space: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of `space[term]` over consecutive groups of `count` terms, none of them empty: first all first terms, then all second ones."""
    order = np.argsort(-count, kind="stable")
    start = (np.cumsum(count) - count)[order]
    total = space[term[start]]
    for k in range(1, int(count.max())):
        longer = np.count_nonzero(count > k)
        total[:longer] += space[term[start[:longer] + k]]
    out = np.empty_like(total)
    out[order] = total
    return out


def read_items(rows: list) -> Items:
    """`rows` have item_id, text and answer (or NULL)."""
    texts = [r["text"] or "" for r in rows]
    h, first = words_of(pa.array(texts, pa.string()))
    a, a_first = words_of(pa.array([r["answer"] or "" for r in rows], pa.string()))
    use = [i for i in range(len(rows)) if first[i + 1] - first[i] >= LEAST_WORDS]
    words = [h[first[i]:first[i + 1]] for i in use]
    short = [i for i in range(len(rows)) if 0 < first[i + 1] - first[i] < LEAST_WORDS]
    return Items([rows[i]["item_id"] for i in use + short], words, [a[a_first[i]:a_first[i + 1]] for i in use],
                 np.unique(np.concatenate(words)) if use else np.zeros(0, np.uint64), short_words=[h[first[i]:first[i + 1]] for i in short])


EMITTED = 1 << 16          # cells of a batch
HELD_CELLS = 1 << 21       # cells that a task holds for a large vocabulary


def _frequencies(items: Items):
    """(cell, n): how often two vocabulary words share a block, cell = row * size + column with row <= column; blocks that hold a word under
    -1 - its number; and the number of blocks under NO_WORD."""
    size = len(items.vocabulary)

    def rows(cell: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(cell), EMITTED):
            yield pa.RecordBatch.from_arrays([pa.array(cell[a:a + EMITTED].astype(np.int64)), pa.array(n[a:a + EMITTED].astype(np.int64))], names=["cell", "n"])

    def pairs(term: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells, and which words are the first ones of their kind in their block."""
        cells, new = [term * size + term], np.ones(len(term), bool)
        for lag in range(1, BLOCK):            # words of a block come one after the other
            same = np.flatnonzero(block[lag:] == block[:-lag]) if len(term) > lag else np.zeros(0, np.int64)
            if not len(same):
                break
            x, y = term[same], term[same + lag]
            cells.append(np.minimum(x, y) * size + np.maximum(x, y))
            twice = x == y                      # a word with itself stands on both sides of the diagonal
            cells.append(x[twice] * size + y[twice])
            new[same[twice] + lag] = False
        return np.concatenate(cells), new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        dense, held, many = np.zeros(size * size if size <= DENSE else 0, np.int32), [], 0
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                h, first = words_of(part.column("text"))
                begin, block = blocks_of(first)
                at, term = items.terms(h)
                n += int(begin[-1])
                cells, new = pairs(term, block[at])
                df += np.bincount(term[new], minlength=size)
                if size <= DENSE:
                    np.add.at(dense, cells, np.int32(1))        # of the table's type: numpy is ten times slower where it must cast
                    continue
                held.append(np.unique(cells, return_counts=True))
                many += len(held[-1][0])
                if many > HELD_CELLS:
                    for cell, count in held:
                        yield from rows(cell, count)
                    held, many = [], 0
        at = np.flatnonzero(dense)
        yield from rows(at, dense[at])
        for cell, count in held:
            yield from rows(cell, count)
        yield from rows(np.append(-1 - np.arange(size), NO_WORD), np.append(df, n))
    return run


NO_WORD = -(1 << 62)


def _times(weights: np.ndarray, right: np.ndarray):
    """(i, m): the row i of AᵀA·right, as bytes, from cells (i, j, n) sorted by i; a row has all its cells in one partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        weighted = weights[:, None] * right
        for batch in batches:
            row, column, count = (batch.column(c).to_numpy() for c in ("i", "j", "n"))
            for a in range(0, len(row), 1 << 14):
                r = row[a:a + (1 << 14)]
                new = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                sums = np.add.reduceat(count[a:a + (1 << 14), None] * weighted[column[a:a + (1 << 14)]], new)
                for k, x in zip(r[new].tolist(), sums):
                    total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([(weights[k] * x).tobytes() for k, x in total.items()], pa.binary())], names=["i", "m"])
    return run


def fit(d: DataFrame, items: Items, rank: int, seed: int = 5) -> Items:
    """Document frequencies and the latent space over all of `d`, and the items in it.

    What comes to the driver has the size of the items' vocabulary, not of `d`: frequencies, and per round a small vector for each word.
    """
    size = len(items.vocabulary)
    counted = save(d.mapInArrow(_frequencies(items), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")))
    n, df = 0, np.zeros(size)
    for r in counted.filter("cell < 0").toLocalIterator():
        if r["cell"] == NO_WORD:
            n = r["n"]
        else:
            df[-1 - r["cell"]] = r["n"]
    i, j = F.floor(F.col("cell") / size), F.col("cell") % size
    half = counted.filter("cell >= 0").select(i.alias("i"), j.alias("j"), "n")
    cells = save(half.unionByName(half.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "n")).repartition("i").sortWithinPartitions("i"))
    items.weights = np.log((n + 1) / (df + 1)) + 0.1
    wide = min(size, rank + 8)
    basis = np.random.Generator(np.random.PCG64(seed)).normal(size=(size, wide))
    # the items count as much as all passages together
    own = np.concatenate(items.words), np.concatenate([[0], np.cumsum([len(w) for w in items.words])])
    share = max(1.0, n / len(items.words))
    for _ in range(2):
        total = share * gram_of_items(items, basis, *own)
        for r in cells.mapInArrow(_times(items.weights, basis), "i bigint, m binary").toLocalIterator():
            total[r["i"]] += np.frombuffer(r["m"])
        basis, _ = np.linalg.qr(total)
    core = basis.T @ total
    value, turn = np.linalg.eigh((core + core.T) / 2)
    space = basis @ turn[:, np.argsort(-value)[:rank]]
    items.space = (items.weights[:, None] * space).astype(np.float32)
    vectors = np.stack([items.space[items.terms(w)[1]].sum(0) for w in items.words])
    items.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    items.counts = np.stack([np.minimum(np.bincount(items.terms(w)[1], minlength=size), 65535).astype(np.uint16) for w in items.words])
    items.sizes = np.where([len(w) <= 2 * BLOCK for w in items.words], 2, 4)
    return items


def gram_of_items(items: Items, right: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The same with each item as one passage."""
    total = np.zeros(right.shape)
    for i in range(len(first) - 1):
        _, term = items.terms(h[first[i]:first[i + 1]])
        w = items.weights[term][:, None]
        np.add.at(total, term, w * (w * right[term]).sum(0))
    return total


def common(places: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence; `places` has the item's positions of each word as bits."""
    full = (1 << size) - 1
    v = full
    for w in text:
        hit = v & places.get(w, 0)
        if hit:
            v = (v + hit | v - hit) & full
    return size - v.bit_count()


def bits_of(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << k
    return out


def possible(items: Items, item: np.ndarray, term: np.ndarray, low: np.ndarray, high: np.ndarray, needed: np.ndarray) -> list[int]:
    """Candidates whose window of vocabulary words (`term` from low to high) can have a common subsequence of `needed` words with the item:
    first by the window's words that the item has, then by the item's words that the window has, repeats counted."""
    out = []
    size = high - low
    group = np.cumsum(size) >> 20       # so that windows are read in bounded pieces
    for g in np.unique(group):
        mine = np.flatnonzero((group == g) & (size >= needed))
        for turn in (0, 1):
            if not len(mine):
                break
            n = size[mine]
            begin = np.cumsum(n) - n
            word = term[np.repeat(low[mine] - begin, n) + np.arange(n.sum())]
            if turn:
                both = np.unique(np.repeat(np.arange(len(mine)), n) * items.counts.shape[1] + word)
                of, word = np.divmod(both, items.counts.shape[1])
                bound = np.bincount(of, items.counts[item[mine][of], word], len(mine))
            else:
                bound = np.add.reduceat((items.counts[np.repeat(item[mine], n), word] > 0).astype(np.int64), begin)
            mine = mine[bound >= needed[mine]]
        out += mine.tolist()
    return out


def leaks_in(part: pa.RecordBatch, items: Items, tables: list, near: float, same: float, paraphrase: float) -> list[dict]:
    """Per row: item number -> share of the item's words that the text has in order."""
    h, first = words_of(part.column("text"))
    found: list[dict] = [{} for _ in range(part.num_rows)]
    for k, w in enumerate(items.short_words):
        at = np.flatnonzero(h[:len(h) - len(w) + 1] == w[0]) if len(h) >= len(w) else np.zeros(0, np.int64)
        for j in range(1, len(w)):
            at = at[h[at + j] == w[j]]
        text = np.searchsorted(first, at, side="right") - 1
        for d in np.unique(text[at + len(w) <= first[text + 1]]):
            found[d][len(items.words) + k] = 1.0
    if not items.words:
        return found
    begin, block = blocks_of(first)
    at, term = items.terms(h)
    if not len(at):
        return found
    lengths = np.array([len(w) for w in items.words])
    sums = np.zeros((begin[-1] + 1, items.space.shape[1]), np.float32)      # of each block; the last row stays zero
    row = block[at]
    new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sums[row[new]] = sums_of(items.space, term, np.diff(new, append=len(row)))
    for size in (2, 4):
        which = np.flatnonzero(items.sizes == size)
        if not len(which):
            continue
        text, start, end = passages(begin, size)
        p = sums[start]
        for k in range(1, size):
            p += sums[np.where(start + k < end, start + k, begin[-1])]
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-6)
        i, j = np.nonzero(p @ items.vectors[which].T >= near)
        item, d = which[j], text[i]
        a = first[d] + (start[i] - begin[d]) * BLOCK
        b = np.minimum(first[d] + (end[i] - begin[d]) * BLOCK, first[d + 1])
        low, high = np.maximum(first[d], a - lengths[item] // 2), np.minimum(first[d + 1], b + lengths[item] // 2)
        low_known, high_known = np.searchsorted(at, low), np.searchsorted(at, high)
        for k in possible(items, item, term, low_known, high_known, np.ceil(min(same, paraphrase) * lengths[item] - 1e-9)):
            of, row = int(item[k]), int(d[k])
            words, n = tables[of], int(lengths[of])
            if found[row].get(of, 0.0) >= 1:
                continue
            share = common(words[0], n, term[low_known[k]:high_known[k]].tolist()) / n      # other words match nothing
            if share >= same or share >= paraphrase and common(words[1], words[2], h[low[k]:high[k]].tolist()) >= 0.9 * words[2]:
                found[row][of] = max(share, found[row].get(of, 0.0))
    return found


def _searched(items: Items, near: float, same: float, paraphrase: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(bits_of(items.terms(w)[1]), bits_of(a), len(a)) for w, a in zip(items.words, items.answers)]
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                found = leaks_in(part, items, tables, near, same, paraphrase)
                ids = [sorted({items.ids[k] for k in f if items.ids[k] is not None}) for f in found]
                best = [max(f.values(), default=0.0) for f in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())],
                                                 names=[*(f"c{k}" for k in range(part.num_columns)), "items", "best"])
    return run


def search(docs: DataFrame, benchmark: DataFrame, keep: list[str], rank: int = 128, near: float = 0.45, same: float = 0.8, paraphrase: float = 0.6,
           block_items: int = 1000) -> DataFrame:
    """The columns `keep` of `docs` (text among them) as c0, c1, ..., then `items`, the item_ids that leak into a row, and `best`, the largest
    share of an item's words found in order."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    b = benchmark.select("item_id", "text", answer.alias("answer"))
    blocks = max(1, -(-benchmark.count() // block_items))
    m, place = len(keep), keep.index("text")
    out = docs.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(keep)], F.array().cast("array<bigint>").alias("items"), F.lit(0.0).alias("best"))
    back = StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(out.schema.fields)),
                       StructField("items", ArrayType(LongType())), StructField("best", DoubleType())])
    texts = columns(docs, "text").filter("text IS NOT NULL")
    for k in range(blocks):
        rows = b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()    # about block_items
        items = read_items(rows)
        if not items.ids:
            continue
        run = _searched(fit(texts, items, rank) if items.words else items, near, same, paraphrase)

        def named(batches, run=run):
            yield from run(pa.RecordBatch.from_arrays(x.columns, names=["text" if i == place else f"c{i}" for i in range(x.num_columns)]) for x in batches)
        out = out.mapInArrow(named, back).select(*[f"c{i}" for i in range(m)], F.array_union(f"c{m}", "items").alias("items"),
                                                 F.greatest(f"c{m + 1}", "best").alias("best"))
    return out


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_leaks, items (ids joined by commas), best_share, contaminated."""
    return search(docs, benchmark, ["doc_id", "text"], **options).select(
        F.col("c0").alias("doc_id"), F.size("items").cast("bigint").alias("n_leaks"),
        F.array_join(F.sort_array("items").cast("array<string>"), ",").alias("items"),
        F.col("best").alias("best_share"), (F.col("best") > 0).alias("contaminated"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` into which no item leaks, all columns."""
    found = search(docs, benchmark, docs.columns, **options).filter("best = 0")
    return found.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])
