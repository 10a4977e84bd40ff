"""Line deduplication by an exact set-similarity join (operator 3).

A line is the set of its words (A-Z as a-z); lines of fewer than `least` different words are left alone (1, the default: no line is). A
line goes if an earlier one, in order of doc_id and line number, has the same set or one of Jaccard similarity 0.8 or more. Sets of up to
three words can only match an equal set; they are grouped by their signature and take no part in the join.

Tokens are ordered by rarity, then by hash. Rarity is read from a table of counts of fixed size (2 ** `bits` hash buckets), which is all
that is broadcast for it: any one order for all lines makes the prefix filter exact, rarity only makes it selective. Two lines of n and
m tokens can be similar only if
  * their prefixes of n - ceil(0.8 n) + 1 tokens share one (prefix filter: lines meet in the buckets of their prefix tokens),
  * 4 max(n, m) <= 5 min(n, m) (length filter),
  * in the bucket of the first token they share, the tokens from that one on suffice for the overlap (positional filter), and
  * the parities of 128 hashed bits differ in no more places than the sets may (bitmap filter).
What passes is confirmed on the full sets.

A bucket is a stream in order of the lines, each set once, at its first line: lines of one set share all their buckets, so the order within
any bucket is that of the sets' first lines in the corpus, and the later one of a similar pair goes. In the first round every line names the
earlier line that the bitmap says is nearest, or the `NEAREST` nearest where the bitmap leaves doubt, so a bucket gives pairs in proportion to
its rows; confirmed ones settle most lines. In the second round the lines that are still there and had further candidates meet them in the
buckets where they had them, among lines of a size that can match, until the first that is similar, so no match is lost and none is listed
twice. A bucket's pairs are weighed in blocks of bounded size and never leave the task.

The first round has a short row for about every fifth word. Those that a block of texts has for the same group of buckets travel as one
binary; the number of groups follows the number of words, so a group stays as small as it is, and is put in order in its task.

Which lines need full sets, and which buckets the second round is about, is told to the scans by bit tables of fixed size; a wrong hit in them
only sends a row too many. NULL texts are empty. Rows with a NULL doc_id are left alone. Identical repeated rows are one record.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns, mix, save, slices, text_or_empty, utf8
from .words import word_hashes

FLAG_BITS = 26             # of the bit tables: 8 MB
HASH_BITS = 48             # of a token's order value, below its rarity
NEAREST = 8                # candidates a line names in a bucket where the bitmaps do not settle it
SIZES = 2654435761         # odd: spreads set sizes over the places of a bit table
GROUP_WORDS = 2_000_000    # words of the corpus for each group of buckets: some 400,000 rows
LEAST_GROUPS = 1024
COUNTS = 1 << 10           # counts that travel as one row
MEETS = 4                  # words from which a line can match another set than its own: 4 of 5 words are 0.8, 3 of 4 are not


class Lines:
    """The lines of a block of texts as sorted token sets."""

    def __init__(self, part: pa.RecordBatch, counts: np.ndarray, least: int, some: np.ndarray | None = None):
        """`some`: a bit table; lines without a token in it are left out."""
        raw, off = utf8(part.column("text"))
        feed = np.flatnonzero(raw == 10)
        begin = np.concatenate([off[:-1], feed + 1])
        doc = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, feed, side="right") - 1])
        order = np.lexsort((begin, doc))
        begin, doc = begin[order], doc[order]
        h, first = word_hashes(raw, off, lower=True, cuts=np.append(begin, len(raw)))
        bits = len(counts).bit_length() - 1
        # rare first: the logarithm of the count, in steps small enough to tell counts of one bucket from two
        rarity = (np.log2(counts + 1) * 1000).astype(np.uint64)
        value = rarity[(h >> np.uint64(64 - bits)).astype(np.int64)] << np.uint64(HASH_BITS) | h & np.uint64((1 << HASH_BITS) - 1)
        line = np.repeat(np.arange(len(begin)), np.diff(first))
        keep = np.full(len(begin), some is None)
        if some is not None:
            keep[line[flagged(value, some)]] = True
            value, line = value[keep[line]], line[keep[line]]
        # one sort of 64-bit keys; where what is cut off of the values could matter, by both columns
        cut = np.uint64(len(begin).bit_length())
        key = (line.astype(np.uint64) << np.uint64(64) - cut) | value >> cut
        by = np.argsort(key)
        key, value, line = key[by], value[by], line[by]
        if ((key[1:] == key[:-1]) & (value[1:] != value[:-1])).any():
            by = np.lexsort((value, line))
            value, line = value[by], line[by]
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (line[1:] != line[:-1])
        value, line = value[fresh], line[fresh]
        size = np.bincount(line, minlength=len(begin))
        keep &= size >= least
        number = np.arange(len(begin)) - np.searchsorted(doc, doc)
        pick = keep[line]
        self.value, self.size = value[pick], size[keep]
        self.doc, self.number = doc[keep], number[keep]
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        if len(self.size):
            self.one = np.add.reduceat(mix(self.value * np.uint64(3)), self.start[:-1])
            self.two = np.add.reduceat(mix(self.value + np.uint64(7)), self.start[:-1])
        else:
            self.one = self.two = np.zeros(0, np.uint64)

    def bitmaps(self) -> np.ndarray:
        """Parity of the tokens in each of 128 places."""
        n = len(self.size)
        at = np.repeat(np.arange(n), self.size) * 128 + (self.value & np.uint64(127)).astype(np.int64)
        odd = (np.bincount(at, minlength=n * 128) & 1).astype(np.uint8)
        return np.packbits(odd.reshape(n, 128), axis=1).view(np.int64)

    def prefixes(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token positions, lines) of the prefixes of the given lines."""
        n = self.size[lines]
        length = n - (4 * n + 4) // 5 + 1
        at = np.repeat(self.start[:-1][lines], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        return at, np.repeat(lines, length)


def _batch(names: list[str], *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if isinstance(a, np.ndarray) and a.dtype == np.uint64 else a) for a in arrays], names=names)


def _packed(names: list[str], key: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of numbers as one binary for each run of equal keys."""
    for at in range(0, len(key), 1 << 20):       # offsets in a column have 32 bits
        k, part = key[at:at + (1 << 20)], np.ascontiguousarray(rows[at:at + (1 << 20)])
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        offsets = (np.append(new, len(k)) * part[0].nbytes).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(k[new]), pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets), pa.py_buffer(part)])], names=names)


def _unpacked(binaries: pa.Array, width: int) -> np.ndarray:
    """All rows of a column of such binaries."""
    binaries = binaries.cast(pa.large_binary())
    _, offsets, data = binaries.buffers()
    off = np.frombuffer(offsets, np.int64)[binaries.offset:binaries.offset + len(binaries) + 1]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]].view(np.int64).reshape(-1, width)


def _counted(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in slices(batch):
                h, _ = word_hashes(*utf8(part.column("text")), lower=True)
                total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        total = total.reshape(-1, min(COUNTS, 1 << bits))
        at = np.flatnonzero(total.any(axis=1))
        yield from _packed(["place", "counts"], at, total[at])
    return run


def _added(bits: int):
    """The counts of each place from all tasks, added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, n in zip(batch.column("place").to_pylist(), _unpacked(batch.column("counts"), min(COUNTS, 1 << bits))):
                total[place] = total[place] + n if place in total else n.copy()
        if total:
            yield from _packed(["place", "counts"], np.array(list(total)), np.stack(list(total.values())))
    return run


def token_counts_by_bucket(d: DataFrame, bits: int) -> np.ndarray:
    """Occurrences of all words of all texts, by hash bucket: 2 ** bits numbers whatever the size of the corpus."""
    rows = "place bigint, counts binary"
    found = d.mapInArrow(_counted(bits), rows).repartition(F.col("place")).mapInArrow(_added(bits), rows).toPandas()
    out = np.zeros(1 << bits, np.int64).reshape(-1, min(COUNTS, 1 << bits))
    for place, counts in zip(found["place"], found["counts"]):
        out[place] = np.frombuffer(counts, np.int64)
    return out.reshape(-1)


def flags(df: DataFrame, column: str) -> np.ndarray:
    """Bit table of fixed size with the hashes of a column set."""
    place = F.pmod(F.col(column), F.lit(1 << FLAG_BITS))
    words = (df.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, CAST(pmod(`%s`, 64) AS INT))" % column).alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits"))).toPandas()
    out = np.zeros(1 << (FLAG_BITS - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def flagged(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    place = values & np.uint64((1 << FLAG_BITS) - 1)
    return (table.view(np.uint64)[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _buckets(counts, least: int, groups: int, tokens=None, ids=None):
    """Rows (token, line) of prefixes, packed by group; with `tokens`, plain rows, only of tokens flagged there both alone and with the line's
    size, and whether the line is flagged in `ids`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, some, own = counts.value, tokens and tokens.value, ids and ids.value
        for batch in batches:
            for part in slices(batch):
                lines = Lines(part, table, least, some)
                if not len(lines.size):
                    continue
                doc_id = part.column("doc_id").to_numpy()
                by = np.lexsort((lines.number, doc_id[lines.doc], lines.one))      # equal lines of a block: the first
                once = by[np.concatenate([[True], lines.one[by][1:] != lines.one[by][:-1]])]
                once = once[lines.size[once] >= MEETS]
                at, line = lines.prefixes(once)
                if some is not None:
                    hit = flagged(lines.value[at] ^ lines.size[line].astype(np.uint64) * np.uint64(SIZES), some)
                    at, line = at[hit], line[hit]
                if not len(at):
                    continue
                maps = lines.bitmaps()
                asks = flagged(lines.one[line], own) if own is not None else np.ones(len(line), bool)
                place = (at - lines.start[line]).astype(np.int64)
                cells = (lines.value[at].view(np.int64), lines.one[line].view(np.int64), doc_id[lines.doc[line]], lines.number[line].astype(np.int64),
                         asks.astype(np.int64) << 62 | lines.size[line].astype(np.int64) << 32 | place, maps[line, 0], maps[line, 1])
                if some is None:
                    group = (lines.value[at] % np.uint64(groups)).astype(np.int64)
                    by = np.argsort(group)
                    yield from _packed(["grp", "rows"], group[by], np.stack(cells, axis=1)[by])
                    continue
                # few rows: their full sets come along
                sets = [lines.value[a:b].view(np.int64) for a, b in zip(lines.start[line], lines.start[line + 1])]
                yield pa.RecordBatch.from_arrays([*_batch(ROW_NAMES, *cells).columns, pa.array(sets, pa.list_(pa.int64()))], names=[*ROW_NAMES, "items"])
    return run


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packed groups, a group at a time, by token and order of the lines, without the tokens that only one row has."""
    def opened(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(held)
        token = rows[:, 0].copy()
        by = np.argsort(token)
        token = token[by]
        same = np.concatenate([[False], token[1:] == token[:-1], [False]])
        rows = rows[by[same[1:] | same[:-1]]]
        if len(rows):
            c = np.ascontiguousarray(rows.T)
            yield _batch(ROW_NAMES, *c[:, np.lexsort((c[1], c[3], c[2], c[0]))])

    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("grp").to_numpy()
        new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        for a, b in zip(new, np.append(new[1:], len(group))):
            if held and group[a] != now:
                yield from opened(held)
                held = []
            now = group[a]
            held.append(_unpacked(batch.column("rows").slice(a, b - a), len(ROW_NAMES)))
    if held:
        yield from opened(held)


PAIR_NAMES = ["id", "other", "token"]
PAIRS = "id bigint, other bigint, token bigint"
ROW_NAMES = ["token", "id", "doc_id", "number", "shape", "b0", "b1"]
BUCKET_ROWS = ", ".join(f"{n} bigint" for n in ROW_NAMES)


def _candidates(everything: bool):
    """Pairs (id, an earlier line's id) within buckets. First round: the nearest by the bitmaps, and the token if there were more. Second round, for lines that ask: the nearest whose full set is similar."""
    names = [*ROW_NAMES, "items"] if everything else ROW_NAMES

    def similar(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        items, found, done = c["items"], [], -1
        for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
            if j != done and 9 * len(np.intersect1d(items[i], items[j], assume_unique=True)) >= 4 * (len(items[i]) + len(items[j])):
                found.append(k)
                done = j
        x, y = x[found], y[found]
        yield _batch(PAIR_NAMES, c["id"][y], c["id"][x], c["token"][y])

    def once(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Each set of a bucket at its first line."""
        by = np.lexsort((c["id"], c["token"]))      # stable: rows come in order of the lines
        t, i = c["token"][by], c["id"][by]
        first = np.sort(by[np.concatenate([[True], (t[1:] != t[:-1]) | (i[1:] != i[:-1])])])
        return c if len(first) == len(by) else {k: v[first] for k, v in c.items()}

    def weigh(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        c = once(c)
        token, size, place = c["token"], c["shape"] >> 32 & 0x3FFFFFFF, c["shape"] & 0xFFFFFFFF
        bucket = np.cumsum(np.concatenate([[False], token[1:] != token[:-1]])) << 32
        key = bucket | size
        asks = c["shape"] >> 62 & 1 if everything else np.ones(len(token), np.int64)
        # a pair is weighed where its first shared token is: there the smaller set has eight ninths of its tokens or more from that one on
        early = place <= size - (8 * size + 8) // 9
        every = np.argsort(key, kind="stable")
        few = every[early[every]]

        def reach(among: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Where the bucket's sets of low to high - 1 tokens start among those sorted by size, and how many they are, for some rows."""
            sizes = key[among]
            first = np.searchsorted(sizes, bucket + low)
            return among, first, (np.searchsorted(sizes, bucket + high) - first) * rows

        ways = [reach(every, size, 5 * size // 4 + 1, asks * early), reach(few, (4 * size + 4) // 5, size, asks)]
        upto = np.cumsum(ways[0][2] + ways[1][2])
        begin = 0
        while begin < len(token):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + 500_000, side="right")))
            met = []
            for among, first, count in ways:
                r = count[begin:end]
                y = np.repeat(np.arange(begin, end), r)
                x = among[np.repeat(first[begin:end] - np.cumsum(r) + r, r) + np.arange(len(y))]
                met.append(np.stack([x, y])[:, x < y])
            begin = end
            x, y = np.concatenate(met, axis=1)
            n, m = size[x], size[y]
            need = (4 * (n + m) + 8) // 9
            hit = np.flatnonzero(np.minimum(n - place[x], m - place[y]) >= need)
            x, y, most = x[hit], y[hit], (n + m - 2 * need)[hit]
            apart = sum(np.bitwise_count((c[b][x] ^ c[b][y]).view(np.uint64)).astype(np.int64) for b in ("b0", "b1"))
            hit = np.flatnonzero((apart <= most) & (c["id"][x] != c["id"][y]))
            if not len(hit):
                continue
            hit = hit[np.lexsort((x[hit], apart[hit], y[hit]))]       # nearest first
            x, y, apart = x[hit], y[hit], apart[hit]
            if everything:
                yield from similar(c, x, y)
                continue
            start = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
            count = np.diff(np.append(start, len(y)))
            # sets may differ in (n + m) / 9 words: where the bitmaps see no more than half of that, the nearest is enough
            named = np.where(18 * apart[start] <= size[x[start]] + size[y[start]], 1, NEAREST)
            nth = np.arange(len(y)) - np.repeat(start, count)
            keep = nth < np.repeat(named, count)
            tells = ((nth == 0) & np.repeat(count > named, count))[keep]
            x, y = x[keep], y[keep]
            yield pa.RecordBatch.from_arrays([pa.array(c["id"][y]), pa.array(c["id"][x]), pa.array(c["token"][y], mask=~tells)], names=PAIR_NAMES)

    def columns_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {k: batch.column(k).to_numpy() for k in ROW_NAMES}
        if everything:
            out["items"] = batch.column("items").to_numpy(zero_copy_only=False)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            now = columns_of(batch)
            if not len(now["token"]):
                continue
            change = np.flatnonzero(now["token"] != now["token"][-1])
            cut = int(change[-1]) + 1 if len(change) else 0       # the last bucket may go on in the next batch
            if cut or held and held[-1]["token"][-1] != now["token"][0]:
                held.append({k: v[:cut] for k, v in now.items()})
                yield from weigh({k: np.concatenate([h[k] for h in held]) for k in names})
                held = []
            held.append({k: v[cut:] for k, v in now.items()})
        if held:
            yield from weigh({k: np.concatenate([h[k] for h in held]) for k in names})
    return run


def _sets(counts, least: int, ids):
    """All lines with their signature; the full set of those flagged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = counts.value, ids.value
        for batch in batches:
            for part in slices(batch):
                lines = Lines(part, table, least)
                if not len(lines.size):
                    continue
                hit = flagged(lines.one, own)
                later = np.ones(len(hit), bool)
                later[np.unique(lines.one, return_index=True)[1]] = False
                hit &= ~later
                size = np.where(hit, lines.size, 0)
                items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                                 pa.array(lines.value[np.repeat(hit, lines.size)].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(lines.doc)), part.column("of_text").take(pa.array(lines.doc)), pa.array(lines.number.astype(np.int32)),
                     pa.array(lines.one.view(np.int64)), pa.array(lines.two.view(np.int64)), items],
                    names=["doc_id", "of_text", "line", "id", "id2", "items"])
    return run


SET_ROWS = "doc_id bigint, of_text bigint, line int, id bigint, id2 bigint, items array<bigint>"


def removed_lines(docs: DataFrame, least: int = 1, bits: int = 18) -> DataFrame:
    """(doc_id, of_text, removed): the numbers, from 0, of the lines that go, for rows that lose any."""
    spark = docs.sparkSession
    text = text_or_empty()
    d = columns(docs, "doc_id", "text").filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64(text).alias("of_text"), text.alias("text"))
    send = spark.sparkContext.broadcast
    table = token_counts_by_bucket(d.select("text"), bits)
    counts, groups = send(table), max(LEAST_GROUPS, int(table.sum()) // GROUP_WORDS)

    def ends(pairs):
        return pairs.select("id").unionByName(pairs.select(F.col("other").alias("id")))

    nearest = _candidates(False)
    rows = d.select("doc_id", "text").mapInArrow(_buckets(counts, least, groups), "grp bigint, rows binary")
    rows = rows.repartition(F.col("grp")).sortWithinPartitions("grp")
    pairs = save(rows.mapInArrow(lambda batches: nearest(_in_order(batches)), PAIRS).distinct())
    lines = save(d.mapInArrow(_sets(counts, least, send(flags(ends(pairs), "id"))), SET_ROWS))
    sets = save(lines.filter(F.size("items") > 0).groupBy("id", "id2").agg(F.first("items").alias("items")))
    # of a pair, `id` is the line that comes later
    both = F.size(F.array_intersect("p", "q"))
    gone = save(pairs.join(sets.select("id", "id2", F.col("items").alias("p")), "id").join(sets.select(F.col("id").alias("other"), F.col("items").alias("q")), "other")
                .filter(9 * both >= 4 * (F.size("p") + F.size("q"))).select("id", "id2").distinct())
    # a line asks on where it stays and saw more candidates
    asking = save(pairs.filter("token IS NOT NULL").select("id", "token").distinct().join(gone, "id", "left_anti"))
    if not asking.isEmpty():
        n = F.size("items")
        fits = F.explode(F.sequence(F.ceil(n * 4 / 5), F.floor(n * 5 / 4)))       # sizes that can match
        at = (asking.join(sets, "id").select("token", fits.alias("m")).distinct()
              .select(F.col("token").bitwiseXOR(F.col("m") * F.lit(SIZES)).alias("at")))
        at = at.unionByName(asking.select(F.col("token").alias("at")))
        some, own = send(flags(at, "at")), send(flags(asking, "id"))
        rows = d.select("doc_id", "text").mapInArrow(_buckets(counts, least, groups, some, own), BUCKET_ROWS + ", items array<bigint>")
        rows = rows.repartition(F.col("token")).sortWithinPartitions("token", "doc_id", "number", "id")
        similar = rows.mapInArrow(_candidates(True), PAIRS).select("id").distinct()
        gone = save(gone.unionByName(sets.select("id", "id2").join(similar, "id")).distinct())
    classes = lines.groupBy("id", "id2").agg(F.min(F.struct("doc_id", "line", "of_text")).alias("first"), F.count(F.lit(1)).alias("n"))
    hits = classes.join(gone.withColumn("near", F.lit(True)), ["id", "id2"], "left").filter("near OR n > 1").drop("n")
    return (lines.select("doc_id", "of_text", "line", "id", "id2").join(hits, ["id", "id2"])
            .filter(F.coalesce("near", F.lit(False)) | (F.struct("doc_id", "line", "of_text") != F.col("first")))
            .groupBy("doc_id", "of_text").agg(F.sort_array(F.collect_set("line")).alias("removed")))


def dedup_report(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_removed, removed (line numbers from 0, joined by commas)."""
    text = text_or_empty()
    lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    d = columns(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("of_text"), lines.alias("n_lines"))
    out = d.join(removed_lines(docs, **options), ["doc_id", "of_text"], "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
                      F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """`docs` without the removed lines, `n_chars` counted anew where there is one. A row all of whose words went is dropped."""
    gone = removed_lines(docs, **options).select(F.col("doc_id").alias("_doc_id_of"), F.col("of_text").alias("_of_text"), F.col("removed").alias("_removed"))
    row = F.col("_row")         # packed, so that no column of the table can clash with the three above
    text, cut = row["text"], F.col("_removed").isNotNull()
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    d = d.join(gone, (row["doc_id"] == F.col("_doc_id_of")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_of_text")), "left")
    lines = F.split(text, "\n")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_removed"), lambda i: F.get(lines, i)), "\n")
    d = d.withColumn("_text", F.when(cut, kept).otherwise(text)).filter(~cut | F.col("_text").rlike("[^ \\t-\\r]"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return d.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])
