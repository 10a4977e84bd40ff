"""MinHash near-duplicates with tensored banding (operator 10).

Two collections of `bands` keys of `rows` minhashes each are made per text. A table key joins one key of either collection, so
2 * bands * rows minhashes serve bands * bands tables of 2 * rows minhashes: about the square root of the usual work. For two texts
of similarity s a table agrees with probability s ** (2 * rows), and some table with (1 - (1 - s ** rows) ** bands) ** 2.

1. Texts with equal shingle sets form a class (128-bit signature), which gets a number. Only classes go on.
2. Classes whose keys are alone in either collection can't share a table and are left out before tables are formed.
3. In every table, each class is paired with the bucket's first class: as many pairs as rows at most. `bands` plain tables, each key of a
   collection in one, come before the others, where the pairs that they have connected are left out. Where buckets still hold several
   components, further rounds (`rounds` in all, fewer once little is found) pair classes with other first classes and with their
   neighbours in the order of further keys, one pair for each class and component that it meets; pairs that are connected are left out.
   Between rounds classes carry the label of a near part of their component; components are settled once, at the end.
   Buckets that stay open are settled exactly: of small ones (`SMALL` rows) all pairs of different components are listed; larger ones
   that share classes form a group, whose rows are dealt into blocks, and a task compares two blocks by size, minhashes and full sets.
   Every two classes of a bucket are compared or connected in the end, so `rounds` decides the speed only.
4. Candidates whose 2 * bands * rows minhashes agree far too rarely for the threshold are dropped (`slack` standard deviations), the
   others are confirmed on the full shingle sets. Links give components by star contractions.

Buckets are counted with a partial aggregation, and the neighbour order is a range partitioning, so a bucket with a third of all rows is
spread over tasks. NULL or empty texts (no words) have an empty set, link with nothing and are kept. Rows with a NULL doc_id
link with nothing and are kept, with a NULL component. Rows that repeat a doc_id each take the component of their text.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.graph import components
from .common import columns, mix, save, shingle_hashes, slices, text_or_empty, utf8
from .words import word_hashes

_FACTORS = np.random.Generator(np.random.PCG64(31337)).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The distinct k-word windows of each text as sorted hashes; A-Z as a-z."""
    raw, off = utf8(texts)
    s, begin = shingle_hashes(*word_hashes(raw, off, lower=True), k)
    for d in range(len(off) - 1):
        yield np.unique(s[begin[d]:begin[d + 1]])


def minhashes(s: np.ndarray, count: int) -> np.ndarray:
    """`count` 32-bit minhashes of a non-empty set."""
    best = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 2048):
        best = np.minimum(best, ((s[a:a + 2048, None] ^ (s[a:a + 2048, None] >> np.uint64(29))) * _FACTORS[:count]).min(0))
    return (best >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(k: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, one, two, values = [], [], [], []
                for s in shingle_sets(part.column("text"), k):
                    n.append(len(s))
                    first, second = _signature(s)
                    one.append(first)
                    two.append(second)
                    values.append(minhashes(s, count) if len(s) else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.array(n, np.int64)), pa.array(np.array(one, np.uint64).view(np.int64)),
                     pa.array(np.array(two, np.uint64).view(np.int64)), lists], names=["doc_id", "n_shingles", "s1", "s2", "mh"])
    return run


def _signature(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return (np.bitwise_xor.reduce(mix(s * np.uint64(3))), mix(s + np.uint64(7)).sum()) if len(s) else (np.uint64(0), np.uint64(0))


def _sets(k: int):
    """The shingle sets of rows whose text has the class's signature (another text may have the same doc_id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                want = np.stack([part.column(c).to_numpy() for c in ("s1", "s2")], 1)
                sets = [s if tuple(int(x.view(np.int64)) for x in _signature(s)) == tuple(w) else None
                        for s, w in zip(shingle_sets(part.column("text"), k), want.tolist())]
                use = [i for i, s in enumerate(sets) if s is not None]
                flat = np.concatenate([sets[i] for i in use]) if use else np.zeros(0, np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(sets[i]) for i in use])]).astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(use, pa.int64())), lists], names=["id", "items"])
    return run


def _signed(k: int):
    """(row, n_shingles, s1, s2) of (text, row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = list(shingle_sets(part.column("text"), k))
                signs = [_signature(s) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([len(s) for s in sets], pa.int64()),
                                                  *(pa.array(np.array([x[i] for x in signs], np.uint64).view(np.int64)) for i in (0, 1))], names=["row", "n_shingles", "s1", "s2"])
    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that follow each other with the same table key, in a sorted partition, where they are of different components: the class, and the
    component and class after it."""
    last = None
    for batch in batches:
        key, node, group = (batch.column(c).to_numpy() for c in ("key", "id", "comp"))
        if last is not None:
            key, node, group = (np.concatenate([[x], y]) for x, y in zip(last, (key, node, group)))
        if len(key):
            last = key[-1], node[-1], group[-1]
            pair = (key[1:] == key[:-1]) & (group[1:] != group[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[:-1][pair], group[1:][pair], node[1:][pair])], names=["id", "fc", "f"])


SMALL = 8                  # rows of an open bucket all of whose pairs are listed
BLOCK_ROWS = 256           # rows of a block of a larger one
BLOCK_ITEMS = 1 << 20      # and shingles
FEW = 8                    # rounds end when one finds no more than this part of all links


def _between(percent: int, least: int):
    """Links that connect different components of two blocks; rows come sorted by (g, p, q), the group and its two blocks."""
    def settle(unit: pa.Table) -> pa.RecordBatch:
        unit = unit.combine_chunks()
        block, node, group = (unit.column(c).to_numpy() for c in ("block", "id", "comp"))
        items = unit.column("items").combine_chunks()
        size = items.value_lengths().to_numpy().astype(np.int64)
        start = np.cumsum(size) - size
        mh = unit.column("mh").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        code = np.unique(items.flatten().to_numpy(), return_inverse=True)[1]
        mine = np.zeros(len(code) + 1, bool)
        top = np.unique(group, return_inverse=True)[1]
        one_block = unit.column("p")[0] == unit.column("q")[0]
        a, b = [], []
        for i in range(len(node) - 1):
            j = np.arange(i + 1, len(node))
            ok = (top[j] != top[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i]))
            j = j[ok if one_block else ok & (block[j] != block[i])]
            j = j[(mh[j] == mh[i]).sum(1) >= least]
            own = code[start[i]:start[i] + size[i]]
            mine[own] = True
            part = np.cumsum(size[j]) >> 22       # so that long texts are not read together
            for k in np.unique(part):
                x = j[part == k]
                first = np.cumsum(size[x]) - size[x]
                both = np.add.reduceat(mine[code[np.repeat(start[x] - first, size[x]) + np.arange(size[x].sum())]].astype(np.int64), first)
                for y in x[100 * both >= percent * (size[x] + size[i] - both)]:
                    if top[y] != top[i]:
                        top[top == top[y]] = top[i]
                        a.append(min(node[i], node[y]))
                        b.append(max(node[i], node[y]))
            mine[own] = False
        return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in ("g", "p", "q")], 1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            if held and any(held[-1].column(c)[held[-1].num_rows - 1] != batch.column(c)[0] for c in ("g", "p", "q")):
                yield settle(pa.Table.from_batches(held))
                held = []
            for x, y in zip(cuts, cuts[1:]):
                held.append(batch.slice(x, y - x))
                if y < batch.num_rows:
                    yield settle(pa.Table.from_batches(held))
                    held = []
        if held:
            yield settle(pa.Table.from_batches(held))
    return run


def _listed(rows: DataFrame) -> DataFrame:
    """All pairs of different components of small buckets, but those with the first class, which the first round has looked at."""
    met = rows.filter((F.col("n") <= SMALL) & (F.col("id") != F.col("f"))).groupBy("key").agg(F.collect_list(F.struct("id", "comp")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(
        F.filter("m", lambda y: (y["id"] > x["id"]) & (y["comp"] != x["comp"])), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))
    return met.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b").distinct()


def _compared(rows: DataFrame, halves: DataFrame, sets: DataFrame, percent: int, least: int) -> DataFrame:
    """Links between components of larger buckets, by blocks of the classes that such buckets connect."""
    large = rows.filter(F.col("n") > SMALL)
    group = components(large.filter("id <> f").select(F.col("f").alias("a"), F.col("id").alias("b")))
    members = save(large.select("id", "comp").distinct().join(group.select(F.col("node").alias("id"), F.col("component").alias("g")), "id")
                   .join(halves.select("id", "mh"), "id").join(sets, "id"))
    blocks = members.groupBy("g").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum(F.size("items")) / BLOCK_ITEMS)).alias("blocks"))
    dealt = (members.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), "blocks"))
             .withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
             .select("g", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "block", "id", "comp", "mh", "items"))
    return dealt.repartition(F.col("g"), F.col("p"), F.col("q")).sortWithinPartitions("g", "p", "q").mapInArrow(_between(percent, least), "a bigint, b bigint")


def _shared(keys: DataFrame) -> DataFrame:
    """Ids that have a key with another id: `keys` is (id, key)."""
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return keys.join(often, "key").select("id").distinct()


def _labels(found: DataFrame) -> DataFrame:
    """(id, comp): the smallest class that a linked class reaches in four links or fewer. Equal labels mean connected; a component that is
    wider than that has several labels, so that more of its pairs are looked at."""
    both = save(found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumnsRenamed({"a": "id", "b": "to"}))
    one = both.groupBy("id").agg(F.least("id", F.min("to")).alias("comp"))
    two = save(both.join(one.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("comp").alias("comp")))
    return two.join(two.select(F.col("id").alias("comp"), F.col("comp").alias("next")), "comp").select("id", F.col("next").alias("comp"))


def _half(side: int, bands: int, rows: int):
    """The keys of one collection, as an array."""
    return F.array(*[F.xxhash64(F.lit(side * bands + i), *[F.get("mh", F.lit((side * bands + i) * rows + r)) for r in range(rows)])
                     for i in range(bands)])


def links(classes: DataFrame, docs: DataFrame, k: int, percent: int, bands: int, rows: int, slack: float = 5.5, rounds: int = 3) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to connect every component. `classes` is (id, mh, least, s1, s2), `least` being a doc_id
    of the class."""
    count, s = 2 * bands * rows, percent / 100
    least = math.floor(count * s - slack * math.sqrt(count * s * (1 - s)))
    halves = classes.select("id", "mh", _half(0, bands, rows).alias("one"), _half(1, bands, rows).alias("two"))
    halves = save(halves.join(_shared(halves.select("id", F.explode("one").alias("key"))), "id", "left_semi"))
    halves = save(halves.join(_shared(halves.select("id", F.explode("two").alias("key"))), "id", "left_semi"))
    tables = (halves.select("id", "one", "two", F.posexplode("one").alias("at", "first"))
              .select("id", "one", "two", "first", "at", F.posexplode("two").alias("to", "second"))
              .select("id", F.xxhash64("at", "to", "first", "second").alias("key"), (F.col("at") == F.col("to")).alias("plain"),
                      # further keys, other ones by the round, that put similar texts side by side in a bucket
                      *[F.get(h, (F.col("at" if h == "one" else "to") + n + 1) % bands).alias(f"t{h}{n}") for n in range(rounds) for h in ("one", "two")]))
    shared = tables.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    tables = save(tables.join(shared, "key").withColumn("comp", F.col("id")))
    # the ids grow with the corpus: never broadcast
    wanted = classes.select("id", "least", "s1", "s2").join(halves.select("id"), "id", "left_semi").hint("merge")
    sets = save(docs.join(wanted, docs["doc_id"] == F.col("least")).select("id", "s1", "s2", "text")
                .mapInArrow(_sets(k), "id bigint, items array<bigint>").groupBy("id").agg(F.any_value("items").alias("items")))
    agree = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, p: n + p)
    both = F.size(F.array_intersect("p", "q"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        close = (pairs.join(halves.select(F.col("id").alias("a"), F.col("mh").alias("x")), "a")
                 .join(halves.select(F.col("id").alias("b"), F.col("mh").alias("y")), "b").filter(agree >= least).select("a", "b"))
        return save(close.join(sets.select(F.col("id").alias("a"), F.col("items").alias("p")), "a")
                    .join(sets.select(F.col("id").alias("b"), F.col("items").alias("q")), "b")
                    .filter(100 * both >= percent * (F.size("p") + F.size("q") - both)).select("a", "b"))

    found, known = None, 0
    for step in range(rounds + 1):
        # a bucket's first class, by a hash that changes by the round; once groups have formed, each class's neighbour too. The first round
        # takes the plain tables before the others: what it links there needs no pairs in them
        turn = max(step - 1, 0)
        used = tables if turn else tables.filter("NOT plain" if step else "plain")
        order = F.struct(F.xxhash64("id", F.lit(turn)) if turn else F.lit(0).cast("bigint"), F.col("id"), F.col("comp"))
        first = (used.groupBy("key").agg(F.min(order).alias("first"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .filter("lo <> hi").select("key", F.col("first.id").alias("f"), F.col("first.comp").alias("fc")))
        tail = [f"t{h}{n % rounds}" for n in range(turn, turn + 2) for h in ("one", "two")]
        open_rows = used.select("key", "id", "comp", *tail).join(first, "key")
        pairs = open_rows.filter("comp <> fc").select("id", "fc", "f")
        if turn:
            side = open_rows.repartitionByRange(F.col("key"), *tail, "id").sortWithinPartitions("key", *tail, "id")
            pairs = pairs.unionByName(side.select("key", "id", "comp").mapInArrow(_neighbours, "id bigint, fc bigint, f bigint"))
            # groups have formed: one class of each other component that a class meets
            pairs = pairs.groupBy("id", "fc").agg(F.min("f").alias("f"))
        pairs = pairs.select(F.least("id", "f").alias("a"), F.greatest("id", "f").alias("b"))
        sure = confirmed(pairs.distinct())
        new = sure.count()
        found, known = sure if found is None else found.unionByName(sure), known + new
        if new:
            tables = save(tables.drop("comp").join(_labels(found), "id", "left").withColumn("comp", F.coalesce("comp", "id")))
        if step and FEW * new <= known:
            break                  # what is left is settled exactly below
    still = (tables.groupBy("key").agg(F.min("id").alias("f"), F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .filter("n > 2 AND lo <> hi").select("key", "f", "n"))
    rows_left = save(tables.select("key", "id", "comp").join(still, "key"))
    found = found.unionByName(confirmed(_listed(rows_left)))
    return found.unionByName(save(_compared(rows_left, halves, sets, percent, least)))


def judged(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """Every row's doc_id, n_shingles, s1 and s2 (signature of its set), component_id and kept."""
    d = columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    sketch = save(d.mapInArrow(_sketches(k, 2 * bands * rows), "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, mh array<int>"))
    real = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # numbered, because texts that differ may have the same doc_id
    classes = save(real.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("least"), F.min("mh").alias("mh")).withColumn("id", F.monotonically_increasing_id()))
    comp = save(components(links(classes, d, k, percent, bands, rows)).join(classes.select(F.col("id").alias("node"), "least"), "node"))
    smallest = comp.groupBy("component").agg(F.min("least").alias("smallest"))
    named = (classes.select("s1", "s2", "n_shingles", "id", "least").join(comp.join(smallest, "component").select(F.col("node").alias("id"), "smallest"), "id", "left")
             .select("s1", "s2", "n_shingles", F.coalesce("smallest", "least").alias("of_class")))
    out = sketch.drop("mh").join(named, ["s1", "s2", "n_shingles"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("of_class"))).otherwise(F.col("doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, bands: int = 10, rows: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (the row is its component's smallest doc_id)."""
    return judged(docs, k, percent, bands, rows).select("doc_id", "n_shingles", "component_id", "kept")


def keep_first(docs: DataFrame, k: int = 3, percent: int = 85, bands: int = 10, rows: int = 3) -> DataFrame:
    """The rows of `docs` that are kept, all columns. Of rows with one doc_id and different texts each is judged by its own text."""
    found = save(judged(docs, k, percent, bands, rows).select("doc_id", "n_shingles", "s1", "s2", "kept").filter("doc_id IS NOT NULL"))
    ids = save(found.groupBy("doc_id").agg(F.min("kept").alias("all"), F.max("kept").alias("any")).filter("NOT all").withColumnRenamed("doc_id", "_of"))
    out = docs.join(ids, F.col("doc_id") == F.col("_of"), "left_anti")
    mixed = docs.join(ids.filter("any"), F.col("doc_id") == F.col("_of"), "left_semi")
    rows_in = mixed.select(text_or_empty().alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    signed = rows_in.mapInArrow(_signed(k), StructType([rows_in.schema["row"], *(StructField(c, LongType()) for c in ("n_shingles", "s1", "s2"))]))
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("_of"), "n_shingles", "s1", "s2").distinct()
    left = signed.withColumn("_of", F.col("row.doc_id")).join(gone, ["_of", "n_shingles", "s1", "s2"], "left_anti").select("row.*")
    return out.unionByName(left)
