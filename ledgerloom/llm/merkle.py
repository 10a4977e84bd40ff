"""Merkle manifest of a dataset as a tree of SHA-256 midstates (operator 11).

Every row is a leaf; the leaves of a group, in order, are hashed in runs of `fanout` until one node, the group's subroot, remains, and the
subroots of all groups give the root in the same way. A parent hashes the hex text of its children, 64 bytes each: one block of SHA-256. So
the hash state before each child slot is eight words, and the tree keeps them beside the nodes. To fold a replaced leaf, each level resumes
the state before the leaf's slot, takes the replacement, and then the siblings on its right only; those on its left are in the state already.

1. `leaves`: digests of the rows, as an expression; texts are read once and not shuffled.
2. `ranked`: positions in the group by a range partitioning, with one row per (group, partition) to carry counts over.
3. `build`: aligned blocks of `fanout ** height` leaves are raised by one task each and saved as one row of nodes and states; their tops are
   the leaves of the next stage. A group of any size is spread over blocks, and the number of stages grows with the logarithm.
4. `folds`: blocks from the top down get the path above them; a task folds and proves the rows of one block.

Defined cases: NULL fields count as "-"; rows of a group with equal doc_id (or a NULL one, which comes first) are ordered by leaf, so equal
rows are interchangeable; the NULL group comes first; a lone leaf is its subroot, a lone subroot the root; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import columns, save

HEIGHT = 12     # levels of a block of a binary tree: 4,096 leaves


def _root_bits(n: int, k: int) -> int:
    """The first 32 bits after the point of the k-th root of n."""
    low, high, aim = 0, n << 32, n << 32 * k
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle ** k <= aim else (low, middle - 1)
    return low & 0xFFFFFFFF


_primes = [p for p in range(2, 312) if all(p % q for q in range(2, int(p ** 0.5) + 1))]
_K = np.array([_root_bits(p, 3) for p in _primes], np.uint32)
START = np.array([_root_bits(p, 2) for p in _primes[:8]], np.uint32)
_HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint16)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """One step of SHA-256 for many states (8, n) and their blocks (16, n) or one block (16, 1)."""
    w = list(block)
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[t - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + (w[t] + _K[t])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        h, g, f, e, d, c, b, a = g, f, e, d + one, c, b, a, one + two
    return np.stack([a, b, c, d, e, f, g, h]) + state


def finish(state: np.ndarray, count: int) -> np.ndarray:
    """Digests (8, n) after `count` children."""
    end = np.zeros((16, 1), np.uint32)
    end[0], end[14], end[15] = 0x80000000, (512 * count) >> 32, (512 * count) & 0xFFFFFFFF
    return compress(state, end)


def to_bytes(digests: np.ndarray) -> bytes:
    return np.ascontiguousarray(digests.T).astype(">u4").tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, ">u4").reshape(-1, 8).T).astype(np.uint32)


def hex_text(digests: np.ndarray) -> bytes:
    return _HEX[np.frombuffer(to_bytes(digests), np.uint8)].tobytes()


def hex_block(digests: np.ndarray) -> np.ndarray:
    """The hex text of each digest as a block of 16 words."""
    return np.ascontiguousarray(np.frombuffer(hex_text(digests), ">u4").reshape(-1, 16).T).astype(np.uint32)


def raised(level: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """The parents (8, p) of a level, and the states (fanout, 8, p) before each of their child slots."""
    n = level.shape[1]
    p = -(-n // fanout)
    states = np.empty((fanout, 8, p), np.uint32)
    now = np.repeat(START[:, None], p, 1)
    words = hex_block(level)
    for j in range(fanout):
        states[j] = now
        has = len(range(j, n, fanout))
        if has:
            now[:, :has] = compress(now[:, :has], words[:, j::fanout])
    last = n - (p - 1) * fanout
    if last == fanout:
        return finish(now, fanout), states
    return np.concatenate([finish(now[:, :-1], fanout), finish(now[:, -1:], last)], 1), states


@dataclass
class Step:
    """What one level needs to fold nodes at `slot`: the states before their slots, and all children of their parents."""
    slot: np.ndarray          # (q,)
    count: np.ndarray         # (q,) children of the parent
    state: np.ndarray         # (8, q)
    children: np.ndarray      # (fanout, 8, q), also the node itself


def block_levels(leaves: np.ndarray, fanout: int, height: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """All levels of a block, and the states of each level's parents."""
    levels, states = [leaves], []
    for _ in range(height):
        above, before = raised(levels[-1], fanout)
        levels.append(above)
        states.append(before)
    return levels, states


def steps(levels: list[np.ndarray], states: list[np.ndarray], at: np.ndarray, fanout: int) -> list[Step]:
    out = []
    for level, before in zip(levels, states):
        parent, slot = at // fanout, at % fanout
        n = level.shape[1]
        children = np.stack([level[:, np.minimum(parent * fanout + j, n - 1)] for j in range(fanout)])
        out.append(Step(slot, np.minimum(n - parent * fanout, fanout), before[slot, :, parent].T, children))
        at = parent
    return out


def fold(digests: np.ndarray, path: list[Step], fanout: int) -> np.ndarray:
    """The root that results from `digests` in place of the nodes that the path starts from."""
    for s in path:
        now = compress(s.state, hex_block(digests))
        for j in range(1, fanout):
            at = np.flatnonzero((s.slot < j) & (j < s.count))
            if len(at):
                now[:, at] = compress(now[:, at], hex_block(s.children[j][:, at]))
        digests = np.empty_like(now)
        for count in np.unique(s.count):
            at = np.flatnonzero(s.count == count)
            digests[:, at] = finish(now[:, at], int(count))
    return digests


def proofs(path: list[Step], fanout: int, rows: int) -> list[bytes]:
    """The hex digests of the siblings of each row, level by level, left to right."""
    if not path:
        return [b""] * rows
    text, held = [], []
    for s in path:
        for j in range(fanout):
            text.append(np.frombuffer(hex_text(s.children[j]), np.uint8).reshape(rows, 64))
            held.append((s.slot != j) & (j < s.count))
    text, held = np.stack(text, 1), np.stack(held, 1)
    return [text[i][held[i]].tobytes() for i in range(rows)]


_PATH = "array<struct<slot:int,count:int,state:binary,children:binary>>"


def _packed(path: list[Step], i: int) -> list[dict]:
    return [{"slot": int(s.slot[i]), "count": int(s.count[i]), "state": to_bytes(s.state[:, i:i + 1]),
             "children": to_bytes(s.children[:int(s.count[i]), :, i].T)} for s in path]


def _unpacked(path: list[dict] | None, rows: int, fanout: int) -> list[Step]:
    out = []
    for s in path or []:
        children = np.zeros((fanout, 8), np.uint32)
        children[:s["count"]] = from_bytes(s["children"]).T
        out.append(Step(np.full(rows, s["slot"]), np.full(rows, s["count"]), np.repeat(from_bytes(s["state"]), rows, 1),
                        np.repeat(children[:, :, None], rows, 2)))
    return out


# ---- leaves and positions

def field(c: Column) -> Column:
    """"-" if NULL, else the number of UTF-8 bytes, ":", and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(n_chars: Column | None = None) -> Column:
    parts = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") if n_chars is None else n_chars, F.col("text")]
    return F.unhex(F.sha2(F.concat(*[field(p) for p in parts]), 256))


def group_key(c: Column) -> Column:
    """A text without NULLs in the same order: NULL first, then bytewise."""
    return F.coalesce(F.concat(F.lit("1"), c), F.lit("0"))


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """g (group), doc_id, leaf and, for rows where `changed` holds, the leaf of the same row with one more in n_chars."""
    d = columns(docs, "doc_id", "source", "lang", "n_chars", "text")
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    other = F.lit(None).cast("binary") if changed is None else F.when(changed, leaf(more))
    return d.select(group_key(F.col("lang")).alias("g"), "doc_id", leaf().alias("leaf"), other.alias("other"))


def ranked(nodes: DataFrame, order: list[str], fanout: int) -> DataFrame:
    """Adds pos (0.. in the group g) and levels (of the group's tree)."""
    rows = save(nodes)          # else the sample of the range partitioning would read the texts too
    rows = save(rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("at", F.monotonically_increasing_id())
                .withColumn("part", F.shiftright("at", 33)))
    runs = rows.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    powers, p = [], 1
    while p < 2 ** 62:
        powers.append(p)
        p *= fanout
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("g", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    runs = runs.withColumn("levels", F.size(F.filter(F.array(*[F.lit(x) for x in powers]), lambda x: x < F.col("total"))))
    return save(rows.join(runs, ["g", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("offset")).drop("at", "part", "first", "offset", "total"))


# ---- the tree

@dataclass
class Tree:
    """nodes: (g, pos, levels, leaf, ..) by position; stages: per block its nodes and states; tops: (g, top), the groups' subroots."""
    nodes: DataFrame
    stages: list[DataFrame]
    tops: DataFrame
    fanout: int
    height: int


def _in_order(t: pa.Table, column: str = "pos") -> pa.Table:
    return t.sort_by([(column, "ascending")]).combine_chunks()


def _joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _raise(fanout: int, height: int, done: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = _in_order(t)
        levels = t.column("levels")[0].as_py()
        above, states = block_levels(from_bytes(_joined(t.column("leaf"))), fanout, max(0, min(height, levels - done)))
        return pa.table({"g": pa.array([key[0].as_py()]), "block": pa.array([key[1].as_py()], pa.int64()), "levels": pa.array([levels], pa.int32()),
                         "top": pa.array([to_bytes(above[-1][:, :1])]), "nodes": pa.array([[to_bytes(x) for x in above]]),
                         "states": pa.array([[to_bytes(np.moveaxis(x, 1, 0).reshape(8, -1)) for x in states]], pa.list_(pa.binary()))})
    return run


def build(nodes: DataFrame, fanout: int = 2, height: int = HEIGHT) -> Tree:
    """`nodes`: g, pos, levels, leaf (binary digest)."""
    most = nodes.agg(F.max("levels")).first()[0] or 0
    stages, level, done = [], nodes.select("g", "pos", "levels", "leaf"), 0
    while True:
        stage = save(level.withColumn("block", F.floor(F.col("pos") / fanout ** height)).groupBy("g", "block").applyInArrow(
            _raise(fanout, height, done), "g string, block bigint, levels int, top binary, nodes array<binary>, states array<binary>"))
        stages.append(stage)
        done += height
        if done >= most:
            break
        level = stage.filter(F.col("levels") > done).select("g", F.col("block").alias("pos"), "levels", F.col("top").alias("leaf"))
    tops = None
    for i, stage in enumerate(stages):
        # the stage that brought the group down to one node
        mine = stage.filter(F.col("levels").between(i * height + (1 if i else 0), (i + 1) * height)).select("g", "top")
        tops = mine if tops is None else tops.unionByName(mine)
    return Tree(nodes, stages, tops, fanout, height)


def _restored(t: pa.Table, fanout: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    levels = [from_bytes(x) for x in t.column("nodes")[0].as_py()]
    states = []
    for x in t.column("states")[0].as_py():
        s = from_bytes(x)
        states.append(np.moveaxis(s.reshape(8, fanout, -1), 0, 1))
    return levels, states


def _down(fanout: int):
    """Paths of the nodes of one block: within it, then above it."""
    def run(key: tuple, rows: pa.Table, block: pa.Table) -> pa.Table:
        n = rows.num_rows
        inside = steps(*_restored(block, fanout), np.array(rows.column("slot").to_pylist()), fanout)
        above = block.column("path")[0].as_py() or []
        return pa.table({"g": rows.column("g"), "pos": rows.column("pos"),
                         "path": pa.array([_packed(inside, i) + above for i in range(n)], pa.list_(pa.struct(
                             [("slot", pa.int32()), ("count", pa.int32()), ("state", pa.binary()), ("children", pa.binary())])))})
    return run


def _fold(fanout: int):
    def run(key: tuple, rows: pa.Table, block: pa.Table) -> pa.Table:
        n = rows.num_rows
        path = steps(*_restored(block, fanout), np.array(rows.column("slot").to_pylist()), fanout) + _unpacked(block.column("path")[0].as_py(), n, fanout)
        found = fold(from_bytes(_joined(rows.column("put"))), path, fanout)
        digest = [hashlib.sha256(p).hexdigest() for p in proofs(path, fanout, n)]
        text = hex_text(found).decode()
        return pa.table({"g": rows.column("g"), "doc_id": rows.column("doc_id"), "leaf": rows.column("leaf"), "subroot": pa.array([block.column("top")[0].as_py()] * n),
                         "proof_sha256": pa.array(digest, pa.string()), "folded_root": pa.array([text[64 * i:64 * i + 64] for i in range(n)], pa.string())})
    return run


def _with_path(stage: DataFrame, paths: DataFrame | None, on: list[str]) -> DataFrame:
    if paths is None:
        return stage.withColumn("path", F.lit(None).cast(_PATH))
    return stage.join(paths, on, "left")


def paths(tree: Tree, above: DataFrame | None, stage: int = 0) -> DataFrame | None:
    """(g, pos, path) of the leaves of a stage, up to the root; `above` is (g, path) of each group's subroot. Stage 0 needs no path of its
    own: its nodes are the rows."""
    if stage == len(tree.stages):
        return None
    blocks = blocks_with_paths(tree, above, stage)
    size = tree.fanout ** tree.height
    nodes = (tree.nodes.select("g", "pos") if stage == 0 else tree.stages[stage - 1].filter(F.col("levels") > stage * tree.height).select("g", F.col("block").alias("pos")))
    nodes = nodes.withColumn("block", F.floor(F.col("pos") / size)).withColumn("slot", F.col("pos") % size)
    return save(nodes.groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(_down(tree.fanout), f"g string, pos bigint, path {_PATH}"))


def blocks_with_paths(tree: Tree, above: DataFrame | None, stage: int) -> DataFrame:
    blocks = tree.stages[stage]
    last = F.col("levels") <= (stage + 1) * tree.height          # the block's top is the subroot
    own = paths(tree, above, stage + 1) if stage + 1 < len(tree.stages) else None
    out = _with_path(blocks.filter(last), above, ["g"])
    if own is not None:
        out = out.unionByName(_with_path(blocks.filter(~last), own.withColumnRenamed("pos", "block"), ["g", "block"]))
    return out.select("g", "block", "nodes", "states", "path")


def folds(tree: Tree, above: DataFrame) -> DataFrame:
    """g, doc_id, leaf, subroot, proof_sha256 and folded_root of every row; tree.nodes has `put`, the digest to fold in the row's place."""
    size = tree.fanout ** tree.height
    rows = tree.nodes.select("g", "doc_id", "leaf", "put", F.floor(F.col("pos") / size).alias("block"), (F.col("pos") % size).alias("slot"))
    blocks = blocks_with_paths(tree, above, 0).join(tree.tops, "g")
    return rows.groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(
        _fold(tree.fanout), "g string, doc_id bigint, leaf binary, subroot binary, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, changed: Column | None = None, fanout: int = 2, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row. Where `changed` (on the columns of documents) holds, the
    folded leaf is that of the row with one more in n_chars."""
    nodes = ranked(leaves(docs, changed), ["doc_id", "leaf"], fanout)
    tree = build(nodes.withColumn("put", F.coalesce("other", "leaf")), fanout, height)
    tree.tops = save(tree.tops)
    # one leaf per group, in the order of groups
    upper = build(ranked(tree.tops.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("leaf")), ["name"], fanout), fanout, height)
    above = paths(upper, None).join(upper.nodes.select("g", "pos", "name"), ["g", "pos"]).select(F.col("name").alias("g"), "path")
    root = upper.tops.select(F.lower(F.hex("top"))).first()      # one digest; no row if the table is empty
    text = lambda c: F.lower(F.hex(c))
    return folds(tree, above).select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), F.lit(root and root[0]).cast("string").alias("root"), "proof_sha256",
                                     "folded_root").withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_sevenths() -> Column:
    """Rows where 7 divides the CRC-32 of the decimal doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 0


SQL = """
WITH RECURSIVE bits AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)),
fields AS (SELECT doc_id, lang, n_chars, doc_id IS NOT NULL AND xor(list_reduce(
      list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c // 256, t[CAST(xor(c, b) % 256 AS INTEGER) + 1])), 4294967295) % 7 = 0 AS tampered,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents, bits),
leaves AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS other FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
grown AS (SELECT lang, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM grown WHERE n > 1 GROUP BY lang, level, pos // 2),
subroots AS (SELECT lang, h AS subroot, level AS top, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM grown WHERE n = 1),
crowned AS (SELECT 0 AS level, pos, subroot AS h, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM crowned WHERE n > 1 GROUP BY level, pos // 2),
path AS (SELECT p.doc_id, p.leaf, p.lang, p.pos AS of, s.subroot, s.top, s.pos AS crown, 0 AS level, p.pos, coalesce(p.other, p.leaf) AS h, '' AS seen
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  UNION ALL SELECT a.doc_id, a.leaf, a.lang, a.of, a.subroot, a.top, a.crown, a.level + 1, a.pos // 2,
    CASE WHEN a.pos % 2 = 0 THEN sha256(a.h || coalesce(b.h, '')) ELSE sha256(b.h || a.h) END, a.seen || coalesce(b.h, '')
  FROM path a LEFT JOIN grown b ON b.lang IS NOT DISTINCT FROM a.lang AND b.level = a.level AND b.pos = xor(a.pos, 1) WHERE a.level < a.top),
last AS (SELECT doc_id, leaf, lang, of, subroot, 0 AS level, crown AS pos, h, seen FROM path WHERE level = top
  UNION ALL SELECT a.doc_id, a.leaf, a.lang, a.of, a.subroot, a.level + 1, a.pos // 2,
    CASE WHEN a.pos % 2 = 0 THEN sha256(a.h || coalesce(b.h, '')) ELSE sha256(b.h || a.h) END, a.seen || coalesce(b.h, '')
  FROM last a LEFT JOIN crowned b ON b.level = a.level AND b.pos = xor(a.pos, 1) WHERE a.level < (SELECT max(level) FROM crowned))
SELECT doc_id, leaf, subroot, root, sha256(seen) AS proof_sha256, h AS folded_root, h = root AS verified
FROM last, (SELECT h AS root FROM crowned WHERE n = 1) r WHERE level = (SELECT max(level) FROM crowned)
"""
