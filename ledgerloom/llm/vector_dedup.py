"""Near-duplicate vectors by spherical k-means and blocked cosine products (operator 12).

1. Vectors that are equal, under the same label, form a class; classes go on with their number of rows.
2. A cell starts as a label (and a number of components). Cells with more than `cell_rows` classes are split by spherical k-means, fitted on
   a bounded sample of each cell (`fit_rows`, about; picked by a hash), again and again until cells are small. A split that saves too few
   comparisons, as in a dense group of near copies, is taken back.
3. A vector lies in the cell of its nearest centre, and in those whose boundary to it is no farther than `reach` standard deviations of
   what a partner at the threshold differs in that direction, tan(angle) / sqrt(dim - 1). Both vectors of a pair may reach over the boundary, so a
   pair is missed only beyond twice that. There is no limit on the number of cells. `reach` sets the recall of pairs near the threshold.
4. A cell's pairs are products of blocks of at most about `BLOCK` rows; small cells share a task. A pair is counted in the first of the
   cells that it shares. A task returns a row per linked vector: its number of links in the block, and one link towards the block's
   component, never the pairs.
5. Links give components by star contractions; the smallest vec_id of each is kept.

Vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows with a NULL label or vec_id, link with nothing and are
kept. Rows with the same vec_id are rows of their own. Vectors of different lengths are never linked. An empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from .common import columns, save

BLOCK = 2048
CHILDREN = 64       # cells that one split makes at most
LEVELS = 12


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, id (digest of label and components; NULL if the row can't link), cell, vec (components as doubles)."""
    for batch in batches:
        lists = batch.column("embedding")
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.fill_null(lists.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False) + 0.0      # no -0.0
        end = np.cumsum(size)
        bad, used = np.concatenate([[0], np.cumsum(~np.isfinite(flat))]), np.concatenate([[0], np.cumsum(flat != 0)])
        ok = (bad[end] == bad[end - size]) & (used[end] > used[end - size]) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
        ids, cells, vectors = [], [], []
        for label, good, n, e in zip(batch.column("label").to_pylist(), ok.tolist(), size.tolist(), end.tolist()):
            if not good or label is None:
                ids.append(None), cells.append(None), vectors.append(None)
                continue
            cell, data = f"{len(label)}:{label}|{n}", flat[e - n:e].tobytes()
            ids.append(hashlib.blake2b(cell.encode() + data, digest_size=16).digest())
            cells.append(cell)
            vectors.append(data)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(ids, pa.binary()), pa.array(cells, pa.string()), pa.array(vectors, pa.binary())],
                                         names=["vec_id", "id", "cell", "vec"])


def unit(vectors: list[bytes]) -> np.ndarray:
    """Vectors of one length, scaled to length one; the largest component goes first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres (k, dim) of unit vectors; a centre that loses all its vectors starts anew at the worst placed one."""
    c = x[np.random.default_rng(7).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        nearest = s.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        lost = np.flatnonzero(np.bincount(nearest, minlength=len(c)) == 0)
        if len(lost):
            sums[lost] = x[np.argsort(s.max(1), kind="stable")[:len(lost)]]
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), c)
    return c


def _fit(cell_rows: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending")])
        n = t.column("n")[0].as_py()
        centres = spherical_means(unit(t.column("vec").to_pylist()), max(2, min(CHILDREN, math.ceil(2 * n / cell_rows))))
        return pa.table({"cell": pa.array([key[0].as_py()]), "n": pa.array([n]), "centres": pa.array([centres.tobytes()])})
    return run


def _assign(threshold: float, reach: float):
    def run(key: tuple, rows: pa.Table, fitted: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        x = unit(rows.column("vec").to_pylist())
        c = np.frombuffer(fitted.column("centres")[0].as_py(), np.float64).reshape(-1, x.shape[1])
        s = x @ c.T
        nearest = s.argmax(1)
        apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))[nearest]
        margin = math.tan(math.acos(threshold)) * reach / math.sqrt(max(x.shape[1] - 1, 1))
        inside = s[np.arange(len(s)), nearest][:, None] - s <= margin * apart
        row, child = np.nonzero(inside)
        cell = key[0].as_py()
        take = pa.array(row)
        return pa.table({"id": rows.column("id").take(take), "parent": pa.array([cell] * len(row), pa.string()),
                         "cell": pa.array([f"{cell}|{j}" for j in child.tolist()], pa.string()), "vec": rows.column("vec").take(take)})
    return run


def cells(classes: DataFrame, threshold: float, cell_rows: int, fit_rows: int, reach: float, gain: float = 0.8) -> DataFrame:
    """(id, cell, vec): the cells of every class; `classes` is (id, cell, vec). A split that leaves more than `gain` of a cell's pairs to be
    compared is taken back."""
    rows, settled = classes.select("id", "cell", "vec"), []
    for _ in range(LEVELS):
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        large = save(sizes.filter(F.col("n") > cell_rows).select("cell", "n", F.ceil(F.col("n") / BLOCK).alias("parts")))
        if large.isEmpty():
            break
        of_large = rows.join(large, "cell")
        sample = of_large.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * F.col("n") < F.lit(fit_rows << 30))
        fitted = save(sample.groupBy("cell").applyInArrow(_fit(cell_rows), "cell string, n bigint, centres binary"))
        # a large cell is dealt into parts, and its centres go to each of them
        part = of_large.select("cell", "id", "vec", F.pmod(F.xxhash64("id", F.lit(1)), "parts").alias("part"))
        each = fitted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / BLOCK) - 1)))
        split = save(part.groupBy("cell", "part").cogroup(each.groupBy("cell", "part")).applyInArrow(
            _assign(threshold, reach), "id binary, parent string, cell string, vec binary"))
        left = (split.groupBy("parent", "cell").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("parent").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")))
        good = save(left.join(large.withColumnRenamed("cell", "parent"), "parent").filter(F.col("pairs") <= gain * F.col("n").cast("double") * F.col("n")).select("parent"))
        settled.append(rows.join(good.withColumnRenamed("parent", "cell"), "cell", "left_anti").select("id", "cell", "vec"))
        rows = save(split.join(good, "parent", "left_semi").select("id", "cell", "vec"))
        if rows.isEmpty():
            break
    for part in settled:
        rows = rows.unionByName(part)
    return rows


def spanning(near: np.ndarray, square: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The components of a relation between rows and columns (the same things if `square`), as (rows, columns)."""
    left, right = near.any(1), near.any(0)
    while left.any():
        rows = ahead = np.array([left.argmax()])
        left[ahead] = False
        found, across = [rows], []
        while len(ahead):
            hit = near[ahead].any(0) & (left if square else right)
            (left if square else right)[hit] = False
            ahead = np.flatnonzero(hit)
            if square:
                found.append(ahead)
                continue
            across.append(ahead)
            hit = near[:, ahead].any(1) & left
            left[hit] = False
            ahead = np.flatnonzero(hit)
            found.append(ahead)
        yield np.concatenate(found), np.concatenate(across) if across else np.zeros(0, np.int64)


def _block(t: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of one cell that have links here, how many, and the first row of their component."""
    block, w = t.column("block").to_numpy(), t.column("w").to_numpy().astype(np.float64)
    x, cell, others = unit(t.column("vec").to_pylist()), t.column("cell")[0].as_py(), t.column("cells").to_pylist()
    two = block.min() != block.max()
    a = np.flatnonzero(block == block.min()) if two else np.arange(len(x))
    b = np.flatnonzero(block == block.max()) if two else a
    near = x[a] @ x[b].T >= threshold
    if not two:
        near |= near.T      # one decision per pair
        np.fill_diagonal(near, False)
    # pairs that share an earlier cell are counted there
    earlier = {}
    member = [(i, earlier.setdefault(c, len(earlier))) for i, own in enumerate(others) for c in own if c < cell]
    if member:
        m = np.zeros((len(x), len(earlier)), np.float32)
        m[tuple(np.array(member).T)] = 1
        near &= m[a] @ m[b].T == 0
    links, root = np.zeros(len(x)), np.full(len(x), -1)
    links[a] = near @ w[b]
    if two:
        links[b] = near.T @ w[a]
    for rows, across in spanning(near, not two):
        both = np.concatenate([a[rows], b[across]])
        root[both] = both.min()
    at = np.flatnonzero(root >= 0)
    return at, np.rint(links[at]).astype(np.int64), root[at]


def _compare(threshold: float):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        p, q = key[1].as_py(), key[2].as_py()
        t = t.sort_by([("cell", "ascending"), ("id", "ascending")]).combine_chunks()
        name = t.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(name)]
        at, links, root = [], [], []
        for x, y in zip(cuts, cuts[1:]):
            part = t.slice(x, y - x)
            if y - x < 2 or (p != q and len(np.unique(part.column("block").to_numpy())) < 2):
                continue
            found = _block(part, threshold)
            at.append(found[0] + x), links.append(found[1]), root.append(found[2] + x)
        cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ids = t.column("id")
        return pa.table({"id": ids.take(pa.array(cat(at))), "links": pa.array(cat(links)), "root": ids.take(pa.array(cat(root)))})
    return run


def links(classes: DataFrame, threshold: float, cell_rows: int, fit_rows: int, reach: float) -> DataFrame:
    """(id, links, root) per block: rows linked to the class there, and a class of the same component. `classes` is (id, cell, vec, w)."""
    placed = save(cells(classes, threshold, cell_rows, fit_rows, reach).join(classes.select("id", "w"), "id"))
    sizes = save(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    lists = placed.groupBy("id").agg(F.collect_list("cell").alias("cells"))
    dealt = (placed.join(sizes, "cell").join(lists, "id")
             .withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), "blocks"))
             .withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
             .withColumn("unit", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cell"), F.lit(total // BLOCK + 1)).cast("string")).otherwise(F.concat(F.lit("c"), "cell")))
             .select("unit", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), "block", "cell", "id", "w", "vec", "cells"))
    return dealt.groupBy("unit", "p", "q").applyInArrow(_compare(threshold), "id binary, links bigint, root binary")


def near_vectors(table: DataFrame, threshold: float = 0.93, cell_rows: int = 1024, fit_rows: int = 4096, reach: float = 0.75) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    d = columns(table, "vec_id", "label", "embedding").withColumn("label", F.col("label").cast("string"))
    rows = save(d.mapInArrow(_prepare, "vec_id bigint, id binary, cell string, vec binary"))
    alone = rows.filter("id IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    real = rows.filter("id IS NOT NULL")
    classes = save(real.groupBy("id").agg(F.any_value("cell").alias("cell"), F.any_value("vec").alias("vec"), F.min("vec_id").alias("least"),
                                          F.count(F.lit(1)).alias("w")))
    found = save(links(classes.select("id", "cell", "vec", "w"), threshold, cell_rows, fit_rows, reach))
    group = save(components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
                 .join(classes.select(F.col("id").alias("node"), "least"), "node"))
    smallest = group.groupBy("component").agg(F.min("least").alias("component_id"))
    named = (group.join(smallest, "component").select(F.col("node").alias("id"), "component_id")
             .join(found.groupBy("id").agg(F.sum("links").alias("links")), "id"))
    known = classes.select("id", "w", "least").join(named, "id", "left").select(
        "id", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    return real.select("vec_id", "id").join(known, "id").select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)


SQL = """
WITH RECURSIVE numbered AS (SELECT vec_id, label, embedding, row_number() OVER () AS r FROM embeddings),
valid AS (SELECT vec_id, label, r, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM numbered
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scaled AS (SELECT vec_id, label, r, v, sqrt(list_dot_product(v, v)) AS norm FROM valid),
linked AS (SELECT a.r, a.vec_id, b.r AS other, b.vec_id AS other_id FROM scaled a JOIN scaled b
  ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reached AS (SELECT r, vec_id AS seen, r AS at FROM scaled
  UNION SELECT x.r, l.other_id, l.other FROM reached x JOIN linked l ON l.r = x.at),
smallest AS (SELECT r, min(seen) AS component_id FROM reached GROUP BY r),
counts AS (SELECT r, count(*) AS n FROM linked GROUP BY r)
SELECT n.vec_id, coalesce(c.n, 0) AS n_links, coalesce(s.component_id, n.vec_id) AS component_id, coalesce(n.vec_id = s.component_id, true) AS kept
FROM numbered n LEFT JOIN smallest s ON s.r = n.r LEFT JOIN counts c ON c.r = n.r
"""
