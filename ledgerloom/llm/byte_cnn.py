"""Quality classifier: a byte-level convolutional network in numpy (operator 9).

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole text (consecutive windows share bytes, and so do
consecutive chunks). Each byte is embedded; one more input says whether a window's bytes stood a few bytes before, as they do in
text that repeats itself. Filters of `WIDTH` bytes are applied every `STRIDE` bytes, and every filter's responses are max-pooled over all chunks; besides the maximum, the mean response is kept, so that how often a
pattern occurs counts as well as whether it occurs. One hidden layer combines them into a probability.

Training: at most `sample` labelled rows (default 3,000, chosen by a hash of doc_id among rows that are not held out), which bounds what
a single machine has to fit. Their texts are learned from whole, chunk by chunk: a first pass pools, a second one hands gradients back.
Labels are the only column used besides the text. Scoring has no bounds.

NULL and empty texts are scored as no bytes. NULL doc_ids are kept and not held out. Repeated rows get equal scores. An
empty label table, or one with a single class, gives the same score to all.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import columns, slices, text_or_empty, utf8

DIM, FILTERS, HIDDEN = 6, 24, 16
WIDTH, STRIDE = 8, 3
LAGS = range(2, 25)        # how far before, in bytes
CHUNK = 2048               # windows of a chunk
TRAIN_CHUNK = 1 << 15      # windows of a chunk in learning
LOW_WEIGHT = 2.0           # what a row of label 0 weighs in learning; there are fewer of them


def held_out(doc_id: str = "doc_id") -> Column:
    """One row in five, by CRC-32 of the id as text; never used for learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Net:
    """Weights, forward pass and training steps, both over whole texts."""

    def __init__(self, seed: int = 7):
        r = np.random.Generator(np.random.PCG64(seed))
        self.w = {
            "embed": r.normal(0, 0.5, (257, DIM)).astype(np.float32),
            "conv": r.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM + 1, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "hid": r.normal(0, (2 * FILTERS) ** -0.5, (2 * FILTERS, HIDDEN)).astype(np.float32),
            "hid_bias": np.zeros(HIDDEN, np.float32),
            "out": r.normal(0, HIDDEN ** -0.5, HIDDEN).astype(np.float32),
            "out_bias": np.zeros(1, np.float32),
        }
        self.w["embed"][256] = 0       # past the end of a text

    def windows(self, raw: np.ndarray) -> np.ndarray:
        """Byte windows over all of one text, and a last column that is 1 where a window repeats. Every byte is in two windows or
        more, except next to the ends."""
        count = max(1, -(-max(len(raw) - WIDTH, 0) // STRIDE) + 1)
        padded = np.full((count - 1) * STRIDE + WIDTH, 256, np.int16)
        padded[:len(raw)] = raw
        out = np.zeros((count, WIDTH + 1), np.int16)
        out[:, :WIDTH] = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STRIDE]
        if len(raw) > WIDTH:       # eight bytes as one number, at every position
            words = np.ndarray((len(raw) - WIDTH + 1,), "<u8", np.ascontiguousarray(raw), strides=(1,))
            for lag in LAGS:
                first = -(-lag // STRIDE)
                now = words[first * STRIDE::STRIDE]
                out[first:first + len(now), WIDTH] |= now == words[first * STRIDE - lag::STRIDE][:len(now)]
        return out

    def inputs(self, windows: np.ndarray) -> np.ndarray:
        x = np.empty((len(windows), WIDTH * DIM + 1), np.float32)
        x[:, :-1] = self.w["embed"][windows[:, :WIDTH]].reshape(len(windows), WIDTH * DIM)
        x[:, -1] = windows[:, WIDTH]
        return x

    def responses(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum(self.inputs(windows) @ self.w["conv"] + self.w["bias"], 0)

    def pooled(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Maximum and mean of each filter over each text, chunk by chunk."""
        out = np.zeros((len(off) - 1, 2 * FILTERS), np.float32)
        for d in range(len(off) - 1):
            w = self.windows(raw[off[d]:off[d + 1]])
            for a in range(0, len(w), CHUNK):
                h = self.responses(w[a:a + CHUNK])
                np.maximum(out[d, :FILTERS], h.max(0), out=out[d, :FILTERS])
                out[d, FILTERS:] += h.sum(0) / len(w)
        return out

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hid = np.maximum(pooled @ self.w["hid"] + self.w["hid_bias"], 0)
        return hid, 1 / (1 + np.exp(-np.clip(hid @ self.w["out"] + self.w["out_bias"], -30, 30)))

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self.head(self.pooled(raw, off))[1].astype(float)

    def gradients(self, batch: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over whole texts given as windows; responses are held for one chunk of windows at a time."""
        size = np.array([len(b) for b in batch])
        all_windows, owner = np.concatenate(batch), np.repeat(np.arange(len(batch)), size)
        chunks = [slice(k, k + TRAIN_CHUNK) for k in range(0, len(owner), TRAIN_CHUNK)]
        pooled = np.zeros((len(batch), 2 * FILTERS), self.w["conv"].dtype)
        for part in chunks:
            h, own = self.responses(all_windows[part]), owner[part]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            at = own[first]
            pooled[at, :FILTERS] = np.maximum(pooled[at, :FILTERS], np.maximum.reduceat(h, first))
            pooled[at, FILTERS:] += np.add.reduceat(h, first) / size[at, None]
        hid, p = self.head(pooled)
        weight = np.where(y == 0, LOW_WEIGHT, 1.0)
        dz = ((p - y) * weight / weight.sum()).astype(self.w["conv"].dtype)
        dhid = np.outer(dz, self.w["out"]) * (hid > 0)
        dpool = dhid @ self.w["hid"].T
        dpool[:, FILTERS:] /= size[:, None]
        g = {"embed": np.zeros((257, DIM), np.float32), "conv": np.zeros_like(self.w["conv"]), "bias": np.zeros_like(self.w["bias"]),
             "hid": pooled.T @ dhid, "hid_bias": dhid.sum(0), "out": hid.T @ dz, "out_bias": np.array([dz.sum()], np.float32)}
        filters = np.arange(FILTERS)
        found = np.zeros((len(batch), FILTERS), bool)          # the first window that reaches a text's maximum takes its gradient
        for part in chunks:
            x, own = self.inputs(all_windows[part]), owner[part]
            h = np.maximum(x @ self.w["conv"] + self.w["bias"], 0)
            dh = dpool[own, FILTERS:]
            first = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
            for a, b in zip(first[:-1], first[1:]):
                t, best = own[a], h[a:b].argmax(0)
                take = ~found[t] & (h[a + best, filters] >= pooled[t, :FILTERS])
                dh[a + best[take], filters[take]] += dpool[t, :FILTERS][take]
                found[t] |= take
            dh *= h > 0
            dx = (dh @ self.w["conv"][:-1].T).reshape(-1, DIM)
            flat = all_windows[part, :WIDTH].ravel()
            g["embed"] += np.stack([np.bincount(flat, dx[:, j], 257) for j in range(DIM)], 1).astype(np.float32)
            g["conv"] += x.T @ dh
            g["bias"] += dh.sum(0)
        g["embed"][256] = 0
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int, rate: float = 0.004, seed: int = 11) -> "Net":
        """Adam over shuffled batches of whole texts. Nothing random but the seeded order."""
        if len(texts) == 0 or y.min() == y.max():
            self.w["out"][:] = 0
            p = (y.sum() + 1) / (len(y) + 2)
            self.w["out_bias"][0] = np.log(p / (1 - p))
            return self
        r = np.random.Generator(np.random.PCG64(seed))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(a) for k, a in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), 32):
                pick = order[a:a + 32]
                g = self.gradients([self.windows(np.frombuffer(texts[i], np.uint8)) for i in pick], y[pick])
                step += 1
                now = rate * (1 - 0.9 * epoch / epochs)
                for k, d in g.items():
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.01 * (d * d - v[k])
                    self.w[k] -= now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, epochs: int = 8) -> Net:
    """Fit on at most `sample` labelled rows that are not held out, spread by hash. Ties and repeats in labels: any one row."""
    y = (columns(labels, "doc_id", "quality").filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
         .groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("order", F.xxhash64(F.col("doc_id"), F.lit("fit"))))
    chosen = y.orderBy("order", "doc_id").limit(sample).select("doc_id", "quality")
    texts = columns(docs, "doc_id", "text").filter("doc_id IS NOT NULL").join(F.broadcast(chosen), "doc_id")     # at most `sample` rows
    texts = texts.groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    rows = texts.orderBy("doc_id").collect()
    return Net().fit([(r["text"] or "").encode() for r in rows], np.array([float(r["quality"]) for r in rows]), epochs)


def _scored(net: Net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                raw, off = utf8(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in part.schema.names), pa.array(net.score(raw, off))], names=[*part.schema.names, "score"])
    return run


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score)."""
    d = columns(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    scored = _scored(net)

    def run(batches):
        for b in scored(batches):
            yield b.select(["doc_id", "score"])
    return d.mapInArrow(run, "doc_id bigint, score double")


def keep_good(docs: DataFrame, net: Net, least: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores at least `least`."""
    from pyspark.sql.types import DoubleType, StructField, StructType
    name = "_score"
    while name in docs.columns:
        name += "_"
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    scored = _scored(net)

    def run(batches):
        for b in scored(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=[*b.schema.names[:-1], name])
    return docs.mapInArrow(run, schema).filter(F.col(name) >= least).drop(name)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score (higher: label 1 likelier), predicted."""
    return score(docs, train(docs, labels, **options)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
