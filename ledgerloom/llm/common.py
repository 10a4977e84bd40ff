"""What several corpus operators share: reading tables, cutting lineage, and words of whole Arrow columns as numbers.

Words are the runs of bytes other than space and 0x09-0x0D; all of these separators are one byte in UTF-8, so the
buffers of an Arrow string column can be cut without decoding them.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCK_BYTES = 2 << 20      # text handled at once by vectorised code, so that its temporaries stay small

_rng = np.random.Generator(np.random.PCG64(20240229))
PLACE = _rng.integers(1, 2**63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table carries under whatever name."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def scratch(spark: SparkSession) -> str:
    """A new folder name under `spark.checkpoint.dir`. Unset, it is allowed to be a temporary folder only in local mode."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        from ..sources.store import shared_dir
        found = shared_dir(spark)
    return f"{found.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def save(df: DataFrame) -> DataFrame:
    """Write once in the shared folder and read back: the plan so far is not run again, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete a table made by `save` that no later plan reads."""
    spark = df.sparkSession
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about `limit` bytes of text; a longer single text makes a range of its own."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a whole string column, NULL as empty, and where each text starts and ends in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, in place (finaliser of a public hash)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text, and where each text's windows start. A text of 1 to k-1 words has one
    window, the whole of it."""
    count = np.diff(first)
    windows = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(windows)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.repeat(first[:-1] - begin[:-1], windows) + np.arange(begin[-1])
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    short = np.flatnonzero((count > 0) & (count < k))
    total = np.zeros(begin[-1], np.uint64)
    for j in range(k):
        total += padded[at + j] * PLACE[j]
    for d in short:
        part = words[first[d]:first[d + 1]]
        total[begin[d]] = np.append(part * PLACE[:len(part)], np.full(len(part), STEP)).sum()
    return mix(total), begin
