"""Reading and writing: labelled and unlabelled splits, caches with a manifest, predictions and reports."""
from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .store import open_bucketed, save_bucketed


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_split(facts: DataFrame, details: DataFrame, row_id: str, drop: tuple = ("Unnamed: 0",)) -> DataFrame:
    """Facts with their 0..1 detail row."""
    return facts.drop(*drop).join(details.drop(*drop), row_id, "left")


def labelled(df: DataFrame, label: str) -> DataFrame:
    if label not in df.columns:
        raise ValueError(f"split does not contain {label}")
    return df


def unlabelled(df: DataFrame, label: str) -> DataFrame:
    """The label is left out of the projection, so the scan does not read it."""
    return df.select(*[c for c in df.columns if c != label])


def fingerprint(df: DataFrame) -> dict:
    """Row count and an order-free hash of all rows: one distributed pass, whatever the size of the files."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("x"), F.sum(F.shiftright(h, 16)).alias("s")).first()
    return {"rows": r["rows"], "hash": f"{r['x']}:{r['s']}", "columns": df.columns}


def fingerprint_row(df: DataFrame) -> DataFrame:
    """`fingerprint` as a table of one row (rows, hash), to be compared inside a plan."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat_ws(":", F.bit_xor(h), F.sum(F.shiftright(h, 16))).alias("hash"))


WHOLE_FILE = 64 << 20      # bytes up to which a file is hashed as one value of a row
FILE_BLOCK = 8 << 20       # bytes of a larger file that a task holds at a time


def _hash_streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs
    for batch in batches:
        for path, length in zip(batch["path"], batch["length"]):
            local = path.startswith("file:") or "://" not in path
            store, at = (fs.LocalFileSystem(), re.sub("^file:(//)?(?=/)", "", path)) if local else fs.FileSystem.from_uri(path)
            h = hashlib.sha256()
            with store.open_input_stream(at) as stream:
                while block := stream.read(FILE_BLOCK):
                    h.update(block)
            yield pd.DataFrame({"path": [path], "length": [length], "sha256": [h.hexdigest()]})


def file_hashes(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """(path, length, sha256) per file of any size.

    Files of up to `whole` bytes are hashed as a value of their row. Larger ones are only listed by the reader, and the task that a
    file falls to streams it block by block, so no task holds more than `whole` bytes or a block. Streams are opened by Arrow's file systems.
    Files without any byte are not listed by Spark's readers and have no row here.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole).select("path", "length").repartition(F.col("path"))
    return small.unionByName(large.mapInPandas(_hash_streams, "path string, length bigint, sha256 string"))


def check_hashes(found: DataFrame, expected: DataFrame, name: str = "name", sha: str = "sha256") -> DataFrame:
    """(name, status): 'same', 'changed', 'missing' (expected only) or 'unexpected' (found only). Files are known by the last part of the path."""
    f = found.select(F.element_at(F.split("path", "/"), -1).alias("_file"), F.col("sha256").alias("_found"))
    e = expected.select(F.col(name).alias("_want"), F.lower(sha).alias("_sha"))
    status = (F.when(F.col("_file").isNull(), "missing").when(F.col("_want").isNull(), "unexpected")
              .when(F.col("_sha").eqNullSafe(F.col("_found")), "same").otherwise("changed"))
    return f.join(e, F.col("_file") == F.col("_want"), "full").select(F.coalesce("_want", "_file").alias("name"), status.alias("status"))


def cached_matrix(spark: SparkSession, path: str, recipe: str, inputs: dict[str, dict], build) -> tuple[DataFrame, bool]:
    """The matrix stored under `path` if recipe version and input fingerprints are the same, else a new one."""
    manifest = json.dumps({"recipe": recipe, "inputs": inputs}, sort_keys=True)
    try:
        stored = spark.read.json(f"{path}/manifest").first()
        if stored is not None and stored["manifest"] == manifest:
            return spark.read.parquet(f"{path}/matrix"), True
    except Exception as e:  # not there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    build().write.mode("overwrite").parquet(f"{path}/matrix")
    spark.createDataFrame([(manifest,)], "manifest string").write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.parquet(f"{path}/matrix"), False


def cached_bucketed(spark: SparkSession, path: str, recipe: str, inputs: dict[str, dict], key: list[str], buckets: int, build) -> tuple[DataFrame, bool]:
    """As `cached_matrix`, as a table bucketed and sorted by `key`; the bucket spec belongs to the manifest. A new matrix gets a folder of its own and
    the manifest is written last, so a run that breaks off leaves the old one in force."""
    manifest = json.dumps({"recipe": recipe, "inputs": inputs, "key": key, "buckets": buckets}, sort_keys=True)
    try:
        stored = spark.read.json(f"{path}/manifest").first()
        if stored is not None and stored["manifest"] == manifest:
            return open_bucketed(spark, stored["place"], T.StructType.fromJson(json.loads(stored["schema"])), key, buckets), True
    except Exception as e:  # not there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    place = f"{path}/matrix-{uuid.uuid4().hex}"
    made = save_bucketed(build(), key, buckets, place)
    (spark.createDataFrame([(manifest, place, made.schema.json())], "manifest string, place string, schema string")
     .coalesce(1).write.mode("overwrite").json(f"{path}/manifest"))
    return made, False


def write_folds(df: DataFrame, path: str, fold: str) -> None:
    df.write.mode("overwrite").partitionBy(fold).parquet(path)


def read_fold(spark: SparkSession, path: str, fold: str, value, required: list[str]) -> DataFrame | None:
    """One fold of a prediction cache (the others are pruned), or None if it lacks a column."""
    d = spark.read.parquet(path)
    return None if set(required) - set(d.columns) else d.filter(F.col(fold) == value)


def write_predictions(df: DataFrame, path: str, row_id: str, score: str) -> None:
    df.select(row_id, score).write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def template(df: DataFrame, row_id: str, score: str) -> DataFrame:
    return df.select(row_id, F.lit(0.5).alias(score))


def overview(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows, columns and bytes per table."""
    parts = []
    for name, path in paths.items():
        d = spark.read.parquet(path)
        # no table column is read: files report their size, row groups their count
        size = (d.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path")
                .agg(F.count(F.lit(1)).alias("n"), F.max("file_size").alias("b")))
        parts.append(size.agg(F.sum("n").alias("rows"), F.sum("b").alias("bytes")).select(
            F.lit(name).alias("name"), "rows", F.lit(len(d.columns)).alias("columns"), "bytes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
