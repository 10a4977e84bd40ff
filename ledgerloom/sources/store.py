"""Cutting lineage: tables written to the shared folder of the cluster."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Unset, a temporary folder serves in local mode only: executors elsewhere would each
    write to their own disk and the read-back would lack rows without an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="ledgerloom-"))
    return _local[0]


def save_bucketed(df: DataFrame, key: list[str], buckets: int | None = None, path: str | None = None) -> DataFrame:
    """As `save`, hashed into `buckets` (default: the session's shuffle partitions) and sorted by `key`: tables of the same key and number of
    buckets join without an exchange, however often they are joined. One file a bucket."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or f"{shared_dir(spark).rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"
    name = f"ledgerloom_{uuid.uuid4().hex}"
    df.repartition(n, *key).write.format("parquet").bucketBy(n, *key).sortBy(*key).option("path", path).saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int) -> DataFrame:
    """A table that `save_bucketed` wrote, perhaps in another session: files know their bucket, the catalogue has to be told."""
    name, keys = f"ledgerloom_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in key)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({schema.toDDL()}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def save(df: DataFrame) -> DataFrame:
    """Write once, read back: the plan so far is not computed again and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
