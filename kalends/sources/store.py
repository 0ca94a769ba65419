"""Versioned Parquet tables: a version is a folder, the current one is the last that finished.

Spark writes `_SUCCESS` once a version is whole, so a reader never sees half a version and the version that a merge reads
is not the folder it writes. A table that is partitioned by `bucket` may hold in a version those buckets alone that it
changes; each bucket is then read from the last version that has it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder, jvm


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, oldest first."""
    fs, folder, jvm = _files(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def _buckets(spark: SparkSession, path: str, found: list[int]) -> dict[int, str]:
    """The folder of each bucket's last state in these versions; empty for tables without buckets."""
    fs, _, jvm = _files(spark, path)
    last = {}
    for v in found:
        for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}")):
            name = s.getPath().getName()
            if name.startswith("bucket="):
                last[int(name[7:])] = f"{path}/v={v}/{name}"
    return last


def read(spark: SparkSession, path: str, schema: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The given or current version, or only some of its buckets; an empty table before the first."""
    found = versions(spark, path)
    if version is not None:
        found = [v for v in found if v <= version]
    parts = _buckets(spark, path, found)
    folders = [f for b, f in parts.items() if buckets is None or b in buckets] if parts else [f"{path}/v={v}" for v in found[-1:]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Writes the next version and returns its number.

    A writer first creates the version's claim, which only one can; a second writer fails before it touches anything. A
    failed write takes its claim back; after a lost driver, `forget` does.
    """
    spark = df.sparkSession
    fs, folder, jvm = _files(spark, path)
    found = versions(spark, path)
    number = (found[-1] if found else 0) + 1
    if not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/{number}")):
        raise FileExistsError(f"version {number} of {path} is being written or was left unfinished")
    try:
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{path}/v={number}")
    except BaseException:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v={number}"), True)
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/{number}"), False)
        raise
    return number


def forget(spark: SparkSession, path: str) -> None:
    """Takes back the claim and folder of a version whose writer is gone. Only for tables that nobody is writing."""
    fs, _, jvm = _files(spark, path)
    found = versions(spark, path)
    number = (found[-1] if found else 0) + 1
    for name in (f"v={number}", f"_claims/{number}"):
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)


def staged(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """df as a table in the folder that the session names in spark.checkpoint.dir: computed once, safe when executors go.

    Only in local mode may the setting be missing, as then driver and executors share a temporary folder.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kalends-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def in_order(df: DataFrame, order: list, per_slice: int, name: str = "_slice", partition_by: bool = False) -> DataFrame:
    """df staged with the number of its slice: slices hold about per_slice rows and follow one another in order. Equal rows share one."""
    df = df if partition_by else staged(df)
    n = max(1, -(-df.count() // per_slice))
    return staged(df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()), (name,) if partition_by else ())
