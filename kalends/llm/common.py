"""What several operators share: the scratch folder, staged tables and the word rule."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR. `bytes.split()` cuts UTF-8 text
#: at exactly these six, which is why the Python helpers use it.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that Spark hands to a Python worker at once, at most: texts are long, and Spark's own number is made for short rows.
ARROW_ROWS = 2000


def on_workers(spark: SparkSession) -> None:
    """Puts this package on the path of Python workers, for sessions started elsewhere; a cluster ships it with --py-files.

    Also bounds the rows of the session's Arrow batches, where they aren't fewer already; results don't depend on it.
    """
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows; where it is too small a file to keep all cores busy, dealt out anew."""
    on_workers(spark)
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder that the session names in spark.checkpoint.dir.

    Only in local mode may the setting be missing: then driver and executors are one machine and a temporary
    folder does. On a cluster a missing setting is an error, as executors don't see each other's folders.
    """
    on_workers(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kalends-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/kalends-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: computed once, lineage cut, safe when executors go."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a single long column up to which a table is broadcast, some 16 MB; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def few_enough(ids: DataFrame) -> bool:
    """Whether a staged table of one long column is small enough to broadcast."""
    return ids.count() <= BROADCAST_ROWS


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs staged with a column that tells rows apart, whatever their ids are, and the column's name."""
    row = "row"
    while row in docs.columns:
        row += "_"
    return stage(docs.withColumn(row, F.monotonically_increasing_id())), row


def drop_rows(rows: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """The rows whose number isn't in dropped. Texts move only if the numbers are too many to broadcast."""
    dropped = stage(dropped)
    return rows.join(F.broadcast(dropped) if few_enough(dropped) else dropped, row, "left_anti")


def slices(batches, rows: int = 1024):
    """Arrow batches cut to so many rows, so that no more than that is ever held as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def tidy(run):
    """run over Arrow batches, for mapInArrow; when it ends, what it freed goes back to the machine, as workers live on through later stages."""

    @wraps(run)
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return tidied


#: Bytes of text that Python works on together, about; a longer text is worked on alone.
TEXT_BYTES = 4 << 20


def text_slices(batches, column: int = 1, size: int = TEXT_BYTES, rows: int = 8192):
    """Arrow batches cut so that the texts of a column have about so many bytes together."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            upto = min(max(at + 1, int(np.searchsorted(ends, done + size, side="right"))), at + rows)
            yield b.slice(at, upto - at)
            at = upto
    pa.default_memory_pool().release_unused()


def n_buckets(rows: int, per_bucket: int) -> int:
    """How many buckets hold about per_bucket rows each; grows with the data, 1 at least."""
    return max(1, -(-rows // per_bucket))


def n_words(text) -> F.Column:
    """Words of a text column as a long, 0 for null: counts the places where a word begins."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_count(text, F.lit(WORD)).cast("long")
