"""Micro-batches of landed rows, merged into a versioned table as they come."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import merge
from ..sources import store

#: Buckets of a table. The number belongs to the table: all streams that write it must use the same.
BUCKETS = 64


def merge_stream(spark: SparkSession, landed: str, schema: str, table: str, key: list[str], order: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Starts a query that upserts files arriving in `landed` into the versioned table.

    Within a batch the last row in order wins. The batch id and the stream's id, which its checkpoint holds, are stored with
    each row (seen_batch, seen_stream). A batch that is replayed after a failure finds both there and publishes
    nothing, so every batch counts once; another checkpoint is another stream, whose batches count again. The table is
    hashed into buckets by key, and a batch reads and writes those of its keys alone. after: called with the rows of these
    buckets, and their action, once they are stored. If a failure comes between, the batch's replay calls it with its rows and the
    action `replayed`, so it is called for each batch, maybe more than once.
    """
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    stored, seen = f"{schema}, seen_batch bigint, seen_stream string", ["seen_batch", "seen_stream"]

    def upsert(batch: DataFrame, batch_id: int) -> None:
        delta = merge.last_wins(batch, key, order)
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        touched = [r[0] for r in delta.select(bucket).distinct().collect()]  # `buckets` at most
        base = store.read(batch.sparkSession, table, stored, buckets=touched)
        stream = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        own = base.where((base["seen_batch"] == batch_id) & (base["seen_stream"] == stream))
        if batch.isEmpty():
            return
        if own.limit(1).count():
            if after:
                after(own.select(*columns, *seen).withColumn("action", F.lit("replayed")), batch_id)
            return
        delta = delta.withColumns({"seen_batch": F.lit(batch_id).cast("long"), "seen_stream": F.lit(stream)})
        result = merge.merged(merge.actions(base, delta, key), [*columns, *seen], {*columns, *seen} - set(key))
        store.publish(result.drop("action").withColumn("bucket", bucket).repartition("bucket"), table, ("bucket",))
        if after:
            after(result, batch_id)

    return spark.readStream.schema(schema).parquet(landed).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
