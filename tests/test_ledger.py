"""Keyed state of sources over micro-batches."""

import datetime as dt

from pyspark.sql import functions as F

from kalends.operators import runs
from kalends.streaming.ledger import EVENTS, source_statuses, with_state_store

START = dt.datetime(2026, 8, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def play(spark, tmp_path, batches):
    """The last status of each source after each batch."""
    with_state_store(spark)
    landed, last, seen = f"file://{tmp_path}/in", {}, []

    def keep(df, _):
        for r in df.collect():
            last[r["source_id"]] = r

    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(landed)
        told = spark.readStream.schema(EVENTS).parquet(landed)
        query = source_statuses(told, limit_hours=2).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        seen.append(dict(last))
    return seen


def test_status_follows_runs_and_equals_the_batch(spark, tmp_path):
    first = [(1, 1, at(0), "running", None, None), (1, 1, at(1), "success", 12, None), (2, 2, at(0), "running", None, None), (2, 2, at(1), "failed", 0, "no list"), (None, 9, at(1), "failed", 0, "x")]
    second = [(1, 3, at(2), "running", None, None), (1, 3, at(3), "failed", 3, "slots"), (1, 4, at(4), "partial", 4, None), (2, 5, at(3), "success", 8, None)]
    one, two, again = play(spark, tmp_path, [first, second, second + first[:4]])
    assert (one[1]["error_count"], one[1]["last_success_at"], one[2]["error_count"], one[2]["error_message"]) == (0, at(1), 1, "no list")
    assert {k: tuple(r) for k, r in again.items()} == {k: tuple(r) for k, r in two.items()}
    ledger = spark.createDataFrame(first[:4] + second, EVENTS).where("status <> 'running'").withColumn("said", F.coalesce("message", "status"))
    for r in runs.source_status(ledger, "source_id", "at", "items", F.col("status") != "success", "said").collect():
        s = two[r["source_id"]]
        assert (s["last_checked_at"], s["last_item_count"], s["last_success_at"], s["error_count"], s["error_message"]) == (r["last_checked_at"], r["last_item_count"], r["last_success_at"], r["error_count"], r["error_message"])


def test_runs_that_never_finish_count_as_failed(spark, tmp_path):
    batches = [[(1, 1, at(0), "running", None, None)], [(2, 2, at(9), "success", 1, None)], [(2, 3, at(10), "success", 1, None)], [(1, 4, at(11), "running", None, None), (1, 5, at(12), "running", None, None)]]
    seen = play(spark, tmp_path, batches)
    assert (seen[0][1]["open_run_id"], seen[0][1]["error_count"]) == (1, 0)
    assert (seen[2][1]["open_run_id"], seen[2][1]["error_count"], seen[2][1]["error_message"]) == (None, 1, "run 1 did not finish")
    assert (seen[3][1]["open_run_id"], seen[3][1]["error_count"], seen[3][1]["error_message"]) == (5, 2, "run 4 did not finish")
