"""The status of each source, kept while its runs start and finish."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import MESSAGE_LIMIT

#: Rows of the stream: what a run tells when it starts (status `running`) and when it is over.
EVENTS = "source_id long, run_id long, at timestamp, status string, items long, message string"
#: Rows of the result: the status of a source after a batch that told of it.
STATUS = (
    "source_id long, last_checked_at timestamp, last_item_count long, last_success_at timestamp, error_count long, error_message string, open_run_id long"
)
_STATE = "told_at long, told_run long, open_run long, items long, success_at long, errors long, message string"
#: Hours after which a run that hasn't finished counts as failed.
LIMIT_HOURS = 6.0


def _micros(at) -> int:
    return int(at.timestamp() * 1_000_000 + 0.5)


class SourceState(StatefulProcessor):
    """State of one source: its open run, failures since the last success, and timers for runs that never finish.

    Rows not later than the last one that was told (by time, then run) change nothing, so what lands twice counts once. A run that is
    over without having started counts too. A second run that starts leaves the first one unfinished, which counts as failed.
    """

    def __init__(self, limit_hours: float):
        self.limit = int(limit_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", _STATE)

    def _failed(self, s: dict, message: str) -> None:
        s["errors"], s["message"] = s["errors"] + 1, message[:MESSAGE_LIMIT]

    def _held(self) -> dict:
        names = [c.split()[0] for c in _STATE.split(", ")]
        return dict(zip(names, self.state.get())) if self.state.exists() else dict.fromkeys(names) | {"errors": 0}

    def _row(self, key: tuple, s: dict) -> Row:
        from datetime import datetime, timezone

        moment = lambda us: None if us is None else datetime.fromtimestamp(us / 1_000_000, timezone.utc)
        return Row(
            source_id=key[0], last_checked_at=moment(s["told_at"]), last_item_count=s["items"], last_success_at=moment(s["success_at"]), error_count=s["errors"], error_message=s["message"], open_run_id=s["open_run"]
        )

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        s = self._held()
        for r in sorted(rows, key=lambda r: (r["at"], r["run_id"], r["status"] != "running")):
            at, running = _micros(r["at"]), r["status"] == "running"
            told = (at, r["run_id"], not running)
            if s["told_at"] is not None and told <= (s["told_at"], s["told_run"], s["open_run"] != s["told_run"]):
                continue
            if s["open_run"] is not None and s["open_run"] != r["run_id"]:
                self._failed(s, f"run {s['open_run']} did not finish")
            s["told_at"], s["told_run"] = at, r["run_id"]
            if running:
                s["open_run"] = r["run_id"]
                self.handle.registerTimer(at // 1000 + self.limit)
                continue
            s["open_run"], s["items"] = None, r["items"]
            if r["status"] == "success":
                s["success_at"], s["errors"], s["message"] = at, 0, None
            else:
                self._failed(s, r["message"] or r["status"])
        self.state.update(tuple(s.values()))
        yield self._row(key, s)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        s = self._held()
        if s["open_run"] is not None and s["told_at"] // 1000 + self.limit <= expiredTimerInfo.getExpiryTimeInMs():
            self._failed(s, f"run {s['open_run']} did not finish")
            s["open_run"] = None
            self.state.update(tuple(s.values()))
            yield self._row(key, s)

    def close(self) -> None:
        pass


def source_statuses(told: DataFrame, limit_hours: float = LIMIT_HOURS, late: str = "1 hour") -> DataFrame:
    """A stream of STATUS rows from a stream of EVENTS rows: each batch tells the new status of the sources that it, or a timer, touches.

    The last row of a source equals operators.runs.source_status() over all its runs that are over. Needs the RocksDB state store (see
    with_state_store). A batch's rows of one source are ordered in memory, so bound batches (maxFilesPerTrigger).
    """
    kept = told.where(F.col("source_id").isNotNull() & F.col("run_id").isNotNull() & F.col("at").isNotNull()).withWatermark("at", late)
    return kept.groupBy("source_id").transformWithState(statefulProcessor=SourceState(limit_hours), outputStructType=STATUS, outputMode="Update", timeMode="EventTime")


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that keyed state needs; queries started before keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark
