"""The job machine on Spark's own keyed state: a job's state, its log and its timer, in RocksDB."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadlake.streaming.arrivals import RECOVERED, STEPS

LOG = 5  # entries of a job's log that are kept
OUT = "source_id long, state string, attempts long, log array<string>"


class JobMachine(StatefulProcessor):
    """Takes ``source_id, event, seq, at``; after each batch gives what became of the jobs that changed.

    A job that hangs in a state of ``RECOVERED`` has a timer for ``stuck_after``
    seconds after its last event; when the watermark has passed it, the job goes
    back. The log keeps the last ``LOG`` changes, oldest first.
    """

    def __init__(self, stuck_after: int):
        self.stuck_after = stuck_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, attempts long, due long")
        self.log = handle.getListState("log", "entry string")

    def held(self) -> tuple[str, int, int]:
        found = self.job.get()
        return (found[0], found[1], found[2]) if found is not None else ("pending", 0, 0)

    def noted(self, key: tuple, state: str, attempts: int, due: int, new: list[str]) -> Row:
        entries = ([e[0] for e in self.log.get()] + new)[-LOG:]
        if entries:
            self.log.put([(e,) for e in entries])
        self.job.update((state, attempts, due))
        return Row(source_id=key[0], state=state, attempts=attempts, log=entries)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, attempts, due = self.held()
        new, last = [], 0
        for row in sorted(rows, key=lambda r: r.seq):
            after = STEPS.get((state, row.event), state)
            attempts += int(after == "failed" and state != "failed")
            if after != state:
                new.append(f"{state}>{after}")
            state, last = after, max(last, int(row.at.timestamp() * 1000))
        if due:
            self.handle.deleteTimer(due)
            due = 0
        if state in RECOVERED:
            due = max(last + self.stuck_after * 1000, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
        yield self.noted(key, state, attempts, due, new)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, attempts, _ = self.held()
        back = RECOVERED.get(state, state)
        yield self.noted(key, back, attempts, 0, [f"{state}>{back}"] if back != state else [])

    def close(self) -> None:
        pass


def with_rocks_db(spark: SparkSession) -> None:
    """This kind of state needs the RocksDB store; it has to be set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def job_machine(stream: DataFrame, stuck_after: int) -> DataFrame:
    """``source_id, state, attempts, log`` in update mode; the stream has a watermark on ``at``."""
    with_rocks_db(stream.sparkSession)
    return stream.groupBy("source_id").transformWithState(JobMachine(stuck_after), OUT, "Update", "EventTime")
