"""Structured Streaming forms of arrival, windowing and job-state processing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadlake.operators.merge import latest
from threadlake.sources.commit import Store
from threadlake.sources.shared import fresh_path

# Where a job that hangs goes back to.
RECOVERED = {"classifying": "pending", "drafting": "eligible"}
# What an event does to a job's state.
STEPS = {
    ("pending", "claim"): "classifying", ("failed", "claim"): "classifying", ("classifying", "newsletter"): "newsletter_skipped", ("classifying", "auto"): "auto_generated",
    ("classifying", "personal"): "eligible", ("classifying", "error"): "failed", ("eligible", "claim"): "drafting", ("drafting", "done"): "drafted", ("drafting", "error"): "failed",
}


def replayed(rows: DataFrame, batch: str, count: int) -> DataFrame:
    """A stream of stored rows, those with ``batch`` 0 first, one micro-batch for each of ``count`` numbers."""
    spark = rows.sparkSession
    folder = fresh_path(spark, "arrivals")
    for k in range(count):  # one after the other, since a source takes files by their age
        rows.where(F.col(batch) == k).drop(batch).coalesce(1).write.parquet(f"{folder}/batch={k}")
    return spark.readStream.schema(rows.drop(batch).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def first_arrivals(stream: DataFrame, key: str = "event_id", at: str = "at", grace: str = "300 seconds") -> DataFrame:
    """Each id once; repeats within the grace are dropped, state older than it is forgotten."""
    return stream.withWatermark(at, grace).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, at: str = "at", width: str = "1 hour", grace: str = "300 seconds") -> DataFrame:
    return stream.withWatermark(at, grace).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("events"))


def bursts(stream: DataFrame, key: str, at: str = "at", quiet: str = "1 hour", grace: str = "300 seconds") -> DataFrame:
    """``key, start, last, events`` of each burst that is over: rows of a key that follow each other in less than ``quiet``, in whatever order they come within ``grace``."""
    found = stream.withWatermark(at, grace).groupBy(key, F.session_window(at, quiet)).agg(F.min(at).alias("start"), F.max(at).alias("last"), F.count("*").alias("events"))
    return found.select(key, "start", "last", "events")


def drained(stream: DataFrame, mode: str = "append", key: Sequence[str] = ()) -> DataFrame:
    """Run a stream over what is there now; the rows that it wrote (in complete mode the last state, in update mode the last row of each key)."""
    spark = stream.sparkSession
    out, mark = fresh_path(spark, "stream"), fresh_path(spark, "progress")

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure writes the same folder again
        batch.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else f'batch={number}'}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    found = spark.read.parquet(f"{out}/all" if mode == "complete" else out)
    if mode == "update":
        found = latest(found, list(key), ["batch"])
    return found.drop("batch")


def merging(store: Store, table: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the last row of each key in a stored table.

    Rows and the number of the batch change in one commit, so a batch that comes
    again after a failure changes nothing, and readers see whole batches.
    """
    marks = f"{table}_batches"

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with store.transaction() as t:
            known = t.tables.get(marks)
            if known and t.read(marks).where(F.col("batch") >= number).limit(1).count():
                return
            rows = batch if table not in t.tables else t.read(table).unionByName(batch)
            t.write(table, latest(rows, [key], [order]))
            t.write(marks, spark.createDataFrame([(number,)], "batch long"))

    return put


def job_states(stream: DataFrame, stuck_after: int | None = None) -> DataFrame:
    """``source_id, state, attempts`` after each batch of ``(source_id, event, seq)``; state is kept for each job.

    With ``stuck_after`` (seconds; the stream then has a watermark on ``at``) a
    job whose last event is older than that goes back from classifying to
    pending and from drafting to eligible once the watermark has passed.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, attempts = held.get if held.exists else ("pending", 0)
        if held.hasTimedOut:
            state = RECOVERED.get(state, state)
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            for event in rows["event"]:
                after = STEPS.get((state, event), state)
                attempts += int(after == "failed" and state != "failed")
                state = after
            if stuck_after is not None and state in RECOVERED:
                last = int(rows["at"].max().timestamp() * 1000) + stuck_after * 1000
                held.setTimeoutTimestamp(max(last, held.getCurrentWatermarkMs() + 1))
        held.update((state, attempts))
        yield pd.DataFrame({"source_id": [key[0]], "state": [state], "attempts": [attempts]})

    return stream.groupBy("source_id").applyInPandasWithState(run, "source_id long, state string, attempts long", "state string, attempts long", "update", GroupStateTimeout.NoTimeout if stuck_after is None else GroupStateTimeout.EventTimeTimeout)
