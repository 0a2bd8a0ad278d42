"""The job state machine: transitions, retries, recovery, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States, and those in which a job is over.
STATES = ["pending", "classifying", "newsletter_skipped", "auto_generated", "eligible", "drafting", "drafted", "failed"]
OVER = ["newsletter_skipped", "auto_generated", "drafted"]
MAX_ATTEMPTS, STUCK_AFTER, GRACE = 5, 600, 300


def backoff(attempts: Column) -> Column:
    """Seconds to wait: a minute doubled with each attempt, an hour at most."""
    return F.least(F.pow(F.lit(2.0), attempts) * 60, F.lit(3600.0)).cast("long")


def retry_due(now: int, most: int = MAX_ATTEMPTS) -> Column:
    return (F.col("state") == "failed") & (F.col("attempts") < most) & (F.lit(now) - F.col("updated_at") >= backoff(F.col("attempts")))


def queue(jobs: DataFrame, now: int, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs to classify: pending ones, then failed ones that are due, oldest first in each."""
    rows = jobs.where((F.col("state") == "pending") | retry_due(now, most))
    return rows.withColumn("block", (F.col("state") != "pending").cast("int"))


def recovered(jobs: DataFrame, now: int, after: int = STUCK_AFTER) -> DataFrame:
    """Jobs that hang go back a state."""
    stuck = F.lit(now) - F.col("updated_at") > after
    back = F.when(stuck & (F.col("state") == "classifying"), "pending").when(stuck & (F.col("state") == "drafting"), "eligible")
    return jobs.withColumns({"state": F.coalesce(back, F.col("state")), "updated_at": F.when(back.isNotNull(), F.lit(now)).otherwise(F.col("updated_at")).cast("long")})


def transition(state: Column, event: Column) -> Column:
    """The next state; events that do not fit leave it."""
    rules = [
        ("pending", "claim", "classifying"), ("failed", "claim", "classifying"), ("classifying", "newsletter", "newsletter_skipped"),
        ("classifying", "auto", "auto_generated"), ("classifying", "personal", "eligible"), ("classifying", "error", "failed"),
        ("eligible", "claim", "drafting"), ("drafting", "done", "drafted"), ("drafting", "error", "failed"),
    ]
    out = state
    for before, what, after in rules:
        out = F.when((state == before) & (event == what), F.lit(after)).otherwise(out)
    return out


def pruned(jobs: DataFrame, cutoff: int, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs that retention keeps."""
    over = F.col("state").isin(OVER) | ((F.col("state") == "failed") & (F.col("attempts") >= most))
    return jobs.where(~((F.col("updated_at") < cutoff) & over))
