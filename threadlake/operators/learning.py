"""Learning from replies: which drafts to look at, what the user really sent, whose profile it changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import sender_address, sender_domain, trimmed

# Seconds between runs, age of a draft before it is looked at, drafts of a run, days of retention.
DAY, LEAST_AGE, PER_RUN, RETENTION_DAYS = 86_400, 3 * 86_400, 5, 14


def due(last_run: Column, now: int, every: int = DAY) -> Column:
    """Whether a task that last ran then (null: never) is due."""
    return F.lit(now) - F.coalesce(last_run, F.lit(0)) >= every


def awaiting(drafts: DataFrame, now: int, most: int = PER_RUN) -> DataFrame:
    """Drafts old enough that were not learned from, oldest first, at most ``most`` (one run's work)."""
    return drafts.where(F.col("style_learned_at").isNull() & (F.col("generated_at") < now - LEAST_AGE)).orderBy("generated_at", "pk").limit(most)


def first_own_replies(drafts: DataFrame, messages: DataFrame, account: str) -> DataFrame:
    """``pk, thread_id, sender, reply_id, reply``: for each draft the first message of its thread that the account sent afterwards; drafts without one are left out."""
    own = messages.where(F.contains(F.lower("sender"), F.lit(account.lower()))).select("thread_id", "message_id", "date_unix", "text") if account else messages.limit(0).select("thread_id", "message_id", "date_unix", "text")
    later = drafts.select("pk", "thread_id", "sender", "generated_at").join(own, "thread_id").where(F.col("date_unix") > F.col("generated_at"))
    return later.groupBy("pk", "thread_id", "sender").agg(F.min_by(F.struct("message_id", "text"), F.struct("date_unix", "message_id")).alias("r")).select("pk", "thread_id", "sender", F.col("r.message_id").alias("reply_id"), F.col("r.text").alias("reply"))


def fresh(replies: DataFrame, learned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(to learn, to mark only)``: of the drafts of one reply the first is learned from, unless ``learned`` (``thread_id, reply_id``) has it."""
    nth = F.row_number().over(Window.partitionBy("thread_id", "reply_id").orderBy("pk"))
    known = learned.select("thread_id", "reply_id").distinct().withColumn("known", F.lit(True))
    rows = replies.withColumn("nth", nth).join(known, ["thread_id", "reply_id"], "left")
    new = (F.col("nth") == 1) & F.col("known").isNull()
    return rows.where(new).drop("nth", "known"), rows.where(~new).drop("nth", "known")


def scopes(sender: Column) -> Column:
    """``global``, the domain's and the address's scope (if there is one)."""
    return F.array_compact(F.array(F.lit("global"), F.concat(F.lit("domain:"), sender_domain(sender)), F.concat(F.lit("address:"), sender_address(sender))))


def merged_profiles(profiles: DataFrame, samples: DataFrame, now: int, epoch_before: int, epoch_now: int) -> DataFrame:
    """``scope, profile_text, sample_count, updated_at`` after ``samples`` (``scope, profile_text``, one for each scope).

    A sample with an empty text changes nothing. If the profiles were reset in the
    meantime (the epoch moved), all samples are stale and nothing changes: it is
    all of them or none.
    """
    if epoch_before != epoch_now:
        return profiles
    new = samples.select("scope", trimmed(F.col("profile_text")).alias("new_text")).where("new_text <> ''")
    both = profiles.join(new, "scope", "full_outer")
    changed = F.col("new_text").isNotNull()
    return both.select(
        "scope", F.coalesce("new_text", "profile_text").alias("profile_text"), (F.coalesce("sample_count", F.lit(0)) + changed.cast("long")).cast("long").alias("sample_count"),
        F.when(changed, F.lit(now)).otherwise(F.col("updated_at")).cast("long").alias("updated_at"))
