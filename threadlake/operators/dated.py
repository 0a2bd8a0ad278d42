"""Date ranges over dated rows by time buckets.

A bucket is ``WIDTH`` seconds. Rows that are written by bucket (:func:`write`) give a
range the folders it needs and nothing else. Of a range the oldest ``top_k`` rows are
wanted, so only its first buckets are taken, until they hold enough, and in these it
is given its place in the order of time instead of being compared with rows.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.operators.ordering import positions
from threadlake.sources.shared import stored

WIDTH = 30 * 86_400


def bucketed(rows: DataFrame, at: str = "date_unix") -> DataFrame:
    return rows.withColumn("bucket", F.floor(F.col(at) / WIDTH).cast("long"))


def write(rows: DataFrame, path: str, at: str = "date_unix") -> None:
    """Rows in a folder for each bucket, sorted by time; rows without a date have a folder of their own that no range opens."""
    dated = bucketed(rows, at)
    dated.repartitionByRange(F.col("bucket"), F.col(at)).sortWithinPartitions("bucket", at).write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def counts(rows: DataFrame) -> DataFrame:
    """``bucket, rows``: a row for each month or so that has any."""
    return rows.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("rows"))


def opened(starts: list[int], buckets: list[tuple[int, int]], top_k: int) -> list[int]:
    """Of sorted ``buckets`` (bucket, rows) those that the ``top_k`` oldest rows from the buckets ``starts`` on can be in.

    A range begins somewhere in its first bucket, so that one counts as empty; of
    the others those are taken that have fewer than ``top_k`` rows before them.
    """
    numbers, ahead = [b for b, _ in buckets], [0, *accumulate(n for _, n in buckets)]
    taken, done = set(), 0
    for start in sorted(starts):
        i = bisect_left(numbers, start)
        after = i + (numbers[i : i + 1] == [start])
        end = min(len(numbers), bisect_left(ahead, ahead[after] + top_k))
        taken.update(numbers[max(i, done) : end])
        done = max(done, end)
    return sorted(taken)


def oldest_in(ranges: DataFrame, rows: DataFrame, top_k: int, id_col: str = "chunk_id", at: str = "date_unix") -> DataFrame:
    """``qid, id, date, at``: the ``top_k`` oldest rows of each closed range ``qid, lo, hi``, by date, then id, numbered from 1.

    Rows are numbered in their order, in which ranges find where they begin, those
    with one beginning together; what follows is looked up by number, so no range
    meets more than ``top_k`` rows. ``rows`` with a column ``bucket`` are a table
    that :func:`write` made, of which only the needed folders are read; others get
    their bucket here.
    """
    stored_ = "bucket" in rows.columns
    rows = rows if stored_ else bucketed(rows, at)
    months = [(r.bucket, r.rows) for r in counts(rows).orderBy("bucket").collect()]  # of months, not of rows
    low, high = (months[0][0], months[-1][0]) if months else (0, -1)
    # a range that begins before the rows do begins with them
    cut = ranges.where("lo <= hi").select("qid", F.greatest("lo", F.lit(low * WIDTH)).alias("lo"), "hi")
    cut = cut.withColumn("bucket", F.floor(F.col("lo") / WIDTH).cast("long")).where(F.col("bucket") <= high)
    starts = cut.select("bucket", "lo").distinct()
    firsts = [r[0] for r in starts.select("bucket").distinct().collect()]
    wanted = opened(firsts, months, top_k)
    rows = rows.where(F.col("bucket").isin(wanted))
    kind = rows.schema[id_col].dataType
    both = rows.select(F.col(at).alias("when"), F.lit(1).alias("row"), F.col(id_col).alias("id")).unionByName(starts.select(F.col("lo").alias("when"), F.lit(0).alias("row"), F.lit(None).cast(kind).alias("id")))
    placed = stored(positions(both, ["when", "row", "id"], "nth", of="row"))
    begins = placed.where("row = 0").select(F.col("when").alias("lo"), F.col("nth").alias("from"), F.explode(F.sequence(F.col("nth") + 1, F.col("nth") + top_k)).alias("nth"))
    found = begins.join(placed.where("row = 1").select("nth", F.col("id").alias(id_col), F.col("when").alias(at)), "nth")
    # ranges of one beginning share a few rows, which stay together until ranges have found them
    lists = found.groupBy("lo").agg(F.collect_list(F.struct((F.col("nth") - F.col("from")).cast("int").alias("at"), id_col, at)).alias("found"))
    met = cut.join(lists, "lo").select("qid", "hi", F.explode("found").alias("f"))
    return met.where(F.col(f"f.{at}") <= F.col("hi")).select("qid", f"f.{id_col}", f"f.{at}", "f.at")
