"""Sharding by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records are
range-partitioned between them, and ranges that turn out overfull are divided
again at quantiles of a row key, so that one key that holds a third of all rows
is spread too. Exact byte totals of the (many, small) ranges then place the
shard borders to within one record.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import uniform, written

PER_RANGE, LEAST_RANGES, MOST_RANGES = 1_000_000, 512, 65_536


def range_of(key: pd.Series, tie: pd.Series, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The number of splitters ``(keys, ties)`` (sorted) at or below each ``(key, tie)``."""
    k, t = key.to_numpy(), tie.to_numpy()
    low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
    out = high.astype("int64")
    for a, b in {(int(a), int(b)) for a, b in zip(low[low < high], high[low < high])}:
        at = (low == a) & (high == b)
        out[at] = a + np.searchsorted(ties[a:b], t[at], "right")
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int = 0) -> DataFrame:
    """``id, size, crc32, shard, slot`` for every row; the shards' bytes are equal to within one record.

    A record's size is the UTF-8 bytes of its text (null: none) plus one. Rows
    are ordered by id, null ids first, and repeated ids by a row number that is
    fixed when the narrow table is written. Shards get numbers in that order;
    with fewer records than shards some shards are empty. ``slot`` counts from 0
    in each shard without gaps. An empty table gives an empty one; other
    columns are not read.

    A range holds about 1/``ranges`` of the bytes; one of more than twice that (or
    than two of the largest record) is divided, until none is left. With
    ``ranges`` 0 there is one for each ``PER_RANGE`` rows, but at least
    ``LEAST_RANGES`` and at most ``MOST_RANGES``. The sample has about ``8 * ranges``
    keys, and only it and one total for each range reach the driver. Ids are cast
    to long.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = written(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc32"), F.monotonically_increasing_id().alias("row"),
    )).withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(-(2**63)))).withColumn("tie", F.xxhash64("row"))
    total, largest, count = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(1)), F.count("*")).first()
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, count // PER_RANGE))
    draws = 8 * ranges
    chance = F.col("size") * F.lit(draws / max(total, 1))
    sample = sorted((r.key, r.tie, r.weight) for r in base.where(uniform("row", seed=7) < chance).select(
        "key", "tie", F.greatest(F.lit(1.0), chance).alias("weight")).collect())
    splits = quantiles(sample, ranges)

    def ranged(splits: list[tuple[int, int]]) -> DataFrame:
        keys, ties = (np.array([s[i] for s in splits], "int64") for i in (0, 1))

        @F.pandas_udf("long")
        def number(key: pd.Series, tie: pd.Series) -> pd.Series:
            return pd.Series(range_of(key, tie, keys, ties))

        return base.withColumn("range", number("key", "tie"))

    # ranges that the sample left overfull are divided again, by a sample of their own
    for _ in range(50):
        split = ranged(splits)
        sizes = {r["range"]: r["size"] for r in split.groupBy("range").agg(F.sum("size").alias("size")).collect()}
        limit = max(2 * total // ranges, 2 * largest)
        over = {k: v for k, v in sizes.items() if v > limit}
        if not over:
            break
        within = split.where(F.col("range").isin(list(over)))
        chance = F.least(F.lit(1.0), F.col("size") * F.lit(draws / max(1, sum(over.values()))))
        more = sorted((r.key, r.tie, 1.0) for r in within.where(uniform("row", seed=11) < chance).select("key", "tie").collect())
        splits = sorted({*splits, *quantiles(more, max(2, 2 * sum(over.values()) * ranges // max(1, total)))})
    else:
        raise RuntimeError("ranges stay overfull")  # row keys differ, so any range can be divided
    bases, run = [], 0
    for k in sorted(sizes):
        bases.append((int(k), int(run)))
        run += sizes[k]
    before = docs.sparkSession.createDataFrame(bases or [(0, 0)], "range long, before long")
    order = Window.partitionBy("range").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = split.join(F.broadcast(before), "range").withColumn("upto", F.col("before") + F.sum("size").over(order))
    middle = F.col("upto") - F.col("size") / 2
    cut = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1)))).cast("int")
    placed = written(summed.select("id", "size", "crc32", "range", cut.alias("shard"), F.col("upto")))
    # slots: rows before in the shard's earlier ranges, then the place in the own range
    parts = placed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    prior = parts.withColumn("prior", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slot = F.col("prior") + F.row_number().over(Window.partitionBy("shard", "range").orderBy("upto")) - 1
    return placed.join(F.broadcast(prior.drop("n")), ["shard", "range"]).select("id", "size", "crc32", "shard", slot.cast("long").alias("slot"))


def quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    """At most ``parts - 1`` distinct keys that divide the sample's weight evenly."""
    if not sample:
        return []
    reach = np.cumsum([s[2] for s in sample])
    at = np.searchsorted(reach, reach[-1] * np.arange(1, parts) / parts)
    return sorted({sample[i][:2] for i in at})
