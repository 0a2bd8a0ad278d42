"""Places in a total order, without bringing all rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.sources.shared import stored


def positions(rows: DataFrame, order: Sequence[Column | str], name: str = "position", of: str | None = None) -> DataFrame:
    """``rows`` with their place from 1 in ``order`` (which should leave no ties, or ties fall as they come).

    Rows are sorted by ranges and written; a partition's place is the rows of
    those before it, which is a sum over a row for each partition. With a column
    ``of`` of zeros and ones, only ones count: a zero's place is that of the last
    one before it, or 0.
    """
    number = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    sorted_ = stored(rows.orderBy(*order).select("*", F.spark_partition_id().alias("part_of_order"), number.alias("place_in_part")))
    earlier = Window.partitionBy().orderBy("part_of_order").rowsBetween(Window.unboundedPreceding, -1)
    counts = sorted_.groupBy("part_of_order").agg((F.sum(of) if of else F.count("*")).alias("n"))
    before = counts.select("part_of_order", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    out = sorted_.join(F.broadcast(before), "part_of_order")
    here = F.sum(of).over(Window.partitionBy("part_of_order").orderBy("place_in_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) if of else F.col("place_in_part") + 1
    return out.withColumn(name, F.col("before") + here).select(*rows.columns, name)
