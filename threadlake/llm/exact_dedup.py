"""Exact deduplication with a heavy-hitter split.

Misra-Gries counters (Spark's built-in mergeable ``freqItems`` aggregate, at
most ``1/support`` counters for each task) name the digests that may be
frequent. An exact count verifies them; the verified winners, of which there
can be no more than ``1/support``, are broadcast, so the rows of large groups
are settled on the map side and never meet in one reducer. All other digests
go through an ordinary shuffle, where no group holds more than ``support`` of
the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import stripped, written


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, points``: the SHA-256 of the text without blanks, and the original's code points."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.sha2(stripped(F.col(text_col)).cast("binary"), 256).alias("digest"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"),
    )


def best(prefix: str = "") -> list:
    """Aggregates: the id that stays (most code points, then smallest id, null last) and the group's size."""
    order = F.struct("points", (F.lit(-1) * F.col("id").cast("decimal(20,0)")).alias("neg"))
    return [F.max_by("id", order).alias(prefix + "keep"), F.count("*").alias(prefix + "size")]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """``id, keep_id, group_size, kept, digest`` for every row of ``docs``.

    Null texts count as empty, and all empty texts form one group. Rows that
    repeat an id are all returned; of rows with the same text and id each has
    ``kept`` true when the id is the one that stays. An empty table gives an
    empty one. Ids are whole numbers (text that is none is an error under
    ANSI). Other columns of ``docs`` are neither read nor returned, so their
    names cannot clash.
    """
    base = written(fingerprints(docs, id_col, text_col))
    counters = base.stat.freqItems(["digest"], support)
    maybe = counters.select(F.explode("digest_freqItems").alias("digest"))
    frequent = base.join(F.broadcast(maybe), "digest", "left_semi")
    least = base.count() * support
    winners = written(frequent.groupBy("digest").agg(*best("h_")).where(F.col("h_size") >= least).coalesce(1))
    marked = base.join(F.broadcast(winners), "digest", "left")
    heavy = marked.where("h_size is not null").select("id", "digest", F.col("h_keep").alias("keep_id"), F.col("h_size").alias("group_size"))
    rest = base.join(F.broadcast(winners), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(*best())
    light = rest.join(groups, "digest").select("id", "digest", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"))
    return heavy.unionByName(light).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "keep_id", "group_size", "kept", "digest")
