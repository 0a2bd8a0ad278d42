"""Shared helpers: durable intermediate tables, connected components, blanks."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that count as blank in every contract, as regex classes.
BLANK = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"

FEW = 10_000  # edges that one task settles sooner than a round takes
BATCH = 8 << 20  # bytes of an Arrow batch
BROADCAST = 48 << 20  # bytes of a broadcast side, counted before


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in spark.checkpoint.dir. Where a session names none, a
    temporary folder is set if driver and executors are one process (tests,
    notebooks); on a cluster that is an error, since executors would write to
    their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="threadlake-"))
    return context.getCheckpointDir().rstrip("/")


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH) -> Iterator[None]:
    """Arrow batches of about ``size`` bytes for the actions inside, whatever the texts' lengths."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def give_back() -> None:
    """Return freed memory to the system: an idle Python worker keeps what its last task needed otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives memory back when a partition is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def narrow(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows, counted or given, fit into ``BROADCAST`` bytes."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST else df


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """The rows of ``df``, written once as Parquet to the shared folder and read again.

    This cuts the lineage, so a lost executor costs no recomputation, and it
    fixes whatever is not deterministic in ``df`` (generated ids, Python output).
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with small_batches(df.sparkSession):
        writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.threadlake_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.threadlake_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files and broadcasts of plans that are done.

    Its cleaner acts when the driver's garbage is collected, which a long job
    with a roomy heap may not do for half an hour; an operator of many rounds
    calls this between them.
    """
    gc.collect()
    spark._jvm.System.gc()


def stripped(text: Column) -> Column:
    """``text`` without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", "")


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns only (portable to other SQL engines)."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the given edges by union-find; the smallest node names each."""
    top: dict = {}
    kinds = None

    def root(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for batch in batches:
        kinds = batch.schema.types
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = root(top.setdefault(u, u)), root(top.setdefault(v, v))
            top[max(x, y)] = min(x, y)
    if top:
        yield pa.RecordBatch.from_arrays([pa.array(list(top), kinds[0]), pa.array([root(x) for x in top], kinds[1])], names=["node", "component"])


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, few: int = 0) -> DataFrame:
    """Connected components: one row ``(node, component)`` for each node of an edge.

    ``component`` is the smallest node of the component. Alternating large-star
    and small-star steps (Kiveris et al. 2014): each step is one grouped minimum,
    which Spark pre-aggregates before the shuffle, and one equi-join, which AQE
    splits when a hub is skewed. Every round is written to the shared folder, so
    the plan stays short. Only two counters reach the driver. A caller of many
    small graphs may have up to ``few`` edges (``FEW``, say) settled by union-find
    in one Python task instead; by default no edge leaves the JVM.
    Nulls, self loops and repeated edges are ignored; an empty table gives an empty one.
    """
    links = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    links = written(links)
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = state(links)
    if seen[0] == 0:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if seen[0] <= few:  # no more rows than that ever meet in one task
        kind = links.schema["u"].dataType.simpleString()
        return links.coalesce(1).mapInArrow(united, f"node {kind}, component {kind}")
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every edge is seen from both ends; those to smaller neighbours return in the small step
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        nxt = written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = state(nxt)
        drop_written(links)
        links = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
