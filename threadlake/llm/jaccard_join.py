"""N-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance is a metric, so pivots divide documents into regions, and
the triangle inequality says which pairs in a region can still be near. Two
kinds of pivots are used.

* Single shingles. At distance below 1 from ``{s}`` are just the sets that hold
  s. Among its shingles, in one global order (rare ones first), a set of n is
  replicated to the first ``n - ceil(t*n) + 1``: two sets of similarity t must
  meet in one of those regions, and first in that of their first common
  shingle. Whole documents as first pivots would not do: nearly all documents
  are at distance 1 from nearly all pivots, so each window would hold the corpus.
  Regions with the same members are one region.
* Documents. In a region the members not in its largest component are the
  outsiders; turn by turn some of them (``fan`` times as many as the turn before)
  are pivots, whose exact distances to the members of other components are taken.
  A pair is left out if its sizes, the places of the region's shingle in both, or
  the distances to a common pivot (the triangle inequality's window) rule a link
  out. Pivots then leave the region, links unite components, and a region ends
  when one component is left, so the recursion ends by itself, without a turn for
  all pairs: a group of thousands of near copies costs about one comparison for
  each copy.

The order comes from a fixed-size sketch of shingle frequencies. It affects
speed alone: any order gives the same, exact result. Sets equal to each other
are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import FEW, components, drop_written, lean, narrow, release, written
from threadlake.llm.shingles import pieces, shingled

SKETCH_BITS = 20  # the sketch has 2**SKETCH_BITS counters
CHUNK_BITS = 14
SALTED = 1_000  # comparisons with one pivot that share a task's read of its text


def least_shared(n: int, percent: int) -> int:
    """The fewest shared shingles that a set of n can have with a linked one."""
    return -(-percent * n // 100)


def packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([pack(c.astype("uint32").tobytes()) for c in sums.values()], pa.binary())], names=["chunk", "block"])


def unpacked(block: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(block), "uint32")


def frequencies(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """Counts of shingles by the high bits of their hash, summed over all documents.

    A task sends one compressed block for each chunk of counters, so what is
    shuffled and what reaches the driver does not grow with a task's input.
    """
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting = np.zeros(size, "int64"), [], 0

        def add() -> None:
            nonlocal waiting
            if held:
                total.__iadd__(np.bincount(np.concatenate(held), minlength=size))
            held.clear()
            waiting = 0

        for batch in batches:
            for _, raw, bounds in pieces(batch.column(0)):
                held.append((shingled(raw, bounds, k)[0] >> np.uint64(64 - SKETCH_BITS)).astype("int64"))
                waiting += len(held[-1])
                if waiting >= size:
                    add()
        add()
        if total.any():
            yield packed(dict(enumerate(total.reshape(-1, 1 << CHUNK_BITS))))

    def merge(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in blocks:
            for chunk, block in zip(batch.column("chunk").to_pylist(), batch.column("block").to_pylist()):
                sums[chunk] = sums[chunk] + unpacked(block) if chunk in sums else unpacked(block)
        if sums:
            yield packed(sums)

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = written(texts.mapInArrow(lean(count), "chunk int, block binary").repartition("chunk").mapInArrow(merge, "chunk int, block binary"))
    out = np.zeros((size >> CHUNK_BITS, 1 << CHUNK_BITS), "uint32")
    for row in parts.collect():
        out[row.chunk] += unpacked(bytes(row.block))
    drop_written(parts)
    return out.ravel()


def prefixes(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """``id, n, digest, prefix``: each set's size, a 128-bit digest and its first shingles in the global order."""
    table = docs.sparkSession.sparkContext.broadcast(frequencies(docs, text_col, k))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = table.value
        for batch in batches:
            for at, raw, bounds in pieces(batch.column("text")):
                flat, ends = shingled(raw, bounds, k)
                sizes, digests, rows = [], [], []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    s = np.unique(flat[a:b])
                    n = len(s)
                    take = n - least_shared(n, percent) + 1 if n else 0
                    count = often[(s >> np.uint64(64 - SKETCH_BITS)).astype("int64")]
                    sizes.append(n)
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    rows.append(s[np.argsort(count, kind="stable")[:take]].view("int64"))
                places = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype("int32")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(places, np.concatenate(rows))],
                    names=["id", "n", "digest", "prefix"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return written(rows.mapInArrow(lean(first), "id long, n long, digest binary, prefix array<long>"))


def compared(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """``a, b, p, d, linked`` for each of ``pairs`` (``a < b, p`` one of them), from whole texts (repeated ids: the nearest of their rows).

    A pivot's text travels once for every ``SALTED`` of its pairs, another's
    once for each pair; if the wanted ids are few, texts are picked at the scan.
    Texts travel, not sets: they compress, and hashes do not.
    """

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []  # one pivot's; its own rows come first
        for batch in batches:
            for at, raw, bounds in pieces(batch.column("text")):
                part = batch.slice(at, len(bounds) - 1)
                flat, ends = shingled(raw, bounds, k)
                seen, far, linked = [], [], []
                for i, (p, m) in enumerate(zip(part.column("p").to_pylist(), part.column("m").to_pylist())):
                    y = np.unique(flat[ends[i] : ends[i + 1]])
                    if m is None:
                        if p != now:
                            now, sets = p, []
                        sets.append(y)
                    elif p == now:
                        best, link = 1.0, False
                        for x in sets:
                            if len(x) and len(y):
                                small, large = (x, y) if len(x) < len(y) else (y, x)
                                place = np.searchsorted(large, small)
                                both = int((large[np.minimum(place, len(large) - 1)] == small).sum())
                                united = len(x) + len(y) - both
                                best, link = min(best, 1 - both / united), link or 100 * both >= percent * united
                        seen.append((p, m))
                        far.append(best)
                        linked.append(link)
                if seen:
                    p, m = (np.array(c, "int64") for c in zip(*seen))
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(m), pa.array(far, pa.float64()), pa.array(linked, pa.bool_())], names=["p", "m", "d", "linked"])

    spark = docs.sparkSession
    salts = written(pairs.groupBy("p").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("salts")))
    heads = salts.select(F.col("p").alias("id"), "p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("m"))
    m = F.when(F.col("a") == F.col("p"), F.col("b")).otherwise(F.col("a"))
    others = pairs.select("p", m.alias("m")).join(salts, "p").select(F.col("m").alias("id"), "p", F.pmod(F.xxhash64("m"), F.col("salts")).cast("int").alias("salt"), "m")
    asked = written(heads.unionByName(others))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(narrow(asked, 60), "id").select("p", "salt", "m", "text")
    out = rows.repartition("p", "salt").sortWithinPartitions("p", "salt", F.col("m").asc_nulls_first()).mapInArrow(lean(distances), "p long, m long, d double, linked boolean")
    out = written(out.groupBy("p", "m").agg(F.min("d").alias("d"), F.max("linked").alias("linked")).select(F.least("p", "m").alias("a"), F.greatest("p", "m").alias("b"), "p", "d", "linked"))
    drop_written(asked)
    drop_written(salts)
    release(spark)
    return out


def regions(reps: DataFrame) -> DataFrame:
    """``token, id, n, pos``: the members of each region of two sets or more; of regions with the same members the first in the order.

    Members are told apart by count, least and greatest id and a 64-bit hash of all.
    """
    held = reps.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    kinds = held.groupBy("token").agg(
        F.count("*").alias("members"), F.min("id").alias("low"), F.max("id").alias("high"), F.bit_xor(F.xxhash64("id")).alias("all"), F.sum("pos").alias("places")).where("low <> high")
    # a shingle earlier in the order is earlier in every member, so its places add up to less
    kept = written(kinds.groupBy("members", "low", "high", "all").agg(F.min_by("token", "places").alias("token")).select("token"))
    out = written(held.join(narrow(kept, 24), "token").select("token", "id", "n", "pos"))
    drop_written(kept)
    return out


def windowed(x: Column, y: Column, r: float) -> Column:
    """Whether the distances to every common pivot differ by at most r."""
    return F.forall(F.map_entries(x), lambda e: F.coalesce(F.abs(e["value"] - F.try_element_at(y, e["key"])) <= F.lit(r + 1e-9), F.lit(True)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, fan: int = 16) -> DataFrame:
    """``id, n_shingles, component_id`` for every row of ``docs``.

    Two documents link when ``100 * shared >= percent * united``; the component
    id is the smallest id reachable by links. Null or blank texts have no
    shingles and link with nothing. Rows with the same id are one node, linked
    if any of them is; ids are cast to long, so text that is no number is an
    error under ANSI. Rows with a null id link with nothing and have a null
    component. An empty table gives an empty one; other columns are not read.
    """
    spark, r = docs.sparkSession, 1 - percent / 100
    base = prefixes(docs, id_col, text_col, k, percent)
    named = base.where("n > 0 and id is not null")
    # stored, so that a join with it can be split where a third of all rows are copies of one text
    classes = written(named.groupBy("digest").agg(F.min("id").alias("rep")))
    member = written(named.select("id", "digest").distinct().join(narrow(classes, 80), "digest").select("id", "digest", "rep"))
    copies = member.where("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    twice = member.groupBy("id").agg(F.min(F.xxhash64("digest")).alias("x"), F.max(F.xxhash64("digest")).alias("y")).where("x <> y").select("id")
    twice = written(twice)
    others = member.where("id <> rep").select("id", "digest")
    reps = named.join(narrow(others, 80), ["id", "digest"], "left_anti").select("id", "n", "prefix")
    open_ = regions(reps)
    # ids with several texts have no place in the metric, so their distances prune nothing
    open_ = open_.join(narrow(twice.withColumn("odd", F.lit(True)), 24), "id", "left").select("token", "id", "n", "pos", F.coalesce("odd", F.lit(False)).alias("odd"), F.col("id").alias("part"), F.map_from_arrays(F.array().cast("array<long>"), F.array().cast("array<double>")).alias("away"))
    open_ = written(open_)
    drop_written(twice)
    drop_written(classes)
    release(spark)
    done: list[DataFrame] = []
    q = 1
    while True:
        sizes = open_.groupBy("token", "part").agg(F.count("*").alias("size"))
        main = sizes.groupBy("token").agg(F.max(F.struct("size", "part"))["part"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("token", "main")
        rows = written(open_.join(main, "token"))
        drop_written(open_)
        outside = rows.where("part <> main")
        chosen = written(outside.groupBy("token", F.pmod(F.xxhash64("id"), F.lit(q)).alias("slot")).agg(F.min("id").alias("id")).select("token", "id"))
        if chosen.isEmpty():
            drop_written(rows)
            drop_written(chosen)
            break
        pivot = rows.join(chosen, ["token", "id"], "left_semi").select("token", *[F.col(c).alias(f"p_{c}") for c in ("id", "n", "pos", "odd", "part", "away")])
        fits = F.lit(100 + percent) * F.least(F.col("n") - F.col("pos"), F.col("p_n") - F.col("p_pos")) >= F.lit(percent) * (F.col("n") + F.col("p_n"))
        near = F.col("odd") | F.col("p_odd") | windowed(F.col("away"), F.col("p_away"), r)
        star = rows.join(pivot, "token").where((F.col("part") != F.col("p_part")) & fits & near)
        pairs = star.groupBy(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).agg(
            F.min("p_id").alias("p"), F.max(F.col("odd") | F.col("p_odd")).alias("odd"), F.min(F.least("part", "p_part")).alias("low"), F.max(F.greatest("part", "p_part")).alias("high"))
        if done:
            pairs = pairs.join(reduce(DataFrame.unionByName, [x.select("a", "b") for x in done]), ["a", "b"], "left_anti")
        pairs = written(pairs)
        left = rows.join(chosen, ["token", "id"], "left_anti").drop("main")
        if not pairs.isEmpty():
            seen = compared(pairs, docs, id_col, text_col, k, percent)
            done.append(seen)
            united = pairs.join(seen.where("linked").select("a", "b"), ["a", "b"], "left_semi").select(F.col("low").alias("src"), F.col("high").alias("dst"))
            parts = components(united, few=FEW)
            left = left.join(parts.withColumnRenamed("node", "part"), "part", "left").withColumn("part", F.coalesce("component", "part"))
            m = F.when(F.col("a") == F.col("p"), F.col("b")).otherwise(F.col("a"))
            even = seen.join(pairs.where("not odd").select("a", "b"), ["a", "b"], "left_semi")
            far = even.groupBy(m.alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("p", "d"))).alias("more"))
            left = left.join(far, "id", "left").withColumn("away", F.when(F.col("more").isNull(), F.col("away")).otherwise(F.map_concat("away", "more")))
        open_ = written(left.select("token", "id", "n", "pos", "odd", "part", "away"))
        for old in (rows, chosen, pairs):
            drop_written(old)
        release(spark)
        q *= fan
    links = reduce(DataFrame.unionByName, [x.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst")) for x in done], copies)
    out = base.select("id", F.col("n").alias("n_shingles")).join(components(links, few=FEW).withColumnRenamed("node", "id"), "id", "left")
    return out.select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
