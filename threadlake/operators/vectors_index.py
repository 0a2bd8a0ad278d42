"""Exact nearest vectors from a stored index.

Unit vectors are written by cluster, sorted by their distance to the cluster's centre.
By the triangle inequality a question at distance d from a centre is at least |d - r|
from a vector at distance r from it, so with the ``top_n``-th best score of the nearest
clusters as a threshold, clusters whose every vector is too far stay closed, and of the
others only a ring of distances is read. Centres are fitted on a bounded sample; every
vector is indexed, and the answer does not depend on the centres.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.index import ranked
from threadlake.sources.shared import stored

SAMPLE, ROUNDS = 20_000, 12  # vectors that centres are fitted on, and rounds of fitting
MOST_CLUSTERS = 4_096
LITERALS = 100  # rings that a filter names; more are joined
BLOCK_VALUES = 1_000_000  # numbers in a block of question vectors
SLACK = 1e-6  # scores are rounded to six places


def units(values: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(values, axis=1)
    return values / np.where(n > 0, n, 1)[:, None]


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, size)


def centres_of(sample: np.ndarray, clusters: int, seed: int = 3) -> np.ndarray:
    """Lloyd's rounds from random vectors of the sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(clusters, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = (sample @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, sample)
        held = np.bincount(near, minlength=len(centres))
        centres = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], centres)
    return centres


class VectorIndex:
    """The index at ``path``: ``vectors`` (``cluster, chunk_id, away, unit``), and ``clusters`` (``cluster, centre, low, high, n``)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame, size: int, clusters: int | None = None) -> None:
        """Index the vectors (``chunk_id, vec``) of ``size`` numbers; those of another length and nulls are left out.

        By default there are as many clusters as the square root of the rows, at most ``MOST_CLUSTERS``.
        """
        rows = vectors.where(F.size("vec") == size).select(F.col("chunk_id").cast("long").alias("chunk_id"), "vec")
        total = rows.count()
        count = clusters or max(1, min(MOST_CLUSTERS, round(total**0.5)))
        share = min(1.0, 2 * SAMPLE / max(1, total))
        picked = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(SAMPLE).select("vec").toArrow()
        sample = units(matrix(picked.column("vec").combine_chunks(), size)) if picked.num_rows else np.zeros((1, size))
        centres = centres_of(sample, count)
        held = self.spark.sparkContext.broadcast(centres)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = held.value
            for batch in batches:
                if batch.num_rows:
                    unit = units(matrix(batch.column("vec"), size))
                    near = (unit @ centres.T - (centres**2).sum(1) / 2).argmax(1)
                    away = np.linalg.norm(unit - centres[near], axis=1)
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), size).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(near.astype("int32")), pa.array(away), flat], names=["chunk_id", "cluster", "away", "unit"])

        dealt = rows.mapInArrow(placed, "chunk_id long, cluster int, away double, unit array<double>")
        # by ranges, so that a cluster with a third of all vectors is many tasks' work
        dealt.repartitionByRange("cluster", "away").sortWithinPartitions("cluster", "away").write.partitionBy("cluster").parquet(f"{self.path}/vectors")
        stats = self.rows().groupBy("cluster").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n"))
        known = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cluster int, centre array<double>")
        stats.join(known, "cluster").coalesce(1).write.parquet(f"{self.path}/clusters")

    def rows(self) -> DataFrame:
        return self.spark.read.schema("chunk_id long, away double, unit array<double>, cluster int").parquet(f"{self.path}/vectors")

    def search(self, questions: DataFrame, top_n: int = 30) -> DataFrame:
        """``qid, chunk_id, score, rank`` by cosine, exactly, ties by id; questions (``qid, vec``) are taken in blocks of a bounded size."""
        found = self.spark.read.parquet(f"{self.path}/clusters").orderBy("cluster").collect()  # at most MOST_CLUSTERS
        out = None
        for ids, asked in self.blocks(questions, len(found[0].centre) if found else 0):
            part = self.answered(ids, asked, found, top_n)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "qid long, chunk_id long, score double, rank int")

    def blocks(self, questions: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows = questions.where(F.size("vec") == size).select("qid", "vec").toLocalIterator() if size else iter(())
        held: list = []
        for r in rows:
            held.append(r)
            if len(held) * size >= BLOCK_VALUES:
                yield np.array([x.qid for x in held]), units(np.array([x.vec for x in held], "float64"))
                held = []
        if held:
            yield np.array([x.qid for x in held]), units(np.array([x.vec for x in held], "float64"))

    def answered(self, ids: np.ndarray, asked: np.ndarray, found: list, top_n: int) -> DataFrame:
        number, centres = np.array([r.cluster for r in found]), np.array([r.centre for r in found])
        low, high, n = (np.array([r[c] for r in found]) for c in ("low", "high", "n"))
        far = np.linalg.norm(asked[:, None, :] - centres[None], axis=2) if len(asked) * len(centres) * centres.shape[1] <= 50_000_000 else np.stack([np.linalg.norm(centres - q, axis=1) for q in asked])
        gap = np.maximum(0, np.maximum(low - far, far - high))  # no vector of the cluster is nearer
        order = np.argsort(gap, axis=1, kind="stable")
        ahead = np.cumsum(n[order], axis=1) - n[order]
        first = np.zeros(far.shape, bool)
        np.put_along_axis(first, order, ahead < top_n, axis=1)  # nearest clusters, until they hold enough
        near = stored(ranked(self.scored(ids, asked, first, np.full(len(ids), np.inf), far, number, top_n), top_n))
        worst = {r.qid: r.score for r in near.where(F.col("rank") == top_n).select("qid", "score").collect()}  # a number for each question of the block
        least = np.array([worst.get(q, -1.0) for q in ids.tolist()])
        reach = np.sqrt(np.maximum(0, 2 - 2 * (least - SLACK)))  # no better vector is farther
        rest = ~first & (gap <= reach[:, None])
        if not rest.any():
            return near
        more = self.scored(ids, asked, rest, reach, far, number, top_n)
        return ranked(near.select("qid", "chunk_id", "score").unionByName(more), top_n)

    def scored(self, ids: np.ndarray, asked: np.ndarray, wanted: np.ndarray, reach: np.ndarray, far: np.ndarray, number: np.ndarray, top_n: int) -> DataFrame:
        """``qid, chunk_id, score`` of the vectors in the wanted clusters and rings; each batch keeps its ``top_n`` of each question."""
        rings, take = [], {}
        for k in np.flatnonzero(wanted.any(0)).tolist():
            who = np.flatnonzero(wanted[:, k])
            a, b = float((far[who, k] - reach[who]).min()), float((far[who, k] + reach[who]).max())
            take[int(number[k])] = who
            rings.append((int(number[k]), a - SLACK, b + SLACK))
        rows = self.rows().where(F.col("cluster").isin(sorted(take)))
        if len(rings) <= LITERALS:  # the reader then leaves out row groups beyond a ring
            rows = rows.where(reduce(or_, [(F.col("cluster") == k) & F.col("away").between(a, b) for k, a, b in rings]))
        else:
            rows = rows.join(F.broadcast(self.spark.createDataFrame(rings, "cluster int, a double, b double")), "cluster").where(F.col("away").between(F.col("a"), F.col("b")))
        rows = rows.select("chunk_id", "cluster", "unit")
        held, size = self.spark.sparkContext.broadcast((ids, asked, take)), asked.shape[1]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked, take = held.value
            for batch in batches:
                cluster = batch.column("cluster").to_numpy()
                for c in np.unique(cluster).tolist():
                    part = batch.filter(pa.array(cluster == c))
                    keys, who = part.column("chunk_id").to_numpy(), take[c]
                    got = np.round(matrix(part.column("unit"), size) @ asked[who].T, 6)
                    keep = np.lexsort((np.broadcast_to(keys[:, None], got.shape).T, -got.T), axis=1)[:, :top_n]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[who], keep.shape[1])), pa.array(keys[keep].ravel()), pa.array(np.take_along_axis(got.T, keep, 1).ravel() + 0.0)], names=["qid", "chunk_id", "score"])

        return rows.mapInArrow(score, "qid long, chunk_id long, score double")
