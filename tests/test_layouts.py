"""Stored vectors, date buckets and places in an order."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlake.operators import dated as D
from threadlake.operators.ordering import positions
from threadlake.operators.search import vector_search
from threadlake.operators.vectors_index import VectorIndex
from tests.test_index import scanned, shuffled


def clouds(rng, n, size, centres):
    where = rng.normal(size=(centres, size)) * 4
    return [(i, (where[rng.integers(centres)] + rng.normal(size=size)).tolist()) for i in range(n)]


@pytest.mark.parametrize("clusters", [None, 1, 7])
def test_stored_vectors_answer_as_brute_force(spark, tmp_path, clusters):
    rng = np.random.default_rng(4)
    rows = clouds(rng, 600, 8, 9) + [(i, [0.0] * 8) for i in (700, 701)] + [(i, [1.0] * 8) for i in (800, 801, 802)] + [(900, [1.0]), (901, None)]
    vectors = spark.createDataFrame(rows, "chunk_id long, vec array<double>")
    asked = spark.createDataFrame(clouds(rng, 20, 8, 3) + [(50, [1.0] * 8), (51, [0.0] * 8), (52, None), (53, rows[5][1])], "qid long, vec array<double>")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(vectors, 8, clusters)
    key = lambda df: sorted((r.qid, r.rank, r.chunk_id, r.score) for r in df.collect())
    for top_n in (1, 12, 1000):
        assert key(index.search(asked, top_n)) == key(vector_search(asked, vectors.where(F.size("vec") == 8), top_n))


def test_far_clusters_are_not_read(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame(clouds(rng, 3000, 16, 40), "chunk_id long, vec array<double>")
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(vectors, 16)
    reads, plain = [], index.scored
    monkeypatch.setattr(index, "scored", lambda *a: reads.append(plain(*a)) or reads[-1])
    index.search(vectors.limit(1).select(F.col("chunk_id").alias("qid"), "vec"), 10).collect()
    assert sum(map(scanned, reads)) < 600  # a fifth of the rows at most


def test_an_empty_vector_index(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(spark.createDataFrame([(1, None)], "chunk_id long, vec array<double>"), 4)
    assert index.search(spark.createDataFrame([(1, [1.0] * 4)], "qid long, vec array<double>")).count() == 0


def plain_oldest(ranges, rows, k):
    out = []
    for q, lo, hi in ranges:
        if lo is not None and hi is not None:
            met = sorted((at, i) for i, at in rows if at is not None and lo <= at <= hi)[:k]
            out += [(q, i, n) for n, (_, i) in enumerate(met, 1)]
    return sorted(out)


def test_oldest_in_ranges(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([rng.randrange(0, 2 * 10**9), rng.randrange(10**9, 10**9 + 10**6), None, -rng.randrange(10**7)])) for i in range(900)]
    ranges = [(q, *sorted((rng.randrange(-(10**8), 2 * 10**9), rng.randrange(0, 2 * 10**9)))) for q in range(60)]
    ranges += [(70, 10**9, 10**9 + 5 * 10**5), (71, 5, 4), (72, None, None), (73, 0, 10**11), (74, 3 * 10**9, 4 * 10**9), (75, -(10**12), 10**12)]
    df, asked = spark.createDataFrame(rows, "chunk_id long, date_unix long"), spark.createDataFrame(ranges, "qid long, lo long, hi long")
    D.write(df, str(tmp_path / "dated"))
    for table in (df, D.read(spark, str(tmp_path / "dated"))):
        for k in (1, 8, 500):
            found = D.oldest_in(asked, table, k)
            assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
            assert sorted((r.qid, r.chunk_id, r["at"]) for r in found.collect()) == plain_oldest(ranges, rows, k)
    few = D.oldest_in(asked.where("qid = 70"), D.read(spark, str(tmp_path / "dated")), 8)
    assert "PartitionFilters: [" in few._jdf.queryExecution().toString() and scanned(few) < 900 / 2
    assert D.oldest_in(asked, df.limit(0), 8).count() == 0


def test_ranges_meet_their_own_rows_alone(spark):
    """Thousands of ranges that begin in one month, or are open at an end, over many months: rows that are moved go with rows and ranges."""
    n, m = 4000, 2000
    rows = spark.range(n).select(F.col("id").alias("chunk_id"), (F.col("id") * 86_400 + F.col("id") % 3).alias("date_unix"))
    ranges = spark.range(m).select(F.col("id").alias("qid"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("lo"), F.lit(10**11).alias("hi"))
    found = []
    moved = shuffled(spark, lambda: found.extend(D.oldest_in(ranges, rows, 3).select("qid", "chunk_id", "at").collect()))
    assert moved < 12 * (n + 3 * m)  # an open range would meet all 134 months, and ranges of one month its 30 rows
    assert sorted(map(tuple, found)) == sorted((q, c, k) for q in range(m) for k, c in enumerate((0, 1, 2) if q % 2 == 0 else (1, 2, 3), 1))


def test_positions(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(40), "x") for i in range(500)]
    got = positions(spark.createDataFrame(rows, "id long, v long, place_in_part string").drop("place_in_part").repartition(7), [F.col("v").desc(), "id"], "nth")
    assert [(r.id, r.nth) for r in got.orderBy("nth").collect()] == [(i, n) for n, (_, i) in enumerate(sorted((-v, i) for i, v, _ in rows), 1)]
    assert positions(spark.createDataFrame([], "id long"), ["id"]).count() == 0
    ones = positions(spark.createDataFrame([(i, i % 3 // 2) for i in range(50)], "id long, one int").repartition(5), ["id"], of="one")
    assert [(r.id, r.position) for r in ones.orderBy("id").collect()] == [(i, (i + 1) // 3) for i in range(50)]
