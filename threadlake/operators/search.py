"""Keyword, vector and hybrid retrieval, for many questions at once.

Exhaustive forms over ordinary tables; stored indexes that prune are in
:mod:`threadlake.operators.index` and :mod:`threadlake.operators.vectors_index`. Scores
are summed map-side first, and top-n windows are cut before the shuffle by Spark's
window group limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import terms
from threadlake.operators.dated import oldest_in
from threadlake.operators.index import B, K1, KeywordIndex, ranked
from threadlake.sources.shared import shared_dir, sized, stored

TOP_N, TOP_K, RRF_K = 30, 8, 60.0
BLOCK_VALUES = 1_000_000  # numbers in a broadcast block of question vectors


def postings(docs: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``term, chunk_id, tf, dl``: write it sorted or bucketed by term for repeated use."""
    found = docs.select(F.col(key).alias("chunk_id"), terms(F.col(text)).alias("t"))
    sized = found.select("chunk_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    return sized.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row ``n, avgdl``; a null text is a chunk without terms."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.size(terms(F.col(text))), F.lit(0))).alias("avgdl"))


def keyword_search(questions: DataFrame, index: DataFrame, stats: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """``qid, chunk_id, score, rank`` by BM25 over any of the terms; ties by id. Without terms, nothing.

    ``index`` are postings that are not stored, so every list that is asked for is
    scored whole; a stored index prunes, see :class:`KeywordIndex`.
    """
    asked = questions.select("qid", F.explode(terms(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    used = index.join(sized(asked.select("term").distinct(), 80), "term", "left_semi")
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    n, avgdl = stats.first()
    idf = F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(float(avgdl or 1.0))))
    scored = used.join(df, "term").join(asked, "term").groupBy("qid", "chunk_id").agg(F.round(F.sum(weight * F.col("times")), 6).alias("score"))
    return ranked(scored, top_n)


def containing(passages: DataFrame, docs: DataFrame, index: KeywordIndex) -> DataFrame:
    """``qid, chunk_id`` of every document (``chunk_id, text``) that holds a passage (``qid, passage``) literally.

    A passage's inner terms stand whole in such a document, so the postings of the
    rarest name the candidates, which are then searched. Passages of fewer than
    three terms have no inner one and are searched in all documents.
    """
    split = passages.select("qid", "passage", terms(F.col("passage")).alias("t"))
    inner = split.where(F.size("t") >= 3).select("qid", F.explode(F.array_distinct(F.slice("t", 2, F.size("t") - 2))).alias("term"))
    keys = inner.select("term").distinct().persist()
    # lists are looked up twice: their lengths from the blocks' heads, then those of the rarest terms
    df = index.bounds(keys).select("term", "df")
    # a term without postings is in no document, so its passage is in none either
    rare = inner.join(df, "term", "left").groupBy("qid").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    used = index.postings(rare.select("term").distinct())
    pairs = stored(rare.join(used, "term").select("qid", "chunk_id"))  # counted before texts are joined to them, so that these stay where they are
    near = docs.join(sized(pairs, 40), "chunk_id").join(sized(passages, 200), "qid").where(F.contains("text", "passage")).select("qid", "chunk_id")
    short = split.where(F.size("t") < 3).select("qid", "passage")
    if short.isEmpty():
        return near
    return near.unionByName(docs.join(sized(short, 200), F.contains("text", "passage")).select("qid", "chunk_id"))


def question_blocks(questions: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors (a column each) of the questions ``qid, vec``, by length, in blocks of at most ``BLOCK_VALUES`` numbers; nulls and empty ones are left out."""
    held: dict[int, list] = {}

    def block(rows: list) -> tuple[np.ndarray, np.ndarray]:
        matrix = np.array([r.vec for r in rows], "float64")
        lengths = np.linalg.norm(matrix, axis=1)
        return np.array([r.qid for r in rows]), (matrix / np.where(lengths > 0, lengths, 1)[:, None]).T

    for r in questions.select("qid", "vec").where(F.size("vec") > 0).toLocalIterator():
        rows = held.setdefault(len(r.vec), [])
        rows.append(r)
        if len(rows) * len(r.vec) >= BLOCK_VALUES:
            yield block(held.pop(len(r.vec)))
    for size in sorted(held):
        yield block(held[size])


def vector_search(questions: DataFrame, vectors: DataFrame, top_n: int = TOP_N, unit_vectors: bool = False) -> DataFrame:
    """``qid, chunk_id, score, rank`` by cosine; vectors of another length are left out, ties go by id.

    Questions are a query set: they are sent in blocks of bounded size to every
    partition of ``vectors``, which multiplies and cuts its own top ``top_n`` for
    each question before anything is shuffled.
    """
    parts = []
    for ids, matrix in question_blocks(questions):
        held, size = questions.sparkSession.sparkContext.broadcast((ids, matrix)), len(matrix)

        def score(batches, held=held):
            ids, matrix = held.value
            for batch in batches:
                if not len(batch):
                    continue
                keys = batch["chunk_id"].to_numpy()
                values = np.stack(batch["vec"].to_numpy()).astype("float64")
                if not unit_vectors:
                    n = np.linalg.norm(values, axis=1)
                    values = values / np.where(n > 0, n, 1)[:, None]
                got = np.round(values @ matrix, 6)
                keep = np.lexsort((np.broadcast_to(keys[:, None], got.shape).T, -got.T), axis=1)[:, :top_n]
                yield pd.DataFrame({"qid": np.repeat(ids, keep.shape[1]), "chunk_id": keys[keep].ravel(), "score": np.take_along_axis(got.T, keep, 1).ravel() + 0.0})

        rows = vectors.where(F.size("vec") == size).select("chunk_id", "vec")
        parts.append(rows.mapInPandas(score, "qid long, chunk_id long, score double"))
    if not parts:
        return questions.sparkSession.createDataFrame([], "qid long, chunk_id long, score double, rank int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out, top_n)


def fuse(*rankings: DataFrame, k: float = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: ``qid, chunk_id, score, rank``; ties go to what appears first, list by list."""
    width = 1_000_000
    tagged = [r.select("qid", "chunk_id", (1.0 / (F.lit(k) + F.col("rank"))).alias("part"), (F.col("rank") + F.lit(i * width)).alias("seen")) for i, r in enumerate(rankings)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    fused = union.groupBy("qid", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min("seen").alias("seen"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "seen")
    return fused.withColumn("rank", F.row_number().over(order)).drop("seen")


def above_floor(fused: DataFrame, floor: float = 0.0) -> DataFrame:
    return fused.where(F.col("score") > floor)


def without(fused: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Rows whose ``(qid, chunk_id)`` is not in ``exclusions``."""
    return fused.join(exclusions, ["qid", "chunk_id"], "left_anti")


def date_scoped(fused: DataFrame, chunks: DataFrame, ranges: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Hits within each question's range, then its range's oldest chunks that are no hits.

    ``ranges`` has ``qid, lo, hi`` (closed, null: no scope). Of a range at most
    ``top_k`` oldest chunks are taken, before those that are hits are removed.
    Where nothing is left the hits stay unscoped. Returns ``qid, chunk_id,
    score, provenance, position`` of the first ``top_k``. ``chunks`` may be a
    table that :mod:`threadlake.operators.dated` wrote; then a range opens its own
    months alone.
    """
    shared_dir(fused.sparkSession)
    fused = fused.checkpoint()  # a few rows for each question, read three times below
    hits = fused.join(ranges, "qid", "left").join(chunks.select("chunk_id", "date_unix"), "chunk_id")
    inside = F.col("lo").isNull() | F.col("date_unix").between(F.col("lo"), F.col("hi"))
    scoped = ranges.where("lo is not null")
    direct = oldest_in(scoped, chunks, top_k)
    direct_ids = direct.select("qid", "chunk_id", F.lit(True).alias("dated"))
    semantic = hits.where(inside).join(direct_ids, ["qid", "chunk_id"], "left").select(
        "qid", "chunk_id", "score", F.when(F.col("dated"), "semantic+date").otherwise("semantic").alias("provenance"), F.lit(0).alias("block"), F.col("rank").alias("pos"))
    added = direct.join(hits.where(inside).select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti").select(
        "qid", "chunk_id", F.lit(0.0).alias("score"), F.lit("date").alias("provenance"), F.lit(1).alias("block"), F.col("at").alias("pos"))
    merged = semantic.unionByName(added)
    lost = hits.join(merged.select("qid").distinct(), "qid", "left_anti").select("qid", "chunk_id", "score", F.lit("semantic").alias("provenance"), F.lit(0).alias("block"), F.col("rank").alias("pos"))
    order = Window.partitionBy("qid").orderBy("block", "pos")
    return merged.unionByName(lost).withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_k).select("qid", "chunk_id", "score", "provenance", "position")
