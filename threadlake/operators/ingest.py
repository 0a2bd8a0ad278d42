"""Incremental ingestion: what is new, what failed, how far it came."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions.text import same_model, stamp
from threadlake.operators.chunking import chunk
from threadlake.operators.merge import latest, replace_children, upsert
from threadlake.operators.providers import Embedder, embedded, letter_embedder
from threadlake.sources.commit import Store
from threadlake.sources.mail import MAX_FILE, contents, numbered, parse_files, small_files
from threadlake.sources.shared import forget, sized, stored

MESSAGE = "source_id long, path string, message_id string, subject string, sender string, date_unix long, original_sender string, body_text string, stored_at long"
TABLES = {
    "files": "source_id long, fingerprint string", "messages": MESSAGE, "chunks": "source_id long, ordinal int, text string, vec array<double>",
    "failures": "source_id long, path string, error string, failed_at long",
}


def unseen(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose ``(source_id, fingerprint)`` is not recorded: new or changed ones."""
    return files.join(state.select("source_id", "fingerprint"), ["source_id", "fingerprint"], "left_anti")


def recorded(state: DataFrame, done: DataFrame) -> DataFrame:
    """The state after ``done`` files were stored."""
    return upsert(state.select("source_id", "fingerprint"), done.select("source_id", "fingerprint"), "source_id")


def dead_letters(failures: DataFrame, parsed: DataFrame, now: int) -> DataFrame:
    """``source_id, path, error, failed_at``: failures of this run over earlier ones, without what succeeded since."""
    tried = parsed.select("source_id")
    failed = parsed.where("error is not null").select("source_id", "path", "error", F.lit(now).cast("long").alias("failed_at"))
    kept = failures.join(tried, "source_id", "left_anti").select("source_id", "path", "error", "failed_at")
    return latest(kept.unionByName(failed), ["source_id"], ["failed_at", "path"])


def watermark(old: int, parsed: DataFrame) -> Column:
    """Never falls; dates of 0 (undated) do not count."""
    return F.greatest(F.lit(old), F.coalesce(F.max(F.when(F.col("date_unix") > 0, F.col("date_unix"))), F.lit(0))).cast("long")


def stamp_allows(stored: Column, model: Column, dimensions: Column, chunks: Column) -> Column:
    """Whether an index may grow: it is empty, unstamped, or made by the same model and size."""
    got = stamp(stored)
    return (chunks == 0) | stored.isNull() | F.coalesce(same_model(got.model, model) & (got.dimensions == dimensions), F.lit(False))


def after_grace(candidates: DataFrame, known: DataFrame, mark: int, grace: int = 300) -> DataFrame:
    """Candidates newer than the watermark less the grace, without those enqueued before."""
    return candidates.where(F.col("date_unix") > max(0, mark - grace)).join(known.select("source_id"), "source_id", "left_anti").dropDuplicates(["source_id"])


def ingest(store: Store, files: DataFrame, now: int, embed: Embedder = letter_embedder, most: int = MAX_FILE) -> int:
    """One run over listed ``files`` (``path, length, mtime``): how many were new or changed.

    Those are read (none larger than ``most``), parsed, chunked and embedded in
    calls of sixteen texts. Messages, their chunks in place of older ones, dead
    letters and only then the fingerprints of what was stored change in one commit
    of ``store``; so a run that ends anywhere before leaves nothing, and the next
    one does its work again. A message with a chunk that could not be embedded is a
    dead letter as a whole. Failed files have no fingerprint and are tried again.
    Where no table has a row of the run's files, rows are appended, so that many
    runs over new files write each row once; else the tables are written anew.
    """
    with store.transaction() as t:
        known = lambda name: t.read(name) if name in t.tables or name in t.staged else files.sparkSession.createDataFrame([], TABLES[name])
        with small_files(files.sparkSession):
            todo = stored(unseen(numbered(files), known("files")))
        count = todo.count()
        if not count:
            return 0
        records = stored(parse_files(contents(todo.select("path", "length"), most)))
        pieces = stored(chunk(records.where("error is null"), "source_id", "body_text").select(F.struct("source_id", "ordinal").alias("chunk_id"), "text"))
        vectors = stored(embedded(pieces, embed))
        lost = vectors.where("error is not null").groupBy("id.source_id").agg(F.min("error").alias("lost"))
        tried = records.join(sized(lost, 100), "source_id", "left").withColumn("error", F.coalesce("error", "lost"))
        good = tried.where("error is null").withColumn("stored_at", F.lit(now).cast("long"))
        rows = pieces.join(vectors.where("error is null").select(F.col("id").alias("chunk_id"), "vec"), "chunk_id").select("chunk_id.*", "text", "vec")
        fresh = rows.join(good.select("source_id"), "source_id", "left_semi")
        messages, chunks = known("messages"), known("chunks")
        seen = reduce(DataFrame.unionByName, [known(name).select("source_id") for name in TABLES])
        if seen.join(todo.select("source_id"), "source_id", "left_semi").isEmpty():
            t.append("messages", good.select(*messages.columns))
            t.append("chunks", fresh.select(*chunks.columns))
            t.append("failures", dead_letters(known("failures").limit(0), tried, now))
            t.append("files", todo.join(good.select("source_id"), "source_id", "left_semi").select("source_id", "fingerprint"))
        else:
            # a message may have no chunk at all, and loses its older ones then too
            gone = chunks.join(good.select("source_id"), "source_id", "left_anti")
            t.write("messages", upsert(messages, good.select(*messages.columns), "source_id"))
            t.write("chunks", replace_children(gone, fresh, "source_id"))
            t.write("failures", dead_letters(known("failures"), tried, now))
            t.write("files", recorded(known("files"), todo.join(good.select("source_id"), "source_id", "left_semi")))
    for old in (todo, records, pieces, vectors):
        forget(old)
    return count


def ingesting(store: Store, now: Callable[[], int], embed: Embedder = letter_embedder, most: int = MAX_FILE) -> Callable[[DataFrame, int], None]:
    """A sink for a stream of listed files; a batch that comes again after a failure finds its files recorded, or does them whole."""

    def put(batch: DataFrame, number: int) -> None:
        ingest(store, batch, now(), embed, most)

    return put
