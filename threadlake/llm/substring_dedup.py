"""Substring dedup by compaction of a de Bruijn graph of words.

The graph's edges are the windows of ``window`` words, its nodes what two
successive windows share. Edges are read from the texts as *units*: successive
windows whose canonical ``anchor``-gram, the rightmost of the smallest hash, is the
same place. Equal windows have equal anchors at equal offsets, so a unit whose
anchor occurs once in the corpus holds no repeated window and is dropped before
anything else moves, and units that are equal as a whole count as one edge, however
often they occur.

Repeated units that always follow each other, and never begin or end with another
neighbour, are nonbranching paths. They are compacted by Spark joins (pointer
doubling over links), and a link counts only if the source coordinates of both ends
fit. Of a path only the first unit is looked up in the texts: each of its places
other than the first source is a long repeated span. At the ends of paths, where
units differ that share an anchor, the windows of one source of each unit are
compared one by one.

A coordinate is the text's number, by id, and the word's number in one long, so that
"starts earlier" is a comparison. Units are told apart by 128 bits of hash, windows
by 128 bits, texts by as many of their SHA-256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import BROADCAST, drop_written, lean, narrow, release, written
from threadlake.llm.shingles import EXACT, FACTORS, finish, pieces, runs_of, word_hashes

OTHER = np.random.default_rng(20250117).integers(1, 2**63, 64, dtype="uint64") * np.uint64(2) + np.uint64(1)
ROWS = 1 << 20  # window hashes of an Arrow batch


def grams(words: np.ndarray, k: int, factors: np.ndarray = FACTORS) -> np.ndarray:
    """Hashes of all ``k`` successive word hashes, whatever text they are in."""
    out = np.zeros(max(0, len(words) - k + 1), "uint64")
    for j in range(k):
        out += words[j : j + len(out)] * factors[j % len(factors)] + np.uint64(j)
    return finish(out)


def rightmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` successive values the place of the smallest, the rightmost of equal ones."""
    place, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[right] <= values[left], right, left)
        span += step
    return place


class Words:
    """The hashed words of several texts, and which places begin a window."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, window: int):
        start, end, self.bounds = runs_of(raw, bounds)
        self.hashes = word_hashes(raw, start, end, EXACT)
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(self.bounds))
        n = max(0, len(self.text) - window + 1)
        self.windows = np.flatnonzero(self.text[:n] == self.text[len(self.text) - n :]) if n else np.zeros(0, "int64")

    def units(self, window: int, anchor: int) -> tuple[np.ndarray, ...]:
        """Text, first window, anchor hash and class hash of each unit, in order."""
        if not len(self.windows):
            return tuple(np.zeros(0, t) for t in ("int64", "int64", "uint64", "uint64"))
        small, whole = grams(self.hashes, anchor), grams(self.hashes, window)
        at = rightmost_least(small, window - anchor + 1)[self.windows]
        text = self.text[self.windows]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        lo, hi = self.windows[first], self.windows[np.append(first[1:], len(at)) - 1]
        # the first and the last window overlap or meet, so together they are all the unit's words
        kind = whole[lo] * OTHER[0] + whole[hi] * OTHER[1] + (hi - lo).astype("uint64") * OTHER[2] + (at[first] - lo).astype("uint64") * OTHER[3]
        return text[first], lo - self.bounds[text[first]], small[at[first]], finish(kind)


def spans_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """``no, spans``: start and end of each stretch of words that a text's windows ``gone`` (first, number) cover, one after the other."""
    for batch in batches:
        out = []
        offsets = batch.column("gone").offsets.to_numpy()
        first, windows = (batch.column("gone").values.field(c).to_numpy().astype("int64") for c in ("start", "windows"))
        for a, b in zip(offsets[:-1], offsets[1:]):
            order = np.argsort(first[a:b], kind="stable")
            start, end = first[a:b][order], np.maximum.accumulate((first[a:b] + windows[a:b] + window - 1)[order])
            new = np.append(True, start[1:] > end[:-1])
            out.append(np.stack((start[new], np.append(end[:-1][new[1:]], end[-1])), 1).ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch.column("no"), pa.array(out, pa.list_(pa.int32()))], names=["no", "spans"])


def compacted(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``at, head``: the first node of each linked node's path, by pointer doubling.

    ``links`` are ``(at, up)`` with at most one row for each node on either side
    and without cycles. Each round is one equi-join and is written; only a count
    reaches the driver.
    """
    state = written(links.select("at", F.col("up").alias("head")))
    for _ in range(max_rounds):
        farther = state.select(F.col("at").alias("head"), F.col("head").alias("next"))
        nxt = written(state.join(farther, "head", "left").select("at", F.coalesce("next", "head").alias("head"), F.col("next").isNotNull().alias("moved")))
        drop_written(state)
        state = nxt
        if nxt.where("moved").isEmpty():
            return nxt.select("at", "head")
    raise RuntimeError(f"paths did not settle in {max_rounds} rounds")


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """``key, rep, no, copied`` for each different text, numbered by its smallest id (nulls last), then key; and the bits that a word's number takes."""
    texts = written(rows.groupBy("key").agg(F.min("id").alias("rep"), F.max(F.octet_length("raw")).alias("n"), (F.count("*") > 1).alias("copied")))
    ordered = written(texts.orderBy(F.col("rep").asc_nulls_last(), "key").select(
        "key", "rep", "copied", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("nth")))
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    earlier = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    total = texts.agg(F.count("*").alias("texts"), F.coalesce(F.max("n"), F.lit(0)).alias("longest")).first()
    bits = int(total.longest // 2 + 1).bit_length()
    if bits + int(total.texts).bit_length() > 62:
        raise ValueError("texts are too many and too long for coordinates of 63 bits")
    out = written(ordered.join(F.broadcast(before), "part").select("key", "rep", "copied", (F.col("before") + F.col("nth")).alias("no")))
    drop_written(texts)
    drop_written(ordered)
    return out, bits


def sized_side(df: DataFrame, size: Column) -> DataFrame:
    """``df`` with a broadcast hint if its bytes, summed before, are few enough."""
    room = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if room <= BROADCAST else df


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, anchor: int = 5) -> DataFrame:
    """``id, n_words, spans, kept`` for every row of ``docs``.

    A word is removed if a window of ``window`` successive words of its text covers
    it whose words also start earlier: in a row of a smaller id, or before it in
    the same text. Words are runs of characters that are not blank, unchanged; the
    input alone is judged. ``spans`` are the removed stretches ``(start, end)`` in
    words, ``kept`` the other words joined by single spaces. Null and blank texts
    have no words; texts shorter than ``window`` keep all. Null ids come last.
    Different texts that share an id are ordered by a hash of the text; rows that
    are equal in id and text are one document, so each gets its result. An empty
    table gives an empty one; other columns are not read.
    """
    if not 1 <= anchor <= window:
        raise ValueError("the anchor has to fit into the window")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("raw")).withColumn("key", F.substring(F.unhex(F.sha2("raw", 256)), 1, 16))
    texts, bits = numbered(rows)
    known = narrow(texts.select("key", "rep", "no"), 80)  # so that texts need no shuffle while this is a small table
    firsts = rows.join(known, "key").where(F.col("id").eqNullSafe(F.col("rep")))
    coordinate = lambda no, start: F.shiftleft(no, bits) + start

    def unit_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("no").to_numpy()
            for at, raw, bounds in pieces(batch.column("raw")):
                words = Words(raw, bounds, window)
                text, start, gram, kind = words.units(window, anchor)
                held, cuts = np.unique(text, return_index=True)
                cuts = pa.array(np.append(cuts, len(text)), pa.int32())
                last = np.diff(words.bounds)[held] - window + 1
                column = lambda values: pa.ListArray.from_arrays(cuts, pa.array(values))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[at + held]), pa.array(last, pa.int32()), column(gram.view("int64")), column(kind.view("int64")), column(start.astype("int32"))],
                    names=["no", "last", "anchor", "class", "start"])

    listed = written(firsts.select("no", "raw").mapInArrow(lean(unit_lists), "no long, last int, anchor array<long>, class array<long>, start array<int>"))
    zero, many = F.array(F.lit(0).cast("long")), F.size("class")
    beside = listed.withColumns({
        "prior": F.concat(zero, F.slice("class", F.lit(1), many - 1)), "next": F.concat(F.slice("class", F.lit(2), many), zero),
        "end": F.concat(F.slice("start", F.lit(2), many), F.array("last"))})
    units = beside.select("no", F.explode(F.arrays_zip("anchor", "class", "prior", "next", "start", "end")).alias("u")).select("no", "u.*")
    again = written(listed.select(F.explode("anchor").alias("anchor")).groupBy("anchor").count().where("count > 1").select("anchor"))
    edges = written(units.join(narrow(again, 32), "anchor", "left_semi").groupBy("anchor", "class").agg(
        F.count("*").alias("n"), F.min(coordinate(F.col("no"), F.col("start"))).alias("first"), F.max(F.col("end") - F.col("start")).alias("windows"),
        *[f(c).alias(f"{name}_{c}") for c in ("prior", "next") for name, f in (("min", F.min), ("max", F.max))]))
    release(spark)
    # links between repeated units that only follow each other, at coordinates that fit
    repeated = edges.where("n > 1")
    ahead = repeated.where("min_next = max_next and max_next <> 0").select(
        F.col("class").alias("min_prior"), F.col("max_next").alias("class"), "n", F.col("first").alias("up"), (F.col("first") + F.col("windows")).alias("first"))
    links = repeated.where("min_prior = max_prior").join(ahead, ["class", "min_prior", "n", "first"]).select(F.col("first").alias("at"), "up")
    heads = compacted(links)
    placed = repeated.join(heads.withColumnRenamed("at", "first"), "first", "left")
    top = F.col("head").isNull()
    paths = written(placed.groupBy(F.coalesce("head", "first").alias("source")).agg(
        F.max(F.when(top, F.col("anchor"))).alias("anchor"), F.max(F.when(top, F.col("class"))).alias("class"), (F.max(F.col("first") + F.col("windows"))).alias("to")))
    places = listed.select("no", F.explode(F.arrays_zip("anchor", "class", "start")).alias("u")).select("no", "u.*")
    copies = places.join(narrow(paths, 72), ["anchor", "class"]).where(coordinate(F.col("no"), F.col("start")) != F.col("source")).select(
        "no", "start", (F.col("to") - F.col("source")).cast("int").alias("windows"))
    copies = written(copies)
    # windows of units that share an anchor with another unit
    shared = edges.groupBy("anchor").count().where("count > 1").select("anchor")
    mixed = edges.join(shared, "anchor", "left_semi").select(
        F.shiftright("first", bits).alias("no"), F.col("first").bitwiseAND(F.lit(2**bits - 1)).cast("int").alias("start"), F.col("windows").cast("int").alias("windows"))
    asked = written(mixed.groupBy("no").agg(F.collect_list(F.struct("start", "windows")).alias("asked")).join(texts.select("key", "rep", "no"), "no"))
    side = sized_side(asked, F.size("asked") * 8 + 100)

    def window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, wanted = batch.column("no").to_numpy(), batch.column("asked")
            offsets = wanted.offsets.to_numpy()
            begin, size = (wanted.values.field(c).to_numpy().astype("int64") for c in ("start", "windows"))
            for at, raw, bounds in pieces(batch.column("raw")):
                words = Words(raw, bounds, window)
                lo, hi = offsets[at], offsets[at + len(bounds) - 1]
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(offsets[at : at + len(bounds)]))
                runs = size[lo:hi]
                step = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
                text = np.repeat(text, runs)
                start = np.repeat(begin[lo:hi], runs) + step
                one, two = grams(words.hashes, window), grams(words.hashes, window, OTHER)
                where = words.bounds[text] + start
                whole = (numbers[at + text] << bits) + start
                for k in range(0, len(where), ROWS):
                    part = where[k : k + ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(one[part].view("int64")), pa.array(two[part].view("int64")), pa.array(whole[k : k + ROWS])], names=["one", "two", "at"])

    hashed = rows.join(side, "key").where(F.col("id").eqNullSafe(F.col("rep"))).select("no", "raw", "asked").mapInArrow(lean(window_hashes), "one long, two long, at long")
    hashed = written(hashed)
    release(spark)
    groups = written(hashed.groupBy("one", "two").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last"))
    # of two places the later one is known; more are looked up
    several = narrow(groups.where("n > 2").select("one", "two", "first"), 56)
    later = groups.where("n = 2").select(F.col("last").alias("at")).unionByName(hashed.join(several, ["one", "two"]).where("at <> first").select("at"))
    later = later.select(F.shiftright("at", bits).alias("no"), F.col("at").bitwiseAND(F.lit(2**bits - 1)).cast("int").alias("start"), F.lit(1).alias("windows"))
    gone = copies.unionByName(later).groupBy("no").agg(F.collect_set(F.struct("start", "windows")).alias("gone"))
    spans = written(gone.mapInArrow(lambda batches: spans_of(batches, window), "no long, spans array<int>"))
    # what differs from its own words: texts with spans, and copies of texts
    found = written(texts.join(spans, "no", "left").where("spans is not null or copied").select("key", "rep", "spans"))
    for old in (listed, again, edges, paths, copies, asked, hashed, groups, spans, texts):
        drop_written(old)
    release(spark)
    side = sized_side(found, F.greatest(F.size("spans"), F.lit(0)) * 4 + 90)
    marked = rows.join(side.withColumn("known", F.lit(True)), "key", "left").select(
        "id", "raw", "spans", (F.coalesce("known", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("rep"))).alias("copy"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            n, spans, kept = [], [], []
            for raw, copy, found in zip(batch.column("raw").to_pylist(), batch.column("copy").to_pylist(), batch.column("spans").to_pylist()):
                words = raw.split()  # at the bytes that count as blank
                ends = [0, len(words)] if copy and len(words) >= window else found or []
                n.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in zip(ends[::2], ends[1::2])])
                stay = zip([0, *ends[1::2]], [*ends[::2], len(words)])
                kept.append(b" ".join([w for a, b in stay for w in words[a:b]] if ends else words))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(spans, shape), pa.array(kept, pa.binary())], names=["id", "n_words", "spans", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    out = marked.mapInArrow(lean(cut), f"id {kind}, n_words long, spans array<struct<start: long, end: long>>, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))
