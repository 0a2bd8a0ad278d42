"""Suffix-array deduplication over merged shard Burrows-Wheeler transforms.

Texts are parsed into phrases between content-defined anchors (winnowing over
hashes of 8 bytes), so equal passages have equal phrases but for their ends,
and the corpus becomes sequences of phrase numbers some fifty times shorter.
Phrases that occur once in the corpus cannot be in a repeat and end every
common prefix; they are dropped first.

Each shard sorts the suffixes of its phrase sequences and keeps its BWT as the
preceding phrase and the LF mapping of each row. The transforms are merged by
iterative interleave refinement (Holt and McMillan): after round k the merged
order is known up to k phrases, as blocks, each an interval of rows in every
shard that has the prefix. The next round sends each interval through LF to the
intervals of the prefixes one phrase longer. A block with a single row in all
shards together is a string without a repeat, so it is dropped and never
refined again: no suffix is sorted anew, and unique text costs nothing after
the first rounds. The last round in which a suffix is in a block is its longest
common prefix with any other suffix, in phrases.

Repeats are wanted in bytes. A window of ``length`` bytes is certainly repeated
if the phrases that enclose it are, and certainly not if the phrases in its core
are not; the windows in between, at the ends of repeats, are compared as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import BROADCAST, drop_written, lean, release, written

GRAM = 8
STEP = 16  # windows are first judged by strings a step apart


def anchors(raw: np.ndarray, window: int) -> np.ndarray:
    """Places of the rightmost smallest hash of each ``window`` successive 8-byte strings, with 0 and the end.

    Whether a place is chosen depends on the ``window - 1`` bytes before it and
    the ``window + 7`` from it on, nothing else.
    """
    n = len(raw) - GRAM + 1
    if n < window:
        return np.array([0, len(raw)] if len(raw) else [0], "int64")
    h = np.empty(n, "uint64")
    for j in range(GRAM):
        part = h[j::GRAM]
        part[:] = np.frombuffer(raw, "<u8", len(part), j)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h &= np.uint64(0xFFFFFFFF00000000)
    h |= np.arange(n - 1, -1, -1, dtype="uint64")  # of equals the rightmost is the least
    span = 1
    while span < window:
        step = min(span, window - span)
        h = np.minimum(h[: len(h) - step], h[step:])
        span += step
    chosen = n - 1 - (h & np.uint64(0xFFFFFFFF)).astype("int64")
    chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
    return np.unique(np.concatenate(([0], chosen, [len(raw)])))


def phrases(raw: bytes, at: np.ndarray) -> list[int]:
    places = at.tolist()
    return [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(places, places[1:])]


def signed(values: list[int] | np.ndarray) -> np.ndarray:
    return np.asarray(values, "uint64").view("int64")


def mix(c: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The key of the string c + X from those of c and X."""
    h = c.view("uint64") * np.uint64(0x9E3779B97F4A7C15) + (key.view("uint64") ^ (key.view("uint64") >> np.uint64(31)))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(27))).view("int64")


def batch_of(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def grouped(batches: Iterator[pa.RecordBatch], judge: Callable) -> Iterator[pa.RecordBatch]:
    """Sorted rows for which ``judge(columns)`` is true.

    It gets each batch with the row before and the row after it; no group is ever gathered.
    """
    before: pa.RecordBatch | None = None
    held: pa.RecordBatch | None = None

    def emit(after: pa.RecordBatch | None) -> pa.RecordBatch:
        parts = [x for x in (before, held, after) if x is not None]
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        mask = judge([whole.column(i).to_numpy(zero_copy_only=False) for i in range(whole.num_columns)])
        first = int(before is not None)
        return held.filter(pa.array(mask[first : first + held.num_rows]))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield emit(batch.slice(0, 1))
            before = held.slice(held.num_rows - 1)
        held = batch
    if held is not None:
        yield emit(None)


ROWS = 1 << 20  # rows that a task gathers before it deals them out


class Blocks:
    """Rows dealt out by a key as binary blocks of columns, a block for each bucket: what a shuffle moves is few rows.

    A bucket is worked on as a whole, so there are as many as the rows ask for,
    whatever the number of partitions.
    """

    schema = "bucket int, block binary"

    def __init__(self, buckets: int, **kinds: str):
        self.buckets, self.kinds = buckets, [np.dtype(k) for k in kinds.values()]

    def spread(self, key: np.ndarray) -> np.ndarray:
        return (((mix(key, key).view("uint64") >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype("int64")

    def dealt(self, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        columns = [c[order].astype(k, copy=False) for c, k in zip(columns, self.kinds)]
        bucket = bucket[order]
        cuts = [*np.flatnonzero(changes(bucket)).tolist(), len(bucket)]
        blocks = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype("int32")), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    def opened(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Each bucket's columns; blocks come sorted by bucket."""
        width = sum(k.itemsize for k in self.kinds)
        for bucket, table in by_first(batches):
            parts = []
            for block in table.column("block").to_pylist():
                n, at, part = len(block) // width, 0, []
                for k in self.kinds:
                    part.append(np.frombuffer(block, k, n, at))
                    at += n * k.itemsize
                parts.append(part)
            yield bucket, [np.concatenate(c) for c in zip(*parts)]

    def shuffled(self, rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket")


class Gathered:
    """Columns held until there are ``ROWS`` rows."""

    def __init__(self) -> None:
        self.held, self.rows = [], 0

    def add(self, *columns: np.ndarray) -> bool:
        self.held.append(columns)
        self.rows += len(columns[0])
        return self.rows >= ROWS

    def taken(self) -> list[np.ndarray]:
        out = [np.concatenate(c) for c in zip(*self.held)]
        self.held, self.rows = [], 0
        return out


def several(group: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """For each row whether its group (``group`` is true at the first row of each) has rows that differ in any column."""
    first = np.flatnonzero(group)
    out = np.zeros(len(first), bool)
    for c in columns:
        out |= np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
    return out[np.cumsum(group) - 1]


def changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it in any column (and for the first)."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    out[:1] = True
    return out


def paired(columns: list[np.ndarray]) -> np.ndarray:
    """Blocks (key, shard, lo, hi, ...) whose key has two rows of suffixes or more."""
    group = changes(columns[0])
    return ~group | np.append(~group[1:], False) | (columns[3] - columns[2] > 1)


def by_text(text: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows (text, places): the places of each text as 32-bit integers."""
    order = np.argsort(text, kind="stable")
    text, place = text[order], place[order].astype("<i4")
    cuts = [*np.flatnonzero(changes(text)).tolist(), len(text)]
    return pa.RecordBatch.from_arrays([pa.array(text[cuts[:-1]]), pa.array([place[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["text", "places"])


def placed(blob: bytes | None) -> np.ndarray:
    return np.frombuffer(blob or b"", "<i4").astype("int64")


def suffix_order(tokens: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by up to ``depth`` tokens; ``left[i]`` tokens remain in the sequence from i on."""
    rank = np.unique(tokens, return_inverse=True)[1].astype("int64") + 1
    span = 1
    while span < depth:
        later = np.zeros(len(tokens), "int64")
        has = left > span
        later[has] = rank[np.flatnonzero(has) + span]
        rank = np.unique(rank * (len(tokens) + 2) + later, return_inverse=True)[1].astype("int64") + 1
        span *= 2
    return np.argsort(rank, kind="stable")


def build(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, text, place, token), sorted, to a shard's transform (one row for each shard)."""
    for shard, table in by_first(batches):
        text, place, token = (table.column(i).to_numpy() for i in (1, 2, 3))
        once = changes(text, place)  # rows of equal texts are one
        text, place, token = text[once], place[once], token[once]
        starts = changes(text, place - np.arange(len(place)))  # runs of neighbouring repeated phrases
        ends = np.append(np.flatnonzero(starts)[1:], len(text))
        left = ends[np.cumsum(starts) - 1] - np.arange(len(text))
        order = suffix_order(token, left, depth)
        rank = np.empty(len(order), "int64")
        rank[order] = np.arange(len(order))
        has = ~starts[order]
        lf = np.where(has, rank[order - 1], -1).astype("int32")
        prior = np.where(has, token[order - 1], 0)
        first = token[order]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (lf, prior, first, text[order], place[order].astype("int32"))]],
            names=["shard", "lf", "prior", "first", "text", "place"])


def by_first(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows sorted by a first column, gathered for each of its values (shards, whose size is bounded)."""
    held, now = [], None
    for batch in batches:
        column = batch.column(0).to_numpy()
        cuts = [*np.flatnonzero(changes(column)).tolist(), len(column)]
        for a, b in zip(cuts, cuts[1:]):
            if now is not None and column[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(column[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def first_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            token = np.frombuffer(blob, "int64")
            low = np.flatnonzero(changes(token)) if len(token) else np.zeros(0, "int64")
            high = np.append(low[1:], len(token))[: len(low)]
            yield batch_of(key=token[low], shard=np.full(len(low), shard, "int32"), lo=low.astype("int32"), hi=high.astype("int32"))


def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, kind, lf, prior, key, lo, hi): a shard's transform, then its blocks; yields the longer blocks."""
    for shard, table in by_first(batches):
        lf, prior = np.frombuffer(table.column("lf")[0].as_py(), "int32"), np.frombuffer(table.column("prior")[0].as_py(), "int64")
        key, low, high = (table.column(c).to_numpy()[1:] for c in ("key", "lo", "hi"))
        if not len(key):
            continue
        key, low, size = key.astype("int64"), low.astype("int64"), (high - low).astype("int64")
        upto = np.cumsum(size)
        row = np.repeat(low - (upto - size), size) + np.arange(int(upto[-1]))
        key = np.repeat(key, size)
        has = lf[row] >= 0
        row, key = row[has], key[has]
        to, longer = lf[row], mix(prior[row], key)
        order = np.argsort(to)
        to, longer = to[order], longer[order]
        if not len(to):
            continue
        low = np.flatnonzero(changes(longer, to - np.arange(len(to))))
        sizes = np.diff(np.append(low, len(to)))
        yield batch_of(key=longer[low], shard=np.full(len(low), shard, "int32"), lo=to[low].astype("int32"), hi=(to[low] + sizes).astype("int32"))


def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, kind, text, place, depth, lo, hi) to (text, lengths): for each phrase its longest common prefix."""
    for _, table in by_first(batches):
        text = np.frombuffer(table.column("text")[0].as_py(), "int64")
        place = np.frombuffer(table.column("place")[0].as_py(), "int32")
        depth, low, high = (table.column(c).to_numpy()[1:].astype("int64") for c in ("depth", "lo", "hi"))
        most = np.zeros(len(text), "uint8")
        order = np.argsort(depth, kind="stable")
        for k in np.unique(depth):
            at = order[depth[order] == k]
            edge = np.zeros(len(text) + 1, "int64")
            np.add.at(edge, low[at], 1)
            np.add.at(edge, high[at], -1)
            most[np.cumsum(edge[:-1]) > 0] = k
        order = np.lexsort((place, text))
        text, place, most = text[order], place[order], most[order]
        cuts = np.append(np.flatnonzero(changes(text)), len(text))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            lengths = np.zeros(place[b - 1] + 1, "uint8")
            lengths[place[a:b]] = most[a:b]
            out.append(lengths.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(text[cuts[:-1]]), pa.array(out, pa.binary())], names=["text", "lengths"])


class Windows:
    """The windows of one text: what the phrases say about each, and the core phrases' key."""

    def __init__(self, raw: bytes, lengths: bytes, length: int, window: int, depth: int, at: np.ndarray | None = None):
        self.raw, self.length = raw, length
        at = anchors(np.frombuffer(raw, "uint8"), window) if at is None else at
        most = np.zeros(len(at), "int64")
        known = np.frombuffer(lengths, "uint8")[: len(at)]
        most[: len(known)] = known
        n = max(0, len(raw) - length + 1)
        upto = np.zeros(len(raw) + 1, "int64")  # anchors at or before each place
        upto[at] = 1
        upto = np.cumsum(upto)
        begin, end = upto[:n] - 1, upto[length - 1 :][:n]
        self.sure = most[begin] >= end - begin
        # anchors whose whole context is in the window are anchors in every copy of it
        core, last = upto[window - 2 :][:n], upto[length - window - GRAM :][:n] - 1
        self.maybe = most[core] >= np.minimum(last - core, depth)
        self.core, self.last, self.at = core, last, at
        self.open = self.maybe & ~self.sure

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window that may be repeated its core's key, and those windows."""
        q = np.flatnonzero(self.maybe)
        if not len(q):
            return np.zeros(0, "int64"), q
        new = changes(self.core[q], self.last[q])
        a, b = self.at[self.core[q][new]].tolist(), self.at[self.last[q][new]].tolist()
        return signed([xxhash.xxh3_64_intdigest(self.raw[x:y]) for x, y in zip(a, b)])[np.cumsum(new) - 1], q

    def aligned(self, q: np.ndarray) -> np.ndarray:
        """The first place in each window that is a multiple of ``STEP`` from the core's first anchor."""
        return q + (self.at[self.core[q]] - q) % STEP

    def digests(self, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        found = b"".join([xxhash.xxh3_128_digest(self.raw[a : a + size]) for a in places.tolist()])
        both = np.frombuffer(found, "<i8").reshape(-1, 2)
        return both[:, 0], both[:, 1]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, window: int | None = None, depth: int = 16, shard_rows: int = 200_000) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``.

    A byte is removed if it is in a ``length``-byte string that starts anywhere
    else too, in the same text or another; strings do not cross texts, overlaps
    count and the input alone is judged. Null texts are empty; texts shorter
    than ``length`` keep everything; equal texts lose everything from ``length``
    bytes on. Rows may repeat, ids may be null; an empty table gives an empty
    one; other columns are not read. Equal texts, phrases and windows are
    recognised by 256, 64 and 128 bits of hash.
    """
    window = window or max(2, (length - GRAM) // 4 - 2)
    if length < 4 * window + GRAM or length <= STEP:
        raise ValueError("length is too small for the anchors' window")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("raw")).withColumn("text", F.xxhash64("raw"))
    base = written(rows.select("id", "text", F.octet_length("raw").cast("long").alias("n"), F.unhex(F.sha2("raw", 256)).alias("sha")))
    met = base.groupBy("text").agg(F.min("sha").alias("x"), F.max("sha").alias("y")).where("x <> y").select("text")
    met = [r.text for r in met.collect()]  # different texts with one 64-bit hash: hardly ever one, so their number is chance alone
    if met:
        again = F.when(F.col("text").isin(met), F.xxhash64("raw", F.lit(1))).otherwise(F.col("text"))
        rows = rows.withColumn("text", again)
        base = written(rows.select("id", "text", F.octet_length("raw").cast("long").alias("n"), F.unhex(F.sha2("raw", 256)).alias("sha")))
    total = base.where(F.col("n") >= length).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    deal = Blocks(max(1, total // (window // 2 * ROWS)), token="i8", text="i8", place="i4")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases; those that a task meets at two places go on as they are, and a mark for all of them tells the others.

        So of a phrase that is everywhere a task sends one row to the phrase's bucket. Of equal texts it
        parses one for each time it deals out: their places are the same, and all lie in one shard.
        """
        held, parsed = Gathered(), set()

        def deal_out() -> pa.RecordBatch:
            token, text, place = held.taken()
            order = np.argsort(token)
            token, text, place = token[order], text[order], place[order]
            group = changes(token)
            sure = several(group, text, place)
            mark = group & sure
            none = np.full(int(mark.sum()), -1)
            bucket = np.concatenate((np.where(sure, deal.buckets + deal.spread(text), deal.spread(token)), deal.spread(token[mark])))
            return deal.dealt(bucket, np.concatenate((token, token[mark])), np.concatenate((text, none)), np.concatenate((place, none)))

        for batch in batches:
            for key, raw in zip(batch.column("text").to_pylist(), batch.column("raw").to_pylist()):
                if key in parsed:
                    continue
                parsed.add(key)
                found = phrases(raw, anchors(np.frombuffer(raw, "uint8"), window))
                if held.add(signed(found), np.full(len(found), key, "int64"), np.arange(len(found), dtype="int64")):
                    yield deal_out()
                    parsed.clear()
        if held.rows:
            yield deal_out()

    def repeated_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (token, text, place) in deal.opened(batches):
            if bucket < deal.buckets:
                order = np.argsort(token)
                token, text, place = token[order], text[order], place[order]
                keep = several(changes(token), text, place) & (place >= 0)
                token, text, place = token[keep], text[keep], place[keep]
            yield batch_of(token=token, text=text, place=place)

    long_enough = rows.where(F.octet_length("raw") >= length).select("text", "raw")
    repeated = deal.shuffled(long_enough.mapInArrow(lean(parse), deal.schema)).mapInArrow(lean(repeated_phrases), "token long, text long, place int")
    repeated = written(repeated)
    release(docs.sparkSession)
    shards = max(1, -(-repeated.count() // shard_rows))
    dealt = repeated.select(F.pmod("text", F.lit(shards)).cast("int").alias("shard"), "text", "place", "token")
    index = written(dealt.repartition("shard").sortWithinPartitions("shard", "text", "place").mapInArrow(
        lean(lambda b: build(b, depth)), "shard int, lf binary, prior binary, first binary, text binary, place binary"))
    drop_written(repeated)
    # the merge
    block = "key long, shard int, lo int, hi int"
    judged = lambda df: df.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: grouped(b, paired), block)
    levels = [written(judged(index.select("shard", "first").mapInArrow(first_blocks, block)))]
    none = F.lit(None)
    heads = index.select("shard", F.lit(0).alias("kind"), "lf", "prior", none.cast("long").alias("key"), none.cast("int").alias("lo"), none.cast("int").alias("hi"))
    while len(levels) < depth and not levels[-1].isEmpty():
        tails = levels[-1].select("shard", F.lit(1).alias("kind"), none.cast("binary").alias("lf"), none.cast("binary").alias("prior"), "key", "lo", "hi")
        both = heads.unionByName(tails).repartition("shard").sortWithinPartitions("shard", "kind")
        levels.append(written(judged(both.mapInArrow(extend, block))))
        release(docs.sparkSession)
    heads = index.select("shard", F.lit(0).alias("kind"), "text", "place", none.cast("int").alias("depth"), none.cast("int").alias("lo"), none.cast("int").alias("hi"))
    for k, level in enumerate(levels, 1):
        heads = heads.unionByName(level.select("shard", F.lit(1).alias("kind"), none.cast("binary").alias("text"), none.cast("binary").alias("place"), F.lit(k).alias("depth"), "lo", "hi"))
    lengths = written(heads.repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(lean(matched), "text long, lengths binary"))
    for level in [*levels, index]:
        drop_written(level)
    # the texts that hold repeated phrases, one of equals
    groups = written(base.groupBy("sha", "text").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    wanted = lengths.join(groups.select("text", "rep"), "text")
    room = lengths.agg(F.coalesce(F.sum(F.octet_length("lengths") + 80), F.lit(0))).first()[0]
    side = F.broadcast(wanted) if room <= BROADCAST else wanted  # so that texts need no shuffle
    held = rows.join(side, "text").where(F.col("id").eqNullSafe(F.col("rep"))).select("text", "raw", "lengths")
    view = lambda raw, known, at: Windows(raw, known, length, window, depth, np.frombuffer(at, "<i4").astype("int64"))

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with a window that may be repeated, their anchors and cores' keys, and whether all windows of a core are settled."""
        for batch in batches:
            keep, places, keys, settled = [], [], [], []
            for i, (raw, known) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("raw", "lengths")))):
                w = Windows(raw, known, length, window, depth)
                found, q = w.keys()
                if len(found):
                    core, at = np.unique(found, return_inverse=True)
                    keep.append(i)
                    places.append(w.at.astype("<i4").tobytes())
                    keys.append(core)
                    settled.append(np.bincount(at, w.open[q], len(core)) == 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(keep, pa.int64())).columns, pa.array(places, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(settled, pa.list_(pa.bool_()))],
                names=[*batch.schema.names, "at", "cores", "settled"])

    held = written(held.mapInArrow(lean(cores), "text long, raw binary, lengths binary, at binary, cores array<long>, settled array<boolean>"))
    release(docs.sparkSession)
    kinds = held.select("text", F.explode(F.arrays_zip("cores", "settled")).alias("x")).select("text", F.col("x.cores").alias("core"), F.col("x.settled").alias("settled"))
    doubtful = kinds.where("not settled").select("core").distinct()
    asked = kinds.join(doubtful, "core", "left_semi").groupBy("text").agg(F.collect_list("core").alias("wanted"))
    total = held.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0]
    strings_of = Blocks(max(1, total // (4 * ROWS)), high="i8", low="i8", settled="u1", text="i8", place="i4")
    texts_of = Blocks(strings_of.buckets, text="i8", place="i4")
    known_columns = ("text", "raw", "lengths", "at", "wanted")

    def dealt_strings(held: Gathered, whole: bool) -> pa.RecordBatch:
        """Strings of a task by hash; those settled here go on as they are, and a mark for all of them tells the others.

        A string is settled here if it has two places and (aligned strings) one whose windows are open.
        """
        high, low, settled, text, place = held.taken()
        order = np.lexsort((low, high))
        high, low, settled, text, place = (c[order] for c in (high, low, settled, text, place))
        group = changes(high, low)
        first = np.flatnonzero(group)
        sure = several(group, text, place)
        if not whole:
            sure &= (np.minimum.reduceat(settled, first) == 0)[np.cumsum(group) - 1]
        mark = group & sure
        none = np.full(int(mark.sum()), -1)
        stay = ~sure | (settled == 0) if whole else np.ones(len(high), bool)  # settled windows are partners only
        bucket = np.concatenate((np.where(sure, strings_of.buckets + strings_of.spread(text), strings_of.spread(high))[stay], strings_of.spread(high[mark])))
        return strings_of.dealt(bucket, *(np.concatenate((c[stay], more)) for c, more in ((high, high[mark]), (low, low[mark]), (settled, none + 1), (text, none), (place, none))))

    def judged_strings(whole: bool) -> Callable:
        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, (high, low, settled, text, place) in strings_of.opened(batches):
                keep = np.ones(len(high), bool)
                if bucket < strings_of.buckets:
                    order = np.lexsort((low, high))
                    high, low, settled, text, place = (c[order] for c in (high, low, settled, text, place))
                    group = changes(high, low)
                    keep = several(group, text, place)
                    if not whole:
                        keep &= (np.minimum.reduceat(settled, np.flatnonzero(group)) == 0)[np.cumsum(group) - 1]
                keep &= place >= 0
                if whole:
                    keep &= settled == 0
                if keep.any():
                    yield texts_of.dealt(texts_of.spread(text[keep]), text[keep], place[keep])
        return judge

    def places_of(rows: DataFrame, whole: bool) -> DataFrame:
        """``text, places`` of the strings that pass; a text's places come together by the text's bucket."""
        passed = strings_of.shuffled(rows).mapInArrow(lean(judged_strings(whole)), texts_of.schema)
        gathered = lambda batches: (by_text(text, place) for _, (text, place) in texts_of.opened(batches))
        out = written(texts_of.shuffled(passed).mapInArrow(lean(gathered), "text long, places binary"))
        release(docs.sparkSession)
        return out

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings STEP - 1 shorter at aligned places: a window cannot be repeated if the one in it is not."""
        out = Gathered()
        for batch in batches:
            for key, raw, known, at, some in zip(*(batch.column(c).to_pylist() for c in known_columns)):
                w = view(raw, known, at)
                found, q = w.keys()
                q = q[np.isin(found, np.array(some, "int64"))]
                place, where = np.unique(w.aligned(q), return_inverse=True)
                high, low = w.digests(place, length - STEP + 1)
                settled = np.bincount(where, w.open[q], len(place)) == 0
                if len(place) and out.add(high, low, settled.astype("int64"), np.full(len(place), key, "int64"), place.astype("int64")):
                    yield dealt_strings(out, False)
        if out.rows:
            yield dealt_strings(out, False)

    short = held.select("text", "raw", "lengths", "at").join(asked, "text").mapInArrow(lean(near), strings_of.schema)
    alive = places_of(short, False).withColumnRenamed("places", "wanted")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole windows at places that are left; settled ones only stand in as partners."""
        out = Gathered()
        for batch in batches:
            for key, raw, known, at, some in zip(*(batch.column(c).to_pylist() for c in known_columns)):
                w = view(raw, known, at)
                q = np.flatnonzero(w.maybe)
                q = q[np.isin(w.aligned(q), placed(some))]
                high, low = w.digests(q, length)
                if len(q) and out.add(high, low, (~w.open[q]).astype("int64"), np.full(len(q), key, "int64"), q):
                    yield dealt_strings(out, True)
        if out.rows:
            yield dealt_strings(out, True)

    compared = held.select("text", "raw", "lengths", "at").join(alive, "text").mapInArrow(lean(strings), strings_of.schema)
    places = places_of(compared, True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, raw, known, at, found in zip(*(batch.column(c).to_pylist() for c in ("text", "raw", "lengths", "at", "places"))):
                w = view(raw, known, at)
                hit = w.sure.copy()
                hit[placed(found)] = True
                edge = np.zeros(len(raw) + 1, "int64")
                q = np.flatnonzero(hit)
                edge[q] += 1
                edge[q + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(raw, "uint8")[~gone].tobytes()
                out.append((key, int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(kept).digest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["text", "removed", "spans", "rest"])

    cuts = held.select("text", "raw", "lengths", "at").join(places, "text", "left").mapInArrow(lean(cut), "text long, removed long, spans long, rest binary")
    cuts = written(cuts.dropDuplicates(["text"]))
    for old in (held, lengths, places):
        drop_written(old)
    out = base.join(groups.select("sha", F.col("copies")), "sha").join(cuts, "text", "left")
    whole = (F.col("copies") > 1) & (F.col("n") >= length)
    return out.select(
        "id", F.col("n").alias("n_bytes"), F.when(whole, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex(F.coalesce("rest", "sha")))).alias("kept_sha256"),
    )
