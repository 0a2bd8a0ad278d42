"""Phrase collocation mining by Apriori passes, level by level.

Level 1 counts words. Level k counts phrases of k words, and a text emits one only
where both its overlapping phrases of k - 1 words are frequent: the frequent ones of
the last level are broadcast. They are a sorted array of hashes while they are at most
``EXACT_GRAMS``, and beyond that a Bloom filter of a fixed size; either lets no
frequent phrase go, and the counts decide, so the result does not depend on which.
Scores of the cuts come from joins of the level tables, not from the texts.

A task counts the phrases of a chunk in numpy (phrases as numbers made of the numbers
of their parts, so exactly), and sends one row for each phrase and chunk to be summed;
a phrase that is everywhere costs one row a chunk. A text longer than a chunk is
counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlake.llm.common import drop_written, lean, narrow, release, written
from threadlake.llm.shingles import FACTORS, LOWER, finish, pieces, word_hashes

#: The bytes that part words, and those that part pieces as well.
GAPS, STOPS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
CHUNK = 4 << 20  # bytes of text counted together
EXACT_GRAMS = 4 << 20  # hashes of eight bytes
BLOOM_BITS = 1 << 28
PROBES = 3

IS_STOP = np.zeros(256, bool)
IS_STOP[list(STOPS)] = True
IS_EDGE = IS_STOP.copy()
IS_EDGE[list(GAPS)] = True


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, its text, and whether it goes on in the piece of the word before."""
    dark = ~IS_EDGE[raw]
    first, last = dark.copy(), dark.copy()
    first[1:] &= ~dark[:-1]
    last[:-1] &= ~dark[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner], last[inner - 1] = dark[inner], dark[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(bounds, start, "right") - 1
    stops = np.cumsum(IS_STOP[raw])
    goes_on = np.zeros(len(start), bool)
    goes_on[1:] = (stops[start[1:]] == stops[start[:-1]]) & (text[1:] == text[:-1])
    return start, end, text, goes_on


def gram_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """Of phrases, from the hashes of their words by place; the language counts as a word."""
    out = np.zeros(len(parts[0]), "uint64")
    for j, part in enumerate(parts):
        out += part * FACTORS[j] + np.uint64(j + 1)
    return finish(out)


def hashes_of(strings: pa.Array) -> np.ndarray:
    """Word hashes of whole strings (A-Z as a-z)."""
    out = np.zeros(len(strings), "uint64")
    for at, raw, bounds in pieces(strings):
        out[at : at + len(bounds) - 1] = word_hashes(raw, bounds[:-1], bounds[1:])
    return out


def probed(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The Bloom filter's bits of each hash; ``bits`` is a power of 2."""
    return [h * FACTORS[40 + probe] >> np.uint64(65 - bits.bit_length()) for probe in range(PROBES)]


class Frequent:
    """The frequent phrases of a level, by hash: exactly, or as a Bloom filter with rare false hits."""

    def __init__(self, hashes: np.ndarray | None, bits: np.ndarray | None):
        self.hashes, self.bits = hashes, bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        if self.hashes is not None:
            if not len(self.hashes):
                return np.zeros(len(h), bool)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            return self.hashes[at] == h
        found = np.ones(len(h), bool)
        for bit in probed(h, 64 * len(self.bits)):
            found &= self.bits[(bit >> np.uint64(6)).astype("int64")] >> (bit & np.uint64(63)) & np.uint64(1) == 1
        return found


def frequent_set(table: DataFrame, most: int = EXACT_GRAMS) -> Frequent:
    """Of the level table ``lang, phrase``; at most ``8 * most`` or ``BLOOM_BITS / 8`` bytes reach the driver."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.split_pattern(batch.column("phrase"), " ")
            k = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            if len(k) == 0:
                continue
            flat = hashes_of(words.flatten()).reshape(len(k), -1)  # all phrases of a level have as many words
            h = gram_hashes([hashes_of(batch.column("lang")), *[np.ascontiguousarray(c) for c in flat.T]])
            yield pa.RecordBatch.from_arrays([pa.array(h.view("int64"))], names=["h"])

    hashes = table.select("lang", "phrase").mapInArrow(lean(hashed), "h long")
    if table.count() <= most:
        found = hashes.toArrow()
        return Frequent(np.sort(found.column("h").to_numpy().view("uint64")), None)

    size = BLOOM_BITS

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.concatenate(probed(batch.column("h").to_numpy().view("uint64"), size))
            slot, mask = (bit >> np.uint64(6)).astype("int64"), (np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(mask.view("int64"))], names=["slot", "mask"])

    slots = hashes.mapInArrow(lean(probes), "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(size >> 6, "uint64")
    bits[slots.column("slot").to_numpy()] = slots.column("mask").to_numpy().view("uint64")
    return Frequent(None, bits)


def joined(parts: list[pa.Array]) -> pa.Array:
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type))


def counted(raw: np.ndarray, bounds: np.ndarray, lang_of: np.ndarray, langs: pa.Array, level: int, known: list[Frequent]) -> Iterator[pa.RecordBatch]:
    """``lang, phrase, n`` of the phrases of ``level`` words in one chunk; at level 1 also each language's words, as the null phrase.

    ``known[k - 1]`` are the frequent phrases of k words, for each k below the level.
    """
    start, end, text, goes_on = words_of(raw, bounds)
    if not len(start):
        return
    hashes = word_hashes(raw, start, end)
    _, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
    low = pa.py_buffer(LOWER[raw].tobytes())
    size = end[sample] - start[sample]
    packed = np.concatenate(([0], np.cumsum(size)))
    take = np.repeat(start[sample] - packed[:-1], size) + np.arange(int(packed[-1]))
    spelled = pa.LargeStringArray.from_buffers(len(sample), pa.py_buffer(packed.astype("int64").tobytes()), pa.py_buffer(np.frombuffer(low, "uint8")[take].tobytes()))
    lang = lang_of[text]
    lang_hash = hashes_of(langs)
    # a phrase at a place is a number; level by level from the numbers of its two overlapping parts
    place = np.arange(len(start))
    gram, one = np.unique(lang * len(sample) + which, return_inverse=True)
    at = np.zeros(len(gram), "int64")
    at[one] = place  # some place of each
    number = one
    for k in range(1, level):
        h = gram_hashes([lang_hash[lang[at]], *[hashes[at + j] for j in range(k)]])
        good = known[k - 1].holds(h)[number]
        stay = np.flatnonzero(good[:-1] & good[1:] & (place[1:] == place[:-1] + 1) & goes_on[place[1:] + k - 1]) if len(place) > 1 else np.zeros(0, "int64")
        pair = number[stay].astype("int64") * len(at) + number[stay + 1]
        place = place[stay]
        gram, number = np.unique(pair, return_inverse=True)
        at = np.zeros(len(gram), "int64")
        at[number] = place
    n = np.bincount(number, minlength=len(at))
    if level == 1:
        words = np.bincount(lang, minlength=len(langs))
        yield pa.RecordBatch.from_arrays([langs, pa.nulls(len(langs), pa.string()), pa.array(words)], names=["lang", "phrase", "n"])
    for a in range(0, len(at), 1 << 16):
        some = at[a : a + (1 << 16)]
        phrase = joined([spelled.take(pa.array(which[some + j])) for j in range(level)]).cast(pa.string())
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[some])), phrase, pa.array(n[a : a + (1 << 16)])], names=["lang", "phrase", "n"])


def level_counts(rows: DataFrame, level: int, known: list) -> DataFrame:
    """``lang, phrase, n`` of all phrases of ``level`` words whose parts are in ``known`` (broadcast variables)."""
    chunk = CHUNK

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = [k.value for k in known]
        held: list[pa.RecordBatch] = []
        size = 0

        def settled() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            lang = table.column("lang").combine_chunks().dictionary_encode()
            text = table.column("raw").combine_chunks()
            text = text.cast(pa.large_binary())
            places = np.frombuffer(text.buffers()[1], "int64")[text.offset : text.offset + len(text) + 1].astype("int64")
            data = text.buffers()[2]
            raw = np.frombuffer(data, "uint8")[places[0] : places[-1]] if data is not None else np.zeros(0, "uint8")
            codes, names = lang.indices.to_numpy().astype("int64"), lang.dictionary
            yield from counted(raw, places - places[0], codes, names, level, below)

        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column("raw")).to_numpy(), dtype="int64")
            at = 0
            while at < batch.num_rows:
                before = int(upto[at - 1]) if at else 0
                to = min(batch.num_rows, int(np.searchsorted(upto, before + chunk - size)) + 1)
                held.append(batch.slice(at, to - at))
                size += int(upto[to - 1]) - before
                at = to
                if size >= chunk:
                    yield from settled()
                    held, size = [], 0
        if held:
            yield from settled()

    return rows.mapInArrow(lean(scan), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def part(phrase: Column, start: int, words: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, words), " ")


def floor_ratio(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (left * right))`` in whole numbers of up to 38 digits; at most 1000000, since a part is as frequent as the phrase."""
    wide = lambda c: c.cast("decimal(19,0)")
    with_names = F.struct((wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)").alias("top"), (wide(left) * wide(right)).cast("decimal(38,0)").alias("low"))
    return F.try_divide(with_names.top - with_names.top % with_names.low, with_names.low).cast("long")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = 3, min_count: int = 10, covered_percent: int = 50, top: int = 2000, exact_grams: int = EXACT_GRAMS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``max_words`` words.

    Words are A-Z lower-cased runs between blanks within pieces that end at
    ``.,;:!?`` and line breaks. ``a`` counts the phrase's occurrences, overlaps
    included, ``l`` and ``r`` those of its parts at the cut of the lowest score
    (the smallest cut among equals), ``n`` the language's words, and the score is
    ``floor(1000000 * a * a / (l * r))``. A phrase inside a longer one that has
    ``covered_percent`` of its occurrences or more is left out. Ranks go by score
    and ``a``, falling, then by the phrase's bytes. A null language is ``und``; null
    and empty texts have no words; repeated rows count as often as they are there;
    an empty table gives an empty one; other columns are not read.
    """
    if not 2 <= max_words <= 16:
        raise ValueError("max_words has to be from 2 to 16")
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    tables: list[DataFrame] = []
    known: list = []
    for level in range(1, max_words + 1):
        enough = F.col("n") >= min_count
        tables.append(written(level_counts(rows, level, known).where(enough | F.col("phrase").isNull() if level == 1 else enough)))
        if level < max_words:
            known.append(spark.sparkContext.broadcast(frequent_set(tables[-1].where("phrase is not null"), exact_grams)))
        release(spark)
    for b in known:
        b.unpersist()
    totals = tables[0].where("phrase is null").select("lang", F.col("n").alias("all"))
    out = None
    for k in range(2, max_words + 1):
        level = tables[k - 1].withColumnRenamed("n", "a")
        scored = level
        for cut in range(1, k):
            left = tables[cut - 1].select("lang", F.col("phrase").alias("p"), F.col("n").alias(f"l{cut}"))
            right = tables[k - cut - 1].select("lang", F.col("phrase").alias("p"), F.col("n").alias(f"r{cut}"))
            scored = scored.withColumn("p", part(F.col("phrase"), 1, cut)).join(left, ["lang", "p"]).drop("p")
            scored = scored.withColumn("p", part(F.col("phrase"), cut + 1, k - cut)).join(right, ["lang", "p"]).drop("p")
        cuts = [F.struct(floor_ratio(F.col("a"), F.col(f"l{c}"), F.col(f"r{c}")).alias("score"), F.lit(c).alias("k"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)]
        scored = scored.select("lang", "phrase", "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut"))
        for longer in range(k + 1, max_words + 1):  # the most frequent longer phrase around each
            inside = tables[longer - 1].select("lang", F.explode(F.array(*[part(F.col("phrase"), i, k) for i in range(1, longer - k + 2)])).alias("phrase"), "n")
            around = inside.groupBy("lang", "phrase").agg(F.max("n").alias("around"))
            scored = scored.join(around, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("around") < F.lit(covered_percent) * F.col("a"), F.lit(True))).drop("around")
        out = scored if out is None else out.unionByName(scored)
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    best = written(out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    done = written(best.join(narrow(totals, 64), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("all").alias("n"), F.col("cut.score").alias("score")))
    for old in (*tables, best):
        drop_written(old)
    return done
