"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are lower-cased words without punctuation, and distances are edit
distances over words. The CGK random walk (Chakraborty, Goldenberg, Koucky
2016) reads a string under a shared random function: at step j it copies the
current word and moves on if the function's bit for (j, word) is set. Strings
at edit distance e end up at Hamming distance O(e^2), usually close to 2e, so
sampled places of the walk agree with good probability; the places sampled by
one hash table form one key, and the tables are repeated until the wanted
recall is met. Candidates are verified with the exact edit distance.

Windows have the size of an item: items are put in classes by length, and a
class embeds windows of ``width`` words of a document at every ``stride`` words
against windows of the items at every offset below the stride, so an occurrence
meets a window of its item that starts at the same word whatever its place.
The item side (a fixed query set) is broadcast; documents are read once, in
blocks, and never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from threadlake.llm.common import lean, written

PUNCTUATION = re.compile(rb"[!-/:-@\[-`{-~]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xC2B2AE3D27D4EB4F)
WALKS = 3  # independent random functions for each length class


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * FACTOR
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Words:
    """Numbers of words: items' words have numbers from 1, all others are 0."""

    def __init__(self, items: list[str]):
        self.known: dict[bytes, int] = {}
        for text in items:
            for w in self.split(text):
                self.known.setdefault(w, len(self.known) + 1)

    @staticmethod
    def split(text: str | None) -> list[bytes]:
        return PUNCTUATION.sub(b" ", (text or "").lower().encode("utf-8", "replace")).split()

    def __call__(self, text: str | None) -> np.ndarray:
        words = self.split(text)
        get = self.known.get
        return np.array([get(w, 0) for w in words], "int32") if words else np.zeros(0, "int32")


class Index:
    """The items' windows under ``tables`` bit-sampling hashes for each length class.

    With similarity-preserving walks a sampled place agrees with probability
    about ``1 - 3 * rate`` (two for the distance, one for walks that have not met again); ``samples`` places agree with its power, and
    ``tables`` of them miss with probability ``(1 - p) ** tables``, which is
    brought below ``1 - recall``.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float = 0.1, recall: float = 0.95, stride: int = 4, samples: int = 4, seed: int = 5):
        self.rate, self.stride, self.samples = rate, stride, samples
        kept = sorted({(int(i), t) for i, t in items if i is not None and Words.split(t)})
        self.words = Words([t for _, t in kept])
        self.items = [(i, self.words(t)) for i, t in kept]
        p = max(1e-3, 1 - 3 * rate) ** samples
        self.tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))
        rng = np.random.default_rng(seed)
        # a walk's bit for (step, word) is the highest of the word's code times the step's factor, so no table of both is kept
        self.codes = rng.integers(1, 2**64 - 1, len(self.words.known) + 2, dtype="uint64")
        self.classes = []
        for width in sorted({self.width(len(t)) for _, t in self.items}):
            # every walk has a random function of its own, and every table places of its own
            steps = max(1, (3 * width) // 2)
            walks = []
            for _ in range(WALKS):
                factors = rng.integers(0, 2**63, steps, dtype="uint64") * np.uint64(2) + np.uint64(1)
                places = [rng.choice(steps, min(samples, steps), replace=False) for _ in range(-(-self.tables // WALKS))]
                walks.append((factors, places))
            rows = []
            for n, (_, tokens) in enumerate(self.items):
                if self.width(len(tokens)) == width:
                    starts = np.arange(min(stride, len(tokens) - width + 1))
                    rows += [(k, n, s) for keys in self.keys(tokens, starts, width, walks) for k, s in zip(keys.tolist(), starts.tolist())]
            rows.sort()
            # documents are read at every step words, no more than the fewest offsets of an item here
            step = min([stride, *[len(t) - width + 1 for _, t in self.items if self.width(len(t)) == width]])
            self.classes.append((width, step, walks, np.array([r[0] for r in rows], "uint64"), np.array([r[1:] for r in rows], "int64").reshape(-1, 2)))

    def width(self, length: int) -> int:
        """The window of an item of so many words: at most its length less the offsets, in steps of a quarter."""
        room = max(1, length - self.stride + 1)
        return max(1, int(2 ** (math.floor(4 * math.log2(room)) / 4)))

    def keys(self, tokens: np.ndarray, starts: np.ndarray, width: int, walks: list, ends: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """A key of each window for each table. Sampled places are hashed as the walk passes them; ``ends`` cuts windows short."""
        number = 0
        for factors, places in walks:
            keys = np.full((len(places), len(starts)), 1, "uint64") * np.arange(number + 1, number + 1 + len(places), dtype="uint64")[:, None]
            number += len(places)
            at, end = starts.copy(), starts + width if ends is None else ends
            for j in range(1 + max(map(max, places))):
                here = np.where(at < end, tokens[np.minimum(at, end - 1)], -1)
                if any(j in p for p in places):
                    code = (here + 2).astype("uint64") * ODD
                    for t, p in enumerate(places):
                        if j in p:
                            keys[t] = mixed(keys[t] ^ code)
                at += (self.codes[here] * factors[j] >> np.uint64(63)).astype("int64")
            yield from keys

    def candidates(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows (document, item, start in the document where the item would begin) of windows that share a key.

        ``flat`` holds the tokens of several documents, which end at ``ends``.
        """
        first = np.concatenate(([0], ends[:-1]))
        sizes = ends - first
        unknown = np.concatenate(([0], np.cumsum(flat == 0)))
        found = [np.zeros((0, 3), "int64")]
        for width, step, walks, known, where in self.classes:
            allowed = math.floor(self.rate * (width * 2**0.25 + self.stride))
            least = max(1, width - allowed)  # at a document's end a passage may lack words
            each = np.where(sizes >= least, (sizes - least) // step + 1, 0)
            upto = np.cumsum(each)
            doc = np.repeat(np.arange(len(sizes)), each)
            starts = first[doc] + step * (np.arange(len(doc)) - (upto - each)[doc])
            stops = np.minimum(starts + width, ends[doc])
            # a window within reach has no more words unknown to all items than edits are allowed
            near = unknown[stops] - unknown[starts] <= allowed
            starts, stops, doc = starts[near], stops[near], doc[near]
            if not len(starts):
                continue
            for keys in self.keys(flat, starts, width, walks, stops):
                low, high = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
                at = np.flatnonzero(low < high)
                many = high[at] - low[at]
                at = np.repeat(at, many)
                k = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + low[at]
                found.append(np.stack((doc[at], where[k, 0], starts[at] - first[doc[at]] - where[k, 1]), 1))
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """For each text: (item_id, start word, distance) of each item's best occurrence within ``rate`` of its words."""
        out: list[list[tuple[int, int, int]]] = []
        for block in blocks(texts):
            tokens = [self.words(t) for t in block]
            best: list[dict[int, tuple[int, int]]] = [{} for _ in block]
            for doc, n, start in self.candidates(np.concatenate(tokens), np.cumsum([len(t) for t in tokens])).tolist():
                item_id, item = self.items[n]
                limit = int(self.rate * len(item))
                if best[doc].get(item_id, (0, 1))[1] == 0:
                    continue
                got = fitted(item, tokens[doc][max(0, start - limit) : max(0, start + len(item) + limit)])
                if got <= limit and (item_id not in best[doc] or got < best[doc][item_id][1]):
                    best[doc][item_id] = (max(0, start), got)
            out += [[(i, s, d) for i, (s, d) in sorted(b.items())] for b in best]
        return out


def blocks(texts: list[str | None], size: int = 2_000_000) -> Iterator[list[str | None]]:
    """The texts in runs of about ``size`` characters; a longer text is a run of its own."""
    held, chars = [], 0
    for t in texts:
        if held and chars + len(t or "") > size:
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t or "")
    if held:
        yield held


def fitted(item: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance of ``item`` to any substring of ``text``."""
    row = np.zeros(len(text) + 1, "int64")
    shift = np.arange(len(text) + 1)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - shift) + shift  # insertions
    return int(row.min())


def item_blocks(items: DataFrame, most_items: int, most_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks that are small enough to be broadcast; an item of more bytes is a block of its own."""
    held, size = [], 0
    for i, t in items.toLocalIterator():
        more = len((t or "").encode("utf-8", "replace"))
        if held and (len(held) >= most_items or size + more > most_bytes):
            yield held
            held, size = [], 0
        held.append((i, t))
        size += more
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = 0.1, recall: float = 0.95, most_items: int = 100_000, most_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with ``hits array<struct<item_id, start, distance>>``, empty where the document is clean.

    ``rate`` is the share of an item's words that may be edited. Items are a
    query set: blocks of at most ``most_items`` items and ``most_bytes`` of text
    are broadcast one after the other (an index takes some twenty times its
    items' bytes), each over all documents; between blocks the documents and
    their hits are written. Null or blank items match nothing, null texts have no
    words, equal items are each reported, and a column named hits is replaced. A
    text of any length is searched whole. An item of fewer than ``1 / rate`` words
    may have no edit, so one of a single word marks every document with that word:
    leave such items out of a benchmark. Item ids are cast to long.
    """
    kept = docs.drop("hits")
    place = kept.columns.index(text_col)
    hit = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("distance", pa.int64())]))
    found = StructType([StructField(n, LongType()) for n in ("item_id", "start", "distance")])
    kind = StructType([*kept.schema.fields, StructField("hits", ArrayType(found))])

    def searched(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        index = docs.sparkSession.sparkContext.broadcast(Index(items, rate, recall))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole, at in ((b, at) for b in batches for at in range(0, b.num_rows, 256)):
                batch = whole.slice(at, 256)
                new = [[dict(zip(("item_id", "start", "distance"), m)) for m in ms] for ms in index.value.matches(batch.column(place).to_pylist())]
                if batch.num_columns > kept_columns:
                    new = [a + b for a, b in zip(batch.column(kept_columns).to_pylist(), new)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept_columns], pa.array(new, hit)], names=kind.names)

        return rows.mapInArrow(lean(find), kind)

    kept_columns = len(kept.columns)
    out = None
    for items in item_blocks(benchmark.select(F.col(item_id), F.col(item_text)), most_items, most_bytes):
        out = searched(kept if out is None else written(out), items)
    return searched(kept, []) if out is None else out
