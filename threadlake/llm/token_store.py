"""Token ids on disk: a wavelet matrix for each shard.

A shard holds the ids of consecutive documents (ascending id) as succinct
bit-planes: plane j keeps bit j of every token, the tokens being stably split
by each bit on the way down, so that every query costs one rank for each plane.
``access``, ``rank`` (counting) and ``select`` (occurrence lookup) work on the
planes without decoding the shard. A shard is one row, and so one zstd-compressed
blob, of a Parquet dataset that Spark writes; nothing is kept on local disks.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.common import lean, narrow, written
from threadlake.llm.shingles import beginnings, runs_of, word_hashes

BLOCK = 512  # bits for each stored count of a plane
SLOT_BITS, PROBES = 21, 16  # slots of an encoder's memory by hash, and how many are tried


class WaveletMatrix:
    """Tokens of one shard; ``width`` planes, the highest bit first."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.planes = n, planes  # each plane packed, 8 bits a byte, first bit highest
        self.width = len(planes)
        counts = [np.bitwise_count(np.pad(p, (0, -len(p) % (BLOCK // 8))).reshape(-1, BLOCK // 8)).sum(1, dtype="int64") for p in planes]
        self.before = [np.concatenate(([0], np.cumsum(c))) for c in counts]
        self.zeros = [n - int(b[-1]) for b in self.before]

    @classmethod
    def of(cls, tokens: np.ndarray) -> WaveletMatrix:
        """Of unsigned integers; an empty array gives an empty matrix."""
        width = int(tokens.max()).bit_length() if len(tokens) else 0
        planes, tokens = [], tokens.astype("uint16" if width <= 16 else "uint32")
        for j in range(width - 1, -1, -1):
            bit = (tokens >> j) & 1 != 0
            planes.append(np.packbits(bit))
            tokens = np.concatenate((tokens[~bit], tokens[bit]))
        return cls(len(tokens), planes)

    def ones(self, plane: int, i: int) -> int:
        """Set bits among the first ``i`` of a plane."""
        block, rest = divmod(i, BLOCK)
        start = block * (BLOCK // 8)
        part = self.planes[plane][start : start + rest // 8]
        count = int(self.before[plane][block]) + int(np.bitwise_count(part).sum())
        if rest % 8:
            count += int(self.planes[plane][start + rest // 8] >> (8 - rest % 8)).bit_count()
        return count

    def bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i >> 3] >> (7 - (i & 7))) & 1

    def access(self, i: int) -> int:
        """The token at ``i``."""
        token = 0
        for j in range(self.width):
            one = self.bit(j, i)
            token = token << 1 | one
            i = self.zeros[j] + self.ones(j, i) if one else i - self.ones(j, i)
        return token

    def access_many(self, places: np.ndarray) -> np.ndarray:
        """The tokens at ``places``, plane by plane for all of them together."""
        i, out = places.astype("int64"), np.zeros(len(places), "int64")
        for j, plane in enumerate(self.planes):
            byte = i >> 3
            one = (plane[byte] >> (7 - (i & 7)).astype("uint8")) & 1 != 0
            upto = np.concatenate(([0], np.cumsum(np.bitwise_count(plane), dtype="int64")))
            ones = upto[byte] + np.bitwise_count(plane[byte] & ~(np.uint8(0xFF) >> (i & 7).astype("uint8")))
            i = np.where(one, self.zeros[j] + ones, i - ones)
            out = out << 1 | one
        return out

    def span(self, token: int, i: int) -> tuple[int, int]:
        """The token's interval on the last level for the first ``i`` places."""
        low = 0
        if token >> self.width:
            return 0, 0
        for j in range(self.width):
            if token >> (self.width - 1 - j) & 1:
                low, i = self.zeros[j] + self.ones(j, low), self.zeros[j] + self.ones(j, i)
            else:
                low, i = low - self.ones(j, low), i - self.ones(j, i)
        return low, i

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` is among the first ``i`` tokens."""
        low, high = self.span(token, i)
        return high - low

    def find(self, plane: int, one: bool, k: int) -> int:
        """The place of the k-th (from 0) bit of a kind in a plane."""
        before = self.before[plane] if one else np.arange(len(self.before[plane])) * BLOCK - self.before[plane]
        block = int(np.searchsorted(before, k, "right")) - 1
        start = block * (BLOCK // 8)
        bits = np.unpackbits(self.planes[plane][start : start + BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) ``token``; -1 if there are fewer."""
        low, high = self.span(token, self.n)
        if not 0 <= k < high - low:
            return -1
        at = low + k
        for j in range(self.width - 1, -1, -1):
            one = bool(token >> (self.width - 1 - j) & 1)
            at = self.find(j, one, at - self.zeros[j] if one else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens in order, plane by plane from the last."""
        kind = np.dtype("uint16" if self.width <= 16 else "uint32").type
        out = np.zeros(self.n, kind)
        for j in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[j], count=self.n).astype(bool)
            up = np.empty_like(out)
            up[~bit] = out[: self.zeros[j]]
            up[bit] = out[self.zeros[j] :] | kind(1 << (self.width - 1 - j))
            out = up
        return out

    def to_bytes(self) -> bytes:
        raw = np.array([self.n, self.width], "<u8").tobytes() + b"".join(p.tobytes() for p in self.planes)
        return zstandard.ZstdCompressor(level=1).compress(raw)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, width = (int(x) for x in np.frombuffer(raw[:16], "<u8"))
        size = -(-n // 8)
        return cls(n, [np.frombuffer(raw, "uint8", size, 16 + j * size) for j in range(width)])


#: A run of Latin letters, then of ASCII signs other than the apostrophe.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\[-`{-~]*)")


# Kinds of bytes, for parting words from the signs behind them: ASCII letters, first bytes of Latin letters (U+00C0 to U+023F), ASCII signs but the apostrophe.
ASCII_LETTER, LATIN_FIRST, SIGN = (np.zeros(256, bool) for _ in range(3))
ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
LATIN_FIRST[0xC3:0xC9] = True
SIGN[[i for i in range(0x21, 0x7F) if not chr(i).isalnum() and i != 0x27]] = True


def parted(raw: np.ndarray, start: np.ndarray, end: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same runs, those of Latin letters with signs behind them as two: the pre-tokenizer parts them there."""
    if not len(start):
        return start, end, upto
    letter = ASCII_LETTER[raw]
    high = np.flatnonzero(LATIN_FIRST[raw[:-1]])
    two = raw[high].astype("uint16") << 8 | raw[high + 1]
    # without the signs x and / of arithmetic, and a capital that lower case divides
    high = high[(raw[high + 1] & 0xC0 == 0x80) & (two != 0xC397) & (two != 0xC3B7) & (two != 0xC4B0)]
    letter[high] = letter[high + 1] = True
    other = np.append(np.flatnonzero(~letter), len(raw))
    head = np.minimum(other[np.searchsorted(other, start)], end)
    cut = (head > start) & (head < end)
    word = np.flatnonzero(cut)
    sign = SIGN[raw]
    plain = np.append(np.flatnonzero(~sign), len(raw))
    cut[word] = plain[np.searchsorted(plain, head[word])] >= end[word]
    pairs = np.concatenate(([0], np.cumsum(cut, dtype="int64")))
    at = np.arange(len(start)) + pairs[:-1]
    starts, ends = np.empty(len(start) + int(pairs[-1]), "int64"), np.empty(len(start) + int(pairs[-1]), "int64")
    starts[at], ends[at] = start, np.where(cut, head, end)
    starts[at[cut] + 1], ends[at[cut] + 1] = head[cut], end[cut]
    return starts, ends, upto + pairs[upto]


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself where it is a visible Latin-1 sign, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of a text under a ``tokenizers`` file, remembered for each run of non-blank bytes.

    The file's pre-tokenizer never joins text across a blank, nor letters with
    signs, so the ids of a text are those of its runs one after the other, and
    those of a plain word with signs behind it are the word's, then the signs'.
    The library encodes each the first time it is seen. With ``plain`` a word of
    Latin letters goes to the library's BPE model directly (for files that
    lower-case, split letters from signs and use byte letters); whatever else
    there is takes the whole pipeline. The memory is bounded: it starts anew at
    ``most`` runs.
    """

    def __init__(self, path: str, plain: bool = True, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer, self.plain, self.most = Tokenizer.from_file(path), plain, most
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.forget()

    def forget(self) -> None:
        self.places: dict[bytes, int] = {}  # of runs that are looked up one by one
        self.starts, self.ids = array("q", [0]), array("I")
        self.slots = np.zeros((1 << SLOT_BITS, 3), "uint64")  # hash, first eight bytes, place and one: of all others

    def find(self, h: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The places of runs by hash and first bytes, -1 for unknown ones; a slot that is taken sends on to the next."""
        out = np.full(len(h), -1, "int64")
        todo, slot = np.arange(len(h)), (h >> np.uint64(64 - SLOT_BITS)).astype("int64")
        for _ in range(PROBES):
            met = self.slots[slot]
            hit = (met[:, 0] == h[todo]) & (met[:, 1] == begin[todo]) & (met[:, 2] > 0)
            out[todo[hit]] = met[hit, 2].astype("int64") - 1
            on = ~hit & (met[:, 2] > 0)
            if not on.any():
                break
            todo, slot = todo[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def keep(self, h: np.ndarray, begin: np.ndarray, place: np.ndarray) -> None:
        """Remember new runs; one that finds no free slot is learnt again when it comes again."""
        rows = np.stack((h, begin, place.astype("uint64") + np.uint64(1)), 1)
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype("int64")
        for _ in range(PROBES):
            free = np.flatnonzero(self.slots[slot, 2] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.slots[slot[won]] = rows[won]
            left = np.ones(len(rows), bool)
            left[won] = False
            if not left.any():
                break
            rows, slot = rows[left], (slot[left] + 1) & ((1 << SLOT_BITS) - 1)

    def learn(self, run: bytes) -> int:
        """Add a run."""
        self.ids.extend(self.ids_of(run))
        self.starts.append(len(self.ids))
        return len(self.starts) - 2

    def ids_of(self, run: bytes) -> list[int]:
        """A run's ids; a plain word with signs has those of the two."""
        text = run.decode("utf-8", "replace")
        plain = None
        if self.plain and run.isascii() and run.isalpha():  # most are
            return [t.id for t in self.model.tokenize(text.lower())]
        if not (plain := self.plain and PLAIN.fullmatch(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if plain[2]:
            return self.ids_of(plain[1].encode()) + self.ids_of(plain[2].encode())
        word = text.lower()
        spelt = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return [t.id for t in self.model.tokenize(spelt)]

    def known(self, run: bytes) -> int:
        place = self.places.get(run)
        if place is None:
            place = self.places[run] = self.learn(run)
        return place

    def places_of(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each run of the texts ``raw[bounds[i]:bounds[i+1]]``, and the runs' bounds by text; A-Z count as a-z."""
        start, end, upto = parted(raw, *runs_of(raw, bounds))
        h = word_hashes(raw, start, end)
        begin = beginnings(raw, start, end)
        out = self.find(h, begin)
        missed = np.flatnonzero(out < 0)
        if len(missed):
            pair = np.stack((h[missed], begin[missed]), 1).view("V16")[:, 0]
            _, first, back = np.unique(pair, return_index=True, return_inverse=True)
            where = missed[first]
            whole, learn = raw.tobytes().lower(), self.learn
            found = np.array([learn(whole[a:b]) for a, b in zip(start[where].tolist(), end[where].tolist())], "int64")
            out[missed] = found[back]
            self.keep(h[where], begin[where], found)
        return out, upto

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        if len(self.starts) > self.most:
            self.forget()
        # ASCII capitals fold to fewer runs; not where a special token's own spelling may occur
        if self.plain and not any(b"<|" in t for t in texts):
            at, upto = self.places_of(np.frombuffer(b"".join(texts), "uint8"), np.cumsum([0, *map(len, texts)]))
        else:
            runs = [(t if b"<|" in t or not self.plain else t.lower()).split() for t in texts]
            at = np.array([self.known(w) for r in runs for w in r], "int64")
            upto = np.cumsum([0, *map(len, runs)])
        if not len(at):
            return np.zeros(0, "uint32"), np.zeros(len(texts), "int64")
        starts, ids = np.frombuffer(self.starts, "int64"), np.frombuffer(self.ids, "uint32")  # views, gone before more is learnt
        first, sizes = starts[at], starts[at + 1] - starts[at]
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        return flat, np.diff(np.concatenate(([0], ends))[upto])


ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool) -> Encoder:
    """One for each Python worker, so that its memory outlives a task."""
    if (path, plain) not in ENCODERS:
        ENCODERS[path, plain] = Encoder(path, plain)
    return ENCODERS[path, plain]


#: ``before``: tokens of the shard in earlier pieces; ``n_null``: the first documents, whose ids are null.
STORED = "shard int, before long, n_docs long, n_tokens long, n_null long, doc_ids binary, doc_ends binary, matrix binary"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, shards: int = 0, id_col: str = "doc_id", text_col: str = "text", piece: int = 4 << 20, plain: bool = True) -> DataFrame:
    """Encode every text, append ``end_id`` and write the shards; returns the written table (columns ``STORED`` plus ``piece``).

    Documents are range-partitioned by id (rows with the same id by a hash of
    the text as well) and sorted, so shards follow each other in ascending id.
    A shard's matrix is cut into pieces of about ``piece`` bytes of text, which
    bounds memory whatever a range holds; one document is never divided. Null
    ids come first, null texts count as empty, an empty table gives no rows.
    ``shards`` 0 lets the session's shuffle partitions decide. Ids are cast to
    long, so text that is no number is an error under ANSI.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    count = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(count, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    dealt = dealt.select("id", "text", F.spark_partition_id().alias("shard"))
    return written(dealt.mapInArrow(lean(lambda batches: pieces(batches, tokenizer, end_id, piece, plain)), STORED + ", piece int"))


def pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, limit: int, plain: bool) -> Iterator[pa.RecordBatch]:
    model, held, number = None, [], 0
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = waiting = shard = before = 0

    def encode() -> None:
        nonlocal waiting
        if texts:
            flat, counts = model.encode(texts)
            held.append((np.insert(flat, np.cumsum(counts), end_id).astype("uint32"), counts + 1))
            texts.clear()
            waiting = 0

    def close() -> pa.RecordBatch:
        nonlocal before
        flat, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        known = np.array([0 if i is None else i for i in ids], "<i8")
        row = {"shard": shard, "before": before, "n_docs": len(ids), "n_tokens": len(flat), "n_null": ids.count(None), "doc_ids": known.tobytes(), "doc_ends": np.cumsum(counts).astype("<i8").tobytes(), "matrix": WaveletMatrix.of(flat).to_bytes(), "piece": number}
        types = [pa.int32(), *[pa.int64()] * 4, *[pa.binary()] * 3, pa.int32()]
        before += len(flat)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            model = model or encoder(tokenizer, plain)
            shard = batch.column("shard")[0].as_py()
            for key, text in zip(batch.column("id"), batch.column("text")):
                texts.append(text.as_py())
                ids.append(key.as_py())
                size += len(texts[-1])
                waiting += len(texts[-1])
                if waiting >= 1 << 20 or size >= limit:
                    encode()
                if size >= limit:
                    yield close()
                    held, ids, size, number = [], [], 0, number + 1
    encode()
    if held:
        yield close()


def read_documents(stored: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids_crc32, first_token`` of every document, decoded from the written shards.

    Where a document starts is what earlier shards hold (one small row for each
    shard), what earlier pieces of its shard hold, and its place in the piece.
    """
    place = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = stored.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    shards = written(shards.select("shard", F.coalesce(F.sum("all").over(place), F.lit(0)).alias("earlier")))
    blobs = stored.join(narrow(shards, 24), "shard").select((F.col("earlier") + F.col("before")).alias("start"), "n_null", "doc_ids", "doc_ends", "matrix")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, nulls, ids, ends, blob = (batch.column(i)[row].as_py() for i in range(5))
                matrix = WaveletMatrix.from_bytes(blob)
                tokens = matrix.tokens().astype("<u4")
                ends, ids = np.frombuffer(ends, "<i8"), np.frombuffer(ids, "<i8")
                first = np.concatenate(([0], ends[:-1]))
                raw = memoryview(tokens).cast("B")
                crc = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist())], "int64")
                out = pa.array(ids, pa.int64(), mask=np.arange(len(ids)) < nulls)
                yield pa.RecordBatch.from_arrays([out, pa.array(start + first), pa.array(ends - first), pa.array(crc), pa.array(matrix.access_many(first))], names=["id", "start", "n_tokens", "ids_crc32", "first_token"])

    return blobs.mapInArrow(lean(decode), "id long, start long, n_tokens long, ids_crc32 long, first_token long")


def occurrences(stored: DataFrame, token: int) -> DataFrame:
    """``shard, piece, count``: how often a token is in each piece, by rank on the planes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for blob in batch.column("matrix").to_pylist():
                m = WaveletMatrix.from_bytes(blob)
                found.append(m.rank(token, m.n))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("piece"), pa.array(found, pa.int64())], names=["shard", "piece", "count"])

    return stored.select("shard", "piece", "matrix").mapInArrow(count, "shard int, piece int, count long")
