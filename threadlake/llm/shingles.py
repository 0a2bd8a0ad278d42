"""Word shingles of many texts at once, in numpy: no Python object for a word or a text.

A word (a run of non-blank bytes, A-Z lower-cased) is hashed as a polynomial
over random numbers for its bytes, taken from prefix sums over the whole piece
of text; a shingle mixes the hashes of its words. Words of over ``LONG`` bytes
go through xxhash. Hashes have 64 bits and depend on the words alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 1 << 20  # bytes of text worked on at once
LONG = 1 << 14
MASK = 2**64

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
RANDOM = np.random.default_rng(20240611)
EXACT = RANDOM.integers(0, MASK, 256, dtype="uint64")  # of bytes as they are
VALUES = EXACT.copy()
VALUES[0x41:0x5B] = VALUES[0x61:0x7B]
LOWER = np.arange(256, dtype="uint8")
LOWER[0x41:0x5B] += 32
BASE = int(RANDOM.integers(1, 2**62)) * 2 + 1
FACTORS = RANDOM.integers(1, 2**63, 64, dtype="uint64") * np.uint64(2) + np.uint64(1)
POWERS: dict[int, np.ndarray] = {}


def powers(base: int) -> np.ndarray:
    """Of an odd number modulo 2**64; one table for each Python worker."""
    if base not in POWERS:
        table = np.full(PIECE + LONG + 2, base, "uint64")
        table[0] = 1
        POWERS[base] = np.multiply.accumulate(table)
    return POWERS[base]


def finish(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """Hashes of the words ``raw[start:end]``, which follow each other; with ``EXACT`` as values A-Z are not lower-cased."""
    out = np.zeros(len(start), "uint64")
    up, down = powers(BASE), powers(pow(BASE, -1, MASK))
    size = end - start
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + PIECE)))
        first = start[at]
        if size[at:to].max() <= LONG:
            part = raw[first : end[to - 1]]
            upto = np.zeros(len(part) + 1, "uint64")
            np.cumsum(values[part] * up[: len(part)], out=upto[1:])
            s, e = start[at:to] - first, end[at:to] - first
            out[at:to] = (upto[e] - upto[s]) * down[s]
        else:
            for i in range(at, to):
                word = raw[start[i] : end[i]]
                if size[i] <= LONG:
                    out[i] = (values[word] * up[: len(word)]).sum(dtype="uint64")
                else:
                    out[i] = xxhash.xxh3_64_intdigest(word.tobytes() if values is EXACT else word.tobytes().lower())
        at = to
    out = finish(out) ^ size.astype("uint64") * np.uint64(0xD6E8FEB86659FD93)
    return finish(out)


def runs_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts ``raw[bounds[i]:bounds[i+1]]``, and the words' bounds by text."""
    dark = ~BLANKS[raw]
    first, last = dark.copy(), dark.copy()
    first[1:] &= ~dark[:-1]
    last[:-1] &= ~dark[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner], last[inner - 1] = dark[inner], dark[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, bounds)


def beginnings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first eight bytes of each word, A-Z lower-cased, as a number; shorter words are filled with zeros."""
    low = np.concatenate((LOWER[raw], np.zeros(8, "uint8")))
    eight = np.ndarray((len(raw) + 1,), "<u8", low, 0, (1,))
    rest = np.uint64(8) * (np.uint64(8) - np.minimum(end - start, 8).astype("uint64"))
    return eight[start] & (np.uint64(MASK - 1) >> rest)


def shingled(raw: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of the texts ``raw[bounds[i]:bounds[i+1]]`` in order, repeats included, and their bounds.

    With fewer than k words the whole sequence is one shingle; without words there is none.
    """
    start, end, word = runs_of(raw, bounds)
    h = word_hashes(raw, start, end)
    words = np.diff(word)
    several = np.where(words >= k, words - k + 1, 0)
    out_bounds = np.concatenate(([0], np.cumsum(np.where(words > 0, np.maximum(several, 1), 0))))
    all_ = np.zeros(max(0, len(h) - k + 1), "uint64")
    for j in range(k):
        all_ += h[j : j + len(all_)] * FACTORS[j % len(FACTORS)] + np.uint64(j)
    all_ = finish(all_)
    out = np.zeros(int(out_bounds[-1]), "uint64")
    full = np.flatnonzero(several)
    run = np.arange(int(several.sum())) - np.repeat(np.cumsum(several[full]) - several[full], several[full])
    out[np.repeat(out_bounds[:-1][full], several[full]) + run] = all_[np.repeat(word[:-1][full], several[full]) + run]
    for i in np.flatnonzero((words > 0) & (words < k)):
        out[out_bounds[i]] = xxhash.xxh3_64_intdigest(h[word[i] : word[i + 1]].tobytes(), seed=int(words[i]))
    return out, out_bounds


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(row, raw, bounds)`` for successive rows of a string or binary column without nulls, about ``PIECE`` bytes each; a text is never divided."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    upto = np.frombuffer(places, "int64" if wide else "int32")[texts.offset : texts.offset + len(texts) + 1].astype("int64") if len(texts) else np.zeros(1, "int64")
    raw = np.frombuffer(data, "uint8") if data is not None else np.zeros(0, "uint8")
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + PIECE, "right")) - 1)
        yield at, raw[upto[at] : upto[to]], upto[at : to + 1] - upto[at]
        at = to
