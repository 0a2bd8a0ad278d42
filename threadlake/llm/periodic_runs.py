"""Runs of words that repeat with a period, by heavy/light lag counting.

For each lag q the number of places is counted at which a text's word equals the
word q places on. Words that are rare in their text contribute the differences of
their places, pair by pair; for a frequent word, whose pairs would grow with the
square of its count, the autocorrelation of its indicator is taken by FFT, which is
exact after rounding. A run of period q and length L has L - q such places in a row,
so only lags with enough of them are looked at again: their islands, stretches of
matching places in a row, are the runs.

A lag's scan first looks at a few places of each block that an island of the least
size has to contain. That costs about n / q for lag q, so all lags of a text together
cost n log n unless they hold islands; blocks inside a run already found whose period
divides the lag are left out, since they can only lead to that run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import lean

CHUNK = 1 << 18  # words of several texts that are counted together
SECTION = 1 << 19  # places transformed at once; longer texts are correlated by sections


def least(lag: np.ndarray | int, min_length: int, min_periods: int) -> np.ndarray | int:
    """Matching places in a row that a run of that period has at least."""
    return np.maximum(min_length - lag, (min_periods - 1) * lag)


def correlated(places: list[np.ndarray], n: int, top: int) -> np.ndarray:
    """For lags 0 to ``top`` the pairs of equal places that are so far apart, summed over words, by FFT."""
    out = np.zeros(top + 1, "int64")
    width = SECTION if n > SECTION else n
    sections = -(-n // width)
    size = 1 << int(np.ceil(np.log2(2 * width)))

    def spectrum(at: np.ndarray, nth: int) -> np.ndarray:
        lo, hi = np.searchsorted(at, (nth * width, (nth + 1) * width))
        signal = np.zeros(size)
        signal[at[lo:hi] - nth * width] = 1
        return np.fft.rfft(signal)

    for apart in range(min(sections, top // width + 2)):
        power = np.zeros(size // 2 + 1, "complex128")
        for at in places:
            for nth in range(sections - apart):
                one = spectrum(at, nth)
                power += np.conj(one) * (one if apart == 0 else spectrum(at, nth + apart))
        found = np.rint(np.fft.irfft(power, size)).astype("int64")
        lags = np.arange(-width + 1, width) + apart * width
        use = (lags >= (1 if apart == 0 else 0)) & (lags <= top)
        np.add.at(out, lags[use], found[np.arange(-width + 1, width)[use]])
    return out


def lag_counts(words: np.ndarray, bounds: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matching places of each text ``words[bounds[i]:bounds[i+1]]`` at lags 1 to ``top[i]``; those of text i begin at the second array's i-th value."""
    first = np.concatenate(([0], np.cumsum(top + 1)))
    counts = np.zeros(int(first[-1]), "int64")
    text = np.repeat(np.arange(len(top)), np.diff(bounds))
    order = np.lexsort((words, text))
    word, text = words[order], text[order]
    new = np.ones(len(order), bool)
    new[1:] = (word[1:] != word[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    often = np.diff(np.append(start, len(order)))
    n = np.diff(bounds)[text[start]]
    heavy = often.astype("float64") ** 2 > 16.0 * n * np.log2(n + 2)
    for i in np.unique(text[start][heavy]):
        mine = np.flatnonzero(heavy & (text[start] == i))
        places = [np.sort(order[start[k] : start[k] + often[k]]) - bounds[i] for k in mine]
        counts[first[i] : first[i + 1]] += correlated(places, int(bounds[i + 1] - bounds[i]), int(top[i]))
    group = np.cumsum(new) - 1
    end = np.append(start[1:], len(order))[group]  # of each place's word
    at = np.flatnonzero(~heavy[group])
    step = 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        lag = order[at + step] - order[at]  # the sort is stable, so places of a word ascend
        near = lag <= top[text[at]]
        at, lag = at[near], lag[near]  # farther places of the word are farther off still
        np.add.at(counts, first[text[at]] + lag, 1)
        step += 1
    return counts, first


def islands(words: np.ndarray, lag: int, size: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal stretches ``[start, end)`` of at least ``size`` places with ``words[i] == words[i + lag]``, but for those inside ``known``."""
    places = len(words) - lag
    block = max(1, size // 2)  # every island of that size holds a whole block
    begin = np.arange(0, places - block + 1, block)
    for a, b in known:
        begin = begin[(begin < a) | (begin + block > b)]
    for probe in sorted({0, block - 1, block // 2, block // 3}):
        begin = begin[words[begin + probe] == words[begin + probe + lag]]
        if not len(begin):
            return []
    out = []
    done = -1
    for at in begin.tolist():
        if at < done or not np.array_equal(words[at : at + block], words[at + lag : at + lag + block]):
            continue
        a, b = at, at + block
        b += reach(words, b, b + lag, 1)
        a -= reach(words, a - 1, a + lag - 1, -1)
        done = b
        if b - a >= size:
            out.append((a, b))
    return out


def reach(words: np.ndarray, i: int, j: int, way: int) -> int:
    """How many places from i and j on, upwards or downwards, are equal."""
    most = len(words) - j if way > 0 else i + 1
    done, span = 0, 64
    while done < most:
        span = min(span, most - done)
        if way > 0:
            differ = np.flatnonzero(words[i + done : i + done + span] != words[j + done : j + done + span])
        else:
            differ = np.flatnonzero(words[i - done - span + 1 : i - done + 1][::-1] != words[j - done - span + 1 : j - done + 1][::-1])
        if len(differ):
            return done + int(differ[0])
        done += span
        span *= 4
    return most


def runs_of_text(words: np.ndarray, counts: np.ndarray, min_length: int, min_periods: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of one text, whose lag counts are given, by start, then period."""
    lags = np.arange(1, len(counts))
    lags = lags[counts[1:] >= least(lags, min_length, min_periods)]
    found: list[tuple[int, int, int]] = []
    for lag in lags.tolist():
        known = [(s, s + length - lag) for s, length, period in found if lag % period == 0 and length > lag]
        for a, b in islands(words, lag, int(least(lag, min_length, min_periods)), known):
            # a smaller period of an island's stretch divides the lag, and the run of that period is the same stretch
            if not any(s == a and s + length == b + lag for s, length, period in found if lag % period == 0):
                found.append((a, b + lag - a, lag))
    return sorted((s, length, period) for s, length, period in found)


def texts_and_runs(texts: list[bytes], min_length: int, min_periods: int) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text and its runs."""
    pending: list[list[bytes]] = []
    held = 0

    def settled() -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
        code: dict[bytes, int] = {}
        words = np.fromiter((code.setdefault(w, len(code)) for some in pending for w in some), "int64", held)
        bounds = np.concatenate(([0], np.cumsum([len(some) for some in pending]))).astype("int64")
        n = np.diff(bounds)
        top = np.where(n >= min_length, n // min_periods, 0)
        counts, first = lag_counts(words, bounds, top)
        for i, some in enumerate(pending):
            mine = counts[first[i] : first[i + 1]]
            yield some, runs_of_text(words[bounds[i] : bounds[i + 1]], mine, min_length, min_periods)

    for text in texts:
        pending.append(text.split())  # bytes.split() parts at \x20 and \x09-\x0D
        held += len(pending[-1])
        if held >= CHUNK:
            yield from settled()
            pending, held = [], 0
    if pending:
        yield from settled()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those after the first period of a run, joined by one space."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, "int64")
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    stay = np.cumsum(edge[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(stay)])


RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_periods: int = 3) -> DataFrame:
    """``id, n_words, runs, collapsed`` for every row of ``docs``.

    ``runs`` are ``(start, length, period)`` by start, then period, in words
    numbered from 0: stretches whose smallest period is ``period``, of at least
    ``min_length`` words and ``min_periods`` periods, which no neighbouring word
    extends. ``collapsed`` is the text without the words after each run's first
    period, joined by single spaces. Null and blank texts have no words, no runs
    and an empty ``collapsed``; texts shorter than ``min_length`` words have no
    runs. Rows are judged one by one, so ids may be null or repeat; an empty table
    gives an empty one; other columns are not read. A text of any length is
    treated whole: counting needs about 100 bytes a word, and the transform's
    memory is bounded by ``SECTION``.
    """
    if min_periods < 2 or min_length < 2:
        raise ValueError("a run has at least two periods and two words")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            n, runs, rest = [], [], []
            for words, found in texts_and_runs(batch.column("raw").to_pylist(), min_length, min_periods):
                n.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                rest.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(runs, shape), pa.array(rest, pa.binary())], names=["id", "n_words", "runs", "collapsed"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lean(scan), f"id {kind}, n_words long, runs {RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
