"""Overlapping chunks of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

SIZE, OVERLAP = 2048, 256


def boundary(text: str, start: int, hard: int, size: int) -> int:
    """Where a chunk from ``start`` ends: after the last paragraph break, line feed or sentence in its second half."""
    floor = start + size // 2
    at = text.rfind("\n\n", floor + 1, hard)
    if at >= 0:
        return at + 2
    at = text.rfind("\n", floor + 1, hard)
    if at >= 0:
        return at + 1
    at = hard
    while (at := text.rfind(" ", floor + 1, at)) >= 0:
        if text[at - 1] in ".!?":
            return at + 1
    return hard


def characters(text: str) -> list[str] | None:
    """The text as what a reader takes for characters (grapheme clusters), or None where those are its code points."""
    if text.isascii() and "\r\n" not in text:
        return None
    found = regex.findall(r"\X", text)
    return found if len(found) < len(text) else None


def chunks_of(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Trimmed pieces of at most ``size`` characters, none of them divided; each starts ``overlap`` before the last one's end."""
    size = max(64, size)
    overlap = max(0, min(overlap, size // 2))
    whole = (text or "").strip()
    if len(whole) <= size:
        return [whole] if whole else []
    units = characters(whole)
    # one sign for each character; those of several code points are neither blanks nor stops
    text = whole if units is None else "".join(u if len(u) == 1 else "\0" for u in units)
    if len(text) <= size:
        return [whole]
    cut = text.__getitem__ if units is None else lambda at: "".join(units[at])
    out, start = [], 0
    while True:
        hard = min(start + size, len(text))
        end = hard if hard == len(text) else boundary(text, start, hard, size)
        piece = cut(slice(start, end)).strip()
        if piece:
            out.append(piece)
        if end >= len(text):
            return out
        start = max(end - overlap, start + 1)


def chunk(docs: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``key, ordinal, text``: a row for each chunk, in Arrow batches. Where a chunk ends depends on the one before, so this is Python."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [chunks_of(t, size, overlap) for t in batch.column(1).to_pylist()]
            row = [i for i, p in enumerate(pieces) for _ in p]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), pa.array([n for p in pieces for n in range(len(p))], pa.int32()), pa.array([x for p in pieces for x in p], pa.string())],
                names=[key, "ordinal", "text"])

    kind = docs.schema[key]
    schema = StructType([StructField(key, kind.dataType), StructField("ordinal", IntegerType()), StructField("text", StringType())])
    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, schema)


def register(spark: SparkSession, name: str = "chunks") -> None:
    """The chunker as a table function of SQL: ``SELECT ... FROM t, LATERAL chunks(t.text)`` with the columns ``ordinal, text``."""
    spark.udtf.register(name, udtf(Chunks, returnType="ordinal int, text string", useArrow=True))


class Chunks:
    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(chunks_of(text))
