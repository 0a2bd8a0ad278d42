"""Interfaces to models: whoever has one passes a function; nothing here knows any service.

An embedder takes a list of texts and gives a list of vectors, a generator takes
a list of prompts and gives a list of answers. Both have to be importable by the
workers. A call gets at most ``batch`` texts, so that a model's memory is bounded
by that number and not by a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
Generator = Callable[[list[str]], Sequence[str]]

# Fixed value: chunks that are embedded together.
BATCH = 16


class ProviderDown(RuntimeError):
    """Raised by a provider that cannot work at all (model missing, unreachable): the job stops instead of failing row by row."""


def letter_embedder(texts: list[str], size: int = 32) -> list[list[float]]:
    """A deterministic stand-in: how often each residue of code points occurs, at unit length."""
    out = []
    for t in texts:
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        v = np.bincount(points % size, minlength=size).astype(float).tolist()
        norm = sum(x * x for x in v) ** 0.5
        out.append([x / norm for x in v] if norm else v)
    return out


def run_batches(rows: DataFrame, call: Callable[[list[str]], Sequence], kind: pa.DataType, spark_kind: str, id_col: str, text_col: str, name: str, batch: int, strikes: int) -> DataFrame:
    id_kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        down = 0
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = part.column(1).to_pylist()
                found, errors = [None] * len(texts), [None] * len(texts)
                try:
                    found = list(call(texts))
                    down = 0
                except ProviderDown:
                    raise
                except ConnectionError as e:
                    down += 1
                    if down >= strikes:
                        raise ProviderDown(f"{strikes} calls in a row failed: {e}") from e
                    errors = [str(e)] * len(texts)
                except Exception as e:  # these rows are dead letters
                    errors = [str(e) or type(e).__name__] * len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind), pa.array(errors, pa.string())], names=["id", name, "error"])

    return rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {id_kind}, {name} {spark_kind}, error string")


def embedded(chunks: DataFrame, embed: Embedder = letter_embedder, id_col: str = "chunk_id", text_col: str = "text", batch: int = BATCH, strikes: int = 3) -> DataFrame:
    """``id, vec, error``: a vector for each chunk; rows of a call that fails have its error, and ``strikes`` lost connections in a row end the job."""
    return run_batches(chunks, embed, pa.list_(pa.float64()), "array<double>", id_col, text_col, "vec", batch, strikes)


def generated(prompts: DataFrame, chat: Generator, id_col: str = "qid", prompt_col: str = "prompt", batch: int = 1, strikes: int = 3) -> DataFrame:
    """``id, answer, error`` for each prompt."""
    return run_batches(prompts, chat, pa.string(), "string", id_col, prompt_col, "answer", batch, strikes)
