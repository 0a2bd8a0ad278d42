"""Settings of a question, read once for each call from a key/value table."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.merge import latest


@dataclass(frozen=True)
class Settings:
    top_k: int = 8
    relevance_floor: float = 0.0
    context_tokens: int = 6000
    answer_tokens: int = 800
    temperature: float = 0.2
    system_prompt: str = ""
    account: str = ""
    chat_model: str = ""


def snapshot(pairs: DataFrame) -> Settings:
    """The settings that ``pairs`` (``k, v, updated_at``) hold, the last write of each key; unknown keys and unreadable values are left out."""
    names = {f.name: type(f.default) for f in fields(Settings)}
    found = {}
    # as many rows as there are settings
    for r in latest(pairs.where(F.col("k").isin(list(names))), ["k"], ["updated_at"]).collect():
        try:
            found[r.k] = names[r.k](r.v)
        except (TypeError, ValueError):
            continue
    return Settings(**found)
