"""Which ready draft a quoted selection belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.functions.text import quoted_sender, sender_address, squeezed

# Characters of a selection that are looked at, of a body's opening, and the fewest that count.
MOST, OPENING, LEAST = 20_000, 80, 20


def match(selections: DataFrame, drafts: DataFrame) -> DataFrame:
    """``pk, draft`` for each of ``selections`` (``pk, selection``).

    Of the ``drafts`` (``draft, sender, generated_at, body``: the message that is
    answered) whose sender the selection's first line quotes, the one with the
    longest opening of its body in the selection, of equals the newest, then the
    largest number; the newest if none has its opening there; null if no draft
    fits. Openings meet selections by their first ``LEAST`` characters at every
    place, so what is compared grows with the texts and not with selections
    times drafts.
    """
    said = selections.select("pk", quoted_sender(F.col("selection")).alias("address"), squeezed(F.substring("selection", 1, MOST)).alias("said"))
    ready = drafts.select("draft", "generated_at", sender_address(F.col("sender")).alias("address"), F.substring(squeezed(F.coalesce("body", F.lit(""))), 1, OPENING).alias("opening"))
    newest = ready.groupBy("address").agg(F.max(F.struct("generated_at", "draft")).alias("n"))
    places = F.transform(F.sequence(F.lit(1), F.length("said") - LEAST + 1), lambda i: F.substr("said", i, F.lit(OPENING)))
    pieces = said.where(F.col("address").isNotNull() & (F.length("said") >= LEAST)).select("pk", "address", F.explode(F.array_distinct(places)).alias("piece"))
    keyed = pieces.withColumn("key", F.substring("piece", 1, LEAST))
    openings = ready.where(F.length("opening") >= LEAST).withColumn("key", F.substring("opening", 1, LEAST))
    met = keyed.join(openings, ["address", "key"]).where(F.startswith("piece", F.col("opening")))
    best = met.groupBy("pk").agg(F.max(F.struct(F.length("opening").alias("overlap"), "generated_at", "draft")).alias("b"))
    rows = said.select("pk", "address").join(newest, "address", "left").join(best, "pk", "left")
    return rows.select("pk", F.coalesce("b.draft", "n.draft").alias("draft"))
