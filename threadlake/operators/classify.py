"""Rules that tell personal messages from bulk mail."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions.text import excluded, sender_address, strip_boilerplate
from threadlake.operators.providers import Generator, generated

# Local parts of senders that take no replies, and weak signs of a bulk sender.
NO_REPLY = ["noreply", "no-reply"]
WEAK_SENDERS = ["newsletter", "notifications", "digest", "updates", "bounce"]
BULK = ["bulk", "list", "junk"]
AUTOMATIC = ["auto-generated", "auto-replied"]
# The verdict and the reason of each rule, in the order in which they are tried; the last four go by the number of weak signs.
RULES = [
    ("auto_generated", "auto_submitted"), ("newsletter", "no_reply_sender"), ("newsletter", "newsletter_address"), ("newsletter", "excluded"),
    ("personal", "prior Sent correspondence with this address"), ("newsletter", "List-Unsubscribe present"), ("newsletter", "List-Id present"), ("newsletter", "Precedence: "),
    ("personal", "no newsletter signals detected"), ("ambiguous", "one weak sign"), ("ambiguous", "one weak sign"), ("newsletter", "sender local-part pattern + unsubscribe-language boilerplate"),
]
ASKED_CHARS = 1000  # of a body that a generator is shown


def starts_with_any(text: Column, words: Iterable[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.startswith(text, F.lit(w))
    return F.coalesce(hit, F.lit(False))


def verdict(sender: Column, body: Column, has_prior: Column, auto_submitted: Column, list_unsubscribe: Column, list_id: Column, precedence: Column, exclusions: Iterable[str] = ()) -> tuple[Column, Column]:
    """``(verdict, reason)``; ambiguous where only one weak sign is there (a generator may decide)."""
    address = sender_address(sender)
    local = F.split(address, "@")[0]
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    level = F.lower(F.trim(precedence))
    weak = starts_with_any(local, WEAK_SENDERS)
    shrinks = F.coalesce(F.length(strip_boilerplate(body)) < F.length(body), F.lit(False))
    tests = [
        F.coalesce(F.lower(F.btrim(auto_submitted, F.lit(" \t"))).isin(AUTOMATIC), F.lit(False)), starts_with_any(local, NO_REPLY), F.coalesce(F.contains(address, F.lit("newsletter")), F.lit(False)),
        excluded(sender, exclusions), has_prior, filled(list_unsubscribe), filled(list_id), F.coalesce(level.isin(BULK), F.lit(False)),
    ]
    # one number for the rule, so that the body is looked at once for both columns
    rule = F.lit(len(tests) + 1) + weak.cast("int") + 2 * shrinks.cast("int")
    for nth, test in reversed(list(enumerate(tests, 1))):
        rule = F.when(test, nth).otherwise(rule)
    what, why = (F.element_at(F.array(*[F.lit(r[i]) for r in RULES]), rule) for i in (0, 1))
    return what, F.concat(why, F.when(F.endswith(why, F.lit(": ")), level).otherwise(""))


def settled(rows: DataFrame, chat: Generator, id_col: str = "pk") -> DataFrame:
    """``rows`` (with ``verdict``, ``sender``, ``body_text``) whose ambiguous ones a generator decided.

    It is shown the sender and the first ``ASKED_CHARS`` characters of the body. An
    answer that holds newsletter counts as that, else one that holds personal; any
    other, and a failed call, leaves the message ambiguous. Only ambiguous rows are sent.
    """
    open_ = rows.where("verdict = 'ambiguous'")
    shown = F.concat(F.lit("From: "), F.coalesce("sender", F.lit("")), F.lit("\n\nBody:\n"), F.substring(F.coalesce("body_text", F.lit("")), 1, ASKED_CHARS))
    asked = open_.select(id_col, F.concat(F.lit("Is this mail a newsletter or personal? Answer with one of these two words.\n\n"), shown).alias("prompt"))
    said = generated(asked, chat, id_col, "prompt").select(F.col("id").alias(id_col), F.lower("answer").alias("said"))
    word = F.when(F.contains("said", F.lit("newsletter")), "newsletter").when(F.contains("said", F.lit("personal")), "personal")
    decided = open_.join(said.select(id_col, word.alias("word")), id_col, "left").withColumn("verdict", F.coalesce("word", "verdict")).drop("word")
    return rows.where("verdict is null or verdict <> 'ambiguous'").unionByName(decided.select(*rows.columns))
