"""Assertions on generated answers: what they must and must not hold, their language, whether they decline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.functions.text import terms

# Frequent words that tell the languages apart, and phrases that decline to answer.
LANGUAGE_WORDS = {"en": ["the", "and", "is", "of", "to", "in", "was", "for"], "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "von"]}
DECLINING = ["not mentioned", "no information", "does not say", "could not find", "cannot find", "nicht erwähnt", "keine information", "keine angabe", "nicht gefunden"]


def language(text: Column) -> Column:
    """The language most of whose frequent words occur; null without one, or in a tie."""
    words = terms(text)
    count = lambda ws: F.size(F.filter(words, lambda w: w.isin(ws)))
    n = {k: count(ws) for k, ws in LANGUAGE_WORDS.items()}
    return F.when(n["en"] > n["de"], "en").when(n["de"] > n["en"], "de")


def declines(text: Column) -> Column:
    low, hit = F.lower(text), F.lit(False)
    for phrase in DECLINING:
        hit = hit | F.contains(low, F.lit(phrase))
    return hit


def assertions(answers: DataFrame) -> DataFrame:
    """``qid, has_all, has_none, no_match, right_language, right_refusal, passed``.

    ``answers`` has ``qid, answer`` and the expectations ``contains``,
    ``not_contains``, ``not_matches`` (arrays of strings, null: nothing is
    expected), ``lang`` (null: any) and ``refusal`` (null: either).
    """
    each = lambda name, test: F.forall(F.coalesce(name, F.array().cast("array<string>")), test)
    answer = F.col("answer")
    tests = {
        "has_all": each("contains", lambda w: F.contains(answer, w)), "has_none": each("not_contains", lambda w: ~F.contains(answer, w)),
        "no_match": each("not_matches", lambda r: ~F.regexp_like(answer, r)),
        "right_language": F.col("lang").isNull() | F.coalesce(language(answer) == F.col("lang"), F.lit(False)),
        "right_refusal": F.col("refusal").isNull() | (declines(answer) == F.col("refusal")),
    }
    passed = F.lit(True)
    for test in tests.values():
        passed = passed & test
    return answers.select("qid", *[v.alias(k) for k, v in tests.items()], passed.alias("passed"))
