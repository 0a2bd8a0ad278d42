"""Context assembly: budget, citation numbers, blocks, sessions, rendered answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlake.functions.text import date_text, message_url, token_estimate
from threadlake.operators.threads import last_messages

# The texts around chunks, turns and questions.
NO_MATCH = "No matching emails found. Try different terms or a wider date range."
SESSION, CONTEXT, QUESTION, THREAD = "Earlier in this conversation:", "CONTEXT:", "QUESTION:", "THREAD (oldest first):"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


def attributed(sender: Column, original: Column) -> Column:
    return F.coalesce(original, sender)


def unit_text(number: Column) -> Column:
    """A chunk with its heading line, for the context block."""
    forwarded = F.when(F.col("original_sender").isNotNull(), F.concat(F.lit(" (forwarded by "), F.col("sender"), F.lit(")"))).otherwise("")
    n = number.cast("string")
    return F.concat(
        F.lit("--- ["), n, F.lit("] from: "), attributed(F.col("sender"), F.col("original_sender")), forwarded, F.lit(" | date: "), date_text(F.col("date_unix")), F.lit(" | source: "), F.col("source"),
        F.lit(" ---\nBEGIN EMAIL ["), n, F.lit("]\n"), F.col("text"), F.lit("\nEND EMAIL ["), n, F.lit("]"))


def budget_trim(ranked: DataFrame, limit: int) -> DataFrame:
    """The prefix of each question's chunks whose running token cost stays in ``limit``; the first always stays."""
    order = Window.partitionBy("qid").orderBy("rank")
    cost = token_estimate(unit_text(F.lit(99)))
    running = ranked.withColumn("running", F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("at", F.row_number().over(order))
    return running.where((F.col("running") <= limit) | (F.col("at") == 1)).drop("at")


def citation_numbers(ranked: DataFrame) -> DataFrame:
    """``number``: messages counted in the order of their first chunk."""
    whole = Window.partitionBy("qid", "message_id")
    first = ranked.withColumn("first", F.min("rank").over(whole))
    return first.withColumn("number", F.dense_rank().over(Window.partitionBy("qid").orderBy("first"))).drop("first")


def best_chunks(ranked: DataFrame) -> DataFrame:
    """Of each message the chunk of best rank."""
    others = [c for c in ranked.columns if c not in ("qid", "message_id")]
    return ranked.groupBy("qid", "message_id").agg(F.min_by(F.struct(*others), "rank").alias("row")).select("qid", "message_id", "row.*")


def context_block(numbered: DataFrame) -> DataFrame:
    """``qid, context``: the rendered chunks in rank order, a blank line between."""
    rows = numbered.select("qid", F.struct("rank", unit_text(F.col("number")).alias("shown")).alias("r"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r.shown), "\n\n").alias("context"))


def session_block(turns: DataFrame, last: int = 3) -> DataFrame:
    """``sid, session``: the last turns, oldest first."""
    order = Window.partitionBy("sid").orderBy(F.col("turn").desc())
    kept = turns.withColumn("back", F.row_number().over(order)).where(F.col("back") <= last)
    shown = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", shown.alias("shown")))), lambda r: r.shown), "\n")
    return kept.groupBy("sid").agg(F.concat(F.lit(SESSION + "\n"), lines).alias("session"))


def assemble(questions: DataFrame, contexts: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """``qid, prompt``: session (if any), context and question; the fixed notice where nothing was found."""
    rows = questions.join(contexts, "qid", "left")
    head = F.lit("")
    if sessions is not None:
        rows = rows.join(sessions.withColumnRenamed("sid", "qid"), "qid", "left")
        head = F.coalesce(F.concat(F.col("session"), F.lit("\n\n")), F.lit(""))
    full = F.concat(head, F.lit(CONTEXT + "\n"), F.col("context"), F.lit("\n\n" + QUESTION + "\n"), F.col("question"))
    return rows.select("qid", F.coalesce(full, F.lit(NO_MATCH)).alias("prompt"), F.col("context").isNotNull().alias("matched"))


# The style block's heading, and how many grounding chunks a draft gets.
STYLE, GROUNDING = "STYLE GUIDANCE (how this user writes; match their tone and register):", 6


def draft_system(system: str, style: Column) -> Column:
    """The system prompt with the style block, if there is one."""
    return F.when(F.coalesce(style, F.lit("")) != "", F.concat(F.lit(f"{system}\n\n{STYLE}\n"), style)).otherwise(F.lit(system))


def draft(messages: DataFrame, account: str = "", most: int = 20, grounding: DataFrame | None = None) -> DataFrame:
    """``thread_id, prompt``: the last messages of each thread, then grounding, then what to reply to.

    ``grounding`` has ``thread_id, rank, sender, date_unix, text``; the best
    ``GROUNDING`` chunks of a thread are shown.
    """
    shown = F.concat(F.lit("--- "), F.col("sender"), F.lit(" | "), date_text(F.col("date_unix")), F.lit(" ---\n"), F.col("text"))
    rows = last_messages(messages, most).groupBy("thread_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", shown.alias("shown")))), lambda r: r.shown), "\n\n").alias("block"),
        F.max_by(F.struct("sender", date_text(F.col("date_unix")).alias("day")), "position").alias("last"))
    sender, day = F.col("last.sender"), F.col("last.day")
    # The instruction with and without the account's own address.
    if account:
        ask = F.concat(
            F.lit(f"You are drafting this reply as {account} \u2014 the person who RECEIVED the message below, not its sender, regardless of any name or greeting used inside the message body. Draft a reply to the most recent message above, sent by "),
            sender, F.lit(" on "), day, F.lit(". Address the reply to "), sender, F.lit(f"; never address it to {account}."))
    else:
        ask = F.concat(F.lit("Draft a reply to the most recent message above, from "), sender, F.lit(", dated "), day, F.lit("."))
    context = F.lit("")
    if grounding is not None:
        best = grounding.withColumn("nth", F.row_number().over(Window.partitionBy("thread_id").orderBy("rank"))).where(F.col("nth") <= GROUNDING)
        unit = F.concat(F.lit("--- from: "), F.col("sender"), F.lit(" | date: "), date_text(F.col("date_unix")), F.lit(" ---\n"), F.col("text"))
        blocks = best.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", unit.alias("shown")))), lambda r: r.shown), "\n\n").alias("ground"))
        rows = rows.join(blocks, "thread_id", "left")
        context = F.coalesce(F.concat(F.lit(CONTEXT + "\n"), F.col("ground"), F.lit("\n\n")), F.lit(""))
    return rows.select("thread_id", F.concat(F.lit(THREAD + "\n"), F.col("block"), F.lit("\n\n"), context, ask).alias("prompt"))


def drop_counts(fused: DataFrame, ranked: DataFrame, kept: DataFrame, floor: float, top_k: int) -> DataFrame:
    """``qid, by_floor, by_top_k, by_budget``: how many hits of a question each step left out.

    ``fused`` are all hits, ``ranked`` those of :func:`budget_trim`'s input and ``kept`` its output.
    """
    above = F.col("score") > floor
    first = fused.groupBy("qid").agg(F.count_if(~above).alias("by_floor"), F.count_if(above & (F.col("rank") > top_k)).alias("by_top_k"))
    counts = ranked.groupBy("qid").agg(F.count("*").alias("n")).join(kept.groupBy("qid").agg(F.count("*").alias("k")), "qid", "left")
    return first.join(counts, "qid", "left").select("qid", "by_floor", "by_top_k", (F.coalesce("n", F.lit(0)) - F.coalesce("k", F.lit(0))).alias("by_budget"))


def relevance_percent(scored: DataFrame) -> DataFrame:
    top = F.max("score").over(Window.partitionBy("qid"))
    return scored.withColumn("percent", F.when(F.col("score").isNotNull() & (top > 0), F.floor(F.col("score") / top * 100 + 0.5).cast("long")))


def source_line() -> Column:
    from threadlake.functions.text import sender_domain

    flat = F.trim(F.regexp_replace(F.col("text"), r"\s+", " "))
    return F.concat(F.col("number").cast("string"), F.lit("  "), sender_domain(attributed(F.col("sender"), F.col("original_sender"))), F.lit(" ("), date_text(F.col("date_unix")), F.lit("): "), F.col("subject"), F.lit("\n"), F.lit('"'), flat, F.lit('"'))


MARKER = r" ?\[\d+(?:\s*,\s*\d+)*\]"


def numbers_of(markers: Column) -> Column:
    """The numbers in an array of markers, in order."""
    digits = F.transform(markers, lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("long")))
    return F.flatten(digits)


def rendered(answer: Column, known: Column) -> Column:
    """``struct<text, cited, lost>``: markers ``[n]`` or ``[n, m]`` as superscripts renumbered by first use.

    ``known`` are the numbers that have a source. A marker takes the blank before
    it along; of its numbers the known ones are shown once each, with a thin space
    between, and the others are dropped and listed in ``lost``. A null answer is null.
    """
    markers = F.regexp_extract_all(answer, F.lit(MARKER), F.lit(0))
    every = F.array_distinct(numbers_of(markers))
    order = F.filter(every, lambda n: F.array_contains(known, n))

    def shown(marker: Column) -> Column:
        own = F.filter(F.array_distinct(numbers_of(F.array(marker))), lambda n: F.array_contains(known, n))
        return F.array_join(F.transform(own, lambda n: F.translate(F.array_position(order, n).cast("string"), "0123456789", SUPERSCRIPTS)), "\u2009")

    between = F.split(answer, MARKER, -1)
    text = F.array_join(F.zip_with(between, F.transform(markers, shown), lambda x, m: F.concat(x, F.coalesce(m, F.lit("")))), "")
    return F.when(answer.isNotNull(), F.struct(text.alias("text"), order.alias("cited"), F.filter(every, lambda n: ~F.array_contains(known, n)).alias("lost")))


def cited(answers: DataFrame) -> DataFrame:
    """``qid, n, new_n``: the numbers cited in ``answer``, renumbered by first appearance."""
    groups = F.regexp_extract_all("answer", F.lit(r"\[\d+(?:\s*,\s*\d+)*\]"), F.lit(0))
    digits = F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"\d+"), F.lit(0))))
    rows = answers.select("qid", F.posexplode(digits)).groupBy("qid", F.col("col").cast("long").alias("n")).agg(F.min("pos").alias("first"))
    return rows.select("qid", "n", F.row_number().over(Window.partitionBy("qid").orderBy("first")).alias("new_n"))


__all__ = ["assemble", "attributed", "best_chunks", "budget_trim", "citation_numbers", "cited", "context_block", "draft", "message_url", "relevance_percent", "rendered", "session_block", "source_line", "unit_text"]
