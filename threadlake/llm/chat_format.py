r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all earlier turns are the
context, and only that reply is trainable. Written out, the examples of a
conversation of t turns hold on the order of t*t turns, so they are cut and
shuffled as shared prefixes: one row for each example with the *segment* that the
example adds (the turns since the last reply, then the reply) and the span of
the trainable text in it. The text of example k is the concatenation of the
segments up to k; :func:`expanded` writes that out, after the last shuffle.
Turns after the last reply form a last row without a trainable span, so nothing
of the input is lost.

Template of a turn: ``<|im_start|>role\ntext<|im_end|>\n``. In roles and texts a
backslash becomes two, and ``<|`` becomes ``<\|`` (in roles a line feed also gets
a backslash), so no control string can come from a text, and :func:`unescaped`
undoes it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|\n])", "$1")


def chat_examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, example, segment, loss_start, loss_length, prefix_chars`` (see the module).

    Offsets count code points within ``segment``; ``prefix_chars`` is the length
    of all earlier segments. Null roles and texts count as empty, a null
    conversation id is a conversation of its own, rows with equal turns are
    ordered by role and text, and an empty table gives an empty one. Columns
    beside the four are not read.
    """
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    reply = F.col("role") == "assistant"
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    body = escaped(F.col("text"))
    shown = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"), body, F.lit(END))
    placed = rows.select(
        "conv", F.row_number().over(order).alias("at"),
        (F.count_if(reply).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - reply.cast("long")).alias("example"),
        shown.alias("shown"), F.when(reply, F.length(body)).cast("long").alias("loss"),
    )
    parts = placed.groupBy("conv", "example").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "shown"))), lambda x: x.shown), "").alias("segment"),
        F.max("loss").alias("loss_length"),
    )
    before = Window.partitionBy("conv").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("segment").cast("long")
    return parts.select(
        "conv", "example", "segment",
        F.when(F.col("loss_length").isNotNull(), size - len(END) - F.col("loss_length")).alias("loss_start"), "loss_length",
        F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("prefix_chars"),
    )


def full_examples(examples: DataFrame) -> DataFrame:
    """``conv, example, context, target_turn``: each example's whole text.

    The output grows with the square of a conversation's turns, as the method
    says; use it where the training format needs it written out.
    """
    sofar = Window.partitionBy("conv").orderBy("example")
    joined = F.array_join(F.collect_list("segment").over(sofar), "")
    start = (F.col("prefix_chars") + F.col("loss_start")).cast("int")
    return examples.withColumn("whole", joined).where("loss_start is not null").select(
        "conv", "example", F.expr("substring(whole, 1, int(prefix_chars + loss_start))").alias("context"),
        F.expr("substring(whole, int(prefix_chars + loss_start) + 1, int(loss_length))").alias("target"), start.alias("target_start"),
    )


def expanded(examples: DataFrame) -> DataFrame:
    """``conv, example, text, loss_start, loss_length, last``: each example with all its context.

    ``text`` is the context, the reply and its end; the loss span counts code
    points in it. Turns after the last reply are a last row without a span, after
    all that precedes them. The shuffle moves one copy of a conversation.
    """
    parts = examples.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("example", "segment", "loss_start", "loss_length", "prefix_chars"))).alias("s"))
    ends = F.transform("s", lambda x: F.struct(
        x.example.alias("example"), (x.prefix_chars + F.length(x.segment)).alias("end"), (x.prefix_chars + x.loss_start).alias("loss_start"), x.loss_length.alias("loss_length")))
    whole = parts.select("conv", F.array_join(F.transform("s", lambda x: x.segment), "").alias("whole"), F.size("s").alias("n"), ends.alias("ends"))
    rows = whole.select("conv", "whole", "n", F.posexplode("ends").alias("at", "e"))
    return rows.select("conv", "e.example", F.substr("whole", F.lit(1), F.col("e.end").cast("int")).alias("text"), "e.loss_start", "e.loss_length", (F.col("at") == F.col("n") - 1).alias("last"))


def parsed(text: Column) -> Column:
    """The turns ``array<struct<role,text>>`` of a formatted text."""
    pieces = F.filter(F.split(text, r"<\|im_end\|>\n", -1), lambda x: F.length(x) > 0)
    header = r"(?s)^<\|im_start\|>((?:\\.|[^\\\n])*)\n(.*)$"
    return F.transform(pieces, lambda x: F.struct(
        unescaped(F.regexp_extract(x, header, 1)).alias("role"), unescaped(F.regexp_extract(x, header, 2)).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """``conv, turns array<struct<role,text>>, loss_text, formatted_chars``, parsed from the output alone."""
    whole = examples.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("example", "segment", "loss_start", "loss_length"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: x.segment), "")
    loss = F.array_join(F.transform(F.filter("s", lambda x: x.loss_start.isNotNull()), lambda x: unescaped(
        F.substr(x.segment, (x.loss_start + 1).cast("int"), x.loss_length.cast("int")))), "")
    return whole.select("conv", parsed(text).alias("turns"), loss.alias("loss_text"), F.length(text).cast("long").alias("formatted_chars"))


def read_expanded(rows: DataFrame) -> DataFrame:
    """As :func:`read_back`, from expanded examples: turns of the last one, the loss text of each from its own span."""
    loss = unescaped(F.substr("text", (F.col("loss_start") + 1).cast("int"), F.col("loss_length").cast("int")))
    cut = rows.select("conv", "example", F.when(F.col("loss_start").isNotNull(), loss).alias("loss"), F.when(F.col("last"), F.col("text")).alias("text"))
    whole = cut.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("s"), F.max("text").alias("text"))
    # array_join leaves out the null of a row without a span
    return whole.select("conv", parsed(F.col("text")).alias("turns"), F.array_join(F.transform("s", lambda x: x.loss), "").alias("loss_text"), F.length("text").cast("long").alias("formatted_chars"))
