"""Registration of queries, and the tables that stand in for a mail corpus."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.functions.text import epoch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
START = 1704067200


def query(sql: str | None = None) -> Callable:
    """Register a function of :class:`Tables` under its name, with the SQL that says the same."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def messages(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("pk"), F.concat(F.lit("doc-"), F.col("doc_id")).alias("message_id"), F.col("lang").alias("account"),
            F.concat(F.lit("Note "), F.col("doc_id")).alias("subject"), F.concat(F.lit("User "), F.col("source"), F.lit(" <"), F.col("source"), F.lit("@mail"), F.col("doc_id") % 10, F.lit(".example.com>")).alias("sender"),
            F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("orig"), F.col("doc_id") % 5, F.lit("@fwd.example.org"))).alias("original_sender"),
            (F.lit(START) + F.col("doc_id") * 3600).alias("date_unix"), F.col("text").alias("body_text"))

    @cached_property
    def linked(self) -> DataFrame:
        """Messages with references: a reply to half the number, references to a third and to the next."""
        n = F.col("doc_id")
        ref = lambda c: F.concat(F.lit("doc-"), c.cast("long"))
        return self.documents.select(
            n.alias("pk"), ref(n).alias("message_id"), F.when((n % 4 != 0) & (n % 7 != 3), ref(F.floor(n / 2))).alias("in_reply_to"),
            F.when(n % 5 == 0, F.array(ref(F.floor(n / 3)), ref(n + 1))).otherwise(F.array().cast("array<string>")).alias("references"), n.alias("arrival"))

    @cached_property
    def threads(self) -> DataFrame:
        return self.conversations.select(
            F.concat(F.lit("t"), F.col("conv_id")).alias("thread_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pk"), "conv_id", "turn", "role",
            F.concat(F.initcap("role"), F.lit(" <"), F.col("role"), F.lit("@h"), F.col("conv_id") % 7, F.lit(".example.net>")).alias("sender"),
            (F.lit(START) + F.col("conv_id") * 86400 + F.col("turn") * 60).alias("date_unix"), "text")

    @cached_property
    def jobs(self) -> DataFrame:
        n = F.col("event_id")
        states = F.array(*[F.lit(s) for s in ("pending", "classifying", "newsletter_skipped", "auto_generated", "eligible", "drafting", "drafted", "failed")])
        return self.events.select(
            n.alias("source_id"), F.concat(F.lit("m"), F.col("user_id")).alias("message_id"), F.element_at(states, (n % 8 + 1).cast("int")).alias("state"),
            (F.floor(n / 8) % 7).alias("attempts"), epoch(F.col("ts")).alias("detected_at"), (epoch(F.col("ts")) + (n % 977)).alias("updated_at"))

    @cached_property
    def drafts(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "ready").when(F.col("o_orderstatus") == "F", "sent").otherwise("dismissed")
        return self.orders.select(
            F.col("o_orderkey").alias("pk"), F.concat(F.lit("t"), F.col("o_custkey")).alias("thread_id"), F.concat(F.lit("c"), F.col("o_custkey"), F.lit("@shop"), F.col("o_custkey") % 3, F.lit(".example.com")).alias("sender"),
            epoch(F.col("o_orderdate")).alias("generated_at"), status.alias("status"), F.when(F.col("o_orderkey") % 3 == 0, epoch(F.col("o_orderdate")) + 9).alias("style_learned_at"))

    @cached_property
    def questions(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"), "text")


# The same tables as SQL.
MESSAGES = f"""(SELECT doc_id AS pk, 'doc-' || doc_id AS message_id, lang AS account, 'Note ' || doc_id AS subject,
 'User ' || source || ' <' || source || '@mail' || doc_id % 10 || '.example.com>' AS sender,
 CASE WHEN doc_id % 9 = 0 THEN 'orig' || doc_id % 5 || '@fwd.example.org' END AS original_sender, {START} + doc_id * 3600 AS date_unix, text AS body_text FROM documents)"""
LINKED = """(SELECT doc_id AS pk, 'doc-' || doc_id AS message_id, CASE WHEN doc_id % 4 <> 0 AND doc_id % 7 <> 3 THEN 'doc-' || doc_id // 2 END AS in_reply_to,
 CASE WHEN doc_id % 5 = 0 THEN ['doc-' || doc_id // 3, 'doc-' || (doc_id + 1)] ELSE []::VARCHAR[] END AS refs FROM documents)"""
THREADS = f"""(SELECT 't' || conv_id AS thread_id, conv_id * 1000 + turn AS pk, conv_id, turn, role,
 upper(role[1]) || role[2:] || ' <' || role || '@h' || conv_id % 7 || '.example.net>' AS sender, {START} + conv_id * 86400 + turn * 60 AS date_unix, text FROM conversations)"""
JOBS = """(SELECT event_id AS source_id, 'm' || user_id AS message_id,
 ['pending','classifying','newsletter_skipped','auto_generated','eligible','drafting','drafted','failed'][event_id % 8 + 1] AS state,
 event_id // 8 % 7 AS attempts, (epoch_us(ts) // 1000000) AS detected_at, (epoch_us(ts) // 1000000) + event_id % 977 AS updated_at FROM events)"""
DRAFTS = """(SELECT o_orderkey AS pk, 't' || o_custkey AS thread_id, 'c' || o_custkey || '@shop' || o_custkey % 3 || '.example.com' AS sender,
 (epoch_us(o_orderdate) // 1000000) AS generated_at, CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'F' THEN 'sent' ELSE 'dismissed' END AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN (epoch_us(o_orderdate) // 1000000) + 9 END AS style_learned_at FROM orders)"""
QUESTIONS = "(SELECT item_id AS qid, text AS question, text FROM benchmark)"
