"""From raw documents to token files in five stages.

Each stage is one operator of ``threadlake.llm`` with production parameters and
works on all that its predecessor kept; all but the last return the columns of
``documents``. Every stage is written as Parquet to the shared folder and read
again, so a lost executor costs one stage's tasks at most.

In every stage columns beside ``doc_id, text, lang, source`` may have any name and
come back as they were, repeated rows and ids are rows of their own, texts may be of
any length, and an empty table gives an empty one. What nulls, empty texts and ties
mean stands at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.common import drop_written, narrow, written
from threadlake.llm.decontaminate import contamination
from threadlake.llm.jaccard_join import jaccard_components
from threadlake.llm.quality import train, with_score
from threadlake.llm.queries import mixed, vocabulary
from threadlake.llm.token_store import read_documents, write_shards

READ = ("doc_id", "text", "lang", "source")


def kept_of(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows that ``change`` keeps, with the columns of ``docs``; those that no operator reads have private names inside."""
    names = [c if c in READ else f"kept_{i}" for i, c in enumerate(docs.columns)]
    return change(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, scores at 0.3 or more.

    A null text is scored as an empty one; null ids and labels are not learned
    from, and an id with several labels counts as 1 if any is. Equal texts have
    equal scores, so copies share their fate.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return kept_of(docs, lambda rows: with_score(rows, model, score_col="score").where("score >= 0.3"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at five words and 0.8 the one with the smallest id.

    Rows are linked by numbers of their own, so rows that share an id stay if
    their texts differ. Null ids go after all others; among rows of equal ids any
    one of the group stays. Null and empty texts link with nothing and stay.
    """

    def change(plain: DataFrame) -> DataFrame:
        # a row's number is its id, or one above all ids where it has none or shares it
        own = F.col("doc_id").cast("long")
        shared = written(plain.where(own.isNotNull()).groupBy(own.alias("row")).agg(F.count("*").alias("n")).where("n > 1").select("row"))
        most = plain.agg(F.greatest(F.max(own), F.lit(0))).first()[0] or 0
        marked = plain.withColumn("row", own).join(narrow(shared.withColumn("met", F.lit(True)), 24), "row", "left")
        number = F.when(own.isNull() | F.col("met"), F.lit(most + 1) + F.monotonically_increasing_id()).otherwise(own)
        rows = written(marked.withColumn("row", number).drop("met"))
        groups = jaccard_components(rows.select("row", "text"), id_col="row", k=5, percent=80)
        named = groups.select(F.col("id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
        first = written(named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")).select("row"))
        return rows.join(narrow(first, 24), "row", "left_semi")

    return kept_of(docs, change)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold no passage and stay; null and blank items match
    nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return kept_of(docs, lambda rows: contamination(rows, items).where(F.size("hits") == 0))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities; see ``threadlake.llm.queries.mixed``.

    A null source or language is a value of its own, a null text counts as empty
    (one token), and the draw depends on the id alone: rows that share an id, or
    have none, stay or go together.
    """
    return kept_of(docs, mixed)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the sampled documents, and from them a row ``doc_id, start, n_tokens, ids_crc32`` for each.

    Null texts count as empty and have the end id alone; documents go by id, null
    ids first, and rows of equal ids by their text.
    """
    return read_documents(write_shards(docs, vocabulary())).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mixture", mixture), ("tokens", tokens)]

#: No SQL: gradient-boosted trees, the walk's LSH and the tokenizer have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for nth, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir))
        if nth:
            drop_written(before)  # the stage's own input, which no later one reads
    return docs
