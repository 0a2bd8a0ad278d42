"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Named by spark.checkpoint.dir; a temporary folder only where a session names none and is one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="threadlake-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def sized(df: DataFrame, row_bytes: int, most: int = 48 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its rows, which are counted, fit into ``most`` bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read again."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.threadlake_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.threadlake_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
