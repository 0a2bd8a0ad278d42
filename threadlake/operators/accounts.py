"""Mail accounts: which folders are accounts, how they are called, whether they can be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What reading the mail root can come to.
OK, DENIED, MISSING = "ok", "denied", "notFound"


def discover(folders: DataFrame, known: DataFrame) -> DataFrame:
    """``id, email, name, label, storage_key, position`` of the accounts below a mail root.

    ``folders`` has ``id, has_messages``, ``known`` has ``id, name, username`` (a
    username without an at sign is no address). Folders without an address and
    without messages are left out, and so is the index folder. Accounts are
    ordered by label, whatever its case, then by id.
    """
    email = F.when(F.contains("username", F.lit("@")), F.col("username")).otherwise("")
    meta = known.select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce(email, F.lit("")).alias("email"))
    rows = folders.where(F.col("id") != "MailData").join(meta, "id", "left").withColumns({"email": F.coalesce("email", F.lit("")), "name": F.coalesce("name", F.lit(""))})
    rows = rows.where((F.col("email") != "") | F.col("has_messages"))
    key = F.coalesce(F.nullif("email", F.lit("")), F.col("id"))
    label = F.coalesce(F.nullif("email", F.lit("")), F.nullif("name", F.lit("")), F.col("id"))
    return rows.select("id", "email", "name", label.alias("label"), key.alias("storage_key")).orderBy(F.lower("label"), "id")


def access_status(spark: SparkSession, root: str) -> str:
    """``ok``, ``denied`` or ``notFound`` for a mail root in any file system that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    try:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    except Exception as e:
        said = str(e)
        return DENIED if "AccessControl" in said or "Permission denied" in said or "AccessDenied" in said else MISSING
    return OK
