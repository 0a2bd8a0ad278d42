"""JSON answers of a model runtime as columns; what is malformed is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAGS = "struct<models:array<struct<name:string,size:bigint,capabilities:array<string>,details:struct<embedding_length:int>>>>"
SHOW = "struct<capabilities:array<string>,model_info:map<string,string>>"
PULL = "struct<status:string,completed:bigint,total:bigint,error:string>"


def installed_models(body: Column) -> Column:
    """``array<struct<name, size, capabilities, embedding_length>>`` of the models that have a name; null without a list of models."""
    models = F.from_json(body, TAGS).models
    named = F.filter(models, lambda m: m["name"].isNotNull())
    return F.transform(named, lambda m: F.struct(m["name"].alias("name"), F.coalesce(m["size"], F.lit(0)).alias("size"), F.coalesce(m["capabilities"], F.array().cast("array<string>")).alias("capabilities"), m["details"]["embedding_length"].alias("embedding_length")))


def shown_dimension(body: Column) -> Column:
    """The dimension of a model: the value of the first key that ends in ``.embedding_length``."""
    info = F.from_json(body, SHOW).model_info
    return F.get(F.map_values(F.map_filter(info, lambda k, _: F.endswith(k, F.lit(".embedding_length")))), 0).cast("int")


def pull_progress(line: Column) -> Column:
    """``struct<status, completed, total, error>`` of a line of progress; null for a blank line or one that is no JSON, or has neither status nor error."""
    got = F.from_json(F.nullif(F.trim(line), F.lit("")), PULL)
    return F.when(got.status.isNotNull() | got.error.isNotNull(), got)
