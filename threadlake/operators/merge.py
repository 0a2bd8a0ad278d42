"""Changes to keyed tables, as plans that yield the table's next version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; pre-aggregated before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    found = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row"))
    return found.select(*key, "row.*").select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, key: str, keep_when_null: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """``table`` with ``changes`` (one row for each key) written over it.

    Columns in ``keep`` never change on existing rows (generated keys); those in
    ``keep_when_null`` change only to values.
    """
    both = table.select(key, F.struct(*table.columns).alias("old")).join(changes.select(key, F.struct(*changes.columns).alias("new")), key, "full_outer")
    out = []
    for c in table.columns:
        old, new = F.col(f"old.{c}"), F.col(f"new.{c}")
        if c == key:
            out.append(F.col(key))
        elif c in keep:
            out.append(F.when(F.col("old").isNull(), new).otherwise(old).alias(c))
        elif c in keep_when_null:
            out.append(F.coalesce(new, old).alias(c))
        else:
            out.append(F.when(F.col("new").isNull(), old).otherwise(new).alias(c))
    return both.select(*out)


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.unionByName(rows.join(table.select(key), key, "left_anti").select(*table.columns))


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of every parent that ``new`` names are ``new``'s."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").select(*children.columns).unionByName(new.select(*children.columns))


def without(table: DataFrame, keys: DataFrame, on: Sequence[str], status: str | None = None) -> DataFrame:
    """``table`` without the rows that ``keys`` names by ``on``; with ``status`` only those of that status go."""
    gone = keys.select(*on).distinct()
    if status is not None:
        gone = gone.withColumn("status", F.lit(status))
        on = [*on, "status"]
    return table.join(gone, list(on), "left_anti").select(*table.columns)


def cascaded(children: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """``children`` of the parents that are left."""
    return children.join(parents.select(F.col(parent_key or key).alias(key)).distinct(), key, "left_semi").select(*children.columns)


def emptied(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """Every table without rows (delete all)."""
    return tuple(t.limit(0) for t in tables)


def remap(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``column`` with ``mapping`` (``old``, ``new``) applied."""
    joined = rows.join(mapping, F.col(column) == F.col("old"), "left")
    return joined.withColumn(column, F.coalesce("new", column)).select(*rows.columns)
