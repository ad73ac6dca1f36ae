"""Tables in a shared folder: scratch copies and the ways in which the domain's tables are written.

Spark's files cannot be updated in place, so each write makes a new version of a table, a folder of its own, and
the caller swaps names; what a version needs of the one before is read while that is still there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.core import latest
from .scratch import new_version, shared, stored

__all__ = ["latest", "new_version", "recompute", "replace_relation", "shared", "stored", "update", "upsert", "with_ids"]


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """K01. A new version in which `rows` replace what has their keys; of rows with one key the last (all other columns
    in order) counts."""
    order = [F.desc(c) for c in rows.columns if c not in keys]
    new = latest(rows, keys, order or [F.col(keys[0])])
    return stored(table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(new), "upsert")


def replace_relation(table: DataFrame, rows: DataFrame, column: str, value: str) -> DataFrame:
    """K02. A new version in which `rows` are all that has column = value: repeating it changes nothing."""
    return stored(table.filter(F.col(column) != value).unionByName(rows.filter(F.col(column) == value)), "replaced", [column])


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """K04. Columns of the rows that fulfil a condition get new values."""
    return table.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in values.items()})


def with_ids(rows: DataFrame, name: str, order: list[str], first: int = 1) -> DataFrame:
    """K05. Ids in the order of a natural key, without a gap: rows are dealt to ranges of the key and numbered inside each, after
    the counts of the ranges before. No task sees more than its range."""
    kept = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    n = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # over ranges
    return kept.join(before, "_part").withColumn(name, (F.col("_before") + F.col("_at") + first).cast("long")).drop("_part", "_at", "_before")


def recompute(source: DataFrame, old: DataFrame, fn) -> DataFrame:
    """K06. fn(source), or what was there before where the source is empty."""
    return old if source.isEmpty() else fn(source)
