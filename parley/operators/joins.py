"""Joins of the engine: bridges, existence, absence, optional children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def through_bridge(rows: DataFrame, bridge: DataFrame, key: str, group: str, keep: list[str]) -> DataFrame:
    """Rows fanned out over a bridge and reduced to one per (key, group)."""
    return rows.select(key, *keep).join(bridge.select(key, group).distinct(), key).dropDuplicates([key, group])


def having(rows: DataFrame, bridge: DataFrame, key: str, condition: Column) -> DataFrame:
    """Rows with at least one bridge row that meets the condition; never fans out."""
    return rows.join(bridge.where(condition).select(key), key, "left_semi")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a finished value yet."""
    return rows.join(done.select(key), key, "left_anti")


def child_counts(parents: DataFrame, children: DataFrame, key: str, condition: Column, name: str = "n") -> DataFrame:
    """Every parent with its number of children that meet the condition, zero included."""
    counted = children.where(condition).groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def members(values: DataFrame, eligible: DataFrame, key: str) -> DataFrame:
    """Values of eligible rows only."""
    return values.join(eligible.select(key), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows replaced by new ones of the same key, and the rest of both."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_columns(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Old rows with ``columns`` taken from the new row of the same key, and new rows of other keys whole.

    ``new`` has each key once; a null in it is a value like any other.
    """
    side = new.select(*keys, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_new"))
    met = old.join(side, keys, "left")
    kept = met.select(*[(F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(f"`{c}`")) if c in columns else F.col(f"`{c}`")).alias(c) for c in old.columns])
    return kept.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there yet."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Each key's row of the highest version, by one aggregation and no sort."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def beside(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Every row with its stored value, or none."""
    return rows.join(values, key, "left")
