"""Changes to tables, as old state and delta to new state. Readers see whole versions, so a lost task changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_of(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key, by a map-side minimum."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    return rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*key, "r.*").select(*rows.columns)


def insert_if_absent(old: DataFrame, new: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first writer of a key wins."""
    return old.unionByName(first_of(new, key, *order).join(old.select(*key), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last writer of a key wins."""
    rest = [c for c in new.columns if c not in key and c not in order]
    last = new.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*key, "r.*").select(*new.columns)
    return old.join(last.select(*key), key, "left_anti").unionByName(last)


def update(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    return rows.withColumns({k: F.when(where, v).otherwise(F.col(k)) for k, v in values.items()})


def delete(rows: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition is false or null stay."""
    return rows.where(~F.coalesce(where, F.lit(False)))


def reload(stale: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The present rows of stale rows' keys."""
    return rows.join(stale.select(*key).distinct(), key, "left_semi")


def get_or_create(sets: DataFrame, names: DataFrame) -> DataFrame:
    """sets with ids for the names that it lacks, numbered on in order of name. New names are few: sets are a dimension."""
    fresh = names.select("name").distinct().join(sets, "name", "left_anti")
    last = sets.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = fresh.withColumn("k", F.row_number().over(Window.orderBy("name"))).join(F.broadcast(last))
    return sets.select("id", "name").unionByName(numbered.select((F.col("last") + F.col("k")).cast("long").alias("id"), "name"))
