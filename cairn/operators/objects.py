"""Objects and their locations: walk, has, missing, locate, get, count; archives and their compaction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.schemas import COMMIT, FILE, INVALID, TOMBSTONE, TREE


def walk(objects: DataFrame, type_: int = INVALID, load: bool = True, payload: str = "payload") -> DataFrame:
    """Objects of a type (INVALID: all); without load the payload column isn't read."""
    rows = objects if type_ == INVALID else objects.where(F.col("type") == type_)
    return rows if load else rows.drop(payload)


def has(refs: DataFrame, objects: DataFrame, key: str = "ref") -> DataFrame:
    return refs.join(objects.select(key), key, "left_semi")


def missing(refs: DataFrame, objects: DataFrame, key: str = "ref") -> DataFrame:
    return refs.join(objects.select(key), key, "left_anti")


def locate(refs: DataFrame, locations: DataFrame, excluding: list[str] = ()) -> DataFrame:
    """The location of each reference in the first archive by name that isn't excluded, there at the first offset.

    A minimum per reference is pre-aggregated, so a reference that is in very many archives is no hot key.
    """
    rows = locations.where(~F.col("archive").isin(list(excluding))) if excluding else locations
    rest = [c for c in rows.columns if c not in ("ref", "archive", "offset")]
    first = has(rows, refs).groupBy("ref").agg(F.min(F.struct("archive", "offset", *rest)).alias("at"))
    return first.select("ref", "at.*")


def get(refs: DataFrame, objects: DataFrame, payload: str = "payload") -> DataFrame:
    """Every reference with its payload; null where there is none. The reference of what is read is verified."""
    sound = objects.where(F.sha1(F.col(payload)) == F.col("ref")).groupBy("ref").agg(F.min(payload).alias(payload))
    return refs.join(sound, "ref", "left")


def cacheable(objects: DataFrame) -> DataFrame:
    """Objects that a cache may hold: commits, trees and files, not the blobs that most bytes are in."""
    return objects.where(F.col("type").isin(COMMIT, TREE, FILE))


def read_through(refs: DataFrame, cache: DataFrame, objects: DataFrame) -> DataFrame:
    """Every reference with what the cache has of it, else with what is stored; null where there is none."""
    hit = refs.join(cache, "ref")
    return hit.unionByName(refs.join(cache.select("ref"), "ref", "left_anti").join(objects, "ref", "left"))


def counts(objects: DataFrame) -> DataFrame:
    """Rows and different references."""
    each = objects.groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.count(F.lit(1)).alias("unique_refs"))


def offsets(entries: DataFrame) -> DataFrame:
    """Adds offset (bytes before it in its archive) and predecessor (the reference before it)."""
    order = Window.partitionBy("archive").orderBy("seq")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return entries.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).withColumn("predecessor", F.lag("ref").over(order))


def ranks(locations: DataFrame, *tie: str) -> DataFrame:
    """Adds rank: the place, from 0, in the archive's index, which is sorted by reference."""
    return locations.withColumn("rank", F.row_number().over(Window.partitionBy("archive").orderBy("ref", *tie)) - 1)


def index_archive(archives: DataFrame, locations: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the new archives' locations; an archive that is known stays as it is."""
    fresh = new.join(archives, "archive", "left_anti")
    return archives.unionByName(fresh.select("archive").distinct()), locations.unionByName(fresh.dropDuplicates(["archive", "ref"]))


def delete_archive(archives: DataFrame, locations: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both tables without the named archives."""
    return tuple(t.where(~F.col("archive").isin(names)) for t in (archives, locations))


def tombstones(refs: DataFrame) -> DataFrame:
    """What is appended to delete objects: hex references of hex references, of type TOMBSTONE, with no payload."""
    return refs.select(F.sha1(F.unhex("ref")).alias("ref"), F.col("ref").alias("tombstone_for"), F.lit(TOMBSTONE).alias("type"))


def without_deleted(objects: DataFrame, stones: DataFrame) -> DataFrame:
    """Objects that no tombstone names; reads alone don't consult tombstones."""
    return objects.join(stones.select(F.col("tombstone_for").alias("ref")), "ref", "left_anti")


def candidates(sizes: DataFrame, max_size: int) -> DataFrame:
    """Archives to compact: those smaller than max_size."""
    return sizes.where(F.col("size") < max_size)


def triggered(chosen: DataFrame, max_size: int, least: int) -> DataFrame:
    """n, size, run: whether there are more than least candidates or they fill an archive."""
    return chosen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("size")).withColumn("run", (F.col("n") > least) | (F.col("size") >= max_size))


def survivors(entries: DataFrame, chosen: DataFrame) -> DataFrame:
    """Entries of chosen archives that are the first of their reference there and in no other archive."""
    inside, outside = (entries.join(chosen.select("archive"), "archive", how) for how in ("left_semi", "left_anti"))
    rest = [c for c in entries.columns if c not in ("ref", "archive", "seq")]
    first = inside.groupBy("ref").agg(F.min(F.struct("archive", "seq", *rest)).alias("e")).select("ref", "e.*")
    return missing(first, outside)


def repack(kept: DataFrame, max_size: int, writer: str = "writer") -> DataFrame:
    """Adds volume: each writer rolls to a new archive once the present one has reached max_size before a write.

    Only sizes travel to the fold. Writers are independent, so the work is dealt by writer.
    """
    kind = f"{writer} {dict(kept.dtypes)[writer]}, archive string, seq long, ref string, length long, volume long"

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["archive", "seq"], kind="stable")
        ends, volume, at, base = rows["length"].cumsum().to_numpy(), np.zeros(len(rows), np.int64), 0, 0
        n = 0
        while at < len(rows):
            stop = min(len(rows), int(np.searchsorted(ends, base + max_size)) + 1)
            volume[at:stop] = n
            base, at, n = ends[stop - 1], stop, n + 1
        return rows.assign(volume=volume)

    return kept.select(writer, "archive", "seq", "ref", "length").groupBy(writer).applyInPandas(fold, kind)


def distribution(values: DataFrame, by: str, value: str, bounds: list[int]) -> DataFrame:
    """How many values of each kind lie in each bucket; bucket k holds those from bounds[k-1] on and below bounds[k]."""
    place = sum(((F.col(value) >= b).cast("int") for b in bounds), F.lit(0))
    return values.groupBy(by, place.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).cast("long").alias("total"))
