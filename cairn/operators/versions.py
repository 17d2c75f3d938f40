"""Point-in-time questions: versions of paths, commits of sets, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_set(rows: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Rows of the named set; none if there is no such set."""
    return rows.join(sets.where(F.col("name") == name).select(F.col("id").alias("set_id")), "set_id", "left_semi")


def as_of(rows: DataFrame, ts: str, not_after) -> DataFrame:
    """The bound is inclusive."""
    return rows.where(F.col(ts) <= not_after)


def newest(rows: DataFrame, ts: str, k: int, *tie: str) -> DataFrame:
    """The k newest rows, newest first; a top-k, not a sort of all."""
    return rows.orderBy(F.col(ts).desc(), *tie).limit(k)


def file_info(files: DataFrame, set_: Column, path: Column, not_after, k: int) -> DataFrame:
    """Versions of one path as of a time."""
    return newest(as_of(files.where(set_ & path), "ts", not_after), "ts", k, "ref")


def newest_each(rows: DataFrame, keys: list[str], ts: str, k: int, *tie: str) -> DataFrame:
    """The k newest rows of each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), *tie)
    return rows.withColumn("version", F.row_number().over(order)).where(F.col("version") <= k)


def latest_each(rows: DataFrame, keys: list[str], ts: str, *values: str) -> DataFrame:
    """The newest row of each key by a map-side maximum; ties go to the larger values."""
    best = F.max(F.struct(ts, *values)).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}") for c in (ts, *values)])


# Tiers of retention in days, and how each truncates time.
TIERS = ((14, "hour"), (30, "day"), (90, "week"))
OLDEST = "month"


def bucket(ts: Column, anchor: Column, tiers=TIERS, oldest: str = OLDEST) -> Column:
    """The truncated time alone: buckets of different tiers that begin together are one."""
    out = F.date_trunc(oldest, ts)
    for days, unit in reversed(tiers):
        out = F.when(ts >= anchor - F.expr(f"interval {days} days"), F.date_trunc(unit, ts)).otherwise(out)
    return out


def retained(commits: DataFrame, set_col: str, ts: str, anchor: Column, tiers=TIERS) -> DataFrame:
    """The earliest commits of each set and bucket; ties at the earliest are all kept.

    The minimum is pre-aggregated and joined back, so a bucket of very many commits is no hot window. Commits without a set are a
    set of their own, and those without a time a bucket.
    """
    dated = commits.withColumn("bucket", bucket(F.col(ts), anchor, tiers))
    first = dated.groupBy(F.col(set_col).alias("of"), F.col("bucket").alias("in")).agg(F.min(ts).alias("first"))
    same = F.col(set_col).eqNullSafe(F.col("of")) & F.col("bucket").eqNullSafe(F.col("in")) & F.col(ts).eqNullSafe(F.col("first"))
    return dated.join(first, same, "left_semi").drop("bucket")


def reusable(current: DataFrame, latest: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """current with state new, changed or same: whether the newest known version has its time, in whole seconds."""
    known = latest.select(*keys, F.col(ts).alias("known"))
    second = lambda c: F.date_trunc("second", c)
    state = F.when(F.col("known").isNull(), "new").when(second(F.col("known")) == second(F.col(ts)), "same").otherwise("changed")
    return current.join(known, keys, "left").withColumn("state", state).drop("known")
