"""Size checks, joins and tables that the operators of this subpackage use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.durable import dropped, durable

__all__ = ["dropped", "fresh", "maybe_broadcast", "pick", "spread_join", "stored", "table"]

#: Most bytes that an operator broadcasts; beyond it the same join shuffles.
BROADCAST_BYTES = 8 << 20
#: Rows that go to Python at once where rows hold whole texts.
TEXT_ROWS = 1000


def stored(df: DataFrame, name: str, texts: bool = False) -> DataFrame:
    """df, written to the shared folder and read again. texts: rows that go to Python hold whole texts, so fewer go at once."""
    if not texts:
        return durable(df, name)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(df.sparkSession.conf.get(key))
    return durable(df, name, **{key: min(TEXT_ROWS, rows) if rows > 0 else TEXT_ROWS})


def weight(df: DataFrame) -> int:
    """Bytes that the rows may take in memory, summed over all of them: twice their JSON form and a fixed part each."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) * 2 + 32), F.lit(0))).first()[0]


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """df, marked for broadcast only if its rows' bytes, which are measured, fit BROADCAST_BYTES; else df itself. Meant for written tables."""
    return F.broadcast(df) if weight(df) <= BROADCAST_BYTES else df


#: Rows of one key beyond which a join doesn't deal them by the key: a 2**16th of all rows, or this many.
HOT_ROWS, HOT_KEYS = 64, 1 << 16
#: Slim rows that one task may hold whatever their keys.
FEW_ROWS = 1 << 13


def spread_join(rows: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with side (one slim row of fixed width for each key), no key's rows in one task.

    Keys of many rows, of which there are at most HOT_KEYS, have their side broadcast; the others' rows are dealt by key.
    Both tables are read twice, so they are written ones.
    """
    n = rows.count()
    if n <= FEW_ROWS:
        return rows.join(side, key, how)
    limit = max(HOT_ROWS, n // HOT_KEYS)
    hot = stored(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select(key), "hot-keys")
    if hot.isEmpty():
        return rows.join(side, key, how)
    few = F.broadcast(hot)
    return rows.join(few, key, "left_anti").join(side, key, how).unionByName(rows.join(few, key, "left_semi").join(F.broadcast(side.join(few, key, "left_semi")), key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no column of that name."""
    have = {c.lower() for c in df.columns}
    return [next(x for x in (n + "_" * k for k in range(len(have) + 1)) if x not in have) for n in names]


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; a column that is absent is null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
