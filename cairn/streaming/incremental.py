"""Incremental indexing of arriving commits, and streams of stored objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.state import insert_if_absent


def indexed_stream(arrivals: DataFrame, key: list[str], read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], checkpoint: str, *order: str, every: str | None = None) -> StreamingQuery:
    """Inserts what arrives if its key is absent, a micro-batch at a time; ends when what is there has been read, or goes on at an interval (every).

    write(state, batch) must replace the state of the same batch if it comes again.
    """

    def step(batch: DataFrame, number: int) -> None:
        old = read()
        write(insert_if_absent(batch.limit(0) if old is None else old, batch, key, *order), number)

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def first_seen(arrivals: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each key once; what comes later than delay after newer rows is dropped with its state."""
    return arrivals.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def measured(arrivals: DataFrame, ts: str, by: str, width: str, delay: str) -> DataFrame:
    """Counts of each kind in windows of time."""
    return arrivals.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, width), by).count()


def walked(objects: DataFrame, handle: Callable[[object], None]) -> int:
    """Hands each row to a function, a partition at a time; returns how many there were."""
    n = 0
    for row in stream(objects):
        handle(row)
        n += 1
    return n


def stream(objects: DataFrame) -> Iterator:
    return objects.toLocalIterator(prefetchPartitions=True)
