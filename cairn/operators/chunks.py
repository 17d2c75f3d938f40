"""File content: chunks, splits, reassembly, ranges."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most bytes of a chunk, and parts of a file object.
MAX_CHUNK, MAX_PARTS = 1 << 20, 25_000
#: The rolling checksum: bytes it covers, what is added to each, and the low bits that are all ones at a boundary.
REACH, OFFSET, BITS = 64, 31, 13


def cuts(blocks, max_chunk: int = MAX_CHUNK):
    """Ends of the content-defined chunks of the bytes that blocks hold together, each as soon as it is known.

    The checksum runs on over cuts; what remains is a chunk; no bytes, no chunks.
    """
    ones, at, done = (1 << BITS) - 1, 0, 0
    tail, s1, s2 = np.zeros(REACH, np.int64), REACH * OFFSET, REACH * (REACH - 1) * OFFSET
    for block in blocks:
        if not len(block):
            continue
        x = np.frombuffer(block, np.uint8).astype(np.int64)
        both = np.concatenate([tail, x])
        gone, tail = both[: len(x)], both[-REACH:]
        # both sums as running totals over all bytes: s1 of the window, s2 of the s1's
        one = s1 + np.cumsum(x - gone)
        two = s2 + np.cumsum(one - REACH * (gone + OFFSET))
        s1, s2 = one[-1], two[-1]
        for cut in (np.flatnonzero(two & ones == ones) + done + 1).tolist():
            while cut - at > max_chunk:
                at += max_chunk
                yield at
            if cut > at:
                at = cut
                yield at
        done += len(x)
        while done - at > max_chunk:
            at += max_chunk
            yield at
    if at < done:
        yield done


def boundaries(data: bytes, max_chunk: int = MAX_CHUNK) -> list[int]:
    return list(cuts([data], max_chunk))


#: Bytes of a file that are read at once, and bytes of chunks that leave a task together.
BLOCK = 8 << 20


def pieces(blocks, max_chunk: int = MAX_CHUNK):
    """(offset, bytes) of each chunk; no more than a block and a chunk are held."""
    held, begin, end = bytearray(), 0, 0

    def taken():
        for b in blocks:
            held.extend(b)
            yield b

    for end in cuts(taken(), max_chunk):
        yield begin, bytes(held[: end - begin])
        del held[: end - begin]
        begin = end


PARTS = "part_no long, offset long, length long, ref string, data binary"


def _cut(sources, key: str, kind: pa.DataType, max_chunk: int):
    """Record batches of the chunks of (key, blocks)."""
    rows, held = [], 0

    def batch():
        kinds = (kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [key, *[f.split()[0] for f in PARTS.split(", ")]])

    for k, blocks in sources:
        for n, (at, data) in enumerate(pieces(blocks, max_chunk)):
            rows.append((k, n, at, len(data), hashlib.sha1(data).hexdigest(), data))
            held += len(data)
            if held > BLOCK:
                yield batch()
                rows, held = [], 0
    if rows:
        yield batch()


def content_parts(files: DataFrame, key: str, content: str, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """key, part_no, offset, length, ref (hex SHA-1 of the data), data of content-defined chunks."""

    def cut(batches):
        for b in batches:
            yield from _cut(((k, [v.as_py() or b""]) for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True)), key, b.schema.field(0).type, max_chunk)

    return files.select(key, F.col(content).cast("binary").alias(content)).mapInArrow(cut, f"{key} {dict(files.dtypes)[key]}, {PARTS}")


def file_parts(files: DataFrame, base: str, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """content_parts of files (path below base, a folder that all executors share), read a block at a time, so that files of any size fit."""

    def blocks(path: str):
        with open(f"{base}/{path}", "rb") as f:
            while data := f.read(BLOCK):
                yield data

    def cut(batches):
        for b in batches:
            yield from _cut(((k, blocks(k)) for k in b.column(0).to_pylist()), "path", pa.string(), max_chunk)

    return files.select("path").mapInArrow(cut, f"path string, {PARTS}")


def fixed_parts(files: DataFrame, key: str, content: str, size: int) -> DataFrame:
    """key, part_no, offset, length, data: slices of size characters (or bytes of a binary)."""
    n = F.length(content)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    out = files.select(key, F.col(content), F.explode(starts).alias("part_no"))
    data = F.substring(F.col(content), F.col("part_no") * size + 1, F.lit(size))
    return out.select(key, F.col("part_no").cast("long").alias("part_no"), (F.col("part_no") * size).cast("long").alias("offset"), F.length(data).cast("long").alias("length"), data.alias("data"))


def part_offsets(parts: DataFrame, key: str) -> DataFrame:
    """Adds offset: the lengths before the part in its file."""
    order = Window.partitionBy(key).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))


def splits(parts: DataFrame, most: int = MAX_PARTS) -> DataFrame:
    """Adds split_no: the file object that holds the part."""
    return parts.withColumn("split_no", F.floor(F.col("part_no") / most).cast("long"))


def file_sizes(parts: DataFrame, key: str) -> DataFrame:
    return parts.groupBy(key).agg(F.max(F.col("offset") + F.col("length")).alias("size"))


def assemble(parts: DataFrame, blobs: DataFrame, key: str, zero: str = "\0") -> DataFrame:
    """key, content: parts (part_no, length, ref) with their blobs (ref, data), in order; a blob that is missing is zeros."""
    data = blobs.groupBy("ref").agg(F.min("data").alias("data"))
    whole = parts.join(data, "ref", "left").withColumn("data", F.coalesce("data", F.repeat(F.lit(zero), F.col("length").cast("int"))))
    pieces = F.array_sort(F.collect_list(F.struct("part_no", "data")))
    return whole.groupBy(key).agg(F.array_join(F.transform(pieces, lambda p: p["data"]), "").alias("content"))


def read_range(parts: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """key, start, n, data: for each wanted (key, start, n) the characters that the parts hold there.

    An equi-join on the file; the range is a filter on its parts, of which only those that overlap are kept.
    """
    end = F.col("start") + F.col("n")
    hit = wanted.join(parts, key).where((F.col("offset") < end) & (F.col("offset") + F.col("length") > F.col("start")))
    low, high = F.greatest("start", "offset"), F.least(end, F.col("offset") + F.col("length"))
    piece = F.substring(F.col("data"), (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
    got = hit.groupBy(key, "start", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_no", piece.alias("d")))), lambda p: p["d"]), "").alias("data"))
    return got


def seek(size: Column, offset: Column, whence: str, position: Column | None = None) -> Column:
    """Where a seek leads, or null if that is before the start or beyond the size. From the end, offset counts back from the last byte."""
    to = {"start": offset, "current": (position if position is not None else F.lit(0)) + offset, "end": size - 1 - offset}[whence]
    return F.when((to >= 0) & (to <= size), to)
