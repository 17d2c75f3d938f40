"""Legacy archive and index files.

An archive is records of varint(header length), header, payload; a header names
the object's reference, predecessor, payload size, compression, time and type.
An index file is a magic, a count and fixed records sorted by reference, all
big-endian. Magic and file suffixes are the caller's.
"""

from __future__ import annotations

import itertools
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import wire
from cairn.operators.objects import repack
from cairn.plans.durable import durable

RECORD = np.dtype([("ref", "S20"), ("offset", ">u4"), ("length", ">u4"), ("type", ">u4")])
LEAST_RECORD = 10  # a shorter rest ends the archive


def header(ref: bytes, predecessor: bytes, size: int, compression: int, seconds: int, nanos: int, type_: int, tombstone_for: bytes = b"") -> bytes:
    refs = lambda r: wire.ref_message(r) if r else b""
    stamp = wire.message((1, seconds), (2, nanos))
    return wire.message((1, refs(ref)), (2, refs(predecessor)), (3, size), (4, compression), (5, stamp), (6, type_), (7, refs(tombstone_for)))


def parsed_header(data: bytes) -> dict:
    got = dict(wire.fields(data))
    ref = lambda k: dict(wire.fields(got[k])).get(1) if k in got else None
    stamp = dict(wire.fields(got.get(5, b"")))
    return {"ref": ref(1), "predecessor": ref(2), "size": got.get(3, 0), "compression": got.get(4, 0), "seconds": stamp.get(1, 0), "nanos": stamp.get(2, 0), "type": got.get(6, 0), "tombstone_for": ref(7)}


def record(ref: bytes, predecessor: bytes, type_: int, data: bytes, seconds: int) -> bytes:
    payload = wire.packed(data) if data else b""
    h = header(ref, predecessor, len(payload), 1, seconds, 0, type_)
    return wire.varint(len(h)) + h + payload


def archive_bytes(objects: list[tuple[bytes, int, bytes, int]]) -> bytes:
    """An archive of (ref, type, object, seconds); an empty object has no payload."""
    before = [b"", *[o[0] for o in objects]]
    return b"".join(record(ref, p, type_, data, seconds) for p, (ref, type_, data, seconds) in zip(before, objects, strict=False))


def records(data: bytes):
    """(header, offset, length, payload) of each record."""
    at = 0
    while len(data) - at >= LEAST_RECORD:
        n, begin = wire.read_varint(data, at)
        h = parsed_header(data[begin : begin + n])
        end = begin + n + h["size"]
        yield h, at, end - at, data[begin + n : end]
        at = end


ENTRIES = "archive string, seq long, ref binary, predecessor binary, size long, compression int, seconds long, nanos int, type int, tombstone_for binary, offset long, length long, payload binary"


def read_archives(spark: SparkSession, path: str, suffix: str, types: list[int] | None = None, load: bool = True, only: list[str] | None = None) -> DataFrame:
    """Entries of all archives in a folder (or only those of these names), one task's work per file. Payloads of types that aren't asked for (or without load) are null."""
    names = [f.split()[0] for f in ENTRIES.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path if only is None else [f"{path.rstrip('/')}/{n}{suffix}" for n in only])

    def scan(batches):
        for b in batches:
            for where, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                name, rows = where.rsplit("/", 1)[-1].removesuffix(suffix), []
                for seq, (h, offset, length, payload) in enumerate(records(data.as_py())):
                    want = load and (types is None or h["type"] in types)
                    body = (wire.unpacked(payload) if h["compression"] == 1 and payload else payload) if want else None
                    rows.append((name, seq, h["ref"], h["predecessor"], h["size"], h["compression"], h["seconds"], h["nanos"], h["type"], h["tombstone_for"], offset, length, body))
                if rows:
                    kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(scan, ENTRIES)


def locations(entries: DataFrame) -> DataFrame:
    """The index of archives, rebuilt from their headers."""
    return entries.select("archive", "ref", "offset", "length", "type")


def index_bytes(rows: list[tuple[bytes, int, int, int]], magic: bytes) -> bytes:
    table = np.array(sorted(rows), RECORD)
    return magic + len(rows).to_bytes(4, "big") + table.tobytes()


def parsed_index(data: bytes, magic: bytes) -> list[tuple[bytes, int, int, int]]:
    if not data.startswith(magic):
        raise ValueError("not an index file")
    n = int.from_bytes(data[len(magic) : len(magic) + 4], "big")
    table = np.frombuffer(data, RECORD, n, len(magic) + 4)
    raw = np.frombuffer(data, np.uint8, n * RECORD.itemsize, len(magic) + 4).reshape(n, RECORD.itemsize)
    return [(raw[k, :20].tobytes(), int(r["offset"]), int(r["length"]), int(r["type"])) for k, r in enumerate(table)]


def read_indexes(spark: SparkSession, path: str, suffix: str, magic: bytes, strict: bool = True) -> DataFrame:
    """archive, ref, offset, length, type of all index files in a folder. A file that isn't an index is an error, or (not strict) has no rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)

    def scan(batches):
        for b in batches:
            for where, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    rows = parsed_index(data.as_py(), magic)
                except ValueError:
                    if strict:
                        raise
                    continue
                if rows:
                    ref, offset, length, type_ = zip(*rows, strict=True)
                    yield pa.record_batch([pa.array([where.rsplit("/", 1)[-1].removesuffix(suffix)] * len(rows)), pa.array(ref, pa.binary()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(type_, pa.int32())], ["archive", "ref", "offset", "length", "type"])

    return files.select("path", "content").mapInArrow(scan, "archive string, ref binary, offset long, length long, type int")


def list_files(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length")


def _groups(rows, *key: str):
    return itertools.groupby(rows, key=lambda r: tuple(r[k] for k in key))


def _replaced(path: str, parts) -> None:
    """Writes a file beside its place and moves it there whole, so that a task that is run again does no harm."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "wb") as f:
        f.writelines(parts)
    os.replace(beside, path)


def write_indexes(locations: DataFrame, base: str, suffix: str, magic: bytes) -> None:
    """An index file for each archive of locations (archive, ref, offset, length, type), below a folder that all executors share."""

    def write(rows) -> None:
        for (name,), own in _groups(rows, "archive"):
            _replaced(f"{base}/{name}{suffix}", [index_bytes([(bytes(r.ref), r.offset, r.length, r.type) for r in own], magic)])

    locations.select("archive", "ref", "offset", "length", "type").repartition("archive").sortWithinPartitions("archive").foreachPartition(write)


def write_archives(objects: DataFrame, base: str, suffix: str, max_size: int, writers: int = 4) -> None:
    """Archives of objects (ref, type, payload: the object, seconds) below a folder that all executors share; each writer rolls to a new one once max_size is reached.

    An archive is written by one task, an object at a time.
    """
    rows = durable(objects.select("ref", "type", "payload", "seconds").dropDuplicates(["ref"]).withColumn("writer", F.pmod(F.xxhash64("ref"), F.lit(writers)).cast("int")), "packing")
    slim = rows.select("writer", F.lit("").alias("archive"), F.xxhash64("ref").alias("seq"), F.hex("ref").alias("ref"), F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("length"))
    placed = repack(slim, max_size).select(F.unhex("ref").alias("ref"), "volume")
    run = uuid.uuid4().hex

    def write(part) -> None:
        for (writer, volume), own in _groups(part, "writer", "volume"):

            def parts(own=own):
                before = b""
                for r in own:
                    yield record(bytes(r.ref), before, r.type, bytes(r.payload or b""), r.seconds)
                    before = bytes(r.ref)

            _replaced(f"{base}/{run}-{writer}-{volume}{suffix}", parts())

    rows.join(placed, "ref").repartition("writer", "volume").sortWithinPartitions("writer", "volume", "ref").foreachPartition(write)


def recovered(spark: SparkSession, base: str, suffix: str, index_suffix: str, magic: bytes, write: bool = True) -> DataFrame:
    """The locations of all archives in a folder: from their index files, and of archives whose index is missing or broken from their headers; write: these get an index file."""
    known = read_indexes(spark, base, index_suffix, magic, strict=False)
    names = list_files(spark, base, suffix).select(F.substring("name", F.lit(1), F.length("name") - len(suffix)).alias("archive"))
    lost = [r.archive for r in names.join(known.select("archive"), "archive", "left_anti").collect()]
    if not lost:
        return known
    rebuilt = durable(locations(read_archives(spark, base, suffix, load=False, only=lost)), "rebuilt")
    known = durable(known, "known")
    if write:
        write_indexes(rebuilt, base, index_suffix, magic)
    return known.unionByName(rebuilt)
