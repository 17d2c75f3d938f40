"""Folders as a source and a sink, tables by scheme, CSV and raw objects."""

from __future__ import annotations

import itertools
import os
import re
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import selected
from cairn.plans.durable import durable, reread


ENTRY = "path string, is_dir boolean, mode long, user string, group string, ts timestamp, size long"


def local_path(url: str) -> str | None:
    """The path of a folder that is mounted on every machine, or None for other file systems."""
    at = urlparse(url)
    return at.path if at.scheme in ("", "file") else None


def _owner(names: dict, lookup, number: int) -> str:
    if number not in names:
        try:
            names[number] = lookup(number)[0]
        except KeyError:
            names[number] = str(number)
    return names[number]


def _entries(root: str):
    """What folders (path below root) hold: regular files and folders; links and devices are left out."""
    import grp
    import pwd
    import stat

    def scan(batches):
        users, groups = {}, {}
        for b in batches:
            rows = []
            for below in b.column("path").to_pylist():
                with os.scandir(os.path.join(root, below)) as found:
                    for e in found:
                        s = e.stat(follow_symlinks=False)
                        if stat.S_ISREG(s.st_mode) or stat.S_ISDIR(s.st_mode):
                            is_dir = stat.S_ISDIR(s.st_mode)
                            rows.append((os.path.join(below, e.name), is_dir, stat.S_IMODE(s.st_mode), _owner(users, pwd.getpwuid, s.st_uid), _owner(groups, grp.getgrgid, s.st_gid), s.st_mtime_ns // 1000, 0 if is_dir else s.st_size))
            if rows:
                kinds = (pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                cols[5] = cols[5].cast(pa.timestamp("us", "UTC"))
                yield pa.record_batch(cols, [f.split()[0] for f in ENTRY.split(", ")])

    return scan


def list_folder(spark: SparkSession, base: str) -> DataFrame:
    """ENTRY of all files and folders below base. A mounted folder is listed by the executors, a level of folders at a time; in others what Spark lists has no owner or mode, and folders have no entry."""
    root = local_path(base)
    if root is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{re.escape(urlparse(base).path.rstrip('/'))}/", "")
        null = lambda c, k: F.lit(None).cast(k).alias(c)
        return files.select(below.alias("path"), F.lit(False).alias("is_dir"), null("mode", "long"), null("user", "string"), null("group", "string"), F.col("modificationTime").alias("ts"), F.col("length").alias("size"))
    front, levels = spark.createDataFrame([("",)], "path string"), []
    while True:
        level = durable(front.repartition("path").mapInArrow(_entries(root), ENTRY), "listing")
        levels += level.stored_at
        front = level.where("is_dir").select("path")
        if front.isEmpty():
            return reread(spark, level, levels)


def read_folder(spark: SparkSession, base: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """ENTRY (less is_dir) and content of regular files that the globs select. For files beyond 2 GB see chunks.file_parts."""
    found = list_folder(spark, base).where("not is_dir").drop("is_dir").where(selected(F.col("path"), list(include), list(exclude)))
    root = local_path(base)
    if root is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{re.escape(urlparse(base).path.rstrip('/'))}/", "")
        return found.join(files.select(below.alias("path"), "content"), "path")

    def read(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                with open(os.path.join(root, row.column("path")[0].as_py()), "rb") as f:
                    yield pa.record_batch([*row.columns, pa.array([f.read()], pa.binary())], [*row.schema.names, "content"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInArrow(read, f"{kinds}, content binary")


def _inside(base: str, path: str) -> str:
    to = os.path.normpath(os.path.join(base, path))
    if os.path.commonpath([os.path.abspath(base), os.path.abspath(to)]) != os.path.abspath(base):
        raise ValueError(f"{path} leads out of {base}")
    return to


def _stamp(to: str, row) -> None:
    if row.mode is not None:
        os.chmod(to, row.mode & 0o7777)
    if row.ts is not None:
        os.utime(to, (time.time(), row.ts.timestamp()))


def restore(parts: DataFrame, base: str, folders: DataFrame | None = None) -> None:
    """Writes files below base, which all executors must share, from path, mode, ts and, part by part, part_no (null: no bytes), offset, data.

    A file's parts go to one task in order, so files of any size fit. It is written beside its place and moved there whole, with
    its mode and time. folders (path, mode, ts) are made first, and get theirs last.
    """
    if folders is not None:
        folders.select("path").foreachPartition(lambda rows: [os.makedirs(_inside(base, r.path), exist_ok=True) for r in rows])

    def write(rows) -> None:
        for _, own in itertools.groupby(rows, key=lambda r: r.path):
            first = next(own)
            to = _inside(base, first.path)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            beside = f"{to}.{uuid.uuid4().hex}"
            with open(beside, "wb") as f:
                for r in itertools.chain([first], own):
                    if r.part_no is not None:
                        f.seek(r.offset)
                        f.write(bytes(r.data))
            _stamp(beside, first)
            os.replace(beside, to)

    parts.select("path", "mode", "ts", "part_no", "offset", "data").repartition("path").sortWithinPartitions("path", "part_no").foreachPartition(write)
    if folders is not None:
        folders.select("path", "mode", "ts").foreachPartition(lambda rows: [_stamp(_inside(base, r.path), r) for r in rows])


def list_objects_csv(objects: DataFrame, path: str | None = None) -> DataFrame:
    """ref (lower-case hex), timestamp (0 if there is none), set ('' if there is none); with path, written as CSV."""
    out = objects.select(F.lower(F.col("ref")).alias("ref"), F.coalesce("timestamp", F.lit(0)).cast("long").alias("timestamp"), F.coalesce("set", F.lit("")).alias("set"))
    if path:
        out.write.csv(path, header=True)
    return out


def raw_object(objects: DataFrame, ref: str, path: str) -> bool:
    """Writes the stored form of one object of any type, by its reference (hex); false if there is none. One without payload (a tombstone) is an empty file."""
    row = objects.where(F.col("ref") == ref.lower()).select("payload").first()
    if row is None:
        return False
    with open(path, "wb") as f:
        f.write(bytes(row.payload or b""))
    return True


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def connector(*schemes: str):
    def add(f):
        READERS.update(dict.fromkeys(schemes, f))
        return f

    return add


@connector("", "file", "gs", "gcs", "s3a", "hdfs", "viewfs", "memory")
def read_table(spark: SparkSession, url: str) -> DataFrame:
    """A Parquet table wherever the session's file systems reach."""
    return spark.read.parquet(url.replace("gcs://", "gs://", 1))


@connector("postgres", "postgresql", "sqlite")
def read_jdbc(spark: SparkSession, url: str) -> DataFrame:
    """A database's table, named by the URL's fragment; needs the driver's jar."""
    where, _, table = url.partition("#")
    return spark.read.jdbc(f"jdbc:{where.replace('postgres://', 'postgresql://', 1)}", table)


def open_table(spark: SparkSession, url: str) -> DataFrame:
    scheme = urlparse(url).scheme
    if scheme not in READERS:
        raise ValueError(f"no connector for {scheme!r}")
    return READERS[scheme](spark, url)


def tenant(table: DataFrame, name: str) -> DataFrame:
    """The rows of a child namespace; tables are partitioned by tenant."""
    return table.where(F.col("tenant") == name)
