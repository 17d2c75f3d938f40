"""Schemas of the stored objects and of the metadata tables. Unsigned 32-bit values are longs; absent fields are zero values."""

from __future__ import annotations

from pyspark.sql import types as T

# Numbers of object types and compressions.
INVALID, COMMIT, TREE, FILE, BLOB, TOMBSTONE = range(6)
TYPE_NAMES = {"INVALID": INVALID, "COMMIT": COMMIT, "TREE": TREE, "FILE": FILE, "BLOB": BLOB, "TOMBSTONE": TOMBSTONE}
NO_COMPRESSION, GZIP = 0, 1


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


FILE_PART = _struct(offset=T.LongType(), length=T.LongType(), ref=T.BinaryType())
FILE_OBJECT = _struct(parts=T.ArrayType(FILE_PART), splits=T.ArrayType(T.BinaryType()))
STAT = _struct(name=T.StringType(), mode=T.LongType(), user=T.StringType(), group=T.StringType(), timestamp=T.LongType(), size=T.LongType(), tree=T.BooleanType())
TREE_NODE = _struct(stat=STAT, ref=T.BinaryType())
TREE_OBJECT = _struct(nodes=T.ArrayType(TREE_NODE))
COMMIT_OBJECT = _struct(timestamp=T.LongType(), tree=T.BinaryType(), backup_set=T.StringType())

OBJECTS = _struct(ref=T.BinaryType(), type=T.IntegerType(), payload=T.BinaryType())
ARCHIVE_ENTRIES = _struct(archive=T.StringType(), seq=T.LongType(), ref=T.BinaryType(), predecessor=T.BinaryType(), size=T.LongType(), compression=T.IntegerType(), seconds=T.LongType(), nanos=T.IntegerType(), type=T.IntegerType(), tombstone_for=T.BinaryType(), offset=T.LongType(), length=T.LongType(), payload=T.BinaryType())
LOCATIONS = _struct(archive=T.StringType(), ref=T.BinaryType(), offset=T.LongType(), length=T.LongType(), type=T.IntegerType())
SETS = _struct(id=T.LongType(), name=T.StringType())
COMMITS = _struct(ref=T.BinaryType(), timestamp=T.TimestampType(), tree=T.BinaryType(), set_id=T.LongType())
TREES = _struct(ref=T.BinaryType(), path=T.StringType(), set_id=T.LongType())
FILES = _struct(path=T.StringType(), timestamp=T.TimestampType(), set_id=T.LongType(), ref=T.BinaryType(), mode=T.LongType(), user=T.StringType(), group=T.StringType(), size=T.LongType())
KEYS = {"sets": ["name"], "commits": ["ref"], "trees": ["ref", "path", "set_id"], "files": ["path", "timestamp", "set_id"], "archives": ["name"], "locations": ["ref", "archive"]}


def type_number(name: str) -> int:
    """An unknown name is INVALID, which stands for every type."""
    return TYPE_NAMES.get(name.upper(), INVALID)
