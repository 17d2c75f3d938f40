"""Wire form of objects: references are SHA-1 of an object wrapped by its type's field number."""

from __future__ import annotations

import gzip
import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field numbers of the wrapped object, and wire tags (field << 3 | 2).
FIELD = {"commit": 1, "tree": 2, "file": 3, "blob": 4}
LENGTH_DELIMITED = 2


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it)."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def field(number: int, body: bytes | int) -> bytes:
    """A field, or nothing for a zero value."""
    if isinstance(body, int):
        return varint(number << 3) + varint(body & (1 << 64) - 1) if body else b""
    return varint(number << 3 | LENGTH_DELIMITED) + varint(len(body)) + body


def fields(data: bytes) -> list[tuple[int, bytes | int]]:
    """(number, value) of each field, in order."""
    out, at = [], 0
    while at < len(data):
        tag, at = read_varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = read_varint(data, at)
        elif kind == LENGTH_DELIMITED:
            n, at = read_varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        out.append((tag >> 3, value))
    return out


def message(*values: tuple[int, bytes | int]) -> bytes:
    return b"".join(field(n, v) for n, v in values if v != b"")


def wrapped(kind: str, body: bytes) -> bytes:
    return field(FIELD[kind], body)


def ref_message(ref: bytes) -> bytes:
    return field(1, ref)


def blob_object(data: bytes) -> bytes:
    return wrapped("blob", message((1, data)))


def file_object(parts: list[tuple[int, int, bytes]], splits: list[bytes] = ()) -> bytes:
    body = b"".join(field(1, message((1, o), (2, n), (3, ref_message(r)))) for o, n, r in parts)
    return wrapped("file", body + b"".join(field(2, ref_message(r)) for r in splits))


def tree_object(nodes: list[tuple[dict, bytes]]) -> bytes:
    def stat(s: dict) -> bytes:
        return message((1, s["name"].encode()), (2, s.get("mode", 0)), (3, s.get("user", "").encode()), (4, s.get("group", "").encode()), (5, s.get("timestamp", 0)), (6, s.get("size", 0)), (7, int(s.get("tree", False))))

    return wrapped("tree", b"".join(field(1, field(1, stat(s)) + field(2, ref_message(r))) for s, r in nodes))


def commit_object(timestamp: int, tree: bytes, backup_set: str) -> bytes:
    return wrapped("commit", message((1, timestamp), (2, ref_message(tree)), (3, backup_set.encode())))


def object_ref(data: bytes) -> bytes:
    return hashlib.sha1(data).digest()


def packed(data: bytes) -> bytes:
    return gzip.compress(data, mtime=0)


def unpacked(data: bytes) -> bytes:
    return gzip.decompress(data)


def varint_column(n: Column) -> Column:
    """The varint of a count below 2**35, as binary."""
    byte = lambda k, more: F.unhex(F.lpad(F.hex(F.shiftright(n, 7 * k).bitwiseAND(0x7F).bitwiseOR(0x80 if more else 0)), 2, "0"))
    out = byte(0, False)
    for k in range(1, 5):
        out = F.when(n >= 1 << (7 * k), F.concat(*[byte(j, True) for j in range(k)], byte(k, False))).otherwise(out)
    return out


def blob_payload(data: Column) -> Column:
    """A blob in wire form, without leaving the JVM."""
    size = F.octet_length(data).cast("long")
    inner = F.when(size == 0, F.unhex(F.lit(""))).otherwise(F.concat(F.unhex(F.lit("0A")), varint_column(size), data))
    return F.concat(F.unhex(F.lit("22")), varint_column(F.octet_length(inner).cast("long")), inner)


def blob_ref(data: Column) -> Column:
    """The reference of a blob."""
    return F.unhex(F.sha1(blob_payload(data)))


def blob_tail(payload: Column, length: Column) -> Column:
    """The data of a blob's wire form, which ends it, given its length."""
    return F.substring(payload, (F.octet_length(payload) - length + 1).cast("int"), length.cast("int"))
