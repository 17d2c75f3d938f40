import hashlib
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from cairn.functions import text, wire


@pytest.mark.parametrize(("said", "want"), [("0", timedelta(0)), ("1h30m", timedelta(hours=1.5)), ("-2.5s", timedelta(seconds=-2.5)), ("300ms", timedelta(milliseconds=300))])
def test_age(said, want):
    assert text.age(said) == want


@pytest.mark.parametrize("said", ["", "5", "h", "1d", "1h x"])
def test_age_malformed(said):
    with pytest.raises(ValueError):
        text.age(said)


CASES = [
    ("*.txt", "a.txt", True), ("*.txt", "b/a.txt", False), ("**/*.txt", "a.txt", True), ("**/*.txt", "x/y/a.txt", True), ("a?c", "abc", True), ("a?c", "a/c", False),
    ("{a,b}.c", "b.c", True), ("[!a].c", "b.c", True), ("[a-c].c", "d.c", False), (r"a\*b", "a*b", True), (r"a\*b", "axb", False), ("a/**", "a/b/c", True),
]


def test_globs(spark):
    for glob, path, want in CASES:
        assert spark.range(1).select(F.lit(path).rlike(text.glob_regex(glob))).first()[0] is want, (glob, path)


def test_selected_include_wins_and_default_keeps(spark):
    df = spark.createDataFrame([("a.txt",), ("b.log",), ("keep.log",), ("c",)], "p string")
    got = {r.p: r.k for r in df.select("p", text.selected(F.col("p"), ["keep*"], ["*.log", "[bad"]).alias("k")).collect()}
    assert got == {"a.txt": True, "b.log": False, "keep.log": True, "c": True}


def test_paths_and_sizes(spark):
    df = spark.createDataFrame([("a/b/c", 999), ("c", 1500), ("x/y", 123_456)], "p string, n long")
    rows = df.select(text.basename(F.col("p")), text.dirname(F.col("p")), text.human_bytes(F.col("n")), text.trim_base(F.col("p"), "a/b"), text.join_path(F.lit(""), F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [("c", "a/b", "999 B", "c", "a/b/c"), ("c", "", "1.5 kB", "c", "c"), ("y", "x", "123 kB", "x/y", "x/y")]


@pytest.mark.parametrize("n", [0, 1, 125, 126, 127, 128, 16383, 20000])
def test_blob_ref_matches_wire_form(spark, n):
    data = bytes(k % 251 for k in range(n))
    want = hashlib.sha1(wire.blob_object(data)).digest()
    got = spark.createDataFrame([(bytearray(data),)], "d binary").select(wire.blob_ref(F.col("d"))).first()[0]
    assert bytes(got) == want == wire.object_ref(wire.blob_object(data))


def test_wire_round_trip():
    parts = [(0, 5, b"a" * 20), (5, 7, b"b" * 20)]
    (number, body), = wire.fields(wire.file_object(parts, [b"c" * 20]))
    assert number == 3
    got = [dict(wire.fields(v)) for n, v in wire.fields(body) if n == 1]
    assert [(p.get(1, 0), p[2], dict(wire.fields(p[3]))[1]) for p in got] == parts
    assert wire.unpacked(wire.packed(b"x" * 999)) == b"x" * 999
    for n in (0, 1, 127, 128, 300, 1 << 40):
        assert wire.read_varint(wire.varint(n), 0) == (n, len(wire.varint(n)))


def test_blob_refs_has_every_document(spark, tmp_path):
    import __spark_entry__ as entry

    texts = ["", "a", "é" * 63, "b" * 125, "b" * 126, "b" * 16383, "b" * 16384, "b" * (1 << 21), None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.ref for r in entry.queries()["blob_refs"](spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else hashlib.sha1(wire.blob_object(t.encode())).hexdigest() for k, t in enumerate(texts)}
