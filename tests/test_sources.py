import os
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import wire
from cairn.schemas import BLOB
from cairn.sources import archives, files
from cairn.store import Compaction, Store

MAGIC = b"TEST_INDEX_01"


def test_index_round_trip(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.randbytes(20), rng.randrange(1 << 32), rng.randrange(1 << 32), rng.randrange(1 << 31)) for _ in range(1000)]
    data = archives.index_bytes(rows, MAGIC)
    assert archives.parsed_index(data, MAGIC) == sorted(rows)
    (tmp_path / "a1.idx").write_bytes(data)
    got = archives.read_indexes(spark, str(tmp_path), ".idx", MAGIC).collect()
    assert {(bytes(r.ref), r.offset, r.length, r.type) for r in got} == set(rows) and {r.archive for r in got} == {"a1"}


def test_archive_round_trip_and_recovery(spark, tmp_path):
    rng = random.Random(6)
    blobs = [wire.blob_object(rng.randbytes(rng.randrange(16384))) for _ in range(50)]
    (tmp_path / "x.pack").write_bytes(archives.archive_bytes([(wire.object_ref(b), BLOB, b, 100 + k) for k, b in enumerate(blobs)]))
    entries = archives.read_archives(spark, str(tmp_path), ".pack").orderBy("seq").collect()
    assert [bytes(r.payload) for r in entries] == blobs
    assert all(bytes(r.ref) == wire.object_ref(bytes(r.payload)) for r in entries)
    assert entries[0].predecessor is None and [bytes(r.predecessor) for r in entries[1:]] == [bytes(r.ref) for r in entries[:-1]]
    assert [r.offset for r in entries[1:]] == [r.offset + r.length for r in entries[:-1]]
    none = archives.read_archives(spark, str(tmp_path), ".pack", load=False)
    assert none.where("payload is not null").count() == 0 and archives.locations(none).count() == 50


def test_archives_are_written_and_indexes_recovered(spark, tmp_path):
    """Objects written as archives are read back; a missing and a broken index are rebuilt from the headers and written."""
    rng, base = random.Random(7), str(tmp_path)
    blobs = [wire.blob_object(rng.randbytes(rng.randrange(1, 4000))) for _ in range(60)]
    df = spark.createDataFrame([(wire.object_ref(b), BLOB, b, 5) for b in blobs], "ref binary, type int, payload binary, seconds long")
    archives.write_archives(df.unionByName(df.limit(9)), base, ".pack", 20_000, writers=2)
    names = sorted(f for f in os.listdir(base) if f.endswith(".pack"))
    entries = archives.read_archives(spark, base, ".pack").collect()
    assert len(names) > 4 and sorted(bytes(r.payload) for r in entries) == sorted(blobs)
    # a writer rolls once its bytes reach the bound, so no archive holds more than that and one object
    assert all(sum(len(bytes(r.payload)) for r in entries if r.archive + ".pack" == n) < 24_100 for n in names)
    where = {(r.archive, bytes(r.ref), r.offset, r.length, r.type) for r in entries}
    found = lambda: {(r.archive, bytes(r.ref), r.offset, r.length, r.type) for r in archives.recovered(spark, base, ".pack", ".idx", MAGIC).collect()}
    assert found() == where
    indexes = sorted(f for f in os.listdir(base) if f.endswith(".idx"))
    assert [f[:-4] for f in indexes] == [f[:-5] for f in names]
    os.remove(f"{base}/{indexes[0]}")
    (tmp_path / indexes[1]).write_bytes(b"no index at all")
    with pytest.raises(Exception, match="not an index"):
        archives.read_indexes(spark, base, ".idx", MAGIC).collect()
    assert found() == where
    assert {(r.archive, bytes(r.ref), r.offset, r.length, r.type) for r in archives.read_indexes(spark, base, ".idx", MAGIC).collect()} == where


def tree_of(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names}


def write(base, data, seconds=1_600_000_000):
    for k, (name, body) in enumerate(data.items()):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(body)
        os.utime(base / name, (seconds + k, seconds + k))


DATA = {"a.txt": b"hello", "d/b.bin": random.Random(8).randbytes(50_000), "d/empty": b"", "d/skip.log": b"no", "same.txt": b"hello", "d/e/deep.txt": b"deep", "odd [1] +.txt": b"odd"}


def test_snapshot_restore_and_sweep(spark, tmp_path):
    base, to = tmp_path / "in", tmp_path / "out"
    write(base, DATA)
    (base / "bare").mkdir()
    os.chmod(base / "a.txt", 0o640)
    os.chmod(base / "d", 0o750)
    os.utime(base / "d", (1_500_000_000,) * 2)
    store = Store(spark, str(tmp_path / "store"))
    first = store.snapshot(str(base), "home", exclude=["**/*.log"], max_chunk=4096, max_parts=5)
    assert store.commit_info("home").count() == 1 and store.commit_info("none").count() == 0
    assert store.table("splits").count() > 1  # b.bin has more than five parts
    store.restore("home", str(to))
    kept = {k: v for k, v in DATA.items() if not k.endswith(".log")}
    assert tree_of(to) == kept
    for name in [*kept, "d", "d/e"]:
        a, b = os.stat(base / name), os.stat(to / name)
        assert (int(a.st_mtime), a.st_mode) == (int(b.st_mtime), b.st_mode), name
    # equal contents keep their own times; stat is kept for each path
    rows = {n: store.file_info("home", n).first() for n in ("a.txt", "same.txt")}
    assert rows["a.txt"].ref == rows["same.txt"].ref and rows["a.txt"].mode == 0o640
    assert {n: int(r.timestamp.timestamp()) for n, r in rows.items()} == {n: int(os.stat(base / n).st_mtime) for n in rows}
    assert rows["a.txt"].user and rows["a.txt"].group and rows["a.txt"].size == 5
    # a file that is only touched, below a folder that is known
    os.utime(base / "d/e/deep.txt", (1_700_000_000,) * 2)
    os.utime(base / "d/e", (1_400_000_000,) * 2)
    (base / "a.txt").write_bytes(b"changed")
    os.utime(base / "a.txt", (1_700_000_001,) * 2)
    before = store.walk(BLOB, load=False).count()
    second = store.snapshot(str(base), "home", exclude=["**/*.log"], max_chunk=4096, max_parts=5)
    assert first != second and store.walk(BLOB, load=False).count() == before + 1
    assert [int(r.timestamp.timestamp()) for r in store.file_info("home", "d/e/deep.txt").collect()] == [1_700_000_000, int(1_600_000_005)]
    assert store.file_info("home", "a.txt").count() == 2 and store.file_info("home", "same.txt").count() == 1
    assert {r.path: bytes(r.content) for r in store.restored("home", path="d").collect()} == {"b.bin": DATA["d/b.bin"], "empty": b"", "e/deep.txt": b"deep"}
    with pytest.raises(LookupError):
        store.restored("home", path="no/such")
    store.restore_file("home", "a.txt", str(tmp_path / "one.txt"))
    assert (tmp_path / "one.txt").read_bytes() == b"changed" and int(os.stat(tmp_path / "one.txt").st_mtime) == 1_700_000_001
    with pytest.raises(LookupError):
        store.restore_file("home", "none.txt", str(tmp_path / "two.txt"))
    n = store.walk().count()
    store.reindex()
    assert store.sweep() == 0 and store.walk().count() == n
    gone = store.walk(BLOB, load=False).select("ref").limit(1)
    store.delete(gone)
    assert store.sweep() == 1 and store.walk().count() == n - 1


def test_objects_are_their_wire_form(spark, tmp_path):
    write(tmp_path / "in", {"a.txt": b"hello", "d/b.txt": b"hello"})
    store = Store(spark, str(tmp_path / "store"), cache=True)
    commit = store.snapshot(str(tmp_path / "in"), "home")
    rows = {r.ref: r for r in store.walk().collect()}
    assert all(wire.object_ref(bytes(r.payload)).hex() == ref for ref, r in rows.items())
    kinds = sorted(r.type for r in rows.values())
    assert kinds == [1, 2, 2, 3, 4] and rows[commit].type == 1
    for ref, r in rows.items():  # a raw copy of any type
        assert store.raw_object(ref, str(tmp_path / "raw")) and (tmp_path / "raw").read_bytes() == bytes(r.payload)
    assert not store.raw_object("00" * 20, str(tmp_path / "raw"))
    # written twice, stored once; reads through the cache give what is stored
    store.put(store.walk().select("ref", "type", "payload"))
    assert store.walk().count() == len(rows)
    refs = spark.createDataFrame([(r,) for r in [*rows, "00" * 20]], "ref string")
    got = {r.ref: r.payload for r in store.get(refs).collect()}
    assert got.pop("00" * 20) is None and {k: bytes(v) for k, v in got.items()} == {k: bytes(r.payload) for k, r in rows.items()}
    assert store.cache.count() == 4
    store.clear()
    assert store.walk().count() == 0 and store.file_info("home", "a.txt").count() == 0


def test_compaction_end_to_end(spark, tmp_path):
    """Many small archives with repeats and one tombstone become few; objects stay readable; old archives are gone."""
    rng, store = random.Random(9), Store(spark, str(tmp_path / "store"), compaction=Compaction(max_size=20_000, least=6, writers=2))
    blobs = [wire.blob_object(rng.randbytes(rng.randrange(500, 3000))) for _ in range(30)]
    rows = [(wire.object_ref(b).hex(), BLOB, b) for b in blobs]
    for k in range(0, 30, 6):
        store.put(spark.createDataFrame(rows[k : k + 6], "ref string, type int, payload binary"))
    archives = lambda: {r.archive for r in store.walk(load=False).select("archive").distinct().collect()}
    old = archives()
    assert len(old) == 5 and store.compact(max_size=100, force=False) is None
    # an object in two archives, as writers that don't know of each other leave it
    store._commit(store._written(store.table("objects").where(F.col("ref") == rows[0][0]).withColumn("archive", F.lit("twin"))))
    store.delete(spark.createDataFrame([(rows[1][0],)], "ref string"))
    assert store.compact(least=100, max_size=1 << 20) is None  # neither enough archives nor enough bytes
    done = store.compact()
    assert done["archives"] == 6 and done["objects"] == 31 and done["dropped_objects"] == 2 and done["dropped_bytes"] == sum(len(rows[k][2]) for k in (0, 1))
    assert not archives() & old and len(archives()) == done["new_archives"]
    assert {r.ref: bytes(r.payload) for r in store.walk().collect()} == {r: b for k, (r, _, b) in enumerate(rows) if k != 1}
    left = {f for d, _, names in os.walk(tmp_path / "store/archives") for f in [os.path.basename(d)] if any(n.endswith(".parquet") for n in names)}
    assert left == {f"in={a}" for a in archives()}
    assert store.run_if_due() is None
    timed = Store(spark, str(tmp_path / "store"), compaction=Compaction(max_size=1 << 30, least=0, every=1e-9, on_close=True))
    assert timed.run_if_due()["new_archives"] <= 4
    timed.close()


def test_connectors(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert files.open_table(spark, f"file://{tmp_path}/t").count() == 3
