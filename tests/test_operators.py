import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import chunks, objects, state, trees, versions
from cairn.operators.indexing import index_commits
from cairn.plans.durable import durable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def ntz(spark, data, kind):
    df = spark.createDataFrame(data, kind)
    return df.withColumn("ts", F.to_timestamp_ntz("ts"))


def test_as_of_is_inclusive_and_newest_first(spark):
    df = ntz(spark, [("2024-01-01 00:00:00", 1), ("2024-01-02 00:00:00", 2), ("2024-01-03 00:00:00", 3)], "ts string, ref long")
    got = versions.newest(versions.as_of(df, "ts", F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00"))), "ts", 5, "ref").collect()
    assert [r.ref for r in got] == [2, 1]


def test_unknown_set_is_empty(spark):
    sets = spark.createDataFrame([(1, "a")], "id long, name string")
    assert versions.in_set(spark.createDataFrame([(1, 5)], "set_id long, x long"), sets, "b").count() == 0


ANCHOR = "2024-04-02 00:00:00"


@pytest.mark.parametrize(
    ("times", "kept"),
    [
        (["2024-01-02 05:00:00", "2024-01-04 05:00:00"], [0]),  # a month and a week that begin together are one bucket
        (["2024-04-01 05:10:00", "2024-04-01 05:10:00", "2024-04-01 05:20:00"], [0, 1]),  # ties at the earliest
        (["2024-03-19 00:00:00", "2024-03-19 01:00:00"], [0, 1]),  # 14 days: by hour, inclusive
        (["2024-03-18 22:00:00", "2024-03-18 23:00:00"], [0]),  # before: by day
        (["2024-03-03 01:00:00", "2024-03-04 01:00:00"], [0, 1]),  # 30 days: by day
    ],
)
def test_retention(spark, times, kept):
    df = ntz(spark, [("s", t, k) for k, t in enumerate(times)], "set string, ts string, ref long")
    got = versions.retained(df, "set", "ts", F.to_timestamp_ntz(F.lit(ANCHOR)))
    assert sorted(r.ref for r in got.collect()) == kept


def test_change_detection_by_seconds(spark):
    now = ntz(spark, [("a", "2024-01-01 00:00:00.900"), ("b", "2024-01-01 00:00:01"), ("c", "2024-01-01 00:00:00")], "path string, ts string")
    old = ntz(spark, [("a", "2024-01-01 00:00:00.100"), ("b", "2024-01-01 00:00:00")], "path string, ts string")
    assert {r.path: r.state for r in versions.reusable(now, old, ["path"], "ts").collect()} == {"a": "same", "b": "changed", "c": "new"}


@pytest.fixture
def located(spark):
    data = [(f"a{k}", f"r{k % 50}", k, 10, 4) for k in range(100)]
    return spark.createDataFrame([(f"arch{k // 10}", f"r{k % 50:02d}", k * 10, 10, 4) for k in range(100)], "archive string, ref string, offset long, length long, type int"), data


def test_locate_delete_and_exclusion(spark, located):
    loc, _ = located
    refs = loc.select("ref").distinct()
    assert {r.ref: r.archive for r in objects.locate(refs, loc).collect()}["r05"] == "arch0"
    assert {r.ref: r.archive for r in objects.locate(refs, loc, ["arch0"]).collect()}["r05"] == "arch5"
    archives = loc.select("archive").distinct()
    left, rest = objects.delete_archive(archives, loc, ["arch0", "arch5"])
    assert left.count() == 8 and objects.locate(refs.where("ref = 'r05'"), rest).count() == 0
    again, same = objects.index_archive(archives, loc, loc.where("archive = 'arch1'"))
    assert again.count() == 10 and same.count() == 100
    assert rows(objects.counts(loc)) == [(100, 50)]


def test_get_verifies_and_misses_are_null(spark):
    import hashlib

    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    store = spark.createDataFrame([(sha("a"), "a"), (sha("b"), "broken")], "ref string, payload string")
    refs = spark.createDataFrame([(sha("a"),), (sha("b"),), (sha("c"),)], "ref string")
    assert {r.ref: r.payload for r in objects.get(refs, store).collect()} == {sha("a"): "a", sha("b"): None, sha("c"): None}


def test_survivors(spark):
    e = spark.createDataFrame([("small1", 0, "x", 5), ("small1", 1, "y", 5), ("small2", 0, "x", 5), ("small2", 1, "z", 5), ("big", 0, "y", 100)], "archive string, seq long, ref string, length long")
    chosen = objects.candidates(e.groupBy("archive").agg(F.sum("length").alias("size")), 50)
    assert [(r.archive, r.ref) for r in objects.survivors(e, chosen).orderBy("ref").collect()] == [("small1", "x"), ("small2", "z")]
    assert rows(objects.triggered(chosen, 1000, 1).select("n", "size", "run")) == [(2, 20, True)]


def test_repack_overshoots_and_starts_anew(spark):
    sizes = [6, 6, 3, 9, 1, 1, 20, 2]
    e = spark.createDataFrame([(0, "a", k, f"r{k}", n) for k, n in enumerate(sizes)], "writer int, archive string, seq long, ref string, length long")
    want, volume, filled = [], 0, 0
    for n in sizes:
        if filled >= 10:
            volume, filled = volume + 1, 0
        filled += n
        want.append(volume)
    assert [r.volume for r in objects.repack(e, 10).orderBy("seq").collect()] == want


def test_state(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, at long")
    new = spark.createDataFrame([(2, "x", 1), (3, "y", 2), (3, "z", 1)], "k long, v string, at long")
    assert rows(state.insert_if_absent(old, new, ["k"], "at").select("k", "v")) == [(1, "a"), (2, "b"), (3, "z")]
    assert rows(state.upsert(old, new, ["k"], "at").select("k", "v")) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(state.delete(old, F.col("k") == 1).select("k")) == [(2,)]
    assert rows(state.update(old, F.col("k") == 1, v=F.lit("q")).select("k", "v")) == [(1, "q"), (2, "b")]
    sets = spark.createDataFrame([(7, "a")], "id long, name string")
    assert rows(state.get_or_create(sets, spark.createDataFrame([("b",), ("a",), ("c",)], "name string"))) == [(7, "a"), (8, "b"), (9, "c")]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([("root", "test.dir", True, "test.dir"), ("root", "test.file1", False, "test.file1"), ("test.dir", "test.file2", False, "test.file2")], "tree_ref string, name string, is_tree boolean, child_ref string")


def test_traverse(spark, edges):
    roots = spark.createDataFrame([("root",)], "ref string")
    assert [r.path for r in trees.traverse(edges, roots).orderBy("path").collect()] == ["test.dir", "test.dir/test.file2", "test.file1"]
    skip = spark.createDataFrame([("test.dir", "test.dir")], "ref string, path string")
    assert [r.path for r in trees.traverse(edges, roots, skip=skip).orderBy("path").collect()] == ["test.dir", "test.file1"]
    assert rows(trees.lookup(edges, roots, "test.dir")) == [("root", "test.dir")]
    assert trees.lookup(edges, roots, "test.file1").count() == 0
    lost = edges.where("tree_ref <> 'test.dir'")
    assert trees.traverse(lost, roots).count() == 2
    with pytest.raises(trees.MissingTree):
        trees.traverse(lost, roots, strict=True)


def test_shared_tree_has_a_path_for_each_place_but_is_marked_once(spark):
    e = spark.createDataFrame([("r", "a", True, "s"), ("r", "b", True, "s"), ("s", "f", False, "x")], "tree_ref string, name string, is_tree boolean, child_ref string")
    roots = spark.createDataFrame([("r",)], "ref string")
    assert [r.path for r in trees.traverse(e, roots).orderBy("path").collect()] == ["a", "a/f", "b", "b/f"]
    marked = trees.reachable(roots, e.select(F.col("tree_ref").alias("src"), F.col("child_ref").alias("dst")))
    assert rows(marked) == [("r",), ("s",), ("x",)]


def test_build_is_undone_by_traverse(spark):
    files = spark.createDataFrame([("a/b/c", "01", 5), ("a/d", "02", 6), ("e", "03", 7), ("x/b/c", "01", 5)], "path string, ref string, mode long")
    e, root, objects_ = trees.build(files, spark.createDataFrame([("a",), ("bare",)], "path string"))
    e = e.cache()
    got = trees.traverse(e, root)
    assert rows(got.where("not is_tree").select("path", "ref", "mode")) == rows(files)
    assert {r.path for r in got.where("is_tree").collect()} == {"a", "a/b", "x", "x/b", "bare"}
    assert e.where("name = 'c'").select("tree_ref").distinct().count() == 1  # equal trees are one
    assert objects_.count() == 5 and trees.build(files.limit(0))[1].count() == 1
    # what is known of a file is in its folders' references
    touched = trees.build(files.withColumn("mode", F.when(F.col("path") == "x/b/c", 9).otherwise(F.col("mode"))))[0]
    refs = lambda edges: {r.name: r.child_ref for r in edges.where("is_tree and name in ('a', 'x')").collect()}
    old, new = refs(trees.build(files)[0]), refs(touched)
    assert old["a"] == new["a"] and old["x"] != new["x"]


def test_traverse_goes_on_or_fails(spark):
    deep = spark.createDataFrame([(f"t{k}", "d", True, f"t{k + 1}") for k in range(12)], "tree_ref string, name string, is_tree boolean, child_ref string")
    roots = spark.createDataFrame([("t0",)], "ref string")
    assert trees.traverse(deep, roots, max_depth=12).count() == 12
    with pytest.raises(ValueError):
        trees.traverse(deep, roots, max_depth=11)


def test_mark_and_sweep_random(spark):
    rng = random.Random(3)
    data = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)]
    e = spark.createDataFrame([(str(a), str(b)) for a, b in data], "src string, dst string")
    seen, todo = {0, 1}, [0, 1]
    while todo:
        x = todo.pop()
        for a, b in data:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    marked = trees.reachable(spark.createDataFrame([("0",), ("1",)], "ref string"), e)
    assert {int(r.ref) for r in marked.collect()} == seen
    every = spark.createDataFrame([(str(k),) for k in range(60)], "ref string")
    assert {int(r.ref) for r in trees.unreachable(every, marked).collect()} == set(range(60)) - seen


def slow_boundaries(data, most):
    window, at = [0] * chunks.REACH, 0
    s1, s2 = chunks.REACH * chunks.OFFSET, chunks.REACH * (chunks.REACH - 1) * chunks.OFFSET
    ends, start = [], 0
    for k, b in enumerate(data):
        gone = window[at]
        s1 += b - gone
        s2 += s1 - chunks.REACH * (gone + chunks.OFFSET)
        window[at] = b
        at = (at + 1) % chunks.REACH
        if s2 & (1 << chunks.BITS) - 1 == (1 << chunks.BITS) - 1 or k + 1 - start == most:
            ends.append(k + 1)
            start = k + 1
    return ends + [len(data)] if start < len(data) else ends


@pytest.mark.parametrize("data", [b"", b"x", b"\0" * 5000, b"\xff" * 5000, random.Random(1).randbytes(200_000), b"ab" * 3000, b"a" * 63, b"a" * 64, b"a" * 65])
@pytest.mark.parametrize("most", [1 << 20, 4096])
def test_boundaries_match_a_loop(data, most):
    assert chunks.boundaries(data, most) == slow_boundaries(data, most)


def test_parts_assemble_and_missing_is_zeros(spark):
    files = spark.createDataFrame([(1, "abcdefghij"), (2, "x"), (3, "")], "k long, t string")
    parts = chunks.fixed_parts(files, "k", "t", 4).withColumn("ref", F.sha1("data"))
    blobs = parts.select("ref", "data")
    assert rows(chunks.assemble(parts.drop("data"), blobs, "k")) == [(1, "abcdefghij"), (2, "x")]
    assert rows(chunks.assemble(parts.drop("data"), blobs.where("data <> 'efgh'"), "k").where("k = 1")) == [(1, "abcd\0\0\0\0ij")]
    want = spark.createDataFrame([(1, 3, 4), (1, 8, 9), (2, 0, 1)], "k long, start long, n long")
    assert rows(chunks.read_range(parts, want, "k").select("k", "start", "data")) == [(1, 3, "defg"), (1, 8, "ij"), (2, 0, "x")]
    assert [r.split_no for r in chunks.splits(parts.where("k = 1"), 2).orderBy("part_no").collect()] == [0, 0, 1]
    assert rows(chunks.file_sizes(parts, "k")) == [(1, 10), (2, 1)]


def test_seek(spark):
    at = lambda n, whence, p=0: spark.range(1).select(chunks.seek(F.lit(10), F.lit(n), whence, F.lit(p))).first()[0]
    assert [at(3, "start"), at(2, "current", 4), at(0, "end"), at(11, "start"), at(-1, "start"), at(10, "start")] == [3, 6, 9, None, None, 10]


FILES = "path string, timestamp timestamp, set_id long, ref string, mode long, user string, group string, size long"


def test_indexing_is_idempotent_and_skips_known_trees_by_set(spark, edges):
    empty = lambda kind: spark.createDataFrame([], kind)
    index = {"sets": empty("id long, name string"), "commits": empty("ref string, timestamp timestamp, tree string, set_id long"), "trees": empty("ref string, path string, set_id long"), "files": empty(FILES)}
    commits = spark.createDataFrame([("c1", "root", "a")], "ref string, tree string, set string").withColumn("timestamp", F.timestamp_seconds(F.lit(5)))
    edges = edges.withColumn("ts", F.timestamp_seconds(F.when(F.col("name") == "test.file1", 1).otherwise(2)))
    written = lambda tables: {k: durable(v) for k, v in tables.items()}
    edges = durable(edges)
    once = written(index_commits(index, commits, edges))
    assert [(r.path, int(r.timestamp.timestamp())) for r in once["files"].orderBy("path").collect()] == [("test.dir/test.file2", 2), ("test.file1", 1)]
    assert {k: v.count() for k, v in index_commits(once, commits, edges).items()} == {k: v.count() for k, v in once.items()}
    other = commits.withColumn("set", F.lit("b")).withColumn("ref", F.lit("c2"))
    assert index_commits(once, other, edges)["files"].count() == 4
    # a commit that lacks a sub-tree is left out, and indexed once that is there
    lacking = written(index_commits(index, commits, edges.where("tree_ref <> 'test.dir'")))
    assert lacking["commits"].count() == lacking["files"].count() == 0
    assert index_commits(lacking, commits, edges)["files"].count() == 2


def test_retention_keeps_what_has_no_set(spark):
    df = ntz(spark, [(None, "2024-01-02 05:00:00", 1), (None, "2024-01-04 05:00:00", 2), ("s", "2024-01-04 05:00:00", 3), ("s", None, 4)], "set string, ts string, ref long")
    assert sorted(r.ref for r in versions.retained(df, "set", "ts", F.to_timestamp_ntz(F.lit(ANCHOR))).collect()) == [1, 3, 4]


@pytest.mark.parametrize("size", [1, 63, 64, 65, 1000])
def test_chunks_of_blocks_are_those_of_the_whole(size):
    data = random.Random(2).randbytes(60_000)
    blocks = [data[k : k + size] for k in range(0, len(data), size)]
    assert list(chunks.cuts(iter(blocks), 4096)) == chunks.boundaries(data, 4096)
    got = list(chunks.pieces(iter(blocks), 4096))
    assert b"".join(d for _, d in got) == data and [at for at, _ in got] == [0, *chunks.boundaries(data, 4096)[:-1]]


def test_streams(spark, tmp_path):
    """First seen and counts in windows, over a stream that ends."""
    from cairn.streaming import incremental

    rows = [(f"k{n % 3}", f"2024-01-01 00:0{n % 5}:00", n) for n in range(30)]
    spark.createDataFrame(rows, "key string, ts string, n long").selectExpr("key", "cast(ts as timestamp) ts", "n").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("key string, ts timestamp, n long").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert rows_of(run(incremental.first_seen(stream(), "key", "ts", "1 hour"), "seen", "append").select("key")) == [("k0",), ("k1",), ("k2",)]
    got = run(incremental.measured(stream(), "ts", "key", "5 minutes", "1 hour"), "measured", "complete")
    assert rows_of(got.select("key", "count")) == [("k0", 10), ("k1", 10), ("k2", 10)]
    assert incremental.walked(spark.range(5), lambda r: None) == 5


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())
