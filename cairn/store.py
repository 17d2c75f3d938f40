"""A store of snapshots: objects in archives, an index of files and commits, and the calls that use them.

State is Parquet below a root folder. Objects are in archives, which never
change: a write adds one, a compaction replaces some. Of the other tables each
change writes a new version. One small file names the present archives and
versions, and is replaced last, so readers see whole states; readers don't wait.
There is one writer at a time.

Objects are kept in wire form; a reference is the SHA-1 of that, in hex.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import wire
from cairn.functions.text import age, selected
from cairn.operators import chunks, objects, trees, versions
from cairn.operators.indexing import index_commits
from cairn.operators.state import first_of, insert_if_absent
from cairn.plans.durable import durable, hadoop_path
from cairn.schemas import BLOB, COMMIT, FILE, INVALID, TREE
from cairn.sources.files import ENTRY, list_folder, list_objects_csv, local_path, raw_object, read_folder, restore

STAT = ", ".join(f"{c} {k}" for c, k in trees.STAT.items())
KINDS = {
    "parts": "file_ref string, part_no long, offset long, length long, ref string",
    "splits": "file_ref string, split_no long, ref string",
    "edges": f"tree_ref string, name string, is_tree boolean, child_ref string, {STAT}",
    "history": "ref string, timestamp timestamp, tree string, set string",
    "sets": "id long, name string",
    "commits": "ref string, timestamp timestamp, tree string, set_id long",
    "trees": "ref string, path string, set_id long",
    "files": "path string, timestamp timestamp, set_id long, ref string, mode long, user string, group string, size long",
    "tombstones": "ref string, tombstone_for string, type int",
}
OBJECTS = "archive string, seq long, ref string, type int, length long, payload binary, ts timestamp"


@dataclass
class Compaction:
    """When archives are compacted: with more than least archives below max_size bytes, or if those fill one; after writes, on opening, on closing, or by run_if_due after so many seconds. collect: what no commit leads to goes with it."""

    max_size: int = 1 << 30
    least: int = 1000
    after_flush: bool = False
    on_open: bool = False
    on_close: bool = False
    every: float = 0.0
    collect: bool = False
    writers: int = 4


def commit_payload(rows: DataFrame) -> DataFrame:
    """Adds payload and ref of commits (timestamp, tree, set)."""

    def work(batches):
        for b in batches:
            out = [wire.commit_object(int(t.timestamp()), bytes.fromhex(r), s) for t, r, s in zip(*(b.column(c).to_pylist() for c in ("timestamp", "tree", "set")), strict=True)]
            yield pa.record_batch([*b.columns, pa.array(out, pa.binary()), pa.array([wire.object_ref(x).hex() for x in out], pa.string())], [*b.schema.names, "payload", "ref"])

    return rows.select("timestamp", "tree", "set").mapInArrow(work, "timestamp timestamp, tree string, set string, payload binary, ref string")


def file_objects(files: DataFrame, parts: DataFrame, most: int = chunks.MAX_PARTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files with their ref, objects, splits) for files (path) and their parts (path, part_no, offset, length, ref).

    A file object has its parts. With more than most parts they go to file objects of most parts each, and the file's object
    names these. Each is built from what it holds alone, so no task holds more than most parts.
    """

    def leaf(batches):
        for b in batches:
            out = [wire.file_object([(p["offset"], p["length"], bytes.fromhex(p["ref"])) for p in own or []]) for own in b.column("p").to_pylist()]
            yield pa.record_batch([b.column("path"), b.column("split_no"), pa.array(out, pa.binary()), pa.array([wire.object_ref(x).hex() for x in out], pa.string())], ["path", "split_no", "payload", "ref"])

    def top(batches):
        for b in batches:
            out = [wire.file_object([], [bytes.fromhex(r["ref"]) for r in own]) for own in b.column("s").to_pylist()]
            yield pa.record_batch([b.column("path"), pa.array(out, pa.binary()), pa.array([wire.object_ref(x).hex() for x in out], pa.string())], ["path", "payload", "ref"])

    each = chunks.splits(parts.select("path", "part_no", "offset", "length", "ref"), most).groupBy("path", "split_no").agg(F.array_sort(F.collect_list(F.struct("part_no", "offset", "length", "ref"))).alias("p"))
    none = files.select("path").join(parts.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("split_no"), F.lit(None).cast(each.schema["p"].dataType).alias("p"))
    leaves = durable(each.unionByName(none).mapInArrow(leaf, "path string, split_no long, payload binary, ref string"), "files")
    pieces = leaves.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("split_no", "ref"))).alias("s"))
    whole = durable(pieces.where("size(s) > 1").select("path", "s").mapInArrow(top, "path string, payload binary, ref string"), "split-files")
    refs = pieces.where("size(s) = 1").select("path", F.col("s")[0]["ref"].alias("ref")).unionByName(whole.select("path", "ref"))
    splits = pieces.where("size(s) > 1").join(whole.select("path", F.col("ref").alias("file_ref")), "path").select("file_ref", F.explode("s").alias("x")).select("file_ref", "x.split_no", "x.ref")
    return refs, leaves.select("ref", "payload").unionByName(whole.select("ref", "payload")).dropDuplicates(["ref"]), splits


class Store:
    """cache: commits, trees and files stay in memory once read. compaction: when archives are compacted, if ever."""

    def __init__(self, spark: SparkSession, root: str, cache: bool = False, compaction: Compaction | None = None):
        self.spark, self.root, self.compaction, self.compacted = spark, root.rstrip("/"), compaction, time.monotonic()
        self.cache: DataFrame | None = None
        self.cached = cache
        if compaction and compaction.on_open:
            self.compact()

    def close(self) -> None:
        if self.compaction and self.compaction.on_close:
            self.compact()
        self._forget()

    # state

    def _state(self) -> dict[str, dict[str, str]]:
        fs, path = hadoop_path(self.spark, f"{self.root}/current.json")
        if not fs.exists(path):
            return {"tables": {}, "archives": {}}
        return json.loads(self.spark.read.text(f"{self.root}/current.json", wholetext=True).first()[0])

    def _write_state(self, state: dict) -> None:
        """Beside the present one first, so that a broken write leaves that."""
        fs, path = hadoop_path(self.spark, f"{self.root}/current.json")
        _, new = hadoop_path(self.spark, f"{self.root}/current.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(new, path):
            fs.delete(path, False)
            fs.rename(new, path)
        self._forget()

    def table(self, name: str) -> DataFrame:
        if name == "objects":
            return self._archives(list(self._state()["archives"].values()))
        at = self._state()["tables"].get(name)
        return self.spark.read.schema(KINDS[name]).parquet(at) if at else self.spark.createDataFrame([], KINDS[name])

    def _archives(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(OBJECTS).parquet(*paths) if paths else self.spark.createDataFrame([], OBJECTS)

    def _written(self, rows: DataFrame) -> dict[str, str]:
        """Archives written from rows of OBJECTS, one folder each; those that have rows."""
        at = f"{self.root}/archives/{uuid.uuid4().hex}"
        rows.withColumn("in", F.col("archive")).write.partitionBy("in").parquet(at)
        names = [r[0] for r in self.spark.read.schema("archive string").parquet(at).distinct().collect()] if self._any(at) else []
        return {n: f"{at}/in={n}" for n in names}

    def _any(self, path: str) -> bool:
        fs, where = hadoop_path(self.spark, path)
        return any(s.isDirectory() for s in fs.listStatus(where))

    def _commit(self, archives: dict[str, str] | None = None, without: list[str] = (), **tables: DataFrame) -> None:
        state = self._state()
        for name, df in tables.items():
            at = f"{self.root}/{name}/{uuid.uuid4().hex}"
            df.select(*[F.col(f"`{f.split()[0]}`").cast(f.split()[1]) for f in KINDS[name].split(", ")]).write.parquet(at)
            state["tables"][name] = at
        state["archives"] = {k: v for k, v in (state["archives"] | (archives or {})).items() if k not in without}
        self._write_state(state)

    def clear(self) -> None:
        """Deletes the store with all archives."""
        self._forget()
        fs, where = hadoop_path(self.spark, self.root)
        fs.delete(where, True)

    # objects

    def _archive(self, new: DataFrame) -> dict[str, str]:
        """An archive of the rows (ref, type, payload) whose references the store lacks; of equal ones the first by payload."""
        name = uuid.uuid4().hex
        fresh = first_of(new.select("ref", "type", "payload").join(self.table("objects").select("ref"), "ref", "left_anti"), ["ref"])
        rows = fresh.select(F.lit(name).alias("archive"), F.monotonically_increasing_id().alias("seq"), "ref", "type", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("length"), "payload", F.current_timestamp().alias("ts"))
        return self._written(rows)

    def put(self, rows: DataFrame) -> None:
        """Adds objects (ref, type, payload) that the store lacks, as an archive of their own; what it has isn't written again."""
        self._commit(self._archive(rows))
        self._flushed()

    def _flushed(self) -> None:
        if self.compaction and self.compaction.after_flush:
            self.compact()

    def _forget(self) -> None:
        if self.cache is not None:
            self.cache.unpersist()
            self.cache = None

    def get(self, refs: DataFrame) -> DataFrame:
        """ref, type, payload of every reference; null where there is none. With cache, what it holds is read there."""
        stored = self.table("objects").select("ref", "type", "payload")
        if not self.cached:
            return refs.join(stored, "ref", "left")
        if self.cache is None:
            self.cache = objects.cacheable(stored).persist()
        return objects.read_through(refs, self.cache, stored)

    def has(self, refs: DataFrame) -> DataFrame:
        return objects.has(refs, self.table("objects"))

    def missing(self, refs: DataFrame) -> DataFrame:
        return objects.missing(refs, self.table("objects"))

    def delete(self, refs: DataFrame) -> None:
        """Appends tombstones; reads go on to find the objects until they are swept."""
        self._commit(tombstones=insert_if_absent(self.table("tombstones"), objects.tombstones(refs), ["ref"]))

    def walk(self, type_: int = INVALID, load: bool = True) -> DataFrame:
        return objects.walk(self.table("objects"), type_, load)

    def count_objects(self) -> DataFrame:
        return objects.counts(self.table("objects"))

    def list_objects(self, path: str | None = None) -> DataFrame:
        rows = self.table("objects").select("ref").join(self.table("history").select("ref", F.unix_timestamp("timestamp").alias("timestamp"), "set"), "ref", "left")
        return list_objects_csv(rows, path)

    def raw_object(self, ref: str, path: str) -> bool:
        return raw_object(self.table("objects"), ref, path)

    # archives

    def compact(self, force: bool = False, **changes) -> dict | None:
        """Replaces archives below max_size: of each reference one object stays, and none that another archive has; the rest is packed anew.

        Returns what was done, or None if too little was there (force: do it anyway). Old archives are deleted once the new ones are named.
        """
        c = Compaction(**((self.compaction or Compaction()).__dict__ | changes))
        self.compacted = time.monotonic()
        state = self._state()
        entries = self.table("objects")
        slim = entries.drop("payload")
        sizes = durable(slim.groupBy("archive").agg(F.sum("length").cast("long").alias("size")), "sizes")
        chosen = objects.candidates(sizes, c.max_size)
        t = objects.triggered(chosen, c.max_size, c.least).first()
        if not t.n or not (t.run or force):
            return None
        names = [r.archive for r in chosen.select("archive").collect()]
        kept = objects.survivors(slim, chosen)
        if c.collect:
            kept = kept.join(self.reachable(), "ref", "left_semi")
        kept = objects.without_deleted(kept, self.table("tombstones"))
        placed = objects.repack(kept.withColumn("writer", F.pmod(F.xxhash64("ref"), F.lit(c.writers)).cast("int")), c.max_size)
        run = uuid.uuid4().hex
        order = placed.select(F.concat_ws("-", F.lit(run), "writer", "volume").alias("to"), "archive", "seq", "ref")
        new = entries.join(order, ["archive", "seq", "ref"]).select(F.col("to").alias("archive"), "seq", "ref", "type", "length", "payload", "ts").repartition("archive").sortWithinPartitions("archive", "seq")
        archives = self._written(new)
        before = slim.join(chosen.select("archive"), "archive", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
        after = self._archives(list(archives.values())).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
        self._commit(archives, without=names)
        for n in names:
            fs, where = hadoop_path(self.spark, state["archives"][n])
            fs.delete(where, True)
        return {"archives": len(names), "new_archives": len(archives), "objects": before.n, "bytes": before.b, "dropped_objects": before.n - after.n, "dropped_bytes": before.b - after.b}

    def run_if_due(self) -> dict | None:
        """A compaction, if it is periodic and its time has come."""
        if self.compaction and self.compaction.every and time.monotonic() - self.compacted >= self.compaction.every:
            return self.compact()
        return None

    # questions

    def file_info(self, set_: str, path: str, not_after=None, k: int = 10) -> DataFrame:
        rows = versions.in_set(self.table("files"), self.table("sets"), set_).where(F.col("path") == path)
        return versions.newest(versions.as_of(rows, "timestamp", F.lit(not_after or _now())), "timestamp", k, "ref")

    def commit_info(self, set_: str, not_after=None, k: int = 10) -> DataFrame:
        rows = versions.in_set(self.table("commits"), self.table("sets"), set_)
        return versions.newest(versions.as_of(rows, "timestamp", F.lit(not_after or _now())), "timestamp", k, "ref")

    def reachable_commits(self, anchor) -> DataFrame:
        return versions.retained(self.table("commits"), "set_id", "timestamp", F.lit(anchor))

    # snapshots

    def snapshot(self, base: str, set_: str, include: list[str] = (), exclude: list[str] = (), max_chunk: int = chunks.MAX_CHUNK, max_parts: int = chunks.MAX_PARTS) -> str:
        """Stores a folder as a commit of the set and indexes it; files whose time is that of their newest version aren't read again."""
        keep = selected(F.col("path"), list(include), list(exclude))
        found = durable(list_folder(self.spark, base).select(*[f.split()[0] for f in ENTRY.split(", ")]).withColumn("ts", F.date_trunc("second", "ts")).where(F.col("is_dir") | keep), "found")
        files = found.where("not is_dir")
        known = versions.latest_each(versions.in_set(self.table("files"), self.table("sets"), set_), ["path"], "timestamp", "ref").withColumnRenamed("timestamp", "ts")
        state = durable(versions.reusable(files.select("path", "ts"), known.select("path", "ts"), ["path"], "ts").select("path", "state"), "state")
        fresh = state.where("state <> 'same'").select("path")
        root = local_path(base)
        cut = chunks.file_parts(fresh, root, max_chunk) if root is not None else chunks.content_parts(read_folder(self.spark, base).join(fresh, "path"), "path", "content", max_chunk)
        payload = wire.blob_payload(F.col("data"))
        parts = durable(cut.select("path", "part_no", "offset", "length", payload.alias("payload")).withColumn("ref", F.sha1("payload")), "parts")
        refs, file_rows, splits = file_objects(fresh, parts, max_parts)
        refs = refs.unionByName(state.where("state = 'same'").select("path").join(known.select("path", "ref"), "path"))
        whole = durable(files.drop("is_dir").join(refs, "path"), "whole")
        holding = whole.select(F.explode(F.expr("transform(filter(sequence(1, length(path)), i -> substring(path, i, 1) = '/'), i -> substring(path, 1, i - 1))")).alias("path")).distinct()
        folders = found.where("is_dir").drop("is_dir")
        folders = folders.join(holding, "path", "left_semi") if include or exclude else folders
        edges, top, tree_rows = trees.build(whole, folders)
        edges, tree_rows = durable(edges, "edges"), durable(tree_rows, "tree-objects")
        tree, now = top.first()[0], _now()
        commit = durable(commit_payload(self.spark.createDataFrame([(now, tree, set_)], "timestamp timestamp, tree string, set string")), "commit")
        as_type = lambda df, t: df.select("ref", F.lit(t).alias("type"), "payload")
        new = as_type(parts, BLOB).unionByName(as_type(file_rows, FILE)).unionByName(as_type(tree_rows.withColumnRenamed("tree_ref", "ref"), TREE)).unionByName(as_type(commit, COMMIT))
        leaf = chunks.splits(parts.select("path", "part_no", "offset", "length", "ref"), max_parts)
        top_ref = refs.withColumnRenamed("ref", "top")
        of_split = splits.select(F.col("file_ref").alias("top"), "split_no", F.col("ref").alias("leaf"))
        owned = leaf.join(top_ref, "path").join(of_split, ["top", "split_no"], "left").select(F.coalesce("leaf", "top").alias("file_ref"), "part_no", "offset", "length", "ref").distinct()
        history = commit.select("ref", "timestamp", "tree", "set")
        add = lambda t, df, key: insert_if_absent(self.table(t), df.select(*[f.split()[0] for f in KINDS[t].split(", ")]), key)
        self._commit(self._archive(new), parts=add("parts", owned, ["file_ref", "part_no"]), splits=add("splits", splits, ["file_ref", "split_no"]), edges=self._with_edges(edges), history=add("history", history, ["ref"]))
        self._index(history)
        self._flushed()
        return commit.first().ref

    def _with_edges(self, edges: DataFrame) -> DataFrame:
        """The edge table with the trees that it lacks; a tree's edges come together."""
        old = self.table("edges")
        return old.unionByName(edges.join(old.select("tree_ref").distinct(), "tree_ref", "left_anti").select(*old.columns))

    def _index(self, commits: DataFrame) -> None:
        index = {t: self.table(t) for t in ("sets", "commits", "trees", "files")}
        self._commit(**index_commits(index, commits, self.table("edges")))

    def reindex(self) -> None:
        """Indexes every stored commit that the index lacks."""
        self._index(self.table("history"))

    def _tree(self, set_: str, not_after, path: str) -> DataFrame:
        commit = self.commit_info(set_, not_after, 1).first()
        if commit is None:
            raise LookupError(f"no commit of {set_!r}")
        edges = self.table("edges")
        at = durable(trees.lookup(edges, self.spark.createDataFrame([(commit.tree,)], "ref string"), path), "root")
        if at.isEmpty():
            raise LookupError(f"no folder {path!r}")
        return trees.traverse(edges, at.select("ref"))

    def _pieces(self, files: DataFrame) -> DataFrame:
        """files (path, ref and more) with part_no, offset, length and data of each part; a missing blob is zeros, an empty file has one row of nulls."""
        leaves = files.join(self.table("splits").select(F.col("file_ref").alias("ref"), F.col("ref").alias("leaf")), "ref", "left").withColumn("leaf", F.coalesce("leaf", "ref")).drop("ref")
        parts = self.table("parts").select(F.col("file_ref").alias("leaf"), "part_no", "offset", "length", "ref")
        blobs = self.table("objects").where(F.col("type") == BLOB).select("ref", "payload")
        zeros = F.when(F.col("length").isNotNull(), F.repeat(F.lit("\0"), F.col("length").cast("int")).cast("binary"))
        data = F.coalesce(wire.blob_tail(F.col("payload"), F.col("length")), zeros)
        return leaves.join(parts, "leaf", "left").join(blobs, "ref", "left").withColumn("data", data).drop("payload", "ref", "leaf")

    def restored(self, set_: str, not_after=None, path: str = "") -> DataFrame:
        """path, mode, user, group, ts, size, content of the files of the newest commit as of a time, below a folder. For files beyond 2 GB see restore."""
        stat = list(trees.STAT)
        rows = self._pieces(self._tree(set_, not_after, path).where("not is_tree").select("path", "ref", *stat))
        pieces = F.array_sort(F.collect_list(F.when(F.col("part_no").isNotNull(), F.struct("part_no", F.base64("data").alias("d")))))
        empty = F.unhex(F.lit(""))
        content = F.coalesce(F.aggregate("p", empty, lambda a, x: F.concat(a, F.unbase64(x["d"]))), empty)
        return rows.groupBy("path", *stat).agg(pieces.alias("p")).select("path", *stat, content.alias("content"))

    def restore(self, set_: str, to: str, not_after=None, path: str = "") -> None:
        """Writes the newest commit as of a time below a folder: files and folders with their modes and times."""
        nodes = durable(self._tree(set_, not_after, path), "nodes")
        restore(self._pieces(nodes.where("not is_tree").select("path", "ref", "mode", "ts")), to, nodes.where("is_tree").select("path", "mode", "ts"))

    def restore_before(self, set_: str, to: str, ago: str, path: str = "") -> None:
        self.restore(set_, to, _now() - age(ago), path)

    def restore_file(self, set_: str, path: str, to: str, not_after=None) -> None:
        """Writes the newest version of one file as of a time, found in the index, to a path."""
        found = self.file_info(set_, path, not_after, 1).first()
        if found is None:
            raise LookupError(f"no file {path!r} of {set_!r}")
        folder, _, name = to.rpartition("/")
        one = self.spark.createDataFrame([(name, found.ref, found.mode, found.timestamp)], "path string, ref string, mode long, ts timestamp")
        restore(self._pieces(one), folder or ".")

    # collection

    def reachable(self) -> DataFrame:
        """References that commits lead to."""
        edge = lambda t, a, b: self.table(t).select(F.col(a).alias("src"), F.col(b).alias("dst"))
        edges = edge("history", "ref", "tree").unionByName(edge("edges", "tree_ref", "child_ref").where("dst is not null")).unionByName(edge("splits", "file_ref", "ref")).unionByName(edge("parts", "file_ref", "ref"))
        return trees.reachable(self.table("history").select("ref"), edges)

    def sweep(self) -> int:
        """Packs all archives anew without what no commit leads to or a tombstone names; returns how many objects went."""
        done = self.compact(force=True, max_size=1 << 62, collect=True)
        return done["dropped_objects"] if done else 0


def _now() -> datetime:
    return datetime.fromtimestamp(time.time(), timezone.utc)
