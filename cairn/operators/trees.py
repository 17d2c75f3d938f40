"""Trees: traversal, path lookup, construction, reachability.

An edge table has tree_ref, name, is_tree and child_ref; further columns, such
as a node's mode and time, go with the node.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import wire
from cairn.plans.durable import durable, reread

#: Levels below which a tree is taken to be broken (a tree that holds itself).
MAX_DEPTH = 1000
#: What a node tells of its file or folder: mode, owner, group, seconds, bytes.
STAT = {"mode": "long", "user": "string", "group": "string", "ts": "timestamp", "size": "long"}


class MissingTree(LookupError):
    """A sub-tree that an edge names isn't there."""


def traverse(edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH, skip: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """root, path, is_tree, ref, depth and the edges' further columns of every node below the roots (column ref, and what else tells them apart).

    A level at a time: the frontier joins the edges and is written once, so no plan grows with the depth.
    skip (ref, path, and any of the roots' further columns): sub-trees that are named but not entered.
    A sub-tree without edges is empty; strict: it is an error unless it is an entry of its own in edges as (ref, null name).
    A frontier that isn't empty after max_depth levels is an error.
    """
    spark, key = edges.sparkSession, ("tree_ref", "name", "is_tree", "child_ref")
    stat = [c for c in edges.columns if c not in key]
    by_tree = edges.where("name is not null").select(F.col("tree_ref").alias("of"), "name", "is_tree", F.col("child_ref").alias("ref"), *stat)
    more = [c for c in roots.columns if c not in ("ref", "root")]
    front = roots.select(F.col("ref").alias("root"), *more, F.lit("").alias("path"), F.lit(True).alias("is_tree"), "ref")
    levels: list[str] = []
    path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name"))
    for depth in range(1, max_depth + 2):
        into = front.where("is_tree")
        if skip is not None:
            into = into.join(skip, [c for c in skip.columns if c in ("ref", "path", *more)], "left_anti")
        if strict and (lost := into.join(edges.select(F.col("tree_ref").alias("ref")), "ref", "left_anti").first()):
            raise MissingTree(f"no tree {lost.ref} at {lost.path or '/'}")
        front = durable(into.select("root", *more, "path", F.col("ref").alias("of")).join(by_tree, "of").select("root", *more, path.alias("path"), "is_tree", "ref", *stat, F.lit(depth).alias("depth")), "level")
        if front.isEmpty():
            return reread(spark, front, levels) if levels else front
        if depth > max_depth:
            raise ValueError(f"trees go on below {max_depth} levels")
        levels += front.stored_at
    raise AssertionError


def lookup(edges: DataFrame, roots: DataFrame, path: str) -> DataFrame:
    """root, ref of the sub-tree at a path: one join for each of its names; no row where a name isn't a tree."""
    at = roots.select(F.col("ref").alias("root"), "ref")
    for name in [p for p in path.split("/") if p]:
        step = edges.where((F.col("name") == name) & F.col("is_tree")).groupBy(F.col("tree_ref").alias("ref")).agg(F.min("child_ref").alias("child"))
        at = at.join(step, "ref").select("root", F.col("child").alias("ref"))
    return at


def listing(nodes: DataFrame) -> DataFrame:
    """Sub-trees before files, then by name, bytewise."""
    return nodes.orderBy("tree_ref", F.col("is_tree").desc(), "name")


def tree_objects(folders: DataFrame) -> DataFrame:
    """Adds payload, the wire form of each folder's nodes (name, is_tree, ref in hex, stat), and tree_ref, its SHA-1 in hex."""

    def work(batches):
        for b in batches:
            out = []
            for nodes in b.column("nodes").to_pylist():
                stat = [{"name": n["name"], "mode": n["mode"] or 0, "user": n["user"] or "", "group": n["group"] or "", "timestamp": int(n["ts"].timestamp()) if n["ts"] else 0, "size": n["size"] or 0, "tree": n["is_tree"]} for n in nodes]
                out.append(wire.tree_object([(s, bytes.fromhex(n["ref"])) for s, n in zip(stat, nodes, strict=True)]))
            refs = [wire.object_ref(x).hex() for x in out]
            yield pa.record_batch([*b.columns, pa.array(out, pa.binary()), pa.array(refs, pa.string())], [*b.schema.names, "payload", "tree_ref"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in folders.schema)
    return folders.mapInArrow(work, f"{kinds}, payload binary, tree_ref string")


def build(files: DataFrame, folders: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, root, trees) over files (path, ref in hex, and any of STAT) and what is known of folders (path and any of STAT).

    Bottom up, a level at a time. A tree is the wire form of its nodes, sub-trees before files and then by name, with what is
    known of each, so a touched file gives its folders new references and equal trees are one. Folders without files are
    there if they are named; an empty tree has one edge, of null name. root has the top tree's ref; trees has tree_ref and payload.
    """
    spark = files.sparkSession
    known = lambda df: [(F.col(c) if df is not None and c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in STAT.items()]
    leaves = files.select("path", "ref", F.lit(False).alias("is_tree"), *known(files))
    named = (spark.createDataFrame([], "path string") if folders is None else folders).where("path <> ''")
    named = named.select("path", *known(folders))
    depth = F.size(F.split("path", "/"))
    deepest = max(leaves.agg(F.max(depth)).first()[0] or 0, (named.agg(F.max(depth)).first()[0] or -1) + 1)
    nodes, levels, root = leaves, [], files.select("ref").limit(0)
    order = F.transform(F.array_sort(F.collect_list(F.struct((~F.col("is_tree")).alias("later"), F.encode("name", "UTF-8").alias("by"), F.struct("name", "is_tree", "ref", *STAT).alias("n")))), lambda x: x["n"])
    parent, name = F.regexp_extract("path", "^(?:(.*)/)?([^/]*)$", 1), F.regexp_extract("path", "([^/]*)$", 1)
    empty = F.expr("cast(array() as array<struct<name:string,is_tree:boolean,ref:string,mode:bigint,user:string,group:string,ts:timestamp,size:bigint>>)")
    for level in range(deepest, 0, -1):
        here, nodes = nodes.where(depth == level), nodes.where(depth < level)
        own = here.where("ref is not null").select(parent.alias("parent"), name.alias("name"), "is_tree", "ref", *STAT)
        full = own.groupBy("parent").agg(order.alias("nodes"))
        if level > 1:  # folders of this level's parents that hold nothing
            bare = named.where(depth == level - 1).select(F.col("path").alias("parent")).join(full.select("parent"), "parent", "left_anti")
            full = full.unionByName(bare.select("parent", empty.alias("nodes")))
        trees = durable(tree_objects(full), "trees")
        levels += trees.stored_at
        if level > 1:
            up = trees.select(F.col("parent").alias("path"), F.col("tree_ref").alias("ref"), F.lit(True).alias("is_tree")).join(named, "path", "left")
            nodes = nodes.unionByName(up.select("path", "ref", "is_tree", *STAT))
        else:
            root = trees.select(F.col("tree_ref").alias("ref"))
    if not levels:
        trees = durable(tree_objects(spark.createDataFrame([("",)], "parent string").select("parent", empty.alias("nodes"))), "trees")
        levels, root = trees.stored_at, trees.select(F.col("tree_ref").alias("ref"))
    every = reread(spark, trees, levels).groupBy("tree_ref").agg(F.first("nodes").alias("nodes"), F.first("payload").alias("payload"))
    edges = every.select("tree_ref", F.explode_outer("nodes").alias("n")).select("tree_ref", "n.name", "n.is_tree", F.col("n.ref").alias("child_ref"), *[f"n.{c}" for c in STAT])
    return edges, root, every.select("tree_ref", "payload")


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """ref of everything that edges (src, dst) lead to from roots, roots included; each ref is entered once.

    Each level is written once; what was seen is all levels together.
    """
    front = durable(roots.select("ref").distinct(), "marked")
    levels = list(front.stored_at)
    while True:
        seen = reread(edges.sparkSession, front, levels)
        if front.isEmpty():
            return seen
        front = durable(front.join(edges, front.ref == edges.src).select(F.col("dst").alias("ref")).distinct().join(seen, "ref", "left_anti"), "marked")
        levels += front.stored_at


def unreachable(objects: DataFrame, marked: DataFrame) -> DataFrame:
    return objects.join(marked, "ref", "left_anti")
