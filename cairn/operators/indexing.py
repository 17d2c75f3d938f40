"""Indexing of commits: new trees are traversed, files and trees are inserted if absent, the commit last."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.state import get_or_create, insert_if_absent
from cairn.operators.trees import STAT, traverse
from cairn.plans.durable import durable
from cairn.schemas import KEYS


def complete(placed: DataFrame, roots: DataFrame, edges: DataFrame, known: DataFrame) -> DataFrame:
    """roots whose every sub-tree is there: has edges, is an entry (ref, null name), or is known (ref, path and the roots' further columns)."""
    more = [c for c in roots.columns if c != "ref"]
    entered = placed.where("is_tree").select("root", *more, "path", "ref").unionByName(roots.select(F.col("ref").alias("root"), *more, F.lit("").alias("path"), "ref"))
    there = edges.select(F.col("tree_ref").alias("ref")).distinct()
    lost = entered.join(known, [c for c in known.columns if c in entered.columns], "left_anti").join(there, "ref", "left_anti")
    return roots.join(lost.select(F.col("root").alias("ref"), *more).distinct(), ["ref", *more], "left_anti")


def index_commits(index: dict[str, DataFrame], commits: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The index (sets, commits, trees, files) with commits (ref, timestamp, tree, set) that it lacks.

    edges: the edge table with what its nodes tell of files (STAT; what is absent is null). A version of a file is its path
    and time in a set. Sub-trees that the index has at the same path aren't entered again; as a tree's reference covers the
    times below it, a touched file makes them new. A commit with a sub-tree that isn't there is left out, so that it is
    indexed once the tree has come. With all commits this is a rebuild.
    """
    edges = edges.select(*edges.columns, *[F.lit(None).cast(k).alias(c) for c, k in STAT.items() if c not in edges.columns])
    new = commits.join(index["commits"].select("ref"), "ref", "left_anti")
    sets = durable(get_or_create(index["sets"], new.select(F.col("set").alias("name"))), "sets")
    # sets: a dimension of names
    new = durable(new.join(F.broadcast(sets.select(F.col("id").alias("set_id"), F.col("name").alias("set"))), "set"), "commits")
    roots = new.select(F.col("tree").alias("ref"), "set_id").distinct()
    known = index["trees"].select("ref", "path", "set_id")
    placed = traverse(edges, roots, skip=known)
    whole = durable(complete(placed, roots, edges, known), "whole")
    new = new.join(whole.withColumnRenamed("ref", "tree"), ["tree", "set_id"], "left_semi")
    placed = placed.join(whole.withColumnRenamed("ref", "root"), ["root", "set_id"], "left_semi")
    trees = placed.where("is_tree").select("ref", "path", "set_id")
    files = placed.where(~F.col("is_tree")).select("path", F.col("ts").alias("timestamp"), "set_id", "ref", "mode", "user", "group", "size")
    return {
        "sets": sets,
        "commits": index["commits"].unionByName(new.select("ref", "timestamp", "tree", "set_id")),
        "trees": insert_if_absent(index["trees"], trees, KEYS["trees"]),
        "files": insert_if_absent(index["files"], files.select(*index["files"].columns), KEYS["files"]),
    }
