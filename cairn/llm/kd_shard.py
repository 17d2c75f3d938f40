"""Sharding by a k-d tree over document metadata (DataFrame operations only).

A document is a point of text metadata: its bytes, its bytes beyond ASCII and
its lines, each made a strict order by the text's hash.  A node is split along
the dimension in which it is widest (relative to the whole table) at the point
that divides its bytes in proportion to the shards on either side.  That
weighted median comes from a histogram that every task pre-aggregates and that
is refined around the median, so only (nodes x bins) sums reach the driver.

Defined results: null text counts as no bytes; a null ``doc_id`` is a document
like any other; repeated rows each get a slot; equal texts share a shard unless
their group holds more than ``group_share`` of a shard, in which case the split
that meets the group cuts it by row; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.store import pick, stored

DIMENSIONS = ("bytes", "wide", "lines")
TOP = 1 << 62
SUB_BITS = 30


@dataclass
class Node:
    first: int
    leaves: int
    dim: str = ""
    key: int = 0
    sub: int = 0
    left: "Node | None" = None
    right: "Node | None" = None

    def leaf(self, level: int = 99) -> Column:
        """The first shard of the node, at most level splits down, that holds a row."""
        if self.left is None or not level:
            return F.lit(self.first)
        below = F.col(self.dim) < self.key
        if self.sub:
            below = below | ((F.col(self.dim) == self.key) & (F.col("sub") < self.sub))
        return F.when(below, self.left.leaf(level - 1)).otherwise(self.right.leaf(level - 1))


def points(docs: DataFrame) -> DataFrame:
    """A slim row for each document: no text, one order-preserving key for each dimension."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = pick(docs, doc_id="long", text="string").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND((1 << 32) - 1).alias("tie"),
        (F.octet_length(text) - F.char_length(text)).cast("long").alias("w"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long").alias("n"),
        F.monotonically_increasing_id().alias("row"),
    )
    key = lambda c: F.shiftleft(F.least(F.col(c), F.lit((1 << 30) - 1)), 32).bitwiseOR(F.col("tie"))
    sub = F.pmod(F.xxhash64("row"), F.lit(1 << SUB_BITS))
    return slim.select("doc_id", "size", "text_crc32", "row", key("size").alias("bytes"), key("w").alias("wide"), key("n").alias("lines"), sub.alias("sub"))


def medians(pts: DataFrame, asked: dict[int, tuple[str, int, int, float]], node: Column, bins: int, near: float) -> dict[int, tuple[int, float, float]]:
    """For each node {id: (dim, low, high, bytes wanted below)}: (key, bytes below it, bytes of the key's bin).

    Each round sums bytes by bin over all rows, then looks closer at the bin that holds the wanted point.
    """
    done: dict[int, tuple[int, float, float]] = {}
    spans = {k: (dim, lo, hi, 0.0, want) for k, (dim, lo, hi, want) in asked.items()}
    while spans:
        width = {k: max(1, -(-(hi - lo) // bins)) for k, (_, lo, hi, _, _) in spans.items()}
        of = lambda values: F.coalesce(*[F.when(F.col("node") == k, v) for k, v in values.items()])
        at = pts.withColumn("node", node).select(
            "node", "size",
            of({k: F.col(x[0]) for k, x in spans.items()}).alias("v"),
            *[of({k: F.lit(y).cast("long") for k, y in v.items()}).alias(n) for n, v in (("lo", {k: x[1] for k, x in spans.items()}), ("hi", {k: x[2] for k, x in spans.items()}), ("width", width))],
        )
        sums = at.where("v >= lo and v < hi").groupBy("node", F.expr("(v - lo) div width").alias("bin")).agg(F.sum("size").alias("b"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        for k, (dim, lo, hi, below, want) in list(spans.items()):
            own = sorted((r.bin, r) for r in sums if r.node == k)
            for _, r in own[:-1]:
                if below + r.b >= want:
                    break
                below += r.b
            else:
                r = own[-1][1]
            if r.least == r.most:
                done[k] = (r.least, below, r.b)
            elif r.b <= near * want:
                done[k] = (r.least, below, 0) if want - below <= below + r.b - want else (r.most + 1, below + r.b, 0)
            else:
                spans[k] = (dim, r.least, r.most + 1, below, want)
            if k in done:
                del spans[k]
    return done


def grow(pts: DataFrame, n_shards: int, bins: int, near: float, group_share: float) -> Node:
    """The tree, a level at a time."""
    root = Node(0, n_shards)
    whole, level, open_nodes = None, 0, [root] if n_shards > 1 else []
    while open_nodes:
        node = root.leaf(level)
        seen = {r.node: r for r in pts.groupBy(node.alias("node")).agg(F.sum("size").alias("b"), *[f(c).alias(f"{c}_{n}") for c in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        if not seen:
            return root
        whole = whole or {c: max(1, (seen[0][f"{c}_hi"] >> 32) - (seen[0][f"{c}_lo"] >> 32)) for c in DIMENSIONS}
        total = sum(r.b for r in seen.values())
        asked = {}
        for x in open_nodes:
            if r := seen.get(x.first):
                dim = max(DIMENSIONS, key=lambda c: ((r[f"{c}_hi"] >> 32) - (r[f"{c}_lo"] >> 32)) / whole[c])  # noqa: B023
                asked[x.first] = (dim, r[f"{dim}_lo"], r[f"{dim}_hi"] + 1, r.b * (x.leaves // 2) / x.leaves)
        found = medians(pts, asked, node, bins, near)
        heavy = {}
        for x in open_nodes:
            if x.first not in asked:
                continue
            x.dim, (x.key, below, group) = asked[x.first][0], found[x.first]
            want = asked[x.first][3]
            if group > group_share * total / n_shards:
                heavy[x.first] = (x, want - below)
            elif group and want - below > below + group - want:
                x.key += 1
        if heavy:
            is_in = F.lit(False)
            for x, _ in heavy.values():
                is_in = is_in | ((node == x.first) & (F.col(x.dim) == x.key))
            cuts = medians(pts.where(is_in), {k: ("sub", 0, 1 << SUB_BITS, want) for k, (_, want) in heavy.items()}, node, bins, near)
            for k, (x, _) in heavy.items():
                x.sub = cuts[k][0]
        split, open_nodes = open_nodes, []
        for x in split:
            if x.first in asked:
                half = x.leaves // 2
                x.left, x.right = Node(x.first, half), Node(x.first + half, x.leaves - half)
                open_nodes += [y for y in (x.left, x.right) if y.leaves > 1]
        level += 1
    return root


def numbered(rows: DataFrame, by: str, n_buckets: int) -> DataFrame:
    """slot: gapless from 0 in each value of by; rows are dealt to (by, bucket), so no task holds all of one value."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(n_buckets)))
    counts = dealt.groupBy(by, "bucket").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select(by, "bucket", (F.sum("n").over(Window.partitionBy(by).orderBy("bucket")) - F.col("n")).alias("first"))
    in_bucket = dealt.withColumn("k", F.row_number().over(Window.partitionBy(by, "bucket").orderBy("doc_id", "row")) - 1)
    return in_bucket.join(first, [by, "bucket"]).withColumn("slot", F.col("first") + F.col("k"))


def kd_shards(docs: DataFrame, n_shards: int = 16, *, bins: int = 4096, near: float = 0.002, group_share: float = 0.1, n_buckets: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards of nearly equal bytes.

    bins and near steer the histogram: a median is settled once its bin holds no more than near of the bytes below it.
    n_buckets: tasks that number the slots of one shard.
    """
    pts = stored(points(docs), "kd-points")
    tree = grow(pts, n_shards, bins, near, group_share)
    return numbered(pts.withColumn("shard", tree.leaf().cast("int")), "shard", n_buckets).select("doc_id", "size", "text_crc32", "shard", "slot")


def op10_kd_shard(spark, sf_dir: str) -> DataFrame:
    """All of documents in 16 shards of nearly equal bytes."""
    from cairn.llm.store import table

    out = kd_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
