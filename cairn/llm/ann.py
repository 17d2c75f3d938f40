"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``sample`` rows of least hashed id);
every row descends it to one leaf.  Vectors are extended by one component so
that the largest inner product is the least distance.  A query walks the tree
best bin first: a priority queue holds the nodes seen so far by the distance to
their centres, so leaves come out in the order in which they promise most.
How many leaves to visit is widened until calibration queries, searched
exactly against all rows, reach ``recall``; a query whose leaves hold fewer than k
other rows of the whole table visits further ones.

The sample bounds the tree's leaves, so those of a very large table grow with it.
A leaf of more than ``GROWN`` times its size gets a tree of its own, fitted on a
sample of its rows by one task, three times over if need be; leaf, rows and queries
meet in parts of bounded size, and visits within such leaves are calibrated in
the same way.  So a query's work follows leaves visited, not rows.

Leaves are cut into blocks of bounded size and so are the queries that visit
one; each (leaf, block, group of queries) is a task's product of two small
matrices, of which the best k for each query leave.

Of equal vectors only the k + 1 smallest ids are searched, as no other can be
among a query's k best; so one vector in very many rows makes no leaf large.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do rows without an id;
rows that repeat a query's id are its own; a query id searches once, with its least vector; repeated
candidates each count; ties go to the smaller id; with fewer candidates than k
all are returned; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.store import maybe_broadcast, stored, table

K, EVERY = 20, 20
SAMPLE, LEAF, BRANCH, CALIBRATE, RECALL, BLOCK = 20_000, 1024, 8, 200, 0.97, 4096
#: How many times its size a leaf may be; bits of a leaf's number for each tree above it; trees below the first at most.
GROWN, BITS, LEVELS = 4, 16, 3


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part."""
    fine = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    most = fine.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return fine.where(F.size("v") == (most.d if most else 0))


def candidates(fine: DataFrame, k: int) -> DataFrame:
    """The rows of the k + 1 smallest ids of each vector, k of an id at most. They are chosen in each task before they are dealt."""
    each = fine.groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies")).withColumn("h", F.xxhash64("v"))
    place = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    return each.withColumn("place", place).where(F.col("place") <= k + 1).select("vec_id", "v", F.explode(F.expr("array_repeat(0, copies)"))).select("vec_id", "v")


def array(column, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Tree:
    """Centres of nodes in levels of children; leaves are numbered in the order they were made."""

    def __init__(self, x: np.ndarray, n_rows: int, leaf: int = LEAF, branch: int = BRANCH, seed: int = 1):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []  # a node's index, or ~leaf
        self.n_leaves, self.rng = 0, np.random.default_rng(seed)
        self.root = self.grow(x, max(8.0, len(x) / (1 << BITS), leaf * len(x) / max(n_rows, 1)), branch)
        del self.rng

    def grow(self, x: np.ndarray, most: float, branch: int) -> int:
        groups = self.split(x, branch) if len(x) > most else None
        if not groups or len(groups) < 2:
            self.n_leaves += 1
            return ~(self.n_leaves - 1)
        at = len(self.centres)
        self.centres.append(np.array([g.mean(0) for g in groups]))
        self.children.append([])
        self.children[at] = [self.grow(g, most, branch) for g in groups]
        return at

    def split(self, x: np.ndarray, branch: int) -> list[np.ndarray]:
        centres = np.unique(x[self.rng.choice(len(x), min(branch, len(x)), replace=False)], axis=0)
        near = np.zeros(len(x), int)
        for _ in range(12):
            near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
            centres = np.array([x[near == c].mean(0) if (near == c).any() else m for c, m in enumerate(centres)])
        return [x[near == c] for c in range(len(centres)) if (near == c).any()]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Where rows descend to."""
        out, todo = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
                continue
            c = self.centres[node]
            near = ((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node]) if (near == k).any()]
        return out

    def visits(self, q: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves of a best-bin-first walk; given the leaves' sizes, as many more as hold least rows."""
        queue, out, held = [(0.0, self.root)], [], 0
        while queue and (len(out) < most or sizes is not None and held < least):
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(~node)
                held += 0 if sizes is None else int(sizes[~node])
                continue
            c = self.centres[node]
            for far, child in zip((((c - q) ** 2).sum(1)).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (far, child))
        return out


def extended(x: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))])


def best(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None):
    """(query row, id, score) of each query's k best rows, of those that reach its least; scores are summed in one order, so equal vectors tie."""
    rough, q_out, id_out, s_out = queries @ x.T, [], [], []
    rough[own[:, None] == ids[None, :]] = -np.inf
    for r, (row, q) in enumerate(zip(rough, queries, strict=True)):
        near = np.flatnonzero(row >= (-1e300 if least is None else least[r]))
        if len(near) > k:
            last = np.partition(row, len(row) - k)[len(row) - k]
            near = near[row[near] >= last - 1e-9 * max(1.0, abs(last))]
        score = (x[near] * q).sum(1)
        order = np.lexsort((ids[near], -score))[:k]
        q_out += [r] * len(order)
        id_out.append(ids[near][order])
        s_out.append(score[order])
    return np.array(q_out, np.int64), np.concatenate(id_out or [np.zeros(0, np.int64)]), np.concatenate(s_out or [np.zeros(0)])


FOUND = "query_id long, vec_id long, score double"


def found(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, s: np.ndarray):
    return [pa.array(query_ids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(s, pa.float64())]


def ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The k best of all rows for a bounded set of queries, in blocks."""
    d = queries.shape[1]

    def run(batches):
        for b in batches:
            got = best(queries, b.column("vec_id").to_numpy(), array(b.column("v"), d), query_ids, k)
            yield pa.record_batch(found(query_ids, *got), ["query_id", "vec_id", "score"])

    return ranked(rows.mapInArrow(run, FOUND), k)


def widened(need: np.ndarray, most: int, recall: float) -> int:
    """The least number of visits that reaches this share of the needed ones."""
    visits, need = 1, np.sort(need)
    while visits < most and len(need) and np.searchsorted(need, visits, "right") < recall * len(need):
        visits += 1
    return visits


def calibrated(truth: DataFrame, tree: Tree, norm: float, ids: np.ndarray, x: np.ndarray, recall: float) -> int:
    """Leaves to visit: widened until the calibration queries' true neighbours (query_id, v) are among the visited ones' rows."""
    wanted: dict[int, list[int]] = defaultdict(list)
    for r in truth.select("query_id", "v").collect():
        wanted[r.query_id].append(int(tree.leaves(extended(np.array([r.v]), norm))[0]))
    rank = {i: {leaf: n for n, leaf in enumerate(tree.visits(np.append(q, 0.0), tree.n_leaves))} for i, q in zip(ids.tolist(), x, strict=True)}
    return widened(np.array([rank[i][leaf] + 1 for i, leaves in wanted.items() for leaf in leaves]), tree.n_leaves, recall)


def place_truth(tree: Tree, norm: float, d: int):
    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column("query_id"), b.column("vec_id"), pa.array(tree.leaves(extended(array(b.column("v"), d), norm)))], ["query_id", "vec_id", "leaf"])

    return run


def large_leaves(placed: DataFrame, leaf: int) -> DataFrame:
    return placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROWN * leaf)


def refined(placed: DataFrame, asked: DataFrame, truth: DataFrame, norm: float, d: int, k: int, sample: int, leaf: int, recall: float, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, asked, truth) with the leaves of large ones in their place. truth: query_id, vec_id, leaf of calibration queries, which asked has as well.

    A tree is fitted on about sample rows of its leaf; it goes with its leaf's rows, and with the queries that visit it,
    in parts of about block rows.
    """
    large = stored(large_leaves(placed, leaf), "ann-large")
    some = placed.join(maybe_broadcast(large), "leaf").where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 30)) < F.lit(float(sample << 30)) / F.col("n"))

    def fit(rows: pa.Table) -> pa.Table:
        x = extended(array(rows.column("v"), d), norm)
        tree = Tree(x[:: -(-len(x) // (8 << BITS))], rows.column("n")[0].as_py(), leaf)
        return pa.table([rows.column("leaf").slice(0, 1), rows.column("n").slice(0, 1), pa.array([pickle.dumps(tree)], pa.binary())], ["leaf", "n", "tree"])

    trees = stored(some.groupBy("leaf").applyInArrow(fit, "leaf long, n long, tree binary"), "ann-trees")
    trees = trees.withColumn("parts", F.ceil(F.col("n") / block).cast("long"))
    narrow = maybe_broadcast(stored(trees.select("leaf", "parts"), "ann-parts"))
    in_parts = trees.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1L)")))
    deal = lambda df, key: df.join(narrow, "leaf").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts"))).drop("parts")
    number = lambda below: (F.col("leaf") * (1 << BITS) + below).alias("leaf")

    def descend(t: pa.Table, rows: pa.Table) -> pa.Table:
        if not t.num_rows or not rows.num_rows:
            return rows.slice(0, 0).select(["leaf", "vec_id", "v"]).append_column("below", pa.array([], pa.int64()))
        below = pickle.loads(t.column("tree")[0].as_py()).leaves(extended(array(rows.column("v"), d), norm))
        return rows.select(["leaf", "vec_id", "v"]).append_column("below", pa.array(below, pa.int64()))

    kind = "leaf long, vec_id long, v array<double>, below long"
    sunk = stored(in_parts.select("leaf", "part", "tree").groupBy("leaf", "part").cogroup(deal(placed, "vec_id").groupBy("leaf", "part")).applyInArrow(descend, kind), "ann-placed")
    sizes = sunk.groupBy("leaf", "below").agg(F.count(F.lit(1)).alias("m")).groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("below", "m"))).alias("sizes"))
    sized = stored(in_parts.join(sizes, "leaf").select("leaf", "part", "tree", "sizes"), "ann-sized")

    def ordered(t: pa.Table, rows: pa.Table, most: int | None) -> pa.Table:
        """Each query's leaves of the tree, best first: all of them, or most and as many more as hold k other rows."""
        out: list[tuple] = []
        if t.num_rows and rows.num_rows:
            tree, held = pickle.loads(t.column("tree")[0].as_py()), dict(t.column("sizes")[0].as_py())
            held = np.array([held.get(x, 0) for x in range(tree.n_leaves)])
            for i, copies, q in zip(rows.column("query_id").to_pylist(), rows.column("copies").to_pylist(), array(rows.column("q"), d), strict=True):
                out.append((rows.column("leaf")[0].as_py(), i, tree.visits(np.append(q, 0.0), tree.n_leaves if most is None else most, held, k + copies)))
        cols = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["leaf", "query_id", "to"])

    def visited(rows: DataFrame, most: int | None) -> DataFrame:
        meet = sized.groupBy("leaf", "part").cogroup(deal(rows, "query_id").select("leaf", "part", "query_id", "copies", "q").groupBy("leaf", "part"))
        return meet.applyInArrow(lambda t, r: ordered(t, r, most), "leaf long, query_id long, to array<long>")

    lost = truth.join(sunk.select("leaf", "vec_id", "below"), ["leaf", "vec_id"], "left")
    wanted = lost.where("below is not null")
    every = visited(asked.join(truth.select("query_id").distinct(), "query_id", "left_semi"), None)
    need = wanted.join(every, ["leaf", "query_id"]).select(F.array_position("to", F.col("below")).alias("need")).collect()
    most = widened(np.array([r.need for r in need]), 1 << BITS, recall)
    to = visited(asked, most).select("leaf", "query_id", F.explode("to").alias("below"))
    on = stored(asked.join(to, ["leaf", "query_id"], "left").select(number(F.coalesce("below", F.lit(0))), "query_id", "copies", "least", "q"), "ann-queries")
    rest = placed.join(narrow, "leaf", "left_anti").select(number(F.lit(0)), "vec_id", "v")
    down = stored(rest.unionByName(sunk.select(number(F.col("below")), "vec_id", "v")), "ann-leaves")
    return down, on, stored(lost.select("query_id", "vec_id", number(F.coalesce("below", F.lit(0)))), "ann-truth")


def search(embeddings: DataFrame, every: int = EVERY, k: int = K, sample: int = SAMPLE, leaf: int = LEAF, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by every."""
    fine = stored(vectors(embeddings), "ann-vectors")
    rows, spark = stored(candidates(fine, k), "ann-candidates"), fine.sparkSession
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = rows.select(F.max(F.expr("sqrt(aggregate(v, 0D, (a, y) -> a + y * y))"))).first()[0]
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    ids, x = np.array([r.vec_id for r in got]), np.array([r.v for r in got])
    d = x.shape[1]
    tree = Tree(extended(x, norm), n, leaf)
    ids, at = np.unique(ids, return_index=True)
    some = at[np.random.default_rng(2).permutation(len(at))[:CALIBRATE]]
    asked_ids, asked_x = np.array([r.vec_id for r in got])[some], x[some]
    truth = stored(exact(rows, asked_ids, asked_x, k).join(rows, "vec_id").select("query_id", "vec_id", "v"), "ann-truth")

    def place(batches):
        for b in batches:
            yield pa.record_batch([pa.array(tree.leaves(extended(array(b.column("v"), d), norm))), b.column("vec_id"), b.column("v")], ["leaf", "vec_id", "v"])

    placed_kind = "leaf long, vec_id long, v array<double>"
    placed = stored(rows.mapInArrow(place, placed_kind), "ann-leaves")
    held = np.zeros(tree.n_leaves, np.int64)
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():
        held[r.leaf] = r.n
    grown = bool((held > GROWN * leaf).any())
    # what is lost at two levels is lost twice
    goal = recall**0.5 if grown else recall
    visits = calibrated(truth, tree, norm, asked_ids, asked_x, goal)
    sample_ids, sample_x, sample_leaves = np.array([r.vec_id for r in got]), x.astype(np.float32), tree.leaves(extended(x, norm))

    def least(q: np.ndarray, i: int, to: list[int]) -> float:
        """What the k-th best of the sample's rows in the visited leaves scores, so the k-th best of all rows there reaches it; less what rounding may take. Nothing, if parts of leaves will be visited."""
        if grown:
            return -1e300
        seen = np.zeros(tree.n_leaves, bool)
        seen[to] = True
        s = (sample_x @ q.astype(np.float32))[seen[sample_leaves] & (sample_ids != i)]
        return float(np.partition(s, len(s) - k)[len(s) - k]) - 1e-5 * norm**2 if len(s) >= k else -1e300

    def walk(batches):
        for b in batches:
            for q, i, v, copies in zip(array(b.column("v"), d), b.column("vec_id").to_pylist(), b.column("v"), b.column("copies").to_pylist(), strict=True):
                to = tree.visits(np.append(q, 0.0), visits, held, k + copies)
                n_to = len(to)
                yield pa.record_batch([pa.array(to, pa.int64()), pa.array([i] * n_to, pa.int64()), pa.array([copies] * n_to, pa.int64()), pa.array([least(q, i, to)] * n_to), pa.array([v.as_py()] * n_to, pa.list_(pa.float64()))], ["leaf", "query_id", "copies", "least", "q"])

    asked_kind = "leaf long, query_id long, copies long, least double, q array<double>"
    queries = fine.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("copies"))
    asked = stored(queries.mapInArrow(walk, asked_kind), "ann-queries")
    if grown:
        probes = spark.createDataFrame([(int(i), [float(y) for y in v], 1) for i, v in zip(asked_ids, asked_x, strict=True)], "vec_id long, v array<double>, copies long")
        own = stored(asked.unionByName(probes.mapInArrow(walk, asked_kind)).groupBy("leaf", "query_id").agg(F.first("copies").alias("copies"), F.first("least").alias("least"), F.first("q").alias("q")), "ann-queries")
        real = stored(asked.select("query_id").distinct(), "ann-real")
        known = stored(truth.mapInArrow(place_truth(tree, norm, d), "query_id long, vec_id long, leaf long"), "ann-truth").join(own.select("leaf", "query_id"), ["leaf", "query_id"], "left_semi")
        for _ in range(LEVELS):
            if large_leaves(placed, leaf).isEmpty():
                break
            placed, own, known = refined(placed, own, known, norm, d, k, sample, leaf, goal, block)
        asked = stored(own.join(real, "query_id", "left_semi"), "ann-queries")
    cut = lambda df: df.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("k"))
    sizes = maybe_broadcast(stored(cut(placed).withColumnRenamed("k", "blocks").join(cut(asked).withColumnRenamed("k", "groups"), "leaf"), "ann-sizes"))
    each = lambda df, key, own, other: df.join(sizes, "leaf").withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s"))).withColumn(other, F.explode(F.expr(f"sequence(0L, {other}s - 1L)")))
    left, right = each(asked, "query_id", "group", "block"), each(placed, "vec_id", "block", "group")
    keys = ["leaf", "block", "group"]

    def product(q: pa.Table, c: pa.Table) -> pa.Table:
        own = q.column("query_id").to_numpy()
        got_ = best(array(q.column("q"), d), c.column("vec_id").to_numpy(), array(c.column("v"), d), own, k, q.column("least").to_numpy()) if q.num_rows and c.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(found(own, *got_), ["query_id", "vec_id", "score"])

    hits = left.select(*keys, "query_id", "least", "q").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "v").groupBy(*keys)).applyInArrow(product, FOUND)
    return ranked(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every twentieth vector."""
    return search(table(spark, sf_dir, "embeddings"))
