"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link at ``radius`` or fewer differing bits.  The 64 bits are dealt
to m parts, correlated bits together; part i gets a threshold t_i of -1 or more
with sum(t_i) = radius - m + 1, so any linked pair agrees within t_i bits in
some part i.  Thresholds are unequal: dynamic programming takes those of least
cost by candidate counts estimated from the bit pair counts of all
fingerprints, and the m of least cost is taken.  Keys of a part (and, from
threshold 1 on, its one-bit variants) bring candidates together; whole
fingerprints verify them.

Only distinct fingerprints are probed, so copies add nothing.  A bucket gives a
spanning forest of its links, not its pairs; one above ``block`` members is cut
into blocks whose pairs are dealt to many tasks.

Defined results: null, empty or blank text has fingerprint zero and links like
any other; a null ``doc_id`` takes part and gets the component's least id, or
null if it has none; repeated rows each get a row; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cairn.llm.components import components
from cairn.llm.store import fresh, maybe_broadcast, pick, spread_join, stored, table

SEED, SHINGLE, RADIUS = 42, 4, 4
PIECE = 1 << 15
#: Seconds that a probe row and a verified candidate take, for weighing plans.
ROW_S, PAIR_S = 2e-6, 3e-8


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        return xxh64_intdigest(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    first, last = (ends - lens)[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    total, counts = len(first), np.zeros(64, np.int64)
    for k in range(0, total, PIECE):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[k : k + PIECE], last[k : k + PIECE], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for b in batches:
        got = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
        yield pa.record_batch([b.column("doc_id"), b.column("h"), pa.array(got.view(np.int64))], ["doc_id", "h", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), fp (the 64 bits as a long)."""
    return pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, h long, fp long")


def _bit_pairs(batches):
    total = np.zeros((64, 64))
    for b in batches:
        bits = np.unpackbits(b.column("fp").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += bits.T @ bits
    i, j = np.triu_indices(64)
    yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])


def bit_pairs(nodes: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j, over all of them."""
    out = np.zeros((64, 64))
    for r in nodes.select("fp").mapInArrow(_bit_pairs, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.n
    return out


def parts(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m parts of nearly equal size; each takes the free bit that correlates most with those it has."""
    p = np.diag(both) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(both / n - np.outer(p, p)) / np.outer(spread, spread)
    free, out = set(range(64)), []
    for k in range(m):
        at = sorted(free)
        own = [max(at, key=lambda b: tie[b, at].sum())]  # noqa: B023
        free -= set(own)
        while len(own) < (k + 1) * 64 // m - k * 64 // m:
            own.append(max(sorted(free), key=lambda b: tie[b, own].sum()))  # noqa: B023
            free.remove(own[-1])
        out.append(own)
    return out


def differing(both: np.ndarray, n: int, bits: list[int]) -> np.ndarray:
    """Chance that two fingerprints differ in 0, 1, ... of the bits, from the counts of neighbouring pairs of bits."""
    dist = np.ones(1)
    for a, b in zip(bits[::2], [*bits[1::2], None], strict=False):
        one = both[a, a] / n
        if b is None:
            step = np.array([one**2 + (1 - one) ** 2, 2 * one * (1 - one)])
        else:
            q = np.array([both[a, b], both[a, a] - both[a, b], both[b, b] - both[a, b], n - both[a, a] - both[b, b] + both[a, b]]) / n
            same, far = (q**2).sum(), 2 * (q[0] * q[3] + q[1] * q[2])
            step = np.array([same, max(0.0, 1 - same - far), far])
        dist = np.convolve(dist, step)
    return dist


def plan(both: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The parts of least cost with their thresholds; those at -1 aren't probed."""
    best: tuple[float, list] = (np.inf, [])
    for m in range(1, radius + 2):
        split = parts(both, n, m)
        costs = []
        for bits in split:
            near = np.cumsum(differing(both, n, bits)) * n * n / 2
            # one-bit variants on both sides meet within two bits
            costs.append({-1: 0.0, 0: n * ROW_S + near[0] * PAIR_S, **{t: n * (1 + len(bits)) * ROW_S + near[min(2, len(near) - 1)] * PAIR_S for t in (1, 2)}})
        table_: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (cost, ts) in table_.items():
                for t, more in c.items():
                    if cost + more < step.get(s + t, (np.inf,))[0]:
                        step[s + t] = (cost + more, [*ts, t])
            table_ = step
        cost, ts = table_.get(radius - m + 1, (np.inf, []))
        if cost < best[0]:
            best = (cost, [x for x in zip(split, ts, strict=True) if x[1] >= 0])
    return best[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def probes(nodes: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """key, fp: the buckets of each fingerprint."""

    def emit(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for k, (bits, t) in enumerate(chosen):
                base = fp & np.uint64(sum(1 << x for x in bits))
                for flip in [0, *([1 << x for x in bits] if t > 0 else [])]:
                    key = mixed((base ^ np.uint64(flip)) + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64))
                    yield pa.record_batch([pa.array(key.view(np.int64)), b.column("fp")], ["key", "fp"])

    return nodes.select("fp").mapInArrow(emit, "key long, fp long")


def forest(fp: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among the fingerprints."""
    a, b, rest = [], [], fp
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                a += [int(x)] * len(found)
                b += found.tolist()
                todo += list(found)
                rest = rest[~near]
    return a, b


SMALL = 24


def linker(block: int, radius: int):
    """For rows sorted by key: links (key null) of each bucket, or its rows as they are if it is above block."""

    def small(key, fp):
        for k in range(1, SMALL):
            if k >= len(key):
                return
            hit = np.flatnonzero((key[k:] == key[:-k]) & (np.bitwise_count(fp[k:] ^ fp[:-k]) <= radius) & (fp[k:] != fp[:-k]))
            if len(hit):
                yield fp[hit], fp[hit + k]

    def out(key, a, b):
        return pa.record_batch([pa.array(key, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["key", "a", "b"])

    def buckets(key, fp):
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        few = np.repeat(size <= SMALL, size)
        for a, b in small(key[few], fp[few]):
            yield out([None] * len(a), a, b)
        for s in np.flatnonzero(size > SMALL):
            own = np.unique(fp[edge[s] : edge[s + 1]])
            if len(own) > block:
                yield out([int(key[edge[s]])] * len(own), own, own)
            else:
                a, b = forest(own, radius)
                yield out([None] * len(a), np.array(a, np.uint64), np.array(b, np.uint64))

    def run(batches):
        key, fp, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            k, f = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            if hot is not None:  # a bucket that goes on beyond block
                n = int(np.searchsorted(k, hot, "right"))
                if n:
                    yield out([hot] * n, f[:n], f[:n])
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                hot = None
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            at = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            if at:
                yield from buckets(key[:at], fp[:at])
            key, fp = key[at:], fp[at:]
            if len(key) > block:
                hot = int(key[0])
                yield out([hot] * len(fp), fp, fp)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from buckets(key, fp)

    return run


def blocks(hot: DataFrame, block: int) -> DataFrame:
    """key, fp of large buckets, copied to every pair of blocks that the row's block is in."""
    sizes = hot.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", (F.floor(F.col("n") * 2 / block) + 1).cast("int").alias("k"))
    dealt = hot.distinct().join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    pairs = dealt.select("key", "fp", "i", F.explode(F.expr("sequence(0, k - 1)")).alias("j"))
    return pairs.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp").distinct()


def links(nodes: DataFrame, radius: int = RADIUS, block: int = 4096) -> DataFrame:
    """a, b: enough links between distinct fingerprints to connect what is linked."""
    n = nodes.count()
    rows = probes(nodes, plan(bit_pairs(nodes), n, radius)) if n else nodes.select(F.col("fp").alias("key"), "fp")
    edges = None
    for limit in (block, 1 << 62):  # blocks of the second turn are as small as hashing deals them
        kind = "key long, a long, b long"
        got = stored(rows.repartition("key").sortWithinPartitions("key").mapInArrow(linker(limit, radius), kind), "links")
        own = got.where("key is null").select("a", "b")
        edges = own if edges is None else edges.unionByName(own)
        hot = got.where("key is not null").select("key", F.col("a").alias("fp"))
        if hot.isEmpty():
            break
        rows = blocks(hot, block)
    return edges


def grouped(docs: DataFrame, radius: int = RADIUS, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(each, nodes): doc_id, h, fp for each row; fp, group, least for each fingerprint. group: one fingerprint of the component; least: its first row as (no_id, doc_id, h)."""
    each = stored(fingerprints(docs), "simhash", texts=True)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    own = stored(each.groupBy("fp").agg(F.min(first).alias("own")), "simhash-nodes")
    labels = stored(components(links(own, radius, block)).select(F.col("node").alias("fp"), F.col("label").alias("group")), "simhash-labels")
    nodes = stored(own.join(labels, "fp", "left").select("fp", F.coalesce("group", "fp").alias("group"), "own"), "simhash-groups")
    least = stored(nodes.groupBy("group").agg(F.min("own").alias("least")), "simhash-least")
    return each, stored(spread_join(nodes, least, "group").select("fp", "group", "least"), "simhash-nodes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block: int = 4096) -> DataFrame:
    """doc_id, fp, component_id for each row."""
    each, nodes = grouped(docs, radius, block)
    return spread_join(each, nodes.select("fp", "least"), "fp").select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: of the rows of least id (null ids come last) one of least text hash.

    A row goes for its own text, not for another row's of its id; of rows that agree in id and text one stays.
    """
    each, nodes = grouped(docs)
    rows = stored(spread_join(each, nodes.select("fp", "least"), "fp").select("doc_id", "h", (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("h") == F.col("least.h"))).alias("first")).groupBy("doc_id", "h", "first").agg(F.count(F.lit(1)).alias("n")), "simhash-rows")
    d, k = fresh(docs, "d", "k")
    is_row = lambda: docs["doc_id"].cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(docs["text"]) == F.col(k))
    side = lambda where: maybe_broadcast(rows.where(where).select(F.col("doc_id").alias(d), F.col("h").alias(k)))
    if rows.where("first and n > 1").isEmpty():
        return docs.join(side("not first"), is_row(), "left_anti").select(*docs.columns)
    once = docs.join(side("not first or n > 1"), is_row(), "left_anti").select(*docs.columns)
    return once.unionByName(docs.join(side("first and n > 1"), is_row(), "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
