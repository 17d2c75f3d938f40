"""Language-model scores by masked pseudo-likelihood.

Every word is predicted from the two words on either side: the sum of four
positions' embeddings goes through one hidden layer, which gives the word's
class and then the word within its class.  A document's score is the sum of the
natural logs of these conditional probabilities over all of its words.

The vocabulary holds the most frequent words by counts over all documents; other
words share hashed places.  Such a word's probability is that of its place times
its part of the place's occurrences, by counts of every word over all documents;
the more frequent of these words are known to every task, the rest are joined.
Every task starts from the same parameters and
trains on every word of all of its documents, each once a round, in ``mask``
passes over a group of documents (each pass masks every ``mask``-th word); the
parameters' mean, weighted by words, is the model of a round. Tasks send their
parameters in parts, which are summed part by part.

Defined results: null, empty or blank text has no words and scores 0; rows with
a null ``doc_id`` and repeated rows count and are scored like any other; an
empty table gives no rows; texts of any length are scored whole; further
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.store import pick, stored, table

SIDE = 48  # classes, and words in a class
VOCABULARY, HASHED, HIDDEN = SIDE * SIDE, 287, 32
OFFSETS = (-2, -1, 1, 2)
REACH = 2
MASK, STEP, RATE, ROUNDS = 4, 4096, 0.3, 1
#: A class learns as if it had this many words in a step, at least.
LEAST = 64
NONE = 0  # beyond either end
#: Most hashed words whose counts every task holds; the others' are joined.
NEAR = 1 << 17

#: Parameters in the order in which they are averaged; the last row of an output layer is its bias.
SHAPES = {"embed": (len(OFFSETS), VOCABULARY, HIDDEN), "bias": (HIDDEN,), "classes": (HIDDEN + 1, SIDE), "words": (SIDE, HIDDEN + 1, SIDE)}
#: Parameters in one row of those that tasks send.
PART = 8192
#: Bound of the outputs before exp, far from what training reaches.
BOUND = 60.0
ONES = np.ones(SIDE, np.float32)


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {k: (np.zeros(s) if k == "bias" else rng.normal(0, 0.1, s)).astype(np.float32) for k, s in SHAPES.items()}
    p["classes"][HIDDEN] = 0
    p["words"][:, HIDDEN] = 0
    return p


def numbers(text: bytes | None, known: dict[bytes, int], others: list[bytes] | None = None) -> list[int]:
    """The words of a text as places in the vocabulary. others: is given the words that aren't known."""
    get, words = known.get, (text or b"").lower().split()
    if others is not None:
        others += [w for w in words if w not in known]
    return [get(w) or zlib.crc32(w) % HASHED + 1 for w in words]


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place. The sums are matrix products, which are faster than sums of short rows."""
    np.clip(x, -BOUND, BOUND, out=x)
    np.exp(x, out=x)
    x /= (x @ ONES)[:, None]
    return x


def _log_chosen(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ln of the softmax of each row at one of its places; x is used up."""
    np.clip(x, -BOUND, BOUND, out=x)
    chosen = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return chosen - np.log(x @ ONES)


def by_class(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice, int]]]:
    """(order, runs): an order in which the words of a class stand together, and where those of each class that occurs do."""
    c = (words // SIDE).astype(np.uint16)
    sizes = np.bincount(c, minlength=SIDE)
    ends = np.cumsum(sizes).tolist()
    return np.argsort(c, kind="stable"), [(k, slice(e - m, e), m) for k, (e, m) in enumerate(zip(ends, sizes.tolist(), strict=True)) if m]


def hidden(p: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    """The hidden layer of each row and a one, which multiplies the biases."""
    x = p["bias"] + p["embed"][0].take(around[:, 0], 0)
    for k in range(1, len(OFFSETS)):
        x += p["embed"][k].take(around[:, k], 0)
    out = np.ones((len(x), HIDDEN + 1), np.float32)
    np.tanh(x, out=out[:, :HIDDEN])
    return out


def log_probabilities(p: dict[str, np.ndarray], words: np.ndarray, around: np.ndarray) -> np.ndarray:
    """ln P(word | words around it) of each row."""
    order, own = by_class(words)
    words, h = words[order], hidden(p, around[order])
    got = _log_chosen(h @ p["classes"], words // SIDE)
    x = np.empty((len(h), SIDE), np.float32)
    for k, rows, _ in own:
        np.matmul(h[rows], p["words"][k], out=x[rows])
    out = np.empty(len(h))
    out[order] = got + _log_chosen(x, words % SIDE)
    return out


def learn(p: dict[str, np.ndarray], words: np.ndarray, around: np.ndarray, rate: float) -> None:
    """One gradient step on the rows, in place."""
    order, own = by_class(words)
    words, around = words[order], around[order]
    n, h = len(words), hidden(p, around)
    each = np.arange(n)
    g = _softmax(h @ p["classes"])
    g[each, words // SIDE] -= 1
    back = g @ p["classes"][:HIDDEN].T
    gw = np.empty((n, SIDE), np.float32)
    for k, rows, _ in own:
        np.matmul(h[rows], p["words"][k], out=gw[rows])
    _softmax(gw)
    gw[each, words % SIDE] -= 1
    for k, rows, m in own:
        back[rows] += gw[rows] @ p["words"][k, :HIDDEN].T
        p["words"][k] -= rate / max(m, LEAST) * (h[rows].T @ gw[rows])
    p["classes"] -= rate / n * (h.T @ g)
    back *= 1 - h[:, :HIDDEN] ** 2
    p["bias"] -= rate / n * back.sum(0)
    # all offsets at once: places in the flat table, sorted, so that a place's rows are summed together
    at = (around + np.arange(len(OFFSETS)) * VOCABULARY).ravel().astype(np.uint16)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    step = np.add.reduceat(back.take(order // len(OFFSETS), 0), first, 0)
    step *= (rate / np.sqrt(float(n) * np.diff(first, append=len(at)))).astype(np.float32)[:, None]
    p["embed"].reshape(-1, HIDDEN)[at[first]] -= step


def windows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that hold a word, and what stands around each; ids has REACH empty places around each document."""
    at = np.flatnonzero(ids != NONE)
    return at, np.stack([ids[at + o] for o in OFFSETS], 1)


def in_groups(batches, known: dict[bytes, int], most: int = 1 << 16, rest: bool = False):
    """(doc ids, words of each, ids with empty places between documents, with rest, words of each that aren't known), of about most words; a longer document is a group of its own."""
    pad, docs, sizes, ids, others = [NONE] * REACH, [], [], [NONE] * REACH, []
    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            own: list[bytes] | None = [] if rest else None
            got = numbers(text.as_py(), known, own)
            if docs and len(ids) + len(got) > most:
                yield docs, sizes, np.array(ids, np.int64), others
                docs, sizes, ids, others = [], [], [NONE] * REACH, []
            docs.append(doc)
            others.append(own or [])
            sizes.append(len(got))
            ids += got
            ids += pad
    if docs:
        yield docs, sizes, np.array(ids, np.int64), others


def _count(batches):
    from collections import Counter

    def rows(counts):
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counts: Counter = Counter()
    for b in batches:
        for text in b.column("text"):
            counts.update((text.as_py() or b"").lower().split())
            if len(counts) > 500_000:
                yield rows(counts)
                counts.clear()
    if counts:
        yield rows(counts)


def counted(rows: DataFrame) -> DataFrame:
    """word, n: every word and its count over all rows."""
    return rows.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(rows: DataFrame, counts: DataFrame | None = None) -> dict[bytes, int]:
    """The most frequent words and their places, by counts over all rows."""
    top = (counted(rows) if counts is None else counts).orderBy(F.desc("n"), "word").limit(VOCABULARY - HASHED - 1).collect()
    return {bytes(r.word): k + HASHED + 1 for k, r in enumerate(top)}


def hashed(counts: DataFrame, known: dict[bytes, int], most: int = NEAR) -> tuple[np.ndarray, dict[bytes, int], DataFrame]:
    """(total, near, far) of the words that aren't known: occurrences in each hashed place, the counts of the most frequent words (at most most), and word, n of all others that occur twice or more."""
    held = counts.sparkSession.createDataFrame([(bytearray(w),) for w in known], "word binary")
    others = counts.join(F.broadcast(held), "word", "left_anti")
    total, left, least = np.ones(VOCABULARY), most, None
    for r in others.groupBy((F.crc32("word") % HASHED + 1).alias("k")).agg(F.sum("n").alias("n")).collect():
        total[r.k] = r.n
    for r in others.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most).collect():
        left -= r.words
        if left < 0:
            break
        least = r.n
    near = {} if least is None else {bytes(r.word): r.n for r in others.where(F.col("n") >= least).collect()}
    return total, near, others.where(F.col("n") > 1) if least is None else others.where((F.col("n") > 1) & (F.col("n") < least))


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def _summed(batches):
    """Sums of the parts of parameters, in order of part; of a part, a row of each task."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column("part").to_pylist(), b.column("data"), strict=True):
            x = np.frombuffer(x.as_buffer(), np.float64)
            sums[k] = sums[k] + x if k in sums else x
    yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "data"])


def train(rows: DataFrame, known: dict[bytes, int], rounds: int = ROUNDS, mask: int = MASK) -> dict[str, np.ndarray]:
    p = initial()
    for turn in range(rounds):

        def work(batches, start=p, turn=turn):
            own, n = {k: v.copy() for k, v in start.items()}, 0
            for _, _, ids, _ in in_groups(batches, known):
                at, around = windows(ids)
                order = np.argsort(((at + turn) % mask).astype(np.uint16), kind="stable")  # every place, each mask-th one together
                words, around = ids[at[order]], around[order]
                for k in range(0, len(words), STEP):
                    learn(own, words[k : k + STEP], around[k : k + STEP], RATE)
                n += len(words)
            x = np.append(flat(own) * float(n), n)
            parts = [x[k : k + PART].tobytes() for k in range(0, len(x), PART)]
            yield pa.record_batch([pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["part", "data"])

        kind, got = "part long, data binary", {}
        for r in rows.mapInArrow(work, kind).repartition("part").mapInArrow(_summed, kind).collect():
            got[r.part] = np.frombuffer(r.data, np.float64)
        total = np.concatenate([got[k] for k in sorted(got)]) if got else np.zeros(1)
        if total[-1]:
            p = unflat(total[:-1] / total[-1])
    return p


def scored(docs: DataFrame, rounds: int = ROUNDS, mask: int = MASK) -> DataFrame:
    """doc_id, n_words, log_likelihood, mean for each row."""
    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.col("text").cast("binary").alias("text"))
    counts = stored(counted(rows), "lm-words")
    known = vocabulary(rows, counts)
    p = train(rows, known, rounds, mask)
    total, near, far = hashed(counts, known)
    # near words are numbered after the vocabulary: the place and ln P(word | place) of each number; of far words only ln of the place's total
    every = known | {w: VOCABULARY + k for k, w in enumerate(near)}
    place = np.concatenate([np.arange(VOCABULARY), np.array([zlib.crc32(w) % HASHED + 1 for w in near], np.int64)])
    within = np.where(place <= HASHED, -np.log(total[place]), 0.0)
    within[VOCABULARY:] += np.log(np.array(list(near.values()), float))

    def score(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for doc, sizes, ids, others in in_groups(batches, every, rest=True):
            own, ids = within[ids], place[ids]
            at, around = windows(ids)
            got = np.concatenate([np.zeros(0), *[log_probabilities(p, ids[at[k : k + (1 << 14)]], around[k : k + (1 << 14)]) for k in range(0, len(at), 1 << 14)]]) + own[at]
            ends = np.cumsum(sizes)
            sums = np.concatenate([[0.0], np.cumsum(got)])
            yield pa.record_batch([pa.array(np.arange(row, row + len(doc))), pa.array(doc, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums[ends] - sums[ends - sizes]), pa.array(others, pa.list_(pa.binary()))], ["row", "doc_id", "n_words", "s", "others"])
            row += len(doc)

    part = stored(rows.mapInArrow(score, "row long, doc_id long, n_words long, s double, others array<binary>"), "lm-scores")
    more = part.select("row", F.explode("others").alias("word")).join(far, "word").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    whole = (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood")
    return part.drop("others").join(more, "row", "left").select("doc_id", "n_words", whole).withColumn("mean", F.col("log_likelihood") / F.greatest("n_words", F.lit(1)))


def op5_pseudo_lm(spark, sf_dir: str) -> DataFrame:
    """The pseudo-likelihood of every document."""
    return scored(table(spark, sf_dir, "documents"))
