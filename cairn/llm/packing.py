"""Mixture-controlled packing: deficit round-robin over source queues.

A queue holds the tokens of one source, in the order of partition and position.
Every window of ``window`` tokens credits each queue with its share; a queue
sends the whole tokens of its credit and carries the rest of it, its deficit,
to the next window and across partitions.  With shares by what queues hold, all
queues end together.  Given other targets, queues that end early leave their
share to those that remain.  A queue's credit after k windows is linear in k
between such ends, so the window and place of any token follow from sums of
what came before it, and no task walks through the windows of others.

The windows, one after another, are cut into sequences; the last one's rest is
cut into powers of two, so nothing is padded.

Defined results: null text is empty text, whose one token is the end; a null
source is a queue of its own; every source that targets name has a queue, and
of the others those that hold most tokens, ``max_queues`` in all; the rest share
one queue, over which each of them is spread evenly, document by document; repeated rows and a null ``doc_id`` are documents like any
other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from fractions import Fraction
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from cairn.llm.store import maybe_broadcast, pick, stored, table

END_ID = 1
LENGTH, WINDOW, MAX_QUEUES = 2048, 1 << 16, 256
#: Words whose ids a worker keeps.
CACHE = 800_000
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: White space beside a space belongs with it: such texts are encoded whole.
TOGETHER = re.compile(r"  |[^\S ] | [^\S ]|^ | $")
#: White space but spaces and ends of lines: texts that hold none need no pattern.
RARE = tuple(c for c in map(chr, range(1 << 16)) if c.isspace() and c not in " \n")


def together(text: str) -> bool:
    if text.isascii():
        return any(x in text for x in ("  ", " \n", "\n ", "\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f")) or text[0] == " " or text[-1] == " "
    if any(x in text for x in ("  ", " \n", "\n ")) or text[0] == " " or text[-1] == " ":
        return True
    return any(c in text for c in RARE) and TOGETHER.search(text) is not None


# How byte-level vocabularies cut text into words, and the bytes that stand for themselves in their tokens.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VISIBLE = (*range(33, 127), *range(161, 173), *range(174, 256))


def ranked(tokenizer: Tokenizer) -> tiktoken.Encoding | None:
    """The same byte-level vocabulary by ranks, which encodes faster to the same ids; None for vocabularies of another kind."""
    model = json.loads(tokenizer.to_str())
    before = model.get("pre_tokenizer") or {}
    if model["model"].get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("normalizer"):
        return None
    hidden = [b for b in range(256) if b not in VISIBLE]
    byte = {chr(b): b for b in VISIBLE} | {chr(256 + k): b for k, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in name): k for name, k in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in byte for c in name)}
    special = {t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()}
    return tiktoken.Encoding("ranks", pat_str=WORD_PATTERN, mergeable_ranks={b: k for b, k in ranks.items() if b not in special}, special_tokens={})


class Words:
    """Ids of whole texts. No token reaches over a space between two characters that aren't white space, so words are looked up alone.

    Unknown words are encoded as one text; the token that holds a word's space begins it.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.ranks = ranked(self.tokenizer)
        names = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(names.values()) + 1, bool)
        self.begins[[k for name, k in names.items() if name.startswith("\u0120")]] = True

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word after a space."""
        if not words:
            return {}
        text = "".join([" " + w for w in words])
        ids = np.array(self.ranks.encode_ordinary(text), "<u4") if self.ranks else self.encoded([text])[0]
        at = (4 * np.append(np.flatnonzero(self.begins[ids]), len(ids))).tolist()
        raw = ids.tobytes()
        return {w: raw[i:j] for w, i, j in zip(words, at[:-1], at[1:], strict=True)}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, 4 bytes each."""
        known, out, cut, got, gaps, wanted = self.known, [None] * len(texts), {}, {}, {}, set()
        for k, t in enumerate(texts):
            if t and not together(t) and not any(s in t for s in self.special):
                cut[k] = t.split(" ")
        for k, words in cut.items():
            got[k] = list(map(known.get, words))
            got[k][0] = b""  # the first word has no space before it
            gaps[k] = [i for i in compress(range(len(words)), map(not_, got[k])) if i]
            wanted.update([words[i] for i in gaps[k]])
        new = self.fresh(list(wanted))
        if len(known) < CACHE:
            known.update(new)
        whole = [k for k in range(len(texts)) if k not in cut]
        for k, ids in zip(whole, self.encoded([texts[k] for k in whole]), strict=True):
            out[k] = ids.tobytes()
        for (k, words), ids in zip(cut.items(), self.encoded([w[0] for w in cut.values()]), strict=True):
            own = got[k]
            own[0] = ids.tobytes()
            for i in gaps[k]:
                own[i] = new[words[i]]
            out[k] = b"".join(own)
        return out


WORDS: dict[str, Words] = {}
BATCH = 1024


def tokens(path: str):
    """source, part, before (its source's tokens earlier in the partition), doc_id, n, ids (16 or 32 bits each)."""

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = WORDS.setdefault(path, None) or WORDS.update({path: Words(path)}) or WORDS[path]
        part, sent = TaskContext.get().partitionId(), {}
        end = np.array([END_ID], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                ids = [x + end for x in encode([t or "" for t in b.column("text").to_pylist()])]
                n, before, sources = [len(x) // 4 for x in ids], [], b.column("source").to_pylist()
                for s, k in zip(sources, n, strict=True):
                    before.append(sent.get(s, 0))
                    sent[s] = before[-1] + k
                packed = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else x.tobytes() for x in (np.frombuffer(x, "<u4") for x in ids)]
                yield pa.record_batch([b.column("source"), pa.array([part] * len(n)), pa.array(before, pa.int64()), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["source", "part", "before", "doc_id", "n", "ids"])

    return run


class Mixture:
    """Where tokens of queues come to lie. totals: tokens of each queue; targets: wanted shares (None: by totals)."""

    def __init__(self, totals: list[int], window: int, targets: list[Fraction] | None = None):
        self.totals, self.window = totals, window
        want = [Fraction(t) for t in (targets or totals)]
        sent, now, live = [Fraction(0)] * len(totals), Fraction(0), {q for q, t in enumerate(totals) if t}
        self.turns: list[tuple[Fraction, list[Fraction], list[Fraction]]] = []  # from when; tokens sent by then; tokens a window
        while live:
            if not any(want[q] for q in live):
                want = [Fraction(t) for t in totals]
            whole = sum(want[q] for q in live)
            rate = [want[q] / whole * window if q in live else Fraction(0) for q in range(len(totals))]
            self.turns.append((now, sent, rate))
            last = min((totals[q] - sent[q]) / rate[q] for q in live if rate[q])
            sent = [s + r * last for s, r in zip(sent, rate, strict=True)]
            now += last
            live = {q for q in live if sent[q] < totals[q]}
        self.ends, self.starts = now, [t for t, _, _ in self.turns]
        self.memo: dict[int, tuple[list[int], int]] = {}

    def sent(self, k: int) -> tuple[list[int], int]:
        """Whole tokens each queue has sent in the first k windows, and their sum."""
        if k not in self.memo:
            if k >= self.ends:
                got = self.totals
            else:
                since, sent, rate = self.turns[bisect.bisect_right(self.starts, k) - 1]
                got = [int(s + r * (k - since)) for s, r in zip(sent, rate, strict=True)]
            if len(self.memo) > 4096:
                self.memo.clear()
            self.memo[k] = (got, sum(got))
        return self.memo[k]

    def window_of(self, q: int, token: int) -> int:
        """The window that sends this token of the queue."""
        at = bisect.bisect_right(self.turns, token, key=lambda t: t[1][q]) - 1
        since, sent, rate = self.turns[at]
        k = int(since + (token - sent[q]) / rate[q]) if rate[q] else int(since)
        while self.sent(k)[0][q] > token:
            k -= 1
        while self.sent(k + 1)[0][q] <= token:
            k += 1
        return k

    def runs(self, q: int, first: int, n: int):
        """(start, length, place in the stream) of a document's tokens, from the first-th of the queue."""
        done = 0
        while done < n:
            k = self.window_of(q, first + done)
            (here, base), (then, _) = self.sent(k), self.sent(k + 1)
            take = min(n - done, then[q] - first - done)
            yield done, take, base + sum(then[r] - here[r] for r in range(q)) + first + done - here[q]
            done += take


def places(stream: int, total: int, length: int):
    """(sequence, offset, room) at a place of the stream; what is left after the full sequences is cut into powers of two."""
    full = total // length
    if stream < full * length:
        return stream // length, stream % length, length - stream % length
    at, rest, seq = stream - full * length, total - full * length, full
    while True:
        size = 1 << (rest.bit_length() - 1)
        if at < size:
            return seq, at, size - at
        at, rest, seq = at - size, rest - size, seq + 1


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(totals: list[int], window: int, length: int, targets: list[Fraction] | None):
    def run(batches):
        mix, total = Mixture(totals, window, targets), sum(totals)
        for b in batches:
            rows = [[] for _ in range(7)]
            for q, first, doc, n, ids in zip(*(b.column(c).to_pylist() for c in ("queue", "first", "doc_id", "n", "ids")), strict=True):
                raw = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                for start, take, place in mix.runs(q, first, n):
                    while take:
                        seq, offset, room = places(place, total, length)
                        m = min(take, room)
                        for c, v in zip(rows, (doc, start, m, zlib.crc32(raw[4 * start : 4 * (start + m)]), n, seq, offset), strict=True):
                            c.append(v)
                        start, take, place = start + m, take - m, place + m
            yield pa.record_batch([pa.array(c, pa.int64()) for c in rows], [f.split()[0] for f in PIECES.split(", ")])

    return run


#: Documents that are ordered together, about.
TOGETHER_ROWS = 10_000


def interleaved(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """rows (source, first in it, n and more) with first in one queue of all their sources: every source's documents are spread evenly over it.

    A document's place is how far into its source it stands, from 0 to 1; a source's start is by its hash, so that many sources of
    one document are spread too. Any stretch of the queue holds the sources by their totals (source, n), but for whole documents.
    """
    side = totals.select(F.col("source").alias("s"), F.col("n").alias("total"))
    start = F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    placed = rows.join(maybe_broadcast(side), F.col("source").eqNullSafe(F.col("s"))).withColumn("far", (F.col("first") + start * F.col("n")) / F.col("total"))
    n = max(1, rows.count() // TOGETHER_ROWS)
    placed = placed.withColumn("bin", F.least(F.floor(F.col("far") * n), F.lit(n - 1)).cast("long"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = placed.groupBy("bin").agg(F.sum("n").alias("n")).select("bin", before(Window.orderBy("bin")).alias("base"))
    inner = before(Window.partitionBy("bin").orderBy("far", "source", "first"))
    return placed.withColumn("inner", inner).join(maybe_broadcast(stored(bins, "packing-bins")), "bin").withColumn("first", F.col("base") + F.col("inner")).drop("base", "inner", "bin", "far", "s", "total")


def packed(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, targets: dict[str, float] | None = None, max_queues: int = MAX_QUEUES, vocabulary: str | None = None) -> DataFrame:
    """PIECES for every document. targets: wanted shares by source; what they leave goes to the others, by what they hold."""
    rows = pick(docs, source="string", doc_id="long", text="string")
    ids = stored(rows.mapInArrow(tokens(vocabulary or vocabulary_path()), "source string, part long, before long, doc_id long, n long, ids binary"), "packing-ids", texts=True)
    sums = stored(ids.groupBy("source", "part").agg(F.sum("n").alias("n")), "packing-sums")
    by_source = stored(sums.groupBy("source").agg(F.sum("n").alias("n")), "packing-sources")
    wanted = list(targets or {})
    named = by_source.where(F.col("source").isin(wanted)).collect() if wanted else []
    largest = by_source.where(~F.coalesce(F.col("source").isin(wanted), F.lit(False))).orderBy(F.desc("n"), "source").limit(max(0, max_queues - len(named))).collect()
    top = [*named, *largest]
    totals = [r.n for r in top] + [0]
    queue = F.lit(len(top))
    for q, r in enumerate(top):
        queue = F.when(F.col("source").eqNullSafe(F.lit(r.source)), q).otherwise(queue)
    own = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(sums.select(queue.alias("queue"), F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(own), F.lit(0)).alias("earlier")), "packing-first")
    joined = ids.join(maybe_broadcast(first), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("queue", "source", (F.col("earlier") + F.col("before")).alias("first"), "doc_id", "n", "ids")
    others = by_source.where(queue == len(top))
    totals[-1] = others.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if totals[-1]:
        rest = interleaved(joined.where(F.col("queue") == len(top)), others).select(*joined.columns)
        joined = joined.where(F.col("queue") < len(top)).unionByName(rest)
    joined = joined.drop("source")
    shares = None
    if targets is not None:
        names = [*[r.source for r in top], None][: len(totals)]
        is_named = [q < len(top) and s in targets for q, s in enumerate(names)]
        left = max(0, 1 - sum(Fraction(targets[s]).limit_denominator(10**6) for s, yes in zip(names, is_named, strict=True) if yes))
        others = sum(t for t, yes in zip(totals, is_named, strict=True) if not yes) or 1
        shares = [Fraction(targets[s]).limit_denominator(10**6) if yes else left * Fraction(t, others) for s, t, yes in zip(names, totals, is_named, strict=True)]
    return joined.mapInArrow(pieces(totals, window, length, shares), PIECES)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"))
