import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cairn.llm import packing


def check(rows, texts, length):
    encode = Tokenizer.from_file(packing.vocabulary_path())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, t in texts.items():
        ids, at = encode.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == length or at.bit_count() == 1 and at < length


@pytest.mark.parametrize("targets", [None, {"s0": 0.7, "s1": 0.1}])
@pytest.mark.parametrize("queues", [256, 1])
def test_every_id_lies_in_one_piece(docs, prose, targets, queues):
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    check(packing.packed(once, 128, 1024, targets, queues).collect(), dict(enumerate(prose)), 128)


def test_windows_hold_the_mixture(spark):
    docs = spark.createDataFrame([(k, "word " * 400, f"s{int(k % 4 == 0)}") for k in range(80)], "doc_id long, text string, source string").repartition(4)
    window = 2048
    part = {r.doc_id: r.doc_id % 4 == 0 for r in docs.collect()}
    got: dict = {}
    for r in packing.packed(docs, 256, window).collect():
        w = got.setdefault((r.sequence_id * 256 + r.offset) // window, [0, 0])
        w[part[r.doc_id]] += r.length
    full = [w for w in got.values() if sum(w) >= window - 2]
    assert len(full) > 10 and all(abs(w[1] / sum(w) - 0.25) < 0.01 for w in full)


def test_repeated_rows_null_ids_and_empty(docs, none):
    rows = packing.packed(docs).collect()
    assert sum(r.doc_id is None and r.start == 0 for r in rows) == 1 and sum(r.doc_id == 7 and r.start == 0 for r in rows) == 2
    assert packing.packed(none).count() == 0


def test_words_match_whole_texts():
    words = packing.Words(packing.vocabulary_path())
    texts = ["a b", " lead", "trail ", "two  spaces", "tab\t here", "line \n x", "nb  x y", "don't stop, it's 12.5%!", "", "x", "é ñ ß 日本 語", "<|endoftext|> a", "a\nb c\n\nd", "a  b", "'s 's"] * 2
    want = [np.array(Tokenizer.from_file(packing.vocabulary_path()).encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words(texts) == want
    words.known.clear()
    packing.CACHE, kept = 0, packing.CACHE
    assert words(texts) == want and not words.known
    packing.CACHE = kept


def test_pattern_is_for_rare_white_space_only(monkeypatch):
    """Any white space beside a space is found, and texts without rare white space don't go through the pattern."""
    space = [c for c in map(chr, range(0x110000)) if c.isspace()]
    for base in ("ab", "é日"):
        for c in space:
            assert all(packing.together(t) for t in (f"{base} {c}{base}", f"{base}{c} {base}", f" {base}", f"{base} "))
        assert not any(packing.together(f"{base}{c}{base} {base}") for c in ("\n", " "))
    assert not packing.together("é\xa0é é\té")
    words, calls = packing.Words(packing.vocabulary_path()), []

    class Pattern:
        def search(self, text):
            calls.append(text)

    monkeypatch.setattr(packing, "TOGETHER", Pattern())
    texts = ["é ñ\nß 日本 語 é ñ", "日本 é", "é"]
    assert words(texts) == [x.tobytes() for x in words.encoded(texts)] and not calls


def test_ranks_give_the_same_ids(spark):
    words = packing.Words(packing.vocabulary_path())
    assert words.ranks is not None
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert words(texts) == [x.tobytes() for x in words.encoded(texts)]


def test_sources_of_the_shared_queue_are_mixed(spark):
    """Of ten sources two have queues; the others' documents are spread over all of the shared one by their totals."""
    import random

    rng = random.Random(3)
    rows = [(s * 1000 + k, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(5, 40))), f"s{s}") for s in range(10) for k in range(30 * (s + 1))]
    rows += [(90_000 + k, "one document alone", f"t{k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.packed(df, length=256, window=1024, targets={"s0": 0.3}, max_queues=2).collect()
    of, total = {r[0]: r[2] for r in rows}, sum(r.length for r in got)
    spread, sizes = {}, {}
    for r in got:
        sizes[of[r.doc_id]] = sizes.get(of[r.doc_id], 0) + r.length
        spread.setdefault(of[r.doc_id], []).append((r.sequence_id, r.length))
    assert sum(sizes.values()) == total
    # s0 is named: it holds 0.3 of the windows until it ends
    early = [r for r in got if r.sequence_id < 4]
    assert abs(sum(r.length for r in early if of[r.doc_id] == "s0") / 1024 - 0.3) < 0.01
    last = max(r.sequence_id for r in got)
    for s in range(1, 9):  # s9 is the largest: it has the other queue
        halves = [sum(n for q, n in spread[f"s{s}"] if (q <= last / 2) == first) / sizes[f"s{s}"] for first in (True, False)]
        assert min(halves) > 0.3, (s, halves)
    alone = [q for s, v in spread.items() if s[0] == "t" for q, _ in v]
    assert min(alone) < last * 0.25 and max(alone) > last * 0.75
