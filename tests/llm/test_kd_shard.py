import zlib

import pytest

from cairn.llm import kd_shard


def shards(df, n=16, **more):
    out: dict = {}
    for r in kd_shard.kd_shards(df, n, **more).collect():
        out.setdefault(r.shard, []).append(r)
    for rows in out.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    return out


@pytest.mark.parametrize("n", [1, 3, 16])
def test_bytes_are_near_equal_and_equal_texts_together(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = shards(docs, n)
    sizes = [sum(r.size for r in rows) for rows in out.values()]
    assert sorted(out) == list(range(n)) and max(sizes) < 1.1 * sum(sizes) / n and min(sizes) > 0.9 * sum(sizes) / n
    texts, where = {r.doc_id: r.text for r in docs.collect()}, {}
    for s, rows in out.items():
        for r in rows:
            assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
            where.setdefault(texts[r.doc_id], set()).add(s)
    assert all(len(s) == 1 for s in where.values())


def test_group_of_a_third_is_cut(spark):
    docs = spark.createDataFrame([(k, "same text" * 20 if k % 3 == 0 else f"{k} other" * (15 + k % 20)) for k in range(3000)], "doc_id long, text string")
    sizes = [sum(r.size for r in rows) for rows in shards(docs).values()]
    assert len(sizes) == 16 and max(sizes) < 1.1 * sum(sizes) / 16


def test_odd_rows(docs, none):
    assert sum(map(len, shards(docs).values())) == docs.count()
    assert shards(none) == {}


def test_splits_match_a_tree_by_sorting(spark):
    """Each split, from sorted keys instead of histograms, along the dimension that is widest."""
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcé\n ") for _ in range(rng.randrange(1, 400))) for _ in range(300)]
    texts += [texts[3]] * 9 + ["", None, "x" * 3000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = [r.asDict() for r in kd_shard.points(docs).collect()]
    whole = {c: max(1, max(r[c] >> 32 for r in rows) - min(r[c] >> 32 for r in rows)) for c in kd_shard.DIMENSIONS}
    shard = {}

    def split(own, first, leaves):
        if leaves == 1 or not own:
            shard.update({r["doc_id"]: first for r in own})
            return
        dim = max(kd_shard.DIMENSIONS, key=lambda c: (max(r[c] >> 32 for r in own) - min(r[c] >> 32 for r in own)) / whole[c])
        want, below, half = sum(r["size"] for r in own) * (leaves // 2) / leaves, 0, leaves // 2
        for key in sorted({r[dim] for r in own}):
            group = sum(r["size"] for r in own if r[dim] == key)
            if below + group >= want:
                break
            below += group
        cut = key + (want - below > below + group - want)
        split([r for r in own if r[dim] < cut], first, half)
        split([r for r in own if r[dim] >= cut], first + half, leaves - half)

    split(rows, 0, 5)
    for bins in (4096, 7):
        got = {r.doc_id: r.shard for r in kd_shard.kd_shards(docs, 5, bins=bins, near=0.0, group_share=1e9).collect()}
        assert got == shard
