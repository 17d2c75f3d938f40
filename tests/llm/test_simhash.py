import random

import numpy as np
import pytest
import xxhash

from cairn.llm import simhash
from cairn.llm.components import components
from cairn.llm.store import stored


def slow_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(fps))]


def test_fingerprints_and_components(docs):
    rows = [r for r in docs.collect()]
    fps = [slow_fingerprint(r.text) for r in rows]
    root = groups(fps, 4)
    least = {}
    for r, k in zip(rows, root, strict=True):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f, str(least.get(k))) for r, f, k in zip(rows, fps, root, strict=True))
    got = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == want


@pytest.mark.parametrize("block", [4096, 30])
def test_links_connect_what_is_near(spark, block):
    """A dense cluster, chains and noise; small blocks cut the large buckets."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    x = rng.getrandbits(64)
    for _ in range(20):
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.add(x)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    label = {r.node % 2**64: r.label for r in components(simhash.links(nodes, 4, block)).collect()}
    root = groups(fps, 4)
    mine = [label.get(f, f) for f in fps]
    assert all((mine[a] == mine[b]) == (root[a] == root[b]) for a in range(len(fps)) for b in range(a))


@pytest.mark.parametrize("n", [10, 10**5, 10**7, 10**10])
def test_plan_is_sound(n):
    rng = np.random.default_rng(1)
    bits = (rng.random((500, 64)) < np.linspace(0.1, 0.9, 64)).astype(float)
    for radius in (1, 4):
        split = simhash.plan(bits.T @ bits / 500 * n, n, radius)
        m = len(split)
        used = [b for part, _ in split for b in part]
        assert len(set(used)) == len(used)
        for _ in range(200):  # any difference of radius bits is within some part's threshold
            far = set(rng.choice(64, radius, replace=False).tolist())
            assert any(len(far & set(part)) <= t for part, t in split), (m, split)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1200)]
    label = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({label[k] for k in range(61)}) == 1 and len({label[k] for k in range(1000, 1200)}) == 1 and label[0] != label[1000]
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_rounds_grow_with_the_logarithm(spark):
    """Chains whose numbers ascend are no worse than others: a round leaves about a third of their edges."""
    seen = []
    label = {r.label for r in components(spark.range(1024).selectExpr("id as a", "id + 1 as b"), seen).collect()}
    assert len(label) == 1 and len(seen) <= 9 and all(b < 0.7 * a for a, b in zip(seen, seen[1:], strict=False) if a > 30), seen


def test_joins_spread_hot_keys(spark, monkeypatch):
    """A key that a third of all rows hold, null keys and keys without a side, by both ways."""
    from cairn.llm import store

    rows = stored(spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 7 when id % 100 = 1 then null else id end as k"), "test")
    side = stored(spark.range(2000).selectExpr("id as k", "id * 2 as v"), "test")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(side, "k", how).select("id", "k", "v").collect()))
        for few in (1 << 13, 0):
            monkeypatch.setattr(store, "FEW_ROWS", few)
            assert sorted(map(str, store.spread_join(rows, side, "k", how).select("id", "k", "v").collect())) == want


def test_a_row_goes_for_its_own_text(spark):
    """Rows of one id with other texts are judged apart; of rows that agree in all one stays."""
    a, b = ("alpha beta gamma delta epsilon zeta eta theta " * 9).strip(), ("one two three four five six seven eight nine ten " * 9).strip()
    rows = [(1, a), (2, a), (2, b), (3, None), (3, ""), (None, a), (1, a), (5, b + " eleven twelve of its own and no other " * 5)]
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert [g for g in got if g[0] != 3] == sorted([(1, a), (2, b), rows[-1]], key=str) and len(got) == 4


def test_keep_one_and_empty(docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {3, 4} <= ids and 40 not in ids and 41 not in ids
    assert simhash.near_duplicates(none).count() == 0
