import re

import pytest

from cairn.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def slow(text, items, width):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        if item is None or not b:
            continue
        n = min(width, len(b))
        for k in range(len(b) - n + 1):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(item)
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("width", [10, 3])
@pytest.mark.parametrize("rarest", [1, 2, 4])
def test_matches_a_scan(spark, docs, prose, width, rarest):
    items = [(1, prose[44]), (2, prose[46].upper()), (10, "one"), (11, "x x x"), (12, ""), (13, None), (None, prose[1]), (14, "never seen words here"), (2, prose[46])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontam.decontaminate(docs, bench, width, rarest, slop=2).collect())
    assert got == sorted((str(r.doc_id), *slow(r.text, items, width)) for r in docs.collect())
    clean = decontam.clean(docs, bench, width, rarest)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r.doc_id) for r in docs.collect() if not slow(r.text, items, width)[1])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha filler beta filler gamma"), (2, "alpha beta gamma"), (3, "alpha " + "far " * 50 + "beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decontam.decontaminate(docs, bench, 10, 2, slop=3).collect()}
    assert got == {1: (0, 1), 2: (3, 0), 3: (0, 0)}


def test_near_is_whole(spark, tmp_path):
    """Another term's start in between, a word that differs and a word no text has don't hide an item; one word isn't two."""
    from cairn.llm import registry

    long = [f"p{k}" for k in range(1, 21)]
    bench = [("long", " ".join(long)), ("a", "a1 a2 a3 a4"), ("twin", "twin twin"), ("u", "unheard u1 u2 u3")]
    docs = {
        "p1 z z z p2 z z z z z z z z z z p15": 1, "a1 z a3 a4": 1, "a1 a2 a3 a4": 0, "a1 " + "far " * 9 + "a3": 0, "one twin": 0, "twin z twin": 1, "z u1 u2 u3": 1,
        " ".join(w for w in long if w not in ("p1", "p2", "p15")) * 5 + "a2 a4 " * 9: None,
    }
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.n_near for r in registry.QUERIES["op6_decontam"](spark, str(tmp_path)).collect()}
    assert [got[k] for k in range(7)] == list(docs.values())[:7]  # the last makes words common


def test_empty(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontam.decontaminate(docs, bench).collect()} == {0}
    assert decontam.decontaminate(docs, bench).count() == docs.count()
    assert decontam.decontaminate(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
