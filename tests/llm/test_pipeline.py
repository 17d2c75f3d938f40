import numpy as np

import corpus_pipeline
from cairn.llm import decontam, quality, secrets, simhash
from cairn.llm.registry import QUERIES
from cairn.llm.store import stored

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "benchmark", "secrets", "packing"]
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stored(stage(spark, now, SF), "test")
        seen[name] = (before, now)
        if name != "packing":
            assert now.columns == docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen["quality"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(after) == {r.doc_id for r in quality.scored(before, labels).collect() if r.predicted}
    before, after = seen["near_copies"]
    assert ids(after) == {r.component_id for r in simhash.near_duplicates(before).collect()}
    before, after = seen["benchmark"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids(after) == {r.doc_id for r in decontam.decontaminate(before, items, slop=0).collect() if not r.n_hit}
    before, after = seen["secrets"]
    assert ids(after) == ids(before) and all(r.spans == "" for r in secrets.secret_spans(after).collect())
    assert all(len(r.text) == r.n_chars for r in after.collect())
    before, after = seen["packing"]
    assert ids(after) == ids(before)


def counted(rows):
    out = {}
    for r in rows:
        out[r] = out.get(r, 0) + 1
    return out


def test_odd_tables_against_brute_force(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, ids that repeat with other texts, and columns with clashing names."""
    from test_decontam import slow
    from test_simhash import groups, slow_fingerprint

    plain = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    rows = [tuple(r) for r in plain[:150]]
    good = [r for r in rows if r[1] and len(r[1]) > 600][:8]
    rows += [rows[3], rows[3], (None, good[0][1], None, None), (None, good[1][1] + " and more of it", "en", "s"), (7_000_000, None, None, None), (7_000_001, "", "en", None), (None, None, None, None)]
    rows += [(good[2][0], good[3][1] + " its own words", "en", "t"), (7_000_002, " ".join(r[1] for r in good) * 40, "en", "u")]
    clash = ("a", 1.0, 2, "d", "k")
    kind = "doc_id long, text string, lang string, source string, fp string, score double, h int, d string, k string, n_chars long"
    docs = spark.createDataFrame([(*r, *clash, len(r[1] or "")) for r in rows], kind).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    labels, items = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("labels", "benchmark"))
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, now, str(tmp_path)), "test")
        if name != "packing":
            assert after.columns == docs.columns and after.where("fp <> 'a' or h <> 2 or d <> 'd' or k <> 'k'").count() == 0
        seen.append((name, now.select("doc_id", "text").collect(), after.collect()))
        now = after
    stages = {name: (before, after) for name, before, after in seen}
    before, after = stages["quality"]
    model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    fine = [bool(model.score(np.array([quality.statistics(r.text.encode() if r.text is not None else None)]))[0] >= quality.THRESHOLD) for r in before]
    assert counted((r.doc_id, r.text) for r in after) == counted((r.doc_id, r.text) for r, ok in zip(before, fine, strict=True) if ok)
    before, after = stages["near_copies"]
    root, best = groups([slow_fingerprint(r.text) for r in before], simhash.RADIUS), {}
    for r, g in zip(before, root, strict=True):
        best.setdefault(g, []).append(r)
    least = {g: min((r.doc_id is None, r.doc_id or 0) for r in own) for g, own in best.items()}
    assert len(after) == len(best) and {(r.doc_id is None, r.doc_id or 0) for r in after} <= set(least.values())
    assert sorted(map(str, least.values())) == sorted(str((r.doc_id is None, r.doc_id or 0)) for r in after)
    before, after = stages["benchmark"]
    bench = [(r.item_id, r.text) for r in items.collect()]
    short = [r for r in before if r.text is None or len(r.text) < 100_000]
    clean = counted((r.doc_id, r.text) for r in short if not slow(r.text, bench, 10)[1])
    assert {k: n for k, n in counted((r.doc_id, r.text) for r in after).items() if k[1] is None or len(k[1]) < 100_000} == clean
    before, after = stages["secrets"]
    assert counted(r.doc_id for r in before) == counted(r.doc_id for r in after) and all(r.n_chars == len(r.text or "") for r in after)
    before, after = stages["packing"]
    assert counted(r.doc_id for r in before) == counted(r.doc_id for r in after if r.start == 0)
    tokens = {}
    for r in after:
        tokens[r.sequence_id] = tokens.get(r.sequence_id, 0) + r.length
    assert all(n == 2048 or n.bit_count() == 1 for n in tokens.values())


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
