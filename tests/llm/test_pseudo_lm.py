import numpy as np

from cairn.llm import pseudo_lm as lm


def slow(p, ids):
    total = 0.0
    for k, w in enumerate(ids):
        around = [ids[k + o] if 0 <= k + o < len(ids) else lm.NONE for o in lm.OFFSETS]
        h = np.tanh(p["bias"] + sum(p["embed"][j][a] for j, a in enumerate(around)))
        h = np.append(h, 1)
        for x, y in ((h @ p["classes"], w // lm.SIDE), (h @ p["words"][w // lm.SIDE], w % lm.SIDE)):
            total += x[y] - np.log(np.exp(x - x.max()).sum()) - x.max()
    return total


def test_scores_match_a_loop(docs, prose, monkeypatch):
    kept = {}
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda rows, known, *a: kept.setdefault("p", kept.update(known=known) or train(rows, known, *a)))
    got = {r.doc_id: r for r in lm.scored(docs).collect() if r.doc_id is not None}
    for k, t in enumerate(prose):
        ids = lm.numbers((t or "").encode(), kept["known"])
        assert got[k].n_words == len((t or "").split()) == len(ids)
        assert abs(got[k].log_likelihood - slow(kept["p"], ids)) < 1e-3 * max(1, len(ids)), k


def test_training_predicts_what_both_sides_tell(spark):
    texts = [(k, "alpha beta gamma delta " * 40) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    known = lm.vocabulary(df)
    assert len(known) == 4 and min(known.values()) == lm.HASHED + 1
    few, many = (lm.scored(df, rounds=r, mask=2).agg({"mean": "avg"}).first()[0] for r in (1, 8))
    assert many > few > -7


def test_every_word_is_a_target(spark):
    """A text of period four: each of its words is learned in one round, not only that at every fourth place."""
    df = spark.createDataFrame([(1, b"alpha beta gamma delta " * 400)], "doc_id long, text binary")
    known = lm.vocabulary(df)
    bias = lm.train(df, known)["words"][:, lm.HIDDEN].ravel()
    assert all(bias[k] > 0 for k in known.values())


def test_hashed_words_have_probabilities_of_their_own(spark, monkeypatch):
    """Of words in one hashed place, each counts by its part of the place's occurrences, known to the tasks or joined."""
    import zlib

    common = [f"c{k}" for k in range(lm.VOCABULARY - lm.HASHED - 1) for _ in range(40)]
    place = lambda w: zlib.crc32(w.encode()) % lm.HASHED
    rare = [w for w in (f"r{k}" for k in range(9999)) if place(w) == 5][:3]
    texts = [" ".join(common), rare[0], rare[0], rare[0], rare[1], rare[1], rare[2], f"{rare[0]} {rare[2]} {rare[1]} {rare[1]}"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    n, found = {rare[0]: 4, rare[1]: 4, rare[2]: 2}, []
    for most in (0, 2, 9):
        monkeypatch.setattr(lm.hashed, "__defaults__", (most,))
        got = {r.doc_id: r.log_likelihood for r in lm.scored(df).collect()}
        bin_ = got[1] - np.log(n[rare[0]] / 10)
        for k in range(1, 7):
            assert abs(got[k] - bin_ - np.log(n[texts[k]] / 10)) < 1e-4
        found.append(got)
    assert all(abs(found[0][k] - other[k]) < 1e-3 * max(1, len(texts[k])) for other in found[1:] for k in found[0])


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(1)
    p, words, around = lm.initial(), rng.integers(1, 40, 500), rng.integers(0, 40, (500, 4))
    before = lm.log_probabilities(p, words, around).mean()
    for _ in range(30):
        lm.learn(p, words, around, lm.RATE)
    assert lm.log_probabilities(p, words, around).mean() > before + 0.5


def test_steps_are_the_numeric_gradient():
    """What learn subtracts, its scales taken out, is the gradient of the loss by differences."""
    rng = np.random.default_rng(2)
    p = {k: v + rng.normal(0, 0.2, v.shape).astype(np.float32) for k, v in lm.initial().items()}
    words, around = rng.integers(1, 200, 40), rng.integers(0, 30, (40, 4))
    after = {k: v.copy() for k, v in p.items()}
    lm.learn(after, words, around, 1.0)
    n, loss = len(words), lambda: -lm.log_probabilities(p, words, around).sum()

    def check(name, place, scale):
        kept, eps = p[name][place], 1e-2
        p[name][place] = kept + eps
        high = loss()
        p[name][place] = kept - eps
        low = loss()
        p[name][place] = kept
        assert abs((high - low) / (2 * eps) - (kept - after[name][place]) * scale) < 2e-2, (name, place)

    for k in range(0, lm.HIDDEN + 1, 4):
        check("classes", (k, int(words[k] // lm.SIDE)), n)
        c, m = int(words[k] // lm.SIDE), int((words // lm.SIDE == words[k] // lm.SIDE).sum())
        check("words", (c, k, int(words[k] % lm.SIDE)), max(m, lm.LEAST))
    for k in range(0, lm.HIDDEN, 5):
        check("bias", (k,), n)
        for o in range(4):
            w = int(around[k, o])
            check("embed", (o, w, k), np.sqrt(n * (around[:, o] == w).sum()))


def test_many_tasks_send_one_mean(spark):
    """The model of a round is the mean of its tasks', weighted by words."""
    texts = [(k, ("alpha beta " if k % 2 else "gamma delta ") * (10 + k)) for k in range(8)]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "cast(text as binary) as text")
    known = lm.vocabulary(df)
    parts = df.repartition(3, "doc_id")
    each = parts.rdd.glom().map(lambda rows: [r.text for r in rows]).collect()
    total, n = 0, 0
    for texts in each:
        own = lm.initial()
        ids = [lm.NONE] * 2
        for t in texts:
            ids += lm.numbers(bytes(t), known) + [lm.NONE] * 2
        at, around = lm.windows(np.array(ids, np.int64))
        if len(at):
            order = np.argsort(at % lm.MASK, kind="stable")
            lm.learn(own, np.array(ids)[at[order]], around[order], lm.RATE)
            total, n = total + lm.flat(own).astype(float) * len(at), n + len(at)
    assert np.allclose(lm.flat(lm.train(parts, known)), total / n, atol=1e-4)


def test_empty(none):
    assert lm.scored(none).count() == 0
