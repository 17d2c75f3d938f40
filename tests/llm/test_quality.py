import numpy as np
import pytest

from cairn.llm import quality


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = quality.scored(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    out = got[got.held_out]
    assert len(out) > 60 and (out.predicted == out.quality).mean() > 0.95
    assert out[out.quality == 0].predicted.mean() == 0 and got.score.between(0, 1).all()


def test_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(c, 1 + c, (300, quality.D)) for c in (0, 1)]
    total = np.zeros((2, quality.D + 1, quality.D + 1))
    for c in (0, 1):
        a = np.column_stack([np.ones(300), x[c]])
        total[c] = a.T @ a
    m = quality.fit_sums(total, shrink=0.0)
    at = np.concatenate(x)[::50]
    z = (at - m.centre) / m.scale
    dens = []
    for c in (0, 1):
        cov = m.factors[c] @ m.factors[c].T
        d = z - m.means[c]
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
        own = ((x[c] - m.centre) / m.scale)
        assert np.allclose(cov, np.cov(own.T, bias=True), atol=1e-6)
    assert np.allclose(m.discriminant(at), dens[1] - dens[0])


def plain_statistics(text):
    """The statistics a character and a word at a time."""
    text = text or b""
    white, letters = b" \t\n\r\v\f", lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    words, now = [], b""
    for b in text:
        if b in white:
            words, now = words + [now] if now else words, b""
        else:
            now += bytes([b])
    words += [now] if now else []
    lines = [x for x in text.split(b"\n") if any(b not in white for b in x)]
    odds = lambda k, n: np.log((k + 0.5) / (n - k + 1))
    n, nw, nl = len(text), len(words), len(lines)
    bare = [w.strip(b".,") for w in words]
    ends = 0
    for x in lines:
        while x and x[-1] in white:
            x = x[:-1]
        ends += x[-1:] in (b".", b"!", b"?")
    return [
        np.log(1 + nw), np.log(1 + n / max(nw, 1)), odds(sum(65 <= b <= 90 for b in text), n), odds(sum(48 <= b <= 57 for b in text), n),
        odds(sum(not letters(b) and not 48 <= b <= 57 and b not in white for b in text), n), odds(sum(any(not letters(b) for b in w) for w in bare), nw),
        odds(len({*words}), nw), odds(max(nw - 1, 0) - len({(words[k], words[k + 1]) for k in range(nw - 1)}), nw), np.log(1 + 100 * nl / max(nw, 1)),
        odds(nl - len({*lines}), nl), odds(ends, nl), odds(sum(65 <= w[0] <= 90 for w in words), nw),
    ]


def test_statistics_match_a_loop(prose):
    texts = [*prose, "A b. C!\n\n  x?  \nA b. C!\n9 9 9 a.b ...", " \t\n", "ÀB 1,2 .,"]
    for t in texts:
        raw = None if t is None else t.encode()
        assert np.allclose(quality.statistics(raw), plain_statistics(raw)), t


def test_curve_is_at_its_optimum_and_inverse_is_one():
    rng = np.random.default_rng(4)
    rows = [(float(d), int(rng.random() < 1 / (1 + np.exp(-d))), int(rng.integers(1, 9))) for d in rng.normal(0, 2, 300)]
    d, y, n = (np.array(c, float) for c in zip(*rows, strict=True))
    w = np.where(y == 1, n / n[y == 1].sum(), n / n[y == 0].sum()) * n.sum() / 2
    loss = lambda b: (w * np.logaddexp(0, np.where(y == 1, -1, 1) * (b[0] * d + b[1]))).sum() + 0.5e-2 * (b @ b)
    best = np.array(quality.fit_curve(rows))
    assert all(loss(best) <= loss(best + step) for step in 1e-2 * np.array([[1, 0], [-1, 0], [0, 1], [0, -1], [1, 1], [-1, -1]]))
    a = rng.normal(0, 1, (9, 6))
    lower = np.linalg.cholesky(a.T @ a)
    assert np.allclose(quality.inverse(lower) @ lower, np.eye(6))


def test_learns_from_a_bounded_number_of_rows(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(3, 0), (None, 1), (5, 7)], "doc_id long, quality int")
    import zlib

    free = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2]
    every = {r.doc_id: r.quality for r in quality.known(labels).collect()}
    assert sorted(every) == free and all(every[k] == (0 if k == 3 else k % 2) for k in free)
    assert quality.known(labels, 50).count() == 50


def test_odd_tables(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {1.0}
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(none, labels).count() == 0
    both = spark.createDataFrame([(k, int(k < 20)) for k in range(50)] + [(1, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, both).collect())
    assert quality.accepted(docs, both).columns == docs.columns


def test_held_out_rows_follow_the_hash(spark):
    import zlib

    got = spark.range(100).select(quality.held_out("id").alias("h"), "id").collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
