import random

from cairn.llm import licenses


def test_align_is_a_common_subsequence_and_finds_all_of_equal_texts():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice(b"abcdefghijkl") for _ in range(rng.randrange(30))] for _ in range(2))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        assert len(licenses.align(a, a)) == len(a)


def slow_rising(pairs):
    best = [1] * len(pairs)
    for k in range(len(pairs)):
        for j in range(k):
            if pairs[j][1] < pairs[k][1]:
                best[k] = max(best[k], best[j] + 1)
    return max(best, default=0)


def test_longest_rising_run():
    rng = random.Random(2)
    for _ in range(100):
        second = rng.sample(range(50), rng.randrange(20))
        pairs = list(enumerate(second))
        got = licenses.rising(pairs)
        assert len(got) == slow_rising(pairs) and all(x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


def test_found_in_noise_with_edits_and_twice(spark):
    mit = licenses.TEMPLATES[2][1]
    noise = "the of this work in and software license under " * 20
    rows = [(1, noise + mit + noise), (2, noise + mit.replace("merge, ", "").replace("Software", "Program", 1) + noise), (3, noise), (4, "Released under the MIT License.\nfoo\nReleased under the MIT License."), (5, None), (6, ""), (7, "all   RIGHTS\nreserved"), (8, "All animals have rights and a seat was reserved")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {r.doc_id: r for r in licenses.licensed(df).collect()}
    assert {k: (r.license, r.n_licenses) for k, r in got.items()} == {1: ("MIT", 1), 2: ("MIT", 1), 3: (None, 0), 4: ("MIT", 2), 5: (None, 0), 6: (None, 0), 7: ("all-rights-reserved", 1), 8: (None, 0)}
    assert got[1].coverage == 1.0 and 0.9 < got[2].coverage < 1


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_edited_templates_are_found_and_hits_are_real():
    """Templates with edits below the coverage asked for are found among noise; no hit claims more than a common subsequence holds; hits don't overlap."""
    rng = random.Random(6)
    lexicon = [f"w{k}" for k in range(40)]
    known = licenses.Templates(tuple((f"t{n}", " ".join(rng.choice(lexicon) for _ in range(rng.randrange(8, 60)))) for n in range(6)))
    for _ in range(150):
        text, planted = [], []
        for name, t in rng.sample(known.all, rng.randrange(4)):
            text += [rng.choice([b"n%d" % rng.randrange(9), rng.choice(lexicon).encode()]) for _ in range(rng.randrange(40))]
            own, lacks = list(t), rng.randrange(int(len(t) * (1 - licenses.COVERAGE) + 1e-9) + 1)
            for at in sorted(rng.sample(range(1, len(own) - 1), lacks), reverse=True):
                own[at : at + 1] = rng.choice([[], [b"edited"]])
            planted.append((len(text), name, lacks))
            text += own
        got = known.found(b" ".join(text))
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
        of = dict(known.all)
        for start, end, name, coverage in got:
            assert coverage >= licenses.COVERAGE and common(text[start:end], of[name]) >= round(coverage * len(of[name]))
        for start, name, lacks in planted:
            if not lacks:
                assert any(s <= start < e for s, e, _, _ in got), (start, name)


def test_many_notices_in_one_text_take_linear_time():
    import time

    known, took = licenses.Templates(), []
    for n in (1000, 8000):
        began = time.process_time()
        assert len(known.found(b"Released under the MIT License.\nfoo\n" * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.01)


def test_every_template_finds_itself(spark):
    known = licenses.Templates()
    for name, text in licenses.TEMPLATES:
        assert name in [n for _, _, n, c in known.found(("x y z " + text + " q r").encode()) if c == 1.0]


def test_empty(none):
    assert licenses.licensed(none).count() == 0
