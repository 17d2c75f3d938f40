import math
import random
import re
from collections import Counter

from cairn.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


TEXTS = [
    None, "", "secret: token : abcdefghijklmnop", "PassWord='ABCDEFGHIJKL' x", "🙂🙂 api_key=abcdefabcdef0123456789 é token=short", "apikey : \"a.b-c_d=e/f+g1\"", "AKIAABCDEFGHIJ1234 AKIA12",
    "deadbeefdeadbeef0 " * 700, "token=secret=abcdefghijklmnop", "0123456789abcdef", "Token = x token = abcdefghijkl",
]


def test_base_spans_match_a_scan(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, kind string")
    for r in secrets.secret_spans(df).collect():
        assert r.base == base(TEXTS[r.doc_id]), r.doc_id
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(r.base.count(f"{k}:") for k in secrets.BASE)


def slow_least(token):
    windows = (token[k : k + secrets.WINDOW] for k in range(len(token) - secrets.WINDOW + 1))
    return min(sum(secrets.weight(n) for n in Counter(w).values()) for w in windows)


def test_entropy_counts_match_windows_counted_anew(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    tokens = ["".join(rng.choice(secrets.ALPHABET[: rng.randrange(2, 67)]) for _ in range(rng.randrange(20, 70))) for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.expr(secrets.least_weight("t")).alias("w")).collect()
    assert all(r.w == slow_least(r.t) for r in got)
    assert abs(secrets.weight(20) / secrets.UNIT - 20 * math.log2(20)) < 1e-5


def test_method_adds_and_allow_list_suppresses(spark):
    df = spark.createDataFrame([(1, "key Zx9Kq2Lm7Pw4Rt8Vb3Nc6 end"), (2, "key exampleZx9Kq2Lm7Pw4Rt8Vb3Nc6"), (3, "a 550E8400E29B41D4A716446655440000F1 b"), (4, "onlylowercaseletterswithoutanydigits")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secret_spans(df).collect()}
    assert got == {1: "entropy_alnum:4:25", 2: "", 3: "entropy_hex:2:36", 4: ""}


def test_redacted_keeps_columns_and_the_rest(spark):
    df = spark.createDataFrame([(1, "é token=abcdefabcdef0123456789 end", "k"), (2, None, "k"), (3, "plain", None)], "doc_id long, text string, hex string")
    got = secrets.redacted(df)
    assert got.columns == df.columns
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, "é [SECRET] end", "k"), (2, None, "k"), (3, "plain", None)]


def test_empty(none):
    assert secrets.secret_spans(none).count() == 0 and secrets.redacted(none).count() == 0
