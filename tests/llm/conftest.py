import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Texts with copies, near copies, shared passages, secrets and odd cases."""
    rng = random.Random(11)
    words = ["".join(rng.choice(["an", "th", "er", "on", "re", "é", "ß"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = some(60)
    out = [some(rng.randrange(30, 200)) for _ in range(40)]
    out += [out[3], out[3], out[4] + " end", out[5].replace(" ", "\n", 3), some(20) + " " + shared + " " + some(9), some(5) + " " + shared, shared, "", None, "one", "x " * 300, "🙂 token = 'abcdEFGH12345678' and AKIA" + "B7" * 9]
    return out


@pytest.fixture(scope="session")
def docs(spark, prose):
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t), "clash") for k, t in enumerate(prose)]
    rows += [(None, "no id here at all", None, None, None, None), (7, prose[7], "en", "s1", 1, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
