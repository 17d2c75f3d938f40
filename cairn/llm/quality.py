"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of the whole text (shares are log-odds, counts are logs) are
standardised.  Each class has a Gaussian whose covariance is shrunk towards the
pooled covariance and towards a multiple of the identity; its Cholesky factor
is computed and inverted once and cached in the model that tasks receive.  A document's
discriminant is the difference of the classes' log densities, from Mahalanobis
distances by the cached factor's inverse, plus that of the log priors; a logistic curve
fitted to the learning rows turns it into a score.

It learns from at most ``most`` labelled rows, those of least hashed id, so that
only these texts are measured to fit it; class sums are taken per task first, so
the driver gets a fixed number of sums.  Labels, language, source and id aren't inputs.

Defined results: null text is empty text and gets a score; a null ``doc_id``
learns nothing and isn't held out; repeated rows each count and each get a row;
of conflicting labels the smaller counts; if a class has no learning row, every
score is the share of label 1 (0.5 without labels); an empty table gives no
rows; further columns are ignored.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.store import pick, stored, table

NAMES = ("words", "word_length", "upper", "digit", "symbol", "not_alphabetic", "distinct", "repeated_pairs", "lines", "repeated_lines", "sentence_ends", "capitalised")
D = len(NAMES)
#: Of a class's covariance: how much gives way, and how much of that to the pooled one.
SHRINK, POOLED = 0.2, 0.5
THRESHOLD, HELD_OUT = 0.7, 2
#: Labelled rows that it learns from, at most.
MOST = 50_000

_KIND = np.full(256, 3, np.uint8)  # 0 letter, 1 digit, 2 white space, 3 other
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_KIND[48:58] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 2
_BARE = bytes(b for b in range(256) if _KIND[b])


def odds(k: float, n: float) -> float:
    return float(np.log((k + 0.5) / (n - k + 1.0)))


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of NAMES."""
    text = text or b""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, nw, nl = len(text), len(words), len(lines)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=4)
    upper = n - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    alphabetic = sum(not w.strip(b".,").translate(None, _LETTERS) for w in words)
    return [
        np.log1p(nw), np.log1p(n / max(nw, 1)), odds(upper, n), odds(kinds[1], n), odds(kinds[3], n), odds(nw - alphabetic, nw),
        odds(len(set(words)), nw), odds(max(nw - 1, 0) - len(set(zip(words, words[1:], strict=False))), nw), np.log1p(100 * nl / max(nw, 1)), odds(nl - len(Counter(lines)), nl),
        odds(sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines), nl), odds(sum(65 <= w[0] <= 90 for w in words), nw),
    ]


_LETTERS = bytes(b for b in range(256) if not _KIND[b])
_FEATURES = ", ".join(f"f{k} double" for k in range(D))


def _measure(batches):
    for b in batches:
        x = np.array([statistics(t) for t in b.column("text").to_pylist()], float).reshape(-1, D)
        yield pa.record_batch([b.column("doc_id"), *[pa.array(x[:, k]) for k in range(D)]], ["doc_id", *[f"f{k}" for k in range(D)]])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and f0, f1, ...: the statistics of each row."""
    return pick(docs, doc_id="long", text="string").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_measure, f"doc_id long, {_FEATURES}")


def matrix(batch) -> np.ndarray:
    return np.column_stack([batch.column(f"f{k}").to_numpy() for k in range(D)])


def _sums(batches):
    total = np.zeros((2, D + 1, D + 1))
    for b in batches:
        x, y = np.column_stack([np.ones(b.num_rows), matrix(b)]), b.column("quality").to_numpy()
        for c in (0, 1):
            total[c] += x[y == c].T @ x[y == c]
    c, i, j = (a.ravel() for a in np.indices(total.shape))
    yield pa.record_batch([pa.array(c), pa.array(i), pa.array(j), pa.array(total.ravel())], ["c", "i", "j", "s"])


@dataclass
class Model:
    """Class means and Cholesky factors over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    inverses: list[np.ndarray]
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def discriminant(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        d0, d1 = (i @ (z - m).T for i, m in zip(self.inverses, self.means, strict=True))
        return 0.5 * ((d0**2).sum(0) - (d1**2).sum(0)) + self.offset

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.discriminant(x) + self.shift, -500, 500)))


def inverse(lower: np.ndarray) -> np.ndarray:
    """The inverse of a lower triangle, by forward substitution."""
    out = np.eye(len(lower))
    for k in range(len(lower)):
        out[k] = (out[k] - lower[k, :k] @ out[:k]) / lower[k, k]
    return out


def fit_sums(total: np.ndarray, shrink: float = SHRINK, pooled: float = POOLED) -> Model:
    """The model of class sums [class, i, j] of products of (1, statistics)."""
    n = total[:, 0, 0]
    if not n.all():
        return Model(np.zeros(D), np.ones(D), [], [], [], 0.0, constant=float(n[1] / n.sum()) if n.sum() else 0.5)
    both = total.sum(0)
    centre = both[0, 1:] / n.sum()
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / n.sum() - centre**2, 1e-12))
    spread = lambda t: (t[1:, 1:] / t[0, 0] - np.outer(t[0, 1:], t[0, 1:]) / t[0, 0] ** 2) / np.outer(scale, scale)
    whole, means, factors = spread(both), [], []
    for t in total:
        own = spread(t)
        cov = (1 - shrink) * own + shrink * (pooled * whole + (1 - pooled) * np.trace(own) / D * np.eye(D))
        means.append((t[0, 1:] / t[0, 0] - centre) / scale)
        factors.append(np.linalg.cholesky(cov + 1e-9 * np.eye(D)))
    logdet = [np.log(np.diag(f)).sum() for f in factors]
    return Model(centre, scale, means, factors, [inverse(f) for f in factors], float(logdet[0] - logdet[1] + np.log(n[1] / n[0])))


STEP, FAR = 0.25, 60.0


def fit_curve(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and shift of the logistic curve for (discriminant, label, count), by Newton steps with a small ridge; classes weigh the same."""
    d, y, n = (np.array(c, float) for c in zip(*rows, strict=True))
    w = np.where(y == 1, n / max(n[y == 1].sum(), 1), n / max(n[y == 0].sum(), 1)) * n.sum() / 2
    x, b = np.column_stack([d, np.ones(len(d))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        step = np.linalg.solve((x.T * (w * p * (1 - p))) @ x + 1e-2 * np.eye(2), x.T @ (w * (y - p)) - 1e-2 * b)
        b = b + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return float(b[0]), float(b[1])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def known(labels: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, quality of the labelled rows to learn from, most at most: none is held out, and each id has one label."""
    rows = pick(labels, doc_id="long", quality="int").where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return stored(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "quality-labels")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """The model of the documents that labels name; their number, and with it what is broadcast, is at most most."""
    side = F.broadcast(known(labels, most))
    learn = pick(docs, doc_id="long", text="string").join(side.select("doc_id"), "doc_id", "left_semi")
    rows = stored(measured(learn), "quality-learning", texts=True).join(side, "doc_id")
    total = np.zeros((2, D + 1, D + 1))
    for r in rows.mapInArrow(_sums, "c long, i long, j long, s double").groupBy("c", "i", "j").agg(F.sum("s").alias("s")).collect():
        total[r.c, r.i, r.j] = r.s
    model = fit_sums(total)
    if model.constant is None:

        def bins(batches):
            for b in batches:
                at = np.round(np.clip(model.discriminant(matrix(b)), -FAR, FAR) / STEP).astype(np.int64)
                yield pa.record_batch([pa.array(at), b.column("quality")], ["at", "quality"])

        counts = rows.mapInArrow(bins, "at long, quality int").groupBy("at", "quality").agg(F.count(F.lit(1)).alias("n")).collect()
        model.slope, model.shift = fit_curve([(r["at"] * STEP, r["quality"], r["n"]) for r in counts])
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    model = fit(docs, labels)

    def score(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()], float).reshape(-1, D)
            yield pa.record_batch([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    got = pick(docs, doc_id="long", text="string").select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(score, "doc_id long, score double")
    return got.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted to be of quality, with their columns."""
    model = fit(docs, labels)

    def measure(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in text], float).reshape(-1, D)))

    score = F.pandas_udf(measure, "double")

    return docs.where(score(F.col("text").cast("binary")) >= THRESHOLD)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
