"""Quality classifier: regularised quadratic discriminant on document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import bound_batches, fold, stored

SYMBOLS = "#*$%&|<>"
MARKS = "!?"
STOPS = ".,;:"
# Code points counted one by one; the rest count as other.
POINTS = 1024
NAMES = ("chars", "words", "lines", "word_length", "line_words", "distinct_words", "top_word", "repeated_lines",
         "upper", "digit", "space", "stops", "marks", "symbols", "brackets", "other", "symbol_words",
         "letterless_words", "char_entropy")


def _classes() -> np.ndarray:
    """Rows: upper, digit, space, stops, marks, symbols, brackets, other; columns: code points."""
    out = np.zeros((8, POINTS))
    for i in range(POINTS):
        c = chr(i)
        tests = (c.isupper(), c.isdigit(), c.isspace(), c in STOPS, c in MARKS, c in SYMBOLS, c in "()[]{}=+/\\@_\"'~^`")
        out[:7, i] = tests
    out[7, POINTS - 1] = 1
    return out


CLASSES = _classes()
SYMBOL_SET = frozenset(SYMBOLS)


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of one text: logarithms of counts, log-odds of shares."""
    n = len(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    counts = np.bincount(np.minimum(points, POINTS - 1), minlength=POINTS)
    shares = CLASSES @ counts / max(n, 1)
    p = counts[counts > 0] / max(n, 1)
    entropy = float(-(p * np.log2(p)).sum()) if n else 0.0
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(words)
    m = len(words)
    marked = sum(k for w, k in seen.items() if w[-1] in SYMBOL_SET or w[0] in SYMBOL_SET)
    letterless = sum(k for w, k in seen.items() if not any(map(str.isalnum, w)))
    sizes = np.array([n, m, len(lines), (n - counts[32]) / max(m, 1), m / max(len(lines), 1)], float)
    rates = np.array([len(seen) / max(m, 1), max(seen.values(), default=0) / max(m, 1),
                      1 - len(set(lines)) / max(len(lines), 1)])
    tail = np.array([marked / max(m, 1), letterless / max(m, 1)])
    rates = np.concatenate((rates, shares, tail))
    odds = np.log((rates + 0.002) / (1.002 - rates))
    return np.concatenate((np.log1p(sizes), odds, [entropy]))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, stats): the statistics of every whole text; null counts as empty."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [statistics(x or "").tolist() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "stats"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, stats array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors of the class covariances, and the
    constant of the log-density difference."""

    means: np.ndarray
    factors: np.ndarray
    constant: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        d = [((x - m) @ f.T) for m, f in zip(self.means, self.factors)]
        gap = self.constant - 0.5 * ((d[1] ** 2).sum(1) - (d[0] ** 2).sum(1))
        return 1 / (1 + np.exp(-np.clip(gap, -60, 60)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of the statistics for each class ``y``,
    added up inside each task before the shuffle."""
    import pyarrow as pa

    d = len(NAMES)

    def run(batches):
        total = {}
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.asarray(batch.column(1).values).reshape(-1, d)
            for k in np.unique(y):
                part = x[y == k]
                full = np.concatenate(([len(part)], part.sum(0), (part.T @ part).ravel()))
                total[int(k)] = total.get(int(k), 0) + full
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(v), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["y", "at", "v"])

    got = rows.select("y", "stats").mapInArrow(run, "y int, at int, v double").groupBy("y", "at").agg(F.sum("v").alias("v")).collect()
    out = {}
    for k in {r.y for r in got}:
        v = np.zeros(1 + d + d * d)
        for r in got:
            if r.y == k:
                v[r.at] = r.v
        out[k] = (v[0], v[1:1 + d], v[1 + d:].reshape(d, d))
    return out


def fit(rows: DataFrame, shrink: float = 0.1, ridge: float = 0.02) -> Discriminant | float:
    """Fit on (y, stats). Each class covariance is moved by ``shrink`` towards
    the diagonal of the pooled one, plus ``ridge`` of variance. With fewer than
    two classes the result is the share of class 1 (0.5 without any row)."""
    found = moments(rows)
    if len(found) < 2:
        return float(next(iter(found), 0.5))
    means, covs, sizes = [], [], []
    for k in (0, 1):
        n, s, p = found[k]
        mean = s / n
        means.append(mean)
        covs.append(p / n - np.outer(mean, mean))
        sizes.append(n)
    pooled = np.diag(sum(n * c for n, c in zip(sizes, covs)) / sum(sizes))
    covs = [(1 - shrink) * c + np.diag(shrink * pooled + ridge) for c in covs]
    factors = [np.linalg.inv(np.linalg.cholesky(c)) for c in covs]
    logs = [np.log(np.diagonal(f)).sum() for f in factors]
    return Discriminant(np.array(means), np.array(factors), float(logs[1] - logs[0] + np.log(sizes[1] / sizes[0])))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learned from all labelled rows outside the held-out fold. Statistics are
    computed once for each text and stored; only they meet the labels. Null and
    empty texts get the score of a text without words. Repeated rows score
    alike; an id labelled twice counts once, with the larger label; rows with a
    null label or label other than 0 and 1 are not learned from; a null id is in
    no held-out fold by rule of its empty text form and is never learned from.
    Without rows of both classes every score is the share of class 1 (0.5
    without labels). Other columns are ignored; an empty table gives an empty one.
    """
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    stats = stored(with_statistics(docs), "quality-stats")
    y = (labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    model = fit(stats.where(fold("doc_id", folds) != held).join(y, "doc_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).values).reshape(-1, len(NAMES))
            score = model.score(x) if isinstance(model, Discriminant) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
