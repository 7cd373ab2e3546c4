"""Topic models of many parts of a corpus, fitted together.

Latent Dirichlet allocation by batch variational inference. The parts (a period
and a topic family, say) are told apart by a key: a document's step needs the
topics of its own model only, and the statistics of all models are summed by
(model, term) in one job an iteration.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.features import fit_grams_by, nonzero, term_stats_by
from panelweave.session import settle

# Steps of a document's own inference, and the mean change at which it stops.
INNER_STEPS, INNER_CHANGE = 50, 1e-3
# Entries (document, term) that a task works on together.
ENTRIES = 1 << 20
# Cells of a table of documents of like length by their terms; its numbers by
# topic stay within a processor's cache.
CELLS = 1 << 16
# Steps in 32 bits after which a document goes on in 64, and the count up to
# which it begins in 32.
SHORT_STEPS, SHORT_COUNT = 1000, 1 << 13
# Weight of pass i of an online fit: (OFFSET + i) ** -DECAY, as Spark ML's.
OFFSET, DECAY = 1024, 0.51


@dataclass
class Fitted:
    """``shares``: the kept columns, the model and topic_0, topic_1, ... per
    document; ``terms``: model, topic, term, weight."""
    shares: DataFrame
    terms: DataFrame


def expected_log(x: np.ndarray) -> np.ndarray:
    """exp(E[log p]) of Dirichlet parameters, by rows."""
    return np.exp(digamma(x) - digamma(x.sum(1))[:, None])


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6 and the asymptotic series from there."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        small = x < 6
        if not small.any():
            break
        out[small] -= 1 / x[small]
        x[small] += 1
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma) of positive numbers, from the series six steps up."""
    y, r = x * (x + 5), 1 / (x + 6)
    s = r * r
    series = np.log(x + 6) - 0.5 * r - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132))))
    return np.exp(series - (2 * x + 5) * (1 / y + 1 / (y + 4) + 1 / (y + 6)))


def trigamma(x) -> np.ndarray:
    """Of positive numbers, by recurrence and the asymptotic series."""
    x = np.asarray(x, float)
    r = 1 / (x + 6)
    s = r * r
    return sum(1 / (x + i) ** 2 for i in range(6)) + r * (1 + r / 2 + s * (1 / 6 - s * (1 / 30 - s * (1 / 42 - s / 30))))


def infer(beta: np.ndarray, at: np.ndarray, counts: np.ndarray, ends: np.ndarray, alpha):
    """(gamma, statistics) of documents under ``beta``, exp(E[log]) by (term,
    topic). Entries ``at`` and ``counts`` of document d end at ``ends[d]``; no
    document is empty. ``statistics`` has a row per entry."""
    gamma, theta, ratio = solve(beta, at, counts, ends, alpha)
    return gamma, np.repeat(theta, np.diff(ends, prepend=0), axis=0) * ratio[:, None]


def solve(beta, at, counts, ends, alpha, to_end=False):
    """(gamma, theta, ratio): entry e of document d adds ``theta[d] * ratio[e]`` to
    the statistics of its term.

    A document takes ``INNER_STEPS`` steps at most; ``to_end`` goes on until its
    mean change is below ``INNER_CHANGE``, by longer steps. Rows of ``beta`` may
    have any scale, to which gamma is indifferent. Documents of like length are
    worked on as a table padded to the longest.
    """
    n, k = len(ends), beta.shape[1]
    begin = np.append(0, ends[:-1])
    size = ends - begin
    gamma, theta, ratio = np.empty((n, k)), np.empty((n, k)), np.empty(len(at))
    for held in _tables(size):
        column = np.arange(int(size[held].max()))
        inside = column < size[held][:, None]
        place = np.minimum(begin[held][:, None] + column, ends[held][:, None] - 1)
        times = np.where(inside, counts[place], 0.0)
        kind = beta.dtype if times.sum(1).max() <= SHORT_COUNT else np.float64
        words, times = beta[at[place]].astype(kind, copy=False), times.astype(kind)
        first = np.ones((len(held), k))
        if to_end:
            found, left = _long_steps(words, times, alpha, first)
            if len(left):
                found[left], _ = _steps(words[left].astype(float), times[left].astype(float), alpha, found[left], None)
        else:
            found, _ = _steps(words, times, alpha, first, INNER_STEPS)
        gamma[held], theta[held] = found, exp_digamma(found)
        ratio[place[inside]] = _ratio(words, times, theta[held])[inside]
    return gamma, theta, ratio


def _tables(size):
    """Numbers of documents of like size, ``CELLS`` padded cells at a time."""
    order = np.argsort(size, kind="stable")
    size, start = size[order], 0
    while start < len(order):
        ahead = size[start:start + max(1, CELLS // int(size[start]))]
        stop = start + max(1, int(np.searchsorted(np.arange(1, len(ahead) + 1) * ahead, CELLS, "right")))
        yield order[start:stop]
        start = stop


def _ratio(words, times, theta):
    norm = np.matmul(words, theta.astype(words.dtype)[:, :, None])[:, :, 0] + np.finfo(words.dtype).tiny
    return times / norm


def _step(words, times, alpha, gamma):
    theta = exp_digamma(gamma).astype(words.dtype)
    return alpha + theta * np.matmul(_ratio(words, times, theta)[:, None, :], words)[:, 0]


def _steps(words, times, alpha, gamma, most):
    """(gamma, documents still moving) after ``most`` steps, or at rest if None."""
    out, open_, n = gamma.copy(), np.arange(len(gamma)), 0
    while len(open_) and n != most:
        new = _step(words, times, alpha, gamma)
        left = np.abs(new - gamma).mean(1) >= INNER_CHANGE
        out[open_], gamma, n = new, new, n + 1
        if not left.all():
            open_, words, times, gamma = open_[left], words[left], times[left], gamma[left]
    return out, open_


def _long_steps(words, times, alpha, gamma):
    """``_steps`` with every second one prolonged by the ratio of a step to its
    change from the step before (SQUAREM); a document at rest is so under a plain
    step. Also returns the documents that are not after ``SHORT_STEPS``."""
    out, open_ = gamma.copy(), np.arange(len(gamma))
    longest = np.full((len(gamma), 1), 4.0)
    for _ in range(SHORT_STEPS // 2):
        one = _step(words, times, alpha, gamma)
        step = one - gamma
        left = np.abs(step).mean(1) >= INNER_CHANGE
        out[open_] = one
        if not left.all():
            open_, words, times, gamma, one, step, longest = (v[left] for v in (open_, words, times, gamma, one, step, longest))
            if not len(open_):
                break
        two = _step(words, times, alpha, one)
        turn = two - one - step
        far = np.sqrt((step * step).sum(1, keepdims=True) / np.maximum((turn * turn).sum(1, keepdims=True), 1e-300))
        longest, far = np.where(far >= longest, 4 * longest, longest), np.clip(far, 1, longest)
        ahead = gamma + far * (2 * step + far * turn)
        gamma = np.where((ahead < alpha).any(1, keepdims=True), two, ahead)
    out[open_] = gamma
    return out, open_


def start(model: str, n_terms: int, k: int, seed: int) -> np.ndarray:
    """First topic parameters of a model; they depend on its own name alone."""
    rng = np.random.default_rng([seed, zlib.crc32(model.encode())])
    return rng.gamma(100.0, 0.01, (k, n_terms))


def vocabularies(rows, model, terms, min_df, max_df, max_terms) -> dict[str, list[str]]:
    """{model: terms}: the most frequent terms of each model among those in at
    least ``min_df`` documents and at most the share ``max_df``. At most
    ``max_terms`` terms a model reach the driver."""
    sizes = rows.groupBy(model).agg(F.count(F.lit(1)).alias("_docs"))
    kept = term_stats_by(rows, model, terms).join(F.broadcast(sizes), model).where(
        (F.col("df") >= min_df) & (F.col("df") <= F.col("_docs") * max_df))
    order = Window.partitionBy(model).orderBy(F.desc("tf"), "term")
    top = kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_terms)
    out: dict = {}
    for r in sorted(top.select(model, "_n", "term").collect(), key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(r[2])
    return out


def encode(rows, model, terms, places) -> DataFrame:
    """(kept columns, model, at, counts): each document's known terms by number,
    looked up in the broadcast vocabularies."""
    import pyarrow as pa

    rest = [c for c in rows.columns if c != terms]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*rest).schema.fields)

    def run(batches):
        for batch in batches:
            at, counts = [], []
            for name, words in zip(batch.column(model).to_pylist(), batch.column(terms).to_pylist()):
                known = places.value.get(name, {})
                found = np.array([known[w] for w in words or () if w in known], np.int64)
                number, times = np.unique(found, return_counts=True)
                at.append(number.astype(np.int32))
                counts.append(times.astype(np.int32))
            made = [pa.array(c, pa.list_(pa.int32())) for c in (at, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + made, names=[*rest, "at", "counts"])

    return rows.mapInArrow(run, f"{kinds}, at array<int>, counts array<int>")


def _grouped(batch, model):
    """(model, rows, at, counts, ends) of a batch's documents that have terms, a
    bounded number of entries at a time."""
    names = np.array(batch.column(model).to_pylist(), object)
    lists = batch.column("at")
    bounds, at = np.asarray(lists.offsets), np.asarray(lists.values)
    counts = np.asarray(batch.column("counts").values)
    sizes = np.diff(bounds)
    for name in sorted(set(names.tolist())):
        held, total = [], 0
        for row in np.flatnonzero((names == name) & (sizes > 0)).tolist():
            held.append(row)
            total += int(sizes[row])
            if total >= ENTRIES:
                yield name, *_entries(held, bounds, at, counts, sizes)
                held, total = [], 0
        if held:
            yield name, *_entries(held, bounds, at, counts, sizes)


def _entries(held, bounds, at, counts, sizes):
    place = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in held])
    return np.array(held), at[place], counts[place].astype(float), np.cumsum(sizes[held])


def statistics(encoded, model, beta, alpha, to_end=False) -> DataFrame:
    """(model, term, stats): summed over all documents, in one job. Term -1 has
    the sums of E[log theta], term -2 the number of documents."""
    import pyarrow as pa

    k = next(iter(beta.value.values())).shape[1]
    cols = [f"s{i}" for i in range(k)]

    def run(batches):
        total: dict = {}
        for batch in batches:
            for name, _, at, counts, ends in _grouped(batch, model):
                words = beta.value[name]
                gamma, theta, ratio = solve(words, at, counts, ends, alpha, to_end)
                sums, rest = total.setdefault(name, (np.zeros((k, len(words))), np.zeros((2, k))))
                each = np.diff(ends, prepend=0)
                for i in range(k):
                    sums[i] += np.bincount(at, np.repeat(theta[:, i], each) * ratio, len(words))
                rest[0] += (digamma(gamma) - digamma(gamma.sum(1))[:, None]).sum(0)
                rest[1] += len(gamma)
        for name, (sums, rest) in total.items():
            used = np.flatnonzero(sums.any(0))
            term = np.append(used, [-1, -2]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(term)), pa.array(term), *[pa.array(np.append(sums[i, used], rest[:, i])) for i in range(k)]],
                names=[model, "term", *cols])

    # every task hands on sums of all terms, so there is one task per core
    rows = encoded.select(model, "at", "counts").coalesce(encoded.sparkSession.sparkContext.defaultParallelism)
    parts = rows.mapInArrow(run, ", ".join([f"`{model}` string, term int", *[f"{c} double" for c in cols]]))
    return parts.groupBy(model, "term").agg(*[F.sum(c).alias(c) for c in cols])


def _collected(stats, sizes: dict, k: int):
    """{model: (statistics by (term, topic), sums of E[log theta], documents)}."""
    got = stats.toArrow()
    out = {m: (np.zeros((n, k)), np.zeros(k), 0) for m, n in sizes.items()}
    names, term = np.array(got.column(0).to_pylist(), object), got.column(1).to_numpy()
    values = np.column_stack([got.column(2 + i).to_numpy() for i in range(k)])
    for m in out:
        mine = names == m
        sums, elog, n = out[m]
        sums[term[mine & (term >= 0)]] = values[mine & (term >= 0)]
        for row in values[mine & (term == -1)]:
            elog = row
        for row in values[mine & (term == -2)]:
            n = int(round(row[0]))
        out[m] = sums, elog, n
    return out


def shares_of(encoded, model, beta, alpha, k, prefix="topic_", to_end=False, none=None) -> DataFrame:
    """Topic shares of every document; where it has no known term, ``none`` or
    even ones."""
    import pyarrow as pa

    rest = [c for c in encoded.columns if c not in ("at", "counts")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*rest).schema.fields)

    def run(batches):
        for batch in batches:
            out = np.full((batch.num_rows, k), 1.0 / k if none is None else none)
            for name, held, at, counts, ends in _grouped(batch, model):
                gamma, _, _ = solve(beta.value[name], at, counts, ends, alpha, to_end)
                out[held] = gamma / gamma.sum(1)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(out[:, i]) for i in range(k)],
                                             names=[*rest, *[f"{prefix}{i}" for i in range(k)]])

    return encoded.mapInArrow(run, kinds + "".join(f", {prefix}{i} double" for i in range(k)))


def fit_many(rows, model, terms, k=15, max_iter=10, min_df=50, max_df=0.8, max_terms=10_000, alpha=0.5, eta=0.01,
             seed=42, keep=(), prefix="topic_", words=None, extra=None) -> Fitted:
    """Fit one topic model for each value of ``model``.

    ``rows`` has one row per document and model, with a list of ``terms``. The
    vocabulary of a model follows from its own documents; a model without terms
    is left out, with its documents. Documents are stored once by term numbers.
    An iteration is one job for all models: the topics (models x terms x k
    numbers) are broadcast, the statistics summed by (model, term). Fits are the
    same one at a time or together, since a model's start depends on its name.
    A null model is left out; null and empty lists have even shares. Where
    ``terms`` are the words and pairs of ``words`` and the terms of ``extra``, they
    are counted by number (``features.fit_grams_by``).
    """
    spark = rows.sparkSession
    share = spark.sparkContext.broadcast
    rows = rows.where(F.col(model).isNotNull())
    made = fit_grams_by(rows, model, words, extra, list(keep), max_terms, min_df, max_df) if words else None
    if made:
        vocab, encoded = made
    else:
        rows = settle(rows.select(*keep, model, terms))
        vocab = vocabularies(rows, model, terms, min_df, max_df, max_terms)
        places = share({m: {t: i for i, t in enumerate(v)} for m, v in vocab.items()})
        known = rows.where(F.col(model).isin(list(vocab))) if vocab else rows.where(F.lit(False))
        encoded = settle(encode(known, model, terms, places))
    topics = {m: start(m, len(v), k, seed) for m, v in vocab.items()}
    for _ in range(max_iter if vocab else 0):
        beta = share({m: expected_log(t).T.copy() for m, t in topics.items()})
        sums = _collected(statistics(encoded, model, beta, alpha), {m: len(v) for m, v in vocab.items()}, k)
        topics = {m: eta + (s * beta.value[m]).T for m, (s, _, _) in sums.items()}
        beta.unpersist()
    last = share({m: expected_log(t).T.copy() for m, t in topics.items()})
    shares = settle(shares_of(encoded, model, last, alpha, k, prefix))
    weights = [(m, f"{prefix}{i}", term, float(w)) for m, t in topics.items()
               for i, row in enumerate(t / t.sum(1)[:, None]) for term, w in zip(vocab[m], row)]
    return Fitted(shares, spark.createDataFrame(weights, f"`{model}` string, topic string, term string, weight double"))


class TopicModel:
    """Topics over a vocabulary: ``weights`` by (term, topic), and the documents'
    concentration ``alpha`` by topic. In use like Spark ML's."""

    def __init__(self, weights: np.ndarray, alpha: np.ndarray):
        self.weights, self.alpha = weights, alpha

    def getK(self) -> int:
        return self.weights.shape[1]

    def vocabSize(self) -> int:
        return len(self.weights)

    def topicsMatrix(self) -> DenseMatrix:
        return DenseMatrix(*self.weights.shape, self.weights.ravel("F"))

    def words(self) -> np.ndarray:
        """exp(E[log]) by (term, topic), each term scaled to 1 at most; 32 bits
        hold what is left."""
        beta = exp_digamma(self.weights) / exp_digamma(self.weights.sum(0))
        return (beta / beta.max(1, keepdims=True)).astype(np.float32)

    def transform(self, df, features="features", out="topicDistribution") -> DataFrame:
        """With the topic shares of every document, zeros where it has no term."""
        k, rest = self.getK(), [c for c in df.columns if c != features]
        beta = df.sparkSession.sparkContext.broadcast({"all": self.words()})
        rows = shares_of(_one_model(df, features, rest), "_model", beta, self.alpha, k, "_share", True, 0.0)
        return rows.select(*rest, array_to_vector(F.array(*[f"_share{i}" for i in range(k)])).alias(out))


def _one_model(df, features, keep=()) -> DataFrame:
    v = nonzero(features)
    return df.select(*keep, F.lit("all").alias("_model"), v["at"].alias("at"), v["values"].alias("counts"))


def fit_online(df, first: np.ndarray, alpha, eta, max_iter, features="features") -> TopicModel:
    """Online variational inference from the topics ``first`` (term, topic), every
    pass over all documents, with the weights and the update of ``alpha`` of Spark
    ML's online fit.

    ``df`` is stored, its ``features`` are counts. A pass is one job; a document
    is inferred until it rests. A pass without any term changes nothing.
    """
    model = TopicModel(first, np.asarray(alpha, float))
    encoded, k = _one_model(df, features), first.shape[1]
    for i in range(1, max_iter + 1):
        words, weight = model.words(), (OFFSET + i) ** -DECAY
        beta = df.sparkSession.sparkContext.broadcast({"all": words})
        sums, elog, n = _collected(statistics(encoded, "_model", beta, model.alpha, True), {"all": len(first)}, k)["all"]
        beta.unpersist()
        if n:
            model = TopicModel((1 - weight) * model.weights + weight * (sums * words + eta), _concentration(model.alpha, elog / n, n, weight))
    return model


def _concentration(alpha, elog, n, weight) -> np.ndarray:
    """A weighted Newton step towards the most likely concentration; ``elog`` is
    the mean E[log theta]. It stays as it is where the step would leave zero."""
    slope = n * (elog - digamma(alpha) + digamma(alpha.sum()))
    c, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
    step = -(slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
    new = alpha + weight * step
    return new if (new > 0).all() else alpha
