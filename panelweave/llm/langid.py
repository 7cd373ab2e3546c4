"""Language identification with a byte convolutional network in numpy.

Byte embeddings, filters of several widths, max pooling and softmax. Texts are
cut into windows of fixed length that overlap by the widest filter, so that
every byte sequence a filter can see lies in one window; a text's scores are
the sums of its windows' log-probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import bound_batches, fold

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 10
EMBED = 8
WIDEST = max(WIDTHS)
STEP = WINDOW - WIDEST + 1
# Windows that pass through the network together.
BATCH = 64
LETTER = regex.compile(r"\p{L}")


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text, padded with zero bytes."""
    n = max(1, -(-(len(raw) - WIDEST + 1) // STEP))
    out = np.zeros((n, WINDOW), np.uint8)
    data = np.frombuffer(raw, np.uint8)
    for i in range(n):
        part = data[i * STEP:i * STEP + WINDOW]
        out[i, :len(part)] = part
    return out


@dataclass
class Network:
    """embed (256 x E), filters (WIDEST * E x F), bias (F), out (F x L), shift (L)."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    languages: list

    def patches(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x].reshape(len(x), -1)
        width = e.shape[1] - (WIDEST - 1) * EMBED
        shape = (len(x), width // EMBED, WIDEST * EMBED)
        strides = (e.strides[0], e.strides[1] * EMBED, e.strides[1])
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, shape, strides)).reshape(-1, WIDEST * EMBED)

    def pooled(self, x: np.ndarray):
        maps = (self.patches(x) @ self.filters).reshape(len(x), -1, self.filters.shape[1])
        return maps

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        top = np.maximum(self.pooled(x).max(1) + self.bias, 0)
        z = top @ self.out + self.shift
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _mask() -> np.ndarray:
    """Filters narrower than the widest see only their first bytes."""
    widths = np.repeat(WIDTHS, FILTERS)
    place = np.repeat(np.arange(WIDEST), EMBED)
    return (place[:, None] < widths[None, :]).astype(np.float32)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean negative log-probability of classes ``y``."""
    b, width = len(x), net.filters.shape[1]
    patches = net.patches(x)
    maps = (patches @ net.filters).reshape(b, -1, width)
    best = maps.argmax(1)
    pre = np.take_along_axis(maps, best[:, None, :], 1)[:, 0] + net.bias
    top = np.maximum(pre, 0)
    z = top @ net.out + net.shift
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(b), y] -= 1
    p /= b
    dpre = (p @ net.out.T) * (pre > 0)
    # Each filter learns from the one place where it was largest.
    where = np.arange(b)[:, None] * maps.shape[1] + best
    seen = patches[where.ravel()].reshape(b, width, -1)
    grads = {"out": top.T @ p, "shift": p.sum(0), "bias": dpre.sum(0), "filters": np.einsum("bf,bfd->df", dpre, seen) * _mask()}
    back = (dpre[:, :, None] * net.filters.T[None]).reshape(b, width, WIDEST, EMBED)
    bytes_at = x[np.arange(b)[:, None, None], best[:, :, None] + np.arange(WIDEST)]
    grads["embed"] = np.zeros_like(net.embed)
    np.add.at(grads["embed"], bytes_at.ravel(), back.reshape(-1, EMBED))
    return grads


def train(x: np.ndarray, y: np.ndarray, languages: list, rounds: int = 6, rate: float = 0.004, seed: int = 7) -> Network:
    """Fit by Adam on windows ``x`` and class numbers ``y``."""
    rng = np.random.default_rng(seed)
    width = len(WIDTHS) * FILTERS
    net = Network(
        rng.normal(0, 0.3, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.25, (WIDEST * EMBED, width)) * _mask()).astype(np.float32),
        np.zeros(width, np.float32), rng.normal(0, 0.1, (width, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32), languages)
    names = ("embed", "filters", "bias", "out", "shift")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            grads = gradients(net, x[rows], y[rows])
            step += 1
            for k in names:
                g = grads[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                change = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - rate * change).astype(np.float32))
    return net


def sample_windows(docs: DataFrame, lang: str, folds: int, held: int, per_language: int, per_text: int):
    """Training windows of up to about ``per_language`` texts of each language,
    chosen by a hash of the id, and ``per_text`` windows spread over each text.
    Only these windows reach the driver."""
    import pyarrow as pa

    known = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & (F.col("text") != "")
                       & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang)).count().collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    whole = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(whole * min(1.0, per_language / n)))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(whole)) < F.element_at(share, F.col(lang)))

    def run(batches):
        for batch in batches:
            langs, parts, keys = [], [], []
            for key, lang_, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                room = max(0, len(raw) - WINDOW)
                for at in sorted({room * i // max(1, per_text - 1) for i in range(per_text)}):
                    langs.append(lang_)
                    parts.append(raw[at:at + WINDOW])
                    keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(langs, pa.string()), pa.array(parts, pa.binary())],
                                             names=["key", "lang", "raw"])

    rows = chosen.select(F.xxhash64("doc_id").alias("key"), F.col(lang).alias("lang"), "text").mapInArrow(
        run, "key long, lang string, raw binary").collect()
    rows.sort(key=lambda r: (r.key, r.lang, bytes(r.raw)))
    languages = sorted(counts)
    place = {k: i for i, k in enumerate(languages)}
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for i, r in enumerate(rows):
        x[i, :len(r.raw)] = np.frombuffer(bytes(r.raw), np.uint8)
    return x, np.array([place[r.lang] for r in rows], np.int64), languages


def predict(docs: DataFrame, folds: int = 4, held: int = 2, per_language: int = 1200, per_text: int = 3) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    The network learns from at most about ``per_language`` texts of each
    language outside the held-out fold; it then reads every window of every
    whole text. A text that is null or has no letter gets ``und`` with score 0,
    as does every text if no language is known. Repeated rows are predicted
    alike; a null id is never learned from. Other columns are ignored; an empty
    table gives an empty one.
    """
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    x, y, languages = sample_windows(docs, "lang", folds, held, per_language, per_text)
    net = train(x, y, languages) if languages else None
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if net else []
            total = np.zeros((len(texts), len(languages)))
            held_rows, held_windows, n = [], [], 0

            def flush():
                if held_windows:
                    owners, cut = np.concatenate(held_rows), np.concatenate(held_windows)
                    for at in range(0, len(cut), BATCH):
                        np.add.at(total, owners[at:at + BATCH], net.log_probs(cut[at:at + BATCH]))

            for i in rows:
                cut = windows(texts[i].encode("utf-8", "surrogatepass"))
                held_rows.append(np.full(len(cut), i))
                held_windows.append(cut)
                n += len(cut)
                if n >= 4096:
                    flush()
                    held_rows, held_windows, n = [], [], 0
            flush()
            for i in rows:
                p = np.exp(total[i] - total[i].max())
                best = int(p.argmax())
                pred[i], score[i] = languages[best], p[best] / p.sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
