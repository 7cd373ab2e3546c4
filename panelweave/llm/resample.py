"""Importance resampling towards a target distribution, with hashed features.

A document's features are its runs of 1 to ``ngrams`` words; a feature's bucket
is the CRC of its bytes. The vocabulary has a head and a tail:

1. Words are counted over all documents. The CRC states of the most frequent
   ones are broadcast; where runs of two words are wanted, so are those of the
   most frequent pairs, counted among neighbours that both stand in the head (a
   pair is no more frequent than its words).
2. A feature of the head is looked up; any other takes its CRC directly, from
   the state of the run before it. Both give the same bucket, so that the head
   decides the speed alone. Bucket totals are summed over all documents and all
   target texts.
3. A document's weight is the floored mean of its buckets' gains; with Gumbel
   noise from its id, the documents with the highest scores are a draw without
   replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import bound_batches, stored

# Words and pairs in the broadcast head, and bytes of the longest word in it: at
# most about 65,536 x (48 + 100) + 65,536 x 250 bytes in a Python process.
HEAD, HEAD_PAIRS, HEAD_BYTES = 65_536, 65_536, 48
# Distinct words that a task counts before it hands them on.
COUNTED = 200_000
OUT = ("n_features", "weight", "score", "rank")


def _letters() -> bytes:
    """A-Z as a-z; all other ASCII but digits and small letters as a space."""
    keep = {*range(48, 58), *range(97, 123), *range(128, 256)}
    return bytes(b + 32 if 65 <= b <= 90 else b if b in keep else 32 for b in range(256))


LETTERS = _letters()


def words(text: str | None) -> list[bytes]:
    """Runs of digits, small letters and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


class Head:
    """CRC values of frequent words and pairs."""

    def __init__(self, top=(), pairs=()):
        self.state = {w: zlib.crc32(w) for w in top}
        self.pair = {(a, b): zlib.crc32(a + b" " + b) for a, b in pairs}

    def values(self, row: list[bytes], ngrams: int) -> list[int]:
        """CRC of every run of 1 to ``ngrams`` words."""
        state, crc = self.state, zlib.crc32
        runs = [state[w] if w in state else crc(w) for w in row]
        out = runs
        for k in range(2, ngrams + 1):
            pair = self.pair if k == 2 else {}
            before = row[:-1] if k == 2 else row
            runs = [pair[a, b] if (a, b) in pair else crc(b" " + b, s) for s, a, b in zip(runs, before, row[k - 1:])]
            out = out + runs
        return out


def _counted(texts: DataFrame, keys_of) -> DataFrame:
    """(key, n): how often each key that ``keys_of`` makes of a text occurs."""
    import pyarrow as pa

    def run(batches):
        def release():
            names = list(found)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([found[k] for k in names], pa.int64())], names=["key", "n"])

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(keys_of(words(text)))
                if len(found) > COUNTED:
                    yield release()
                    found.clear()
        if found:
            yield release()

    return texts.mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def head_of(texts: DataFrame, ngrams: int, head: int = HEAD, pairs: int = HEAD_PAIRS) -> Head:
    """The head of the vocabulary of a one-column table of texts. At most
    ``head`` words of at most HEAD_BYTES bytes, and ``pairs`` pairs of them,
    reach the driver."""
    def most(counts, n, name):
        # Whole steps of frequency, an eighth of a doubling each, from the top
        # while they fit; a hundred or so steps reach the driver.
        counts = stored(counts.where("n > 1").withColumn("step", F.floor(F.log2("n") * 8)), name)
        room, least = n, None
        for step, size in sorted(((r.step, r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True):
            room -= size
            if room < 0:
                break
            least = step
        return [] if least is None else [bytes(r[0]) for r in counts.where(F.col("step") >= least).select("key").collect()]

    top = most(_counted(texts, lambda row: row).where(F.octet_length("key") <= HEAD_BYTES), head, "resample-words") if head else []
    if ngrams < 2 or not top or not pairs:
        return Head(top)
    known = texts.sparkSession.sparkContext.broadcast(frozenset(top))

    def neighbours(row):
        inside = known.value
        return [a + b" " + b for a, b in zip(row, row[1:]) if a in inside and b in inside]

    return Head(top, [tuple(p.split(b" ")) for p in most(_counted(texts, neighbours), pairs, "resample-pairs")])


def bucket_totals(texts: DataFrame, head, ngrams: int, buckets: int) -> list[int]:
    """Features in each bucket, over all texts of a one-column table; ``head``
    is broadcast. One row per bucket and task is summed."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                row = words(text)
                if row:
                    total += np.bincount(np.array(head.value.values(row, ngrams), np.int64) % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = [0] * buckets
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """floor(1000 ln) of the smoothed target share over the source share."""
    b, s_all, t_all = len(source), sum(source), sum(target)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source, target)], np.int64)


def weighted(docs: DataFrame, head, gain, ngrams: int, buckets: int, text: str) -> DataFrame:
    """Replace ``text`` by ``n_words``, ``n_features`` and ``weight``."""
    import pyarrow as pa

    rest = [c for c in docs.columns if c != text]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in rest]).schema.fields]

    def run(batches):
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for value in batch.column(text).to_pylist():
                row = words(value)
                found = head.value.values(row, ngrams)
                n_words.append(len(row))
                n_features.append(len(found))
                weight.append(int(gain.value[np.array(found, np.int64) % buckets].sum()) // len(found) if found else 0)
            made = [pa.array(c, pa.int64()) for c in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + made, names=rest + ["__n_words", "n_features", "weight"])

    return docs.mapInArrow(run, ", ".join([*kinds, "__n_words long, n_features long, weight long"]))


def noise(doc_id: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first digits of sha256 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = 10_000, min_words: int = 20,
             percent: int = 10, seed: int = 2024, head: int = HEAD, pairs: int = HEAD_PAIRS, keep=("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns of every document with ``n_features``, ``weight``,
    ``score`` and, for the drawn ones, ``rank``.

    ``docs`` has ``doc_id`` and ``text``, ``target`` has ``text``. Of the N
    documents with ``min_words`` words or more, the floor(percent * N / 100)
    with the highest scores are drawn and numbered from 1; ties go to the
    smaller id (null ids last), then to the smaller hash of the text. Null and
    empty texts have no features, weight 0, and are not drawn; texts are read
    whole. A null id counts as an empty one for the noise. Rows that share id
    and text are separate documents with equal scores. An empty target has no
    totals; an empty table gives an empty one. Columns outside ``keep`` are left
    out, and kept columns called like an output column are replaced.

    Ranks come from a running count over rows placed by range of the score, so
    the drawn rows never meet in one task.
    """
    from panelweave.operators.spread import running_total

    spark = docs.sparkSession
    bound_batches(spark)
    keep = [c for c in dict.fromkeys(["doc_id", *keep]) if c not in (*OUT, text)]
    source, wanted = docs.select(text), target.select(text)
    share = spark.sparkContext.broadcast
    vocabulary = share(head_of(source, ngrams, head, pairs))
    gain = share(gains(bucket_totals(source, vocabulary, ngrams, buckets), bucket_totals(wanted, vocabulary, ngrams, buckets)))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"),
                       F.xxhash64(text).alias("__print"), F.monotonically_increasing_id().alias("__row"))
    rows = weighted(rows, vocabulary, gain, ngrams, buckets, "__text").withColumn("score", F.col("weight") + noise("doc_id", seed))
    rows = stored(rows, "resample-scores")
    long_enough = rows.where(F.col("__n_words") >= min_words)
    drawn = percent * long_enough.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("__print"), F.col("__row")]
    ranked = running_total(long_enough, [], order, F.lit(1).cast("long"), "__place") if drawn else long_enough.withColumn("__place", F.lit(1).cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("__place") <= drawn, F.col("__place"))).drop("__place")
    others = rows.where(F.col("__n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).select(*keep, *OUT)
