"""Document fingerprints: quartile bucket digests of hashed byte triplets."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import bound_batches, stored

BUCKETS = 128
# Offsets of the bytes of a triplet inside a sliding window of five bytes.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
# Largest bucket difference, and the difference at which likeness reaches 0.
CODE_STEP = (0, 1, 2, 6)
LENGTH_CAP = 12
SCALE = 2.0 * BUCKETS

# Tabulation hashing: one table of bucket numbers per triplet and place.
_TABLES = [[bytes(hashlib.sha256(bytes((k, place, b))).digest()[0] % BUCKETS for b in range(256)) for place in range(3)]
           for k in range(len(TRIPLETS))]
_STEP = np.array(CODE_STEP, np.int64)


def bucket_counts(raw: bytes) -> np.ndarray:
    """How many triplets fall in each bucket; shorter texts count what they have."""
    counts = np.zeros(BUCKETS, np.int64)
    for tables, offsets in zip(_TABLES, TRIPLETS):
        n = len(raw) - offsets[-1]
        if n > 0:
            a, b, c = (np.frombuffer(raw.translate(t), np.uint8)[o:o + n] for t, o in zip(tables, offsets))
            counts += np.bincount(a ^ b ^ c, minlength=BUCKETS)
    return counts


def digest(raw: bytes) -> str:
    """Hex of: length step, ratio steps of the quartiles, two bits per bucket.

    A bucket's code is the number of quartiles (of all bucket counts) that its
    count exceeds. The length step is a logarithm of the byte length; 0 is empty.
    """
    counts = bucket_counts(raw)
    q = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > q).sum(1).reshape(-1, 4) @ np.array([1, 4, 16, 64])
    length = min(255, round(8 * np.log2(len(raw) + 1)))
    ratios = [int(q[0] * 15 // q[2]) if q[2] else 0, int(q[1] * 15 // q[2]) if q[2] else 0]
    return bytes([length, ratios[0] << 4 | ratios[1], *codes.tolist()]).hex()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling to 0 as the bounded difference score grows.

    The difference sums a step per bucket (0, 1, 2, 6 for codes 0 to 3 apart),
    the ratio steps and the length steps apart, the last up to a cap.
    """
    if a == b:
        return 1.0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8).astype(np.int64), np.frombuffer(bytes.fromhex(b), np.uint8).astype(np.int64)
    shifts = np.array([0, 2, 4, 6])
    gaps = np.abs((x[2:, None] >> shifts & 3) - (y[2:, None] >> shifts & 3))
    score = _STEP[gaps].sum() + abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15)) + min(LENGTH_CAP, abs(x[0] - y[0]))
    return float(max(0.0, 1.0 - score / SCALE))


def own_digest(text: str) -> str:
    return digest(text.encode("utf-8", "surrogatepass"))


def compare(text: str, own: str, following: str, after: str) -> tuple:
    """A text with its fingerprint against its edited form and against the next
    document with its fingerprint."""
    n = len(text)
    edited = (text[: n - n // 2] + following[: n // 2]).encode("utf-8", "surrogatepass")
    other = digest(edited)
    return n, hashlib.sha256(edited).hexdigest(), own, other, likeness(own, other), likeness(own, after)


NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
KINDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; null counts as empty."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            made = [own_digest(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Every document compared with its edited text and with the next document.

    The next document is the next row by ascending doc_id (null first; rows with
    one id by a hash of their text, so repeated rows follow one another); the
    first row follows the last. A single row follows itself. A null text counts as empty.
    Other columns are ignored; an empty table gives an empty one.

    Rows are placed by range of doc_id and sorted, and a task passes through its
    part with one row in hand. Only the outer rows of each part wait for their
    neighbour part: one row per part is joined by the part's number.
    """
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    schema = f"doc_id {kind}, {KINDS}, part int, head string, tail string"
    fields = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, head = None, None
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            ids, out = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                print_ = own_digest(text)
                if held is None:
                    head = text
                else:
                    ids.append(held[0])
                    out.append((*compare(*held[1:], text, print_), part, None, None))
                held = (doc_id, text, print_)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, id_type)] + [pa.array(list(c), k) for c, k in zip(zip(*out), fields)],
                    names=["doc_id", *NAMES, "part", "head", "tail"])
        if held is not None:
            values = [held[0], *[None] * len(NAMES), part, head, held[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, [id_type, *fields])], names=["doc_id", *NAMES, "part", "head", "tail"])

    made = stored(placed.mapInArrow(run, schema), "fingerprints")
    # One row per part: its first text, and its last row still to be compared.
    ends = made.where("tail IS NOT NULL").select("doc_id", "part", "head", "tail")
    parts = [r.part for r in ends.select("part").orderBy("part").collect()]
    follows = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, after int")
    heads = ends.select(F.col("part").alias("after"), F.col("head").alias("following"))
    pairs = ends.select("doc_id", "tail", "part").join(follows, "part").join(heads, "after")

    def close(batches):
        for batch in batches:
            out = [compare(a, own_digest(a), b, own_digest(b)) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)] + [pa.array(list(c), k) for c, k in zip(zip(*out), fields)], names=["doc_id", *NAMES])

    closed = pairs.select("doc_id", "tail", "following").mapInArrow(close, f"doc_id {kind}, {KINDS}")
    return made.where("tail IS NULL").select("doc_id", *NAMES).unionByName(closed)
