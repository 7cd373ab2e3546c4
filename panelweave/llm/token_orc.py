"""Token ids in ORC files, written in id order and read by stripe.

Documents are placed by range of their id, so that the files, in order of their
names, hold all documents in ascending order; each task encodes its sorted rows
with the tokenizers library and writes one file. Ids are integer lists, which
ORC stores by run-length encoding; stripes carry row indexes, and Bloom filters
on the document id. Scans read stripes side by side; a look-up by id skips
files, stripes and row groups by those statistics.

A row holds its task's number and the ids before it in that task; one total per
file turns these into a position in the whole corpus, without moving the ids.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm.bpe import byte_symbols
from panelweave.llm.common import bound_batches

SCHEMA = "doc_id long, part int, first long, n_tokens int, ids array<int>"
# Text that one file holds, about.
FILE_BYTES = 128 << 20
# Most files; their totals, 24 bytes a file, are broadcast.
MOST_FILES = 1 << 20
# Strings between spaces that a task remembers, and characters of the longest.
REMEMBERED, LONGEST = 400_000, 64
# Below this code point a letter is Latin and composed.
LATIN = "ɐ"


class Chunks(dict):
    """Ids, as little-endian bytes, of strings between spaces.

    For vocabularies with word ends, which drop white space before anything
    else: such a string is encoded the same alone as in its text. A word of
    Latin letters is one piece for the library's model, also before punctuation;
    any other string is encoded by the whole library.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.symbols = dict(enumerate(byte_symbols()))
        self[""] = b""

    def word(self, letters: str) -> bytes:
        shown = letters.lower().encode().decode("latin-1").translate(self.symbols)
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > LONGEST:
            return self.whole(chunk)
        core = chunk.rstrip(string.punctuation)
        if not core.lower().isalpha() or max(core) >= LATIN:  # a dotted capital I falls apart
            ids = self.whole(chunk)
        elif len(core) == len(chunk):
            ids = self.word(core)
        else:
            ids = self[core] + self[chunk[len(core):]]
        if len(self) >= REMEMBERED:
            self.clear()
            self[""] = b""
        self[chunk] = ids
        return ids


class Encoder:
    """Whole texts to ids as the tokenizers library gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.chunks = Chunks(self.tokenizer) if model.get("end_of_word_suffix") else None

    def encode(self, text: str) -> bytes:
        if self.chunks is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 2, file_bytes: int = FILE_BYTES,
          stripe_bytes: int = 16 << 20, index_rows: int = 1_000, text: str = "text") -> None:
    """Encode ``docs`` (doc_id, text) and write ORC files to ``folder``.

    Each document's ids end in ``end_id``. Null texts count as empty and hold
    the end id alone. Rows stand by id (null first), then by a hash of the text,
    then by their place in the table, so that rows that repeat an id or a whole
    row are separate documents and spread over files. Other columns are left
    out. An empty table writes files without rows.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    spark = docs.sparkSession
    bound_batches(spark)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes)), MOST_FILES)
    rows = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("print"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("doc_id"), F.col("print"), F.col("row")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        part, first, made = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for batch in batches:
            ids = [made.encode(t) + end if t else end for t in batch.column("text").to_pylist()]
            counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            ends = np.cumsum(counts)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(first + ends - counts), pa.array(counts.astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), flat)],
                names=["doc_id", "part", "first", "n_tokens", "ids"])
            first += int(ends[-1]) if len(ends) else 0

    (rows.mapInArrow(run, SCHEMA).write.option("compression", "zstd").option("orc.stripe.size", stripe_bytes).option("orc.rows.between.memory.checks", 100)
     .option("orc.row.index.stride", index_rows).option("orc.create.index", "true")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(folder))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The stored documents: doc_id, start, n_tokens, ids. ``start`` counts the
    ids of all documents before. A filter on doc_id reaches the files."""
    rows = spark.read.schema(SCHEMA).orc(folder)
    # one row per file, at most MOST_FILES
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def lookup(spark: SparkSession, folder: str, ids) -> DataFrame:
    """(doc_id, ids) of the given documents, read past files, stripes and row
    groups that cannot hold them."""
    return spark.read.schema(SCHEMA).orc(folder).where(F.col("doc_id").isin(list(ids))).select("doc_id", "ids")


def digests(stored: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, the unsigned crc32 of the ids as
    little-endian 32-bit integers."""
    import pyarrow as pa

    names = ["doc_id", "start", "n_tokens"]

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            ends = np.asarray(lists.offsets)
            flat = np.ascontiguousarray(np.asarray(lists.values), "<i4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])

    bound_batches(stored.sparkSession)
    return stored.select(*names, "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
