"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of bands are hashed, A and B; every pair (A_i, B_j) is
the key of one table. HALVES bands on each side give HALVES x HALVES tables
from 2 x HALVES x ROWS minhashes, where plain banding would need the square.
Candidates are compared on their full shingle sets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import bound_batches, stored
from panelweave.llm.components import components

SHINGLE = 3
# Bands on each side and minhashes per band. At similarity 0.85 a band of 2
# agrees with chance 0.72, so all 8 of a side differ with chance 3.5e-5.
HALVES, ROWS = 8, 2
# Shingles of one block when a cluster of unresolved candidates is compared.
BLOCK = 120_000

MASK = (1 << 64) - 1


def _splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def _row(seed: int, n: int, odd: bool = False) -> np.ndarray:
    return np.array([_splitmix(seed * 1000 + i) | odd for i in range(n)], np.uint64)


BYTES = _row(1, 256)
BASE = np.uint64(_splitmix(2) | 1)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACES = _row(3, 16, odd=True)
FACTORS = _row(4, 2 * HALVES * ROWS, odd=True)
SHIFTS = _row(5, 2 * HALVES * ROWS)
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * (self.up[-1:] * BASE)))
            self.down = np.concatenate((self.down, self.down * (self.down[-1:] * BACK)))
            assert len(self.up) == 2 * k
        return self.up, self.down


POWERS = Powers()


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of ``width`` words (16 at most) of
    a whole text, ascending."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(LOWER), np.uint8)
    edges = np.diff(IS_WORD[raw].view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = POWERS.get(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * up[:len(raw)])))
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        total += words[k:len(words) - size + 1 + k] * PLACES[k]
    return np.unique(mix(total))


def signature(found: np.ndarray) -> np.ndarray:
    """The bands of both sides: HALVES of A, then HALVES of B."""
    least = np.full(len(FACTORS), MASK, np.uint64)
    for at in range(0, len(found), 8192):
        least = np.minimum(least, (found[at:at + 8192, None] * FACTORS + SHIFTS).min(0))
    bands = least.reshape(-1, ROWS)
    out = bands[:, 0]
    for k in range(1, ROWS):
        out = mix(out) + bands[:, k]
    return mix(out)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n, d1, d2, bands): set size, two digests of the set, bands."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width)
                if len(found):
                    rows.append((len(found), int(np.bitwise_xor.reduce(found).view(np.int64)),
                                 int(mix(found).sum().view(np.int64)), signature(found).view(np.int64).tolist()))
                else:
                    rows.append((0, 0, 0, []))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            cols = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n", "d1", "d2", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, bands array<long>")


def tables(reps: DataFrame) -> DataFrame:
    """(key, id, n): the tables' keys of each representative.

    A band that nobody else has cannot match, so single bands are counted first
    and keys are formed from shared ones only.
    """
    halves = reps.select("id", "n", F.posexplode("bands").alias("p", "v"))
    shared = halves.groupBy("p", "v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("p", "v")
    alive = halves.join(shared, ["p", "v"], "left_semi").groupBy("id", "n").agg(F.collect_list(F.struct("p", "v")).alias("s"))
    left = alive.select("id", "n", F.explode(F.filter("s", lambda x: x["p"] < HALVES)).alias("l"), "s")
    pair = left.select("id", "n", "l", F.explode(F.filter("s", lambda x: x["p"] >= HALVES)).alias("r"))
    return pair.select(F.xxhash64("l", "r").alias("key"), "id", "n")


def candidate_texts(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the documents that share a table with another, stored: the
    texts of the corpus move once, and only these meet the pairs."""
    ids = keys.select("id").distinct().hint("shuffle_hash")
    return stored(docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi"), "minhash-texts")


def verify(pairs: DataFrame, texts: DataFrame, percent: int, width: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    import pyarrow as pa

    placed = texts.repartition("id")
    met = pairs.join(placed, F.col("a") == F.col("id")).select("a", "b", F.col("text").alias("ta"))
    met = met.join(placed, F.col("b") == F.col("id")).select("a", "b", "ta", F.col("text").alias("tb"))

    def run(batches):
        last, held = None, None
        for batch in batches:
            keep = []
            for b, ta, tb in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if b != last:
                    last, held = b, shingles(tb, width)
                keep.append(similar(shingles(ta, width), held, percent))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


def resolve(keys: DataFrame, found: DataFrame, texts: DataFrame, percent: int, width: int = SHINGLE) -> DataFrame:
    """Further links between documents that share a table key but still lie in
    different components after the first links.

    Such documents are gathered into clusters over their shared keys, and every
    pair of different components inside a cluster is compared on full sets, in
    pairs of blocks of bounded size. Per block pair, only links that join two
    components are returned, so the output grows with the rows, not the pairs.
    """
    import pyarrow as pa

    met = keys.join(found, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
    met = stored(met, "minhash-keys")
    open_ = met.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("c")).where("lo <> hi")
    chains = met.join(open_.select("key", "c"), "key").select(F.col("id").alias("a"), F.col("c").alias("b")).where("a <> b")
    clusters = components(chains, "minhash-clusters").withColumnRenamed("component", "cluster")
    one = met.select("id", "n", "component").distinct()
    rows = stored(clusters.join(one, "id"), "minhash-open")
    sizes = rows.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, "cluster").join(texts.repartition("id"), "id")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", "id", "component", "text", "mine",
                       F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def compare(part: pa.Table) -> pa.Table:
        ids, kept = np.unique(part.column("id").to_numpy(), return_index=True)
        comp, mine = part.column("component").to_numpy()[kept], part.column("mine").to_numpy()[kept]
        text = part.column("text")
        sets = [shingles(text[int(i)].as_py(), width) for i in kept]
        n = np.array(list(map(len, sets)))
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), n)
        order = np.argsort(flat)
        flat, owner = flat[order], owner[order]
        root = {int(c): int(c) for c in comp}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        across = part.column("i")[0].as_py() != part.column("j")[0].as_py()
        # The largest component's documents need not look for others themselves.
        values, counts = np.unique(comp, return_counts=True)
        largest = values[counts.argmax()]
        for x in np.flatnonzero(comp != largest):
            lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
            span = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            good = np.flatnonzero((100 * both >= percent * (n + n[x] - both)) & (comp != comp[x]))
            for y in good:
                a, b = top(int(comp[x])), top(int(comp[y]))
                if a != b and (not across or mine[x] != mine[y]):
                    root[max(a, b)] = min(a, b)
                    out.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents link if 100 * shared >= percent * all of their distinct shingles
    of ``width`` words; a component is named by its smallest id, and kept is that row.
    Equal sets are one class, linked without comparing; classes meet in the
    tensored tables, each table links its members to its smallest id, and links
    are confirmed on full sets. What still shares a table across components is
    then compared completely.

    Null, empty and wordless texts have no shingles and link with nothing.
    Fewer than ``width`` words are one shingle. Repeated rows of an id are linked;
    each has kept true if the id names its component. Rows with a null id have
    a null component and are not kept. Other columns are ignored; an empty table
    gives an empty one.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stored(signatures(docs, width), "minhash-signatures")
    real = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(real.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id")), "minhash-classes")
    reps = real.join(classes.select(F.col("n").alias("n_"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), "id"),
                     (F.col("doc_id") == F.col("id")) & (F.col("n") == F.col("n_")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    keys = stored(tables(reps.select("id", "n", "bands")), "minhash-tables")
    stars = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
    pairs = (keys.join(stars.select("key", "c"), "key").where("id <> c.id")
             .where(100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n"))
             .select(F.col("id").alias("a"), F.col("c.id").alias("b")).distinct())
    texts = candidate_texts(keys, docs)
    links = stored(verify(pairs, texts, percent, width), "minhash-links")
    found = components(links, "minhash-first")
    more = stored(resolve(keys, found, texts, percent, width), "minhash-more")
    final = components(links.unionByName(more), "minhash-final")
    named = classes.join(final, "id", "left").select("n", "d1", "d2", F.coalesce("component", "id").alias("component"))
    out = rows.join(named, (rows.n == named.n) & (rows.d1 == named.d1) & (rows.d2 == named.d2) & rows.doc_id.isNotNull(), "left").select(
        rows.doc_id, rows.n.alias("n_shingles"), F.coalesce(F.col("component"), rows.doc_id).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
