"""Byte-pair encoding with a pair occurrence index, and decoding.

Each task gathers the distinct pre-token strings of a run of rows that it has
not met lately, lays them out as one array of symbols, indexes every adjacent
pair by its merge rank, and applies the ranks in ascending order to all
positions of a pair at once, updating the lists of the pairs that change. The
rows are then put together from the encoded strings.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import bound_batches

# Fixed values of the vocabulary's file format: its white space, its split
# pattern and the suffix of a word's last symbol.
SPACES = regex.compile("[\t-\r \x85\xa0  -     　]+")
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SUFFIX = "</w>"
NO_RANK = np.int64(1) << 40
# Characters indexed together, and encoded strings a task remembers.
INDEX_CHARS = 1_500_000
REMEMBERED = 250_000


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself where printable in Latin-1,
    else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    return [rest.get(b, chr(b)) for b in range(256)]


class Vocabulary:
    """A tokenizer file as arrays: merges by packed pair, symbols by byte."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.names = {i: s for s, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names.update({i: s for s, i in self.special.items()})
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        packed = left << 32 | right
        order = np.argsort(packed, kind="stable")
        self.packed, self.rank = packed[order], order.astype(np.int64)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + SUFFIX] for s in symbols], np.int64)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.packed, key), len(self.packed) - 1)
        return np.where(self.packed[at] == key, self.rank[at], NO_RANK)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_all(strings: list[bytes], v: Vocabulary) -> list[bytes]:
    """Token ids of each non-empty string as little-endian 32-bit integers, by
    the pair occurrence index."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(strings), np.uint8)
    n = len(raw)
    sym = v.inner[raw]
    sym[ends - 1] = v.final[raw[ends - 1]]
    # Neighbours by position; n stands for none on either side.
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends - 1] = n
    before = np.append(before, 0)[: n + 1]
    before[ends - sizes] = n
    after, alive = after[: n + 1], np.ones(n, bool)
    rank = np.full(n + 1, NO_RANK)
    has = np.flatnonzero(after[:n] < n)
    rank[has] = v.ranks(sym[has], sym[has + 1])
    # The index: rank -> positions where its pair begins.
    known = has[rank[has] < NO_RANK]
    known = known[np.argsort(rank[known], kind="stable")]
    firsts = np.flatnonzero(np.diff(rank[known], prepend=-1))
    index: dict[int, list[np.ndarray]] = {int(rank[known[a]]): [part] for a, part in zip(firsts, np.split(known, firsts[1:]))} if len(known) else {}
    active = list(index)
    heapq.heapify(active)
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r, None)
        if lists is None:
            continue
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == r]
        if not len(at):
            continue
        nxt = after[at]
        linked = np.zeros(len(at), bool)
        linked[1:] = nxt[:-1] == at[1:]
        if linked.any():
            # Overlapping occurrences, as in aaa: from the left, every other one.
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
            at = at[run % 2 == 0]
            nxt = after[at]
        far = after[nxt]
        sym[at] = v.made[r]
        alive[nxt] = False
        rank[nxt] = NO_RANK
        after[at] = far
        before[far] = at
        before[n] = after[n] = n
        # Pairs that begin at a merged symbol, or end in one.
        lefts = before[at]
        touched = np.unique(np.concatenate((at, lefts[lefts < n])))
        right = after[touched]
        inside = right < n
        rank[touched[~inside]] = NO_RANK
        touched, right = touched[inside], right[inside]
        new = v.ranks(sym[touched], sym[right])
        rank[touched] = new
        touched, new = touched[new < NO_RANK], new[new < NO_RANK]
        if len(new):
            order = np.argsort(new, kind="stable")
            touched, new = touched[order], new[order]
            cuts = np.flatnonzero(np.diff(new)) + 1
            for value, part in zip(new[np.concatenate(([0], cuts))].tolist(), np.split(touched, cuts)):
                if value in index:
                    index[value].append(part)
                else:
                    index[value] = [part]
                    heapq.heappush(active, value)
    whole = sym[alive].astype("<u4").tobytes()
    stops = np.cumsum(4 * np.add.reduceat(alive.astype(np.int64), ends - sizes)).tolist()
    return [whole[a:b] for a, b in zip([0, *stops], stops)]


def pieces(text: str, v: Vocabulary) -> list:
    """Pre-token strings of a text in order; a special token stands as its id."""
    out: list = []
    for part in v.cut.split(text) if v.cut else [text]:
        if part in v.special:
            out.append(v.special[part])
        elif part:
            # One character at a time, a capital sigma has one small form.
            part = SPACES.sub(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower()
            out.extend(SPLIT.findall(part))
    return out


class Encoder:
    """Encodes lists of texts, remembering strings met lately."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.known: dict = {i: i.to_bytes(4, "little") for i in self.v.special.values()}
        self.start = dict(self.known)

    def learn(self, rows: list[list]) -> None:
        fresh = sorted(p for p in {p for row in rows for p in row} if p not in self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = dict(self.start)
            fresh = sorted({p for row in rows for p in row if isinstance(p, str)})
        if fresh:
            self.known.update(zip(fresh, merge_all([p.encode() for p in fresh], self.v)))

    def groups(self, texts: list[str]):
        """Yield lists of the ids, as bytes, of consecutive texts."""
        waiting, chars = [], 0
        for text in texts:
            waiting.append(pieces(text, self.v))
            chars += len(text)
            if chars >= INDEX_CHARS:
                yield self.release(waiting)
                waiting, chars = [], 0
        if waiting:
            yield self.release(waiting)

    def release(self, rows) -> list[bytes]:
        self.learn(rows)
        known = self.known
        return [b"".join([known[p] for p in row]) for row in rows]

    def encode(self, texts: list[str]):
        """Yield the ids of each text."""
        for group in self.groups(texts):
            for ids in group:
                yield np.frombuffer(ids, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The file names no decoder, so tokens are joined by a space."""
        return " ".join(map(self.v.names.__getitem__, ids.tolist()))


def encode(docs: DataFrame, path: str, keep_ids: bool = True, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with
    ``keep_ids``, ``ids`` (array of int) and ``decoded`` to every row.

    A null text counts as empty; an empty text has no tokens, and the digests
    are those of no bytes. Texts of any length are encoded whole. Repeated rows
    are encoded alike; other columns pass through, and columns called like an
    output column are replaced. An empty table gives an empty one.
    """
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    new = [x.split()[0] for x in extra.split(", ")]
    docs = docs.drop(*[c for c in new if c != text])
    rest = [c for c in docs.columns if keep_ids or c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema.fields)

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            at = 0
            for group in encoder.groups([x or "" for x in batch.column(text).to_pylist()]):
                part = batch.slice(at, len(group))
                at += len(group)
                counts = [len(ids) // 4 for ids in group]
                decoded = [encoder.decode(np.frombuffer(ids, "<u4")) for ids in group]
                made = [pa.array(counts, pa.int64()), pa.array([hashlib.sha256(ids).hexdigest() for ids in group], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
                if keep_ids:
                    flat = pa.array(np.frombuffer(b"".join(group), "<u4").astype(np.int32))
                    made += [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), flat), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + made, names=rest + new)

    columns = list(dict.fromkeys([*rest, text]))
    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, f"{schema}, {extra}" if schema else extra)
