"""Removal of repeated passages by interval expansion on a Burrows-Wheeler transform.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier.

1. Every window of LENGTH bytes is named by its anchor, the smallest hash of the
   ANCHOR-byte strings inside it. Equal windows have equal anchors, so windows
   whose anchor is found once in the corpus cannot repeat and are left out.
   Neighbouring windows with one anchor form a run.
2. The runs of one anchor are pieces of text. Equal pieces are merged by a print
   of their bytes: all places but the first are repeated throughout. The first
   places stay, where an anchor has several different pieces.
3. Those pieces are laid out as one text, whose Burrows-Wheeler transform is
   expanded from the empty string by one byte to the left at a time, breadth
   first. Level l yields the places where neighbours in suffix order have exactly
   l bytes in common; the search stops below LENGTH, and what was not separated
   by then shares LENGTH bytes or more.
4. In each such class all starts but the first are repeated.

An anchor that occurs very often (a passage of a large share of the documents)
is known from its exact count. Its pieces are merged over whole tasks before they
meet. An anchor that still has very many *different* pieces after that has them
compared as single windows, named by a print of their own, so that no task holds
them together.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import bound_batches, stored
from panelweave.llm.minhash import BYTES, POWERS, mix

LENGTH, ANCHOR = 100, 32
SPAN = LENGTH - ANCHOR + 1
# Bytes whose transform is formed together, and pieces in it before those of the
# last anchor; with HOT_PIECES more there are fewer than 65,280, so symbols fit 16 bits.
BATCH_BYTES, BATCH_PIECES = 1_000_000, 15_000
# The pieces of an anchor found more often than this are merged by task, up to so
# many remembered; an anchor with more different pieces is split into windows.
HOT_RUNS, SEEN = 50_000, 500_000
HOT_PIECES = 50_000
# Text whose anchors are counted together before the shuffle.
CHUNK = 16_000_000


def _slide(values: np.ndarray, width: int, choose) -> np.ndarray:
    """Smallest or largest of every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        values = choose(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return choose(values[:-rest], values[rest:]) if rest else values


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every ANCHOR-byte string, by doubling."""
    h, size = BYTES[raw], 1
    while size < ANCHOR:
        h = h[:-size] * np.uint64(0xD6E8FEB86659FD93) + (h[size:] ^ h[size:] >> np.uint64(31))
        size *= 2
    return mix(h)


def runs(raw: np.ndarray):
    """(anchor, start, windows, found) of every run of a text: the anchor's hash,
    the first window, the number of windows, how often the anchor occurs there."""
    none = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return none.astype(np.uint64), none, none, none
    grams = gram_hashes(raw)
    least = _slide(grams, SPAN, np.minimum)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    start = np.concatenate((none, [0], cut))
    anchor = least[start]
    # Places that are the smallest of some window, dealt to the runs they name.
    padded = np.concatenate((np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)))
    at = np.flatnonzero(_slide(padded, SPAN, np.maximum) == grams)
    run = np.searchsorted(start, np.maximum(at - SPAN + 1, 0), "right") - 1
    found = np.zeros(len(start), np.int64)
    while len(at):
        here = anchor[run] == grams[at]
        found += np.bincount(run[here], minlength=len(start))
        at, run = at[~here], run[~here] + 1
    return anchor, start, np.diff(np.append(start, len(least))), found


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; symbols lie below 65536 and each text
    ends in a symbol of its own, so all suffixes differ."""
    n = len(symbols)
    wide = np.concatenate((symbols, np.zeros(3, symbols.dtype))).astype(np.uint64)
    key = wide[:n] << np.uint64(48) | wide[1:n + 1] << np.uint64(32) | wide[2:n + 2] << np.uint64(16) | wide[3:]
    order = np.argsort(key)
    key = key[order]
    place = np.arange(n)
    rank = np.zeros(n + 1, np.int64)
    step = 4
    while True:
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        group = place[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        rank[order[place]] = group + 1
        tied = ~head
        tied[:-1] |= ~head[1:]
        place = place[tied]
        if not len(place):
            return order
        who = order[place]
        key = rank[who] << 32 | rank[np.minimum(who + step, n)]
        again = np.argsort(key)
        order[place] = who[again]
        key = key[again]
        step *= 2


def boundaries(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each place in suffix order (and the end) shares fewer than
    ``length`` symbols with the place before it."""
    n = len(symbols)
    transform = symbols[order - 1].astype(np.uint16)
    by_symbol = np.argsort(transform, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    equal = transform[by_symbol[1:]] == transform[by_symbol[:-1]]
    following, before = np.full(n, n), np.full(n, -1)
    following[by_symbol[:-1][equal]] = by_symbol[1:][equal]
    before[by_symbol[1:][equal]] = by_symbol[:-1][equal]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        size = high - low
        total = int(size.sum())
        if not total:
            break
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(total)
        first, last = before[at] < np.repeat(low, size), following[at] >= np.repeat(high, size)
        # One symbol to the left: intervals of different strings do not overlap,
        # so sorted beginnings belong to sorted ends.
        low, high = np.sort(step[at[first]]), np.sort(step[at[last]]) + 1
        new = ~known[high]
        low, high = low[new], high[new]
        known[high] = True
    return known


def repeated_windows(bodies: list[bytes], rid: np.ndarray, start: np.ndarray):
    """(piece, offset) of the windows of the pieces that also start earlier,
    sorted. Pieces stand at (rid, start)."""
    count = len(bodies)
    sizes = np.fromiter(map(len, bodies), np.int64, count) + 1
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    symbols = raw.astype(np.int64) + count
    symbols[ends - 1] = np.arange(count)
    order = suffix_order(symbols)
    group = np.cumsum(boundaries(symbols, order, LENGTH)[:-1])
    piece = np.repeat(np.arange(count), sizes)
    offset = np.arange(len(raw)) - np.repeat(ends - sizes, sizes)
    whole = (sizes[piece] - 1 - offset >= LENGTH)[order]
    order, group = order[whole], group[whole]
    shared = np.zeros(len(group), bool)
    shared[1:] = group[1:] == group[:-1]
    shared[:-1] |= shared[1:]
    order, group = order[shared], group[shared]
    piece, offset = piece[order], offset[order]
    line = np.lexsort((start[piece] + offset, rid[piece], group))
    later = np.zeros(len(line), bool)
    later[1:] = group[line][1:] == group[line][:-1]
    piece, offset = piece[line][later], offset[line][later]
    line = np.lexsort((offset, piece))
    return piece[line], offset[line]


def _rows(names, *columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _complete(batches, names, size):
    """Batches of about ``size`` rows of a sorted stream as numpy columns, cut
    where the first column changes."""
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        n += batch.num_rows
        if n < size:
            continue
        whole = [np.concatenate(c) for c in zip(*held)]
        cut = np.searchsorted(whole[0], whole[0][-1])
        if cut:
            yield [c[:cut] for c in whole]
        held, n = [[c[cut:] for c in whole]], len(whole[0]) - cut
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(anchor, rid, run, found): the runs of all texts by number.

    ``found`` counts the anchor's occurrences; 0 marks a run whose anchor is
    known to repeat. Anchors that occur twice inside one chunk of a task are
    known at once; one run of each stands for all of them in the count, so a
    passage shared by many documents adds a row per chunk to it.
    """
    def run(batches):
        def release(parts):
            anchor, rid, number, found = (np.concatenate(c) for c in zip(*parts))
            kinds, first, inverse = np.unique(anchor, return_index=True, return_inverse=True)
            total = np.bincount(inverse, found, minlength=len(kinds)).astype(np.int64)
            witness = np.zeros(len(anchor), bool)
            witness[first] = True
            found = np.where(witness, total[inverse], np.where(total[inverse] > 1, 0, found))
            return _rows(["anchor", "rid", "run", "found"], anchor.view(np.int64), rid, number.astype(np.int32), found.astype(np.int32))

        parts, size = [], 0
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                if len(raw) >= LENGTH:
                    anchor, _, _, found = runs(raw)
                    parts.append((anchor, np.full(len(anchor), rid, np.int64), np.arange(len(anchor)), found))
                    size += len(raw)
                    if size >= CHUNK:
                        yield release(parts)
                        parts, size = [], 0
        if parts:
            yield release(parts)

    return docs.select("rid", "text").mapInArrow(run, "anchor long, rid long, run int, found int")


def repeating_runs(docs: DataFrame) -> DataFrame:
    """(anchor, rid, run, total) of the runs whose anchor occurs twice or more,
    with its count in the corpus (0 where it was known without counting)."""
    names = ["anchor", "rid", "run", "found"]
    # Runs known to repeat need no count and go anywhere; the others meet by anchor.
    rows = (anchor_rows(docs)
            .repartition(F.when(F.col("found") == 0, F.xxhash64("rid", "run")).otherwise(F.col("anchor")))
            .sortWithinPartitions("anchor"))

    def run(batches):
        for anchor, rid, number, found in _complete(batches, names, 500_000):
            head = np.ones(len(anchor), bool)
            head[1:] = anchor[1:] != anchor[:-1]
            group = np.cumsum(head) - 1
            total = np.bincount(group, found).astype(np.int64)[group]
            keep = (found == 0) | (total > 1)
            total = np.where(found == 0, 0, np.minimum(total, 2 ** 31 - 1)).astype(np.int32)
            yield _rows(["anchor", "rid", "run", "total"], anchor[keep], rid[keep], number[keep], total[keep])

    return rows.mapInArrow(run, "anchor long, rid long, run int, total int")


def run_lists(flagged: DataFrame) -> DataFrame:
    """(rid, runs): the repeating runs of each document; a run of a hot anchor
    as minus its number less one."""
    hot = flagged.where(F.col("total") > HOT_RUNS).select("anchor").distinct()
    number = F.col("run")
    if not hot.isEmpty():
        flagged = flagged.join(hot.withColumn("hot", F.lit(True)), "anchor", "left")
        number = F.when(F.col("hot"), -number - 1).otherwise(number)
    return flagged.groupBy("rid").agg(F.collect_list(number).alias("runs"))


def _polynomial(raw: np.ndarray):
    up, down = POWERS.get(len(raw) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[raw] * up[:len(raw)]))), down


def pieces(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """(key, print, rid, s, e, inner): the repeating runs as byte ranges, with a
    print of their bytes. ``inner`` tells that the anchor occurs more than once
    in the run. Without a key if an equal piece stands before it in the batch, or
    in the task if the anchor is hot: such a range is repeated throughout, and
    those of a text that touch are one row."""
    import pyarrow as pa

    met = texts.join(lists.withColumnRenamed("rid", "r").hint("shuffle_hash"), F.col("rid") == F.col("r"))
    # All columns of the texts go along, so that the placed texts serve again.
    met = met.select(*texts.columns, "runs")

    def run(batches):
        seen: dict = {}
        for batch in batches:
            lists_ = batch.column("runs")
            ends, numbers = np.asarray(lists_.offsets), np.asarray(lists_.values)
            cols = []
            for i, (rid, text) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist())):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                # Runs are cheaper to find again than to send.
                number = numbers[ends[i]:ends[i + 1]]
                hot = number < 0
                anchor, s, windows, found = (x[np.where(hot, -number - 1, number)] for x in runs(raw))
                e = s + windows + LENGTH - 1
                sums, down = _polynomial(raw)
                marks = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
                cols.append((anchor.view(np.int64), marks.view(np.int64), np.full(len(s), rid, np.int64), s, e, found > 1, hot))
            if not cols:
                continue
            key, marks, rid, s, e, inner, hot = (np.concatenate(c) for c in zip(*cols))
            line = np.lexsort((s, rid, marks, key))
            later = np.zeros(len(line), bool)
            later[line] = _later(key[line], marks[line], rid[line], s[line])[1]
            for i in np.flatnonzero(hot & ~later).tolist():
                name, place = (int(key[i]), int(marks[i])), (int(rid[i]), int(s[i]))
                first = seen.get(name, place)
                later[i] = first < place
                if len(seen) < SEEN or name in seen:
                    seen[name] = min(first, place)
            open_ = ~later
            begin, stop, owner = _joined(rid[later], s[later], e[later])
            rest = len(owner)
            none, no = np.zeros(rest, np.int64), np.zeros(rest, bool)
            yield _rows(["key", "print", "rid", "s", "e", "inner"],
                        pa.array(np.append(key[open_], none), mask=np.append(np.zeros(int(open_.sum()), bool), ~no)), np.append(marks[open_], none),
                        np.append(rid[open_], owner), np.append(s[open_], begin).astype(np.int32), np.append(e[open_], stop).astype(np.int32), np.append(inner[open_], no))

    return met.mapInArrow(run, "key long, print long, rid long, s int, e int, inner boolean")


def _joined(rid, s, e):
    """(s, e, rid) of byte ranges, those of a text that touch as one."""
    line = np.lexsort((e, s, rid))
    rid, s, e = rid[line], s[line], e[line]
    if not len(rid):
        return s, e, rid
    # Ends so far inside a text: texts are set apart by more than any length.
    apart = np.cumsum(np.append(False, rid[1:] != rid[:-1])) << 40
    reach = np.maximum.accumulate(e + apart)
    head = np.append(True, s[1:] + apart[1:] > reach[:-1])
    tail = np.append(head[1:], True)
    return s[head], (reach - apart)[tail], rid[head]


def _later(key, mark, rid, s):
    """For sorted rows: first of its key and print; equal to the first but at
    another place (a row repeated with its id stands at the same one)."""
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    return first, ~first & ((rid != rid[head]) | (s != s[head]))


def marks_of(found: DataFrame) -> DataFrame:
    """(rid, marks): byte ranges that are repeated throughout (without a key),
    and first places of pieces that have to be searched (with one); ``wide``
    where their anchor has too many to lay them out together."""
    import pyarrow as pa

    names = ["key", "print", "rid", "s", "e", "inner"]
    open_ = found.repartition(F.when(F.col("key").isNull(), F.xxhash64("rid", "s")).otherwise(F.col("key")))
    open_ = open_.withColumn("settled", F.col("key").isNull()).withColumn("key", F.coalesce("key", F.lit(-(1 << 63)).cast("long")))
    open_ = open_.sortWithinPartitions("settled", "key", "print", "rid", "s")

    def run(batches):
        def pure(batches):
            # Settled rows come last and are passed on as they are.
            for batch in batches:
                done = np.asarray(batch.column("settled").to_numpy(zero_copy_only=False))
                passed.append(batch.filter(pa.array(done)))
                yield batch.filter(pa.array(~done))

        passed: list = []
        for key, mark, rid, s, e, inner in _complete((b for b in pure(batches) if b.num_rows), names, 200_000):
            first, later = _later(key, mark, rid, s)
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            group = np.cumsum(head) - 1
            different = np.bincount(group, first)[group]
            lead = first & ((different > 1) | inner)
            keep = lead | later
            yield _rows(["rid", "s", "e", "key", "wide"], rid[keep], s[keep], e[keep], pa.array(key[keep], mask=~lead[keep]), (different > HOT_PIECES)[keep])
            yield from release(passed)
        yield from release(passed)

    def release(passed):
        for batch in passed:
            if batch.num_rows:
                none = pa.nulls(batch.num_rows, pa.int64())
                yield _rows(["rid", "s", "e", "key", "wide"], batch.column("rid"), batch.column("s"), batch.column("e"), none, np.zeros(batch.num_rows, bool))
        passed.clear()

    rows = open_.mapInArrow(run, "rid long, s int, e int, key long, wide boolean").where("rid IS NOT NULL")
    return rows.groupBy("rid").agg(F.collect_list(F.struct("s", "e", "key", "wide")).alias("marks"))


def searched(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """(rid, spans): byte ranges of the first places that start earlier inside
    another piece, by interval expansion."""
    import pyarrow as pa

    met = texts.join(marks.withColumnRenamed("rid", "r").hint("shuffle_hash"), F.col("rid") == F.col("r"))
    met = met.select(*texts.columns, "marks")

    def cut(batches):
        for batch in batches:
            lists_ = batch.column("marks")
            ends, flat = np.asarray(lists_.offsets), lists_.values
            start, stop = np.asarray(flat.field("s")), np.asarray(flat.field("e"))
            has = flat.field("key").is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(has)
            at = at[(at >= ends[0]) & (at < ends[-1])]
            if not len(at):
                continue
            owner = np.searchsorted(ends, at, "right") - 1
            texts_ = {i: batch.column("text")[i].as_py().encode("utf-8", "surrogatepass") for i in np.unique(owner).tolist()}
            wide = flat.field("wide").to_numpy(zero_copy_only=False)[at]
            rids = batch.column("rid").to_numpy()
            if wide.any():
                yield from windows(owner[wide], start[at[wide]], stop[at[wide]], texts_, rids)
                at, owner = at[~wide], owner[~wide]
            bodies = [texts_[i][a:b] for i, a, b in zip(owner.tolist(), start[at].tolist(), stop[at].tolist())]
            yield _rows(["key", "rid", "s", "body"], flat.field("key").take(pa.array(at)), rids[owner], start[at], pa.array(bodies, pa.binary()))

    def windows(owner, start, stop, texts_, rids):
        for i in np.unique(owner).tolist():
            sums, down = _polynomial(np.frombuffer(texts_[i], np.uint8))
            own = owner == i
            s = np.unique(np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(start[own].tolist(), stop[own].tolist())]))
            key = mix((sums[s + LENGTH] - sums[s]) * down[s] + np.uint64(LENGTH)).view(np.int64)
            yield _rows(["key", "rid", "s", "body"], key, np.full(len(s), rids[i], np.int64), s.astype(np.int32), pa.nulls(len(s), pa.binary()))

    rows = (met.mapInArrow(cut, "key long, rid long, s int, body binary")
            .repartition("key").sortWithinPartitions("key", F.col("body").isNull(), "rid", "s"))

    def run(batches):
        for key, rid, s, body in _complete(batches, ["key", "rid", "s", "body"], 10_000):
            single = np.fromiter((b is None for b in body), bool, len(body))
            if single.any():
                # Windows with their own print: all places but the first are repeated.
                later = _later(key[single], key[single], rid[single], s[single])[1]
                begin = s[single][later].astype(np.int64)
                begin, stop, owner = _joined(rid[single][later], begin, begin + LENGTH)
                yield _rows(["rid", "s", "e"], owner, begin.astype(np.int32), stop.astype(np.int32))
                key, rid, s, body = (x[~single] for x in (key, rid, s, body))
            same = np.ones(len(key), bool)  # a row repeated with its id
            same[1:] = (key[1:] != key[:-1]) | (rid[1:] != rid[:-1]) | (s[1:] != s[:-1])
            key, rid, s, body = (x[same] for x in (key, rid, s.astype(np.int64), body))
            size = np.cumsum(np.fromiter(map(len, body), np.int64, len(body)))
            at = 0
            while at < len(key):
                last = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES)))
                last = min(last, at + BATCH_PIECES, len(key))
                last = int(np.searchsorted(key, key[last - 1], "right"))
                yield search(list(body[at:last]), rid[at:last], s[at:last])
                at = last

    def search(bodies, rid, s):
        piece, offset = repeated_windows(bodies, rid, s)
        head = np.ones(len(piece), bool)
        head[1:] = (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)
        tail = np.append(head[1:], True)[:len(piece)]
        begin, end = s[piece[head]] + offset[head], s[piece[tail]] + offset[tail] + LENGTH
        return _rows(["rid", "s", "e"], rid[piece[head]], begin.astype(np.int32), end.astype(np.int32))

    return rows.mapInArrow(run, "rid long, s int, e int").groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def numbered(docs: DataFrame) -> DataFrame:
    """Add ``rid``, ordered like doc_id. Ids that are unique serve themselves;
    else rows are ordered by id (null first) and hash of the text, and rows equal
    in both share a number."""
    from panelweave.operators.spread import number_rows

    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if ids.n == ids.known and not repeated:
        return docs.withColumn("rid", F.col("doc_id").cast("long"))
    docs = docs.withColumn("__print", F.xxhash64("text"))
    kinds = docs.select(F.col("doc_id").alias("__id"), F.col("__print").alias("__p")).distinct()
    kinds = number_rows(kinds.withColumn("__all", F.lit(0)), ["__all"], [F.col("__id").asc_nulls_first(), F.col("__p")], "rid").drop("__all")
    return docs.join(kinds, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__p"))).drop("__id", "__p", "__print")


def _trimmed(text: str, keep: np.ndarray) -> str:
    """The kept bytes as text; a character that loses only part of its bytes stays."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    owner = np.cumsum((raw & 0xC0) != 0x80) - 1
    whole = np.bincount(owner, keep, minlength=int(owner[-1]) + 1 if len(owner) else 0) > 0
    return raw[whole[owner]].tobytes().decode("utf-8", "surrogatepass") if len(raw) else ""


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Add ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` to every row,
    and with ``with_text`` replace ``text`` by what is left.

    Strings are judged on the input, not on what is left, and never cross
    documents. A null text counts as empty (and stays null in ``text``). Rows
    repeated with their id and text stand at one place and do not repeat each
    other; other rows that share an id are ordered by a hash of the text, null
    ids come first. In ``text`` a character stays whole if part of its bytes is
    kept. Other columns pass through, those called like an output column are
    replaced; an empty table gives an empty one.
    """
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = docs.drop(*new, "rid")
    rest = [c for c in docs.columns if c != "text"]
    rows = numbered(docs)
    texts = rows.select("rid", *rest, F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("__null"))
    # Said once for both uses, so that both read the same placed texts.
    texts = texts.where("rid IS NOT NULL").repartition("rid")
    flagged = stored(repeating_runs(rows.where("length(text) * 4 >= %d" % LENGTH)), "suffix-runs")
    marks = marks_of(pieces(texts, run_lists(flagged)))
    met = texts
    for ranges in (marks, searched(texts, marks)):
        met = met.join(ranges.withColumnRenamed("rid", "r").hint("shuffle_hash"), F.col("rid") == F.col("r"), "left").drop("r")

    def run(batches):
        for batch in batches:
            out, left = [], []
            for text, null, marks_, found in zip(*(batch.column(c).to_pylist() for c in ("text", "__null", "marks", "spans"))):
                raw = text.encode("utf-8", "surrogatepass")
                edge = np.zeros(len(raw) + 1, np.int32)
                for x in [*(x for x in marks_ or () if x["key"] is None), *(found or ())]:
                    edge[x["s"]] += 1
                    edge[x["e"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                begins = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if begins else raw
                out.append((len(raw), int(gone.sum()), begins, hashlib.sha256(kept).hexdigest()))
                if with_text:
                    left.append(None if null else _trimmed(text, ~gone) if begins else text)
            cols = [pa.array(list(c), k) for c, k in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            own = [batch.column(c) for c in rest]
            names = list(rest)
            if with_text:
                own.append(pa.array(left, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(own + cols, names=names + new)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema.fields]
    schema = ", ".join(kinds + ["text string"] * with_text + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    return met.select(*rest, "text", "__null", "marks", "spans").mapInArrow(run, schema)
