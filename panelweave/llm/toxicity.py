"""Toxicity by noisy-channel deobfuscation.

A token that mixes letters with look-alike signs, consists of such signs without
being a number, repeats a character three times or is spelt out with separators
becomes a lattice of characters. Viterbi
decoding under a character language model of the corpus picks the likeliest
reading; the restored words are then scored by a linear model.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import bound_batches, fold, stored

# Look-alike signs and the letters they may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "#": "h",
}
PUNCTUATION = ".,;:!?\"'()[]{}<>«»“”‘’…#%&*=^~_/\\-"
SEPARATORS = " .-_*·"
# Costs of the channel: a sign read as a letter, a sign left out inside a word, a
# sign kept inside a word and at its edge, a separator left out and kept between
# letters, a doubled letter read as one, and a look-alike sign left out of a token
# that has no letter.
READ, SKIP, KEEP, EDGE, JOIN, PART, SINGLE, LOST = 2.0, 2.0, 5.0, 0.3, 0.2, 2.5, 0.5, 6.0
# Code points below POINTS are counted; the LETTERS most frequent ones form the
# alphabet of the language model. State 0 is the word boundary.
POINTS, LETTERS = 2048, 63
STATES = LETTERS + 1
# No reading of this number at a place of a lattice.
NONE = -2
# Longest lattice; a longer token is read in pieces of this many characters.
LONGEST = 4096
# Odd tokens a task remembers, and texts whose tokens are read together.
REMEMBERED, TOGETHER = 150_000, 2048
# Shortest and longest beginning of a word that is a feature.
STEM = (3, 8)
TRIPLE = re.compile(r"(.)\1\1+", re.S)
# Single letters, digits or signs with up to three separators between each two,
# next to white space or punctuation.
SPELT = re.compile(r"(?<![^\W_])(?=.[\s._\-*·])(?:[^\W_]|[@$€£¡])(?:[\s._\-*·]{1,3}(?:[^\W_]|[@$!€£¡])){2,}(?![^\W_]|[@$€£¡])")
GAP = re.compile(r"[\s._\-*·]+")
NUMBER = re.compile(r"[-+$€£(#]*\d+(?:[.,:/x+-]\d+)*[%)€£$+]*")
WORDS = re.compile(r"[^\W\d_]+")


class LanguageModel:
    """Log-probabilities of letter bigrams with a boundary symbol."""

    def __init__(self, letters: list[str], counts: np.ndarray):
        self.letters = [" ", *letters]
        self.code = {c: i for i, c in enumerate(self.letters)}
        total = counts + 0.5
        self.log = np.full((STATES, STATES), -20.0, np.float32)
        n = len(self.letters)
        self.log[:n, :n] = np.log(total / total.sum(1, keepdims=True))
        self.into = np.ascontiguousarray(self.log.T)
        # readings of characters met so far
        self.ways: dict = {}


def bigram_counts(docs: DataFrame) -> DataFrame:
    """(a, b, n): counts of adjacent code points over all whole texts in lower
    case; anything but a letter is 0. Summed inside each task first."""
    import pyarrow as pa

    def run(batches):
        letter = np.array([i if chr(i).isalpha() else 0 for i in range(POINTS)], np.int64)
        total = np.zeros(POINTS * POINTS, np.int64)

        def add(texts):
            points = np.frombuffer((" " + " ".join(texts) + " ").lower().encode("utf-32-le", "surrogatepass"), "<u4")
            codes = letter[np.where(points < POINTS, points, 0)]
            total[:] += np.bincount(codes[:-1] * POINTS + codes[1:], minlength=len(total))

        for batch in batches:
            texts, size = [], 0
            for text in batch.column(0).to_pylist():
                texts.append(text or "")
                size += len(texts[-1])
                if size > 1_500_000:
                    add(texts)
                    texts, size = [], 0
            add(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // POINTS), pa.array(at % POINTS), pa.array(total[at])], names=["a", "b", "n"])

    return docs.select("text").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> LanguageModel:
    """Fit on every whole text; at most STATES x STATES counts reach the driver."""
    pairs = stored(bigram_counts(docs), "toxicity-bigrams")
    top = pairs.where("a > 0").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(LETTERS).collect()
    letters = sorted(chr(r.a) for r in top)
    place = {ord(c): i + 1 for i, c in enumerate(letters)} | {0: 0}
    counts = np.zeros((len(letters) + 1,) * 2)
    keep = list(place)
    for r in pairs.where(F.col("a").isin(keep) & F.col("b").isin(keep)).collect():
        counts[place[r.a], place[r.b]] += r.n
    return LanguageModel(letters, counts)


def lattice(token: str, lm: LanguageModel) -> list[list[tuple[int, float, str]]]:
    """For each character the readings (state or -1 for none, cost, output)."""
    out = []
    doubled = False
    letters = ([i for i, c in enumerate(token) if c.isalpha() or c.isdigit()]
               or [i for i, c in enumerate(token) if c in LOOKALIKES])
    first, last = (letters[0], letters[-1]) if letters else (len(token), -1)
    bare = not any(map(str.isalpha, token))
    before = ""
    for i, c in enumerate(token):
        edge = i < first or i > last
        doubled = before == c and not doubled
        before = c
        ways = lm.ways.get((c, edge, bare, doubled))
        if ways is None:
            ways = lm.ways[c, edge, bare, doubled] = readings(c, edge, bare, doubled, lm)
        out.append(ways)
    return out


def readings(c: str, edge: bool, bare: bool, doubled: bool, lm: LanguageModel) -> list[tuple[int, float, str]]:
    """Those of one character: ``edge`` outside a token's letters, ``bare`` in a
    token without letters, ``doubled`` after the same character."""
    if c.isalpha():
        ways = [(lm.code[c], 0.0, c)] if c in lm.code else [(0, 0.0, c)]
    else:
        ways = [(lm.code[x], READ, x) for x in LOOKALIKES.get(c, "") if x in lm.code]
        part = c in SEPARATORS
        ways.append((0, EDGE if edge else PART if part else KEEP, " "))
        if not c.isdigit():
            ways.append((-1, EDGE if edge else JOIN if part else LOST if bare and c in LOOKALIKES else SKIP, ""))
    if doubled and c.isalpha():
        ways = [*ways, (-1, SINGLE, "")]
    return ways


def decode(tokens: list[str], lm: LanguageModel) -> list[str]:
    """The likeliest reading of each token; tokens of one length run together."""
    out = [""] * len(tokens)
    short = [TRIPLE.sub(r"\1\1", t)[:LONGEST] for t in tokens]
    by_length: dict[int, list[int]] = {}
    for i, t in enumerate(short):
        by_length.setdefault(len(t), []).append(i)
    for n, rows in by_length.items():
        step = max(1, min(2048, 60_000 // max(n, 1)))
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            for i, text in zip(part, _viterbi([lattice(short[i], lm) for i in part], n, lm)):
                out[i] = text
    return out


def _viterbi(lattices, n: int, lm: LanguageModel) -> list[str]:
    b = len(lattices)
    rows = np.arange(b)
    value = np.full((b, STATES), -np.inf, np.float32)
    value[:, 0] = 0
    came = np.zeros((n, b, STATES), np.int8)
    way = np.full((n, b, STATES), -1, np.int8)
    # every reading as (its number, state, cost), by place and token
    sizes = np.array([[len(ways) for ways in x] for x in lattices]).reshape(b, n)
    most = sizes.max(0) if b else sizes.sum(0)
    flat = [(w[0], w[1]) for x in lattices for ways in x for w in ways]
    number = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes.ravel(), sizes.ravel())
    token, place = (np.repeat(i.ravel(), sizes.ravel()) for i in np.indices((b, n)))
    states = np.full((n, int(most.max(initial=0)), b), NONE)
    costs = np.zeros(states.shape, np.float32)
    if flat:
        states[place, number, token], costs[place, number, token] = np.array(flat).T
    for t in range(n):
        new = np.full((b, STATES), -np.inf, np.float32)
        for k in range(most[t]):
            state, cost = states[t, k], costs[t, k]
            skip = np.flatnonzero(state == -1)
            if len(skip):
                held = value[skip] - cost[skip, None]
                better = held > new[skip]
                new[skip] = np.where(better, held, new[skip])
                came[t, skip] = np.where(better, np.arange(STATES, dtype=np.int8), came[t, skip])
                way[t, skip] = np.where(better, np.int8(k), way[t, skip])
            step = np.flatnonzero(state >= 0)
            if len(step):
                to = state[step]
                reach = value[step] + lm.into[to]
                best = reach.argmax(1)
                got = reach[np.arange(len(step)), best] - cost[step]
                better = got > new[step, to]
                s, to = step[better], to[better]
                new[s, to] = got[better]
                came[t, s, to] = best[better]
                way[t, s, to] = k
        value = new
    state = (value + lm.into[0]).argmax(1) if n else np.zeros(b, int)
    parts = [[] for _ in range(b)]
    for t in range(n - 1, -1, -1):
        k, p = way[t, rows, state], came[t, rows, state]
        for i in range(b):
            parts[i].append(lattices[i][t][k[i]][2])
        state = p.astype(int)
    return ["".join(reversed(p)) for p in parts]


def spelt(text: str) -> str | None:
    """A spelt-out run with one space between its signs, if it has three letters
    or digits, one of them a letter."""
    known = sum(map(str.isalnum, text))
    return GAP.sub(" ", text) if known >= 3 and any(map(str.isalpha, text)) else None


def is_odd(token: str) -> bool:
    """Whether a token needs a lattice: signs among letters, a sign repeated, or
    three look-alike signs that are no number and not table lines alone."""
    core = token.strip(PUNCTUATION)
    if any(map(str.isalpha, core)):
        return not core.isalpha() or bool(TRIPLE.search(core))
    signs = [c for c in token if c in LOOKALIKES]
    return len(signs) >= 3 and len(set(signs) - set("|!(#+")) > 0 and len(set(token)) > 1 and not NUMBER.fullmatch(token.strip(".,;:!?\"'()[]{}"))


def repeating(tokens) -> set[str]:
    """The tokens with a character three times in a row, found in one search."""
    body = "\n".join(tokens)  # no token holds a line break
    found, end = set(), -1
    for m in TRIPLE.finditer(body):
        if m.start() > end:
            start, end = body.rfind("\n", 0, m.start()) + 1, body.find("\n", m.start())
            end = len(body) if end < 0 else end
            found.add(body[start:end])
    return found


class Restorer:
    """What texts hold after restoring: their words, or what ``finish`` makes of
    a token's words. A task remembers the odd tokens it read; ``known`` has the
    tokens of the texts at hand that give anything. ``starts``, if given, holds
    the beginnings of STEM[0] characters without which a word gives nothing."""

    def __init__(self, lm: LanguageModel, finish=tuple, starts=None):
        self.lm = lm
        self.finish = finish
        self.starts = starts
        self.known: dict[str, tuple] = {}
        self.read: dict[str, tuple] = {}

    def tokens(self, text: str) -> set[str]:
        """Distinct tokens in lower case, spelt-out runs as one token each."""
        low = text.lower()
        return set(low.split()) | ({spelt(x) for x in SPELT.findall(low)} - {None})

    def learn(self, tokens: set[str]) -> None:
        self.known.clear()
        repeats = repeating(tokens)
        odd, finish, starts, n = [], self.finish, self.starts, STEM[0]
        # see ``is_odd``: letters alone may only repeat one
        plain = {t for t in tokens if t.isalpha()} - repeats
        for t in plain if starts is None else [t for t in plain if t[:n] in starts]:
            self.keep(t, finish((t,)))
        for t in tokens - plain:
            core = t.strip(PUNCTUATION)
            if (t in repeats and TRIPLE.search(core)) if core.isalpha() else is_odd(t):
                odd.append(t)
            elif core and (starts is None or core[:n] in starts):
                self.keep(t, finish((core,)))
        self.decode([t for t in odd if t not in self.read])
        for t in odd:
            self.keep(t, self.read[t])

    def keep(self, token: str, found: tuple) -> None:
        if found:
            self.known[token] = found

    def decode(self, odd: list[str]) -> None:
        if len(self.read) > REMEMBERED:
            self.read.clear()
        cut = [t[i:i + LONGEST] for t in odd for i in range(0, len(t), LONGEST)]
        read = iter(decode(cut, self.lm))
        for t in odd:
            whole = "".join(next(read) for _ in range(0, len(t), LONGEST))
            # The reading and the letters as they stand both count.
            self.read[t] = self.finish(tuple(dict.fromkeys(WORDS.findall(whole) + WORDS.findall(t))))

    def words(self, texts: list[str]) -> list[set[str]]:
        """Distinct restored words of each text, or what ``finish`` made of them."""
        sets = [self.tokens(t) for t in texts]
        out = []
        for at in range(0, len(sets), TOGETHER):
            part = sets[at:at + TOGETHER]
            self.learn(set().union(*part))
            known = self.known
            # the smaller side is gone through: most texts hold few tokens that give anything
            out.extend({w for t in (s if self.starts is None else known.keys() & s) for w in known.get(t, ())} for s in part)
        return out

    def text(self, text: str) -> str:
        """The text with every odd token in its likeliest reading."""
        def read(token):
            return "".join(decode([token[i:i + LONGEST] for i in range(0, len(token), LONGEST)], self.lm))

        def run(match):
            known = spelt(match.group())
            return read(known) if known else match.group()

        return re.sub(r"\S+", lambda m: read(m.group()) if is_odd(m.group()) else m.group(), SPELT.sub(run, text.lower()))


def features(words) -> set[str]:
    """Words and their beginnings, which tell families of words apart."""
    return {*words, *["^" + w[:n] for w in words for n in range(STEM[0], min(STEM[1], len(w)) + 1)]}


def word_features(lists, among=None):
    """(names, at, row): ``features`` of each row's words in an Arrow column of
    lists. ``names`` are the features of all rows, ``at`` their numbers and
    ``row`` the rows, each feature once a row. Beginnings are cut from the
    distinct words only. ``among`` names the only features wanted."""
    import pyarrow as pa
    import pyarrow.compute as pc

    flat = lists.flatten().dictionary_encode()
    words, code = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    lengths = pc.utf8_length(words).to_numpy()
    names, at, row, n = [words], [], [], 0
    for size in (0, *range(STEM[0], STEM[1] + 1)):
        if size:
            stems = pc.utf8_slice_codeunits(words.filter(pa.array(lengths >= size)), 0, size).dictionary_encode()
            names.append(pc.binary_join_element_wise("^", stems.dictionary, ""))
            number = np.full(len(words), -1, np.int64)
            number[lengths >= size] = stems.indices.to_numpy()
        else:
            number = np.arange(len(words))
        if among is not None:
            wanted = pc.is_in(names[-1], among).to_numpy(zero_copy_only=False)
            number[~np.append(wanted, False)[number]] = -1
        mine = number[code]
        width = max(len(names[-1]), 1)
        once = np.unique(owner[mine >= 0] * width + mine[mine >= 0])
        at.append(once % width + n)
        row.append(once // width)
        n += len(names[-1])
    return pa.concat_arrays(names), np.concatenate(at), np.concatenate(row)


class Active:
    """The features of words that have a weight, without building the others."""

    def __init__(self, weights: dict):
        self.words = {f for f in weights if f[0] != "^"}
        self.stems = [(n, {f[1:] for f in weights if f[0] == "^" and len(f) == n + 1}) for n in range(STEM[0], STEM[1] + 1)]
        self.starts = {f.removeprefix("^")[:STEM[0]] for f in weights}

    def __call__(self, words) -> tuple:
        out = []
        for w in words:
            if w[:STEM[0]] in self.starts:
                if w in self.words:
                    out.append(w)
                out.extend("^" + w[:n] for n, known in self.stems if w[:n] in known and len(w) >= n)
        return tuple(out)


def _slices(texts, size=4_000_000):
    part, n = [], 0
    for t in texts:
        part.append(t or "")
        n += len(part[-1])
        if n >= size:
            yield part
            part, n = [], 0
    yield part


def restored(docs: DataFrame, lm: LanguageModel) -> DataFrame:
    """Add ``restored``: the whole text in lower case after deobfuscation."""
    import pyarrow as pa

    docs = docs.drop("restored")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        reader = Restorer(lm)
        for batch in batches:
            made = [reader.text(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "restored"])

    return docs.mapInArrow(run, schema + ", restored string")


def training_words(docs: DataFrame, labels: DataFrame, label: str, lm: LanguageModel, folds: int, held: int, most: int) -> DataFrame:
    """(y, words) of at most ``most`` labelled documents outside the held-out
    fold, chosen by a hash of the id. Only their texts reach Python; the side
    that is broadcast has at most ``most`` rows of two numbers."""
    import pyarrow as pa

    rows = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
            .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    met = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("y", "text")

    def run(batches):
        reader = Restorer(lm)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words = [sorted(w) for part in _slices(texts) for w in reader.words(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["y", "words"])

    return stored(met.mapInArrow(run, "y int, words array<string>"), "toxicity-words")


def telling_features(rows: DataFrame, least: int, most: int) -> list[str]:
    """The ``most`` features, seen in ``least`` documents or more, that speak
    for class 1 most clearly by the likelihood ratio of their document counts."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            y = batch.column(0).to_numpy()
            names, at, row = word_features(batch.column(1))
            ones = np.bincount(at, y[row], minlength=len(names)).astype(np.int64)
            both = np.bincount(at, minlength=len(names))
            yield pa.RecordBatch.from_arrays([names, pa.array(ones), pa.array(both - ones)], names=["feature", "ones", "zeros"])

    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return []
    table = rows.mapInArrow(run, "feature string, ones long, zeros long").groupBy("feature").agg(
        F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    share = sizes[1] / (sizes[0] + sizes[1])
    n = F.col("ones") + F.col("zeros")

    def part(x, expected):
        return F.when(x > 0, x * F.log(x / (n * expected))).otherwise(0.0)

    gain = part(F.col("ones"), share) + part(F.col("zeros"), 1 - share)
    best = table.where((n >= least) & (F.col("ones") > n * share)).select("feature", gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(most)
    return sorted(r.feature for r in best.collect())


def fit(rows: DataFrame, least: int = 4, most: int = 4000, penalty: float = 0.05, rounds: int = 500) -> tuple[dict, float]:
    """Weights of a logistic model on the presence of the telling features, and
    its intercept. Weights are 0 or more: a text is toxic for what it holds, and
    no harmless words make up for it. The features' places in the bounded sample reach the driver."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names = telling_features(rows, least, most)

    def run(batches):
        for batch in batches:
            found, at, row = word_features(batch.column(1), pa.array(names, pa.string()))
            told = pc.index_in(found, pa.array(names, pa.string())).fill_null(-1).to_numpy().astype(np.int64)[at]
            told = told[np.lexsort((told, row))].astype(np.int32)
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(told))], names=["y", "at"])

    got = rows.mapInArrow(run, "y int, at array<int>").toArrow()
    y = got.column("y").to_numpy().astype(float)
    if not len(y):
        return {}, 0.0
    if not names:
        share = min(max(y.mean(), 0.01), 0.99)
        return {}, float(np.log(share / (1 - share)))
    at = got.column("at").combine_chunks()
    col = np.asarray(at.values).astype(np.int64)
    row = np.repeat(np.arange(len(y)), np.asarray(at.value_lengths()))
    w, b, speed_w, speed_b = np.zeros(len(names)), np.log(y.mean() / (1 - y.mean())), 0.0, 0.0
    # Diagonal steps: each feature's curvature is at most a quarter of its count.
    width = np.bincount(row, minlength=len(y)).mean() + 1
    size = 0.25 * np.bincount(col, minlength=len(names)) * width ** 0.5 + penalty
    for _ in range(rounds):
        ahead_w, ahead_b = w + 0.9 * speed_w, b + 0.9 * speed_b
        z = ahead_b + np.bincount(row, ahead_w[col], minlength=len(y))
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.bincount(col, gap[row], minlength=len(names)) + penalty * ahead_w
        speed_w = 0.9 * speed_w - grad / size
        speed_b = 0.9 * speed_b - gap.sum() / (0.25 * len(y) * width ** 0.5)
        moved = np.maximum(w + speed_w, 0)
        speed_w, w, b = moved - w, moved, b + speed_b
    return {f: float(x) for f, x in zip(names, w) if x > 0}, float(b)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0,
             most_labelled: int = 60_000, keep=("doc_id",)) -> DataFrame:
    """Columns ``keep``, held_out, score, predicted for every row of ``docs``.

    The language model counts every whole text. The linear model learns from at
    most ``most_labelled`` labelled documents outside the held-out fold; every
    whole text is restored and scored. Null and empty texts have no words and
    get the score of the intercept. Repeated rows score alike; an id labelled
    twice counts once, with the larger label; null labels and null ids are not
    learned from. Without rows of both classes every score is that of the share
    of toxic labels (0.5 without labels). Other columns are ignored; an empty
    table gives an empty one.
    """
    import pyarrow as pa

    bound_batches(docs.sparkSession)
    lm = language_model(docs)
    weights, intercept = fit(training_words(docs, labels, label, lm, folds, held, most_labelled))
    keep = list(dict.fromkeys(["doc_id", *keep]))
    columns = list(dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches):
        active = Active(weights)
        reader = Restorer(lm, active, active.starts)
        for batch in batches:
            z = []
            for part in _slices(batch.column("text").to_pylist()):
                z.extend(intercept + sum(weights[f] for f in found) for found in reader.words(part))
            score = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score, pa.float64())], names=[*keep, "score"])

    scored = docs.select(*columns).mapInArrow(run, f"{schema}, score double")
    return scored.select(*keep, (fold("doc_id", folds) == held).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
