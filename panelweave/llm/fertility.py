"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback measures how well a text is covered:
characters per token, share of byte-fallback tokens and entropy of the tokens.
Bands for the three measures come from all documents of a language (or, with no
language, of the main script) and of like length; a text outside its bands is
rejected.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import WORD, bound_batches, stored
from panelweave.operators.joins import salted_join
from panelweave.operators.spread import fits

WORDS = re.compile(WORD)
SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 8
# Ranges of code points by script; other letters count as ``other``.
SCRIPTS = (("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("hebrew", 0x0590, 0x05FF),
           ("arabic", 0x0600, 0x06FF), ("indic", 0x0900, 0x0DFF), ("thai", 0x0E00, 0x0E7F), ("kana", 0x3040, 0x30FF),
           ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Meter:
    """Fertility measures of a word list under a vocabulary."""

    def __init__(self, path: str):
        self.model = processor(path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def measure(self, words: list[str]):
        """Token count, characters per token, byte share, entropy in bits."""
        ids = np.array(self.model.encode(" ".join(words)), np.int64)
        n = len(ids)
        if not n:
            return 0, 0.0, 0.0, 0.0
        counts = np.bincount(ids)
        p = counts[counts > 0] / n
        return n, sum(map(len, words)) / n, float(self.is_byte[ids].mean()), float(-(p * np.log2(p)).sum())


def repeated_words(words: list[str]) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more.

    Windows get equal numbers exactly if equal: numbers of two halves, doubled.
    """
    if len(words) <= WINDOW:
        return 0
    places: dict[str, int] = {}
    ids = np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words))
    step = 1
    while step < WINDOW:
        kinds, ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)
        if len(kinds) == len(ids):
            return 0
        step *= 2
    hit = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:len(hit)] += hit
    edge[WINDOW:] -= hit
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script with most letters among the given ranges."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sums = [int(((points >= a) & (points <= b)).sum()) for _, a, b in SCRIPTS]
    return SCRIPTS[int(np.argmax(sums))][0] if max(sums) else "other"


def measure(docs: DataFrame, path: str) -> DataFrame:
    """Per document the base counts and the three measures, with its group."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "entropy", "script"]
    kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string()]

    def run(batches):
        meter = Meter(path)
        for batch in batches:
            out = []
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = text or ""
                words = WORDS.findall(text)
                out.append((len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), repeated_lines(text),
                            repeated_words(words), *meter.measure(words), lang or f"script:{script_of(text)}"))
            cols = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *names])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    schema = f"doc_id {kind}, " + ", ".join(f"{n} {'string' if k == pa.string() else 'long' if k == pa.int64() else 'double'}" for n, k in zip(names, kinds))
    return docs.select("doc_id", "text", lang.alias("lang")).mapInArrow(run, schema).withColumnRenamed("script", "band")


def rules(docs: DataFrame, path: str, width: float = 2.0, least_words: int = 20, most_repeated: int = 30,
          enough: int = 50) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, and the measures.

    The base fails below ``least_words`` words or with more than
    ``most_repeated`` percent of words in repeated windows. Of the rest, a text
    is kept while its three measures lie inside the bands of its language:
    characters per token and entropy within ``width`` interquartile ranges of
    the quartiles, byte share at most the upper bound. Quartiles come from the
    texts that pass the base, texts with equal measures once, so that copies do
    not narrow a band. A text is held against texts of its language and like
    length: the nearest doubling of the token count, at most one away, with
    ``enough`` texts; else against such texts of all languages; else against
    texts of any length, of its language if there are ``enough``, with entropy
    less half the logarithm of the length. Quartiles of more than 1,000 texts are
    exact to a thousandth of the ranks, which may move a text at the very edge of
    a band between runs.
    Null texts count as empty and fail the base. Texts without a language use
    the main script's bands. Repeated rows are judged alike; other columns are
    ignored; an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    rows = stored(measure(docs, path), "fertility")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    log = F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))
    rows = rows.withColumns({"length": F.round(log).cast("int"), "spread": F.col("entropy") - log * 0.5})
    measures = ("chars_per_token", "byte_share", "entropy", "spread")
    quartiles = F.struct(*[F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(m) for m in measures]).alias("q")
    sound = rows.where(~F.col("base_failed")).select("band", "length", *measures).distinct()
    sound = stored(sound, "fertility-sound")
    counted = (F.count(F.lit(1)).alias("n"), quartiles)
    near = F.col("n") >= enough

    # by language and length, by length, by language, and all
    classes = sound.groupBy("band", "length").agg(*counted).where(near).groupBy("band").agg(
        F.collect_list(F.struct("length", "q")).alias("own"))
    whole = sound.groupBy("band").agg(*counted).select("band", F.when(near, F.col("q")).alias("any"))
    bands = stored(whole.join(classes, "band", "left"), "fertility-bands")
    shared = sound.groupBy("length").agg(*counted).where(near).agg(F.collect_list(F.struct("length", "q")).alias("shared"))
    shared = stored(shared.crossJoin(sound.agg(quartiles.alias("every"))), "fertility-shared")
    met = rows.join(F.broadcast(bands), "band", "left") if fits(bands) else salted_join(rows, bands, "band", "left")
    met = met.crossJoin(F.broadcast(shared))

    def nearest(classes):
        away = F.array_min(F.transform(classes, lambda s: F.struct(
            F.abs(s["length"] - F.col("length")).alias("away"), s["length"].alias("length"), s["q"].alias("q"))))
        return F.when(away["away"] <= 1, away["q"])

    met = met.withColumn("like", F.coalesce(nearest(F.col("own")), nearest(F.col("shared"))))
    met = met.withColumn("loose", F.coalesce("any", "every"))

    def within(quarters, m, floor, both=True):
        low, high = F.col(quarters)[m][0], F.col(quarters)[m][2]
        room = F.greatest((high - low) * width, F.lit(floor))
        inside = F.col(m) <= high + room
        return inside & (F.col(m) >= low - room) if both else inside

    def verdict(quarters, entropy):
        return (within(quarters, "chars_per_token", 0.05) & within(quarters, "byte_share", 0.05, both=False)
                & within(quarters, entropy, 0.1))

    kept = F.when(F.col("like").isNotNull(), verdict("like", "entropy")).otherwise(verdict("loose", "spread"))
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & F.coalesce(kept, F.lit(True))).alias("kept"),
                      "n_tokens", "chars_per_token", "byte_share", "entropy")
