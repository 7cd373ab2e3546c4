"""A corpus pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. Columns of the
documents table are carried through; others are left out. A document without an
id takes part in every stage but the near-duplicate one, which keeps it.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.llm import bpe, minhash, mixing, suffix, toxicity
from panelweave.llm.common import stored, table
from panelweave.llm.queries import vocabulary_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark, docs, sf_dir):
    """Leave out documents that the toxicity model rejects.

    Null and empty texts hold no words and stay unless most labelled documents
    are toxic. Repeated rows stay or go together. A null id takes no part in
    learning. An empty table gives an empty one.
    """
    scored = toxicity.classify(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: shingles of five words,
    similarity 0.8 or more.

    Null, empty and wordless texts are in no group and stay. Of rows that share
    the id that stays, the one with the smallest hash of its text stays. Rows
    without an id are all kept. An empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    named = docs.where("doc_id IS NOT NULL")
    gone = minhash.near_duplicates(named, 80, 5).where("NOT kept").select("doc_id").distinct()
    left = named.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        # One row per id passes the window before the shuffle, so a hot id stays small.
        first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.col("text"))
        left = left.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*COLUMNS)
    return left.unionByName(docs.where("doc_id IS NULL"))


def drop_repeats(spark, docs, sf_dir):
    """Remove passages that an earlier document, or an earlier place, has.

    Null texts stay null, empty ones empty; a text that is repeated throughout
    becomes empty and its row stays. Rows that repeat an id and its text do not
    repeat each other; null ids come first. ``n_chars`` follows the text. An
    empty table gives an empty one.
    """
    left = suffix.remove_repeats(docs.select(*COLUMNS), with_text=True)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark, docs, sf_dir):
    """Repeat or leave out documents so that sources meet their targets.

    A null source is one of its own, last in order. Null and empty texts have
    size 0 and are taken like others; a source without words is left out whole.
    Repeated rows and null ids are separate documents. An empty table gives an
    empty one.
    """
    sized = docs.select(*COLUMNS, mixing.words().alias("size"))
    return mixing.repeat_rows(mixing.mix(sized), COLUMNS)


def encode(spark, docs, sf_dir):
    """Token ids of every document that the mix took.

    A null text counts as empty; an empty text has no ids. Repeated rows and
    null ids are encoded alike and stay. An empty table gives an empty one.
    """
    return bpe.encode(docs.select(*COLUMNS), vocabulary_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffix", drop_repeats),
    ("mixing", mix),
    ("bpe", encode),
]

# The toxicity, near-duplicate and suffix stages have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
