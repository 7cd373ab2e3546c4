"""Bag-of-words features, vocabulary limits, phrases and splits."""

from __future__ import annotations

import math

from pyspark.ml.feature import Binarizer, CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelweave import fixed
from panelweave.functions.arrays import pairs_of
from panelweave.operators.joins import salted_join
from panelweave.operators.spread import fits, hash_quota, stable_hash
from panelweave.session import drop_scratch, scratch_path, settle


# Joins the words of a pair; no token holds it.
PAIR_MARK = "\x01"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ngram(t: Column, n: int, sep: str) -> Column:
    # lambdas use their own arguments only, see ``arrays.pairs_of``
    words = F.greatest(F.size(t) - (n - 1), F.lit(0))
    out = F.slice(t, F.lit(1), words)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(t, F.lit(k), words), lambda a, b: F.concat_ws(sep, a, b))
    return out


def ngrams(tokens, low=1, high=2, sep=" ") -> Column:
    """All n-grams of a token column from ``low`` to ``high`` words."""
    t = _col(tokens)
    lists = [t if n == 1 else _ngram(t, n, sep) for n in range(low, high + 1)]
    return F.concat(*lists) if len(lists) > 1 else lists[0]


def term_counts(df, doc, terms, keep=()) -> DataFrame:
    """Occurrences per (document, term), in long form.

    A document is one row, so its terms are sorted and run lengths taken
    within the row; nothing is shuffled.
    """
    rows = df.select(doc, *keep, F.sort_array(_col(terms)).alias("_s"))
    n = F.size("_s")
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("_s", F.lit(1), F.greatest(n - 1, F.lit(0))))
    fresh = F.zip_with("_s", F.slice(before, F.lit(1), n), lambda x, p: F.struct(
        x.alias("term"), (p.isNull() | (p != x)).alias("new")))
    rows = rows.select(doc, *keep, n.cast("bigint").alias("_n"), F.filter(
        F.transform(fresh, lambda e, i: F.struct(
            e["term"].alias("term"), i.cast("bigint").alias("at"), e["new"].alias("new"))),
        lambda e: e["new"]).alias("_h"))
    starts = F.transform("_h", lambda h: h["at"])
    ends = F.concat(F.slice(starts, F.lit(2), F.size("_h")), F.array("_n"))
    counted = F.zip_with("_h", F.slice(ends, F.lit(1), F.size("_h")), lambda h, e: F.struct(
        h["term"].alias("term"), (e - h["at"]).alias("tf")))
    return _exploded(rows, [doc, *keep], counted, "_c").select(doc, *keep, "_c.term", "_c.tf")


def _exploded(rows, keep, values, out) -> DataFrame:
    """Explode a costly list. Exploded itself, it would be computed a second
    time by the filter on empty lists that the optimizer adds."""
    return rows.select(*keep, F.explode(F.array(values)).alias("_l")).select(*keep, F.explode("_l").alias(out))


def term_stats(df, terms) -> DataFrame:
    """Document frequency and total frequency per term; ``df`` has one row per
    document. One shuffle, after partial counts are merged."""
    return _stats(df.select(terms), [], terms)


def term_stats_by(df, key, terms) -> DataFrame:
    """``term_stats`` for each value of a column: (key, term, df, tf)."""
    return _stats(df.select(key, terms), [key], terms)


def _stats(rows, keys, terms) -> DataFrame:
    # a document's terms stand once with repeats for tf and once without for df
    both = rows.select(*keys, F.posexplode(F.array(F.col(terms), F.array_distinct(terms))).alias("_once", "_l"))
    cells = both.select(*keys, "_once", F.explode("_l").alias("term"))
    return cells.groupBy(*keys, "term").agg(F.sum(F.col("_once").cast("bigint")).alias("df"), F.sum((1 - F.col("_once")).cast("bigint")).alias("tf"))


def term_totals(df, terms) -> DataFrame:
    """Total frequency per term."""
    return _exploded(df, [], F.col(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("tf"))


def nonzero(features) -> Column:
    """(indices, values) of a vector column without filling in its zeros."""
    v = F.unwrap_udt(_col(features))
    at = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    return F.struct(at.alias("at"), v["values"].alias("values"))


def filter_vocab(df, terms, no_below=fixed.DICT_NO_BELOW, no_above=fixed.MAX_DF, max_terms=None) -> DataFrame:
    """Terms in at least ``no_below`` documents and at most the share
    ``no_above`` of them; optionally the ``max_terms`` most frequent."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    kept = (term_stats(df, terms).crossJoin(F.broadcast(total))
            .where((F.col("df") >= no_below) & (F.col("df") <= F.col("_n") * no_above)).drop("_n"))
    return kept.orderBy(F.desc("tf"), "term").limit(max_terms) if max_terms else kept


def _meet(rows, table, on) -> DataFrame:
    """Rows whose key is in a stored table, by broadcast when its bytes are few."""
    if fits(table):
        return rows.join(F.broadcast(table), on, "left_semi")
    return salted_join(rows, table, on, "left_semi")


def bow_table(df, doc, terms, vocab) -> DataFrame:
    """Relational bag of words: counts per (document, kept term).

    The vocabulary is stored once. When counted small it is broadcast, so
    counts are not shuffled at all; else frequent terms are split in the join.
    """
    return _meet(term_counts(df, doc, terms), settle(vocab.select("term")), "term")


def counted_bow(df, doc, terms, no_below=fixed.MIN_DF, no_above=fixed.MAX_DF, max_terms=fixed.MAX_FEATURES) -> DataFrame:
    """``bow_table`` over the table's own vocabulary. The counts are stored once
    and give the vocabulary as well, so texts are read a single time."""
    counts = settle(term_counts(df, doc, terms))
    stats = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    kept = stats.crossJoin(F.broadcast(total)).where((F.col("df") >= no_below) & (F.col("df") <= F.col("_n") * no_above))
    kept = kept.orderBy(F.desc("tf"), "term").limit(max_terms) if max_terms else kept
    return _meet(counts, settle(kept.select("term")), "term")


def idf_table(vocab, n_docs) -> DataFrame:
    """Smoothed inverse document frequency ``ln((1 + n) / (1 + df)) + 1``."""
    return vocab.withColumn("idf", F.log((F.lit(1.0) + n_docs) / (1.0 + F.col("df"))) + 1)


class BowModel:
    """Vocabulary fitted on one table, applied to others.

    ``frequency`` gives counts, ``onehot`` 0/1, ``tf_idf`` smoothed weights
    with unit length. The vocabulary has at most ``max_features`` terms.
    """

    def __init__(self, terms_col, vocabulary, dfs, n_docs):
        self.terms_col, self.vocabulary = terms_col, vocabulary
        self.dfs, self.n_docs = dfs, n_docs

    def transform(self, df, method="frequency", out="features") -> DataFrame:
        counts = out if method == "frequency" else "_counts"
        rows = CountVectorizerModel.from_vocabulary(
            self.vocabulary, inputCol=self.terms_col, outputCol=counts, minTF=1.0).transform(df)
        return rows if method == "frequency" else self.recode(rows, method, counts, out).drop(counts)

    def recode(self, df, method, counts, out="features") -> DataFrame:
        """``transform`` from a column of counts that is there already; several
        encodings of one table need its terms counted only once."""
        if method == "frequency":
            return df.withColumn(out, F.col(counts))
        if method == "onehot":
            return Binarizer(threshold=0.0, inputCol=counts, outputCol=out).transform(df)
        weights = [math.log((1 + self.n_docs) / (1 + d)) + 1 for d in self.dfs]
        scaled = ElementwiseProduct(
            scalingVec=Vectors.dense(weights), inputCol=counts, outputCol="_scaled").transform(df)
        return Normalizer(p=2.0, inputCol="_scaled", outputCol=out).transform(scaled).drop("_scaled")


def fit_bow(df, terms, max_features=fixed.MAX_FEATURES, min_df=fixed.MIN_DF, max_df=fixed.MAX_DF) -> BowModel:
    """Fit the vocabulary; only its ``max_features`` terms reach the driver."""
    rows = filter_vocab(df, terms, min_df, max_df, max_features).collect()
    rows.sort(key=lambda r: (-r["tf"], r["term"]))
    return BowModel(terms, [r["term"] for r in rows], [r["df"] for r in rows], df.count())


def _word_stats(df, words, key=None, docs=False) -> DataFrame:
    """``term_stats`` (or ``term_stats_by``) for terms that many documents share:
    they are numbered and counted by batches of documents, and a batch's distinct
    terms alone are grouped. With ``docs``, the row of ``PAIR_MARK`` has the number
    of documents as ``df``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def counted(lists):
        row, coded = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).dictionary_encode(null_encoding="encode")
        size = max(len(coded.dictionary), 1)
        both = np.sort(row.astype(np.int64) * size + coded.indices.to_numpy())
        once = both[np.diff(both, prepend=-1) != 0]
        df, tf = (np.bincount(c % size, minlength=size)[:len(coded.dictionary)] for c in (once, both))
        found = [coded.dictionary, pa.array(df), pa.array(tf)]
        return [pa.concat_arrays([a, pa.array([b], a.type)]) for a, b in zip(found, (PAIR_MARK, len(lists), 0))] if docs else found

    def run(batches):
        for batch in batches:
            if key is None:
                yield pa.RecordBatch.from_arrays(counted(batch.column(words)), names=names)
                continue
            for value in pc.unique(batch.column(key)):
                mine = pc.is_null(batch.column(key)) if not value.is_valid else pc.equal(batch.column(key), value)
                found = counted(batch.column(words).filter(mine))
                yield pa.RecordBatch.from_arrays([pa.array([value.as_py()] * len(found[0]), value.type), *found], names=names)

    keys = [] if key is None else [key]
    names = [*keys, "term", "df", "tf"]
    kinds = [f"`{key}` {df.schema[key].dataType.simpleString()}"] if keys else []
    got = df.select(*keys, words).mapInArrow(run, ", ".join([*kinds, "term string, df bigint, tf bigint"]))
    return got.groupBy(*keys, "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


# Most words, as a multiple of the vocabulary, whose pairs are counted by number.
NUMBERED = 4


def fit_grams(df, words, terms, keep, max_features=fixed.MAX_FEATURES, min_df=fixed.MIN_DF, max_df=fixed.MAX_DF):
    """(BowModel, stored ``keep`` and ``features``): ``fit_bow`` and its counts for
    ``terms`` that are the words and neighbouring pairs of ``words``.

    A pair is no more frequent than its words. So with the words' own counts a
    bound is known that every term of the vocabulary reaches, only words above it
    are numbered, and pairs are counted and looked up by number. None where very
    many words share the bound. Words hold no space.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = df.sparkSession
    all_docs = F.col("term").eqNullSafe(PAIR_MARK)
    stats = settle(_word_stats(df, words, docs=True).where((F.col("df") >= min_df) | all_docs))
    n_docs = stats.where(all_docs).agg(F.sum("df")).first()[0] or 0
    stats = stats.where(~all_docs)
    fitting = F.col("df") <= n_docs * max_df
    top = stats.where(fitting).orderBy(F.desc("tf")).limit(max_features).agg(F.count(F.lit(1)).alias("n"), F.min("tf").alias("least")).first()
    least = top["least"] if top["n"] == max_features else 1
    known = stats.where(F.col("tf") >= least).select("term").limit(NUMBERED * max_features + 1).toArrow().column("term").combine_chunks()
    size = len(known)
    if size > NUMBERED * max_features:
        return None
    share, n_words = spark.sparkContext.broadcast(known), max(size, 1)

    def number(batches):
        for batch in batches:
            lists = batch.column(words)
            each = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            found = pc.fill_null(pc.index_in(pc.list_flatten(lists), share.value), -1)
            bounds = pa.array(np.append(0, np.cumsum(each)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.ListArray.from_arrays(bounds, found)], names=[*keep, "_at"])

    def cells(batch):
        """Numbers, rows, and the pairs of neighbours with theirs."""
        lists = batch.column("_at")
        row, at = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy().astype(np.int64)
        met = np.flatnonzero((row[1:] == row[:-1]) & (at[1:] >= 0) & (at[:-1] >= 0))
        one = np.flatnonzero(at >= 0)
        return at[one], row[one], at[met] * n_words + at[met + 1], row[met]

    def counted(batches):
        for batch in batches:
            _, _, pair, row = cells(batch)
            both = np.sort(pair * batch.num_rows + row)
            pair, row = np.divmod(both, max(batch.num_rows, 1))
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            fresh = np.diff(both, prepend=-1) != 0
            sums = [np.add.reduceat(v.astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for v in (fresh, np.ones(len(pair)))]
            yield pa.RecordBatch.from_arrays([pa.array(pair[first]), *map(pa.array, sums)], names=["pair", "df", "tf"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields]
    path = scratch_path(spark, "numbers")
    df.select(*keep, words).mapInArrow(number, ", ".join([*kinds, "_at array<int>"])).write.parquet(path)
    rows = spark.read.schema(", ".join([*kinds, "_at array<int>"])).parquet(path)
    pairs = rows.select("_at").mapInArrow(counted, "pair bigint, df bigint, tf bigint").groupBy("pair").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    names = F.broadcast(spark.createDataFrame(pa.table({"i": np.arange(size), "w": known})))
    a, b = (names.select(F.col("i").alias(f"_{c}"), F.col("w").alias(c)) for c in "ab")
    pairs = pairs.where((F.col("df") >= min_df) & (F.col("tf") >= least)).withColumns({"_a": F.expr(f"pair div {n_words}"), "_b": F.col("pair") % n_words})
    pairs = pairs.join(a, "_a").join(b, "_b").select(F.concat_ws(" ", "a", "b").alias("term"), "df", "tf", "pair")
    every = stats.withColumn("pair", F.lit(None).cast("bigint")).unionByName(pairs).where(fitting)
    vocab = every.orderBy(F.desc("tf"), "term").limit(max_features).collect()
    vocab.sort(key=lambda r: (-r["tf"], r["term"]))
    bow = BowModel(terms, [r["term"] for r in vocab], [r["df"] for r in vocab], n_docs)

    single = np.full(n_words, -1)
    place = {w: i for i, w in enumerate(known.to_pylist())}
    for i, r in enumerate(vocab):
        if r["pair"] is None:
            single[place[r["term"]]] = i
    paired = sorted((r["pair"], i) for i, r in enumerate(vocab) if r["pair"] is not None)
    width = len(vocab)
    # a number beyond all pairs ends the list, so that every search has a hit
    look = spark.sparkContext.broadcast((single, np.array([p for p, _ in paired] + [np.iinfo(np.int64).max]), np.array([i for _, i in paired] + [-1])))

    def vectors(batches):
        single, pairs, numbers = look.value
        for batch in batches:
            at, row, pair, beside = cells(batch)
            hit = np.searchsorted(pairs, pair)
            found = np.concatenate([single[at], np.where(pairs[hit] == pair, numbers[hit], -1)])
            both = np.concatenate([row, beside]).astype(np.int64)[found >= 0] * max(width, 1) + found[found >= 0]
            both, times = np.unique(both, return_counts=True)
            ends = np.cumsum(np.bincount(both // max(width, 1), minlength=batch.num_rows))
            bounds = pa.array(np.append(0, ends).astype(np.int32))
            n = batch.num_rows
            made = pa.StructArray.from_arrays(
                [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)), pa.ListArray.from_arrays(bounds, pa.array((both % max(width, 1)).astype(np.int32))),
                 pa.ListArray.from_arrays(bounds, pa.array(times.astype(float)))], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], made], names=[*keep, "features"])

    out = scratch_path(spark, "counts")
    rows.mapInArrow(vectors, ", ".join([*kinds, "features struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"])).write.parquet(out)
    drop_scratch(spark, path)
    return bow, spark.read.schema(StructType([*df.select(*keep).schema.fields]).add("features", VectorUDT())).parquet(out)


def fit_grams_by(rows, key, words, extra, keep, max_features, min_df, max_df):
    """({key: terms}, stored ``keep``, ``key``, ``at`` and ``counts``): the most
    frequent terms of each key among those in at least ``min_df`` of its documents
    and at most the share ``max_df``, and every document's known terms by number.
    Terms are the words and neighbouring pairs of ``words``, and those of ``extra``.

    Words are bounded and numbered as in ``fit_grams``; None where very many share
    the bounds. Words hold no space.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = rows.sparkSession
    both = rows.select(*keep, key, F.coalesce(F.size(words), F.lit(0)).alias("_n"), F.concat(words, extra).alias("_u"))
    all_docs = F.col("term").eqNullSafe(PAIR_MARK)
    stats = settle(_word_stats(both, "_u", key, docs=True).where((F.col("df") >= min_df) | all_docs))
    sizes = stats.where(all_docs).select(key, F.col("df").alias("_docs"))
    stats = stats.where(~all_docs).join(F.broadcast(sizes), key)
    fitting = F.col("df") <= F.col("_docs") * max_df

    def best(table):
        order = Window.partitionBy(key).orderBy(F.desc("tf"), "term")
        return table.where(fitting).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= max_features)

    least = best(stats).groupBy(key).agg(F.when(F.count(F.lit(1)) == max_features, F.min("tf")).otherwise(1).alias("_least"))
    bounds = settle(sizes.join(least, key, "left").withColumn("_least", F.coalesce("_least", F.lit(1))))
    reached = stats.drop("_docs").join(F.broadcast(bounds), key).where(F.col("tf") >= F.col("_least"))
    most = NUMBERED * max_features
    known = reached.select("term").distinct().limit(most + 1).toArrow().column("term").combine_chunks()
    size = len(known)
    if size > most:
        return None
    share, n_words = spark.sparkContext.broadcast(known), max(size, 1)

    def number(batches):
        for batch in batches:
            lists = batch.column("_u")
            coded = pc.list_flatten(lists).dictionary_encode()
            there = np.append(pc.fill_null(pc.index_in(coded.dictionary, share.value), -1).to_numpy(), -1).astype(np.int32)
            found = there[pc.fill_null(coded.indices, len(there) - 1).to_numpy()]
            each = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            ends = pa.array(np.append(0, np.cumsum(each)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.ListArray.from_arrays(ends, pa.array(found))], names=[*names, "_at"])

    def cells(batch):
        """Numbers, rows, and the pairs of neighbouring words with theirs."""
        lists = batch.column("_at")
        row, at = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy().astype(np.int64)
        each = pc.list_value_length(lists).to_numpy()
        place = np.arange(len(row)) - (np.cumsum(each) - each)[row]
        held = place + 1 < batch.column("_n").to_numpy()[row]
        met = np.flatnonzero(held[:-1] & (at[1:] >= 0) & (at[:-1] >= 0))
        one = np.flatnonzero(at >= 0)
        return at[one], row[one], at[met] * n_words + at[met + 1], row[met]

    def counted(batches):
        for batch in batches:
            groups = batch.column(key).dictionary_encode(null_encoding="encode")
            mine = groups.indices.to_numpy()
            _, _, pair, row = cells(batch)
            order = np.lexsort((row, pair, mine[row]))
            pair, row, group = pair[order], row[order], mine[row][order]
            new = np.append(True, (np.diff(pair) != 0) | (np.diff(group) != 0))[:len(pair)]
            first = np.flatnonzero(new)
            fresh = new | np.append(True, np.diff(row) != 0)[:len(pair)]
            sums = [np.add.reduceat(v.astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for v in (fresh, np.ones(len(pair)))]
            yield pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(group[first])), pa.array(pair[first]), *map(pa.array, sums)], names=[key, "pair", "df", "tf"])

    kinds = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields}
    names = [*keep, key, "_n"]
    path = scratch_path(spark, "numbers")
    kept = ", ".join([*[kinds[c] for c in names], "_at array<int>"])
    both.select(*names, "_u").mapInArrow(number, kept).write.parquet(path)
    coded = spark.read.schema(kept).parquet(path)
    pairs = coded.select(key, "_n", "_at").mapInArrow(counted, f"{kinds[key]}, pair bigint, df bigint, tf bigint").groupBy(key, "pair").agg(
        F.sum("df").alias("df"), F.sum("tf").alias("tf")).where(F.col("df") >= min_df)
    pairs = pairs.join(F.broadcast(bounds), key).where(F.col("tf") >= F.col("_least")).withColumns(
        {"_a": F.expr(f"pair div {n_words}"), "_b": F.col("pair") % n_words})
    table = F.broadcast(spark.createDataFrame(pa.table({"i": np.arange(size), "w": known})))
    a, b = (table.select(F.col("i").alias(f"_{c}"), F.col("w").alias(c)) for c in "ab")
    pairs = pairs.join(a, "_a").join(b, "_b").select(key, F.concat_ws(" ", "a", "b").alias("term"), "df", "tf", "_docs", "pair")
    every = stats.select(key, "term", "df", "tf", "_docs", F.lit(None).cast("bigint").alias("pair")).unionByName(pairs)
    vocab: dict = {}
    for r in sorted(best(every).select(key, "_i", "term", "pair").collect(), key=lambda r: (r[0], r[1])):
        vocab.setdefault(r[0], []).append((r["term"], r["pair"]))

    place, look = {w: i for i, w in enumerate(known.to_pylist())}, {}
    for name, terms in vocab.items():
        single = np.full(n_words, -1)
        for i, (term, pair) in enumerate(terms):
            if pair is None:
                single[place[term]] = i
        paired = sorted((pair, i) for i, (_, pair) in enumerate(terms) if pair is not None)
        # a number beyond all pairs ends the list, so that every search has a hit
        look[name] = single, np.array([p for p, _ in paired] + [np.iinfo(np.int64).max]), np.array([i for _, i in paired] + [-1])
    tables = spark.sparkContext.broadcast(look)

    def encoded(batches):
        for batch in batches:
            at, row, pair, beside = cells(batch)
            values = np.array(batch.column(key).to_pylist(), object)
            made = [np.full(len(at), -1), np.full(len(pair), -1)]
            for name, (single, pairs, numbers) in tables.value.items():
                mine = values == name
                made[0] = np.where(mine[row], single[at], made[0])
                own = np.flatnonzero(mine[beside])
                hit = np.searchsorted(pairs, pair[own])
                made[1][own] = np.where(pairs[hit] == pair[own], numbers[hit], -1)
            found, owner = np.concatenate(made), np.concatenate([row, beside]).astype(np.int64)
            width = max(map(len, vocab.values()), default=1)
            cell, times = np.unique(owner[found >= 0] * width + found[found >= 0], return_counts=True)
            ends = pa.array(np.append(0, np.cumsum(np.bincount(cell // width, minlength=batch.num_rows))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (cell % width, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*keep, key]], *lists], names=[*keep, key, "at", "counts"])

    inside = coded.where(F.col(key).isin(list(vocab))) if vocab else coded.where(F.lit(False))
    out = settle(inside.mapInArrow(encoded, ", ".join([*[kinds[c] for c in [*keep, key]], "at array<int>, counts array<int>"])))
    drop_scratch(spark, path)
    return {name: [t for t, _ in terms] for name, terms in vocab.items()}, out


# Most words whose pairs are counted by number; other pairs are counted as words.
PAIRED = 1 << 18


def _pair_counts(df, tokens, known) -> DataFrame:
    """(pair, a, b, n): occurrences of neighbouring words. Those of two ``known``
    words have the number ``a * len(known) + b`` as ``pair``, others their words."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    share, size = df.sparkSession.sparkContext.broadcast(known), max(len(known), 1)

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            row, coded = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).dictionary_encode()
            at, n = pc.fill_null(coded.indices, -1).to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
            met = np.flatnonzero((row[1:] == row[:-1]) & (at[1:] >= 0) & (at[:-1] >= 0))
            pair, times = np.unique(at[met] * n + at[met + 1], return_counts=True)
            a, b = np.divmod(pair, n)
            number = pc.fill_null(pc.index_in(coded.dictionary, share.value), -1).to_numpy().astype(np.int64)
            number = number if len(number) else np.full(1, -1)
            rare = (number[a] < 0) | (number[b] < 0)
            words = [coded.dictionary.take(pa.array(v, mask=~rare)) for v in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(number[a] * size + number[b], mask=rare), *words, pa.array(times)], names=["pair", "a", "b", "n"])

    got = df.select(tokens).mapInArrow(run, "pair bigint, a string, b string, n bigint")
    return got.groupBy("pair", "a", "b").agg(F.sum("n").alias("n"))


def phrase_table(df, tokens, min_count=fixed.PHRASE_MIN_COUNT, threshold=fixed.PHRASE_THRESHOLD) -> DataFrame:
    """Neighbouring word pairs whose score passes the threshold.

    score = (n_ab - min_count) * V / (n_a * n_b), V the number of distinct
    words and pairs together. Words are counted first and the most frequent ones
    numbered, so that most pairs are counted by number.
    """
    import numpy as np
    import pyarrow as pa

    words = settle(_word_stats(df, tokens).select("term", F.col("tf").alias("n")))
    known = words.where(F.col("term").isNotNull()).orderBy(F.desc("n")).limit(PAIRED).select("term").toArrow().column("term").combine_chunks()
    pairs = settle(_pair_counts(df, tokens, known))
    size = words.count() + pairs.count()
    # pairs at or below min_count cannot pass, whatever their words
    kept = pairs.where(F.col("n") > min_count).withColumnRenamed("n", "n_ab")
    names = F.broadcast(df.sparkSession.createDataFrame(pa.table({"i": np.arange(len(known)), "w": known})))
    a, b = (names.select(F.col("i").alias(f"_{c}"), F.col("w").alias(c)) for c in "ab")
    n = max(len(known), 1)
    coded = kept.where(F.col("pair").isNotNull()).select(F.expr(f"pair div {n}").alias("_a"), (F.col("pair") % n).alias("_b"), "n_ab")
    coded = coded.join(a, "_a").join(b, "_b").select("a", "b", "n_ab")
    both = coded.unionByName(kept.where(F.col("pair").isNull()).select("a", "b", "n_ab"))
    scored = (both.join(words.toDF("a", "n_a"), "a").join(words.toDF("b", "n_b"), "b")
              .withColumn("score", (F.col("n_ab") - min_count) * F.lit(float(size)) / F.col("n_a") / F.col("n_b")))
    return scored.where(F.col("score") > threshold).select("a", "b", "n_ab", "n_a", "n_b", "score")


# Bits a phrase takes in the filter, and bytes of the largest one; more phrases
# share its bits, so that more pairs pass and are then looked up in vain.
PHRASE_BITS, FILTER_BYTES, FILTER_HASHES = 32, 1 << 20, 3


def phrase_filter(phrases):
    """A Bloom filter of (a, b) as a function from two Columns to a condition,
    or None without phrases. Its bits are set by an aggregate; at most
    FILTER_BYTES reach the driver and become a constant of the plan."""
    n = phrases.count()
    if not n:
        return None
    bits = 64
    while bits < min(n * PHRASE_BITS, FILTER_BYTES * 8):
        bits *= 2

    def places(a, b):
        h = F.xxhash64(a, b)
        # 21 bits of the hash each time, so up to 2 million bits are told apart; larger filters use more of it
        step = 64 // FILTER_HASHES
        return [F.pmod(F.shiftrightunsigned(h, i * step) if bits <= 1 << step else F.xxhash64(h, F.lit(i)), F.lit(bits)) for i in range(FILTER_HASHES)]

    at = phrases.select(F.explode(F.array(*places(F.col("a"), F.col("b")))).alias("p")).distinct()
    words = at.groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))).alias("v"))
    held = {r["w"]: r["v"] for r in words.collect()}
    table = F.split(F.lit(",".join(str(held.get(i, 0)) for i in range(bits // 64))), ",").cast("array<bigint>")

    def may_hold(a, b):
        tests = [F.call_function("shiftrightunsigned", F.get(table, F.floor(p / 64).cast("int")), (p % 64).cast("int")).bitwiseAND(
            F.lit(1).cast("bigint")) == 1 for p in places(a, b)]
        return tests[0] & tests[1] & tests[2]

    return may_hold


def collocations(df, doc, tokens, min_count=fixed.PHRASE_MIN_COUNT, threshold=fixed.PHRASE_THRESHOLD,
                 phrases=None) -> DataFrame:
    """Append ``a_b`` for every phrase found in a document, left to right and
    without overlap.

    A phrase table of few bytes is broadcast and looked up inside the row. Rows
    that share an id have the phrases of all of them; these, and rows under a
    larger table, meet their phrases in a join.
    """
    phrases = phrase_table(df, tokens, min_count, threshold) if phrases is None else phrases
    phrases = settle(phrases.select("a", "b").dropna())
    if phrases.isEmpty():
        return df
    if not fits(phrases):
        return _joined_phrases(df, doc, tokens, phrases)
    shared = settle(df.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(doc))
    if shared.isEmpty():
        return _looked_up_phrases(df, doc, tokens, phrases)
    apart = _looked_up_phrases(df.join(shared, doc, "left_anti"), doc, tokens, phrases)
    return apart.unionByName(_joined_phrases(df.join(shared, doc, "left_semi"), doc, tokens, phrases))


def _looked_up_phrases(df, doc, tokens, phrases) -> DataFrame:
    """``collocations`` of rows with an id each; a row without id has none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table = phrases.distinct().toArrow()
    a, b = (table.column(c).combine_chunks() for c in "ab")
    words = pc.unique(pa.concat_arrays([a, b]))
    size = max(len(words), 1)
    code = pc.index_in(a, words).to_numpy().astype(np.int64) * size + pc.index_in(b, words).to_numpy()
    order = np.argsort(code)
    joined = pc.binary_join_element_wise(a, b, "_").take(pa.array(order))
    # a number beyond all pairs ends the list, so that every search has a hit
    share = df.sparkSession.sparkContext.broadcast((words, np.append(code[order], np.iinfo(np.int64).max), joined))

    def run(batches):
        words, codes, joined = share.value
        for batch in batches:
            lists = batch.column(tokens)
            row, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
            coded = flat.dictionary_encode()
            number = np.append(pc.fill_null(pc.index_in(coded.dictionary, words), -1).to_numpy().astype(np.int64), -1)
            at = number[pc.fill_null(coded.indices, len(number) - 1).to_numpy()]
            named = pc.is_valid(batch.column(doc)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero((row[1:] == row[:-1]) & (at[1:] >= 0) & (at[:-1] >= 0) & named[row[:-1]])
            pair = at[first] * size + at[first + 1]
            place = np.searchsorted(codes, pair)
            first, place = first[codes[place] == pair], place[codes[place] == pair]
            # of hits that overlap in a chain every second is taken; hits of two rows are apart by a word
            starts = np.flatnonzero(np.diff(first, prepend=-2) != 1)
            nth = np.arange(len(first)) - np.repeat(starts, np.diff(np.append(starts, len(first))))
            first, place = first[nth % 2 == 0], place[nth % 2 == 0]
            # a row's phrases stand after its words
            order = np.argsort(np.concatenate([row, row[first]]), kind="stable")
            merged = pa.concat_arrays([flat, joined.take(pa.array(place))]).take(pa.array(order))
            each = pc.fill_null(pc.list_value_length(lists), 0).to_numpy() + np.bincount(row[first], minlength=batch.num_rows)
            bounds = pa.array(np.append(0, np.cumsum(each)).astype(np.int32), mask=np.append(pc.is_null(lists).to_numpy(zero_copy_only=False), False))
            made = pa.ListArray.from_arrays(bounds, merged)
            yield pa.RecordBatch.from_arrays([made if c == tokens else batch.column(c) for c in names], names=names)

    names = [doc, *[c for c in df.columns if c != doc]]
    return df.select(*names).mapInArrow(run, df.select(*names).schema)


def _joined_phrases(df, doc, tokens, phrases) -> DataFrame:
    """``collocations`` by a join. Neighbours are tested against a filter of the
    phrases inside the row, so that little more than the phrases themselves is
    exploded and looked up."""
    may_hold = phrase_filter(phrases)
    if may_hold is None:
        return df
    near = candidate_pairs(tokens, may_hold)
    long = df.select(doc, F.explode(near).alias("_p")).select(
        doc, F.col("_p.pos").alias("_pos"), F.col("_p.a").alias("a"), F.col("_p.b").alias("b"))
    hits = _meet(long, phrases, ["a", "b"])
    # no longer than the document
    found = hits.groupBy(doc).agg(F.sort_array(F.collect_list(
        F.struct("_pos", F.concat_ws("_", "a", "b").alias("w")))).alias("_f"))
    chosen = F.aggregate(
        F.col("_f"),
        F.struct(F.lit(-2).alias("last"), F.array().cast("array<string>").alias("words")),
        lambda s, x: F.when(x["_pos"] > s["last"] + 1, F.struct(
            x["_pos"].alias("last"), F.array_append(s["words"], x["w"]).alias("words"))).otherwise(s),
        lambda s: s["words"])
    added = found.select(doc, chosen.alias("_added"))
    return df.join(added, doc, "left").withColumn(
        tokens, F.concat(F.col(tokens), F.coalesce("_added", F.array().cast("array<string>")))).drop("_added")


def candidate_pairs(tokens, may_hold) -> Column:
    """(pos, a, b) of the neighbours that pass a phrase filter."""
    placed = F.transform(pairs_of(tokens), lambda p, i: F.struct(i.alias("pos"), p["src"].alias("a"), p["dst"].alias("b")))
    return F.filter(placed, lambda p: may_hold(p["a"], p["b"]))


def stratified_split(df, strata, key, kept=fixed.KEPT_SHARE, test=fixed.TEST_SHARE, val=fixed.VAL_SHARE,
                     seed=fixed.SEED, out="split") -> DataFrame:
    """Nested stratified split with exact sizes per stratum: unused, then test,
    then validation, the rest is the training set."""
    def sizes(n):
        n_kept = F.round(n * kept)
        n_test = F.round(n_kept * test)
        n_val = F.round((n_kept - n_test) * val)
        return [("test", n_test), ("val", n_val), ("train", n_kept - n_test - n_val),
                ("unused", n - n_kept)]
    return hash_quota(df, strata, key, sizes, out, seed)


def grouped_split(df, group, shares=fixed.GROUPED_SHARES, seed=fixed.SEED, out="split") -> DataFrame:
    """Split that never shares a group: each group gets a hash bucket of
    1,000, and the buckets are dealt by the shares. No shuffle."""
    bucket = F.pmod(stable_hash(group, seed=seed), F.lit(1000))
    chain, end = None, 0.0
    for label, share in shares[:-1]:
        end += share * 1000
        chain = (F.when if chain is None else chain.when)(bucket < round(end), label)
    return df.withColumn(out, chain.otherwise(shares[-1][0]))


def balanced_split(df, group, stratum, shares=fixed.GROUPED_SHARES, seed=fixed.SEED, out="split") -> DataFrame:
    """Split that never shares a group and has the shares within each stratum.

    A group belongs to the stratum of most of its rows (the smallest of equal
    ones); the groups of a stratum are dealt in hash order with exact sizes,
    the last share taking the rest. ``balance_report`` shows the outcome.
    """
    cells = df.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("_n"))
    first = F.min_by(F.col(stratum), F.struct(-F.col("_n"), F.col(stratum)))
    groups = settle(cells.groupBy(group).agg(first.alias("_stratum")))

    def sizes(n):
        return [(label, F.round(n * share)) for label, share in shares]

    dealt = hash_quota(groups, "_stratum", group, sizes, out, seed).select(group, out)
    return salted_join(df, dealt, group, "left")


def balance_report(df, split, stratum) -> DataFrame:
    """Share of each stratum within each split."""
    counts = df.groupBy(split, stratum).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(split).agg(F.sum("n").alias("_t"))
    return counts.join(totals, split).withColumn("share", F.col("n") / F.col("_t")).drop("_t")
