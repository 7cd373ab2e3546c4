"""List expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filter_list(arr, valid) -> Column:
    """Elements that belong to ``valid`` (a short list or an array column)."""
    if isinstance(valid, (Column, str)):
        allowed = _col(valid)
        return F.filter(_col(arr), lambda x: F.array_contains(allowed, x))
    return F.filter(_col(arr), lambda x: x.isin(list(valid)))


def list_sum(arr) -> Column:
    """Sum of a numeric list; 0 for an empty one, nulls ignored."""
    return F.aggregate(_col(arr), F.lit(0.0),
                       lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))


def list_len(arr) -> Column:
    return F.size(_col(arr))


def group_hits(tags, group, binary=False) -> Column:
    """How many distinct group tags a list holds, or 0/1.

    ``group`` is a list of tags or a Column -> Column test on one tag.
    """
    distinct = F.array_distinct(_col(tags))
    if callable(group) and not isinstance(group, Column):
        hits = F.size(F.filter(distinct, group))
    else:
        hits = F.size(F.filter(distinct, lambda t: t.isin(list(group))))
    return (hits > 0).cast("int") if binary else hits


def tag_rule(rules):
    """Test on one tag from group rules (see ``fixed.TAG_GROUPS``)."""
    def test(tag: Column) -> Column:
        found = F.lit(False)
        for rule in rules:
            holds = F.lit(True)
            for pattern in rule["all"]:
                holds = holds & tag.rlike(pattern)
            if "no" in rule:
                holds = holds & ~tag.rlike(rule["no"])
            found = found | holds
        return found
    return test


def append(arr, col) -> Column:
    return F.array_append(_col(arr), _col(col))


def pairs_of(arr) -> Column:
    """Neighbouring elements as ``struct(src, dst)``; empty below two elements.

    The lambda uses its own arguments only. A reference to the list inside it
    would be evaluated per element once a filter is pushed through.
    """
    a = _col(arr)
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n),
                      lambda x, y: F.struct(x.alias("src"), y.alias("dst")))


def flatten_rows(df: DataFrame, arr: str, out: str | None = None, pos: str | None = None) -> DataFrame:
    """One row per list element; ``pos`` keeps the position."""
    out = out or arr
    keep = [c for c in df.columns if c not in (arr, out, pos)]
    if pos is None:
        return df.select(*keep, F.explode(arr).alias(out))
    return df.select(*keep, F.posexplode(arr).alias(pos, out))


def adjacent_pairs(df: DataFrame, arr: str, src="src", dst="dst") -> DataFrame:
    """One row per neighbouring pair of each list."""
    keep = [c for c in df.columns if c != arr]
    long = df.where(F.size(arr) > 1).select(*keep, F.explode(pairs_of(arr)).alias("_pair"))
    return long.select(*keep, F.col("_pair.src").alias(src), F.col("_pair.dst").alias(dst))


def truncate_tokens(arr, n=fixed.TRUNCATE_TOKENS) -> Column:
    return F.slice(_col(arr), 1, n)


def chunk_tokens(df: DataFrame, tokens: str, size=fixed.CHUNK_SIZE, keep=fixed.CHUNK_KEEP,
                 cls=fixed.CLS_ID, sep=fixed.SEP_ID, pad=fixed.PAD_ID,
                 chunk_no="chunk_no", n_real="n_real") -> DataFrame:
    """Cut token lists into padded chunks, one row per kept chunk.

    A chunk holds ``size - 2`` tokens between two markers. It is kept when its
    real part reaches ``keep``; ``keep=1`` keeps all.
    """
    body = size - 2
    kind = df.schema[tokens].dataType.elementType
    t, n = F.col(tokens), F.size(tokens)
    # n div body slices only: a list is never expanded to all its positions
    starts = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / body), F.lit(0)).cast("int"))
    others = [c for c in df.columns if c != tokens]
    long = df.select(*others, F.posexplode(
        F.transform(starts, lambda i: F.slice(t, i * body + 1, body))).alias(chunk_no, "_body"))
    long = long.withColumn(n_real, F.size("_body") + 2)
    if keep < 1:
        long = long.where(F.col(n_real) / size >= keep)
    mark = lambda v: F.array(F.lit(v).cast(kind))
    filled = F.concat(mark(cls), F.col("_body"), mark(sep),
                      F.array_repeat(F.lit(pad).cast(kind), F.lit(size) - F.col(n_real)))
    return long.select(*others, chunk_no, n_real, filled.alias(tokens))


def argmax_col(names) -> Column:
    """Name of the largest column; the first wins a tie, nulls never win."""
    ranked = F.array(*[
        F.struct(F.col(n).cast("double").alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n"))
        for i, n in enumerate(names)])
    return F.array_max(F.filter(ranked, lambda s: s["v"].isNotNull()))["n"]


def argmax_label(arr, label="label", score="score") -> Column:
    """Label with the highest score in a list of ``{label, score}``; the first
    wins a tie."""
    ranked = F.transform(_col(arr), lambda s, i: F.struct(
        s[score].alias("v"), (-i).alias("i"), s[label].alias("n")))
    return F.array_max(F.filter(ranked, lambda s: s["v"].isNotNull()))["n"]
