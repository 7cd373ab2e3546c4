"""Sorts, top-k and arg-best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.bins import ordinal


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def sort_panel(df, entity, time) -> DataFrame:
    return df.orderBy(*_keys(entity), time)


def _limited(df, keys, order, n, rank) -> DataFrame:
    # row_number() <= n is applied per input partition before the shuffle
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def top_terms(df, topic, term, weight, k, rank="rank") -> DataFrame:
    """The k heaviest terms per topic; the alphabet breaks ties."""
    return _limited(df, _keys(topic), [F.desc(weight), F.col(term)], k, rank)


def order_categories(df, col, order, out="order", tie=None) -> DataFrame:
    """Sort by an explicit category order; unknown ones come last. Rows of one
    category stand by ``tie`` (a hash of the row by default), so that a category
    with most of the rows is still sorted by many tasks."""
    place = df.withColumn(out, ordinal(col, order))
    ties = [F.xxhash64(*df.columns)] if tie is None else _keys(tie)
    return place.orderBy(F.col(out).asc_nulls_last(), col, *ties)


def arg_best(df, metric, how="max", tie=()) -> DataFrame:
    """The row with the best metric; ``tie`` columns say which is first."""
    best = F.col(metric).desc_nulls_last() if how == "max" else F.col(metric).asc_nulls_last()
    return df.orderBy(best, *_keys(tie)).limit(1)


def head(df, n, order) -> DataFrame:
    return df.orderBy(*_keys(order)).limit(n)


def limit_per_group(df, key, order, n, rank="rank") -> DataFrame:
    """The first n rows per key in ``order``."""
    order = [F.col(c) if isinstance(c, str) else c for c in _keys(order)]
    return _limited(df, _keys(key), order, n, rank)
