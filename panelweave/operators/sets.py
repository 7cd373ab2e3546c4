"""Set operations on tables and lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(*dfs) -> DataFrame:
    """Bag union by name; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_ids(*dfs) -> DataFrame:
    return reduce(lambda a, b: a.union(b), dfs).distinct()


def minus(a, b) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)


def overlaps(a, b) -> Column:
    """True when two lists share an element."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.arrays_overlap(a, b)


def common(a, b) -> DataFrame:
    """Distinct rows present in both tables."""
    return a.intersect(b)


def split_by(df, cond: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet a condition, and all others (null counts as not met)."""
    met = F.coalesce(cond, F.lit(False))
    return df.where(met), df.where(~met)
