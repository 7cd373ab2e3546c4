"""Projection, filters and conditional columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, keep=None, rename=None, drop=()) -> DataFrame:
    """Keep, rename and drop columns in one step."""
    out = df.select(*keep) if keep else df
    out = out.drop(*drop) if drop else out
    return out.withColumnsRenamed(rename) if rename else out


def where_eq(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def where_in(df: DataFrame, col, values, negate=False) -> DataFrame:
    """Membership filter. Negated, a null counts as not in the set."""
    col = F.col(col) if isinstance(col, str) else col
    member = F.coalesce(col.isin(list(values)), F.lit(False))
    return df.where(~member) if negate else df.where(col.isin(list(values)))


def where_date(df: DataFrame, col: str, lo=None, hi=None, lo_open=False, hi_open=False) -> DataFrame:
    """Date range with either end open, closed or absent."""
    c = F.col(col)
    kind = "date" if dict(df.dtypes)[col] == "date" else "timestamp"
    if kind == "timestamp" and dict(df.dtypes)[col] == "timestamp_ntz":
        kind = "timestamp_ntz"
    if lo is not None:
        bound = F.lit(lo).cast(kind)
        df = df.where(c > bound if lo_open else c >= bound)
    if hi is not None:
        bound = F.lit(hi).cast(kind)
        df = df.where(c < bound if hi_open else c <= bound)
    return df


def drop_sentinels(df: DataFrame, col: str, values) -> DataFrame:
    """Drop rows marked by an error value; nulls stay."""
    return where_in(df, col, values, negate=True)


def drop_nulls(df: DataFrame, cols) -> DataFrame:
    return df.dropna(subset=[cols] if isinstance(cols, str) else list(cols))


def where_positive(df: DataFrame, col) -> DataFrame:
    """Rows with a positive count, or a non-empty list."""
    if isinstance(col, str) and dict(df.dtypes)[col].startswith("array"):
        return df.where(F.size(col) > 0)
    return df.where((F.col(col) if isinstance(col, str) else col) > 0)


def flag_min(df: DataFrame, col: str, n, out="target_train") -> DataFrame:
    """True where the value reaches ``n``; null counts as False."""
    return df.withColumn(out, F.coalesce(F.col(col) >= n, F.lit(False)))


def near_extreme(df: DataFrame, col: str, ratio=0.99, side="max", nth=None, order=None) -> DataFrame:
    """Rows beyond ``ratio`` times the extreme; optionally only the n-th
    (from 1) of them in ``order``."""
    best = (F.max if side == "max" else F.min)(col).alias("_best")
    # the right side is a single row
    near = df.crossJoin(F.broadcast(df.agg(best)))
    limit = F.col("_best") * ratio
    near = near.where(F.col(col) > limit if side == "max" else F.col(col) < limit).drop("_best")
    if nth is None:
        return near
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return near.orderBy(*order).offset(nth - 1).limit(1)


def recode(df: DataFrame, col: str, mapping: dict, out: str | None = None, default="keep") -> DataFrame:
    """Replace values; unknown ones are kept, or set to ``default``."""
    chain = None
    for old, new in mapping.items():
        chain = (F.when if chain is None else chain.when)(F.col(col) == F.lit(old), F.lit(new))
    chain = chain.otherwise(F.col(col) if default == "keep" else F.lit(default))
    return df.withColumn(out or col, chain)


def assign_cases(df: DataFrame, out: str, cases, default=None) -> DataFrame:
    """First condition that holds gives the value."""
    chain = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = (F.when if chain is None else chain.when)(condition, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return df.withColumn(out, chain.otherwise(default))


def group_cases(col, groups: dict, form="{}"):
    """Cases for ``assign_cases`` from ``group -> members``."""
    col = F.col(col) if isinstance(col, str) else col
    return [(col.isin([form.format(m) for m in members]), name)
            for name, members in groups.items()]


def with_constants(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def with_rate(df: DataFrame, num, den, out: str) -> DataFrame:
    """``num / den``; null where the denominator is zero or null."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return df.withColumn(out, F.try_divide(num.cast("double"), den.cast("double")))


def coalesce_from(df: DataFrame, pairs: dict) -> DataFrame:
    """Fill each column from its fallback column, then drop the fallback."""
    filled = df.withColumns({c: F.coalesce(F.col(c), F.col(old)) for c, old in pairs.items()})
    return filled.drop(*pairs.values())


def expand_periods(df: DataFrame, date, periods: dict, out="period") -> DataFrame:
    """One row per named month set that holds the date; sets may overlap."""
    month = F.month(F.col(date) if isinstance(date, str) else date)
    named = F.array_compact(F.array(*[
        F.when(month.isin(list(months)), F.lit(name)) for name, months in periods.items()]))
    return df.withColumn(out, F.explode(named))


def fill_default(df: DataFrame, col, value) -> DataFrame:
    """Fill nulls, and blank text, with a default."""
    cols = [col] if isinstance(col, str) else list(col)
    kinds = dict(df.dtypes)
    return df.withColumns({
        c: F.when(F.col(c).isNull() | (F.trim(c) == ""), F.lit(value)).otherwise(F.col(c))
        if kinds[c] == "string" else F.coalesce(F.col(c), F.lit(value).cast(kinds[c]))
        for c in cols})
