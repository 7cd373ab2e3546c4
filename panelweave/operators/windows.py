"""Lags, spans, shares and bins within groups.

Lags and moving means run over panels that are unique on (entity, week), or on
(group, week), so a window group holds at most one row per week. Whole-group
statistics over unaggregated rows use an aggregate and a join instead of a
window; the join splits groups that the aggregate counted as large.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.joins import with_group
from panelweave.operators.spread import count_below, quantiles
from panelweave.operators.spread import number_rows as _number_rows


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def lag_diff(df, entity, time, lags: dict, diffs: dict = None, max_gap=None) -> DataFrame:
    """Previous observed value and first difference per entity.

    ``lags`` and ``diffs`` map source column to output column. The first row
    of an entity gets null. ``max_gap`` (days) also empties rows whose previous
    observation is further away.
    """
    w = Window.partitionBy(*_keys(entity)).orderBy(time)
    near = F.lit(True)
    if max_gap is not None:
        near = F.datediff(F.col(time), F.lag(time).over(w)) <= max_gap
    cols = {out: F.when(near, F.lag(c).over(w)) for c, out in lags.items()}
    cols |= {out: F.when(near, F.col(c) - F.lag(c).over(w)) for c, out in (diffs or {}).items()}
    return df.withColumns(cols)


def shift_in_group(df, entity, time, col, out) -> DataFrame:
    """Previous value per entity over distinct (entity, time, value) rows; the
    first row of an entity is dropped."""
    keys = _keys(entity)
    rows = df.select(*keys, time, col).distinct()
    w = Window.partitionBy(*keys).orderBy(time, col)
    return rows.withColumn(out, F.lag(col).over(w)).where(F.col(out).isNotNull())


def entity_span(df, entity, time, event=None, first="min_date", last="max_date",
                out="active_both") -> DataFrame:
    """First and last active week on each row, and whether the event date lies
    between them."""
    keys = _keys(entity)
    spans = with_group(df, keys, [F.min(time).alias(first), F.max(time).alias(last)])
    if event is None:
        return spans
    day = F.lit(event).cast("date")
    return spans.withColumn(out, (F.col(first) <= day) & (F.col(last) >= day))


def region_week_stats(df, keys, maxima=(), sums=(), means=()) -> DataFrame:
    """Weekly maximum, sum and mean per region; maps of source to output."""
    aggs = [F.max(c).alias(o) for c, o in dict(maxima).items()]
    aggs += [F.sum(c).alias(o) for c, o in dict(sums).items()]
    aggs += [F.avg(c).alias(o) for c, o in dict(means).items()]
    return df.groupBy(*_keys(keys)).agg(*aggs)


def share_of(df, group, value, out="share", total=None) -> DataFrame:
    """Value divided by the total of its group; ``total`` also keeps that."""
    keys = _keys(group)
    rows = with_group(df, keys, [F.sum(value).alias("_total")])
    rows = rows.withColumn(out, F.try_divide(F.col(value).cast("double"), F.col("_total").cast("double")))
    return rows.withColumnRenamed("_total", total) if total else rows.drop("_total")


def trailing_mean(df, group, time, value, out=None, n=3) -> DataFrame:
    """Mean of the row and the n-1 rows before it; null until n rows exist."""
    w = Window.partitionBy(*_keys(group)).orderBy(time).rowsBetween(-(n - 1), 0)
    return df.withColumn(out or value, F.when(
        F.count(F.lit(1)).over(w) == n, F.avg(value).over(w)))


def number_rows(df, group, order, out="row_number", **options) -> DataFrame:
    """1-based running number within each group, exact for any group size."""
    return _number_rows(df, _keys(group), order, out, **options)


def bin_number(col, cuts) -> Column:
    """1 + the number of cut points below the value; null stays null."""
    col, cuts = (F.col(col) if isinstance(col, str) else col), [c for c in cuts if c is not None]
    return F.when(col.isNotNull(), sum(((col > F.lit(float(c))).cast("int") for c in cuts), F.lit(1)))


def quantile_bin(df, col, n, out="bin", method="averaged") -> DataFrame:
    """Equal-frequency bins 1..n from exact cut points; equal values share a
    bin, and a value equal to a cut point belongs to the lower bin."""
    cuts = [c for c in quantiles(df, col, [i / n for i in range(1, n)], method) if c is not None]
    points = sorted(set(cuts))
    if not points or not all(map(math.isfinite, points)):
        return df.withColumn(out, bin_number(col, cuts))
    # equal cut points count as often as they occur
    upto = F.lit([1, *[1 + bisect_right(cuts, p) for p in points]])
    rows = count_below(df.withColumn("_value", F.col(col) if isinstance(col, str) else col), {"_value": points})
    return rows.withColumn(out, F.get(upto, F.col("_below__value"))).drop("_value", "_below__value")


def bin_means(df, bin_col, cols: dict) -> DataFrame:
    """Mean of each column per bin, on every row."""
    return with_group(df, bin_col, [F.avg(c).alias(o) for c, o in cols.items()])


def first_per_key(df, key, order) -> DataFrame:
    from panelweave.operators.aggregates import dedupe
    return dedupe(df, _keys(key), order)
