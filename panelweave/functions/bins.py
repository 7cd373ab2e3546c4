"""Numeric bins and transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave import fixed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut_right(col, edges=fixed.TRAIN_EDGES, labels=fixed.BIN_LABELS) -> Column:
    """Label of the right-closed interval holding the value; null outside."""
    x = _col(col)
    out = F.when(x.isNull() | F.isnan(x) | (x <= edges[0]), F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        out = out.when(x <= upper, label)
    return out


def leaning(col) -> Column:
    """Three-way right-closed cut."""
    return cut_right(col, fixed.LEANING_EDGES, fixed.LEANING_LABELS)


def score_bin(col, limits=fixed.SCORE_LIMITS, labels=fixed.BIN_LABELS) -> Column:
    """Five-way bin, open to the left of the centre and closed to the right;
    a missing score falls in the last bin."""
    x = _col(col)
    low, mid_low, mid_high, high = limits
    return (
        F.when(x < low, labels[0]).when(x < mid_low, labels[1])
        .when((x <= mid_high) & ~F.isnan(x), labels[2])
        .when((x <= high) & ~F.isnan(x), labels[3]).otherwise(labels[4])
    )


def ordinal(col, order) -> Column:
    """Position of a category in an explicit order, from 0; null if unknown."""
    x = _col(col)
    out = None
    for i, value in enumerate(order):
        out = F.when(x == value, i) if out is None else out.when(x == value, i)
    return out


def round_to(col, digits) -> Column:
    return F.round(_col(col), digits)


def powers(col, degree) -> list[Column]:
    """The value to the powers 2..degree."""
    x = _col(col)
    return [F.pow(x, F.lit(float(k))) for k in range(2, degree + 1)]


def ci_band(b, se, z=1.96) -> tuple[Column, Column]:
    """Lower and upper bound ``b -/+ z * se``."""
    return _col(b) - z * _col(se), _col(b) + z * _col(se)
