"""Data-quality checks and key contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class QualityError(ValueError):
    pass


class KeyContractError(ValueError):
    pass


def quality_report(df: DataFrame, rules: dict) -> DataFrame:
    """One row: the row count and, per rule, how many rows break it.

    A rule is a boolean Column that must hold; null counts as a breach.
    """
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name)
          for name, rule in rules.items()])


def assert_quality(df: DataFrame, rules: dict, n_rows=None) -> DataFrame:
    """Raise if a rule is broken or the row count differs; return the report."""
    report = quality_report(df, rules)
    row = report.first().asDict()
    broken = {k: v for k, v in row.items() if k != "n_rows" and v}
    if n_rows is not None and row["n_rows"] != n_rows:
        broken["n_rows"] = row["n_rows"]
    if broken:
        raise QualityError(f"broken rules: {broken}")
    return report


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once, with their count."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).count().where("count > 1")


def assert_unique(df: DataFrame, keys) -> DataFrame:
    """Raise if the keys are not unique; return the frame."""
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise KeyContractError(f"duplicate key {found[0].asDict()}")
    return df
