"""Wide/long reshaping and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.joins import HOT_KEY_ROWS, hot_keys, salted_join
from panelweave.operators.sets import union_ids
from panelweave.operators.spread import number_rows
from panelweave.session import settle


def one_hot(df, col, values, prefix="") -> DataFrame:
    """One 0/1 column per category value."""
    return df.withColumns({
        f"{prefix}{v}": F.when(F.col(col) == v, 1).otherwise(0) for v in values})


def to_long(df, ids, values, variable="variable", value="value") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def to_wide(df, index, col, values, value, agg=F.first) -> DataFrame:
    """One column per listed category."""
    index = [index] if isinstance(index, str) else list(index)
    return df.groupBy(*index).pivot(col, list(values)).agg(agg(value))


def transpose(df, index, columns, index_values, variable="variable") -> DataFrame:
    """Swap rows and columns of a small named matrix."""
    long = to_long(df, [index], columns, variable, "_v")
    return to_wide(long, variable, index, index_values, "_v")


def label_codes(*columns, label="label", code="code") -> DataFrame:
    """Alphabetical codes from 0 for all distinct labels of the columns."""
    labels = union_ids(*[c.toDF(label) for c in columns]).where(F.col(label).isNotNull())
    return number_rows(labels, [], [F.col(label)], code).withColumn(code, F.col(code) - 1)


def encode_labels(df, cols, codes=None, suffix="_enc") -> DataFrame:
    """Replace labels by alphabetical codes, shared by all columns."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    # one pass over all columns gives the labels and the hot ones
    counts = settle(df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("col"), F.col(c).alias("label")) for i, c in enumerate(cols)])).alias("_l"))
        .groupBy("_l.col", "_l.label").count())
    codes = settle(label_codes(counts.select("label")) if codes is None else codes)
    large = counts.where(F.col("count") > HOT_KEY_ROWS)
    with_hot = {r["col"] for r in large.select("col").distinct().collect()}
    for i, c in enumerate(cols):
        hot = hot_keys(large.where(F.col("col") == i).withColumnRenamed("label", c), [c]) if i in with_hot else None
        side = codes.toDF(c, f"{c}{suffix}")
        df = df.join(side, c, "left") if hot is None else salted_join(df, side, c, "left", hot=hot)
    return df
