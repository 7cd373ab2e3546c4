"""Joins: entity-week and attribute joins, contracts, list lookups, ranges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.quality import assert_unique
from panelweave.operators.spread import HOT_ROWS, fits
from panelweave.session import settle

# Keys with more rows than this are split over several tasks.
HOT_KEY_ROWS = 500_000
# The list of such keys is broadcast up to this size; it has at most
# rows / HOT_KEY_ROWS entries.
HOT_LIST_BYTES = 64 << 20


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def join_entity_week(df, agg, keys=("week_start", "entity"), hot_rows=HOT_KEY_ROWS) -> DataFrame:
    """Attach weekly aggregates; ``agg`` is unique on the keys and stored first.
    Few bytes are broadcast; else an entity-week with very many rows is split
    over several tasks."""
    agg = settle(agg)
    if fits(agg):
        return df.join(F.broadcast(agg), _keys(keys), "left")
    return salted_join(df, agg, keys, "left", hot_rows)


def join_attrs(df, attrs, key, order=None) -> DataFrame:
    """Attach entity attributes, reduced to the first row per entity."""
    from panelweave.operators.aggregates import dedupe
    keys = _keys(key)
    rest = [c for c in attrs.columns if c not in keys]
    return df.join(dedupe(attrs, keys, order or rest), keys, "left")


def join_dim(df, dim, keys) -> DataFrame:
    """Left join with a dimension. Spark broadcasts it by its estimated bytes, or
    by its bytes as measured while the query runs."""
    return df.join(dim, _keys(keys), "left")


def join_inner(left, right, keys, validate=None) -> DataFrame:
    return checked_join(left, right, keys, "inner", validate)


def join_outer_indicator(left, right, keys, out="_merge") -> DataFrame:
    """Full outer join with ``both`` / ``left_only`` / ``right_only``."""
    joined = left.withColumn("_in_l", F.lit(True)).join(
        right.withColumn("_in_r", F.lit(True)), _keys(keys), "full_outer")
    mark = (F.when(F.col("_in_l").isNull(), "right_only")
            .when(F.col("_in_r").isNull(), "left_only").otherwise("both"))
    return joined.withColumn(out, mark).drop("_in_l", "_in_r")


def keep_present(df, ids, key) -> DataFrame:
    """Rows whose key occurs in the other table."""
    keys = _keys(key)
    return df.join(ids.select(*keys), keys, "left_semi")


def pending(df, done, key) -> DataFrame:
    """Rows whose key is not in the done table."""
    keys = _keys(key)
    return df.join(done.select(*keys), keys, "left_anti")


def checked_join(left, right, on, how="inner", validate=None) -> DataFrame:
    """Join with a cardinality contract: ``1:1``, ``m:1``, ``1:m`` or none."""
    keys = _keys(on)
    if validate not in (None, "1:1", "m:1", "1:m", "m:m"):
        raise ValueError(f"unknown contract {validate}")
    if validate in ("1:1", "1:m"):
        assert_unique(left, keys)
    if validate in ("1:1", "m:1"):
        assert_unique(right, keys)
    return left.join(right, keys, how)


def hot_keys(counts, keys, hot_rows=HOT_KEY_ROWS):
    """Stored (keys, _shares) of the keys above ``hot_rows`` in a table of key
    counts (``count``), or None if there are none."""
    hot = settle(counts.where(F.col("count") > hot_rows).select(
        *keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_shares")))
    return None if hot.isEmpty() else hot


def _fitting(hot, keys):
    """The list of hot keys, marked for broadcast if its bytes are few."""
    size = hot.agg(F.sum(sum((F.octet_length(F.col(k).cast("string")) for k in keys), F.lit(16)))).first()[0]
    return F.broadcast(hot) if size <= HOT_LIST_BYTES else hot


def salted_join(big, side, on, how="inner", hot_rows=HOT_KEY_ROWS, spread_by=None, hot="count") -> DataFrame:
    """Equi-join that splits hot keys of ``big`` over several tasks.

    A count by key finds the keys above ``hot_rows``, all of them (``hot`` hands
    over what ``hot_keys`` found before). Without any, this is a plain join.
    Else the rows of a hot key are dealt over numbered shares by the hash of
    ``spread_by`` (all columns by default) and the matching rows of ``side`` are
    copied once per share. Only ``inner``, ``left``, ``left_semi`` and
    ``left_anti`` make sense. ``big`` is read twice, so store it first where it
    is costly to compute.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot split a {how} join")
    keys = _keys(on)
    hot = hot_keys(big.groupBy(*keys).count(), keys, hot_rows) if isinstance(hot, str) else hot
    return _split_join(big, side, keys, how, hot, spread_by)


def _split_join(big, side, keys, how, hot, spread_by=None) -> DataFrame:
    if hot is None:
        return big.join(side, keys, how)
    hot = _fitting(hot, keys)
    spread = [F.col(c) for c in (spread_by or [c for c in big.columns])]
    dealt = (
        big.join(hot, keys, "left")
        .withColumn("_share", F.when(
            F.col("_shares").isNotNull(),
            F.pmod(F.xxhash64(*spread), F.col("_shares").cast("bigint")).cast("int")
        ).otherwise(0)).drop("_shares"))
    copied = (
        side.join(hot, keys, "left")
        .withColumn("_share", F.explode(
            F.sequence(F.lit(0), F.coalesce(F.col("_shares"), F.lit(1)) - 1)))
        .drop("_shares"))
    return dealt.join(copied, [*keys, "_share"], how).drop("_share")


def with_group(df, keys, aggs, how="left", hot_rows=HOT_KEY_ROWS) -> DataFrame:
    """Attach group aggregates to every row. The aggregate also counts its rows,
    so that hot groups are known and split without another pass."""
    keys = _keys(keys)
    stored = settle(df.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("count")))
    return _split_join(df, stored.drop("count"), keys, how, hot_keys(stored, keys, hot_rows))


def lookup_long(df, col, table, key, value, out=None, hot_rows=HOT_KEY_ROWS) -> DataFrame:
    """Look one column up in a key-unique table of any size; misses and null
    values are dropped. Hot keys are split."""
    pairs = table.where(F.col(value).isNotNull()).select(
        F.col(key).alias(col), F.col(value).alias(out or value))
    return salted_join(df, pairs, col, "inner", hot_rows)


def lookup_list(df, arr, table, key, value, out, row_id, keep_key=None, hot_rows=HOT_KEY_ROWS) -> DataFrame:
    """Replace each list by the values its elements have in ``table``.

    Elements without a value are dropped, order is kept, and a row without any
    hit keeps an empty list. ``keep_key`` also keeps the elements found. The
    exploded lists are stored once. Prefer ``lookup_long`` where no list is
    needed. The regrouped lists are no longer than the input lists.
    """
    ids = _keys(row_id)
    long = settle(df.select(*ids, F.posexplode(arr).alias("_pos", "_key")).where(F.col("_key").isNotNull()))
    hits = lookup_long(long, "_key", table, key, value, "_val", hot_rows)
    found = F.sort_array(F.collect_list(F.struct("_pos", "_val", "_key")))
    cols = [F.transform(found, lambda s: s["_val"]).alias(out)]
    if keep_key:
        cols.append(F.transform(found, lambda s: s["_key"]).alias(keep_key))
    lists = hits.groupBy(*ids).agg(*cols)
    empty = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in lists.schema if f.name not in ids}
    return df.drop(*empty).join(lists, ids, "left").withColumns(empty)


def lookup_dim(df, arr, dim, key, value, out, row_id, keep_key=None) -> DataFrame:
    """Scores of the listed keys in a key-unique table of any size, in list
    order; ``keep_key`` also keeps the keys found."""
    return lookup_list(df, arr, dim, key, value, out, row_id, keep_key)


# Interval starts are broadcast up to this many, and searched by halving.
FEW_INTERVALS = 100_000
# Types whose values are exact as doubles.
_EXACT = ("date", "timestamp", "timestamp_ntz", "tinyint", "smallint", "int", "float", "double")


def _number(col, kind):
    col = F.col(col)
    if kind == "date":
        return F.unix_date(col).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    return col.cast("double")


def range_join(df, bounds, col, lb="lb", ub="ub", how="left", few=FEW_INTERVALS) -> DataFrame:
    """Attach the interval that holds the value, both ends closed.

    Intervals are disjoint, of any number and any widths; where two touch, the
    later one takes the value. A value can only lie in the last interval that
    starts at or before it, so this is a sorted as-of join, and the work is rows
    plus intervals however the intervals lie. Up to ``few`` starts are counted
    and then broadcast; more go through ``carry_forward``. ``how`` is ``left``
    or ``inner``. Null values, and NaN, lie in no interval; an interval without
    a start holds nothing.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"cannot look intervals up in a {how} join")
    kinds, wanted = dict(bounds.dtypes), dict(df.dtypes)[col]
    bounds = settle(bounds.where(F.col(lb).isNotNull()))
    cols = [F.col(f"_b.{c}").alias(c) for c in bounds.columns]
    payload = bounds.select(F.col(lb).alias("_at"), F.struct(*[F.col(f"`{c}`") for c in bounds.columns]).alias("_b"))
    # a timestamp with a zone and one without, say, are left to Spark's own widening
    exact = wanted in _EXACT and kinds[lb] in _EXACT and (wanted == kinds[lb] or not {"date", "timestamp", "timestamp_ntz"} & {wanted, kinds[lb]})
    if exact and bounds.count() <= few:
        met = _by_halving(df, payload, col, wanted, kinds[lb])
    else:
        met = carry_forward(df, payload, col)
    inside = F.coalesce(F.col(col).between(F.col(f"_b.{lb}"), F.col(f"_b.{ub}")), F.lit(False))
    if how == "inner":
        return met.where(inside).select(*[F.col(f"`{c}`") for c in df.columns], *cols)
    found = met.withColumn("_b", F.when(inside, F.col("_b")))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], *cols)


def _by_halving(df, payload, col, kind, start_kind) -> DataFrame:
    """Add ``_b``, the payload of the last start at or before the value, for
    starts that the driver can hold: the place among them joins a broadcast."""
    from pyspark.ml.feature import Bucketizer

    numbered = payload.select(_number("_at", start_kind).alias("_n"), "_b").where(~F.isnan("_n"))
    starts = sorted({r["_n"] for r in numbered.select("_n").collect()})
    splits = [-math.inf, *[x for x in starts if not math.isinf(x)], math.inf]
    rows = df.withColumn("_x", _number(col, kind))
    if len(splits) < 3 or len(splits) - 1 != len(starts) + 1:
        return carry_forward(df, payload, col)
    cut = Bucketizer(splits=splits, inputCol="_x", outputCol="_place", handleInvalid="keep")
    table = cut.transform(numbered.withColumnRenamed("_n", "_x")).select("_place", "_b")
    table = table.groupBy("_place").agg(F.first("_b").alias("_b"))
    return cut.transform(rows).join(F.broadcast(table), "_place", "left").drop("_x", "_place")


def carry_forward(df, payload, col, parts=None) -> DataFrame:
    """Add ``_b``, the payload of the last start at or before the value.

    ``payload`` has (``_at``, ``_b``). Rows and starts are placed together by
    range of value, starts first, and stored; inside a slice the last start is
    carried forward, and one row per slice hands it on. Rows of one hot value
    are placed by their hash, so they span several slices.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(least, math.ceil(df.count() / HOT_ROWS))
    hashed = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t]
    rows = df.select(F.col(f"`{col}`").alias("_at"), F.lit(1).alias("_kind"), F.xxhash64(*hashed).alias("_salt"),
                     F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_r"))
    starts = payload.select("_at", F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_salt"), "_b")
    both = rows.unionByName(starts, allowMissingColumns=True)
    order = [F.asc_nulls_first("_at"), F.col("_kind"), F.col("_salt")]
    placed = settle(both.repartitionByRange(parts, *order).withColumn("_slice", F.spark_partition_id()))
    upto = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # at most one row per slice
    last = placed.where("_kind = 0").groupBy("_slice").agg(F.max_by("_b", "_at").alias("_b"))
    slices = placed.select("_slice").distinct().join(last, "_slice", "left")
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = slices.select("_slice", F.last("_b", ignorenulls=True).over(earlier).alias("_handed"))
    carried = placed.withColumn("_b", F.last("_b", ignorenulls=True).over(upto)).where("_kind = 1")
    return (carried.join(handed, "_slice").withColumn("_b", F.coalesce("_b", "_handed"))
            .select("_r.*", "_b"))


def balance_panel(df, group, time, fill=0) -> DataFrame:
    """All (group, observed time) pairs; absent cells get ``fill``.

    Both lists are distinct values, and their product is the size of the
    result by definition.
    """
    groups, times = df.select(group).distinct(), df.select(time).distinct()
    rest = {c: t for c, t in df.dtypes if c not in (group, time)}
    out = groups.crossJoin(times).join(df, [group, time], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(fill).cast(t)) for c, t in rest.items()})


def attach_by_id(left, right, id_col, how="full_outer") -> DataFrame:
    """Put two tables side by side on a shared id, never by position."""
    return left.join(right, _keys(id_col), how)


def merge_dicts(new, old, key, prefer="old") -> DataFrame:
    """Union of two key-value tables; on a shared key the preferred side wins.

    Each side is taken as key-unique.
    """
    first, second = (old, new) if prefer == "old" else (new, old)
    keys = _keys(key)
    extra = second.join(first.select(*keys), keys, "left_anti")
    return first.unionByName(extra.select(*first.columns))


def merge_batches(df, key, batch) -> DataFrame:
    """Within one run, the row of the latest batch wins for each key."""
    keys = _keys(key)
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(batch)).alias("_r"))
            .select(*keys, "_r.*"))
