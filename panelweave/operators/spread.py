"""Ordered work that never puts a whole group, or a whole table, in one task.

A plain window sends each group to one task. That is fine while every group
is proven small; a group holding a large share of the rows needs another way:

* ``running_total`` / ``number_rows`` place rows by range of (group, order), so
  that a large group spans many slices, total each slice and add what lies
  before it.
* ``order_values`` finds exact order statistics from slice counts and reads
  only the slices that hold a wanted rank.
* ``average_ranks`` ranks distinct values by a running total of their counts.
* ``hash_quota`` gives exact per-stratum quotas from counts of hash slices.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.session import settle

# A stored side is broadcast only up to this many bytes, measured first.
BROADCAST_BYTES = 32 << 20
# A group up to this many rows is sorted in one task.
HOT_ROWS = 1_000_000
# Rows that a slice is meant to hold, and most slices cut in one pass; a slice
# that is still too large is cut again.
SLICE_ROWS = 100_000
MOST_SLICES = 2_000


def _cols(cols):
    cols = [cols] if isinstance(cols, (str, Column)) else list(cols)
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def null_safe(left: str, right: str, keys) -> Column:
    """Equality of all keys between two aliases; null equals null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def fits(stored: DataFrame) -> bool:
    """Whether a stored table's rows take few enough bytes to broadcast."""
    size = F.lit(16).cast("bigint")
    for f in stored.schema.fields:
        size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) + 8
    return (stored.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def slice_count(n: int) -> int:
    return max(1, min(MOST_SLICES, math.ceil(n / SLICE_ROWS)))


def split_hot(df: DataFrame, keys, limit: int, size: Column | None = None, most: int = 0):
    """Rows of groups up to ``limit`` rows, and rows of larger groups (None if
    there are none). One count over the key columns finds the larger groups;
    there are at most rows / ``limit`` of them. Where ``size`` is given, groups
    whose sizes add up to more than ``most`` are large as well."""
    large = F.count(F.lit(1)) > limit
    if size is not None:
        large = large | (F.sum(size) > most)
    hot = settle(df.groupBy(*keys).agg(F.coalesce(large, F.lit(False)).alias("_large")).where("_large").select(*keys))
    if hot.isEmpty():
        return df, None
    side = (F.broadcast(hot) if fits(hot) else hot).alias("r")
    match = null_safe("l", "r", keys)
    rows = df.alias("l")
    return rows.join(side, match, "left_anti"), rows.join(side, match, "left_semi")


def running_total(df: DataFrame, keys, order, value, out, parts: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` inside each group, in ``order``.

    Rows are range-placed by (keys, order) and stored, so that both passes see
    the same slices. ``order`` must be unique within a group. ``value`` and
    ``out`` may be lists of the same length.
    """
    outs, values = ([out], [value]) if isinstance(out, str) else (list(out), list(value))
    keys, order = list(keys), _cols(order)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(least, math.ceil(df.count() / HOT_ROWS))
    sums = {f"_v{i}": F.col(v) if isinstance(v, str) else v for i, v in enumerate(values)}
    placed = df.withColumns(sums)
    if keys:
        placed = placed.withColumn("_k", F.struct(*keys))
    else:
        placed = placed.withColumn("_k", F.struct(F.lit(0).alias("one")))
    placed = settle(
        placed.repartitionByRange(parts, F.col("_k"), *order)
        .withColumn("_slice", F.spark_partition_id()))
    # at most one row per (group, slice)
    totals = placed.groupBy("_k", "_slice").agg(*[F.sum(v).alias(f"_t{v}") for v in sums])
    earlier = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_k", "_slice", *[F.coalesce(F.sum(f"_t{v}").over(earlier), F.lit(0)).alias(f"_before{v}") for v in sums])
    within = (Window.partitionBy("_k", "_slice").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.withColumns({o: F.sum(v).over(within) for o, v in zip(outs, sums)})
        .join(before, ["_k", "_slice"])
        .withColumns({o: F.col(o) + F.col(f"_before{v}") for o, v in zip(outs, sums)})
        .drop("_k", "_slice", *sums, *[f"_before{v}" for v in sums]))


def number_rows(df: DataFrame, keys, order, out="row_number", hot_rows=HOT_ROWS) -> DataFrame:
    """Exact 1-based row number inside each group.

    Groups up to ``hot_rows`` rows use a window; rows of larger groups go
    through ``running_total``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if keys:
        plain, hot = split_hot(df, keys, hot_rows)
    else:
        plain, hot = (df, None) if df.count() <= hot_rows else (None, df)
    parts = []
    if plain is not None:
        window = Window.partitionBy(*keys).orderBy(*_cols(order))
        parts.append(plain.withColumn(out, F.row_number().over(window).cast("bigint")))
    if hot is not None:
        parts.append(running_total(hot, keys, order, F.lit(1).cast("bigint"), out))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# Cut points taken in the first pass over the columns.
FIRST_CUTS = 64


def count_below(df: DataFrame, cuts: dict[str, list[float]], prefix="_below_") -> DataFrame:
    """Add for each numeric column the number of its cut points below the value,
    searched by halving. ``cuts`` maps columns to ascending, distinct, finite
    numbers. NaN lies above all of them; null is left null."""
    known = {c: points for c, points in cuts.items() if points}
    # intervals of the bucketizer are closed to the left, those here to the right: signs turn
    rows = df.withColumns({f"_turned_{c}": F.lit(0.0) - F.col(f"`{c}`").cast("double") for c in known})
    if known:
        rows = Bucketizer(
            splitsArray=[[-math.inf, *[0.0 - p for p in reversed(points)], math.inf] for points in known.values()],
            inputCols=[f"_turned_{c}" for c in known], outputCols=[f"_at_{c}" for c in known], handleInvalid="keep").transform(rows)
    made = {}
    for c, points in cuts.items():
        value = (F.when(F.isnan(F.col(f"`_turned_{c}`")), len(points)).otherwise(F.lit(len(points)) - F.col(f"`_at_{c}`").cast("int"))
                 if points else F.lit(0))
        made[prefix + c] = F.when(F.col(f"`{c}`").isNotNull(), value)
    return rows.withColumns(made).drop(*[f"{p}{c}" for c in known for p in ("_turned_", "_at_")])


def _finite(cuts) -> list[float]:
    return sorted({float(c) for c in cuts or [] if c is not None and not math.isinf(c)})


def _cells(x: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """(name, b, x) of all columns in long form, b the slice of the value."""
    cells = [F.struct(F.lit(c).alias("name"), F.col(f"_below_{c}").alias("b"), F.col(c).alias("x")) for c in cuts]
    return count_below(x, cuts).select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("x").isNotNull())


def _literal(spark, names, rows) -> DataFrame:
    """A few rows as a table; they are part of the plan."""
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def _slice_counts(x: DataFrame, sizes: dict[str, int], cuts: dict[str, list[float]]) -> dict[str, dict[int, int]]:
    """{column: {slice: rows}}; at most (columns) x (cuts + 1) rows reach the driver."""
    counts: dict = {c: {} if points else {0: sizes[c]} for c, points in cuts.items()}
    if any(cuts.values()):
        for r in _cells(x, {c: points for c, points in cuts.items() if points}).groupBy("name", "b").count().collect():
            counts[r["name"]][r["b"]] = r["count"]
    return counts


def _held(counts: dict[int, int], ranks: list[int]):
    """(slice, rows, rows before it, ranks in it) of the slices that hold a rank."""
    before = 0
    for b, count in sorted(counts.items()):
        inside = [r for r in ranks if before < r <= before + count]
        if inside:
            yield b, count, before, inside
        before += count


def _inside(held: DataFrame, spots: dict[str, set], counts) -> DataFrame:
    keep = F.lit(False)
    for c, some in spots.items():
        mine = F.col("name") == c
        keep = keep | (mine & F.col("b").isin(sorted(some)) if len(some) < len(counts[c]) else mine)
    return held.where(keep)


def _ranked(x: DataFrame, sizes: dict[str, int], cuts: dict[str, list[float]], wanted: dict[str, list[int]], slices) -> dict[str, dict[int, float]]:
    """{column: {rank: value}}. One count over the slices of all columns, and
    one job for the slices that hold a wanted rank; slices that hold far more
    rows than meant are cut again first, those of all columns in one job."""
    cuts = {c: cuts[c] for c in wanted}
    counts = _slice_counts(x, sizes, cuts)
    deep: dict = {}
    if slices is None:
        for c, ranks in wanted.items():
            large = {b: count for b, count, _, _ in _held(counts[c], ranks) if SLICE_ROWS * 4 < count < sizes[c]}
            if large:
                deep[c] = large
    if deep:
        many = slice_count(max(n for large in deep.values() for n in large.values()))
        probs = [i / many for i in range(1, many)]
        found = _inside(_cells(x, {c: cuts[c] for c in deep}), {c: set(large) for c, large in deep.items()}, counts).groupBy(
            "name", "b").agg(F.percentile_approx("x", probs, 20 * many).alias("q")).collect()
        finer = {c: _finite([*cuts[c], *[q for r in found if r["name"] == c for q in r["q"]]]) for c in deep}
        counts |= _slice_counts(x, sizes, finer)
        cuts |= finer
    need, spots = [], {}
    for c, ranks in wanted.items():
        for b, _, before, inside in _held(counts[c], ranks):
            spots.setdefault(c, set()).add(b)
            need += [(c, b, r, r - before) for r in inside]
    out: dict = {c: {} for c in wanted}
    if need:
        held = _inside(_cells(x, {c: cuts[c] for c in spots}), spots, counts).groupBy("name", "b", "x").count()
        upto = F.sum("count").over(Window.partitionBy("name", "b").orderBy("x"))
        held = held.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("count"))
        # one row per wanted rank
        targets = F.broadcast(_literal(x.sparkSession, ["name", "b", "rank", "local"], need))
        hits = held.join(targets, ["name", "b"]).where((F.col("lo") < F.col("local")) & (F.col("local") <= F.col("hi")))
        for r in hits.select("name", "rank", "x").collect():
            out[r["name"]][r["rank"]] = r["x"]
    return out


def order_values_many(df: DataFrame, wanted: dict, slices=None) -> dict[str, tuple[int, dict[int, float]]]:
    """Exact order statistics of many columns, nulls and NaN left out.

    ``wanted`` maps a name to a column and a function from its number of values
    to the 1-based ranks to fetch. Rows are read three times whatever the number
    of columns (sizes and cut points, slice counts, wanted slices), and once more
    where slices are cut again, so store a costly input first. Only slice counts
    and the wanted values reach the driver; rows are shuffled only for slices
    that hold a wanted rank, after equal values are merged. Returns
    ``{name: (n, {rank: value})}``.
    """
    names = {f"x{i}": name for i, name in enumerate(wanted)}

    def value(c):
        x = (F.col(c) if isinstance(c, str) else c).cast("double")
        return F.when(~F.isnan(x), x)

    x = df.select(*[value(wanted[name][0]).alias(c) for c, name in names.items()])
    many = slices or FIRST_CUTS
    probs = [i / many for i in range(1, many)]
    row = x.agg(*[F.count(c).alias(f"n{c}") for c in names],
                *([F.percentile_approx(c, probs, 20 * many).alias(f"q{c}") for c in names] if probs else [])).first()
    sizes = {c: row[f"n{c}"] for c in names}
    ranks = {c: sorted({r for r in wanted[name][1](sizes[c]) if 1 <= r <= sizes[c]}) for c, name in names.items()}
    # a column that fits one slice needs no cutting
    cuts = {c: _finite(row[f"q{c}"]) if probs and (slices or sizes[c] > SLICE_ROWS * 4) else [] for c in names}
    found = _ranked(x, sizes, cuts, {c: r for c, r in ranks.items() if r}, slices) if any(ranks.values()) else {}
    return {name: (sizes[c], found.get(c, {})) for c, name in names.items()}


def order_values(df: DataFrame, col, wanted, slices=None) -> tuple[int, dict[int, float]]:
    """``order_values_many`` for one column: ``(n, {rank: value})``."""
    return order_values_many(df, {"x": (col, wanted)}, slices)["x"]


def _spots(n: int, probs, method):
    for p in probs:
        if method == "linear":
            h = (n - 1) * p
            low = math.floor(h + 1e-9)
            yield low + 1, min(low + 2, n), max(h - low, 0.0)
        else:
            h = n * p
            near = round(h)
            if abs(h - near) < 1e-9:
                yield max(near, 1), min(near + 1, n), 0.5 if 0 < near < n else 0.0
            else:
                yield math.ceil(h), math.ceil(h), 0.0


def quantiles_many(df: DataFrame, wanted: dict, method="linear", slices=None) -> dict[str, list[float]]:
    """Exact quantiles of many columns: ``wanted`` maps a name to a column and
    its probabilities. ``linear`` interpolates between neighbours; ``averaged``
    takes the next value, or the mean of two at a whole position (the rule of
    the statistics package behind the validation curves)."""
    def ranks(probs):
        return lambda n: [r for a, b, _ in _spots(n, probs, method) for r in (a, b)]

    found = order_values_many(df, {name: (c, ranks(probs)) for name, (c, probs) in wanted.items()}, slices)
    out = {}
    for name, (_, probs) in wanted.items():
        n, value = found[name]
        out[name] = [value[a] + (value[b] - value[a]) * w if w else value[a] for a, b, w in _spots(n, probs, method)] if n else [None for _ in probs]
    return out


def quantiles(df: DataFrame, col, probs, method="linear", slices=None) -> list[float]:
    """``quantiles_many`` for one column."""
    return quantiles_many(df, {"x": (col, probs)}, method, slices)["x"]


def average_ranks(df: DataFrame, col, value="value", rank="rank", keys=(), weight=None) -> DataFrame:
    """One row per distinct value with its average rank over all rows (of its
    group by ``keys``). ``weight`` counts a row several times.

    Equal values are merged first; the running count of more than HOT_ROWS
    distinct values is range-placed, so neither a long column nor a hot value
    meets in one task.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    col = F.col(col) if isinstance(col, str) else col
    x = df.select(*keys, col.cast("double").alias("x"), (F.col(weight) if weight else F.lit(1)).alias("w"))
    merged = x.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy(*keys, "x").agg(F.sum("w").cast("bigint").alias("count"))
    merged = settle(merged)
    if merged.count() <= HOT_ROWS:
        placed = merged.withColumn("upto", F.sum("count").over(Window.partitionBy(*keys).orderBy("x")))
    else:
        placed = running_total(merged, keys, ["x"], "count", "upto")
    return placed.select(*keys, F.col("x").alias(value), (F.col("upto") - F.col("count") + (F.col("count") + 1) / 2).alias(rank))


def stable_hash(*cols, seed=0) -> Column:
    """32-bit number from the text form of the columns; the same in any engine
    that has md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in _cols(cols)])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_quota(df: DataFrame, strata, key, cuts, out: str, seed=0, slices=None) -> DataFrame:
    """Label rows by exact position in the hash order of their stratum.

    ``cuts`` maps a size Column to a list of ``(label, size Column)``; labels
    are dealt in that order and the last one takes the rest. Positions come
    from counts per (stratum, hash slice); only slices that hold a limit are
    shuffled and sorted, each about 1/``slices`` of a stratum; the number of
    slices follows from the largest stratum.
    """
    strata = [strata] if isinstance(strata, str) else list(strata)
    if slices is None:
        largest = df.groupBy(*strata).count().agg(F.max("count")).first()[0] or 1
        slices = 1 << max(0, math.ceil(math.log2(max(1, largest / SLICE_ROWS))))
    h = stable_hash(*_cols(key), seed=seed)
    base = df.withColumn("_h", h).withColumn("_s", F.floor(F.col("_h") * slices / F.lit(2 ** 32)))
    # at most (number of strata) x slices rows, read by both branches
    counts = base.groupBy(*strata, "_s").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(*strata).orderBy("_s")
    marks = (counts.withColumn("_hi", F.sum("_c").over(run))
             .withColumn("_lo", F.col("_hi") - F.col("_c"))
             .withColumn("_n", F.sum("_c").over(Window.partitionBy(*strata))))
    labels = cuts(F.col("_n"))
    ends, total = [], F.lit(0)
    for label, size in labels[:-1]:
        total = total + size
        ends.append((label, total))
    last = labels[-1][0]

    def label_at(position: Column) -> Column:
        chain = None
        for label, end in ends:
            chain = (F.when if chain is None else chain.when)(position <= end, label)
        return F.lit(last) if chain is None else chain.otherwise(last)

    marks = marks.withColumn("_first", label_at(F.col("_lo") + 1)).withColumn("_last", label_at(F.col("_hi")))
    marks = settle(marks)
    if fits(marks):
        marks = F.broadcast(marks)
    tagged = base.alias("l").join(marks.alias("r"), null_safe("l", "r", [*strata, "_s"])).select(
        "l.*", "r._lo", "r._first", "r._last",
        *[(F.lit(0) + e).alias(f"_e{i}") for i, (_, e) in enumerate(ends)])
    whole = tagged.where(F.col("_first") == F.col("_last")).withColumn(out, F.col("_first"))
    spot = F.row_number().over(
        Window.partitionBy(*strata, "_s").orderBy("_h", *_cols(key))) + F.col("_lo")
    split = tagged.where(F.col("_first") != F.col("_last")).withColumn("_p", spot)
    chain = None
    for i, (label, _) in enumerate(ends):
        chain = (F.when if chain is None else chain.when)(F.col("_p") <= F.col(f"_e{i}"), label)
    split = split.withColumn(out, F.lit(last) if chain is None else chain.otherwise(last)).drop("_p")
    hidden = ["_h", "_s", "_lo", "_first", "_last", *[f"_e{i}" for i in range(len(ends))]]
    return whole.unionByName(split).drop(*hidden)
