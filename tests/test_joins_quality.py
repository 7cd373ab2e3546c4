"""Join semantics, contracts, filters and sources."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelweave import schemas
from panelweave.operators import aggregates, filters, joins, ordering, quality, windows
from panelweave.session import discard_scratch, scratch_path
from panelweave.sources import readers, writers


def test_contracts(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k int, x string")
    right = spark.createDataFrame([(1, "c")], "k int, y string")
    assert joins.checked_join(left, right, "k", "inner", "m:1").count() == 2
    with pytest.raises(quality.KeyContractError):
        joins.checked_join(left, right, "k", "inner", "1:1")
    with pytest.raises(quality.KeyContractError):
        joins.checked_join(right, left, "k", "inner", "m:1")
    with pytest.raises(quality.QualityError):
        quality.assert_quality(left, {"x_is_a": F.col("x") == "a"})


def test_lookup_keeps_order_and_drops_misses(spark):
    rows = spark.createDataFrame([(1, ["u3", "u1", "zz", "u1"]), (2, []), (3, ["un"])], "id int, urls array<string>")
    table = spark.createDataFrame([("u1", "A"), ("u3", "C"), ("un", None)], "url string, loc string")
    got = {r["id"]: r["o"] for r in joins.lookup_list(rows, "urls", table, "url", "loc", "o", "id").collect()}
    assert got == {1: ["C", "A", "A"], 2: [], 3: []}


def test_dictionaries(spark):
    old = spark.createDataFrame([("a", "1")], "k string, v string")
    new = spark.createDataFrame([("a", "2"), ("b", "3")], "k string, v string")
    get = lambda df: dict(map(tuple, df.collect()))
    assert get(joins.merge_dicts(new, old, "k")) == {"a": "1", "b": "3"}
    assert get(joins.merge_dicts(new, old, "k", prefer="new")) == {"a": "2", "b": "3"}


def test_outer_indicator_and_balance(spark):
    a = spark.createDataFrame([(1, 1), (2, 1)], "k int, x int")
    b = spark.createDataFrame([(2, 5), (3, 5)], "k int, y int")
    got = {r["k"]: r["_merge"] for r in joins.join_outer_indicator(a, b, "k").collect()}
    assert got == {1: "left_only", 2: "both", 3: "right_only"}
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 3.0)], "g string, t int, v double")
    assert sorted(map(tuple, joins.balance_panel(df, "g", "t").collect())) == [
        ("a", 1, 2.0), ("a", 2, 0.0), ("b", 1, 0.0), ("b", 2, 3.0)]


def test_lookup_dim_keeps_columns_and_order(spark):
    df = spark.createDataFrame([(1, ["b", "x", "a", "b"]), (2, []), (3, None), (4, ["x"])], "id int, l array<string>")
    dim = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "k string, v double")
    got = {r["id"]: (r["s"], r["kept"]) for r in joins.lookup_dim(df, "l", dim, "k", "v", "s", "id", "kept").collect()}
    assert got == {1: ([2.0, 1.0, 2.0], ["b", "a", "b"]), 2: ([], []), 3: ([], []), 4: ([], [])}


def test_range_join_with_many_uneven_intervals(spark):
    bounds = [(0, 3), (4, 4), (5, 900), (901, 901), (950, 960)] + [(2000 + 2 * i, 2001 + 2 * i) for i in range(200)]
    side = spark.createDataFrame([(a, b, f"{a}") for a, b in bounds], "lb int, ub int, name string")
    rows = spark.range(-5, 2500).withColumnRenamed("id", "x")
    got = {r["x"]: r["name"] for r in joins.range_join(rows, side, "x").collect()}
    want = {x: next((str(a) for a, b in bounds if a <= x <= b), None) for x in range(-5, 2500)}
    assert got == want
    days = spark.createDataFrame([(dt.date(2020, 1, 5),), (None,)], "d date")
    weeks = spark.createDataFrame([(dt.date(2020, 1, 1), dt.date(2020, 1, 7))], "lb date, ub date")
    assert [r["lb"] for r in joins.range_join(days, weeks, "d").orderBy("d").collect()] == [None, dt.date(2020, 1, 1)]
    assert joins.range_join(days, weeks.where("false"), "d").count() == 2


def largest_part(df):
    """Rows of the fullest partition and of all."""
    sizes = df.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    return max(sizes), sum(sizes)


def test_hot_group_is_split_in_joins_with_its_aggregate(spark):
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in plain.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 4 > 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"), "id")
        spans = joins.with_group(df, "k", [F.max("id").alias("top")], hot_rows=1_000)
        most, total = largest_part(spans)
        assert total == 20_000 and most < 15_000
        assert spans.where("k = 0").select("top").distinct().collect()[0][0] == 19_999
        agg = df.groupBy("k").agg(F.count("id").alias("n"))
        most, total = largest_part(joins.join_entity_week(df, agg, ["k"], hot_rows=1_000))
        assert total == 20_000 and most < 15_000
    finally:
        for k in plain:
            spark.conf.unset(k)


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 5, 4.0), ("b", 1, 9.0)], "e string, w int, v double")
    got = sorted(map(tuple, windows.lag_diff(df, "e", "w", {"v": "old"}, {"v": "d"}).select("e", "w", "old", "d").collect()))
    assert got == [("a", 1, None, None), ("a", 2, 1.0, 2.0), ("a", 5, 3.0, 1.0), ("b", 1, None, None)]
    smooth = [r["m"] for r in windows.trailing_mean(df.where("e = 'a'"), "e", "w", "v", "m").orderBy("w").collect()]
    assert smooth[:2] == [None, None] and abs(smooth[2] - 8 / 3) < 1e-12
    rows = ordering.limit_per_group(df, "e", ["w"], 2)
    assert rows.groupBy("e").count().agg(F.max("count")).first()[0] == 2


def test_filters(spark):
    df = spark.createDataFrame([("x",), (None,), ("other",)], "c string")
    assert filters.where_in(df, "c", ["other"], negate=True).count() == 2
    days = spark.createDataFrame([(dt.date(2019, 12, 31),), (dt.date(2020, 1, 1),), (dt.date(2020, 12, 31),)], "d date")
    assert filters.where_date(days, "d", "2019-12-31", "2020-12-31", lo_open=True).count() == 2
    assert filters.flag_min(spark.createDataFrame([(3,), (None,)], "n int"), "n", 3).where("target_train").count() == 1


def test_weekly_score_joins_the_week_before(spark):
    ts = lambda d: dt.datetime(2020, 2, d, 12)
    rows = spark.createDataFrame([("u", ts(18), 1.0, 1), ("u", ts(24), -1.0, 1), ("u", ts(25), 0.5, 1)], "e string, ts timestamp, s double, n int")
    got = sorted(map(tuple, aggregates.weekly_score(rows, "ts", "e", "s", "n").select("week_start", "final_score").collect()))
    assert got == [(dt.date(2020, 2, 24), 0.0), (dt.date(2020, 3, 2), 0.5)]


def test_sources(spark, tmp_path):
    path = f"{tmp_path}/labels.csv"
    rows = spark.createDataFrame([("a.it", "-", 0.5, "newspaper")], schemas.DOMAIN_LABELS)
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("domain,polarity_cat,polarity_cont,type\na.it,-,0.5,newspaper\n")
    assert readers.read_dim_csv(spark, path, schemas.DOMAIN_LABELS).collect() == rows.collect()
    with pytest.raises(schemas.SchemaMismatch):
        schemas.check_schema(rows.drop("type"), schemas.DOMAIN_LABELS)
    calls = []
    step = scratch_path(spark, "step")
    make = lambda: calls.append(1) or rows
    writers.compute_or_load(spark, step, make)
    writers.compute_or_load(spark, step, make)
    assert calls == [1]
    with pytest.raises(Exception):
        writers.write_table(rows, step)
    df = spark.range(1000)
    shards = writers.write_sharded(df, scratch_path(spark, "shards"), 5, "id")
    back = readers.read_shards(spark, shards, df.schema)
    assert back.count() == 1000 and readers.missing_shards(back.where("shard <> 2"), 5).collect()[0][0] == 2


def test_discard_scratch(spark):
    import os
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.isdir(local) and discard_scratch(spark) >= 1 and not os.path.exists(local)
    assert discard_scratch(spark) == 0
