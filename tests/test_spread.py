"""Work on large groups gives the same result as the plain way."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.operators import aggregates, joins, spread, windows


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(1)
    key = np.where(rng.random(3000) < 0.4, 0, rng.integers(1, 60, 3000))
    return pd.DataFrame({"k": key, "id": np.arange(3000), "v": np.round(rng.normal(size=3000), 2)})


def test_running_total_and_numbers(spark, hot):
    df = spark.createDataFrame(hot)
    want = hot.sort_values(["k", "id"])
    total = spread.running_total(df, ["k"], ["id"], "v", "t").toPandas().sort_values(["k", "id"])
    assert np.allclose(total["t"], want.groupby("k")["v"].cumsum())
    number = spread.number_rows(df, "k", "id", "n", hot_rows=50).toPandas().sort_values(["k", "id"])
    assert (number["n"].to_numpy() == want.groupby("k").cumcount().to_numpy() + 1).all()
    whole = spread.number_rows(df, [], ["id"], "n", hot_rows=50).toPandas()
    assert (whole["n"] == whole["id"] + 1).all()


@pytest.mark.parametrize("one_slice", [100, 100_000])
def test_quantiles(spark, hot, monkeypatch, one_slice):
    monkeypatch.setattr(spread, "SLICE_ROWS", one_slice)
    df = spark.createDataFrame(hot)
    probs = [0, 0.01, 0.25, 0.5, 0.75, 0.99, 1]
    assert np.allclose(spread.quantiles(df, "v", probs, slices=32), np.quantile(hot["v"], probs))
    assert np.allclose(spread.quantiles(df, "v", [0.25, 0.5], "averaged", 32),
                       np.quantile(hot["v"], [0.25, 0.5], method="averaged_inverted_cdf"))
    ranks = spread.average_ranks(df, "v").toPandas().set_index("value")["rank"]
    assert np.allclose(hot["v"].map(ranks), hot["v"].rank())


def test_quantile_bins_share_ties(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 2, 3]], "x double")
    got = windows.quantile_bin(df, "x", 3).groupBy("x").agg(F.min("bin"), F.max("bin")).collect()
    assert all(r[1] == r[2] for r in got)


def test_hash_quota(spark, hot):
    df = spark.createDataFrame(hot)
    cuts = lambda n: [("a", F.round(n * 0.3)), ("b", F.round(n * 0.1)), ("c", n)]
    got = spread.hash_quota(df, "k", "id", cuts, "part", seed=3, slices=8)
    assert got.count() == 3000
    sizes = got.groupBy("k").pivot("part", ["a", "b"]).count().na.fill(0).toPandas().set_index("k").sort_index()
    n = hot.groupby("k").size()
    half_up = lambda x: np.floor(x + 0.5)
    assert (sizes["a"] == half_up(n * 0.3)).all() and (sizes["b"] == half_up(n * 0.1)).all()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, hot, how):
    df = spark.createDataFrame(hot)
    side = spark.createDataFrame([(k, f"n{k}") for k in range(0, 60, 2)], "k long, name string")
    split = joins.salted_join(df, side, "k", how, hot_rows=30)
    plain = df.join(side, "k", how)
    assert split.exceptAll(plain.select(*split.columns)).count() == 0
    assert split.count() == plain.count()


def test_concat_text_parts_hold_everything(spark, hot):
    df = spark.createDataFrame(hot).withColumn("t", F.col("id").cast("string"))
    parts = aggregates.text_parts(df, "k", "t", ["id"], max_rows=100).toPandas().sort_values(["k", "part"])
    whole = parts.groupby("k")["text"].agg(" ".join)
    want = hot.sort_values("id").groupby("k")["id"].agg(lambda s: " ".join(map(str, s)))
    assert (whole == want).all()
    assert parts["text"].str.split().str.len().max() <= 100


def test_group_members_parts(spark, hot):
    df = spark.createDataFrame(hot)
    whole = aggregates.group_members(df, "k", "id", slice_rows=200).toPandas()
    assert whole["k"].is_unique and all(sorted(x) == list(x) for x in whole["ids"])
    assert sorted(i for ids in whole["ids"] for i in ids) == list(range(3000))
    parts = aggregates.member_parts(df, "k", "id", max_rows=200).toPandas()
    assert parts["ids"].str.len().max() < 400
    assert sorted(i for ids in parts["ids"] for i in ids) == list(range(3000))


def test_concat_text_is_one_row_per_group(spark, hot):
    df = spark.createDataFrame(hot).withColumn("t", F.col("id").cast("string"))
    got = aggregates.concat_text(df, "k", "t", ["id"], slice_rows=100).toPandas().set_index("k")["text"]
    want = hot.sort_values("id").groupby("k")["id"].agg(lambda s: " ".join(map(str, s)))
    assert got.index.is_unique and (got.sort_index() == want).all()


def test_concat_text_above_the_slice_size(spark):
    df = spark.range(20_001).select(F.lit("u").alias("k"), "id", F.lit("w").alias("t"))
    got = aggregates.concat_text(df, "k", "t", ["id"]).collect()
    assert len(got) == 1 and got[0]["text"] == " ".join(["w"] * 20_001)


def test_order_values_cuts_large_slices_again(spark, monkeypatch):
    monkeypatch.setattr(spread, "SLICE_ROWS", 20)
    monkeypatch.setattr(spread, "MOST_SLICES", 3)
    values = [float(i ** 3 % 997) for i in range(900)] + [5.0] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    n, got = spread.order_values(df, "v", lambda n: range(1, n + 1, 37))
    assert n == 1200 and got == {r: sorted(values)[r - 1] for r in range(1, 1201, 37)}


def test_rank_columns_reads_its_input_once(spark):
    import pandas as pd
    from panelweave.operators import stats

    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"id": range(300), **{c: rng.integers(0, 9, 300).astype(float) for c in "abcde"}})
    frame.loc[::17, "b"] = np.nan
    df = spark.createDataFrame(frame).replace(float("nan"), None)
    for cols in (["a"], list("abcde")):
        out = stats.rank_columns(df, cols)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("LogicalRDD") <= 6 and "LocalRelation" not in plan
        got = out.toPandas().sort_values("id").reset_index(drop=True)
        for c in cols:
            assert np.allclose(got[c], frame[c].rank(), equal_nan=True)


def test_large_slices_are_cut_again_in_one_pass_of_the_same_column(spark, monkeypatch):
    monkeypatch.setattr(spread, "SLICE_ROWS", 20)
    widths, cells = [], spread._cells
    monkeypatch.setattr(spread, "_cells", lambda x, cuts: widths.append(len(cuts)) or cells(x, cuts))
    values = [float(i * 7919 % 100_003) for i in range(12_000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    _, got = spread.order_values(df, "v", lambda n: range(1, n + 1, 500))
    assert got == {r: sorted(values)[r - 1] for r in range(1, 12_001, 500)}
    assert len(widths) == 4 and max(widths) == 1


def test_quantile_bin_plan_does_not_grow_with_bins(spark):
    from panelweave.operators import windows

    values = [0.0, -0.0, 1.0, 1.0, 2.5, float("nan"), float("inf"), None, *[float(i % 50) for i in range(800)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    plans = []
    for n in (4, 99):
        out = windows.quantile_bin(df, "v", n)
        assert out.columns == ["id", "v", "bin"] and dict(out.dtypes)["bin"] == "int"
        cuts = [c for c in spread.quantiles(df, "v", [i / n for i in range(1, n)], "averaged")]
        want = {i: None if v is None else 1 + (len(cuts) if v != v else sum(v > c for c in cuts)) for i, v in enumerate(values)}
        assert {r["id"]: r["bin"] for r in out.collect()} == want
        plans.append(out._jdf.queryExecution().optimizedPlan().toString().count(">"))
    assert plans[0] == plans[1]


def test_count_below_meets_comparisons(spark):
    rows = [(1.0, 5), (-0.0, 0), (0.0, -3), (2.0, None), (None, 7), (float("nan"), 2), (float("-inf"), 9)]
    df = spark.createDataFrame(rows, "a double, b int")
    cuts = {"a": [-1.0, 0.0, 1.0, 1.5], "b": []}
    out = spread.count_below(df, cuts).collect()
    for (a, b), r in zip(rows, out):
        assert r["_below_a"] == (None if a is None else 4 if a != a else sum(a > c for c in cuts["a"]))
        assert r["_below_b"] == (None if b is None else 0)


def test_rank_columns_of_few_values_shuffle_no_rows(spark):
    from panelweave.operators import stats

    rows = [(i % 3 if i % 7 else None, float(i % 5) if i % 11 else None, float("nan") if i % 13 == 0 else float(i % 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    for part in ((), ("k",)):
        out = stats.rank_columns(df, ["a", "b"], part)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.columns == ["k", "a", "b"] and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        frame = df.toPandas()
        found = out.toPandas()
        want = frame.groupby("k")[["a", "b"]].rank() if part else frame[["a", "b"]].rank()
        order = lambda f: f.fillna(-1.0).sort_values(["k", "a", "b"]).reset_index(drop=True)
        want.insert(0, "k", frame["k"])
        assert order(found).equals(order(want))
