"""Column functions on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from panelweave.functions import arrays, bins, dates, text, urls


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def test_links_and_tags(spark):
    assert one(spark, "a http://x.it/1 b https://y.com?q#z", text.extract_urls) == ["http://x.it/1", "https://y.com?q#z"]
    assert one(spark, "no link", text.extract_urls) == []
    assert one(spark, "#Covid19Casa #a #Ab_1 #resto-a", text.extract_tags) == ["#casa", "#ab_1", "#resto-a"]
    assert one(spark, "hi @Ann_1 @b", lambda c: text.extract_tags(c, "mention")) == ["@ann_1"]


def test_registered_domain(spark):
    get = lambda u: one(spark, u, urls.registered_domain)
    assert get("https://www.corriere.it/a?b") == "corriere.it"
    assert get("http://news.bbc.co.uk:80/x") == "bbc.co.uk"
    assert get("http://user@a.b.example.com#t") == "example.com"
    assert get("Repubblica.IT/politica") == "repubblica.it"
    assert get("http://co.uk/") is None
    assert get("Error") is None and get("http://10.0.0.1/x") is None and get(None) is None


def test_clean_and_tokens(spark):
    clean = lambda v: one(spark, v, text.clean_post)
    assert clean("RT @user_1 ciao http://t.co/x #Casa").split() == ["ciao", "casa"]
    assert clean("VIDEO: Perché vaccino 12 pic.twitter.com/q").split() == ["perche", "vaccinare"]
    # a character set is trimmed from both ends, not the marker itself
    assert one(spark, "link nil [link]", text.remove_links) == " nil "
    assert one(spark, "a [link]", lambda c: text.remove_links(c, "literal")) == "a "
    assert one(spark, "il gatto e_b nero abcdefghijklmnop", lambda c: text.tokenize(c, ["nero"])) == ["gatto", "e_b"]
    assert one(spark, "Città #bella! http://a.b e il mare", lambda c: text.normalize_bow(c, ["il"])) == "citta bella e mare"
    assert one(spark, "a-b c.", text.split_words) == ["a", "b", "c"]
    assert text.fold_words(["perché", "così"]) == ["cosi", "perche"]


def test_weeks(spark):
    day = lambda d, make: one(spark, d, make, "date")
    monday = dt.date(2020, 2, 24)
    # the week that ends on a Monday: Tuesday to Monday
    assert day(dt.date(2020, 2, 18), dates.week_label) == monday
    assert day(monday, dates.week_label) == monday
    assert day(dt.date(2020, 2, 25), dates.week_label) == dt.date(2020, 3, 2)
    assert day(dt.date(2020, 3, 1), lambda c: dates.week_label(c, "SUN")) == dt.date(2020, 3, 1)
    assert day(dt.date(2020, 3, 1), dates.week_start) == monday
    assert one(spark, "2020-03-01 00:30:00+02:00", dates.to_utc) == dt.datetime(2020, 2, 29, 22, 30)
    assert one(spark, "not a date", dates.to_utc) is None
    weeks = spark.range(52).select(F.expr("date_add(date'2020-01-06', cast(7 * id as int))").alias("w"))
    indexed = weeks.crossJoin(weeks.agg(F.min("w").alias("f"))).select(dates.biweek_index("w", "f").alias("b"))
    assert indexed.distinct().count() == 27
    assert one(spark, dt.date(2020, 2, 17), lambda c: dates.distance_label(dates.event_distance(c, "2020-02-24")), "date") == "-7 days"


def test_bin_edges(spark):
    rows = spark.createDataFrame([(x,) for x in (-1.0, -0.6, -0.1, 0.1, 0.2, 1.01, 1.02, None)], "x double")
    got = [tuple(r) for r in rows.select(bins.cut_right("x"), bins.leaning("x"), bins.score_bin("x")).collect()]
    assert got[1] == ("far_left", "left", "far_left")
    # the two cuts disagree at -0.1
    assert got[2] == ("center", "left", "center")
    assert got[3] == ("center", "center", "center")
    assert got[5] == ("far_right", "right", "far_right")
    assert got[6] == (None, None, "far_right")
    assert got[7] == (None, None, "far_right")


def test_lists(spark):
    assert one(spark, ["a", "b", "c"], arrays.pairs_of, "array<string>") == [("a", "b"), ("b", "c")]
    assert one(spark, ["a"], arrays.pairs_of, "array<string>") == []
    assert one(spark, [], arrays.list_sum, "array<double>") == 0.0
    rule = arrays.tag_rule(({"all": ("casa", "resto"), "no": "non"}, {"all": ("uniti",)}))
    tags = ["#iorestoacasa", "#iorestoacasa", "#nonrestoacasa", "#uniti"]
    assert one(spark, tags, lambda c: arrays.group_hits(c, rule), "array<string>") == 2
    df = spark.createDataFrame([(1.0, 1.0, None)], "a double, b double, c double")
    assert df.select(arrays.argmax_col(["a", "b", "c"])).first()[0] == "a"
    rows = spark.createDataFrame([([("x", 0.5), ("y", 0.5)],)], "s array<struct<label:string,score:double>>")
    assert rows.select(arrays.argmax_label("s")).first()[0] == "x"


def test_chunks(spark):
    df = spark.createDataFrame([(1, list(range(300))), (2, list(range(50))), (3, [])], "id int, t array<int>")
    kept = {(r["id"], r["chunk_no"]): r for r in arrays.chunk_tokens(df, "t").collect()}
    # 46 + 2 of 256 and 50 + 2 of 256 are below the kept share
    assert set(kept) == {(1, 0)}
    assert kept[1, 0]["t"] == [101, *range(254), 102]
    every = arrays.chunk_tokens(df, "t", keep=1).collect()
    assert sorted((r["id"], r["chunk_no"], r["n_real"], len(r["t"])) for r in every) == [
        (1, 0, 256, 256), (1, 1, 48, 256), (2, 0, 52, 256), (3, 0, 2, 256)]
