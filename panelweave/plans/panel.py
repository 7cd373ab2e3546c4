"""Panel indicators: shifts, emotions, regional exposure, activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave import fixed
from panelweave.functions import arrays, bins, dates, text
from panelweave.operators import aggregates, filters, joins, reshape, windows
from panelweave.operators.spread import quantiles_many
from panelweave.session import settle


def shift_indicators(panel, entity="entity", week="week_start", score="prediction", max_gap=None) -> DataFrame:
    """Bins, previous bins and 0/1 change flags per entity-week.

    All lags look at the previous observed week. Flags are null in the first
    week of an entity. "To left" means out of a right bin, whatever the new
    bin is, and the other way round.
    """
    rows = panel.withColumn("score_bin", bins.score_bin(score)).withColumn("leaning", bins.leaning(score))
    rows = windows.lag_diff(rows, entity, week, {"score_bin": "bin_old", "leaning": "leaning_old"},
                            {score: "score_diff"}, max_gap)
    old, new = F.col("bin_old"), F.col("score_bin")
    changed = old != new
    flag = lambda c: F.when(old.isNotNull(), c.cast("int"))
    orient = changed & (old != "center")
    return rows.withColumns({
        "bin_change": flag(changed),
        "extremism": flag(changed & new.isin("far_left", "far_right")),
        "extremism_toleft": flag(changed & (new == "far_left")),
        "extremism_toright": flag(changed & (new == "far_right")),
        "orient_change": flag(orient),
        "orient_change_toleft": flag(orient & old.isin("center_right", "far_right")),
        "orient_change_toright": flag(orient & old.isin("center_left", "far_left")),
    })


def weekly_emotions(posts, emotions, entity="entity", ts="ts", emotion="emotion", n="n_posts", extra=()) -> DataFrame:
    """Posts and emotion counts per entity and week."""
    rows = reshape.one_hot(posts.withColumn("week_start", dates.week_start(ts)), emotion, emotions)
    rows = filters.with_constants(rows, **{n: 1})
    return aggregates.group_sums(rows, ["week_start", entity], [*extra, *emotions, n])


def emotion_activity_panel(panel, posts, old_posts, emotions, entity="entity", ts="ts",
                           emotion="emotion") -> DataFrame:
    """Attach weekly emotion and post counts; weeks without recent posts take
    the counts of the earlier corpus."""
    keys = ["week_start", entity]
    new = weekly_emotions(posts, emotions, entity, ts, emotion)
    old = weekly_emotions(old_posts, emotions, entity, ts, emotion)
    cols = ["n_posts", *emotions]
    old = old.withColumnsRenamed({c: f"{c}_old" for c in cols})
    rows = joins.join_entity_week(joins.join_entity_week(panel, new, keys), old, keys)
    return filters.coalesce_from(rows, {c: f"{c}_old" for c in cols})


def add_calendar(panel, week="week_start", event=fixed.EVENT_DATE, base_month=2) -> DataFrame:
    """Distances to the event in days, two-week bins and months, with text
    labels. The two-week bin starts at its first observed week."""
    first = panel.agg(F.min(week).alias("_first"))
    rows = panel.crossJoin(F.broadcast(first)).withColumn("_bi", dates.biweek_index(week, "_first"))
    # a bin is two weeks: at most one row per two weeks of the time range
    starts = rows.groupBy("_bi").agg(F.min(week).alias("biweek"))
    rows = rows.join(starts, "_bi", "left").drop("_bi", "_first")
    rows = rows.withColumns({
        "dist": dates.event_distance(week, event),
        "dist_bi": dates.event_distance("biweek", event),
        "month": dates.month_of(week),
        "dist_month": dates.month_distance(week, base_month),
    })
    return rows.withColumns({"dist_label": dates.distance_label("dist"),
                             "dist_bi_label": dates.distance_label("dist_bi"),
                             "dist_month_label": dates.distance_label("dist_month", "months")})


def weekly_regions(daily, region="region", day="day", renames=None, maxima=(), sums=(), means=()) -> DataFrame:
    """Weekly figures per region after region names are merged."""
    rows = daily.withColumn("week_start", dates.week_start(day))
    if renames:
        rows = filters.recode(rows, region, renames)
    return windows.region_week_stats(rows, [region, "week_start"], maxima, sums, means)


def regional_exposure(weekly, population, measures, region="region", pop="pop", composite=None,
                      out_prefix="treat_") -> DataFrame:
    """Largest weekly value per head and region, and flags for values above
    the upper quartile; ``composite`` names two measures to multiply."""
    # the peaks are unique by construction; only the dimension needs a check
    peak = aggregates.group_max(weekly, region, measures)
    rows = joins.checked_join(peak, population, region, "left", "m:1")
    for m in measures:
        rows = filters.with_rate(rows, m, pop, m)
    flags = list(measures)
    if composite:
        rows = rows.withColumn("composite", F.col(composite[0]) * F.col(composite[1]))
        flags.append("composite")
    # one row per region, read several times below
    rows = settle(rows)
    limits = quantiles_many(rows, {m: (m, [0.75]) for m in flags})
    return rows.withColumns({f"{out_prefix}{m}": F.col(m) > F.lit(v[0]).cast("double") for m, v in limits.items()})


def apply_treatment(panel, weekly, flags, measure="composite", region="region", week="week_start",
                    prefix="treat_") -> DataFrame:
    """Attach the weekly figures and the 0/1 treatment flag of the region, and
    distance labels marked by treatment."""
    treated = flags.select(region, F.col(f"{prefix}{measure}").cast("int").alias("treat"))
    rows = joins.join_dim(joins.join_dim(panel, weekly, [region, week]), treated, region)
    rows = rows.withColumn("treat", F.coalesce("treat", F.lit(0)))
    for c in ("dist_label", "dist_bi_label", "dist_month_label"):
        if c in rows.columns:
            rows = rows.withColumn(f"{c}_treat", F.concat(c, F.lit("_treat")))
    return rows


def total_activity(panel, week="week_start", n="n_posts", out="tot_activity") -> DataFrame:
    """Weekly total of posts on every row."""
    totals = aggregates.group_total(panel, week, n).withColumnRenamed(n, out)
    return joins.join_dim(panel, totals, week)


def tag_hits(posts, groups=None, text_col="text", kind="hashtag", keywords=fixed.TAG_KEYWORDS,
             binary=False) -> DataFrame:
    """Distinct group tags used in each post, one column per group."""
    groups = fixed.TAG_GROUPS if groups is None else groups
    rows = posts.withColumn("_tags", text.extract_tags(text_col, kind, keywords))
    return rows.withColumns({
        name: arrays.group_hits("_tags", arrays.tag_rule(rules), binary)
        for name, rules in groups.items()}).drop("_tags")


def tag_group_activity(posts, panel, groups=None, entity="entity", ts="ts", text_col="text",
                       keywords=fixed.TAG_KEYWORDS) -> DataFrame:
    """Weekly tag-group counts attached to the entity-week panel."""
    groups = fixed.TAG_GROUPS if groups is None else groups
    hits = tag_hits(posts, groups, text_col, keywords=keywords).withColumn("week_start", dates.week_start(ts))
    weekly = aggregates.group_sums(hits, ["week_start", entity], list(groups))
    return joins.join_entity_week(panel, weekly, ["week_start", entity])
