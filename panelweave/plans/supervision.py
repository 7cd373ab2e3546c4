"""From posts and resolved links to a scored training table, corpora and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave import fixed
from panelweave.functions import bins, dates, text, urls
from panelweave.operators import aggregates, features, filters, joins, spread
from panelweave.session import settle


def post_domains(posts, links, post_id="post_id", text_col="text", url="url", location="location",
                 keep=()) -> DataFrame:
    """One row per resolved link of a post with its registered domain.

    Links that resolve to nothing or failed are dropped before the join. The
    long link table, much smaller than the texts, is stored, so that the texts
    are scanned once although hot links are counted before the join.
    """
    long = settle(posts.select(post_id, *keep, F.explode(text.extract_urls(text_col)).alias("_url")))
    usable = links.where(F.col(location).isNotNull() & (F.col(location) != fixed.LINK_ERROR))
    found = joins.lookup_long(long, "_url", usable, url, location, "_location")
    return found.withColumn("domain", urls.registered_domain("_location")).drop("_url", "_location")


def weekly_alignment(posts, links, labels, post_id="post_id", entity="entity", ts="ts", text_col="text",
                     domain="domain", score="score", remove_centre=False, label="trailing") -> DataFrame:
    """Score per entity and week from the scored domains of its links.

    Sums are taken from the long table of links, so no list is regrouped.
    """
    if remove_centre:
        labels = labels.where(F.col(score) != 0)
    scored = post_domains(posts, links, post_id, text_col, keep=[entity, ts]).join(
        labels.select(F.col(domain).alias("domain"), F.col(score).alias("_score")), "domain")
    return aggregates.weekly_score(
        scored.withColumn("_one", F.lit(1).cast("bigint")), ts, entity, "_score", "_one", label=label)


def distant_supervision(posts, links, labels, attrs=None, topics=None, post_id="post_id", entity="entity",
                        ts="ts", text_col="text", topic="topic", min_count=fixed.MIN_WEEKLY_DOMAINS,
                        label="trailing") -> DataFrame:
    """Posts of entity-weeks with enough scored links, with score and bin.

    The weekly score uses posts of all topics. Only then are posts of other
    topics and entity-weeks with too few links left out, both before the join.
    """
    weekly = weekly_alignment(posts, links, labels, post_id, entity, ts, text_col, label=label)
    weekly = settle(filters.flag_min(weekly, "score_count", min_count).where("target_train"))
    rows = posts if topics is None else filters.where_in(posts, topic, topics)
    keys = ["week_start", entity]
    rows = rows.withColumn("week_start", dates.week_start(ts))
    if spread.fits(weekly):
        rows = rows.join(F.broadcast(weekly), keys)
    else:
        # hot keys are counted among the rows that the join keeps
        kept = rows.select(*keys).join(weekly.select(*keys), keys, "left_semi").groupBy(*keys).count()
        rows = joins.salted_join(rows, weekly, keys, hot=joins.hot_keys(kept, keys))
    if attrs is not None:
        rows = joins.join_attrs(rows, attrs, entity)
    return rows.withColumn("score_bin", bins.cut_right("final_score"))


def entity_week_corpus(posts, attrs=None, entity="entity", ts="ts", text_col="text", order=("ts", "post_id"),
                       topics=None, topic="topic", org=None, org_col="is_org", sort=False) -> DataFrame:
    """One text per entity and week, with entity attributes; entities without
    attributes are left out. ``sort`` orders the table by entity and week."""
    rows = posts
    if org is not None:
        rows = filters.where_eq(rows, org_col, org)
    if topics is not None:
        rows = filters.where_in(rows, topic, topics)
    rows = rows.withColumn("week_start", dates.week_start(ts))
    corpus = aggregates.concat_text(rows, [entity, "week_start"], text_col, list(order), text_col)
    if attrs is not None:
        rest = [c for c in attrs.columns if c != entity]
        info = aggregates.dedupe(attrs, entity, rest)
        corpus = corpus.join(info, entity)
    return corpus.orderBy(entity, "week_start") if sort else corpus


def training_sets(training, entity="entity", week="week_start", text_col="text", order=("ts", "post_id"),
                  score="final_score", bin_col="score_bin", seed=fixed.SEED, store=True) -> tuple[DataFrame, DataFrame]:
    """Merged entity-week texts with their score and a split by entity, and
    the summary of both forms.

    The training rows are read several times; they are stored first unless
    they come from a stored table already (``store=False``).
    """
    training = settle(training) if store else training
    merged = aggregates.concat_text(training, [entity, week], text_col, list(order), text_col)
    # score and bin are constant within an entity-week
    target = training.groupBy(entity, week).agg(F.min(score).alias(score), F.min(bin_col).alias(bin_col))
    merged = joins.checked_join(merged, target, [entity, week], "inner", "m:1")
    merged = features.grouped_split(merged, entity, seed=seed)
    single = features.grouped_split(training, entity, seed=seed)
    summary = aggregates.split_summary({"individual": single, "merged": merged}, "split", entity, week)
    return merged, summary
