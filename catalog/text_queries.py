"""Text, link and list expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.inputs import (
    GROUP_SQL, GROUPS, HOST_SUFFIXES, LINKED, STOP, TAGS, TOKENS, linked_posts, r, tagged, tokens,
)
from panelweave import fixed
from panelweave.functions import arrays, text, urls

SP = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
PLAIN = "replace(replace(replace(strip_accents({0}), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')"
STOPS = ", ".join(f"'{w}'" for w in STOP)


@query("extract_urls", f"""WITH {LINKED} SELECT post_id, pos, url FROM (SELECT post_id, unnest(l) AS url, unnest(range(len(l))) AS pos FROM
  (SELECT post_id, regexp_extract_all(text, 'https?://[^{SP}]+') AS l FROM linked))""", "T-01 AR-03")
def _(t):
    rows = linked_posts(t).select("post_id", text.extract_urls("text").alias("url"))
    return arrays.flatten_rows(rows, "url", pos="pos")


@query("registered_domain", """SELECT page_id, regexp_extract(lower(url), '([^./]+\\.[^./?#]+)([/?#]|$)', 1) AS domain,
  regexp_extract(lower(url), '([^./]+\\.example\\.[a-z]+)([/?#]|$)', 1) AS site, regexp_extract(lower(url), '//([^/?#]+)', 1) AS host FROM pages""", "T-02")
def _(t):
    return t.pages.select("page_id", urls.registered_domain("url").alias("domain"),
                          urls.registered_domain("url", HOST_SUFFIXES).alias("site"), urls.host("url").alias("host"))


@query("extract_hashtags", f"WITH {TAGS} SELECT post_id, len(tags) AS n, array_to_string(tags, ' ') AS tags FROM tags", "T-03")
def _(t):
    tags = text.extract_tags("text")
    return tagged(t).select("post_id", F.size(tags).alias("n"), F.array_join(tags, " ").alias("tags"))


@query("extract_mentions", f"""WITH m AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(replace(text, ' the ', ' @the_1 ')),
  '({'|'.join(fixed.TAG_KEYWORDS)})', '', 'g'), '@[A-Za-z]+[A-Za-z0-9\\-_]+') AS l FROM documents)
  SELECT doc_id, len(l) AS n, array_to_string(l, ' ') AS mentions FROM m""", "T-03")
def _(t):
    m = text.extract_tags(F.replace(F.col("text"), F.lit(" the "), F.lit(" @the_1 ")), "mention")
    return t.documents.select("doc_id", F.size(m).alias("n"), F.array_join(m, " ").alias("mentions"))


@query("normalize_bow", f"""SELECT doc_id, array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(
  {PLAIN.format("lower(text || ' #Tag @You http://a.b/c?d=1 end!')")}, '[#@]', '', 'g'),
  'http[^{SP}]+|[^\\p{{L}}\\p{{N}}_{SP}]', '', 'g'), '[{SP}]+'), lambda w: w <> '' AND w NOT IN ({STOPS})), ' ') AS bow FROM documents""", "T-04")
def _(t):
    raw = F.concat("text", F.lit(" #Tag @You http://a.b/c?d=1 end!"))
    return t.documents.select("doc_id", text.normalize_bow(raw, STOP).alias("bow"))


NOISY = "'RT @Abc_9 look @b-c http://x.y/z?q=1 ' || text || ' bit.ly/abc VIDEO: #Covid19 vaccino 123 pic.twitter.com/q [link]'"


def _clean_sql(raw):
    e = raw
    e = f"regexp_replace({e}, 'RT\\s@[A-Za-z]+[A-Za-z0-9\\-_]+', '', 'g')"
    e = f"regexp_replace({e}, '@[A-Za-z]+[A-Za-z0-9\\-_]+', '', 'g')"
    e = f"regexp_replace({e}, 'http[^{SP}]+', '', 'g')"
    e = f"regexp_replace({e}, 'bit.ly/[^{SP}]+', '', 'g')"
    e = f"trim({e}, '[link]')"
    e = f"regexp_replace({e}, 'pic.twitter[^{SP}]+', '', 'g')"
    e = f"replace(replace(replace({e}, '#', ''), 'VIDEO:', ''), 'AUDIO:', '')"
    e = f"lower({e})"
    e = f"regexp_replace({e}, '({'|'.join(fixed.TEXT_KEYWORDS)})', '', 'g')"
    e = f"replace({e}, 'vaccino', 'vaccinare')"
    e = f"regexp_replace({e}, '[!\"$%&''()*+,\\-./:;<=>?\\[\\]^_`{{|}}~•@]+', ' ', 'g')"
    e = f"regexp_replace({e}, '[{SP}]+', ' ', 'g')"
    e = f"regexp_replace({e}, '[0-9]+', '', 'g')"
    return PLAIN.format(e)


@query("clean_post", f"SELECT doc_id, {_clean_sql(NOISY)} AS clean FROM documents", "T-05 T-07")
def _(t):
    raw = F.concat(F.lit("RT @Abc_9 look @b-c http://x.y/z?q=1 "), "text",
                   F.lit(" bit.ly/abc VIDEO: #Covid19 vaccino 123 pic.twitter.com/q [link]"))
    return t.documents.select("doc_id", text.clean_post(raw).alias("clean"))


@query("tokenize", f"WITH {TOKENS} SELECT doc_id, len(tokens) AS n, array_to_string(tokens, ' ') AS tokens FROM tok", "T-06")
def _(t):
    return tokens(t).select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@query("fold_accents", f"SELECT doc_id, {PLAIN.format('text')} AS plain FROM documents", "T-07")
def _(t):
    return t.documents.select("doc_id", text.fold_accents("text").alias("plain"))


RUN = "'lr_' || (p_size % 3 + 3) || 'e-05_batch_' || p_size || CASE WHEN p_size % 2 = 0 THEN '_merged_' ELSE '_individual_' END || 'perc_0.4_len_' || p_partkey"


@query("parse_params", f"""SELECT p_partkey, (p_size % 3 + 3) || 'e-05' AS lr, p_size::VARCHAR AS batch, '0.4' AS perc, p_partkey::VARCHAR AS len,
  CASE WHEN p_size % 2 = 0 THEN 'merged' ELSE 'individual' END AS dataset FROM part""", "T-08")
def _(t):
    from panelweave.plans import reports
    runs = t.part.select("p_partkey", F.concat(
        F.lit("lr_"), (F.col("p_size") % 3 + 3).cast("string"), F.lit("e-05_batch_"), F.col("p_size").cast("string"),
        F.when(F.col("p_size") % 2 == 0, "_merged_").otherwise("_individual_"),
        F.lit("perc_0.4_len_"), F.col("p_partkey").cast("string")).alias("run"))
    return reports.run_table(runs).drop("run")


@query("join_list", f"""WITH {TAGS} SELECT post_id, '<' || array_to_string(tags, ', ') || '>_treat' AS words,
  'Topic ' || (post_id % 20) AS topic FROM tags""", "T-09")
def _(t):
    return tagged(t).select("post_id", text.join_list(text.extract_tags("text"), ", ", "<", ">_treat").alias("words"),
                            text.relabel(F.concat(F.lit("topic_"), F.col("post_id") % 20), "topic_", "Topic ").alias("topic"))


@query("split_words", """WITH w AS (SELECT doc_id, string_split_regex(text, '[^\\p{L}\\p{N}_]') AS l FROM documents),
  k AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM w)
  SELECT doc_id, len(l) AS n, array_to_string(l, '|') AS words FROM k""", "T-10")
def _(t):
    words = text.split_words("text")
    return t.documents.select("doc_id", F.size(words).alias("n"), F.array_join(words, "|").alias("words"))


# lists

@query("filter_list", f"""WITH {TOKENS} SELECT doc_id, array_to_string(list_filter(tokens, lambda w: w IN ('with', 'for', 'une', 'das', 'los')), ' ') AS kept FROM tok""", "AR-01")
def _(t):
    return tokens(t).select("doc_id", F.array_join(arrays.filter_list("tokens", ["with", "for", "une", "das", "los"]), " ").alias("kept"))


@query("list_sum_len", f"WITH {TOKENS} SELECT doc_id, {r('CAST(coalesce(list_sum(list_transform(tokens, lambda w: length(w))), 0) AS DOUBLE)')} AS total, len(tokens) AS n FROM tok", "AR-02")
def _(t):
    return tokens(t).select("doc_id", arrays.list_sum(F.transform("tokens", F.length)).alias("total"), arrays.list_len("tokens").alias("n"))


@query("flatten_rows", f"WITH {TAGS} SELECT post_id, unnest(tags) AS tag FROM tags", "AR-03")
def _(t):
    return arrays.flatten_rows(tagged(t).select("post_id", text.extract_tags("text").alias("tag")), "tag")


@query("group_hits", f"WITH {TAGS} SELECT post_id, " + ", ".join(
    f"len(list_filter(list_distinct(tags), lambda x: {c})) AS \"{g}\"" for g, c in GROUP_SQL.items())
    + f", CAST(len(list_filter(tags, lambda x: {GROUP_SQL['for-of']})) > 0 AS BIGINT) AS any_for FROM tags", "AR-04")
def _(t):
    rows = tagged(t).withColumn("tags", text.extract_tags("text"))
    return rows.select("post_id", *[
        arrays.group_hits("tags", arrays.tag_rule(rules)).alias(g) for g, rules in GROUPS.items()],
        arrays.group_hits("tags", arrays.tag_rule(GROUPS["for-of"]), binary=True).alias("any_for"))


@query("append", f"WITH {TAGS} SELECT post_id, array_to_string(list_append(tags, category), ' ') AS tags FROM tags", "AR-05")
def _(t):
    rows = tagged(t).withColumn("tags", text.extract_tags("text"))
    return rows.select("post_id", F.array_join(arrays.append("tags", "category"), " ").alias("tags"))


@query("adjacent_pairs", f"""WITH {TOKENS} SELECT doc_id, tokens[i] AS a, tokens[i + 1] AS b FROM
  (SELECT doc_id, tokens, unnest(range(1, len(tokens))) AS i FROM tok)""", "AR-06")
def _(t):
    return arrays.adjacent_pairs(tokens(t).select("doc_id", "tokens"), "tokens", "a", "b")


def _chunk_sql(keep, size=256):
    body = size - 2
    return f"""WITH w AS (SELECT doc_id, string_split_regex(text, '\\s+') AS l FROM documents),
  c AS (SELECT doc_id, i AS chunk_no, l[i * {body} + 1 : (i + 1) * {body}] AS b FROM
    (SELECT doc_id, l, unnest(range((len(l) - 1) // {body} + 1)) AS i FROM w))
  SELECT doc_id, chunk_no, len(b) + 2 AS n_real, '[C] ' || array_to_string(b, ' ') || ' [S]' || repeat(' [P]', {size} - 2 - len(b)) AS tokens
  FROM c WHERE {f"(len(b) + 2) / {size} >= {keep}" if keep < 1 else "true"}"""


def _chunks(t, **options):
    rows = t.documents.select("doc_id", F.split("text", r"\s+").alias("tokens"))
    out = arrays.chunk_tokens(rows, "tokens", cls="[C]", sep="[S]", pad="[P]", **options)
    return out.withColumn("tokens", F.array_join("tokens", " "))


@query("chunk_tokens", _chunk_sql(0.4), "AR-07")
def _(t):
    return _chunks(t)


@query("chunk_tokens_all", _chunk_sql(1, 128), "AR-07")
def _(t):
    return _chunks(t, size=128, keep=1)


@query("truncate_tokens", "SELECT doc_id, array_to_string(string_split_regex(text, '\\s+')[:128], ' ') AS tokens FROM documents", "AR-07")
def _(t):
    return t.documents.select("doc_id", F.array_join(arrays.truncate_tokens(F.split("text", r"\s+")), " ").alias("tokens"))


@query("argmax_col", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_discount >= l_tax AND l_discount >= l_quantity / 500 THEN 'l_discount'
  WHEN l_tax >= l_quantity / 500 THEN 'l_tax' ELSE 'q' END AS best FROM lineitem""", "AR-08")
def _(t):
    rows = t.lineitem.withColumn("q", F.col("l_quantity") / 500)
    return rows.select("l_orderkey", "l_linenumber", arrays.argmax_col(["l_discount", "l_tax", "q"]).alias("best"))


@query("argmax_label", """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best FROM embeddings""", "AR-09")
def _(t):
    scored = F.transform("embedding", lambda x, i: F.struct(i.alias("label"), x.alias("score")))
    return t.embeddings.select("vec_id", arrays.argmax_label(scored).alias("best"))
