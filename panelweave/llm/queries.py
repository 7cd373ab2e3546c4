"""Registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.llm import bpe, chat, fertility, fingerprint, langid, minhash, mixing, quality, resample, suffix, token_orc, toxicity, whitening
from panelweave.llm.common import WORD, stored, table
from panelweave.session import scratch_path


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(docs, table(spark, sf_dir, "labels"))


def op2_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, vocabulary_file("word_bpe_49k.json"), keep_ids=False)


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels"))


def op4_chat_format(spark, sf_dir):
    return chat.render(table(spark, sf_dir, "conversations"))


def op5_langid(spark, sf_dir):
    return langid.predict(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_fingerprint(spark, sf_dir):
    return fingerprint.with_next(table(spark, sf_dir, "documents"))


def op8_fertility(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return fertility.rules(docs, vocabulary_file("piece_bpe_32k.model"))


def op9_suffix(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words().alias("size"))
    mixed = mixing.mix(stored(docs, "mixing-sizes"))  # texts are counted once
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_resample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, table(spark, sf_dir, "benchmark"))


def op12_token_orc(spark, sf_dir):
    folder = scratch_path(spark, "token-orc")
    token_orc.write(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_file("word_bpe_49k.json"), folder)
    return token_orc.digests(token_orc.read(spark, folder))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_chat_format": op4_chat_format,
    "op5_langid": op5_langid,
    "op6_minhash": op6_minhash,
    "op7_fingerprint": op7_fingerprint,
    "op8_fertility": op8_fertility,
    "op9_suffix": op9_suffix,
    "op10_mixing": op10_mixing,
    "op11_resample": op11_resample,
    "op12_token_orc": op12_token_orc,
    "op13_whitening": op13_whitening,
}

SPLIT_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
               r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

SQL = {
    "op4_chat_format": f"""
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, role, text FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n, max(turn) AS top,
    list([CAST(turn AS VARCHAR), coalesce(role, ''), coalesce(text, '')] ORDER BY turn, role, text) AS l
  FROM t GROUP BY conv_id
), whole AS (
  SELECT min(conv_id) AS conv_id, n, l, min(top) AS top FROM c GROUP BY n, l
), kept AS (
  SELECT conv_id, n, top FROM whole AS a
  WHERE NOT EXISTS (SELECT 1 FROM c AS b WHERE b.l[1] = a.l[1] AND b.n > a.n AND b.l[1:a.n] = a.l)
)
SELECT t.conv_id, t.turn, kept.n AS n_turns,
  '{chat.OPEN}' || coalesce(t.role, 'none') || chr(10) || coalesce(t.text, '') || '{chat.CLOSE.strip()}' || chr(10)
  || CASE WHEN t.turn = kept.top THEN '{chat.END.strip()}' || chr(10) ELSE '' END AS rendered
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id
""",
    "op10_mixing": f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM d GROUP BY source
), o AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size, weight, CAST(source_size * 3 AS BIGINT) AS most FROM s
), f AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
    CAST(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open
  FROM o
), g AS (
  SELECT *, CAST(most AS DOUBLE) * open <= CAST(rest AS DOUBLE) * weight AS stopped FROM f
), h AS (
  SELECT *, max(CASE WHEN NOT stopped THEN open END) OVER () AS open_all,
    max(CASE WHEN NOT stopped THEN rest END) OVER () AS rest_all FROM g
), t AS (
  SELECT source, source_size,
    CASE WHEN stopped THEN CAST(most AS DOUBLE) ELSE CAST(rest_all AS DOUBLE) * weight / open_all END AS target
  FROM h
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5(concat_ws('|', coalesce(d.source, ''), 'mix')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u,
    CAST(row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id) AS DOUBLE) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST((floor(i * rate + u) - floor((i - 1) * rate + u)) * size AS BIGINT) AS taken
FROM r
""",
    "op11_resample": f"""
WITH RECURSIVE table_ AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM range(256) AS r(i)
), crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS l FROM table_
), src AS MATERIALIZED (
  SELECT 0 AS part, doc_id AS id, row_number() OVER () AS r, {SPLIT_WORDS} AS w FROM documents
), tgt AS MATERIALIZED (SELECT {SPLIT_WORDS} AS w FROM benchmark
), swords AS MATERIALIZED (SELECT r, unnest(w) AS w FROM src
), twords AS MATERIALIZED (SELECT unnest(w) AS w FROM tgt
), distinct_words AS (SELECT w FROM swords UNION SELECT w FROM twords
), hexed AS (SELECT w, hex(encode(w)) AS h FROM distinct_words
), bucketed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda k: CAST(('0x' || substr(h, 2 * k + 1, 2)) AS BIGINT))),
    lambda c, b: xor(c // 256, l[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc_table
), s AS (SELECT bucket, count(*) AS n FROM swords JOIN bucketed USING (w) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS n FROM twords JOIN bucketed USING (w) GROUP BY bucket
), gains AS (
  SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM swords) + 10000)
    / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM twords) + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM swords JOIN bucketed USING (w) JOIN gains USING (bucket) GROUP BY r
), scored AS (
  SELECT id AS doc_id, coalesce(n_features, 0) AS n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM src LEFT JOIN weights USING (r)
), noisy AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
    10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS drawn
  FROM noisy
)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank
FROM placed
""",
}
