"""Registered queries of the operators of this folder, with SQL twins where SQL can express them."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from fluoroframe.llm import chat, chat_trie, decontaminate, html_text, licenses, quality, sentencepiece_fst, simhash, spelling, token_store, topk, toxicity, warc
from fluoroframe.llm.common import table
from fluoroframe.plans.cut import shared_folder


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; TOKENIZER_DIR names another folder that every executor has."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.groupBy("doc_id", "item_id").agg(
        F.max("coverage").alias("coverage"), F.max("slots").alias("slots"), F.max("consistent").alias("consistent")
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_fst.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("decoded_chars"), "same")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return token_store.read_store(spark, path)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(pd.DataFrame({"conv_id": [-1, -1], "turn": [0, 1], "role": ["user", "assistant"], "text": [said, said]}))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(turns))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_once(table(spark, sf_dir, "pages"), path)
    return warc.resolve(warc.read_archives(spark, path))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform_ AS q FROM (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS list_transform_ FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)),
c AS (SELECT vec_id, unnest(q) AS x, unnest(range(len(q))) AS i FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
      FROM c a JOIN c b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

# crc32 of a list of bytes; its table follows from the fixed reversed polynomial 0xEDB88320
CRC_SQL = """crc AS MATERIALIZED (SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b))"""
CRC_OF = "xor(list_reduce([4294967295::BIGINT] || {bytes}, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"

OP11_SQL = f"""
WITH {CRC_SQL},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT id, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
marked AS (SELECT run, times, {CRC_OF.format(bytes="flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END FOR x IN string_split(id || ':' || run, '')])")} AS h FROM each, crc),
cut AS (SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM marked),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY 1 HAVING sum(times) >= 2),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS word, b.word AS near, b.n AS m FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM pairs GROUP BY 1),
first AS (SELECT b.word, b.n_near, b.m, min(p.near) AS near FROM best b JOIN pairs p ON p.word = b.word AND p.m = b.m GROUP BY ALL),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.m >= 10 * w.n THEN f.near END AS form, CASE WHEN f.m >= 10 * w.n THEN f.m END AS form_n FROM words w LEFT JOIN first f ON f.word = w.word),
steps AS (WITH RECURSIVE s(word, place, form) AS (SELECT word, word, form FROM forms UNION ALL SELECT s.word, f.word, f.form FROM s JOIN forms f ON f.word = s.form) SELECT word, place AS root FROM s WHERE form IS NULL)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word"""

OP12_SQL = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS place, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS first FROM p)
SELECT page_id, url, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT *, place > 1 AND payload_bytes >= 100 AS again FROM r)"""

OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
said AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS place FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {CRC_OF.format(bytes="[unicode(x)::BIGINT FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM said), crc),
parts AS (SELECT c.conv_id, s.role, s.text, 0 AS own, s.place FROM convs c JOIN said s ON s.conv_id = c.conv_id - c.conv_id % 20 AND s.place <= c.h
  UNION ALL SELECT c.conv_id, s.role, s.text, 1, s.place FROM convs c JOIN said s ON s.conv_id = c.conv_id AND s.place > c.h),
turns AS MATERIALIZED (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth FROM parts),
beginnings(conv_id, depth, key, words) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT) FROM convs
  UNION ALL SELECT b.conv_id, t.depth, sha256(b.key || ' ' || length(t.role) || ' ' || t.role || t.text), len(regexp_extract_all(t.text, '[^\x20\x09-\x0D]+'))
  FROM beginnings b JOIN turns t ON t.conv_id = b.conv_id AND t.depth = b.depth + 1),
lengths AS (SELECT conv_id, max(depth) AS size FROM beginnings GROUP BY 1),
nodes AS MATERIALIZED (SELECT b.key, any_value(b.depth) AS depth, any_value(b.words) AS words, min(b.conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(b.conv_id AS VARCHAR), ',' ORDER BY b.conv_id) FILTER (WHERE b.depth = l.size), '')) AS ends_sha256
  FROM beginnings b JOIN lengths l ON l.conv_id = b.conv_id GROUP BY b.key),
up AS (SELECT DISTINCT b.key, a.key AS above, b.depth - a.depth AS steps FROM beginnings a JOIN beginnings b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
children AS (SELECT above AS key, count(*) AS n_children FROM up WHERE steps = 1 GROUP BY 1),
below AS (SELECT u.above AS key, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves
  FROM up u JOIN nodes n ON n.key = u.key LEFT JOIN children c ON c.key = u.key GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.key = n.key LEFT JOIN children c ON c.key = n.key LEFT JOIN up u ON u.key = n.key AND u.steps = 1 LEFT JOIN nodes p ON p.key = u.above"""

QUERIES = {
    "op1_license_scan": (op1_license_scan, licenses.scan_sql()),
    "op2_decontamination": (op2_decontamination, None),
    "op3_simhash": (op3_simhash, None),
    "op4_top_k": (op4_top_k, OP4_SQL),
    "op5_sentencepiece": (op5_sentencepiece, None),
    "op6_toxicity": (op6_toxicity, None),
    "op7_token_store": (op7_token_store, None),
    "op8_html_text": (op8_html_text, None),
    "op9_chat": (op9_chat, None),
    "op10_quality": (op10_quality, None),
    "op11_spelling_groups": (op11_spelling_groups, OP11_SQL),
    "op12_warc": (op12_warc, OP12_SQL),
    "op13_prefix_trie": (op13_prefix_trie, OP13_SQL),
}
