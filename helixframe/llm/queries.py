"""The queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, language, mixing, ngrams, quality, repetition, simhash, store, substrings, warc
from helixframe.llm.text import table
from helixframe.scratch import scratch_path


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN, keep=["doc_id"], decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    warc.write(pages.select(F.col("page_id").alias("key"), F.col("url").alias("uri"), warc.payload_of("html").alias("payload")), path)
    return warc.read(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, net, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "store")
    store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return store.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(~language.apart(F.col("doc_id"))))
    return language.predict(docs, model, keep=["doc_id"]).select("doc_id", language.apart(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.totals(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compared(table(spark, sf_dir, "documents"))


def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = repetition.verdict(repetition.measures(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_warc, op3_ngram_jaccard, op4_substrings, op5_quality, op6_token_store, op7_language, op8_mixing, op9_simhash, op10_repetition)}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _covered(k: int) -> str:
    """Words of each document in windows of k words that stand in it twice or more."""
    return rf"""
      SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + {k})) AS p FROM (
          SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM (
            SELECT doc_id, i, ws[i:i + {k - 1}] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})))
        WHERE k > 1) GROUP BY doc_id"""


_OP10 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
r AS ({_covered(repetition.WINDOW)}), c AS ({_covered(repetition.LEAST_REPEAT)}), l AS ({_covered(repetition.LONGEST_REPEAT + 1)}),
b AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (SELECT count(*) - count(DISTINCT x) FROM (SELECT unnest(string_split(w.text, chr(10))) AS x) WHERE regexp_matches(x, '[^\x20\x09-\x0D]'))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(c.n, 0)::BIGINT AS n_covered, l.n IS NOT NULL AS long_repeat
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id))
"""

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOW)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (
  SELECT doc_id, ws[i:i + {ngrams.SHINGLE - 1}] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {ngrams.SHINGLE - 2})) AS i FROM w WHERE len(ws) >= {ngrams.SHINGLE})
  UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND {ngrams.SHINGLE - 1})),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= {ngrams.PERCENT} * (na.n + nb.n - i)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) m USING (doc_id)"""

_OP4 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i:i + {substrings.WINDOW - 1}] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {substrings.WINDOW - 2})) AS i FROM w WHERE len(ws) >= {substrings.WINDOW})),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
r AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + {substrings.WINDOW})) AS p FROM g JOIN f USING (k) WHERE first < doc_id) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": _OP3,
    "op4_substrings": _OP4,
    "op2_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} AND page_id <> first THEN first END AS refers_to
FROM d""",
    "op10_repetition": _OP10
    + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {round(100 * repetition.MOST_REPEATED)} * n_words AS base_failed,
  NOT (n_words < {repetition.LEAST_WORDS} OR 100 * n_repeat_words > {round(100 * repetition.MOST_REPEATED)} * n_words)
    AND n_covered <= {repetition.MOST_COVERED} * n_words AND NOT long_repeat AS kept,
  n_covered
FROM b""",
}
