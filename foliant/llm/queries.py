"""The queries opN_<name> and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import audit, byte_bpe, jaccard, lines, packing, pii, quality, resharding, toxicity, transport, unigram, urls, whitening
from foliant.llm.common import documents


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = 4096
    cut = packing.pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity)
    return packing.pack(cut, capacity)


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns per document doc_id, n_lines, n_removed and removed, the numbers of its removed lines."""
    return lines.report(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = toxicity.scored(docs, model)
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.described(transport.to_media(documents(spark, sf_dir)))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns per document doc_id, n_tokens and n_pretokens."""
    return unigram.counted(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old shards are those of the sources, which a hash dealt over 8 shards; the new ones are to be equal in bytes. Files of affected shards are rewritten."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(8))
    placed = resharding.moved(resharding.resharded(resharding.sized(docs, old), 8))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return audit.audited(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Host, path and verdict of the rules that URLs are judged by.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns per page page_id, host, path, rule, verdict (allowed where no rule fits) and n_rules, the number of rules that fit."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).drop("url")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_fuzzy_lines,
        op3_toxicity,
        op4_transport_streams,
        op5_token_counts,
        op6_quality_rules,
        op7_personal_data,
        op8_byte_bpe,
        op9_resharding,
        op10_ngram_jaccard,
        op11_filter_audit,
        op12_url_filters,
        op13_whitening,
    )
}

#: Words and lines of whole texts; a word is covered if one of the three windows that it can be in is there twice.
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)),
three AS (SELECT r, word, pos, lead(word) OVER v AS second_word, lead(word, 2) OVER v AS third_word FROM w WINDOW v AS (PARTITION BY r ORDER BY pos)),
again AS (SELECT r, word, pos, third_word IS NOT NULL AND count(*) OVER (PARTITION BY r, word, second_word, third_word) > 1 AS twice FROM three),
covered AS (SELECT r, word, max(twice) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM again),
of_words AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (WHERE covered) AS n_repeat_words, count(*) FILTER (WHERE lower(word) IN (STOP)) AS n_stop FROM covered GROUP BY r),
of_lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^!?]+', '', 'g')) AS n_marks, coalesce(n_stop, 0) AS n_stop FROM d LEFT JOIN of_words USING (r) LEFT JOIN of_lines USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND n_words <= 1000000 AND word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.1 AND n_marks / n_words <= 0.5 AND n_stop / n_words >= 0.01 AND n_dup_lines / n_lines <= 0.3 AND n_words / n_lines >= 2 AS kept,
n_lines, n_marks, n_stop FROM b""".replace("STOP", ", ".join(f"'{w}'" for w in quality.STOP_WORDS))

#: All pairs that share a shingle, and what each document reaches by links.
JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (SELECT DISTINCT x, x AS y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x)
SELECT doc_id, len(g)::BIGINT AS n_shingles, coalesce(least(doc_id, c), doc_id) AS component_id FROM s LEFT JOIN (SELECT x, min(y) AS c FROM reached GROUP BY x) ON doc_id = x"""

#: Masks of failed filters, and what becomes of each of them at each step of each order.
AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
first AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
m AS (SELECT doc_id, text, part, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
failing AS (SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f FROM m JOIN first USING (text)),
marks AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, f, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, f),
filters AS (SELECT unnest([1, 2, 3, 4, 5]) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM filters a, filters b, filters c, filters d, filters e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT array_to_string(list_transform(o, lambda k: 'ABCDE'[k]), '') AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, o FROM orders),
judged AS (SELECT part, filter_order, step, o[step] AS filter, n, good, toxic, f[o[step]] AS fails, list_bool_or(list_concat([false], list_transform(o[1:step - 1], lambda k: f[k]))) AS gone, len(list_filter(f, lambda x: x)) AS n_failed FROM masks, steps),
counts AS (SELECT part, filter_order, step, filter, sum(n) FILTER (WHERE NOT gone AND NOT fails) AS kept, sum(n) FILTER (WHERE fails AND NOT gone) AS removed, sum(n) FILTER (WHERE fails AND gone) AS redundant,
  sum(n) FILTER (WHERE fails AND n_failed = 1) AS unique_fails, sum(good) FILTER (WHERE fails AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE fails AND NOT gone) AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counts""".replace("\\\\", "\\")

#: Each page with the longest of the rules that fit.
URLS_SQL = r"""
WITH rules AS (SELECT * FROM (VALUES RULES) AS r(rule_host, rule_path, rule_verdict)),
p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
fits AS (SELECT r, count(*) AS n_rules, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM q JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, coalesce(n_rules, 0) AS n_rules FROM q LEFT JOIN fits USING (r)""".replace("RULES", ", ".join(map(str, URL_RULES)))

ORACLE_SQL: dict[str, str] = {"op6_quality_rules": QUALITY_SQL, "op10_ngram_jaccard": JACCARD_SQL, "op11_filter_audit": AUDIT_SQL, "op12_url_filters": URLS_SQL}
