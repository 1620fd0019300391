"""Registered queries of the operators, with SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import (bpe, conversations, embeddings, html_wrappers, langid, licenses, line_dedup, packing, quality, rans, runs,
                           simhash, suffixes)
from tallymill.session import fresh_path, load


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(load(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.drop("ids")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(load(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op6_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "rans")
    rans.write_tokens(load(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return rans.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_texts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(load(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.digests(runs.find_runs(docs, loops_by=F.col("doc_id").cast("string")))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return rows.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("_repeats.kept")).alias("n_removed"),
                       F.size("_repeats.spans").cast("bigint").alias("n_spans"), F.sha2("_repeats.kept", 256).alias("kept_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, lengths = conversations.rebuilt(conversations.turns_of(load(spark, sf_dir, "conversations")))
    return conversations.prefix_trie(turns, lengths)


QUERIES = {f.__name__: f for f in (
    op1_main_text, op2_language_id, op3_line_dedup, op4_best_fit_packing, op5_simhash, op6_rans_tokens, op7_byte_bpe, op8_quality_rules,
    op9_license_scan, op10_near_vectors, op11_periodic_runs, op12_suffix_dedup, op13_conversation_trie)}

LINE_DEDUP_SQL = """WITH lines AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
holders AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.owner AS gone FROM keyed k LEFT JOIN holders h USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

QUALITY_SQL = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, text, {_WORDS.format('text')} AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM texts),
windows AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM parts),
shingles AS (SELECT doc_id, i, words[i:i + 2] AS s FROM windows),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM shingles) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
measured AS (SELECT p.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
  length(regexp_replace(array_to_string(words, ''), '[^\\p{{L}}]', '', 'g'))::BIGINT AS n_letters,
  length(regexp_replace(array_to_string(words, ''), '[^\\p{{Lu}}]', '', 'g'))::BIGINT AS n_upper,
  len(regexp_extract_all(text, '!'))::BIGINT AS n_marks
  FROM parts p LEFT JOIN covered c ON c.doc_id = p.doc_id),
bits AS (SELECT *, {' + '.join(f"(CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END)" for r in quality.RULES)} AS failed FROM measured)
SELECT * EXCLUDE (failed), failed::BIGINT AS failed, (failed & {quality.BASE}) <> 0 AS base_failed,
  (failed & {quality.BASE | quality.POLICIES[quality.CURRENT]}) = 0 AS kept FROM bits"""

NEAR_VECTORS_SQL = """WITH RECURSIVE pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y),
links AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM embeddings e JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) m ON m.x = e.vec_id LEFT JOIN links l ON l.x = e.vec_id"""

ORACLES = {"op3_line_dedup": LINE_DEDUP_SQL, "op8_quality_rules": QUALITY_SQL, "op9_license_scan": licenses.scan_sql(),
           "op10_near_vectors": NEAR_VECTORS_SQL}
