"""Registered queries of the privacy family and their SQL twins."""

from pyspark.sql import functions as F

from tallymill.operators import privacy
from tallymill.session import checkpointed, fresh_path
from tallymill.suite import views

ALT = (r"[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9.\-]+|\b[0-9]{17}[0-9Xx]\b|sk-[a-zA-Z0-9]{20,}"
       r"|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b|(?:\+?86)?1[3-9][0-9]{9}")

LABEL = """CASE WHEN contains(value, '@') THEN 'EMAIL' WHEN starts_with(value, 'sk-') THEN 'API_KEY'
 WHEN contains(value, '.') THEN 'IP_ADDR' WHEN length(value) = 18 THEN 'ID_CARD' ELSE 'PHONE' END"""


def found_sql(table: str, key: str, text: str, extra: str = "") -> str:
    return f"""SELECT {key}, {extra} pos, value, {LABEL} AS label FROM (
 SELECT {key}, {extra} unnest(range(len(m))) AS pos, unnest(m) AS value FROM (
  SELECT {key}, {extra} regexp_extract_all({text}, '{ALT}') AS m FROM {table}))"""


def masked_sql(table: str, key: str, text: str, numbered: str, pattern: str = ALT) -> str:
    """Pieces and placeholders joined again; ``numbered`` yields key, pos, placeholder."""
    return f"""SELECT p.{key}, string_agg(p.piece || coalesce(n.placeholder, ''), '' ORDER BY p.pos) AS masked
 FROM (SELECT {key}, unnest(range(len(s))) AS pos, unnest(s) AS piece FROM (
   SELECT {key}, string_split_regex({text}, '{pattern}') AS s FROM {table})) p
 LEFT JOIN ({numbered}) n ON n.{key} = p.{key} AND n.pos = p.pos GROUP BY p.{key}"""


DOC_NUMBERED = f"""SELECT f.doc_id, f.pos, f.value, f.label,
 '[[PII_' || f.label || '_' || CAST(r.n AS VARCHAR) || ']]' AS placeholder
 FROM found f JOIN (SELECT doc_id, value, row_number() OVER (PARTITION BY doc_id ORDER BY max(pos) DESC) AS n
  FROM found GROUP BY doc_id, value) r ON r.doc_id = f.doc_id AND r.value = f.value"""

CORPUS_NUMBERED = f"""SELECT f.doc_id, f.pos, f.value, f.label,
 '[[PII_' || f.label || '_' || CAST(r.n AS VARCHAR) || ']]' AS placeholder
 FROM found f JOIN (SELECT value, row_number() OVER (ORDER BY doc_id, pos DESC) AS n FROM (
   SELECT value, doc_id, pos, row_number() OVER (PARTITION BY value ORDER BY doc_id, pos DESC) AS k FROM found)
  WHERE k = 1) r ON r.value = f.value"""

FOUND = f"found AS ({found_sql('documents', 'doc_id', 'text')})"


def pii_scan(spark, d):
    return privacy.scan(views.documents(spark, d), "doc_id")


def pii_scan_pages(spark, d):
    return privacy.scan(views.pages(spark, d), "page_id", "html")


def pii_census(spark, d):
    return privacy.census(views.documents(spark, d, "source", "lang"), "doc_id", ["source", "lang"])


def mask_rows(spark, d):
    return privacy.mask(views.documents(spark, d)).select("doc_id", "masked")


def mask_corpus(spark, d):
    masked, _ = privacy.mask_corpus(views.documents(spark, d), "doc_id", "doc_id")
    return masked.select("doc_id", "masked")


def corpus_vault(spark, d):
    return privacy.corpus_vault(views.documents(spark, d), "doc_id")


def vault_table(spark, d):
    return privacy.vault_rows(privacy.mask(views.documents(spark, d)), "doc_id")


def vault_stats(spark, d):
    return privacy.vault_stats(vault_table(spark, d))


def _stored_vault(spark, d):
    path = fresh_path(spark, "vault")
    privacy.write_vault(vault_table(spark, d), path)
    return spark.read.schema("placeholder string, label string, original_value string, scope_id bigint").parquet(path)


def vault_upsert(spark, d):
    """A stored vault with every third entry written again under a new value and one new entry per scope."""
    stored = _stored_vault(spark, d)
    changed = stored.filter(F.length("original_value") % 3 == 0).withColumn("original_value", F.concat("original_value", F.lit(" again")))
    added = stored.select("scope_id").distinct().select(
        F.lit("[[PII_PHONE_900]]").alias("placeholder"), F.lit("PHONE").alias("label"), F.lit("none").alias("original_value"), "scope_id")
    return privacy.upsert_vault(stored, changed.unionByName(added))


def _largest_scope(vault):
    """The scope with the most entries, the smallest id on ties."""
    sizes = vault.groupBy("scope_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.max_by("scope_id", F.struct("n", -F.col("scope_id")))).first()[0]


def vault_restored_scope(spark, d):
    vault = _stored_vault(spark, d)
    return privacy.restore_scope(vault, _largest_scope(vault))


def vault_without_scope(spark, d):
    vault = _stored_vault(spark, d)
    return privacy.drop_scope(vault, _largest_scope(vault))


def unmask_from_vault(spark, d):
    masked = privacy.mask(views.documents(spark, d))
    vault = checkpointed(privacy.vault_rows(masked, "doc_id").withColumnRenamed("scope_id", "doc_id"))
    back = privacy.unmask(masked.select("doc_id", "text", "masked"), vault, "doc_id", ["doc_id"])
    return back.select("doc_id", "restored", (F.col("restored") == F.col("text")).alias("same"))


def unmask_rows(spark, d):
    back = privacy.unmask_row(privacy.mask(views.documents(spark, d)))
    return back.select("doc_id", F.sha2("restored", 256).alias("restored_hash"))


def leak_audit(spark, d):
    """Leaks per field, over the raw and the masked text; masked texts must have none."""
    masked = privacy.mask(views.documents(spark, d))
    found = privacy.leaks(masked, "doc_id", ["text", "masked"])
    return found.groupBy("field", "label").agg(F.count("*").alias("n_values"),
                                               F.count_distinct("doc_id").alias("n_rows"))


def mask_custom_patterns(spark, d):
    rules = {"WORD_PAIR": r"[A-Z][a-z]+ [a-z]+", "CAPITAL": r"[A-Z][a-z]{5,}", "NUMBER": r"[0-9]+"}
    return (privacy.mask_custom(views.documents(spark, d), rules)
            .select("doc_id", "masked"))


QUERIES = {
    "pii_scan": pii_scan,
    "pii_scan_pages": pii_scan_pages,
    "pii_census": pii_census,
    "mask_rows": mask_rows,
    "mask_corpus": mask_corpus,
    "corpus_vault": corpus_vault,
    "vault_table": vault_table,
    "vault_stats": vault_stats,
    "vault_upsert": vault_upsert,
    "vault_restored_scope": vault_restored_scope,
    "vault_without_scope": vault_without_scope,
    "unmask_from_vault": unmask_from_vault,
    "unmask_rows": unmask_rows,
    "leak_audit": leak_audit,
    "mask_custom_patterns": mask_custom_patterns,
}

VAULT = f"""{FOUND}, vault AS (SELECT DISTINCT doc_id AS scope_id, placeholder, label, value AS original_value FROM ({DOC_NUMBERED})),
 largest AS (SELECT scope_id FROM vault GROUP BY scope_id ORDER BY count(*) DESC, scope_id LIMIT 1)"""
CUSTOM = "[A-Z][a-z]+ [a-z]+|[A-Z][a-z]{5,}|[0-9]+"
CUSTOM_FOUND = f"""found AS (SELECT doc_id, pos, value, CASE WHEN contains(value, ' ') THEN 'WORD_PAIR' WHEN regexp_matches(value, '^[0-9]') THEN 'NUMBER'
  ELSE 'CAPITAL' END AS label FROM (SELECT doc_id, unnest(range(len(m))) AS pos, unnest(m) AS value FROM (
   SELECT doc_id, regexp_extract_all(text, '{CUSTOM}') AS m FROM documents)))"""

ORACLES = {
    "vault_upsert": f"""WITH {VAULT} SELECT scope_id, placeholder, label,
 CASE WHEN length(original_value) % 3 = 0 THEN original_value || ' again' ELSE original_value END AS original_value FROM vault
 UNION ALL SELECT DISTINCT scope_id, '[[PII_PHONE_900]]', 'PHONE', 'none' FROM vault""",
    "vault_restored_scope": f"WITH {VAULT} SELECT * FROM vault WHERE scope_id = (SELECT scope_id FROM largest)",
    "vault_without_scope": f"WITH {VAULT} SELECT * FROM vault WHERE scope_id <> (SELECT scope_id FROM largest)",
    "mask_custom_patterns": f"WITH {CUSTOM_FOUND} {masked_sql('documents', 'doc_id', 'text', DOC_NUMBERED, CUSTOM)}",
    "pii_scan": f"WITH {FOUND} SELECT doc_id, CAST(pos AS INTEGER) AS pos, label, value FROM found",
    "pii_scan_pages": f"WITH found AS ({found_sql('pages', 'page_id', 'html')}) "
                      "SELECT page_id, CAST(pos AS INTEGER) AS pos, label, value FROM found",
    "pii_census": f"WITH found AS ({found_sql('documents', 'doc_id', 'text', 'source, lang,')}) "
                  "SELECT source, lang, label, count(*) AS n_values, count(DISTINCT value) AS n_distinct, "
                  "count(DISTINCT doc_id) AS n_rows FROM found GROUP BY source, lang, label",
    "mask_rows": f"WITH {FOUND} {masked_sql('documents', 'doc_id', 'text', DOC_NUMBERED)}",
    "mask_corpus": f"WITH {FOUND} {masked_sql('documents', 'doc_id', 'text', CORPUS_NUMBERED)}",
    "corpus_vault": f"WITH {FOUND} SELECT DISTINCT placeholder, label, value AS original_value "
                    f"FROM ({CORPUS_NUMBERED})",
    "vault_table": f"WITH {FOUND} SELECT DISTINCT doc_id AS scope_id, placeholder, label, "
                   f"value AS original_value FROM ({DOC_NUMBERED})",
    "vault_stats": f"WITH {FOUND} SELECT doc_id AS scope_id, count(DISTINCT value) AS n_entries, "
                   "count(DISTINCT value) AS last_number FROM found GROUP BY doc_id",
    "unmask_from_vault": "SELECT doc_id, text AS restored, TRUE AS same FROM documents",
    "unmask_rows": "SELECT doc_id, sha256(text) AS restored_hash FROM documents",
    "leak_audit": f"WITH {FOUND} SELECT 'text' AS field, label, count(*) AS n_values, "
                  "count(DISTINCT doc_id) AS n_rows FROM found GROUP BY label",
}
