"""Registered queries of the prompt and batch-file family and their SQL twins."""

from pyspark.sql import functions as F

from tallymill.operators import prompts as pr
from tallymill.operators.rules import Rule
from tallymill.session import fresh_path, load
from tallymill.suite import views
from tallymill.suite.views import ATTEMPTS, IO_PAIRS

TEMPLATE = "Summarise:\n{{data}}\n--\nAgain: {{  data }}"


def render_prompts(spark, d):
    return load(spark, d, "documents").select("doc_id", pr.render(F.col("text"), TEMPLATE).alias("prompt"))


def render_nodes(spark, d):
    templates = {"en": "Read {{ data }}", "fr": "Lisez {{ data }}", "de": "Lies {{ data }}"}
    items = load(spark, d, "documents").select("doc_id", "lang", "text")
    return pr.render_nodes(items, templates, node="lang").select("doc_id", "prompt")


def assemble_messages(spark, d):
    rows = views.attempts(spark, d)
    return rows.select("ord", F.to_json(pr.messages(F.col("output"), F.col("critique"))).alias("messages"))


RULES = [Rule("style", "polite", 2.0), Rule("length", "at most 100 words")]


def critic_prompts(spark, d):
    pairs = views.io_pairs(spark, d)
    chat = pr.critic_messages("answer", F.col("input"), F.col("output"), RULES)
    return pairs.select("conv_id", "turn", F.element_at(chat, -1)["content"].alias("request"), F.size(chat).alias("n"))


def batch_requests(spark, d):
    docs = load(spark, d, "documents")
    chat = pr.messages(pr.render(F.col("text"), "Summarise: {{ data }}"))
    return docs.select("doc_id", pr.batch_line(F.col("doc_id"), F.lit("gpt-4o-mini"), chat).alias("line"))


def embedding_requests(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", pr.embedding_line(F.col("doc_id"), F.lit("embed"), F.col("text")).alias("line"))


def batch_file_roundtrip(spark, d):
    """Requests written as batch files and read back: one line per document, none lost or split."""
    path = fresh_path(spark, "batch")
    pr.write_batch_files(batch_requests(spark, d), path, 1_000)
    back = pr.read_batch_lines(spark, path)
    return back.select(F.get_json_object("line", "$.custom_id").cast("bigint").alias("doc_id"),
                       F.get_json_object("line", "$.body.messages[0].content").alias("content"))


def result_lines(spark, d):
    """Result lines for the documents: answers, errors, empty answers, broken lines and blank lines."""
    return load(spark, d, "documents").select("doc_id", F.expr("""CASE doc_id % 6
        WHEN 0 THEN concat('{"custom_id": "', doc_id, '", "response": {"body": {"choices": [{"message": {"content": "answer ', doc_id,
          '"}}], "usage": {"prompt_tokens": ', n_chars, ', "completion_tokens": 7}}}, "error": null}')
        WHEN 1 THEN concat('{"custom_id": "', doc_id, '", "response": null, "error": "rate limit"}')
        WHEN 2 THEN concat('{"custom_id": "', doc_id, '", "response": {"body": {"choices": []}}}')
        WHEN 3 THEN concat('{"custom_id": "', doc_id, '", "response": {"bo')
        WHEN 4 THEN '   ' ELSE concat('{"custom_id": "x', doc_id, '", "response": {"body": {"choices": [{"message": {"content": "late"}}]}}}')
        END""").alias("line"))


def parse_batch_results(spark, d):
    return pr.parse_batch_results(result_lines(spark, d))


def _reconciled(spark, d):
    requests = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("custom_id"))
    return pr.reconcile(requests, parse_batch_results(spark, d))


def reconcile_batch(spark, d):
    return _reconciled(spark, d)


def batch_progress(spark, d):
    return pr.progress(_reconciled(spark, d))


QUERIES = {
    "render_prompts": render_prompts, "render_nodes": render_nodes, "assemble_messages": assemble_messages,
    "critic_prompts": critic_prompts, "batch_requests": batch_requests, "embedding_requests": embedding_requests,
    "batch_file_roundtrip": batch_file_roundtrip, "parse_batch_results": parse_batch_results,
    "reconcile_batch": reconcile_batch, "batch_progress": batch_progress,
}

RESULTS = """results AS (SELECT doc_id, CASE doc_id % 6 WHEN 3 THEN 'unknown' WHEN 5 THEN 'x' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS custom_id,
  CASE doc_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' WHEN 2 THEN 'empty' WHEN 3 THEN 'unparsed' ELSE 'ok' END AS status,
  CASE doc_id % 6 WHEN 0 THEN 'answer ' || doc_id WHEN 5 THEN 'late' END AS content,
  CASE doc_id % 6 WHEN 0 THEN n_chars ELSE 0 END AS prompt_tokens,
  CAST(CASE doc_id % 6 WHEN 0 THEN 7 ELSE 0 END AS BIGINT) AS completion_tokens,
  CASE doc_id % 6 WHEN 1 THEN 'rate limit' WHEN 3 THEN 'not JSON: {"custom_id": "' || doc_id || '", "response": {"bo' END AS error
  FROM documents WHERE doc_id % 6 <> 4)"""

RECONCILED = RESULTS + """, a AS (SELECT custom_id, max(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS ok, count(*) AS n_results FROM results GROUP BY custom_id),
 rec AS (SELECT coalesce(CAST(d.doc_id AS VARCHAR), a.custom_id) AS custom_id, coalesce(n_results, 0) AS n_results,
  CASE WHEN d.doc_id IS NULL THEN 'unexpected' WHEN ok IS NULL THEN 'missing' WHEN ok = 1 THEN 'matched' ELSE 'failed' END AS outcome
  FROM documents d FULL JOIN a ON a.custom_id = CAST(d.doc_id AS VARCHAR))"""

ORACLES = {
    "render_prompts": "SELECT doc_id, 'Summarise:' || chr(10) || text || chr(10) || '--' || chr(10) || 'Again: ' || text AS prompt FROM documents",
    "render_nodes": "SELECT doc_id, CASE lang WHEN 'en' THEN 'Read ' || text WHEN 'fr' THEN 'Lisez ' || text WHEN 'de' THEN 'Lies ' || text END AS prompt FROM documents",
    "assemble_messages": f"""WITH {ATTEMPTS} SELECT ord, CAST(to_json(CASE WHEN critique IS NULL THEN [{{'role': 'user', 'content': output}}] ELSE
 [{{'role': 'system', 'content': 'The previous attempt did not pass. Feedback:' || chr(10) || critique || chr(10) || chr(10)
 || 'Correct the output so that every check passes.'}}, {{'role': 'user', 'content': output}}] END) AS VARCHAR) AS messages FROM attempts""",
    "critic_prompts": f"""WITH {IO_PAIRS} SELECT conv_id, turn, 2 AS n, 'Task: answer' || chr(10) || 'Input: ' || input || chr(10) || 'Output: ' || output
 || chr(10) || 'Rules:' || chr(10) || '- [style] weight 2.0: polite' || chr(10) || '- [length] weight 1.0: at most 100 words' AS request FROM io_pairs""",
    "batch_requests": """SELECT doc_id, CAST(to_json({'custom_id': CAST(doc_id AS VARCHAR), 'method': 'POST', 'url': '/v1/chat/completions',
 'body': {'model': 'gpt-4o-mini', 'messages': [{'role': 'user', 'content': 'Summarise: ' || text}], 'temperature': 0.1::DOUBLE, 'max_tokens': 4096}}) AS VARCHAR) AS line FROM documents""",
    "embedding_requests": """SELECT doc_id, CAST(to_json({'custom_id': CAST(doc_id AS VARCHAR), 'method': 'POST', 'url': '/v1/embeddings',
 'body': {'model': 'embed', 'input': text}}) AS VARCHAR) AS line FROM documents""",
    "batch_file_roundtrip": "SELECT doc_id, 'Summarise: ' || text AS content FROM documents",
    "parse_batch_results": f"WITH {RESULTS} SELECT custom_id, status, content, prompt_tokens, completion_tokens, error FROM results",
    "reconcile_batch": f"WITH {RECONCILED} SELECT * FROM rec",
    "batch_progress": f"WITH {RECONCILED} SELECT outcome, count(*) AS n FROM rec GROUP BY outcome",
}
