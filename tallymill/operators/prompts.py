"""Rendered prompts, chat messages, and the request and result files of batch services."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import jsons
from tallymill.operators.rules import Rule

_SLOT = re.compile(r"\{\{\s*data\s*\}\}")
SLOT = "{{ data }}"


def normal_template(template: str) -> str:
    """The template with its data slots spelled alike; any other template syntax is an error."""
    plain = _SLOT.sub(SLOT, template)
    if re.search(r"\{\{|\{%|\{#|\}\}", plain.replace(SLOT, "")):
        raise ValueError("templates may only use {{ data }}")
    return plain


def render(text: Column, template: str) -> Column:
    """The template with the text in every data slot."""
    parts = normal_template(template).split(SLOT)
    pieces = [F.lit(parts[0])]
    for part in parts[1:]:
        pieces += [text, F.lit(part)]
    return F.concat(*pieces)


def render_nodes(items: DataFrame, templates: dict[str, str], node: str = "node_id", text: str = "text",
                 into: str = "prompt") -> DataFrame:
    """Prompts by the template of each row's node; null for a node without one."""
    prompt = F.lit(None).cast("string")
    for name, template in templates.items():
        prompt = F.when(F.col(node) == name, render(F.col(text), template)).otherwise(prompt)
    return items.withColumn(into, prompt)


def messages(prompt: Column, feedback: Column | None = None) -> Column:
    """Chat messages: the last feedback, where there is any, as a system message, then the prompt."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    user = message("user", prompt)
    if feedback is None:
        return F.array(user)
    told = message("system", F.concat(
        F.lit("The previous attempt did not pass. Feedback:\n"), feedback,
        F.lit("\n\nCorrect the output so that every check passes.")))
    return F.array_compact(F.array(F.when(F.length(feedback) > 0, told), user))


def critic_messages(task: str, input: Column, output: Column, rules: list[Rule]) -> Column:
    """Messages asking a judging model to audit an output against rules and to answer in JSON."""
    listed = "\n".join(f"- [{r.kind}] weight {r.weight}: {r.criteria}" for r in rules)
    system = ("You audit generated content against the user's rules. Answer with one JSON object: passed (boolean), "
              "score (0.0-1.0), scores (object of 0.0-1.0 by dimension), critique (string, empty when passed), "
              "suggestions (list of strings).")
    user = F.concat(F.lit(f"Task: {task}\nInput: "), input, F.lit("\nOutput: "), output, F.lit(f"\nRules:\n{listed}"))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))


CHAT_URL = "/v1/chat/completions"
EMBEDDING_URL = "/v1/embeddings"


def _request(custom_id: Column, url: str, body: Column) -> Column:
    return F.to_json(F.struct(custom_id.cast("string").alias("custom_id"), F.lit("POST").alias("method"),
                              F.lit(url).alias("url"), body.alias("body")), {"ignoreNullFields": "false"})


def batch_line(custom_id: Column, model: Column, chat: Column, temperature: float = 0.1,
               max_tokens: int = 4096) -> Column:
    """One chat request as a JSON line."""
    return _request(custom_id, CHAT_URL, F.struct(
        model.alias("model"), chat.alias("messages"), F.lit(temperature).alias("temperature"),
        F.lit(max_tokens).alias("max_tokens")))


def embedding_line(custom_id: Column, model: Column, text: Column) -> Column:
    """One embedding request as a JSON line."""
    return _request(custom_id, EMBEDDING_URL, F.struct(model.alias("model"), text.alias("input")))


def write_batch_files(lines: DataFrame, path: str, per_file: int = 50_000) -> None:
    """Request lines as text files of at most ``per_file`` requests, the services' upload limit."""
    lines.select("line").write.mode("append").option("maxRecordsPerFile", per_file).text(path)


def read_batch_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


_RESULT = """custom_id string, error string, response struct<body: struct<
  choices: array<struct<message: struct<content: string>>>,
  usage: struct<prompt_tokens: bigint, completion_tokens: bigint>>>"""
_NO_ERROR = ("", "null", "false", "0", "{}", "[]")
ERROR_PREVIEW = 100


def parse_batch_results(lines: DataFrame, line: str = "line") -> DataFrame:
    """Result lines as custom_id, status, content, prompt_tokens, completion_tokens, error.

    Blank lines are skipped. Status is ok, error, empty (neither error nor choice) or unparsed (no
    JSON object; custom_id ``unknown``, the error quotes the line's beginning). No line is lost.
    """
    rows = (lines.filter(F.trim(F.regexp_replace(line, r"\s", "")) != "")
            .withColumn("_ok", jsons.is_json_object(F.col(line)))
            .withColumn("_r", F.when(F.col("_ok"), F.from_json(line, _RESULT))))
    error = F.when(~F.coalesce(F.col("_r.error"), F.lit("")).isin(*_NO_ERROR), F.col("_r.error"))
    body = F.col("_r.response.body")
    has_choice = F.coalesce(F.size(body["choices"]), F.lit(0)) > 0
    status = (F.when(~F.col("_ok"), "unparsed").when(error.isNotNull(), "error")
              .when(has_choice, "ok").otherwise("empty"))
    parsed = rows.withColumn("status", status)
    ok = F.col("status") == "ok"
    quoted = F.concat(F.lit("not JSON: "), F.substring(line, 1, ERROR_PREVIEW))
    return parsed.select(
        F.when(F.col("_ok"), F.coalesce(F.col("_r.custom_id"), F.lit(""))).otherwise("unknown").alias("custom_id"), "status",
        F.when(ok, F.coalesce(body["choices"][0]["message"]["content"], F.lit(""))).alias("content"),
        F.when(ok, F.coalesce(body["usage"]["prompt_tokens"], F.lit(0))).otherwise(0).alias("prompt_tokens"),
        F.when(ok, F.coalesce(body["usage"]["completion_tokens"], F.lit(0))).otherwise(0).alias("completion_tokens"),
        F.when(F.col("status") == "error", error).when(F.col("status") == "unparsed", quoted).alias("error"))


def reconcile(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Every request and result by custom_id: matched, failed, missing (no result) or unexpected
    (no request). The ``unknown`` id may repeat without end, so unparsed results are counted first."""
    answered = results.groupBy("custom_id").agg(
        F.max(F.when(F.col("status") == "ok", 1).otherwise(0)).alias("ok"), F.count("*").alias("n_results"))
    both = requests.select("custom_id", F.lit(1).alias("asked")).join(answered, "custom_id", "full")
    return both.select("custom_id", F.coalesce("n_results", F.lit(0)).alias("n_results"),
                       F.when(F.col("asked").isNull(), "unexpected").when(F.col("ok").isNull(), "missing")
                       .when(F.col("ok") == 1, "matched").otherwise("failed").alias("outcome"))


def progress(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("outcome").agg(F.count("*").alias("n"))
