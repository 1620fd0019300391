"""Registered queries of the version and distillation families and their SQL twins."""

from pyspark.sql import functions as F

from tallymill.functions.basic import no_scores
from tallymill.operators import distill, versions as ve
from tallymill.operators.evaluators import Dimension, judge
from tallymill.functions import scoring as sc
from tallymill.session import checkpointed, fresh_path, load
from tallymill.suite import views
from tallymill.suite.scoring import COMPLETE
from tallymill.suite.views import ATTEMPTS, TRACES


def version_log(spark, d):
    """Region by region, every nation name is one more version of the region's prompt."""
    changes = load(spark, d, "nation").select(
        F.col("n_regionkey").alias("node_id"), F.col("n_nationkey").alias("at"), F.col("n_name").alias("template"),
        F.concat(F.lit("add "), "n_name").alias("change_log"), no_scores().alias("stats"))
    return ve.append_versions(None, changes, "at")


def append_versions(spark, d):
    """Customers' market segments append further versions to the log of their region."""
    segments = load(spark, d, "customer").join(load(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    changes = (segments.groupBy(F.col("n_regionkey").alias("node_id"), F.col("c_mktsegment").alias("template"))
               .agg(F.min("c_custkey").alias("at"))
               .withColumns({"change_log": F.lit("segment"), "stats": no_scores()}))
    log = version_log(spark, d)
    return log.unionByName(ve.append_versions(log, changes, "at")).drop("stats")


def current_versions(spark, d):
    return ve.current_versions(version_log(spark, d)).select("node_id", "version_id", "hash", "template")


def version_history(spark, d):
    return ve.version_history(version_log(spark, d))


def lineage(spark, d):
    return ve.lineage(version_log(spark, d))


def results(spark, d):
    """Orders as results: the order's customer key picks node and version."""
    return load(spark, d, "orders").select(
        (F.col("o_custkey") % 5).cast("int").alias("node_id"),
        F.concat(F.lit("v1."), (F.col("o_orderkey") % 5).cast("string")).alias("version_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("success"))


def version_stats(spark, d):
    log = ve.merge_stats(version_log(spark, d), ve.version_results(results(spark, d)))
    return log.select("node_id", "version_id", F.element_at("stats", "pass_rate").alias("pass_rate"),
                      F.element_at("stats", "total_processed").alias("total_processed"))


def version_tree_nodes(spark, d):
    return ve.tree_nodes(version_log(spark, d)).drop("stats")


def version_tree_edges(spark, d):
    return ve.tree_edges(version_log(spark, d))


def version_compare(spark, d):
    return ve.compare_versions(ve.merge_stats(version_log(spark, d), ve.version_results(results(spark, d))))


def critique_patterns(spark, d):
    return ve.critique_patterns(views.attempts(spark, d), ["mission_id"], "ord")


def _node_critiques(spark, d):
    return views.attempts(spark, d).withColumn("node_id", (F.col("mission_id") % 5).cast("int")).filter("critique IS NOT NULL")


def improvement_requests(spark, d):
    critiques = _node_critiques(spark, d)
    return ve.improvement_requests(version_log(spark, d), critiques, ve.critique_patterns(critiques, ["node_id"], "ord"), "ord")


def apply_suggestions(spark, d):
    accepted = ve.critique_patterns(_node_critiques(spark, d), ["node_id"], "ord").withColumn(
        "template", F.concat(F.lit("avoid "), "pattern"))
    rows = ve.apply_suggestions(version_log(spark, d), accepted)
    return rows.select("node_id", "version_id", "parent_id", "template", "change_log",
                       F.element_at("stats", "frequency").alias("frequency"), F.element_at("stats", "confidence").alias("confidence"))


def open_critiques(spark, d):
    critiques = _node_critiques(spark, d)
    applied = critiques.groupBy("node_id").agg(F.expr("percentile(ord, 0.5)").cast("bigint").alias("applied_at"))
    left = ve.open_critiques(critiques, applied, ["node_id"], "ord")
    return left.groupBy("node_id").agg(F.count("*").alias("n_open"))


def full_traces(spark, d):
    """Traces with their first output as input; stored, as a finished run's traces are."""
    return checkpointed(views.attempts(spark, d).groupBy("mission_id", "item_id").agg(
        F.min("ord").alias("ord"), F.count("*").alias("iterations"),
        F.max(F.col("passed").cast("int")).alias("success"), F.max_by("score", "attempt").alias("last_score"),
        F.min_by("output", "attempt").alias("input"), F.max_by("output", "attempt").alias("output")))


def golden_samples(spark, d):
    return distill.golden_samples(views.traces(spark, d), ["mission_id"], "ord").select("mission_id", "item_id", "last_score")


def golden_samples_overall(spark, d):
    return distill.golden_samples(views.traces(spark, d), [], "ord").select("item_id", "last_score")


def run_stats(spark, d):
    return distill.run_stats(views.traces(spark, d), ["mission_id"])


def packages(spark, d):
    traces = full_traces(spark, d)
    prompts = traces.select("mission_id").distinct().withColumns({
        "name": F.concat(F.lit("mission "), F.col("mission_id").cast("string")),
        "prompt": F.concat(F.lit("Handle "), F.col("mission_id").cast("string"), F.lit(": {{ data }}"))})
    return distill.skill_packages(traces, prompts, "mission_id", "ord", {"model": "gpt-4o-mini"}, [("regex", "[0-9]")])


def skill_packages(spark, d):
    made = packages(spark, d)
    return made.select("mission_id", F.to_json(F.struct(*[c for c in made.columns if c != "mission_id"])).alias("package"))


def skill_catalog(spark, d):
    path = fresh_path(spark, "skills")
    distill.write_skills(packages(spark, d), path, "2024-02-01T00:00:00Z")
    return distill.list_skills(distill.read_skills(spark, path))


def apply_skills(spark, d):
    """Missions as nodes; two in three refer to a skill, of which one does not exist."""
    nodes = views.traces(spark, d).select("mission_id").distinct().select(
        F.col("mission_id").alias("node_id"), F.expr("""CASE mission_id % 3 WHEN 0 THEN NULL WHEN 1 THEN
          concat('SKILL-', substring(sha2(concat('Handle ', CAST(mission_id AS STRING), ': {{ data }}'), 256), 1, 12))
          ELSE 'SKILL-none' END""").alias("skill_ref"), F.lit("plain").alias("template"),
        F.array().cast("array<struct<type:string,criteria:string>>").alias("rules"))
    merged = distill.apply_skills(nodes, packages(spark, d))
    return merged.select("node_id", "template", F.size("rules").alias("n_rules"), "skill_missing")


def scored_pairs(spark, d):
    judged = judge(views.io_pairs(spark, d), [Dimension("completeness", 1.0, sc.completeness)], 0.3)
    return judged.select("conv_id", "turn", "input", "output", F.col("passed").cast("int").alias("success"),
                         F.element_at("scores", "completeness").alias("last_score"))


def training_records(spark, d):
    pairs = scored_pairs(spark, d)
    made = [distill.training_records(pairs, shape, 0.35).withColumn("shape", F.lit(shape))
            for shape in ("messages", "instruction", "conversation")]
    return made[0].unionByName(made[1]).unionByName(made[2]).select("shape", "conv_id", "turn", "record")


def distil_worthy(spark, d):
    return distill.distil_worthy(views.traces(spark, d), ["mission_id"], 0.85, 5).select("mission_id", "item_id")


QUERIES = {
    "append_versions": append_versions, "current_versions": current_versions, "version_history": version_history, "lineage": lineage,
    "version_stats": version_stats, "version_tree_nodes": version_tree_nodes, "version_tree_edges": version_tree_edges,
    "version_compare": version_compare, "critique_patterns": critique_patterns,
    "improvement_requests": improvement_requests, "apply_suggestions": apply_suggestions,
    "open_critiques": open_critiques, "golden_samples": golden_samples,
    "golden_samples_overall": golden_samples_overall, "run_stats": run_stats, "skill_packages": skill_packages,
    "skill_catalog": skill_catalog, "apply_skills": apply_skills, "training_records": training_records,
    "distil_worthy": distil_worthy,
}

LOG = """log AS (SELECT n_regionkey AS node_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS seq,
  n_name AS template, 'add ' || n_name AS change_log FROM nation),
 versions AS (SELECT *, 'v1.' || (seq - 1) AS version_id, substr(sha256(template), 1, 16) AS hash,
  CASE WHEN seq > 1 THEN 'v1.' || (seq - 2) END AS parent_id FROM log)"""

STATS = LOG + """, stats AS (SELECT CAST(o_custkey % 5 AS INTEGER) AS node_id, 'v1.' || (o_orderkey % 5) AS version_id,
  avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS pass_rate, CAST(count(*) AS DOUBLE) AS total_processed
  FROM orders GROUP BY 1, 2)"""


def _patterns(by: str, source: str) -> str:
    return f"""SELECT {by}, pattern, frequency, least(1.0::DOUBLE, frequency / 10.0::DOUBLE) AS confidence FROM (
 SELECT {by}, pattern, frequency, row_number() OVER (PARTITION BY {by} ORDER BY frequency DESC, first_seen) AS k FROM (
  SELECT {by}, trim(substr(trim(critique), 1, 5)) AS pattern, count(*) AS frequency, min(ord) AS first_seen
  FROM {source} WHERE critique IS NOT NULL GROUP BY 1, 2) WHERE pattern <> '') WHERE k = 1 AND frequency >= 3"""


NODE_CRITIQUES = ATTEMPTS + """, nc AS (SELECT CAST(mission_id % 5 AS INTEGER) AS node_id, * FROM attempts WHERE critique IS NOT NULL)"""
BEST = "SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY last_score DESC, ord) AS k FROM traces WHERE success = 1"
RUN_STATS = """SELECT mission_id, count(*) AS total, round(avg(success), 4) AS success_rate,
 round(CAST(sum(iterations) AS DOUBLE) / count(*), 2) AS average_retries FROM traces GROUP BY mission_id"""
TEXTS = """texts AS (SELECT item_id, arg_min(output, attempt) AS input, arg_max(output, attempt) AS output FROM attempts GROUP BY item_id)"""
SKILL = "'SKILL-' || substr(sha256('Handle ' || mission_id || ': {{ data }}'), 1, 12)"
TRAIN = "FROM complete WHERE completeness >= 0.35"

ORACLES = {
    "append_versions": """WITH ch AS (SELECT n_regionkey AS node_id, 0 AS wave, n_nationkey AS at_key, n_name AS template, 'add ' || n_name AS change_log
  FROM nation UNION ALL SELECT n_regionkey, 1, min(c_custkey), c_mktsegment, 'segment' FROM customer JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_regionkey, c_mktsegment), l AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY wave, at_key) AS seq FROM ch)
SELECT node_id, seq, 'v1.' || (seq - 1) AS version_id, substr(sha256(template), 1, 16) AS hash, template,
 CASE WHEN seq > 1 THEN 'v1.' || (seq - 2) END AS parent_id, change_log FROM l""",
    "current_versions": f"WITH {LOG} SELECT node_id, version_id, hash, template FROM versions v WHERE seq = (SELECT max(seq) FROM log l WHERE l.node_id = v.node_id)",
    "version_history": f"""WITH {LOG} SELECT node_id, seq, version_id, change_log, hash IS DISTINCT FROM lag(hash) OVER w AS changed,
 seq = max(seq) OVER (PARTITION BY node_id) AS is_current FROM versions WINDOW w AS (PARTITION BY node_id ORDER BY seq)""",
    "lineage": """WITH RECURSIVE """ + LOG + """, chain AS (SELECT node_id, seq, version_id, parent_id, hash FROM versions v
  WHERE seq = (SELECT max(seq) FROM log l WHERE l.node_id = v.node_id) UNION ALL
  SELECT v.node_id, v.seq, v.version_id, v.parent_id, v.hash FROM chain c JOIN versions v ON v.node_id = c.node_id AND v.version_id = c.parent_id)
SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY seq) AS depth FROM chain""",
    "version_stats": f"WITH {STATS} SELECT v.node_id, v.version_id, pass_rate, total_processed FROM versions v LEFT JOIN stats s ON s.node_id = v.node_id AND s.version_id = v.version_id",
    "version_tree_nodes": f"WITH {LOG} SELECT node_id, version_id, substr(template, 1, 80) AS template_preview, change_log FROM versions",
    "version_tree_edges": f"WITH {LOG} SELECT node_id, parent_id AS from_version, version_id AS to_version FROM versions WHERE parent_id IS NOT NULL",
    "version_compare": f"""WITH {STATS}, j AS (SELECT v.*, s.pass_rate FROM versions v LEFT JOIN stats s ON s.node_id = v.node_id AND s.version_id = v.version_id),
 r AS (SELECT node_id, min(seq) AS a, max(seq) AS b FROM j GROUP BY node_id HAVING count(*) >= 2)
SELECT r.node_id, x.version_id AS first_version, x.pass_rate AS first_rate, y.version_id AS last_version, y.pass_rate AS last_rate
 FROM r JOIN j x ON x.node_id = r.node_id AND x.seq = r.a JOIN j y ON y.node_id = r.node_id AND y.seq = r.b""",
    "critique_patterns": f"WITH {ATTEMPTS} " + _patterns("mission_id", "attempts"),
    "improvement_requests": f"""WITH {NODE_CRITIQUES}, {LOG}, p AS ({_patterns('node_id', 'nc')}),
 recent AS (SELECT node_id, string_agg('- ' || critique, chr(10) ORDER BY ord) AS r FROM (SELECT *,
  row_number() OVER (PARTITION BY node_id ORDER BY ord DESC) AS k FROM nc) WHERE k <= 20 GROUP BY node_id)
SELECT p.node_id, 'Current prompt:' || chr(10) || v.template || chr(10) || chr(10) || 'Recurring critique (' || frequency || ' times): ' || pattern
 || chr(10) || 'Latest critiques:' || chr(10) || r || chr(10) || chr(10)
 || 'Write an improved prompt. Keep the {{{{ data }}}} variable. Reply with the prompt only.' AS request
 FROM p JOIN recent USING (node_id) JOIN versions v ON v.node_id = p.node_id
 WHERE v.seq = (SELECT max(seq) FROM log l WHERE l.node_id = p.node_id)""",
    "apply_suggestions": f"""WITH {NODE_CRITIQUES}, {LOG}, p AS ({_patterns('node_id', 'nc')}), t AS (SELECT node_id, max(seq) AS s FROM log GROUP BY node_id)
SELECT p.node_id, 'v1.' || s AS version_id, 'v1.' || (s - 1) AS parent_id, 'avoid ' || pattern AS template, 'healing: ' || pattern AS change_log,
 CAST(frequency AS DOUBLE) AS frequency, confidence FROM p JOIN t USING (node_id)""",
    "open_critiques": f"""WITH {NODE_CRITIQUES}, a AS (SELECT node_id, CAST(trunc(quantile_cont(ord, 0.5)) AS BIGINT) AS applied_at FROM nc GROUP BY node_id)
SELECT nc.node_id, count(*) AS n_open FROM nc JOIN a ON a.node_id = nc.node_id WHERE ord > applied_at GROUP BY nc.node_id""",
    "golden_samples": f"WITH {TRACES} SELECT mission_id, item_id, last_score FROM ({BEST}) WHERE k <= 5",
    "golden_samples_overall": f"WITH {TRACES} SELECT item_id, last_score FROM traces WHERE success = 1 ORDER BY last_score DESC, ord LIMIT 5",
    "run_stats": f"WITH {TRACES} {RUN_STATS}",
    "skill_packages": f"""WITH {TRACES}, {TEXTS}, s AS ({RUN_STATS}), g AS (SELECT b.mission_id,
  list({{'input_preview': substr(input, 1, 200), 'output': output, 'score': round(last_score, 4)}} ORDER BY k) AS golden
  FROM ({BEST}) b JOIN texts USING (item_id) WHERE k <= 5 GROUP BY b.mission_id)
SELECT mission_id, CAST(to_json({{'skill_id': {SKILL}, 'name': 'mission ' || mission_id,
 'optimized_prompt': 'Handle ' || mission_id || ': {{{{ data }}}}', 'model_config': {{'model': 'gpt-4o-mini'}},
 'validation_rules': [{{'type': 'regex', 'criteria': '[0-9]'}}], 'golden_samples': golden,
 'performance_stats': {{'total': total, 'success_rate': success_rate, 'average_retries': average_retries}}}}) AS VARCHAR) AS package
 FROM s JOIN g USING (mission_id)""",
    "skill_catalog": f"""WITH {TRACES}, s AS ({RUN_STATS}) SELECT {SKILL} AS skill_id, 'mission ' || mission_id AS name, total, success_rate,
 CAST((SELECT least(5, count(*)) FROM traces t WHERE t.mission_id = s.mission_id AND success = 1) AS INTEGER) AS n_samples FROM s""",
    "apply_skills": """SELECT user_id AS node_id, CASE user_id % 3 WHEN 1 THEN 'Handle ' || user_id || ': {{ data }}' ELSE 'plain' END AS template,
 CASE user_id % 3 WHEN 1 THEN 1 ELSE 0 END AS n_rules, user_id % 3 = 2 AS skill_missing FROM (SELECT DISTINCT user_id FROM events)""",
    "training_records": f"""WITH {COMPLETE}
SELECT 'messages' AS shape, conv_id, turn, CAST(to_json({{'messages': [{{'role': 'user', 'content': input}}, {{'role': 'assistant', 'content': output}}]}}) AS VARCHAR) AS record {TRAIN}
UNION ALL SELECT 'instruction', conv_id, turn, CAST(to_json({{'instruction': input, 'input': '', 'output': output}}) AS VARCHAR) {TRAIN}
UNION ALL SELECT 'conversation', conv_id, turn, CAST(to_json({{'conversations': [{{'from': 'human', 'value': input}}, {{'from': 'gpt', 'value': output}}]}}) AS VARCHAR) {TRAIN}""",
    "distil_worthy": f"""WITH {TRACES} SELECT mission_id, item_id FROM traces WHERE mission_id IN (SELECT mission_id FROM traces
 GROUP BY mission_id HAVING avg(success) > 0.85 AND count(*) >= 5)""",
}
