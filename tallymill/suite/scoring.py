"""Registered queries of the validation and scoring family and their SQL twins."""

from pyspark.sql import functions as F

from tallymill.functions import scoring as sc
from tallymill.functions.basic import no_scores
from tallymill.operators import evaluators as ev
from tallymill.operators import rules as ru
from tallymill.operators.rules import Rule
from tallymill.session import load
from tallymill.suite import views
from tallymill.suite.views import ATTEMPTS, IO_PAIRS, SCORES, VOTES

PAIR = ["conv_id", "turn"]
PAIR_RULES = [Rule("regex", "[0-9]"), Rule("regex", "^[A-Z]"), Rule("regex", "(unclosed"),
              Rule("expression", "length(output) >= 40", name="long_enough")]


LONG_PATTERN = "|".join(f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "thrx")


def regex_rules(spark, d):
    """A digit, a capital, a pattern that is none, and an alternation of over 500 characters."""
    rules = [*PAIR_RULES[:3], Rule("regex", f"({LONG_PATTERN}|no such ending)[a-z]*[.]$", name="long")]
    checked = ru.apply_rules(views.io_pairs(spark, d), rules)
    return checked.select(*PAIR, "rules_passed", *[
        F.element_at("rule_scores", r.key).alias(n) for r, n in zip(rules, ("digit", "capital", "invalid", "long"))],
        F.array_join("rule_errors", ",").alias("errors"))


def json_outputs(spark, d):
    """Event properties as model outputs; some are broken in ways a lenient parser would accept."""
    return load(spark, d, "events").select("event_id", F.expr("""CASE event_type
        WHEN 'click' THEN props WHEN 'view' THEN concat(props, ' trailing')
        WHEN 'purchase' THEN concat('{"k": null, "v": ', CAST(event_id AS STRING), '}')
        WHEN 'signup' THEN concat('["k", ', CAST(event_id AS STRING), ']') ELSE '12' END""").alias("output"))


def json_rules(spark, d):
    checked = ru.apply_rules(json_outputs(spark, d), [Rule("json", ["k"], name="has_k"), Rule("json", None, name="parses")])
    return checked.select("event_id", "rules_passed", *[
        F.element_at("rule_scores", n).alias(n) for n in ("has_k", "parses")])


def expression_rules(spark, d):
    rules = [Rule("expression", "length(output) > length(input)", name="longer"),
             Rule("expression", "contains(lower(output), 'the')", name="has_the")]
    checked = ru.apply_rules(views.io_pairs(spark, d), rules)
    return checked.select(*PAIR, "rules_passed", *[F.element_at("rule_scores", r.name).alias(r.name) for r in rules])


def rule_outcome(spark, d):
    checked = ru.apply_rules(views.io_pairs(spark, d), [PAIR_RULES[0], PAIR_RULES[1], PAIR_RULES[3]])
    weighted = sc.weighted_score(F.col("rule_scores"), {"long_enough": 2.0})
    return checked.select(*PAIR, "rules_passed", weighted.alias("weighted"))


def rule_report(spark, d):
    docs = views.documents(spark, d, "lang").withColumnRenamed("text", "output")
    rules = [Rule("regex", "[0-9]", name="digit"), Rule("regex", "^[A-Z]", name="capital"),
             Rule("expression", "length(output) >= 400", name="long_enough")]
    return ru.rule_report(ru.apply_rules(docs, rules), ["lang"])


def _score_map(df):
    return df.withColumn("scores", F.create_map(F.lit("quality"), F.col("quality"), F.lit("safety"), F.col("safety")))


def weighted_scores(spark, d):
    rows = _score_map(views.scores(spark, d))
    m = F.col("scores")
    return rows.select("doc_id", sc.weighted_score(m).alias("plain"),
                       sc.weighted_score(m, {"quality": 2.0}).alias("quality_first"),
                       sc.weighted_score(m, {"quality": 0.0, "safety": 0.0}).alias("weightless"),
                       sc.weighted_score(F.map_filter(m, lambda k, v: v < 0)).alias("empty"))


def min_score_gate(spark, d):
    rows = views.attempts(spark, d)
    m = F.when(F.col("ord") % 10 == 0, no_scores()).otherwise(
        F.create_map(F.lit("score"), F.col("score")))
    gated = ru.min_score_gate(rows.withColumn("scores", m), F.col("scores"), 0.7)
    return gated.select("ord", "passed", "weighted")


def reports(spark, d):
    """Judging reports made from labels and events: good ones, out-of-range scores, broken JSON."""
    return load(spark, d, "events").select("event_id", F.expr("""CASE event_id % 5
        WHEN 0 THEN concat('{"passed": true, "score": ', CAST(event_id % 100 / 50.0D AS STRING),
          ', "scores": {"format": 1.5, "tone": 0.25}, "critique": "", "suggestions": ["a", "b"]}')
        WHEN 1 THEN '{"passed": false, "score": 0.25, "scores": [], "critique": "too long"}'
        WHEN 2 THEN '{"passed": true, "score": "many"}'
        WHEN 3 THEN '{"passed": true} and more'
        ELSE '{"passed": true, "critique": "fine"}' END""").alias("report"),
        F.col("event_id").alias("prompt_tokens"), F.lit(5).cast("bigint").alias("completion_tokens"))


def critic_reports(spark, d):
    parsed = ru.parse_reports(reports(spark, d))
    return parsed.select("event_id", "passed", "score", F.try_element_at("scores", F.lit("format")).alias("format"),
                         F.try_element_at("scores", F.lit("tone")).alias("tone"), "critique",
                         F.size("suggestions").alias("n_suggestions"), "audit_cost")


def consensus_votes(spark, d):
    votes = views.votes(spark, d).select(
        "item", "judge", "passed", "score", F.create_map(
            F.lit("overall"), F.col("score"), F.lit("rest"), F.lit(1.0) - F.col("score")).alias("scores"),
        F.concat(F.lit("judge "), F.col("judge").cast("string")).alias("critique"))
    verdict = ru.consensus(votes, ["item"], 0.5, F.col("judge") == 1)
    return verdict.select("item", "passed", "yes", "n_votes", "score", "critique",
                          F.element_at("scores", "overall").alias("overall"), F.element_at("scores", "rest").alias("rest"))


def _documents_scored(spark, d, evaluator, name):
    docs = views.documents(spark, d)
    return docs.select("doc_id", evaluator(F.lit(""), F.col("text")).alias(name))


def safety_scores(spark, d):
    return _documents_scored(spark, d, sc.safety, "safety")


def code_style_scores(spark, d):
    pages = views.pages(spark, d).toDF("doc_id", "text")
    docs = views.documents(spark, d)
    both = docs.withColumn("kind", F.lit("document")).unionByName(pages.withColumn("kind", F.lit("page")))
    return both.select("kind", "doc_id", sc.code_style(F.lit(""), F.col("text")).alias("style"))


def code_quality_scores(spark, d):
    return _documents_scored(spark, d, sc.code_quality, "quality")


def code_outputs(spark, d):
    """Python texts made from events: sound ones, ones with a broken line, and plain words."""
    return load(spark, d, "events").select("event_id", F.expr("""CASE event_id % 3
        WHEN 0 THEN concat('def score_', event_id, '(x):\n    return x + ', event_id, '\n')
        WHEN 1 THEN concat('def score_', event_id, '(x)\n    return x + ', event_id, '\n')
        ELSE concat('the ', event_type, ' number ', event_id) END""").alias("output"))


def code_syntax_scores(spark, d):
    return code_outputs(spark, d).select("event_id", sc.code_quality(F.lit(""), F.col("output")).alias("quality"))


def completeness_scores(spark, d):
    return views.io_pairs(spark, d).select(*PAIR, sc.completeness(F.col("input"), F.col("output")).alias("completeness"))


def coherence_scores(spark, d):
    return _documents_scored(spark, d, sc.coherence, "coherence")


def substance_scores(spark, d):
    return views.io_pairs(spark, d).select(*PAIR, sc.substance(F.col("input"), F.col("output")).alias("substance"))


DIMENSIONS = [ev.Dimension("safety", 0.3, sc.safety), ev.Dimension("completeness", 0.5, sc.completeness),
              ev.Dimension("substance", 0.2, sc.substance), ev.Dimension("unset", 0.1)]


def judged(spark, d):
    return ev.judge(views.io_pairs(spark, d), DIMENSIONS, 0.7)


def judge(spark, d):
    return judged(spark, d).select(*PAIR, "weighted_score", "passed", *[
        F.element_at("scores", x.name).alias(x.name) for x in DIMENSIONS])


def score_bands(spark, d):
    return ev.score_rows(judged(spark, d), PAIR)


def score_summaries(spark, d):
    return ev.summary_text(judged(spark, d)).select(*PAIR, "summary")


def score_bars(spark, d):
    return ev.bar_report(judged(spark, d)).select(*PAIR, "report")


def _judged_documents(spark, d):
    docs = views.documents(spark, d, "lang").withColumn("input", F.lit("")).withColumnRenamed("text", "output")
    return ev.judge(docs, [ev.Dimension("safety", 1.0, sc.safety), ev.Dimension("substance", 1.0, sc.substance)])


def corpus_score_report(spark, d):
    return ev.corpus_report(_judged_documents(spark, d), ["lang"])


def validation_report(spark, d):
    return ev.validation_report(_judged_documents(spark, d), ["lang"], 0.7)


QUERIES = {
    "regex_rules": regex_rules, "json_rules": json_rules, "expression_rules": expression_rules,
    "rule_outcome": rule_outcome, "rule_report": rule_report, "weighted_scores": weighted_scores,
    "min_score_gate": min_score_gate, "critic_reports": critic_reports, "consensus_votes": consensus_votes,
    "safety_scores": safety_scores, "code_style_scores": code_style_scores,
    "code_quality_scores": code_quality_scores, "code_syntax_scores": code_syntax_scores, "completeness_scores": completeness_scores,
    "coherence_scores": coherence_scores, "substance_scores": substance_scores, "judge": judge,
    "score_bands": score_bands, "score_summaries": score_summaries, "score_bars": score_bars,
    "corpus_score_report": corpus_score_report, "validation_report": validation_report,
}


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _safety(text: str) -> str:
    patterns = [(r"<script[^>]*>", .3), (r"__import__\s*\(", .3), (r"eval\s*\(", .3), (r"exec\s*\(", .3),
                (r"subprocess\.", .3), (r"os\.system\s*\(", .3), (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", .2),
                (r"\b[0-9]{16}\b", .2), (r"password\s*[:=]\s*\S+", .2),
                (r"\b(hack|exploit|bypass)\s+(auth|security|login)\b", .2),
                (r"\b(drop\s+table|delete\s+from|truncate)\b", .2)]
    ladder = "".join(f" - CASE WHEN regexp_matches({text}, '(?i){p}') THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for p, v in patterns)
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE{ladder}))"


TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
SUBSTANCE = (f"CASE WHEN length({TRIM.format('output')}) < 10 THEN 0.1::DOUBLE "
             f"WHEN length({TRIM.format('output')}) < 50 THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END")
STOP = ("'that','this','with','from','were','been','have','will','would','could','should','might','shall','also',"
        "'just','only','very','really','quite','rather','some','each','every','both','more','most','other',"
        "'another','such','than'")

COMPLETE = IO_PAIRS + f""", asked AS (SELECT DISTINCT conv_id, turn, w FROM (SELECT conv_id, turn,
  unnest(list_transform(regexp_extract_all(input, '[\\p{{L}}\\p{{N}}_]{{4,}}'), lambda x: lower(x))) AS w FROM io_pairs)
  WHERE w NOT IN ({STOP})),
 given AS (SELECT DISTINCT conv_id, turn, w, 1 AS hit FROM (SELECT conv_id, turn,
  unnest(list_transform(regexp_extract_all(output, '[\\p{{L}}\\p{{N}}_]{{4,}}'), lambda x: lower(x))) AS w FROM io_pairs)),
 cover AS (SELECT conv_id, turn, CAST(count(hit) AS DOUBLE) / count(*) AS share FROM asked
  LEFT JOIN given USING (conv_id, turn, w) GROUP BY conv_id, turn),
 complete AS (SELECT p.*, CASE WHEN {TRIM.format('input')} = '' OR {TRIM.format('output')} = '' THEN 0.0::DOUBLE
  WHEN share IS NULL THEN 0.5::DOUBLE ELSE 0.6::DOUBLE * share + 0.4::DOUBLE * (
   CASE WHEN length(output) / length(input) < 0.3 THEN 0.3::DOUBLE WHEN length(output) / length(input) < 0.8 THEN 0.7::DOUBLE
    WHEN length(output) / length(input) > 10.0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END) END AS completeness
  FROM io_pairs p LEFT JOIN cover USING (conv_id, turn))"""

JUDGED = COMPLETE + f""", dims AS (SELECT conv_id, turn, {_safety('output')} AS safety, completeness,
  {SUBSTANCE} AS substance, 0.5::DOUBLE AS unset FROM complete),
 judged AS (SELECT *, (0.0::DOUBLE + safety * 0.3::DOUBLE + completeness * 0.5::DOUBLE + substance * 0.2::DOUBLE
  + unset * 0.1::DOUBLE) / 1.1::DOUBLE AS w FROM dims)"""


def _band(score: str) -> str:
    return (f"CASE WHEN {score} >= 0.9 THEN 'excellent' WHEN {score} >= 0.7 THEN 'good' WHEN {score} >= 0.5 THEN 'fair' "
            f"WHEN {score} >= 0.3 THEN 'poor' ELSE 'failing' END")


def _places(score: str) -> str:
    return f"CAST(CAST(CAST({score} AS DECIMAL(18,6)) AS DECIMAL(18,2)) AS VARCHAR)"


NAMES = ("safety", "completeness", "substance", "unset")
DOC_DIMS = f"""flat AS (SELECT lang, 'safety' AS dimension, {_safety('text')} AS score FROM documents UNION ALL
 SELECT lang, 'substance', {SUBSTANCE.replace('output', 'text')} FROM documents)"""


def _code_style(text: str) -> str:
    stripped = TRIM.format(text)
    return f"""greatest(0.0::DOUBLE, 1.0::DOUBLE
 - CASE WHEN len(string_split({stripped}, chr(10))) > 500 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
 - CASE WHEN len(list_filter(string_split({stripped}, chr(10)), lambda x: regexp_matches(x, '^\\s{{17,}}')))
   > len(string_split({stripped}, chr(10))) * 0.1 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
 - CASE WHEN contains({text}, 'try:') AND NOT contains({text}, 'except') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
 - CASE WHEN regexp_matches({text}, 'except\\s*:') THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
 - CASE WHEN regexp_matches({text}, 'import\\s+\\*') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
 - CASE WHEN regexp_matches({text}, 'global\\s+') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)"""


ORACLES = {
    "regex_rules": f"""WITH {IO_PAIRS} SELECT conv_id, turn, FALSE AS rules_passed, {_flag("regexp_matches(output, '[0-9]')")} AS digit,
 {_flag("regexp_matches(output, '^[A-Z]')")} AS capital, 0.0::DOUBLE AS invalid,
 {_flag(f"regexp_matches(output, '({LONG_PATTERN}|no such ending)[a-z]*[.]$')")} AS long, 'regex:(unclosed' AS errors FROM io_pairs""",
    "json_rules": """WITH o AS (SELECT event_id, CASE event_type WHEN 'click' THEN props WHEN 'view' THEN props || ' trailing'
  WHEN 'purchase' THEN '{"k": null, "v": ' || event_id || '}' WHEN 'signup' THEN '["k", ' || event_id || ']' ELSE '12' END AS output
  FROM events), r AS (SELECT event_id, json_valid(output) AS ok, CASE WHEN NOT json_valid(output) THEN FALSE
  WHEN json_type(output) = 'OBJECT' THEN list_contains(json_keys(output), 'k')
  WHEN json_type(output) = 'ARRAY' THEN list_contains(CAST(json_extract_string(output, '$[*]') AS VARCHAR[]), 'k')
  ELSE FALSE END AS k FROM o)
SELECT event_id, ok AND k AS rules_passed, CAST(k AS INTEGER)::DOUBLE AS has_k, CAST(ok AS INTEGER)::DOUBLE AS parses FROM r""",
    "expression_rules": f"""WITH {IO_PAIRS} SELECT conv_id, turn, length(output) > length(input) AND contains(lower(output), 'the') AS rules_passed,
 {_flag('length(output) > length(input)')} AS longer, {_flag("contains(lower(output), 'the')")} AS has_the FROM io_pairs""",
    "rule_outcome": f"""WITH {IO_PAIRS}, f AS (SELECT conv_id, turn, {_flag("regexp_matches(output, '[0-9]')")} AS a,
 {_flag("regexp_matches(output, '^[A-Z]')")} AS b, {_flag('length(output) >= 40')} AS c FROM io_pairs)
SELECT conv_id, turn, a + b + c = 3 AS rules_passed, (a + b + 2 * c) / 4.0::DOUBLE AS weighted FROM f""",
    "rule_report": f"""WITH f AS (SELECT lang, 'digit' AS rule, {_flag("regexp_matches(text, '[0-9]')")} AS score FROM documents UNION ALL
 SELECT lang, 'capital', {_flag("regexp_matches(text, '^[A-Z]')")} FROM documents UNION ALL
 SELECT lang, 'long_enough', {_flag('length(text) >= 400')} FROM documents)
SELECT lang, rule, count(*) AS n, avg(score) AS pass_rate FROM f GROUP BY ROLLUP (lang, rule)""",
    "weighted_scores": f"""WITH {SCORES} SELECT doc_id, (quality + safety) / 2.0::DOUBLE AS plain,
 (2.0 * quality + safety) / 3.0::DOUBLE AS quality_first, 0.0::DOUBLE AS weightless, 0.0::DOUBLE AS empty FROM scores""",
    "min_score_gate": f"""WITH {ATTEMPTS} SELECT ord, CASE WHEN ord % 10 = 0 THEN NULL ELSE score END AS weighted,
 passed AND (ord % 10 = 0 OR score >= 0.7) AS passed FROM attempts""",
    "code_syntax_scores": "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS quality FROM events",
    "critic_reports": """SELECT event_id, event_id % 5 IN (0, 4) AS passed,
 CASE event_id % 5 WHEN 0 THEN least(1.0::DOUBLE, (event_id % 100) / 50.0::DOUBLE) WHEN 1 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS score,
 CASE WHEN event_id % 5 = 0 THEN 1.0::DOUBLE END AS format, CASE WHEN event_id % 5 = 0 THEN 0.25::DOUBLE END AS tone,
 CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'too long' WHEN 4 THEN 'fine' ELSE 'unreadable_report' END AS critique,
 CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS n_suggestions, event_id + 5 AS audit_cost FROM events""",
    "consensus_votes": f"""WITH {VOTES}, t AS (SELECT item, count(*) FILTER (passed) AS yes, count(*) AS n_votes,
 max(score) AS overall, max(1.0::DOUBLE - score) AS rest, max(score) FILTER (judge = 1) AS score FROM votes GROUP BY item)
SELECT item, CAST(yes AS DOUBLE) / n_votes >= 0.5 AS passed, yes, n_votes, score, overall, rest,
 CASE WHEN CAST(yes AS DOUBLE) / n_votes >= 0.5 THEN 'judge 1' ELSE 'consensus_not_reached:' || yes || '/' || n_votes END AS critique FROM t""",
    "safety_scores": f"SELECT doc_id, {_safety('text')} AS safety FROM documents",
    "code_style_scores": f"""SELECT 'document' AS kind, doc_id, {_code_style('text')} AS style FROM documents UNION ALL
 SELECT 'page', page_id, {_code_style('html')} FROM pages""",
    "completeness_scores": f"WITH {COMPLETE} SELECT conv_id, turn, completeness FROM complete",
    "coherence_scores": f"""WITH l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)),
  lambda x: {TRIM.format('x')}), lambda x: x <> '') AS kept FROM documents),
 m AS (SELECT doc_id, text, len(kept) AS n, 1.0::DOUBLE - CAST(len(list_distinct(kept)) AS DOUBLE) / len(kept) AS rep,
  list_avg(list_transform(list_filter(kept, lambda x: length(x) > 5), lambda x: len(string_split_regex(x, '\\s+')))) AS words FROM l)
SELECT doc_id, CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN length({TRIM.format('text')}) < 20 THEN 0.2::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE
 - CASE WHEN n > 5 AND rep > 0.3 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
 - CASE WHEN words < 3 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN words > 50 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
 - CASE WHEN regexp_matches(text, '(?is)\\bhowever\\b.*\\btherefore\\b') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
 - CASE WHEN regexp_matches(text, '(?is)\\bbut\\b.*\\balso\\b.*\\bbut\\b') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) END AS coherence FROM m""",
    "substance_scores": f"WITH {IO_PAIRS} SELECT conv_id, turn, {SUBSTANCE} AS substance FROM io_pairs",
    "judge": f"""WITH {JUDGED} SELECT conv_id, turn, safety, completeness, substance, unset, w >= 0.7 AS passed,
 round(w, 4) AS weighted_score FROM judged""",
    "score_bands": f"WITH {JUDGED} " + " UNION ALL ".join(
        f"SELECT conv_id, turn, '{n}' AS dimension, {n} AS score, {_band(n)} AS band FROM judged" for n in NAMES),
    "score_summaries": f"WITH {JUDGED} SELECT conv_id, turn, 'overall: ' || {_places('round(w, 4)')} || " + " || ".join(
        f"chr(10) || '  {n}: ' || {_places(n)} || ' - ' || {_band(n)}" for n in NAMES) + " AS summary FROM judged",
    "score_bars": f"WITH {JUDGED} SELECT conv_id, turn, " + " || chr(10) || ".join(
        f"rpad('{n}', 15, ' ') || ' [' || repeat('█', trunc({n} * 20)::INTEGER) || repeat('░', 20 - trunc({n} * 20)::INTEGER) || '] ' || {_places(n)}"
        for n in NAMES) + " AS report FROM judged",
    "corpus_score_report": f"WITH {DOC_DIMS} SELECT lang, dimension, count(*) AS n, avg(score) AS mean_score, min(score) AS min_score, "
        "max(score) AS max_score, " + ", ".join(f"count(*) FILTER ({_band('score')} = '{b}') AS n_{b}"
        for b in ("excellent", "good", "fair", "poor", "failing")) + " FROM flat GROUP BY lang, dimension",
    "validation_report": f"WITH {DOC_DIMS} SELECT lang, dimension, count(*) AS n, count(*) FILTER (score >= 0.7) AS n_passed, "
        "avg(score) AS mean_score FROM flat GROUP BY ROLLUP (lang, dimension)",
}
