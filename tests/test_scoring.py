import json

import pytest
from pyspark.sql import functions as F

from tallymill.functions import scoring as sc
from tallymill.operators import evaluators as ev
from tallymill.operators import rules as ru
from tallymill.operators.rules import Rule


def score(spark, evaluator, output, input=""):
    df = spark.createDataFrame([(input, output)], "i string, o string")
    return df.select(evaluator(F.col("i"), F.col("o")).alias("s")).first().s


def near(value):
    return pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("text, want", [
    ("A calm and helpful answer.", 1.0), ("<script>alert(1)</script>", 0.7), ("x = EVAL (y)", 0.7),
    ("subprocess.run(x); os.system ('y')", 0.4), ("SSN 123-45-6789", 0.8), ("card 1234567812345678", 0.8),
    ("card 12345678123456789", 1.0), ("Password: hunter2 and 123-45-6789", 0.6), ("bypass  security", 0.8),
    ("DROP TABLE users", 0.8), ("pa\u017f\u017fword = x", 0.8), ("hac\u212a login", 0.8), ("²1234567812345678", 1.0),
    ("<script> __import__('x') eval(1) exec(2)", 0.0)])
def test_safety(spark, text, want):
    assert score(spark, sc.safety, text) == near(want)


@pytest.mark.parametrize("text, want", [
    ("def f():\n    return 1", 1.0), ("def f(:\n  pass", 0.6), ("no code at all (", 1.0),
    ("try:\n    x()\nexcept:\n    pass", 0.85), ("import os\ntry:\n  x", 0.4), ("from a import *", 0.9),
    ("\n".join(["x"] * 501), 0.9), ("a\n" + " " * 17 + "b", 0.9), ("class A:\n  global x\0", 0.5)])
def test_code_quality(spark, text, want):
    assert score(spark, sc.code_quality, text) == near(want)


@pytest.mark.parametrize("input, output, want", [
    ("", "x", 0.0), ("explain sorting", "  ", 0.0), ("a an the", "short words only", 0.5),
    ("explain sorting", "sorting: explain it well", 1.0), ("explain sorting", "Sorting is done", 0.7),
    ("explain sorting", "no", 0.12), ("explain", "explain " * 20, 0.92)])
def test_completeness(spark, input, output, want):
    assert score(spark, sc.completeness, output, input) == near(want)


@pytest.mark.parametrize("text, want", [
    ("", 0.0), (" \n ", 0.0), ("short", 0.2), ("This is one fine sentence of text.", 1.0),
    ("the same line of text again\n" * 10, 0.7), ("oneword12\ntwoword34\nthreeword", 0.8),
    ("It is good, however it is bad, therefore it is fine.", 0.9),
    ("therefore it is good, however it is bad and so on.", 1.0),
    ("But we came and also saw but did not win.", 0.9), ("word " * 60, 0.9)])
def test_coherence(spark, text, want):
    assert score(spark, sc.coherence, text) == near(want)


@pytest.mark.parametrize("text, want", [("", 0.1), ("  hi  ", 0.1), ("a" * 10, 0.4), ("a" * 49, 0.4), ("a" * 50, 0.6)])
def test_substance(spark, text, want):
    assert score(spark, sc.substance, text) == want


@pytest.mark.parametrize("scores, weights, want", [
    ({"a": 0.9, "b": 0.8}, {"a": 2.0, "b": 1.0}, 0.8666666667), ({"a": 0.9, "b": 0.8}, None, 0.85), ({}, None, 0.0),
    ({"a": 0.5}, {"a": 0.0}, 0.0), ({"a": 1.0, "b": 0.0}, {"a": 3.0}, 0.75)])
def test_weighted_score(spark, scores, weights, want):
    df = spark.createDataFrame([(scores,)], "m map<string,double>")
    assert df.select(sc.weighted_score(F.col("m"), weights)).first()[0] == near(want)


def test_judge(spark):
    df = spark.createDataFrame([("q", "answer")], "input string, output string")
    dims = [ev.Dimension("one", 1.0, lambda i, o: F.lit(1.0)), ev.Dimension("none", 1.0),
            ev.Dimension("broken", 2.0, lambda i, o: F.lit(None).cast("double")), ev.Dimension("over", 1.0, lambda i, o: F.lit(7.0))]
    row = ev.judge(df, dims, 0.5).first()
    assert row.scores == {"one": 1.0, "none": 0.5, "broken": 0.0, "over": 1.0}
    assert row.weighted_score == 0.5 and row.passed
    close = ev.judge(df, [ev.Dimension("x", 1.0, lambda i, o: F.lit(0.69999))]).first()
    assert close.weighted_score == 0.7 and not close.passed
    empty = ev.judge(df, []).first()
    assert (empty.passed, empty.weighted_score, empty.scores) == (False, 0.0, {})
    with pytest.raises(ValueError):
        ev.judge(df, [ev.Dimension("x"), ev.Dimension("x")])


@pytest.mark.parametrize("value, band", [(1.0, "excellent"), (0.9, "excellent"), (0.7, "good"), (0.5, "fair"), (0.3, "poor"), (0.29, "failing")])
def test_bands(spark, value, band):
    assert spark.range(1).select(sc.band(F.lit(value))).first()[0] == band


def outcome(spark, output, rules):
    row = ru.apply_rules(spark.createDataFrame([(output,)], "output string"), rules).first()
    return row.rules_passed, row.rule_scores


def test_rules(spark):
    assert outcome(spark, "order 7", [Rule("regex", r"\d")]) == (True, {r"regex:\d": 1.0})
    assert outcome(spark, "order", [Rule("regex", r"\d")]) == (False, {r"regex:\d": 0.0})
    assert outcome(spark, "x", []) == (True, {})
    assert outcome(spark, None, [Rule("regex", "x")])[0] is False
    long_pattern = "x" * 501
    assert outcome(spark, long_pattern, [Rule("regex", long_pattern)]) == (True, {"regex:" + "x" * 30: 1.0})
    broken = ru.apply_rules(spark.createDataFrame([("x",)], "output string"), [Rule("regex", "(x"), Rule("regex", "x")]).first()
    assert (broken.rules_passed, broken.rule_errors) == (False, ["regex:(x"])
    shared = [Rule("regex", "a" * 30 + "b"), Rule("regex", "a" * 30)]
    assert outcome(spark, "a" * 30, shared) == (False, {"regex:" + "a" * 30: 1.0})
    assert ru.split_rules([Rule("regex", "x"), Rule("style", "y")])[1] == [Rule("style", "y")]
    with pytest.raises(ValueError):
        outcome(spark, "x", [Rule("style", "y")])


@pytest.mark.parametrize("text", [
    '{"a": 1, "b": null}', '{"a": 1}', '["a", "b"]', '["a"]', '"xaxbx"', "12", "null", "", "{", '{"a":1,"b":2} junk',
    '{"a": 1, "a": 2, "b": 3}', '{"a": NaN, "b": 1}', " {\"b\": [], \"a\": {}} "])
@pytest.mark.parametrize("required", [None, [], ["a", "b"]])
def test_json_rule_like_the_standard_parser(spark, text, required):
    try:
        parsed, want = json.loads(text), True
        for name in required or []:
            want = want and name in parsed
    except (ValueError, TypeError):
        want = False
    assert outcome(spark, text, [Rule("json", required)])[0] is want


def test_min_score_gate_never_rescues(spark):
    df = spark.createDataFrame([(True, {"a": 0.5}), (True, {"a": 0.9}), (True, {}), (False, {"a": 1.0})], "passed boolean, s map<string,double>")
    assert [r.passed for r in ru.min_score_gate(df, F.col("s"), 0.7).collect()] == [False, True, True, False]


@pytest.mark.parametrize("report, want", [
    ('{"passed": true, "score": 1.7, "scores": {"a": -1, "b": 0.5}, "critique": ""}', (True, 1.0, {"a": 0.0, "b": 0.5}, None)),
    ('{}', (False, 0.0, {}, None)), ('{"passed": true, "score": "0.5"}', (True, 0.5, {}, None)),
    ('{"passed": true, "score": null}', (False, 0.0, {}, ru.BAD_REPORT)), ('[1]', (False, 0.0, {}, ru.BAD_REPORT)),
    ('{"passed": true', (False, 0.0, {}, ru.BAD_REPORT)), ('{"passed": true, "scores": {"a": "x"}}', (False, 0.0, {}, ru.BAD_REPORT)),
    (None, (False, 0.0, {}, ru.BAD_REPORT))])
def test_critic_reports(spark, report, want):
    df = spark.createDataFrame([(report, 3, 4)], "report string, prompt_tokens long, completion_tokens long")
    row = ru.parse_reports(df).first()
    assert (row.passed, row.score, row.scores, row.critique) == want and row.audit_cost == 7


def test_reports_take_the_last_of_a_repeated_key(spark):
    report = '{"passed": false, "passed": true, "score": 0.9, "score": 0.8}'
    row = ru.parse_reports(spark.createDataFrame([(report, 1, 1)], "report string, prompt_tokens long, completion_tokens long")).first()
    assert (row.passed, row.score) == (True, 0.8)


def test_consensus_leaves_out_failed_judges(spark):
    rows = [(1, 1, True, 0.9, {"a": 0.2}, None), (1, 2, None, 0.0, {}, None), (1, 3, False, 0.1, {"a": 0.7, "b": 0.1}, "bad"),
            (2, 1, False, 0.3, {}, "why")]
    df = spark.createDataFrame(rows, "item long, judge long, passed boolean, score double, scores map<string,double>, critique string")
    one, two = ru.consensus(df, ["item"], 0.5, F.col("judge") == 1).orderBy("item").collect()
    assert (one.passed, one.n_votes, one.score, one.scores, one.critique) == (True, 2, 0.9, {"a": 0.7, "b": 0.1}, None)
    assert (two.passed, two.critique) == (False, "consensus_not_reached:0/1")
