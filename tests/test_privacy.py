import random
import re

import pytest
from pyspark.sql import functions as F

from tallymill.functions import pii
from tallymill.operators import privacy

EMAIL, PHONE, ID, IP, KEY = ("alice@example.com", "13812345678", "000000200001010029", "192.168.1.100", "sk-" + "a" * 24)


def fold(text, numbers=None):
    """Plain three-step masking: all matches of all labels, earliest and longest first, numbered from the end."""
    spans = sorted(((m.start(), m.end(), label) for label, p in pii.PATTERNS.items() for m in re.finditer(p, text)),
                   key=lambda s: (s[0], s[0] - s[1]))
    kept, at = [], 0
    for s, e, label in spans:
        if s >= at:
            kept.append((s, e, label))
            at = e
    numbers = {} if numbers is None else numbers
    for s, e, label in reversed(kept):
        mark = numbers.setdefault(text[s:e], f"[[PII_{label}_{len(numbers) + 1}]]")
        text = text[:s] + mark + text[e:]
    return text


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = [EMAIL, PHONE, ID, IP, KEY, "+86" + PHONE, "a.b_c", "@", ".", "-", "+", "sk-", "1", "9", "1.2.3.4", "é", "中", " ",
             "x", "7" * 18, "6" * 11, "1.2", "_", "\n", "X", "b@c.d", "..", "²", "٣"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def masked(spark, texts, **options):
    return [r.masked for r in privacy.mask(frame(spark, texts), **options).orderBy("id").collect()]


@pytest.mark.parametrize("label, value", [("EMAIL", EMAIL), ("PHONE", PHONE), ("ID_CARD", ID), ("IP_ADDR", IP), ("API_KEY", KEY)])
def test_each_label(spark, label, value):
    assert masked(spark, [f"see {value} here"]) == [f"see [[PII_{label}_1]] here"]


def test_equal_values_share_and_distinct_ones_count(spark):
    row = privacy.mask(frame(spark, [f"{EMAIL} {EMAIL} {PHONE} {IP}"])).first()
    assert row.masked == "[[PII_EMAIL_3]] [[PII_EMAIL_3]] [[PII_PHONE_2]] [[PII_IP_ADDR_1]]"
    assert len(row.vault) == 3


def test_empty_and_null(spark):
    assert masked(spark, ["", None]) == ["", None]


def test_labels_and_prefix(spark):
    text = f"{EMAIL} {PHONE}"
    assert masked(spark, [text], labels=["emails"], prefix="X") == [f"[[X_EMAIL_1]] {PHONE}"]
    assert masked(spark, [text], labels=["phones", "IP_ADDRS"]) == [f"{EMAIL} [[PII_PHONE_1]]"]
    assert masked(spark, [text], labels=[]) == masked(spark, [text])
    with pytest.raises(ValueError):
        pii.resolve_labels(["surname"])


def test_random_texts_like_the_plain_fold(spark):
    texts = random_texts(6000, 7)
    df = privacy.unmask_row(privacy.mask(frame(spark, texts))).orderBy("id")
    for row in df.collect():
        assert row.masked == fold(row.text), row.text
        assert row.restored == row.text


def test_corpus_scope_like_one_plain_vault(spark):
    texts = random_texts(500, 8)
    df = frame(spark, texts).repartition(6)
    out, vault = privacy.mask_corpus(df, "id", "id")
    numbers = {}
    assert [r.masked for r in out.orderBy("id").collect()] == [fold(t, numbers) for t in texts]
    assert {r.original_value: r.placeholder for r in vault.collect()} == numbers
    back = privacy.unmask(out, vault, "id", [])
    assert back.filter("restored <> text").isEmpty()
    assert privacy.leaks(out, "id", ["masked"]).filter("length(value) > 0").count() == sum(
        len(re.findall("|".join(pii.PATTERNS.values()), fold(t))) for t in texts)


def test_scoped_unmask_keeps_unknown_placeholders(spark):
    df = spark.createDataFrame([(1, "[[PII_EMAIL_1]] [[PII_EMAIL_10]] [[PII_PHONE_9]]")], "id long, masked string")
    vault = spark.createDataFrame([(1, "[[PII_EMAIL_1]]", "EMAIL", "a@b.c"), (1, "[[PII_EMAIL_10]]", "EMAIL", "x@y.z"),
                                   (2, "[[PII_PHONE_9]]", "PHONE", PHONE)], "id long, placeholder string, label string, original_value string")
    assert privacy.unmask(df, vault, "id", ["id"]).first().restored == "a@b.c x@y.z [[PII_PHONE_9]]"


def test_vault_upsert_restore_and_stats(spark, tmp_path):
    rows = "scope_id long, placeholder string, label string, original_value string"
    old = spark.createDataFrame([(1, "[[PII_EMAIL_1]]", "EMAIL", "a@b.c"), (2, "[[PII_IP_ADDR_7]]", "IP_ADDR", IP)], rows)
    privacy.write_vault(old, str(tmp_path / "vault"))
    stored = spark.read.parquet(str(tmp_path / "vault"))
    new = spark.createDataFrame([(1, "[[PII_EMAIL_1]]", "EMAIL", "z@b.c"), (1, "[[PII_PHONE_2]]", "PHONE", PHONE)], rows)
    merged = privacy.upsert_vault(stored, new)
    assert {(r.scope_id, r.placeholder): r.original_value for r in merged.collect()} == {
        (1, "[[PII_EMAIL_1]]"): "z@b.c", (1, "[[PII_PHONE_2]]"): PHONE, (2, "[[PII_IP_ADDR_7]]"): IP}
    assert {r.scope_id: (r.n_entries, r.last_number) for r in privacy.vault_stats(merged).collect()} == {1: (2, 2), 2: (1, 7)}
    assert privacy.restore_scope(merged, 1).count() == 2 and privacy.drop_scope(merged, 1).count() == 1
    more = privacy.corpus_vault(frame(spark, [f"{EMAIL}"]), "id", start=7)
    assert more.first().placeholder == "[[PII_EMAIL_8]]"


def test_custom_patterns_prefer_earliest_then_longest(spark):
    df = frame(spark, ["abcd bc abcd", None])
    out = privacy.mask_custom(df, {"SHORT": "bc", "LONG": "abc", "TAIL": "cd"}).orderBy("id").collect()
    assert out[0].masked == "[[PII_LONG_1]]d [[PII_SHORT_2]] [[PII_LONG_1]]d" and out[1].masked is None


def plain_custom(text, patterns):
    """Earliest start, then longest, then first pattern; numbers from the last new value to the first."""
    spans = sorted((m.start(), -m.end(), at, m.group()) for at, p in enumerate(patterns.values()) for m in re.finditer(p, text) if m.group())
    kept, reached = [], 0
    for start, stop, at, value in spans:
        if start >= reached:
            kept.append((start, -stop, list(patterns)[at], value))
            reached = -stop
    tokens = {}
    for _, _, label, value in reversed(kept):
        tokens.setdefault(value, f"[[PII_{label}_{len(tokens) + 1}]]")
    out, at = "", 0
    for start, stop, _, value in kept:
        out, at = out + text[at:start] + tokens[value], stop
    return out + text[at:]


@pytest.mark.parametrize("patterns", [
    {"SHORT": "bc", "LONG": "abc", "TAIL": "cd"}, {"A": "a+", "AB": "(ab)+", "X": "x+"}, {"P": r"\w+@", "Q": r"[a-c]{2}", "R": r"@\w"},
    {"E": "é+", "EMOJI": "😀.", "ANY": "[é😀]{3}"}, {"NONE": "zzz"}, {"SAME": "ab", "AGAIN": "ab", "CTX": "(?<=c)ab"}])
def test_custom_patterns_that_overlap(spark, patterns):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b", "c", "d", "x", "@", " ", "é", "😀", "\n"]) for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += ["", "abc" * 700, "x" * 5, "qaq"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id long, text string").withColumns({"_spans": F.lit(1), "_values": F.lit(2)})
    masked = privacy.mask_custom(df, patterns)
    assert masked.columns == [*df.columns, "masked"]
    got = {r.id: r.masked for r in masked.collect()}
    assert got.pop(-1) is None and got == {i: plain_custom(t, patterns) for i, t in enumerate(texts)}
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_custom_patterns_that_match_nothing_are_refused(spark):
    df = spark.createDataFrame([("xx",)], "text string")
    with pytest.raises(ValueError, match="'X' matches an empty text"):
        privacy.mask_custom(df, {"A": "a", "X": "x*"})
    assert privacy.mask_custom(df, {}).first().masked == "xx"
    assert privacy.mask_custom(df.limit(0), {"A": "a"}).count() == 0


def test_large_text_and_long_run(spark):
    run = "a" * 300_000
    text = "word " * 400_000 + run + " " + EMAIL
    df = spark.createDataFrame([(1,)], "id long").select("id", F.lit(text).alias("text"))
    assert privacy.mask(df).first().masked == text.replace(EMAIL, "[[PII_EMAIL_1]]")


def test_text_with_very_many_values(spark):
    rng = random.Random(2)
    text = " ".join(f"10.{rng.randrange(200)}.{rng.randrange(200)}.7" for _ in range(20_000))
    masked = privacy.mask(spark.createDataFrame([(1, text)], "id long, text string"))
    row = privacy.unmask_row(masked).first()
    assert row.restored == text and row.masked == fold(text) and len(row.vault) == len(set(text.split()))


def test_row_vault_of_another_make(spark):
    vault = {"[[PII_EMAIL_7]]": "a@b.c", "[[PII_PHONE_1]]": PHONE}
    df = spark.createDataFrame([("[[PII_PHONE_1]] [[PII_EMAIL_7]] [[PII_EMAIL_1]] [[PII_X_12345678901]]", vault)], "masked string, vault map<string,string>")
    assert privacy.unmask_row(df).first().restored == f"{PHONE} a@b.c [[PII_EMAIL_1]] [[PII_X_12345678901]]"
