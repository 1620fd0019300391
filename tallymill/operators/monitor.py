"""Sampling, quality gates and drift checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.basic import zero
from tallymill.functions.money import ratio
from tallymill.functions.text import short_hash
from tallymill.functions.vectors import cosine
from tallymill.plans.ordered import OrderedRows, first_rows
from tallymill.plans.skew import lookup_join

def sample_size(rows: int, *, share: float | None = None, count: int | None = None) -> int:
    if (share is None) == (count is None):
        raise ValueError("give either share or count")
    return max(1, int(rows * share) if share is not None else int(count))


# Up to this many rows a sample is taken as a top-k, whose rows meet in one task.
TOP_K = 10_000


def _value_at(df: DataFrame, column: str, k: int):
    """The ``k``-th smallest value of a unique column."""
    return OrderedRows(df.select(column), [], [column]).number("_n").df.filter(F.col("_n") == k).first()[column]


def head_sample(items: DataFrame, order: str, *, share: float | None = None, count: int | None = None,
                top_k: int = TOP_K) -> DataFrame:
    """The first rows by a unique numeric order column: a share of them or a fixed number, at least one.

    A large sample is a filter at the exact value of its last row. Approximate quantiles bound that
    value first, so only the order values near it are ranked.
    """
    rows = items.count()
    k = min(sample_size(rows, share=share, count=count), rows)
    if k <= top_k:
        return items.orderBy(order).limit(k)
    error = 0.001
    low, high = items.stat.approxQuantile(order, [max(0.0, k / rows - 2 * error), min(1.0, k / rows + 2 * error)], error)
    position = F.col(order)
    last = _value_at(items.filter((position >= low) & (position <= high)), order, k - items.filter(position < low).count())
    return items.filter(position <= last)


def spot_check(items: DataFrame, key: str, share: float, seed: str = "", top_k: int = TOP_K) -> DataFrame:
    """A random sample without replacement of exact size ``max(1, int(n * share))``, flagged for review.

    The draw orders rows by a hash of their unique key and a seed, so it repeats. Hashes are uniform:
    a cut-off slightly above the share keeps barely more rows than needed, and only those are ranked.
    """
    rows = items.count()
    k = min(sample_size(rows, share=share), rows)
    drawn = items.withColumn("_draw", F.sha2(F.concat(F.col(key).cast("string"), F.lit(seed)), 256))
    slack = k + 6 * int(k ** 0.5) + 20
    if slack < rows:
        # The first 13 hex digits of the hash, read as a number, against the same share of their range.
        close = drawn.filter(F.col("_draw") < format(int(16 ** 13 * slack / rows), "013x"))
        drawn = close if close.count() >= k else drawn
    if k <= top_k:
        sample = drawn.orderBy("_draw").limit(k)
    else:
        sample = drawn.filter(F.col("_draw") <= _value_at(drawn, "_draw", k))
    return sample.drop("_draw").withColumn("spot_check", F.lit(True))


def sampling_report(traces: DataFrame, spending: DataFrame, by: list[str]) -> DataFrame:
    """Quality of a sample and what the full run would cost.

    ``traces`` has success (0/1), iterations and last_score; ``spending`` has one row per key with
    total_count (size of the full data set) and sampling_cost.
    """
    good = (F.col("success") == 1) & (F.col("iterations") > 0)
    seen = traces.groupBy(*by).agg(
        F.count("*").alias("sample_count"), F.count_if(F.col("success") == 1).alias("success_count"),
        F.coalesce(F.avg(F.when(good, F.col("last_score"))), zero()).alias("mean_score"),
        F.coalesce(F.avg(F.when(good, F.col("iterations"))), zero()).alias("mean_retries"))
    return (seen.join(spending.select(*by, "total_count", "sampling_cost"), by, "left")
            .withColumns({"total_count": F.coalesce("total_count", F.lit(0)).cast("bigint"),
                          "sampling_cost": F.coalesce(F.col("sampling_cost").cast("double"), zero())})
            .withColumn("success_rate", ratio(F.col("success_count").cast("double"), F.col("sample_count"), zero()))
            .withColumn("cost_per_sample", ratio(F.col("sampling_cost"), F.col("sample_count"), zero()))
            .withColumn("estimated_cost", F.when(F.col("total_count") > 0, F.col("cost_per_sample") * F.col("total_count"))
                        .otherwise(zero()))
            .withColumn("estimated_success", (F.col("total_count") * F.col("success_rate")).cast("bigint"))
            .withColumn("cost_per_success", ratio(F.col("estimated_cost"), F.col("estimated_success"), zero())))


def sampling_previews(traces: DataFrame, by: list[str], order: str, n: int = 3) -> DataFrame:
    """The first successes of every sample."""
    return first_rows(traces.filter(F.col("success") == 1), by, [F.col(order)], n)


def gate_steps(rows: OrderedRows, score: str, threshold: float, window: int, recovery: int) -> OrderedRows:
    """Adds ``halted`` to rows in order.

    A run of ``window`` low scores halts; while halted, a run of ``recovery`` good scores resumes
    (0: never). A run is long enough at a row when the latest score of the other kind lies that far
    back, and the gate is halted when the latest halt is more recent than the latest resumption.
    """
    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    good = F.col(score) >= threshold
    runs = rows.number("_n").scan(_good=("max", F.when(good, F.col("_n"))), _low=("max", F.when(~good, F.col("_n"))))
    resumes = (F.col("_n") - known("_low") >= recovery) if recovery > 0 else F.lit(False)
    state = runs.scan(_halt=("max", F.when(F.col("_n") - known("_good") >= window, F.col("_n"))),
                      _resume=("max", F.when(resumes, F.col("_n"))))
    return state.with_columns({"halted": known("_halt") > known("_resume")})


_STEPS = ("_n", "_good", "_low", "_halt", "_resume")


def quality_gate(scored: DataFrame, by: list[str], order: list[str], score: str = "score", *,
                 threshold: float = 0.6, window: int = 5, recovery: int = 0, **ordered) -> DataFrame:
    """State of the quality gate after every scored row. Rows without a score do not take part."""
    rows = OrderedRows(scored.filter(F.col(score).isNotNull()), by, order, **ordered)
    return gate_steps(rows, score, threshold, window, recovery).df.drop(*_STEPS)


def gate_report(gated: DataFrame, by: list[str], order: list[str], score: str = "score", *, window: int = 5) -> DataFrame:
    """The latest ``window`` scores of every key, their mean, and whether the gate is halted."""
    recent = first_rows(gated, by, [F.desc(c) for c in order], window)
    return (recent.groupBy(*by)
            .agg(F.sort_array(F.collect_list(F.struct(*order, score))).alias("_w"), F.avg(score).alias("average"),
                 F.max_by("halted", F.struct(*order)).alias("halted"))
            .select(*by, F.col(f"_w.{score}").alias("recent_scores"), "average", "halted"))


def hash_drift_rows(golden: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Golden samples against current outputs by hash. A sample without an expected hash matches;
    a sample whose output is missing (the call failed) does not."""
    both = golden.select(*key, "expected_hash").join(
        current.select(*key, short_hash(F.col("output")).alias("_now")), key, "left")
    expected = F.coalesce("expected_hash", F.lit(""))
    matched = F.col("_now").isNotNull() & ((expected == "") | (expected == F.col("_now")))
    return both.select(*key, matched.alias("matched"))


def hash_drift(rows: DataFrame, by: list[str], threshold: float = 0.8) -> DataFrame:
    """Match rate and alert per check. A check without samples has rate 1 and raises no alert."""
    return (rows.groupBy(*by)
            .agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("matched").cast("double")), F.lit(1.0)).alias("match_rate"))
            .withColumn("alert", F.col("match_rate") < threshold))


def embedding_drift_rows(pairs: DataFrame, golden: str, current: str, threshold: float = 0.85) -> DataFrame:
    """Adds ``similarity`` (null without a golden vector) and ``passed``. A golden vector without a
    current one means the call failed: similarity stays null and the row fails."""
    have_golden = F.col(golden).isNotNull() & (F.size(golden) > 0)
    return (pairs.withColumn("similarity", F.when(have_golden & F.col(current).isNotNull(),
                                                  cosine(F.col(golden), F.col(current))))
            .withColumn("passed", F.when(~have_golden, True)
                        .otherwise(F.coalesce(F.col("similarity") >= threshold, F.lit(False)))))


def embedding_drift(rows: DataFrame, by: list[str], threshold: float = 0.85) -> DataFrame:
    """Mean similarity over the compared pairs and alert per check; nothing compared counts as 1."""
    return (rows.groupBy(*by)
            .agg(F.count("*").alias("n"), F.coalesce(F.avg("similarity"), F.lit(1.0)).alias("mean_similarity"),
                 F.count_if(~F.col("passed")).alias("n_failed"))
            .withColumn("alert", F.col("mean_similarity") < threshold))


def check_cadence(items: DataFrame, by: list[str], order: list[str], every: int, **ordered) -> DataFrame:
    """Adds ``item_no``, ``check_no`` (the check that covers the item) and ``check_due``."""
    numbered = OrderedRows(items, by, order, **ordered).number("item_no").df
    return numbered.withColumns({
        "check_no": F.floor((F.col("item_no") - 1) / every).cast("bigint") + 1,
        "check_due": F.col("item_no") % every == 0})


DRIFT_STATUS = {"warn": "drift_warning", "halt": "drift_halted", "resample": "drift_resample"}


def drift_action(items: DataFrame, checks: DataFrame, by: list[str], action: str) -> DataFrame:
    """Effect of the first alerting check on the items after it: ``warn`` leaves them running,
    ``halt`` stops them, ``resample`` holds them back for a new sample."""
    first = checks.filter("alert").groupBy(*by).agg(F.min("check_no").alias("_alert"))
    marked = lookup_join(items, first, by, "left")
    return (marked.withColumn("status", F.when(F.col("check_no") > F.col("_alert"), DRIFT_STATUS[action])
                              .otherwise(F.col("status"))).drop("_alert"))
