"""Iterative refinement: ask, check, and ask again with feedback, as a short loop of Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.operators.rules import Rule, apply_rules, rule_weights
from tallymill.functions.scoring import weighted_score
from tallymill.operators.state import Snapshots
from tallymill.plans.ordered import union_all

BatchFunction = Callable[[pd.DataFrame], pd.Series]
#: Bytes of prompts that are handed to a call at once; a longer prompt goes alone.
PROMPT_BYTES = 1 << 20


def _parts(batch: pa.RecordBatch, prompt: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, in parts of about PROMPT_BYTES of prompts: Spark's batches have any size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(prompt)), 0).to_numpy(zero_copy_only=False)
    number = (np.cumsum(sizes, dtype=np.int64) - sizes) // PROMPT_BYTES
    starts = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(start, end - start)


def refine(items: DataFrame, call: BatchFunction, rules: list[Rule], path: str, *, max_attempts: int = 3,
           item: str = "item_id", prompt: str = "prompt", callers: int | None = None) -> DataFrame:
    """All attempts at ``items``: item, attempt, output, passed, score, critique.

    ``call`` gets frames with item, prompt, attempt and feedback and returns the outputs. Each
    round only sends the items that have not passed, with the names of the failed rules as feedback.
    Rounds are stored below ``path``: none is computed twice, and a job started again with the same
    path goes on after the last finished round. ``callers`` bounds the concurrent callers.
    """
    spark = items.sparkSession
    rounds = Snapshots(spark, path)
    done = rounds.newest() or 0
    kind = items.schema[item].dataType.simpleString()

    def ask(batches):
        for batch in batches:
            for part in _parts(batch, prompt):
                frame = part.to_pandas()
                for zoned in frame.select_dtypes("datetimetz"):
                    frame[zoned] = frame[zoned].dt.tz_localize(None)
                output = frame.assign(output=call(frame))["output"]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(output, part.column(prompt).type, from_pandas=True)], [*part.schema.names, "output"])

    # The prompt and the last feedback travel with the row, so equal ids stay rows of their own.
    waiting = items.select(item, prompt, F.lit(None).cast("string").alias("feedback"))
    made = []
    for attempt in range(1, max_attempts + 1):
        if attempt > done:
            if waiting.isEmpty():
                break
            sent = waiting.withColumn("attempt", F.lit(attempt))
            if callers is not None:
                sent = sent.repartition(callers)
            answered = sent.mapInArrow(ask, f"{item} {kind}, {prompt} string, feedback string, attempt int, output string")
            checked = apply_rules(answered, rules)
            failed = F.map_keys(F.map_filter("rule_scores", lambda k, v: v < 1.0))
            rounds.write(checked.select(
                item, prompt, "attempt", "output", F.col("rules_passed").alias("passed"),
                F.when(F.size("rule_scores") > 0, weighted_score(F.col("rule_scores"), rule_weights(rules))).alias("score"),
                F.when(~F.col("rules_passed"), F.concat(F.lit("failed: "), F.array_join(failed, ", "))).alias("critique")), attempt)
        result = spark.read.parquet(f"{rounds.path}/data/version={attempt}")
        made.append(result.drop(prompt))
        waiting = result.filter(~F.col("passed")).select(item, prompt, F.col("critique").alias("feedback"))
    return union_all(made)
