"""Registered queries of the state and cache families and their SQL twins."""

from pyspark.sql import functions as F

from tallymill.functions.text import short_hash
from tallymill.operators import cache, state as st
from tallymill.session import fresh_path, load

MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def state_log(spark, d):
    """Every event writes the state of its (user, type) unit."""
    return load(spark, d, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("id"),
        short_hash(F.col("props")).alias("input_hash"),
        F.when(F.col("value") >= 30.0, "completed").otherwise("pending").alias("status"),
        F.col("props").alias("final_output"), F.col("event_id").alias("updated_at"))


def state_table(spark, d):
    return st.latest(state_log(spark, d), ["id"], ["updated_at"])


def state_upsert(spark, d):
    """Three waves of writes that arrive out of order, each upserted into one table."""
    table = st.KeyedTable(spark, fresh_path(spark, "state"), ["id"], ["updated_at"], parts=8)
    log = state_log(spark, d)
    for wave in ("status = 'pending'", "status = 'completed' AND input_hash < '8'", "status = 'completed' AND input_hash >= '8'"):
        table.upsert(log.filter(wave))
    return table.read()


def _asked(spark, d):
    return load(spark, d, "events").select(
        F.concat_ws(":", (F.col("user_id") + 20).cast("string"), "event_type").alias("id"), F.col("event_id").alias("ord"))


def pending_ids(spark, d):
    return st.pending(_asked(spark, d), state_table(spark, d))


def completed_ids(spark, d):
    return st.completed(state_table(spark, d))


def completed_among(spark, d):
    return st.completed(state_table(spark, d), among=_asked(spark, d))


def status_of_ids(spark, d):
    return st.status_of(_asked(spark, d), state_table(spark, d))


def reset_many(spark, d):
    return st.reset(state_table(spark, d), _asked(spark, d)).drop("input_hash")


def reset_single(spark, d):
    return st.reset(state_table(spark, d), _asked(spark, d), only_completed=False).drop("input_hash")


def reset_counts(spark, d):
    return st.reset_counts(reset_many(spark, d))


def state_in_update_order(spark, d):
    return st.in_update_order(state_table(spark, d), ["updated_at"]).select("id", "place")


def input_units(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    done = docs.filter("lang IN ('de', 'es')").select(
        st.unit_id("sum", F.col("text")).alias("id"), F.lit("completed").alias("status"),
        F.concat(F.lit("done "), F.length("text").cast("string")).alias("final_output")).dropDuplicates(["id"])
    return st.plan_units(docs, "sum", done, "doc_id")


def prefix_hashes(spark, d):
    return load(spark, d, "documents").select("doc_id", cache.prefix_hash(F.col("text")).alias("prefix_hash"),
                                              cache.eligible(F.col("text")).alias("eligible"))


def prefix_clusters(spark, d):
    return cache.cluster_places(load(spark, d, "documents"), "doc_id")


def prefix_report(spark, d):
    return cache.prefix_report(load(spark, d, "documents"))


TTL = 6 * 3600 * 1_000_000


def cache_hits(spark, d):
    requests = load(spark, d, "events").select("user_id", F.expr(MICROS).alias("at"))
    return cache.hit_report(requests, "user_id", "at", TTL)


def cache_hits_by_type(spark, d):
    """Five hot keys with long bursts of requests."""
    requests = load(spark, d, "events").select("event_type", F.expr(MICROS).alias("at"))
    return cache.hit_report(requests, "event_type", "at", TTL, fold_limit=100)


def cache_hits_unlimited(spark, d):
    requests = load(spark, d, "events").select("user_id", F.expr(MICROS).alias("at"))
    return cache.hit_report(requests, "user_id", "at", 0)


QUERIES = {
    "state_table": state_table, "state_upsert": state_upsert, "pending_ids": pending_ids, "completed_ids": completed_ids,
    "completed_among": completed_among, "status_of_ids": status_of_ids, "reset_many": reset_many, "reset_single": reset_single,
    "reset_counts": reset_counts,
    "state_in_update_order": state_in_update_order, "input_units": input_units, "prefix_hashes": prefix_hashes,
    "prefix_clusters": prefix_clusters, "prefix_report": prefix_report, "cache_hits": cache_hits,
    "cache_hits_by_type": cache_hits_by_type, "cache_hits_unlimited": cache_hits_unlimited,
}

STATE = """state AS (SELECT id, input_hash, status, final_output, updated_at FROM (SELECT user_id || ':' || event_type AS id,
  substr(sha256(props), 1, 16) AS input_hash, CASE WHEN value >= 30.0 THEN 'completed' ELSE 'pending' END AS status, props AS final_output,
  event_id AS updated_at, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1),
 asked AS (SELECT (user_id + 20) || ':' || event_type AS id, event_id AS ord FROM events)"""


def _reset(condition: str) -> str:
    return f"""WITH {STATE}, r AS (SELECT *, id IN (SELECT id FROM asked) {condition} AS reset FROM state)
SELECT id, CASE WHEN reset THEN 'pending' ELSE status END AS status, CASE WHEN reset THEN '' ELSE final_output END AS final_output,
 updated_at, reset FROM r"""


def _hits(key: str) -> str:
    return f"""WITH RECURSIVE t AS (SELECT {key}, epoch_us(ts) AS at_us, count(*) AS n FROM events GROUP BY 1, 2),
 p AS (SELECT {key}, at_us, min(at_us) OVER (PARTITION BY {key} ORDER BY at_us RANGE BETWEEN {TTL + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM t),
 a AS (SELECT {key}, min(at_us) AS at_us FROM t GROUP BY 1 UNION ALL
  SELECT a.{key}, p.nxt FROM a JOIN p ON p.{key} = a.{key} AND p.at_us = a.at_us WHERE p.nxt IS NOT NULL),
 m AS (SELECT {key}, count(*) AS misses FROM a GROUP BY 1), r AS (SELECT {key}, count(*) AS requests FROM events GROUP BY 1)
SELECT {key}, requests, misses, requests - misses AS hits, CAST(requests - misses AS DOUBLE) / requests AS hit_rate FROM r JOIN m USING ({key})"""


ORACLES = {
    "state_table": f"WITH {STATE} SELECT * FROM state",
    "state_upsert": f"WITH {STATE} SELECT * FROM state",
    "pending_ids": f"WITH {STATE} SELECT id, ord FROM asked WHERE id NOT IN (SELECT id FROM state WHERE status = 'completed')",
    "completed_ids": f"WITH {STATE} SELECT id FROM state WHERE status = 'completed'",
    "completed_among": f"WITH {STATE} SELECT id FROM state WHERE status = 'completed' AND id IN (SELECT id FROM asked)",
    "status_of_ids": f"WITH {STATE} SELECT a.id, a.ord, s.status FROM asked a LEFT JOIN state s ON s.id = a.id",
    "reset_many": _reset("AND status = 'completed'"),
    "reset_single": _reset(""),
    "reset_counts": f"SELECT reset, status, count(*) AS n FROM ({_reset("AND status = 'completed'")}) GROUP BY reset, status",
    "state_in_update_order": f"WITH {STATE} SELECT id, row_number() OVER (ORDER BY updated_at) AS place FROM state",
    "input_units": """WITH k AS (SELECT doc_id, lang, 'sum:' || substr(sha256(text), 1, 16) AS unit_id, length(text) AS n FROM documents),
 done AS (SELECT unit_id, 'done ' || any_value(n) AS final_output FROM k WHERE lang IN ('de', 'es') GROUP BY unit_id)
SELECT k.doc_id, k.unit_id, CASE WHEN d.unit_id IS NOT NULL THEN 'stored' WHEN k.doc_id = min(k.doc_id) OVER (PARTITION BY k.unit_id) THEN 'run'
 ELSE 'duplicate' END AS action, d.final_output FROM k LEFT JOIN done d ON d.unit_id = k.unit_id""",
    "prefix_hashes": "SELECT doc_id, substr(sha256(substr(text, 1, 50)), 1, 16) AS prefix_hash, length(text) >= 100 AS eligible FROM documents",
    "prefix_clusters": "SELECT doc_id, row_number() OVER (ORDER BY substr(text, 1, 50) COLLATE C, doc_id) AS place FROM documents",
    "prefix_report": """SELECT substr(sha256(substr(text, 1, 50)), 1, 16) AS prefix_hash, count(*) AS n_items,
 count(*) FILTER (length(text) >= 100) AS n_eligible, greatest(count(*) FILTER (length(text) >= 100) - 1, 0) AS n_reusable FROM documents GROUP BY 1""",
    "cache_hits": _hits("user_id"),
    "cache_hits_by_type": _hits("event_type"),
    "cache_hits_unlimited": """SELECT user_id, count(*) AS requests, CAST(1 AS BIGINT) AS misses, count(*) - 1 AS hits,
 CAST(count(*) - 1 AS DOUBLE) / count(*) AS hit_rate FROM events GROUP BY user_id""",
}
