"""Registered queries of the telemetry, source and SQL families and their SQL twins."""

from pyspark.sql import functions as F

from tallymill.operators import telemetry as te
from tallymill.operators.cost import recent_rows
from tallymill.session import fresh_path, load
from tallymill.sources import items as it, sinks, tables
from tallymill.suite import views
from tallymill.suite.views import ATTEMPTS, IO_PAIRS

TYPE = """CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'STATUS_UPDATE' WHEN 'click' THEN 'TRACE_EVENT'
 WHEN 'view' THEN 'SPOT_CHECK' ELSE 'QUALITY_HALT' END"""


def telemetry_events(spark, d):
    """Events as telemetry: some carry an explicit level, some belong to no mission."""
    rows = load(spark, d, "events").select(
        "event_id", "ts", F.expr(TYPE).alias("event_type"),
        F.when(F.col("value") >= 5.0, F.col("user_id")).alias("mission_id"),
        F.when(F.col("value") > 200.0, F.lit(3)).alias("given"), "value", "props")
    return rows.withColumn("level", te.event_level(F.col("event_type"), F.col("given"))).drop("given")


def event_levels(spark, d):
    return telemetry_events(spark, d).select("event_id", "event_type", "level")


def emitted_events(spark, d):
    return te.emitted(telemetry_events(spark, d), 2, "props").select("event_id", "level", "props")


def subscriptions(spark, d):
    """Suppliers subscribe: to the mission of their nation key, or to everything from region-less nations."""
    return load(spark, d, "supplier").select(
        F.col("s_suppkey").alias("subscriber"),
        F.when(F.col("s_nationkey") > 0, F.col("s_nationkey").cast("bigint")).alias("mission_id"),
        (F.col("s_acctbal") / 2500).cast("int").alias("level"))


def deliveries(spark, d):
    return te.deliveries(telemetry_events(spark, d), subscriptions(spark, d), "event_id", 3)


def delivery_counts(spark, d):
    return te.delivery_counts(telemetry_events(spark, d), subscriptions(spark, d))


def phase_updates(spark, d):
    return load(spark, d, "events").select(
        "user_id", "ts", "event_id", F.when(F.col("value") >= 100.0, "production").when(F.col("value") >= 40.0, "sampling")
        .otherwise("idle").alias("phase"),
        F.when(F.col("value") >= 400.0, "completed").otherwise("running").alias("status"))


def phase_changes(spark, d):
    return te.phase_changes(phase_updates(spark, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "phase")


def recent_events(spark, d):
    return recent_rows(load(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], 100).drop("ts")


def _timed(spark, d):
    return load(spark, d, "events").select("ts", "event_type", "user_id", "value")


def _named(df, by):
    return df.select(by, F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


def tumbling_counts(spark, d):
    return _named(te.tumbling_counts(_timed(spark, d), ["event_type"], "1 hour"), "event_type")


def sliding_counts(spark, d):
    return _named(te.sliding_counts(_timed(spark, d), ["event_type"], "1 hour", "15 minutes"), "event_type")


def session_counts(spark, d):
    return _named(te.session_counts(_timed(spark, d), ["user_id"], "2 hours"), "user_id")


def row_items(spark, d):
    return it.rows_to_items(load(spark, d, "customer"), ["c_custkey"])


def corpus_items(spark, d):
    """Pages written as a folder of text files and scanned back as a corpus, whole."""
    path = fresh_path(spark, "corpus")
    load(spark, d, "pages").select("page_id", "url", "html").write.json(path)
    corpus = it.read_corpus(spark, path, "*.json")
    lines = it.corpus_items(corpus).select("item_id", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return lines.select(F.get_json_object("line", "$.page_id").cast("bigint").alias("page_id"),
                        F.get_json_object("line", "$.url").alias("url"),
                        F.sha2(F.get_json_object("line", "$.html"), 256).alias("html_hash"))


def first_resource(spark, d):
    """The first location is empty of items, the second has them."""
    found = it.load_items(spark, [it.Resource("parquet", f"{d}/absent.parquet"),
                                  it.Resource("parquet", f"{d}/supplier.parquet", ["s_suppkey"])])
    return found.select("ord", F.get_json_object("text", "$.s_name").alias("name"))


def all_text_rows(spark, d):
    """Whole vectors as JSON text, in millionths: programs print fractions in different ways."""
    millionths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("bigint"))
    rows = load(spark, d, "embeddings").select("vec_id", "label", millionths.alias("embedding"))
    return sinks.all_text(rows.withColumn("pair", F.array("vec_id", "label")))


def vector_documents(spark, d):
    docs = sinks.vector_documents(views.io_pairs(spark, d).drop("input"), ["conv_id", "turn"])
    return docs.select("id", "document", F.to_json("metadata").alias("metadata"))


def jsonl_roundtrip(spark, d):
    """Successful attempts through the JSON-lines sink and back."""
    path = fresh_path(spark, "sink")
    rows = views.attempts(spark, d).select("ord", "output", F.when(F.col("passed"), "success").otherwise("exhausted").alias("status"))
    sinks.create_sink("jsonl", path)(rows)
    return spark.read.schema("ord bigint, output string, status string").json(path)


def registered_parquet(spark, d):
    tables.register_parquet(spark, "mill_supplier", f"{d}/supplier.parquet")
    return tables.run_sql(spark, "SELECT s_nationkey, count(*) AS n, min(s_name) AS first_name FROM mill_supplier GROUP BY s_nationkey")


def registered_csv(spark, d):
    path = fresh_path(spark, "csv")
    load(spark, d, "part").write.option("header", True).csv(path)
    tables.register_csv(spark, "mill_part", path)
    return tables.run_sql(spark, "SELECT p_brand, count(*) AS n, max(p_size) AS largest FROM mill_part GROUP BY p_brand")


PRICING_SUMMARY = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
 FROM {li} WHERE l_shipdate <= {before} GROUP BY l_returnflag, l_linestatus"""

NATION_REVENUE = """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
 FROM {c} JOIN {o} ON c_custkey = o_custkey JOIN {l} ON l_orderkey = o_orderkey JOIN {n} ON c_nationkey = n_nationkey
 JOIN {r} ON n_regionkey = r_regionkey WHERE r_name = {region} GROUP BY n_name"""


def _register(spark, d, *names):
    for name in names:
        tables.register_parquet(spark, f"mill_{name}", f"{d}/{name}.parquet")


def sql_pricing_summary(spark, d):
    _register(spark, d, "lineitem")
    return tables.run_sql(spark, PRICING_SUMMARY.format(li="mill_lineitem", before="CAST(? AS DATE)"), ["2000-09-02"])


def sql_nation_revenue(spark, d):
    _register(spark, d, "customer", "orders", "lineitem", "nation", "region")
    names = dict(c="mill_customer", o="mill_orders", l="mill_lineitem", n="mill_nation", r="mill_region", region=":region")
    return tables.run_sql(spark, NATION_REVENUE.format(**names), {"region": "ASIA"})


RANKED = """SELECT o_custkey, o_orderkey, CAST(rk AS INTEGER) AS rk FROM (SELECT o_custkey, o_orderkey,
 rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM {o}) t WHERE rk <= {k}"""


def sql_top_orders(spark, d):
    _register(spark, d, "orders")
    return tables.run_sql(spark, RANKED.format(o="mill_orders", k=":k"), {"k": 2})


GROUPED = """SELECT p_brand, p_type, count(*) AS n, min(p_retailprice) AS cheapest FROM {p} GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), ())"""


def sql_grouping_sets(spark, d):
    _register(spark, d, "part")
    return tables.run_sql(spark, GROUPED.format(p="mill_part"))


QUERIES = {
    "event_levels": event_levels, "emitted_events": emitted_events, "deliveries": deliveries, "delivery_counts": delivery_counts,
    "phase_changes": phase_changes,
    "recent_events": recent_events, "tumbling_counts": tumbling_counts, "sliding_counts": sliding_counts,
    "session_counts": session_counts, "row_items": row_items, "corpus_items": corpus_items, "first_resource": first_resource,
    "all_text_rows": all_text_rows, "vector_documents": vector_documents, "jsonl_roundtrip": jsonl_roundtrip,
    "registered_parquet": registered_parquet, "registered_csv": registered_csv, "sql_pricing_summary": sql_pricing_summary,
    "sql_nation_revenue": sql_nation_revenue, "sql_top_orders": sql_top_orders, "sql_grouping_sets": sql_grouping_sets,
}

EVENTS = f"""te AS (SELECT event_id, ts, event_type, mission_id, value, props, CASE WHEN value > 200.0 THEN 3 WHEN event_type IN
  ('STATUS_UPDATE', 'ERROR', 'APPROVAL_REQUIRED') THEN 1 WHEN event_type = 'TRACE_EVENT' THEN 3 ELSE 2 END AS level FROM (
  SELECT event_id, ts, {TYPE} AS event_type, CASE WHEN value >= 5.0 THEN user_id END AS mission_id, value, props FROM events))"""


SUBSCRIPTIONS = """subs AS (SELECT s_suppkey AS subscriber, CASE WHEN s_nationkey > 0 THEN s_nationkey END AS mission_id,
  least(greatest(CAST(trunc(s_acctbal / 2500) AS INTEGER), 1), 3) AS level FROM supplier)"""
RECEIVED = "e.level <= s.level AND (s.mission_id IS NULL OR e.mission_id IS NULL OR s.mission_id = e.mission_id)"


def _counts(by: str, start: str, source: str = "events") -> str:
    return f"SELECT {by}, strftime({start}, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM {source} GROUP BY 1, 2"


PHASES = """u AS (SELECT user_id, ts, event_id, value >= 400.0 AS over, CASE WHEN value >= 100.0 THEN 'production' WHEN value >= 40.0 THEN 'sampling' ELSE 'idle' END AS phase FROM events),
 p AS (SELECT *, lag(phase) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before,
  coalesce(bool_or(over) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS done FROM u)"""

ORACLES = {
    "event_levels": f"WITH {EVENTS} SELECT event_id, event_type, level FROM te",
    "emitted_events": f"WITH {EVENTS} SELECT event_id, level, substr(props, 1, 200) AS props FROM te WHERE level <= 2",
    "deliveries": f"WITH {EVENTS}, {SUBSCRIPTIONS} SELECT e.event_id, s.subscriber FROM te e JOIN subs s ON {RECEIVED} WHERE s.subscriber = 3",
    "delivery_counts": f"""WITH {EVENTS}, {SUBSCRIPTIONS} SELECT s.subscriber, count(e.event_id) AS n
 FROM subs s LEFT JOIN te e ON {RECEIVED} GROUP BY s.subscriber""",
    "phase_changes": f"WITH {PHASES} SELECT user_id, event_id, phase FROM p WHERE NOT done AND phase IS DISTINCT FROM before",
    "recent_events": """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k
 FROM events) WHERE k <= 100""",
    "tumbling_counts": _counts("event_type", "date_trunc('hour', ts)"),
    "sliding_counts": _counts("event_type", "start", """(SELECT event_type, value, time_bucket(INTERVAL 15 MINUTES, ts) - k * INTERVAL 15 MINUTES AS start
 FROM events, (VALUES (0), (1), (2), (3)) w(k))"""),
    "session_counts": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid""",
    "row_items": "SELECT row_number() OVER (ORDER BY c_custkey) AS ord, CAST(to_json(c) AS VARCHAR) AS text FROM customer c",
    "corpus_items": "SELECT page_id, url, sha256(html) AS html_hash FROM pages",
    "first_resource": "SELECT row_number() OVER (ORDER BY s_suppkey) AS ord, s_name AS name FROM supplier",
    "all_text_rows": """SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(label AS VARCHAR) AS label, 
 CAST(to_json(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT))) AS VARCHAR) AS embedding,
 '[' || vec_id || ',' || label || ']' AS pair FROM embeddings""",
    "vector_documents": f"""WITH {IO_PAIRS} SELECT sha256(conv_id || chr(1) || turn || chr(1) || output) AS id, output AS document,
 '{{"conv_id":"' || conv_id || '","turn":"' || turn || '"}}' AS metadata FROM io_pairs""",
    "jsonl_roundtrip": f"WITH {ATTEMPTS} SELECT ord, output, 'success' AS status FROM attempts WHERE passed",
    "registered_parquet": "SELECT s_nationkey, count(*) AS n, min(s_name) AS first_name FROM supplier GROUP BY s_nationkey",
    "registered_csv": "SELECT p_brand, count(*) AS n, max(p_size) AS largest FROM part GROUP BY p_brand",
    "sql_pricing_summary": PRICING_SUMMARY.format(li="lineitem", before="DATE '2000-09-02'"),
    "sql_nation_revenue": NATION_REVENUE.format(c="customer", o="orders", l="lineitem", n="nation", r="region", region="'ASIA'"),
    "sql_top_orders": RANKED.format(o="orders", k=2),
    "sql_grouping_sets": GROUPED.format(p="part"),
}
