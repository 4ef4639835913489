"""Registered joins and set operations over the telemetry views."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import adapters as A
from tidewatch.functions.scalar import fixed as sfixed
from tidewatch.operators import joins as J
from tidewatch.plans.registry import query
from tidewatch.plans.views import fixed as r


@query("join_nested_enrichment", """
  SELECT COALESCE(k.id, d.id) AS id, k.children, k.has_missing_child, k.n_children, d.details FROM (
    SELECT p.id, STRING_AGG(p.pos || ':' || p.child_id || ':' || COALESCE(c.name, '?'), '|' ORDER BY p.pos, p.child_id) AS children, BOOL_OR(c.id IS NULL) AS has_missing_child, CAST(COUNT(*) AS INT) AS n_children
    FROM parent_v p LEFT JOIN child_v c ON c.id = p.child_id GROUP BY 1) k
  FULL JOIN (SELECT l_orderkey AS id, STRING_AGG(l_linenumber || ':' || CAST(l_quantity AS VARCHAR) || ':' || l_returnflag, '|' ORDER BY l_linenumber, l_quantity, l_returnflag) AS details FROM lineitem GROUP BY 1) d ON d.id = k.id""",
       ["parent_v", "child_v"])
def join_nested_enrichment(spark, sf):
    details = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").alias("rating"), F.col("l_returnflag").alias("flag"))
    out = J.nested_enrichment(A.parents(spark, sf), A.children(spark, sf), details)
    text = lambda arr, f: F.array_join(F.transform(arr, f), "|")
    return out.select("id", text("children", lambda x: F.concat_ws(":", x["pos"].cast("string"), x["child_id"].cast("string"), F.coalesce(x["name"], F.lit("?")))).alias("children"),
                      "has_missing_child", F.size("children").alias("n_children"),
                      text("details", lambda x: F.concat_ws(":", x["pos"].cast("string"), x["rating"].cast("string"), x["flag"])).alias("details"))


@query("join_asof_latest", f"""
  SELECT t.id, t.service, t.timestamp, m.v AS latest FROM (SELECT * FROM traces_v WHERE has_error) t
  ASOF LEFT JOIN (SELECT service, timestamp, TRY_CAST(value AS DOUBLE) AS v FROM metrics_v WHERE metric_name = 'view') m ON t.service = m.service AND t.timestamp >= m.timestamp""", ["traces_v", "metrics_v"])
def join_asof_latest(spark, sf):
    left = A.traces(spark, sf).filter("has_error").select("id", "service", "timestamp")
    right = A.metrics(spark, sf).filter(F.col("metric_name") == "view").select("id", "service", "timestamp", F.col("value").try_cast("double").alias("v"))
    return J.asof_latest(left, right, ["service"], "timestamp", "v", "latest")


@query("join_trace_log_event_corr", """
  SELECT l.id, l.service, l.timestamp,
    (SELECT COUNT(*) FROM traces_v t WHERE t.is_slow AND t.service = l.service AND t.timestamp BETWEEN l.timestamp - INTERVAL 10 MINUTE AND l.timestamp + INTERVAL 10 MINUTE) AS slow_traces,
    (SELECT COUNT(*) FROM svc e WHERE e.event_type = 'signup' AND e.service = l.service AND e.ts BETWEEN l.timestamp - INTERVAL 10 MINUTE AND l.timestamp + INTERVAL 10 MINUTE) AS events
  FROM logs_v l WHERE l.severity = 'ERROR'""", ["logs_v", "traces_v", "svc"])
def join_trace_log_event_corr(spark, sf):
    errors = A.logs(spark, sf).filter(F.col("severity") == "ERROR").select("id", "service", "timestamp")
    return J.near_counts(errors, {
        "slow_traces": A.traces(spark, sf).filter("is_slow").select("service", "timestamp"),
        "events": A.svc(spark, sf).filter(F.col("event_type") == "signup").select("service", F.col("ts").alias("timestamp")),
    }, "service", "timestamp", 600)


@query("set_union_frames", """SELECT id, timestamp, service, message, CAST(NULL AS VARCHAR) AS operation, CAST(NULL AS BOOLEAN) AS is_slow FROM logs_v UNION ALL SELECT id, timestamp, service, NULL, operation, is_slow FROM traces_v""", ["logs_v", "traces_v"])
def set_union_frames(spark, sf):
    return J.union_frames(A.logs(spark, sf).select("id", "timestamp", "service", "message"), A.traces(spark, sf).select("id", "timestamp", "service", "operation", "is_slow"))


@query("set_distinct_keys", "SELECT DISTINCT service, metric_name FROM metrics_v", ["metrics_v"])
def set_distinct_keys(spark, sf):
    return J.distinct_keys(A.metrics(spark, sf), "service", "metric_name")


@query("set_error_warn_messages", """SELECT * FROM logs_v WHERE severity IN ('ERROR', 'WARN') AND message <> ''""", ["logs_v"])
def set_error_warn_messages(spark, sf):
    return J.error_then_warning_messages(A.logs(spark, sf))
