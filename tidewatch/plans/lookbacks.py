"""Registered look-back queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import adapters as A
from tidewatch.operators import queries as Q
from tidewatch.plans import reports as R
from tidewatch.plans import trends as T
from tidewatch.plans.registry import query

DAY = "timestamp >= (SELECT as_of FROM now_v) - INTERVAL 1440 MINUTE"


@query("q_logs", f"""SELECT * FROM logs_v WHERE {DAY} AND service = 'svc-a' AND severity = 'ERROR'
  ORDER BY timestamp DESC, id DESC LIMIT 200""", ["logs_v", "now_v"])
def q_logs(spark, sf):
    return Q.query_logs(A.logs(spark, sf), A.as_of(spark, sf), service="svc-a", severity="error", since_minutes=1440)


@query("q_metrics", f"""SELECT * FROM metrics_v WHERE {DAY} AND metric_name = 'view' ORDER BY timestamp DESC, id DESC LIMIT 200""", ["metrics_v", "now_v"])
def q_metrics(spark, sf):
    return Q.query_metrics(A.metrics(spark, sf), A.as_of(spark, sf), metric_name="view", since_minutes=1440)


@query("q_traces", f"""SELECT id, timestamp, trace_id, service, operation, ROUND(duration_ms, 4) AS duration_ms, is_slow, has_error FROM traces_v
  WHERE {DAY} AND service = 'svc-b' AND is_slow AND has_error ORDER BY timestamp DESC, id DESC LIMIT 100""", ["traces_v", "now_v"])
def q_traces(spark, sf):
    return Q.query_traces(A.traces(spark, sf), A.as_of(spark, sf), service="svc-b", slow_only=True, errors_only=True,
                          since_minutes=1440).withColumn("duration_ms", F.round("duration_ms", 4))


@query("q_events", """SELECT * FROM k8s_v WHERE timestamp >= (SELECT as_of FROM k8s_now_v) - INTERVAL 1440 MINUTE AND source = 'kubernetes'
  AND reason = 'BackOff' ORDER BY timestamp DESC, id DESC LIMIT 100""", ["k8s_v", "k8s_now_v"])
def q_events(spark, sf):
    return Q.query_events(A.k8s_events(spark, sf), A.k8s_as_of(spark, sf), source="kubernetes", reason="BackOff", since_minutes=1440)


@query("q_analysis_list", """SELECT service, timestamp, health_status, confidence, summary FROM report_v ORDER BY timestamp DESC, service DESC LIMIT 10""", ["report_v"])
def q_analysis_list(spark, sf):
    return Q.list_analyses(R.analyses(spark, sf)).select("service", "timestamp", "health_status", "confidence", "summary")


@query("q_analysis_latest", """SELECT service, timestamp, health_status, confidence, summary FROM report_v ORDER BY timestamp DESC, service DESC LIMIT 1""", ["report_v"])
def q_analysis_latest(spark, sf):
    return Q.latest_analysis(R.analyses(spark, sf)).select("service", "timestamp", "health_status", "confidence", "summary")


@query("q_trends", """SELECT DISTINCT timestamp, query_name, description, range_window, step, series_count FROM trend_v
  WHERE timestamp >= (SELECT as_of FROM now_v) - INTERVAL 168 HOUR AND query_name = 'error' ORDER BY timestamp DESC, query_name DESC LIMIT 50""", ["trend_v", "now_v"])
def q_trends(spark, sf):
    return Q.query_trends(T.records(spark, sf), A.as_of(spark, sf), "error", since_hours=168).drop("analysis")


@query("q_event_importance", """SELECT * FROM k8s_v WHERE event_type = 'Warning' OR reason IN ('OOMKilled', 'CrashLoopBackOff', 'BackOff', 'Failed',
  'FailedScheduling', 'Evicted', 'Unhealthy', 'ImagePullBackOff', 'ErrImagePull')""", ["k8s_v"])
def q_event_importance(spark, sf):
    return Q.important_events(A.k8s_events(spark, sf))


@query("q_topn_per_group", """SELECT * FROM metrics_v QUALIFY ROW_NUMBER() OVER (PARTITION BY metric_name ORDER BY timestamp DESC, id DESC) <= 50""", ["metrics_v"])
def q_topn_per_group(spark, sf):
    return Q.top_per_group(A.metrics(spark, sf), ["metric_name"], [F.desc("timestamp"), F.desc("id")], 50)


@query("q_log_filter_ui", """SELECT * FROM logs_v WHERE severity = 'WARN' ORDER BY timestamp DESC, id DESC LIMIT 200""", ["logs_v"])
def q_log_filter_ui(spark, sf):
    return Q.filter_logs_view(A.logs(spark, sf), "WARN")
