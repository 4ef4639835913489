"""Registered export tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import adapters as A
from tidewatch.functions.scalar import fixed as sfixed
from tidewatch.operators import exports as X
from tidewatch.plans import aggregates as G
from tidewatch.plans import reports as R
from tidewatch.plans import trends as T
from tidewatch.plans.registry import query
from tidewatch.plans.views import fixed as r


def labels():
    return F.create_map(F.lit("service_name"), F.col("service"), F.lit("job"), F.lit("otel"))




@query("x_summary", f"""
  WITH st AS (SELECT (SELECT COUNT(*) FROM logs_v WHERE {G.DAY}) AS a, (SELECT COUNT(*) FROM logs_v WHERE {G.DAY} AND severity = 'ERROR') AS b,
    (SELECT COUNT(*) FROM traces_v WHERE {G.DAY}) AS c, (SELECT COUNT(*) FROM traces_v WHERE {G.DAY} AND is_slow) AS d,
    (SELECT COUNT(*) FROM traces_v WHERE {G.DAY} AND has_error) AS e, (SELECT COUNT(*) FROM k8s_v WHERE {G.K8S_DAY}) AS f)
  SELECT 'Logs (total)' AS data_type, a AS count, 'Last 1440 min' AS notes FROM st UNION ALL SELECT 'Logs (errors)', b, 'Severity = ERROR' FROM st
  UNION ALL SELECT 'Traces (total)', c, 'Last 1440 min' FROM st UNION ALL SELECT 'Traces (slow)', d, 'duration_ms > 500' FROM st
  UNION ALL SELECT 'Traces (error)', e, 'has_error = true' FROM st UNION ALL SELECT 'K8s Events', f, 'Last 1440 min' FROM st""",
       ["logs_v", "traces_v", "k8s_v", "now_v", "k8s_now_v"])
def x_summary(spark, sf):
    return X.summary(G.agg_stats(spark, sf), "Last 1440 min")


@query("x_logs", """SELECT id, timestamp, service, severity, message, namespace, 'service_name=' || service || ', job=otel' AS labels FROM logs_v""", ["logs_v"])
def x_logs(spark, sf):
    return X.logs(A.logs(spark, sf).withColumn("labels", labels()))


@query("x_metrics", """SELECT id, timestamp, metric_name, service, value, 'service_name=' || service || ', job=otel' AS labels FROM metrics_v""", ["metrics_v"])
def x_metrics(spark, sf):
    return X.metrics(A.metrics(spark, sf).withColumn("labels", labels()))


@query("x_traces", """SELECT id, timestamp, trace_id, service, operation, ROUND(duration_ms, 4) AS duration_ms, is_slow, has_error,
  CASE WHEN has_error THEN 'error' WHEN is_slow THEN 'slow' ELSE 'none' END AS highlight FROM traces_v""", ["traces_v"])
def x_traces(spark, sf):
    return X.traces(A.traces(spark, sf)).withColumn("duration_ms", F.round("duration_ms", 4))


@query("x_events", """SELECT id, uid, timestamp, source, pod, reason, event_type, message, event_type = 'Warning' AS is_warning FROM k8s_v""", ["k8s_v"])
def x_events(spark, sf):
    return X.events(A.k8s_events(spark, sf))


@query("x_analysis", """SELECT timestamp, service, health_status, confidence, summary, n_anomalies AS anomaly_count,
  CASE WHEN n_anomalies = 1 THEN 'Metric anomaly detected' ELSE '' END AS top_anomaly, COALESCE(severity, '') AS top_anomaly_severity, n_roots AS root_cause_count,
  CASE WHEN cause = 'normal' THEN '' ELSE cause_title END AS top_root_cause, n_alerts AS recommendation_count,
  CASE WHEN rate_alert THEN error_action WHEN latency_alert THEN latency_action ELSE '' END AS top_recommendation, '' AS bottlenecks FROM report_v""", ["report_v"])
def x_analysis(spark, sf):
    return X.analysis(R.analyses(spark, sf))


@query("x_anomalies", """SELECT timestamp AS analysis_timestamp, service, health_status, severity, 'Metric anomaly detected' AS title, details AS detail,
  '' AS affected_resources, evidence FROM report_v WHERE n_anomalies = 1""", ["report_v"])
def x_anomalies(spark, sf):
    return X.anomalies(R.analyses(spark, sf))


@query("x_recommendations", """SELECT timestamp AS analysis_timestamp, service, error_priority AS priority, error_action AS action, error_reason AS reason, '' AS command FROM report_v WHERE rate_alert
  UNION ALL SELECT timestamp, service, latency_priority, latency_action, latency_reason, '' FROM report_v WHERE latency_alert""", ["report_v"])
def x_recommendations(spark, sf):
    return X.recommendations(R.analyses(spark, sf))


@query("x_trends", """SELECT timestamp, query_name, description, range_window, step, service, data_points, avg, min, max, latest, trend_pct, direction, volatility_cv FROM trend_v""", ["trend_v"])
def x_trends(spark, sf):
    return X.trends(T.records(spark, sf))


@query("x_result_melt", f"""
  UNPIVOT (SELECT service AS model, {r('AVG(duration_ms)', 6)} AS avg_ms, {r('MAX(duration_ms)', 6)} AS max_ms, CAST(COUNT(*) AS DOUBLE) AS n FROM traces_v GROUP BY 1)
  ON avg_ms, max_ms, n INTO NAME metric VALUE value""", ["traces_v"])
def x_result_melt(spark, sf):
    res = A.traces(spark, sf).groupBy(F.col("service").alias("model")).agg(
        sfixed(F.avg("duration_ms"), 6).alias("avg_ms"), sfixed(F.max("duration_ms"), 6).alias("max_ms"), F.count(F.lit(1)).alias("n"))
    return X.melt(res, ["model"])


@query("x_feature_mae_table", f"""
  SELECT operation AS feature, {r("AVG(ABS(duration_ms - 300)) FILTER (id % 5 <> 0)", 6)} AS train, {r("AVG(ABS(duration_ms - 300)) FILTER (id % 5 = 0)", 6)} AS val FROM traces_v GROUP BY 1""", ["traces_v"])
def x_feature_mae_table(spark, sf):
    errors = A.traces(spark, sf).select(F.col("operation").alias("feature"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"),
                                        F.abs(F.col("duration_ms") - 300).alias("abs_error"))
    return X.split_table(errors).select("feature", sfixed("train", 6).alias("train"), sfixed("val", 6).alias("val"))


@query("x_data_sample", """SELECT *, (SELECT COUNT(*) FROM logs_v) AS total_rows FROM logs_v ORDER BY id LIMIT 1000""", ["logs_v"])
def x_data_sample(spark, sf):
    return X.data_sample(A.logs(spark, sf), ["id"])
