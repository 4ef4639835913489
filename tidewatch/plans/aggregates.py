"""Registered aggregates."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import adapters as A
from tidewatch.functions.scalar import fixed as sfixed, short_service
from tidewatch.operators import aggregates as G
from tidewatch.plans import reports as R
from tidewatch.plans.registry import query
from tidewatch.plans.views import fixed as r

DAY = "timestamp >= (SELECT as_of FROM now_v) - INTERVAL 24 HOUR"
K8S_DAY = "timestamp >= (SELECT as_of FROM k8s_now_v) - INTERVAL 24 HOUR"


@query("agg_stats", f"""
  SELECT l.*, t.*, e.* FROM (SELECT COUNT(*) AS total_logs, COUNT(*) FILTER (severity = 'ERROR') AS total_errors FROM logs_v WHERE {DAY}) l,
    (SELECT COUNT(*) AS total_traces, COUNT(*) FILTER (is_slow) AS slow_traces, COUNT(*) FILTER (has_error) AS error_traces FROM traces_v WHERE {DAY}) t,
    (SELECT COUNT(*) AS k8s_events FROM k8s_v WHERE {K8S_DAY} AND source = 'kubernetes') e""", ["logs_v", "traces_v", "k8s_v", "now_v", "k8s_now_v"])
def agg_stats(spark, sf):
    return G.stats_row(A.logs(spark, sf), A.traces(spark, sf), A.k8s_events(spark, sf), A.as_of(spark, sf), A.k8s_as_of(spark, sf), hours=24)


@query("agg_errors_by_service", f"""SELECT service, COUNT(*) AS cnt FROM logs_v WHERE {DAY} AND severity = 'ERROR' GROUP BY 1""", ["logs_v", "now_v"])
def agg_errors_by_service(spark, sf):
    return G.errors_by_service(A.logs(spark, sf), A.as_of(spark, sf), hours=24)


@query("agg_latency_by_service", f"""SELECT service, {r('AVG(duration_ms)', 6)} AS avg_ms, {r('MAX(duration_ms)', 6)} AS max_ms FROM traces_v WHERE {DAY} GROUP BY 1""", ["traces_v", "now_v"])
def agg_latency_by_service(spark, sf):
    return G.latency_by_service(A.traces(spark, sf), A.as_of(spark, sf), hours=24).select("service", sfixed("avg_ms", 6).alias("avg_ms"), sfixed("max_ms", 6).alias("max_ms"))


@query("agg_severity_counts", """SELECT name, COUNT(l.id) AS value FROM (VALUES ('ERROR'), ('WARN'), ('INFO'), ('DEBUG')) s(name) LEFT JOIN logs_v l ON l.severity = name GROUP BY 1""", ["logs_v"])
def agg_severity_counts(spark, sf):
    return G.severity_counts(A.logs(spark, sf))


@query("agg_duration_histogram", """
  SELECT name, COUNT(t.id) AS count FROM (VALUES ('0–100', 0.0E0, 100.0E0), ('100–500', 100.0E0, 500.0E0), ('500–1k', 500.0E0, 1000.0E0),
    ('1k–2k', 1000.0E0, 2000.0E0), ('>2k', 2000.0E0, CAST('Infinity' AS DOUBLE))) b(name, lo, hi)
  LEFT JOIN traces_v t ON COALESCE(t.duration_ms, 0) >= lo AND COALESCE(t.duration_ms, 0) < hi GROUP BY 1""", ["traces_v"])
def agg_duration_histogram(spark, sf):
    return G.duration_histogram(A.traces(spark, sf))


@query("agg_latency_chart", f"""SELECT REPLACE(service, '-service', '') AS service, {r('AVG(duration_ms)', 1)} AS avg, {r('MAX(duration_ms)', 1)} AS max FROM traces_v GROUP BY 1""", ["traces_v"])
def agg_latency_chart(spark, sf):
    t = A.traces(spark, sf)
    return t.groupBy(short_service(F.col("service")).alias("service")).agg(
        sfixed(F.avg("duration_ms"), 1).alias("avg"), sfixed(F.max("duration_ms"), 1).alias("max"))


@query("agg_metrics_by_service", """
  SELECT CASE id % 3 WHEN 0 THEN service WHEN 1 THEN 'otel-collector' ELSE 'other' END AS name, COUNT(*) AS count FROM metrics_v GROUP BY 1""", ["metrics_v"])
def agg_metrics_by_service(spark, sf):
    m = F.col("id") % 3
    labels = (F.when(m == 0, F.create_map(F.lit("service_name"), F.concat(F.col("service"), F.lit("-service"))))
              .when(m == 1, F.create_map(F.lit("job"), F.lit("otel-collector"))))
    return G.metrics_by_service(A.metrics(spark, sf).withColumn("labels", labels))


@query("agg_anomaly_severity", "SELECT severity, COUNT(*) AS n FROM report_v WHERE severity IS NOT NULL GROUP BY 1", ["report_v"])
def agg_anomaly_severity(spark, sf):
    return G.anomaly_severities(R.analyses(spark, sf))


@query("agg_recommendation_priority", """
  SELECT CASE p WHEN 'immediate' THEN 'Immediate' ELSE 'Short-term' END AS priority, COUNT(*) AS n FROM (
    SELECT error_priority AS p FROM report_v WHERE rate_alert UNION ALL SELECT latency_priority FROM report_v WHERE latency_alert) GROUP BY 1""", ["report_v"])
def agg_recommendation_priority(spark, sf):
    return G.recommendation_priorities(R.analyses(spark, sf))


@query("agg_agent_timeseries", "SELECT timestamp, service, ROUND(confidence * 100, 1) AS confidence, n_anomalies AS anomalies, n_roots AS roots FROM report_v", ["report_v"])
def agg_agent_timeseries(spark, sf):
    return G.analysis_series(R.analyses(spark, sf))


@query("agg_health_timeline", """SELECT timestamp, service, health_status AS status, CASE health_status WHEN 'HEALTHY' THEN 4 WHEN 'DEGRADED' THEN 3 WHEN 'CRITICAL' THEN 2 WHEN 'UNKNOWN' THEN 1 ELSE 5 END AS value FROM report_v""", ["report_v"])
def agg_health_timeline(spark, sf):
    return G.health_timeline(R.analyses(spark, sf))


@query("agg_ingest_counts", """
  SELECT l.total_logs, m.total_metrics, t.total_traces, t.slow_count, l.error_count FROM (SELECT COUNT(*) AS total_logs, COUNT(*) FILTER (severity = 'ERROR') AS error_count FROM logs_v) l,
    (SELECT COUNT(*) AS total_metrics FROM metrics_v) m, (SELECT COUNT(*) AS total_traces, COUNT(*) FILTER (is_slow) AS slow_count FROM traces_v) t""", ["logs_v", "metrics_v", "traces_v"])
def agg_ingest_counts(spark, sf):
    return G.ingest_counts(A.logs(spark, sf), A.metrics(spark, sf), A.traces(spark, sf))


@query("agg_metric_rollup", """
  SELECT metric_name, COUNT(*) AS samples, ARG_MAX(value, (timestamp, id)) AS latest FROM metrics_v GROUP BY 1""", ["metrics_v"])
def agg_metric_rollup(spark, sf):
    return G.metric_rollup(A.metrics(spark, sf))


@query("agg_label_distribution", "SELECT severity, COUNT(*) AS n FROM logs_v GROUP BY 1", ["logs_v"])
def agg_label_distribution(spark, sf):
    return G.distribution(A.logs(spark, sf), "severity")


@query("agg_percentiles", f"""
  SELECT {r('AVG(duration_ms)', 6)} AS mean, {r('QUANTILE_CONT(duration_ms, 0.5)', 6)} AS median, {r('QUANTILE_CONT(duration_ms, 0.95)', 6)} AS p95,
    {r('QUANTILE_CONT(duration_ms, 0.99)', 6)} AS p99, {r('STDDEV_POP(duration_ms)', 6)} AS std, {r('MIN(duration_ms)', 6)} AS min, {r('MAX(duration_ms)', 6)} AS max, COUNT(*) AS n_runs FROM traces_v""", ["traces_v"])
def agg_percentiles(spark, sf):
    out = G.measurement_summary(A.traces(spark, sf), "duration_ms")
    return out.withColumns({c: sfixed(c, 6) for c in ("mean", "median", "p95", "p99", "std", "min", "max")})


@query("agg_mode_label", """
  SELECT service, hour, operation FROM (SELECT service, DATE_TRUNC('hour', timestamp) AS hour, operation, COUNT(*) AS n FROM traces_v GROUP BY 1, 2, 3)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY service, hour ORDER BY n DESC, operation) = 1""", ["traces_v"])
def agg_mode_label(spark, sf):
    from tidewatch.functions.series import floor_ts
    t = A.traces(spark, sf).select("service", floor_ts("timestamp", 3600).alias("hour"), "operation")
    return G.mode_label(t, ["service", "hour"], "operation")
