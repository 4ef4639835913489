"""Registered reports, and the views of model outputs and stored reports that other plans use."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import adapters as A
from tidewatch.functions import scalar as S
from tidewatch.functions.series import floor_ts
from tidewatch.operators import reports as R
from tidewatch.plans import trends as T
from tidewatch.plans.registry import query
from tidewatch.plans.views import add_view, fixed as r

SIX_HOURS = 6 * 3600

add_view("totals_v", """
  SELECT service, TIME_BUCKET(INTERVAL 6 HOUR, timestamp, TIMESTAMP '2000-01-01') AS timestamp, COUNT(*) AS total_logs,
    COUNT(*) FILTER (severity = 'ERROR') AS total_errors, COUNT(*) FILTER (severity = 'WARN') AS total_warns FROM logs_v GROUP BY 1, 2""", "logs_v")
add_view("slow_v", """
  SELECT service, TIME_BUCKET(INTERVAL 6 HOUR, timestamp, TIMESTAMP '2000-01-01') AS timestamp,
    COUNT(*) FILTER (is_slow) AS slow_traces, MAX(duration_ms) AS max_ms FROM traces_v GROUP BY 1, 2""", "traces_v")
add_view("outputs_v", f"""
  SELECT *, anomaly_score > 0.5E0 AS is_anomaly,
    CASE WHEN anomaly_score > 0.5E0 THEN 'Anomaly detected (score: ' || PRINTF('%.2f', {r('anomaly_score', 2)}) || '), dominant signal: ' ||
      CASE WHEN lstm_score > if_score THEN 'temporal pattern (LSTM)' ELSE 'statistical outlier (IF)' END
      ELSE 'Normal (score: ' || PRINTF('%.2f', {r('anomaly_score', 2)}) || ')' END AS details,
    CASE WHEN anomaly_score <= 0.5E0 THEN 'normal' WHEN total_errors > total_warns THEN 'config_error' ELSE 'downstream_timeout' END AS cause,
    {r('0.5E0 + rate / 2', 4)} AS cause_confidence, {r('total_warns / total_logs', 4)} AS leak_p, {r('(0.5E0 - rate / 2) / 2', 4)} AS spike_p
  FROM (SELECT *, {r('0.4E0 * if_score + 0.6E0 * lstm_score', 4)} AS anomaly_score FROM (
    SELECT *, total_errors / total_logs AS rate, {r('LEAST(1.0E0, 2.5E0 * total_errors / total_logs)', 4)} AS if_score,
      {r('LEAST(1.0E0, 1.6E0 * slow_traces / total_logs)', 4)} AS lstm_score
    FROM totals_v JOIN slow_v USING (service, timestamp)))""", "totals_v", "slow_v")

TITLE = ("CASE cause WHEN 'normal' THEN 'Normal' WHEN 'config_error' THEN 'Config Error' ELSE 'Downstream Timeout' END")
add_view("report_v", f"""
  SELECT service, timestamp,
    CASE WHEN is_anomaly AND anomaly_score > 0.8E0 THEN 'CRITICAL' WHEN is_anomaly OR n_alerts > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health_status,
    0.8E0 AS confidence,
    CASE WHEN is_anomaly OR n_alerts > 0 THEN 'Detected ' || CASE WHEN is_anomaly THEN '1' ELSE '0' END || ' anomalies and ' || CAST(n_alerts AS VARCHAR) ||
      ' forecast alerts. System status: ' || CASE WHEN is_anomaly AND anomaly_score > 0.8E0 THEN 'CRITICAL' ELSE 'DEGRADED' END || '.'
      ELSE 'All metrics within normal parameters. No anomalies or forecast alerts.' END AS summary,
    is_anomaly::INT AS n_anomalies, CASE WHEN is_anomaly THEN CASE WHEN anomaly_score > 0.8E0 THEN 'critical' WHEN anomaly_score > 0.6E0 THEN 'high' ELSE 'medium' END END AS severity,
    details, 'Anomaly score: ' || PRINTF('%.2f', {r('anomaly_score', 2)}) || ' (IF: ' || PRINTF('%.2f', {r('if_score', 2)}) || ', LSTM: ' || PRINTF('%.2f', {r('lstm_score', 2)}) || ')' AS evidence,
    rate_alert, latency_alert, n_alerts, error_conf, latency_conf,
    CASE WHEN error_conf > 0.8E0 THEN 'immediate' ELSE 'short_term' END AS error_priority, CASE WHEN latency_conf > 0.8E0 THEN 'immediate' ELSE 'short_term' END AS latency_priority,
    'Proactive: error_rate predicted to breach threshold in ' || CAST(1 + total_errors % 15 AS VARCHAR) || ' steps' AS error_action,
    'Proactive: latency_p99 predicted to breach threshold in ' || CAST(1 + slow_traces % 15 AS VARCHAR) || ' steps' AS latency_action,
    'Predicted value: ' || CAST({r('rate', 4)} AS VARCHAR) || ', threshold: 0.05, confidence: ' || CAST(error_conf AS VARCHAR) AS error_reason,
    'Predicted value: ' || CAST({r('max_ms', 4)} AS VARCHAR) || ', threshold: 500.0, confidence: ' || CAST(latency_conf AS VARCHAR) AS latency_reason,
    cause, cause_confidence, leak_p, spike_p, {TITLE} AS cause_title,
    CASE WHEN cause = 'normal' THEN 0 ELSE 1 + (leak_p > 0.1E0)::INT + (spike_p > 0.1E0)::INT END AS n_roots
  FROM (SELECT *, rate > 0.2E0 AS rate_alert, max_ms > 2500 AS latency_alert, (rate > 0.2E0)::INT + (max_ms > 2500)::INT AS n_alerts,
      {r('LEAST(1.0E0, total_errors / 10)', 2)} AS error_conf, {r('slow_traces / total_logs', 2)} AS latency_conf FROM outputs_v)""", "outputs_v")


def totals(spark: SparkSession, sf: str) -> DataFrame:
    """Log and trace totals per service and six hours."""
    at = floor_ts("timestamp", SIX_HOURS).alias("timestamp")
    logs = A.logs(spark, sf).groupBy("service", at).agg(
        F.count(F.lit(1)).alias("total_logs"), F.count_if(F.col("severity") == "ERROR").alias("total_errors"),
        F.count_if(F.col("severity") == "WARN").alias("total_warns"))
    traces = A.traces(spark, sf).groupBy("service", at).agg(F.count_if("is_slow").alias("slow_traces"), F.max("duration_ms").alias("max_ms"))
    return logs.join(traces, ["service", "timestamp"])


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in model outputs derived from the totals, in the shape the report operator expects."""
    df = totals(spark, sf)
    rate, slow = F.col("total_errors") / F.col("total_logs"), F.col("slow_traces") / F.col("total_logs")
    df = df.withColumns({"rate": rate, "if_score": S.fixed(F.least(F.lit(1.0), 2.5 * rate), 4), "lstm_score": S.fixed(F.least(F.lit(1.0), 1.6 * slow), 4)})
    df = df.withColumn("anomaly_score", S.fixed(0.4 * F.col("if_score") + 0.6 * F.col("lstm_score"), 4))
    score = F.col("anomaly_score")
    cause = F.when(score <= 0.5, "normal").when(F.col("total_errors") > F.col("total_warns"), "config_error").otherwise("downstream_timeout")
    conf = S.fixed(0.5 + F.col("rate") / 2, 4)
    alert = lambda metric, step, value, limit, p: F.struct(
        F.lit(metric).alias("metric"), (1 + step % 15).cast("int").alias("step"), S.fixed(value, 4).alias("predicted_value"),
        F.lit(limit).alias("threshold"), S.fixed(p, 2).alias("confidence"))
    alerts = R.present(
        F.when(F.col("rate") > 0.2, alert("error_rate", F.col("total_errors"), F.col("rate"), 0.05, F.least(F.lit(1.0), F.col("total_errors") / 10))),
        F.when(F.col("max_ms") > 2500, alert("latency_p99", F.col("slow_traces"), F.col("max_ms"), 500.0, slow)))
    top = F.array(*[F.struct(c.alias("cause"), p.alias("probability")) for c, p in (
        (cause, conf), (F.lit("memory_leak"), S.fixed(F.col("total_warns") / F.col("total_logs"), 4)),
        (F.lit("request_spike"), S.fixed((0.5 - F.col("rate") / 2) / 2, 4)))])
    from tidewatch.ml.ensemble import details
    return df.select(
        "service", "timestamp", "anomaly_score", "if_score", "lstm_score", (score > 0.5).alias("is_anomaly"), details().alias("details"),
        alerts.alias("breach_alerts"), cause.alias("predicted_cause"), conf.alias("cause_confidence"), top.alias("top_causes"))


def analyses(spark: SparkSession, sf: str) -> DataFrame:
    return R.stored_analysis(R.model_report(outputs(spark, sf)))


def joined(array: str, *fields: str):
    """Array of structs as text, for comparison."""
    return F.array_join(F.transform(array, lambda a: F.concat_ws("~", *[a[f].cast("string") for f in fields])), "|")


@query("rpt_health_rules", f"""
  SELECT service, timestamp, CASE WHEN rate > 0.1E0 THEN 'CRITICAL' WHEN rate > 0.02E0 OR slow_traces > 10 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health_status,
    0.6E0 AS confidence, 'Rule-based analysis: ' || CAST((rate > 0.02E0)::INT + (slow_traces > 10)::INT AS VARCHAR) || ' issues detected (ML server offline)' AS summary,
    CONCAT_WS('|', CASE WHEN rate > 0.1E0 THEN 'High error rate~critical~Error rate at ' || PRINTF('%.1f%%', {r('rate * 100', 1)}) || ' (' || total_errors || ' errors)~' || total_errors || ' errors out of ' || total_logs || ' logs'
      WHEN rate > 0.02E0 THEN 'Elevated error rate~medium~Error rate at ' || PRINTF('%.1f%%', {r('rate * 100', 1)}) || '~' || total_errors || ' errors out of ' || total_logs || ' logs' END,
      CASE WHEN slow_traces > 10 THEN 'Slow traces detected~' || CASE WHEN slow_traces > 20 THEN 'high' ELSE 'medium' END || '~' || slow_traces || ' slow traces in the last window~' || slow_traces || ' traces exceeded latency threshold' END) AS anomalies
  FROM (SELECT *, total_errors / GREATEST(total_logs, 1) AS rate FROM totals_v JOIN slow_v USING (service, timestamp))""", ["totals_v", "slow_v"])
def rpt_health_rules(spark, sf):
    return R.rule_report(totals(spark, sf)).select(
        "service", "timestamp", "health_status", "confidence", "summary", joined("anomalies", "title", "severity", "detail", "evidence").alias("anomalies"))


@query("rpt_ml_report", f"""
  SELECT service, timestamp, health_status, confidence, summary,
    CASE WHEN n_anomalies = 1 THEN 'Metric anomaly detected~' || severity || '~' || details || '~' || evidence ELSE '' END AS anomalies,
    CONCAT_WS('|', CASE WHEN cause <> 'normal' THEN cause_title || '~ML classifier identified ' || cause || ' with ' || PRINTF('%.0f%%', {r('cause_confidence * 100', 0)}) || ' confidence~' || CAST(cause_confidence AS VARCHAR) END,
      CASE WHEN cause <> 'normal' AND leak_p > 0.1E0 THEN 'Memory Leak~Alternative root cause (' || PRINTF('%.0f%%', {r('leak_p * 100', 0)}) || ')~' || CAST(leak_p AS VARCHAR) END,
      CASE WHEN cause <> 'normal' AND spike_p > 0.1E0 THEN 'Request Spike~Alternative root cause (' || PRINTF('%.0f%%', {r('spike_p * 100', 0)}) || ')~' || CAST(spike_p AS VARCHAR) END) AS root_causes,
    CONCAT_WS('|', CASE WHEN rate_alert THEN error_action || '~' || error_reason || '~' || error_priority || '~' END,
      CASE WHEN latency_alert THEN latency_action || '~' || latency_reason || '~' || latency_priority || '~' END) AS recommendations
  FROM report_v""", ["report_v"])
def rpt_ml_report(spark, sf):
    return R.model_report(outputs(spark, sf)).select(
        "service", "timestamp", "health_status", "confidence", "summary",
        joined("anomalies", "title", "severity", "detail", "evidence").alias("anomalies"),
        joined("root_causes", "issue", "probable_cause", "confidence").alias("root_causes"),
        joined("recommendations", "action", "reason", "priority", "command").alias("recommendations"))


@query("rpt_status_from_severity", """
  SELECT service, timestamp, CASE severity WHEN 'critical' THEN 'CRITICAL' WHEN 'high' THEN 'DEGRADED' WHEN 'medium' THEN 'DEGRADED' ELSE 'HEALTHY' END AS status
  FROM report_v""", ["report_v"])
def rpt_status_from_severity(spark, sf):
    return analyses(spark, sf).select("service", "timestamp", R.status_from_severity(F.col("anomalies")).alias("status"))


@query("rpt_unknown_fallback", """
  SELECT t.service, t.timestamp, COALESCE(r.health_status, 'UNKNOWN') AS health_status, COALESCE(r.confidence, 0.0E0) AS confidence,
    COALESCE(r.summary, 'ML analysis failed: no model output') AS summary,
    CASE WHEN r.service IS NULL THEN 'Check ML model server connectivity~Error: no model output~immediate' END AS first_recommendation
  FROM totals_v t LEFT JOIN (SELECT * FROM report_v WHERE n_anomalies = 1) r ON t.service = r.service AND t.timestamp = r.timestamp""", ["totals_v", "report_v"])
def rpt_unknown_fallback(spark, sf):
    anomalous = R.model_report(outputs(spark, sf).filter("is_anomaly"))
    found = totals(spark, sf).select("service", "timestamp").join(anomalous, ["service", "timestamp"], "left")
    full = R.with_fallback(found, F.lit("no model output"))
    first = F.get("recommendations", F.lit(0))
    return full.select("service", "timestamp", "health_status", "confidence", "summary", F.when(
        F.col("health_status") == "UNKNOWN", F.concat_ws("~", first["action"], first["reason"], first["priority"])).alias("first_recommendation"))


@query("snk_store_analysis", """
  SELECT service, timestamp, health_status, confidence, '' AS summary, '' AS raw_response, n_anomalies, 0 AS n_recommendations FROM report_v""", ["report_v"])
def snk_store_analysis(spark, sf):
    payload = R.model_report(outputs(spark, sf)).select("service", "timestamp", "health_status", "confidence", "anomalies")
    return R.stored_analysis(payload).select(
        "service", "timestamp", "health_status", "confidence", "summary", "raw_response", F.array_size("anomalies").alias("n_anomalies"),
        F.array_size("recommendations").alias("n_recommendations"))


def context_lines(spark: SparkSession, sf: str, caps: dict[str, int] | None = None) -> DataFrame:
    """All eight sections per service (events and metrics have no service and use ``all``), whole but for those that ``caps`` names."""
    section = lambda df, keys, name, order, line: R.ranked_section(df, keys, name, order, line, (caps or {}).get(name))
    logs, traces, run = A.logs(spark, sf), A.traces(spark, sf), ["service"]
    newest = [F.desc("timestamp"), F.desc("id")]
    summary = T.T.trend_summary(T.records(spark, sf)).withColumn("service", F.col("labels")["service_name"])
    everything = F.lit("all").alias("service")
    metric = A.metrics(spark, sf).groupBy("metric_name").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("value", F.struct("timestamp", "id")).alias("latest")).withColumn("service", F.lit("all"))
    parts = [
        section(logs.filter(F.col("severity") == "ERROR"), run, "error_logs", newest, R.log_line(300)),
        section(traces.filter("is_slow").withColumn("duration_ms", F.round("duration_ms", 2)), run, "slow_traces", newest, R.slow_line()),
        section(traces.filter("has_error").withColumn("duration_ms", F.round("duration_ms", 2)), run, "error_traces", newest, R.trace_line()),
        section(A.k8s_events(spark, sf).withColumn("service", everything), run, "k8s_events", newest, R.event_line()),
        section(metric, run, "metrics", [F.col("metric_name")], F.concat(
            F.lit("  "), F.col("metric_name"), F.lit(": "), F.col("n").cast("string"), F.lit(" samples, latest="), F.col("latest"))),
        section(logs.filter(F.col("severity") == "WARN"), run, "warning_logs", newest, R.log_line(200)),
        section(summary.filter(F.col("class") == "degrading"), run, "degrading", [F.desc("trend_pct"), F.col("query")], R.degrading_line()),
        section(summary.filter(F.col("class") == "improving"), run, "improving", [F.col("trend_pct"), F.col("query")], R.improving_line()),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


LINE_TS = "STRFTIME(timestamp, '%Y-%m-%d %H:%M:%S.%f')"
# Spark prints a timestamp without trailing zeros of the fraction
add_view("l", f"SELECT *, RTRIM(RTRIM({LINE_TS}, '0'), '.') AS ts FROM logs_v", "logs_v")
RN = "ROW_NUMBER() OVER (PARTITION BY service ORDER BY timestamp DESC, id DESC)::INT AS rank"


@query("rpt_context_lines", f"""
  SELECT * FROM (
  SELECT service, 'error_logs' AS section, {RN}, '[' || ts || '] ' || service || ': ' || SUBSTRING(message, 1, 300) AS line FROM l WHERE severity = 'ERROR' QUALIFY rank <= 40
  UNION ALL SELECT service, 'slow_traces', {RN}, '  ' || service || ' ' || operation || ' — ' || CAST(ROUND(duration_ms, 2) AS VARCHAR) || 'ms (trace: ' || SUBSTRING(trace_id, 1, 16) || ')' FROM traces_v WHERE is_slow QUALIFY rank <= 20
  UNION ALL SELECT service, 'error_traces', {RN}, '  ' || service || ' ' || operation || ' — ' || CAST(ROUND(duration_ms, 2) AS VARCHAR) || 'ms' FROM traces_v WHERE has_error QUALIFY rank <= 20
  UNION ALL SELECT 'all', 'k8s_events', ROW_NUMBER() OVER (ORDER BY timestamp DESC, id DESC)::INT AS rank, '  ' || reason || ': ' || pod || ' — ' || SUBSTRING(message, 1, 200) FROM k8s_v QUALIFY rank <= 20
  UNION ALL SELECT 'all', 'metrics', ROW_NUMBER() OVER (ORDER BY metric_name)::INT AS rank, '  ' || metric_name || ': ' || COUNT(*) || ' samples, latest=' || ARG_MAX(value, (timestamp, id)) FROM metrics_v GROUP BY metric_name QUALIFY rank <= 15
  UNION ALL SELECT service, 'warning_logs', {RN}, '[' || ts || '] ' || service || ': ' || SUBSTRING(message, 1, 200) FROM l WHERE severity = 'WARN' QUALIFY rank <= 20
  UNION ALL SELECT service, 'degrading', ROW_NUMBER() OVER (PARTITION BY service ORDER BY trend_pct DESC, query_name)::INT AS rank, '  [' || query_name || '] ' || service || ' (' || range_window || ' window) Change: +' || PRINTF('%.1f', {r('trend_pct', 1)}) || '% | Latest: ' || CAST(latest AS VARCHAR) || ' | Avg: ' || CAST(avg AS VARCHAR) || ' | Volatility(CV): ' || PRINTF('%.1f', {r('volatility_cv', 1)}) || '%' FROM trend_class_v WHERE class = 'degrading' QUALIFY rank <= 15
  UNION ALL SELECT service, 'improving', ROW_NUMBER() OVER (PARTITION BY service ORDER BY trend_pct, query_name)::INT AS rank, '  [' || query_name || '] ' || service || ': ' || PRINTF('%.1f', {r('trend_pct', 1)}) || '% (' || direction || ')' FROM trend_class_v WHERE class = 'improving' QUALIFY rank <= 10)""",
       ["l", "traces_v", "k8s_v", "metrics_v", "trend_class_v"])
def rpt_context_lines(spark, sf):
    return context_lines(spark, sf, R.SECTIONS)




@query("rpt_incident_timeline", """
  WITH items AS (SELECT service, timestamp, 'error' AS kind, message AS text FROM logs_v WHERE severity = 'ERROR'
      UNION ALL SELECT service, timestamp, 'slow', operation FROM traces_v WHERE is_slow
      UNION ALL SELECT 'svc-' || pod, timestamp, 'event', reason FROM k8s_v WHERE event_type = 'Warning'),
    marked AS (SELECT *, COALESCE(timestamp - LAG(timestamp) OVER (PARTITION BY service ORDER BY timestamp, kind, text) >= INTERVAL 30 MINUTE, TRUE) AS fresh FROM items),
    runs AS (SELECT *, SUM(fresh::INT) OVER (PARTITION BY service ORDER BY timestamp, kind, text ROWS UNBOUNDED PRECEDING) AS run FROM marked)
  SELECT service, MIN(timestamp) AS start, MAX(timestamp) AS "end", COUNT(*) FILTER (kind = 'error') AS errors, COUNT(*) FILTER (kind = 'slow') AS slow,
    COUNT(*) FILTER (kind = 'event') AS events, ARG_MIN(text, (timestamp, kind, text)) AS first_item FROM runs GROUP BY service, run""", ["logs_v", "traces_v", "k8s_v"])
def rpt_incident_timeline(spark, sf):
    items = R.incident_events(A.logs(spark, sf), A.traces(spark, sf), A.k8s_events(spark, sf), F.concat(F.lit("svc-"), F.col("pod")))
    return R.incident_timeline(items)


@query("rpt_nodata_guard", "SELECT EXISTS (SELECT 1 FROM logs_v) OR EXISTS (SELECT 1 FROM k8s_v) AS has_data", ["logs_v", "k8s_v"])
def rpt_nodata_guard(spark, sf):
    return R.has_data(A.logs(spark, sf), A.traces(spark, sf), A.metrics(spark, sf), A.k8s_events(spark, sf))
