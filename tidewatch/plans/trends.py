"""Registered trend queries (daily trend records of the metric samples)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import adapters as A
from tidewatch.functions import scalar as S
from tidewatch.functions.series import ntz
from tidewatch.operators import trends as T
from tidewatch.plans.registry import query
from tidewatch.plans.views import add_view, fixed as r

KEYS = ["query_name", "service", "timestamp"]

add_view("stats_v", """
  SELECT query_name, service, timestamp, COUNT(*) AS data_points, AVG(v) AS avg, MIN(v) AS min, MAX(v) AS max,
    ARG_MAX(v, idx) AS latest,
    CASE WHEN COUNT(*) >= 2 AND AVG(v) FILTER (idx < n // 2) <> 0
         THEN (AVG(v) FILTER (idx >= n // 2) - AVG(v) FILTER (idx < n // 2)) / AVG(v) FILTER (idx < n // 2) * 100 ELSE 0 END AS trend_pct,
    CASE WHEN AVG(v) <> 0 THEN STDDEV_POP(v) / ABS(AVG(v)) * 100 ELSE 0 END AS volatility_cv
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_name, service, timestamp ORDER BY ts, id) - 1 AS idx,
               COUNT(*) OVER (PARTITION BY query_name, service, timestamp) AS n
        FROM (SELECT metric_name AS query_name, service, DATE_TRUNC('day', timestamp) AS timestamp, timestamp AS ts, id,
                     TRY_CAST(value AS DOUBLE) AS v FROM metrics_v) WHERE v IS NOT NULL)
  GROUP BY 1, 2, 3""", "metrics_v")
add_view("trend_v", f"""
  SELECT query_name, service, timestamp, 'Samples of ' || query_name || ' over one day' AS description, '24h' AS range_window, '15m' AS step,
    COUNT(*) OVER (PARTITION BY query_name, timestamp)::INT AS series_count,
    data_points, {r('avg', 4)} AS avg, {r('min', 4)} AS min, {r('max', 4)} AS max, {r('latest', 4)} AS latest,
    {r('trend_pct', 2)} AS trend_pct, {r('volatility_cv', 2)} AS volatility_cv,
    CASE WHEN trend_pct > 5 THEN 'increasing' WHEN trend_pct < -5 THEN 'decreasing' ELSE 'stable' END AS direction
  FROM stats_v""", "stats_v")
add_view("latest_trend_v", """
  SELECT * FROM trend_v QUALIFY RANK() OVER (PARTITION BY query_name ORDER BY timestamp DESC) = 1""", "trend_v")
add_view("trend_class_v", """
  SELECT CASE WHEN direction = 'increasing' AND trend_pct > 10 THEN 'degrading' WHEN direction = 'decreasing' THEN 'improving' ELSE 'stable' END AS class, *
  FROM latest_trend_v""", "latest_trend_v")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return A.metrics(spark, sf).select(
        F.col("metric_name").alias("query_name"), "service", ntz(F.date_trunc("day", "timestamp")).alias("timestamp"),
        F.col("timestamp").alias("ts"), "id", "value")


def stats(spark: SparkSession, sf: str) -> DataFrame:
    return T.series_stats(samples(spark, sf), KEYS, ["ts", "id"], "ts")


def records(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Samples of "), F.col("query_name"), F.lit(" over one day"))
    return T.trend_records(T.rounded(stats(spark, sf)), text, "24h", "15m")


@query("tr_series_stats", "SELECT query_name, service, timestamp, data_points, avg, min, max, latest FROM trend_v", ["trend_v"])
def tr_series_stats(spark, sf):
    return T.rounded(stats(spark, sf)).select(*KEYS, "data_points", "avg", "min", "max", "latest")


@query("tr_half_trend", "SELECT query_name, service, timestamp, trend_pct FROM trend_v", ["trend_v"])
def tr_half_trend(spark, sf):
    return T.rounded(stats(spark, sf)).select(*KEYS, "trend_pct")


@query("tr_volatility", "SELECT query_name, service, timestamp, volatility_cv FROM trend_v", ["trend_v"])
def tr_volatility(spark, sf):
    return T.rounded(stats(spark, sf)).select(*KEYS, "volatility_cv")


@query("tr_direction", "SELECT query_name, service, timestamp, direction FROM trend_v", ["trend_v"])
def tr_direction(spark, sf):
    return stats(spark, sf).select(*KEYS, "direction")


@query("tr_parse_range", """
  SELECT event_id, txt AS range_window, CASE RIGHT(txt, 1) WHEN 'h' THEN n * 3600 WHEN 'd' THEN n * 86400 WHEN 'm' THEN n * 60 ELSE 3600 END AS seconds
  FROM (SELECT event_id, (1 + user_id % 90) AS n, CAST(1 + user_id % 90 AS VARCHAR) ||
          CASE event_id % 4 WHEN 0 THEN 'h' WHEN 1 THEN 'd' WHEN 2 THEN 'm' ELSE 'x' END AS txt FROM events)""")
def tr_parse_range(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in "hdmx"]), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat((F.col("user_id") % 90 + 1).cast("string"), unit)
    return A.table(spark, sf, "events").select("event_id", text.alias("range_window"), S.parse_range_seconds(text).alias("seconds"))


@query("tr_raw_snapshot", """
  SELECT query_name, timestamp, service, values_count, first_value, last_value FROM (
    SELECT metric_name AS query_name, DATE_TRUNC('day', timestamp) AS timestamp, service, COUNT(*) AS values_count,
      ARG_MIN(value, (timestamp, id)) AS first_value, ARG_MAX(value, (timestamp, id)) AS last_value
    FROM metrics_v GROUP BY 1, 2, 3)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY query_name, timestamp ORDER BY service) <= 10""", ["metrics_v"])
def tr_raw_snapshot(spark, sf):
    return T.raw_snapshot(samples(spark, sf), ["query_name", "timestamp"], "service", ["ts", "id"])


@query("tr_latest_per_query", """
  SELECT DISTINCT timestamp, query_name, description, range_window, step, series_count FROM latest_trend_v""", ["latest_trend_v"])
def tr_latest_per_query(spark, sf):
    return T.latest_per_query(records(spark, sf)).drop("analysis")


@query("tr_summary", """
  SELECT class, query_name AS query, description, range_window AS range, service, latest, avg, trend_pct, direction, volatility_cv
  FROM trend_class_v""", ["trend_class_v"])
def tr_summary(spark, sf):
    return T.trend_summary(records(spark, sf)).withColumn("service", F.col("labels")["service_name"]).drop("labels")


@query("tr_summary_counts", """
  SELECT COUNT(*) FILTER (class = 'degrading') AS degrading, COUNT(*) FILTER (class = 'stable') AS stable,
    COUNT(*) FILTER (class = 'improving') AS improving, COUNT(*) AS total_series FROM trend_class_v""", ["trend_class_v"])
def tr_summary_counts(spark, sf):
    return T.summary_counts(T.trend_summary(records(spark, sf)))


@query("tr_timeseries_pivot", f"""
  SELECT timestamp, {r("MAX(latest) FILTER (service = 'svc-a')", 3)} AS "svc-a", {r("MAX(latest) FILTER (service = 'svc-b')", 3)} AS "svc-b",
    {r("MAX(latest) FILTER (service = 'svc-c')", 3)} AS "svc-c" FROM trend_v WHERE query_name = 'error' GROUP BY 1""", ["trend_v"])
def tr_timeseries_pivot(spark, sf):
    return T.history_pivot(records(spark, sf), "error")


@query("tr_current_values", """
  SELECT REPLACE(REGEXP_REPLACE(query_name, '_1h|_24h', '', 'g'), '_', ' ') AS metric, REPLACE(service, '-service', '') AS service,
    latest, avg, trend_pct, direction FROM latest_trend_v""", ["latest_trend_v"])
def tr_current_values(spark, sf):
    return T.current_values(records(spark, sf))


@query("tr_mean_latest", f"SELECT query_name, {r('AVG(latest)', 6)} AS latest FROM trend_v GROUP BY 1", ["trend_v"])
def tr_mean_latest(spark, sf):
    return T.mean_latest(records(spark, sf)).withColumn("latest", S.fixed("latest", 6))
