"""Registered model queries. Fitted models are kept for the session, one per data folder."""
from __future__ import annotations

from datetime import timedelta
from functools import lru_cache

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import adapters as A
from tidewatch.constants import CAPACITY_THRESHOLDS, FEATURES
from tidewatch.functions.scalar import fixed as sfixed
from tidewatch.functions.series import floor_ts, ntz
from tidewatch.ml import ensemble as EN
from tidewatch.ml import forecast as FC
from tidewatch.ml import logs as L
from tidewatch.ml import pipeline as P
from tidewatch.ml import reconstruction as RE
from tidewatch.ml import rootcause as RC
from tidewatch.ml.neighbours import nearest_same_class
from tidewatch.operators import evaluation as V
from tidewatch.operators import windows as OW
from tidewatch.operators.aggregates import mode_label
from tidewatch.operators.reports import service_context
from tidewatch.plans import reports as PR
from tidewatch.plans import windows as W
from tidewatch.plans.registry import query
from tidewatch.plans.views import add_view, fixed as r
from tidewatch.session import cut, run_dir, settled


# ---- shared inputs ----------------------------------------------------------
@lru_cache(maxsize=8)
def _inputs(app: str, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = SparkSession.getActiveSession()
    wide = cut(W.row_labelled(spark, sf))
    windows = cut(W.windows(spark, sf))
    rich = OW.rich_stats(windows).join(W.labelled(spark, sf).select("window_id", "label"), "window_id")
    return wide, windows, cut(rich)


def inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(labelled metric rows, windows, rich window features with the label that the rules give)``."""
    return _inputs(spark.sparkContext.applicationId, sf)


@lru_cache(maxsize=8)
def _anomaly(app: str, sf: str):
    wide, _, rich = _inputs(app, sf)
    return P.fit_anomaly(wide, rich)


@lru_cache(maxsize=8)
def _forecaster(app: str, sf: str):
    return P.fit_forecaster(_inputs(app, sf)[0])


@lru_cache(maxsize=8)
def _cause(app: str, sf: str):
    return P.fit_cause(_inputs(app, sf)[2])


def anomaly(spark: SparkSession, sf: str):
    """``(forest, reconstruction)``."""
    return _anomaly(spark.sparkContext.applicationId, sf)


def forecaster(spark: SparkSession, sf: str):
    return _forecaster(spark.sparkContext.applicationId, sf)


def cause(spark: SparkSession, sf: str) -> tuple:
    return _cause(spark.sparkContext.applicationId, sf)


def models(spark: SparkSession, sf: str) -> P.Models:
    forest, rec = anomaly(spark, sf)
    return P.Models(forest, rec, forecaster(spark, sf), cause(spark, sf))


# ---- anomaly ----------------------------------------------------------------
@query("ml_iforest_fit_score")
def ml_iforest_fit_score(spark, sf):
    return anomaly(spark, sf)[0].transform(inputs(spark, sf)[2])


@query("ml_reconstruction_error")
def ml_reconstruction_error(spark, sf):
    rec = anomaly(spark, sf)[1]
    return OW.sequences(rec.scaler.transform(inputs(spark, sf)[0])).select("service", "timestamp", rec.error().alias("error"))


@query("ml_error_threshold", f"SELECT {r('QUANTILE_CONT(latency_p99 / 1000, 0.95)', 6)} AS threshold FROM row_label_v WHERE label = 'normal'", ["row_label_v"])
def ml_error_threshold(spark, sf):
    df = W.row_labelled(spark, sf).select((F.col("latency_p99") / 1000).alias("error"), (F.col("label") != "normal").cast("int").alias("is_anomaly"))
    return RE.normal_threshold(df).select(sfixed("threshold", 6).alias("threshold"))


@query("ml_ensemble_score", f"""
  SELECT service, timestamp, {r('score', 6)} AS anomaly_score, score > 0.5E0 AS is_anomaly, CASE WHEN score > 0.5E0 THEN 'Anomaly detected (score: ' || PRINTF('%.2f', {r('score', 2)}) || '), dominant signal: ' ||
    CASE WHEN ls > if_score THEN 'temporal pattern (LSTM)' ELSE 'statistical outlier (IF)' END ELSE 'Normal (score: ' || PRINTF('%.2f', {r('score', 2)}) || ')' END AS details
  FROM (SELECT *, 0.4E0 * if_score + 0.6E0 * ls AS score FROM (SELECT *, LEAST(GREATEST(slow_traces / total_logs / (0.3E0 * 2), 0), 1) AS ls FROM outputs_v))""", ["outputs_v"])
def ml_ensemble_score(spark, sf):
    t = PR.totals(spark, sf)
    df = t.select("service", "timestamp", sfixed(F.least(F.lit(1.0), 2.5 * F.col("total_errors") / F.col("total_logs")), 4).alias("if_score"),
                  EN.sequence_score(F.col("slow_traces") / F.col("total_logs"), F.lit(0.3)).alias("lstm_score"))
    return EN.ensemble(df).select("service", "timestamp", sfixed("anomaly_score", 6).alias("anomaly_score"), "is_anomaly", "details")


# ---- forecast ---------------------------------------------------------------
@query("ml_forecast")
def ml_forecast(spark, sf):
    fc = forecaster(spark, sf)
    rows = OW.left_pad(fc.scaler.transform(inputs(spark, sf)[0]), ["service"], "timestamp", FEATURES, fc.past)
    return fc.predict(rows, ["service"]).drop("member_values")


MEMBERS = """(SELECT service, (['cpu_usage', 'memory_usage', 'error_rate', 'latency_p99', 'queue_depth'])[1 + user_id % 5] AS feature, CAST(1 + EXTRACT(hour FROM ts) % 15 AS INT) AS step, event_id % 20 AS member,
    CASE user_id % 5 WHEN 3 THEN value * 8 ELSE value / 60 END AS value FROM svc)"""


def member_table(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("cpu_usage", "memory_usage", "error_rate", "latency_p99", "queue_depth")])
    k = F.col("user_id") % 5
    return A.svc(spark, sf).select(
        "service", F.element_at(names, (k + 1).cast("int")).alias("feature"), (F.hour("ts") % 15 + 1).cast("int").alias("step"), (F.col("event_id") % 20).alias("member"),
        F.when(k == 3, F.col("value") * 8).otherwise(F.col("value") / 60).alias("value"))


@query("ml_forecast_interval", f"""SELECT service, feature, step, {r('AVG(value)', 6)} AS mean, {r('STDDEV_POP(value)', 6)} AS std, {r('AVG(value) - 1.96E0 * STDDEV_POP(value)', 6)} AS lower, {r('AVG(value) + 1.96E0 * STDDEV_POP(value)', 6)} AS upper
  FROM {MEMBERS} GROUP BY 1, 2, 3""", ["svc"])
def ml_forecast_interval(spark, sf):
    out = FC.interval(member_table(spark, sf), ["service", "feature", "step"])
    return out.withColumns({c: sfixed(c, 6) for c in ("mean", "std", "lower", "upper")})


LIMITS = "(VALUES " + ", ".join(f"('{k}', {float(v)!r}E0)" if "e" not in repr(float(v)) else f"('{k}', {v})" for k, v in CAPACITY_THRESHOLDS.items()) + ") l(feature, threshold)"


@query("ml_breach_alerts", f"""
  SELECT service, feature AS metric, step, ROUND(mean, 4) AS predicted_value, threshold, ROUND(share, 2) AS confidence FROM (
    SELECT service, m.feature, step, CAST(threshold AS DOUBLE) AS threshold, AVG(value) AS mean, AVG(CASE WHEN value > threshold THEN 1.0E0 ELSE 0.0E0 END) AS share FROM {MEMBERS} m JOIN {LIMITS} ON l.feature = m.feature GROUP BY 1, 2, 3, 4)
  WHERE mean > threshold QUALIFY ROW_NUMBER() OVER (PARTITION BY service, feature ORDER BY step) = 1""", ["svc"])
def ml_breach_alerts(spark, sf):
    return FC.breach_alerts(member_table(spark, sf), ["service"])


# ---- root cause -------------------------------------------------------------
def by_time(spark: SparkSession, sf: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rich features of the windows that end before, and of those that start after, the time at which ``share`` of the windows have started.

    Windows overlap, so those over the border are in neither part."""
    _, windows, rich = inputs(spark, sf)
    times = windows.groupBy("window_id").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    border = F.lit(times.agg(F.percentile_approx("start", share)).first()[0]).cast("timestamp_ntz")
    part = lambda condition: rich.join(times.filter(condition).select("window_id"), "window_id", "left_semi")
    return part(F.col("end") < border), part(F.col("start") >= border)


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    rich = inputs(spark, sf)[2]
    return RC.predict(cause(spark, sf), rich, OW.rich_columns(), ["window_id", "label"])


@query("ml_root_cause_fit")
def ml_root_cause_fit(spark, sf):
    """Class report on the anomalous windows of the last fifth of the time, by a model fitted on the windows before."""
    before, after = by_time(spark, sf)
    held_out = after.filter(F.col("label") != "normal")
    return V.class_report(RC.predict(P.fit_cause(before), held_out, OW.rich_columns(), ["window_id", "label"]), "label", "predicted_cause")


@query("ml_root_cause_topk")
def ml_root_cause_topk(spark, sf):
    return predicted(spark, sf).select("window_id", "predicted_cause", "cause_confidence", F.posexplode("top_causes").alias("rank", "t")).select(
        "window_id", "predicted_cause", "cause_confidence", "rank", "t.cause", "t.probability")


@query("ml_feature_importance")
def ml_feature_importance(spark, sf):
    return RC.contributing(cause(spark, sf), inputs(spark, sf)[2], OW.rich_columns(), ["window_id"])


@query("join_knn_minority", f"""
  SELECT id, y, rank, neighbour, {r('d', 5)} AS distance FROM (SELECT a.vec_id AS id, a.label AS y, b.vec_id AS neighbour, LIST_DISTANCE(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
    CAST(ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY LIST_DISTANCE(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) - 1 AS INT) AS rank
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rank < 5""")
def join_knn_minority(spark, sf):
    rows = A.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("y"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    near = nearest_same_class(rows, "vec_id", 5)
    return near.select(F.col("vec_id").cast("bigint").alias("id"), "y", F.posexplode("neighbours").alias("rank", "t")).select(
        "id", "y", "rank", F.col("t.id").cast("bigint").alias("neighbour"), sfixed("t.d", 5).alias("distance"))


@query("win_smote", "SELECT DISTINCT label AS y, (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM embeddings GROUP BY label)) AS n FROM embeddings")
def win_smote(spark, sf):
    """Class sizes after oversampling: all equal to the largest."""
    rows = A.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("y"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return RC.smote(rows, "vec_id").groupBy(F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("ml_cross_validate")
def ml_cross_validate(spark, sf):
    rich = inputs(spark, sf)[2].filter(F.col("label") != "normal")
    usable = rich.groupBy("label").count().filter("count >= 2").select("label")
    return RC.cross_validate(rich.join(usable, "label", "left_semi"), OW.rich_columns())


# ---- logs -------------------------------------------------------------------
MASK_SQL = "message"
for _p, _m in L.MASKS:
    MASK_SQL = f"REGEXP_REPLACE({MASK_SQL}, '{_p.replace(chr(39), chr(39) * 2)}', '{_m}', 'g')"
add_view("template_v", f"SELECT *, {MASK_SQL} AS template FROM logs_v", "logs_v")
# every template of the log lines has enough lines to be a cluster of its own, and none is inside another one's
add_view("clustered_v", "SELECT *, CAST('0x' || SUBSTR(MD5(template), 1, 15) AS BIGINT) AS cluster_id FROM template_v", "template_v")


@query("ml_log_template", f"""SELECT template, COUNT(*) AS n FROM (SELECT template FROM template_v UNION ALL SELECT {MASK_SQL} AS template FROM (SELECT text AS message FROM conversations)) GROUP BY 1""", ["template_v"])
def ml_log_template(spark, sf):
    both = A.logs(spark, sf).select("message").unionByName(A.table(spark, sf, "conversations").select(F.col("text").alias("message")))
    return L.templates(both)


def app_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines plus the conversation turns as free-text lines."""
    conv = A.table(spark, sf, "conversations").select(
        (-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("timestamp"), F.col("role").alias("service"),
        F.col("text").alias("message"), F.lit("INFO").alias("severity"))
    return A.logs(spark, sf).select("id", "timestamp", "service", "message", "severity").unionByName(conv)


@query("ml_log_embed")
def ml_log_embed(spark, sf):
    vectors, _ = L.embed(app_logs(spark, sf))
    return vectors.select("template", "n", F.size(F.filter(vector_to_array("vector"), lambda v: v != 0)).alias("non_zero"))


@query("ml_log_reduce")
def ml_log_reduce(spark, sf):
    vectors, _ = L.embed(app_logs(spark, sf))
    return L.reduce(vectors).select("template", "n", vector_to_array("reduced").alias("reduced"))


@query("ml_log_cluster")
def ml_log_cluster(spark, sf):
    return L.cluster(app_logs(spark, sf))


@lru_cache(maxsize=8)
def _clusters(app: str, sf: str) -> DataFrame:
    return settled(L.cluster(A.logs(SparkSession.getActiveSession(), sf)))


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines with their cluster."""
    return L.with_cluster(A.logs(spark, sf), _clusters(spark.sparkContext.applicationId, sf))


TOKENS = """(SELECT cluster_id, token, c, size, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY c DESC, token) AS rn FROM (SELECT cluster_id, token, COUNT(*) AS c FROM (SELECT cluster_id, UNNEST(STRING_SPLIT(message, ' ')) AS token FROM clustered_v) GROUP BY 1, 2)
  JOIN (SELECT cluster_id, COUNT(*) AS size FROM clustered_v GROUP BY 1) USING (cluster_id))"""
KEYWORDS = f"(SELECT cluster_id, LIST(token ORDER BY rn)[1:8] AS kw FROM {TOKENS} WHERE rn <= 10 AND c > size * 0.3E0 GROUP BY 1)"


@query("ml_cluster_patterns", f"""
  SELECT cluster_id, size, representative, COALESCE(ARRAY_TO_STRING(kw, ' '), '') AS keywords, sev AS severities, svcs AS services, ex AS examples FROM (
    SELECT cluster_id, COUNT(*) AS size, ARG_MIN(message, (timestamp, id)) AS representative FROM clustered_v GROUP BY 1) LEFT JOIN {KEYWORDS} USING (cluster_id)
  JOIN (SELECT cluster_id, STRING_AGG(severity || '=' || n, ',' ORDER BY severity) AS sev FROM (SELECT cluster_id, severity, COUNT(*) AS n FROM clustered_v GROUP BY 1, 2) GROUP BY 1) USING (cluster_id)
  JOIN (SELECT cluster_id, STRING_AGG(service || '=' || n, ',' ORDER BY service) AS svcs FROM (SELECT cluster_id, service, COUNT(*) AS n FROM clustered_v GROUP BY 1, 2) GROUP BY 1) USING (cluster_id)
  JOIN (SELECT cluster_id, STRING_AGG(message, '|' ORDER BY timestamp, id) AS ex FROM (SELECT * FROM clustered_v QUALIFY ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY timestamp, id) <= 3) GROUP BY 1) USING (cluster_id)""", ["clustered_v"])
def ml_cluster_patterns(spark, sf):
    p = L.patterns(clustered(spark, sf))
    show = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return p.select("cluster_id", "size", "representative", F.array_join("pattern_keywords", " ").alias("keywords"), show("severity_distribution").alias("severities"),
                    show("service_distribution").alias("services"), F.array_join("examples", "|").alias("examples"))


LABELS = f"""(SELECT cluster_id, sev || ': ' || COALESCE(ARRAY_TO_STRING(kw[1:3], ' '), '') AS label FROM (SELECT cluster_id, severity AS sev FROM (SELECT cluster_id, severity, COUNT(*) AS n FROM clustered_v GROUP BY 1, 2)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY n DESC, severity) = 1) LEFT JOIN {KEYWORDS} USING (cluster_id))"""


@query("ml_cluster_labels", f"SELECT * FROM {LABELS}", ["clustered_v"])
def ml_cluster_labels(spark, sf):
    return L.patterns(clustered(spark, sf)).select("cluster_id", L.pattern_label().alias("label"))


@query("ml_pattern_summary", f"""SELECT cluster_id, label, size, SUBSTRING(representative, 1, 100) AS representative, COUNT(*) OVER () AS total_patterns FROM {LABELS} JOIN
  (SELECT cluster_id, COUNT(*) AS size, ARG_MIN(message, (timestamp, id)) AS representative FROM clustered_v GROUP BY 1) USING (cluster_id)""", ["clustered_v"])
def ml_pattern_summary(spark, sf):
    return L.pattern_summary(L.patterns(clustered(spark, sf))).select("cluster_id", "label", "size", "representative", "total_patterns")


@query("ml_cluster_assign")
def ml_cluster_assign(spark, sf):
    """Clusters from the lines of the first four fifths of the time; every line is assigned."""
    logs = app_logs(spark, sf)
    border = F.lit(A.logs(spark, sf).agg(F.percentile_approx("timestamp", 0.8)).first()[0]).cast("timestamp_ntz")
    clusters = settled(L.cluster(logs.filter(F.col("timestamp") < border)))
    labels = L.pattern_summary(L.patterns(L.with_cluster(logs, clusters))).select("cluster_id", "label")
    return L.assign(logs, clusters, labels).select("id", "message", "cluster_id", "cluster_label", "is_new_pattern", "confidence")


STEP_SQL = "CASE event_type WHEN 'purchase' THEN 'slow_query' WHEN 'view' THEN 'pool_exhaustion' WHEN 'error' THEN 'db_pool_exhausted' WHEN 'click' THEN 'tx_rollback' END"


@query("ml_incident_sequences", f"""
  SELECT service, 'db_overload_sequence' AS incident, ts AS start, "end" FROM (SELECT service, ts, LEAD(ts, 4) OVER w AS "end", step AS a, LEAD(step, 1) OVER w AS b, LEAD(step, 2) OVER w AS c, LEAD(step, 3) OVER w AS d, LEAD(step, 4) OVER w AS e
    FROM (SELECT service, ts, event_id, {STEP_SQL} AS step FROM svc) WHERE step IS NOT NULL WINDOW w AS (PARTITION BY service ORDER BY ts, event_id))
  WHERE a = 'slow_query' AND b = 'pool_exhaustion' AND c = 'slow_query' AND d = 'db_pool_exhausted' AND e = 'tx_rollback' AND "end" - ts <= INTERVAL 24 HOUR""", ["svc"])
def ml_incident_sequences(spark, sf):
    steps, t, v = dict(L.STEPS), F.col("event_type"), F.floor("value").cast("int").cast("string")
    said = lambda step: F.concat(F.lit(f"{steps[step]} (event value "), v, F.lit(")"))  # noqa: E731  the beginning tells the step
    message = (F.when(t == "purchase", said("slow_query")).when(t == "view", said("pool_exhaustion")).when(t == "error", said("db_pool_exhausted"))
               .when(t == "click", said("tx_rollback")).otherwise(F.lit("nothing to report")))
    logs = A.svc(spark, sf).select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), "service", message.alias("message"))
    return L.incident_sequences(logs)


# ---- pipeline ---------------------------------------------------------------
def report_rows(df: DataFrame) -> DataFrame:
    return df.select("window_id", "service", "health_status", "confidence", "summary", "anomaly_score", "is_anomaly", "predicted_cause",
                     F.size("anomalies").alias("n_anomalies"), F.size("recommendations").alias("n_recommendations"), F.size("root_causes").alias("n_root_causes"),
                     "total_patterns", "log_lines", "new_patterns_detected", "log_patterns")


@query("ml_full_analysis")
def ml_full_analysis(spark, sf):
    clusters = _clusters(spark.sparkContext.applicationId, sf)
    return report_rows(P.full_analysis(models(spark, sf), inputs(spark, sf)[1], A.logs(spark, sf), clusters))


@query("ml_model_io")
def ml_model_io(spark, sf):
    """Scores before and after a save and load; the difference is zero."""
    m, windows = models(spark, sf), inputs(spark, sf)[1]
    path = run_dir(spark, "models")
    m.save(spark, path)
    before, after = P.score_windows(m, windows), P.score_windows(P.Models.load(spark, path), windows)
    pair = before.select("window_id", F.col("anomaly_score").alias("before")).join(after.select("window_id", F.col("anomaly_score").alias("after")), "window_id")
    return pair.withColumn("difference", F.abs(F.col("before") - F.col("after")))


@query("ml_retrain")
def ml_retrain(spark, sf):
    wide, windows, rich = inputs(spark, sf)
    forest, rec, cause = P.retrain(wide, rich, rich)
    return forest.transform(rich).select("window_id", "if_score", "is_outlier", F.lit(cause is not None).alias("cause_retrained"), F.lit(rec.threshold).cast("double").alias("threshold"))


CONTEXT_ID = "CAST('0x' || SUBSTR(MD5(template), 1, 15) AS BIGINT)"


@query("rpt_ml_context", f"""
  WITH lines AS (SELECT t.*, timestamp > as_of - INTERVAL 24 HOUR AS late FROM template_v t, now_v), known AS (SELECT template FROM lines WHERE NOT late GROUP BY 1 HAVING COUNT(*) >= 5),
    ends AS (SELECT service, {r('ARG_MAX(duration_ms, (timestamp, id))', 4)} AS end_value FROM traces_v GROUP BY 1)
  SELECT service, CAST(COUNT(DISTINCT template) FILTER (NOT late AND template IN (SELECT template FROM known)) AS INT) AS total_patterns,
    CAST(COUNT(DISTINCT template) FILTER (NOT late AND severity = 'ERROR' AND template IN (SELECT template FROM known)) AS INT) AS error_patterns,
    COALESCE(STRING_AGG(DISTINCT CAST({CONTEXT_ID} AS VARCHAR), ',' ORDER BY CAST({CONTEXT_ID} AS VARCHAR)) FILTER (NOT late AND severity = 'ERROR' AND template IN (SELECT template FROM known)), '') AS error_ids,
    CAST(COUNT(*) FILTER (late AND template NOT IN (SELECT template FROM known)) AS INT) AS new_patterns_detected, ANY_VALUE(end_value) AS end_value
  FROM lines JOIN ends USING (service) GROUP BY 1""", ["template_v", "traces_v", "now_v"])
def rpt_ml_context(spark, sf):
    """Clusters of the lines before the last day, the lines of the last day as predictions, the last duration as end value."""
    logs, border = A.logs(spark, sf), A.as_of(spark, sf) - timedelta(hours=24)
    late = F.col("timestamp") > F.lit(border).cast("timestamp_ntz")
    clusters = settled(L.cluster(logs.filter(~late)))
    patterns = L.with_cluster(logs.filter(~late), clusters).filter("cluster_id <> -1").select("service", "cluster_id", "severity")
    predictions = L.assign(logs.filter(late), clusters).select("service", "is_new_pattern")
    forecasts = A.traces(spark, sf).select("service", F.lit("duration_ms").alias("metric"), F.struct("timestamp", "id").alias("step"), F.col("duration_ms").alias("value"))
    out = service_context(forecasts, predictions, patterns)
    ids = F.array_sort(F.transform("error_patterns", lambda c: c.cast("string")))
    return out.select("service", F.col("total_patterns").cast("int").alias("total_patterns"), F.col("n_error_patterns").cast("int").alias("error_patterns"), F.array_join(ids, ",").alias("error_ids"),
                      F.col("new_patterns_detected").cast("int").alias("new_patterns_detected"), sfixed(F.col("predicted_end_values")["duration_ms"], 4).alias("end_value"))
