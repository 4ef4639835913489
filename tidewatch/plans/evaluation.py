"""Registered evaluation and statistics queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import adapters as A
from tidewatch.constants import FEATURES
from tidewatch.functions.scalar import fixed as sfixed
from tidewatch.functions.series import ntz, with_previous
from tidewatch.operators import evaluation as V
from tidewatch.plans.registry import query
from tidewatch.plans.views import add_view, fixed as r


def rounded(df: DataFrame, n: int = 8) -> DataFrame:
    return df.withColumns({f.name: sfixed(f.name, n) for f in df.schema if f.dataType.simpleString() == "double"})


@query("ev_binary", f"""
  SELECT {r('p', 8)} AS precision, {r('q', 8)} AS recall, {r('CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END', 8)} AS f1_score, tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,
    {r('fp / (fp + tn + 1.0E-8)', 8)} AS false_positive_rate, {r('fn / (fn + tp + 1.0E-8)', 8)} AS miss_rate
  FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM (
    SELECT COUNT(*) FILTER (y = 1 AND y_hat = 1) AS tp, COUNT(*) FILTER (y <> 1 AND y_hat = 1) AS fp, COUNT(*) FILTER (y <> 1 AND y_hat <> 1) AS tn, COUNT(*) FILTER (y = 1 AND y_hat <> 1) AS fn FROM eval_v))""", ["eval_v"])
def ev_binary(spark, sf):
    return rounded(V.binary(A.predictions(spark, sf)))


@query("ev_auc", f"""
  SELECT {r('SUM(CASE WHEN y = 1 THEN rk END) / (MAX(p) * MAX(q)) - (MAX(p) + 1) / 2 / MAX(q)', 8)} AS auc_roc FROM (
    SELECT y, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2 AS rk, SUM(y) OVER () AS p, SUM(1 - y) OVER () AS q FROM eval_v)""", ["eval_v"])
def ev_auc(spark, sf):
    return rounded(V.auc(A.predictions(spark, sf)))


add_view("long_v", "SELECT service, timestamp, feature, y, LAG(y) OVER (PARTITION BY service, feature ORDER BY timestamp) AS y_hat FROM (UNPIVOT (SELECT service, timestamp, "
         + ", ".join(FEATURES) + " FROM wide_v) ON " + ", ".join(FEATURES) + " INTO NAME feature VALUE y)", "wide_v")


def naive_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Last-value forecast of every feature."""
    long = A.wide(spark, sf).unpivot(["service", "timestamp"], FEATURES, "feature", "y")
    return with_previous(long, ["service", "feature"], ["timestamp"], "timestamp", "y", "y_hat").filter(F.col("y_hat").isNotNull())


@query("ml_forecast_naive", f"SELECT service, timestamp, feature, {r('y_hat', 4)} AS y_hat FROM long_v WHERE y_hat IS NOT NULL", ["long_v"])
def ml_forecast_naive(spark, sf):
    return naive_forecasts(spark, sf).select("service", "timestamp", "feature", sfixed("y_hat", 4).alias("y_hat"))


FORECAST = """(SELECT *, LAG(y) OVER w AS py, LAG(y_hat) OVER w AS ph FROM long_v WHERE y_hat IS NOT NULL WINDOW w AS (PARTITION BY service, feature ORDER BY timestamp))"""
ERRORS = """AVG(ABS(y - y_hat)) AS mae, SQRT(AVG((y - y_hat) * (y - y_hat))) AS rmse, COALESCE(AVG(ABS((y - y_hat) / y)) FILTER (ABS(y) > 1.0E-8), 0) * 100 AS mape,
  AVG(CASE WHEN (y > py) = (y_hat > ph) THEN 1.0E0 ELSE 0.0E0 END) FILTER (py IS NOT NULL) AS directional_accuracy"""


@query("ev_forecast", f"""SELECT feature, {r('mae', 4)} AS mae, {r('rmse', 2)} AS rmse, {r('mape', 4)} AS mape, {r('directional_accuracy', 8)} AS directional_accuracy FROM (
  SELECT feature, {ERRORS} FROM {FORECAST} GROUP BY 1 UNION ALL SELECT 'all', {ERRORS} FROM {FORECAST})""", ["long_v"])
def ev_forecast(spark, sf):
    out = V.forecast_errors(naive_forecasts(spark, sf), ["service"], ["timestamp"], "timestamp")
    return out.select("feature", sfixed("mae", 4).alias("mae"), sfixed("rmse", 2).alias("rmse"), sfixed("mape", 4).alias("mape"), sfixed("directional_accuracy", 8).alias("directional_accuracy"))


CLASSES = """(SELECT class, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS q, tp FROM (
  SELECT class, SUM(t)::BIGINT AS support, SUM(c)::BIGINT AS predicted, SUM(tp)::BIGINT AS tp FROM (
    SELECT CAST(true_label AS VARCHAR) AS class, 1 AS t, 0 AS c, (true_label = cid)::INT AS tp FROM cluster_v UNION ALL SELECT CAST(cid AS VARCHAR), 0, 1, 0 FROM cluster_v) GROUP BY 1))"""
F1 = "CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END"


@query("ev_multiclass", f"""
  SELECT class, {r('p', 8)} AS precision, {r('q', 8)} AS recall, {r(F1, 8)} AS f1_score, support FROM {CLASSES}
  UNION ALL SELECT 'accuracy', {r('SUM(tp) / SUM(support)', 8)}, {r('SUM(tp) / SUM(support)', 8)}, {r('SUM(tp) / SUM(support)', 8)}, SUM(support)::BIGINT FROM {CLASSES}
  UNION ALL SELECT 'macro avg', {r('AVG(p)', 8)}, {r('AVG(q)', 8)}, {r(f'AVG({F1})', 8)}, SUM(support)::BIGINT FROM {CLASSES}
  UNION ALL SELECT 'weighted avg', {r('SUM(p * support) / SUM(support)', 8)}, {r('SUM(q * support) / SUM(support)', 8)}, {r(f'SUM({F1} * support) / SUM(support)', 8)}, SUM(support)::BIGINT FROM {CLASSES}""", ["cluster_v"])
def ev_multiclass(spark, sf):
    return rounded(V.class_report(A.clustered(spark, sf), "true_label", "cid"))


@query("ev_topk_accuracy", f"""SELECT {r('AVG(CASE WHEN rk < 3 THEN 1.0E0 ELSE 0.0E0 END)', 8)} AS top_3_accuracy, {r('AVG(CASE WHEN rk < 5 THEN 1.0E0 ELSE 0.0E0 END)', 8)} AS top_5_accuracy
  FROM (SELECT LEN(LIST_FILTER(embedding[1:10], lambda x: x > embedding[label + 1])) AS rk FROM embeddings)""")
def ev_topk_accuracy(spark, sf):
    e = A.table(spark, sf, "embeddings").select(F.col("label").alias("y"), F.slice("embedding", 1, 10).alias("proba"))
    return rounded(V.topk_accuracy(e))


@query("ev_confusion", """SELECT y AS actual, COUNT(*) FILTER (y_hat = 0) AS "0", COUNT(*) FILTER (y_hat = 1) AS "1" FROM eval_v GROUP BY 1""", ["eval_v"])
def ev_confusion(spark, sf):
    return V.confusion(A.predictions(spark, sf), [0, 1])


@query("ev_silhouette", f"""
  WITH pts AS (SELECT vec_id AS id, CASE WHEN vec_id % 11 = 0 THEN -1 ELSE CAST((label + vec_id % 2) % 8 AS INT) END AS cid, embedding::DOUBLE[] AS v FROM embeddings),
    k AS (SELECT * FROM pts WHERE cid <> -1), n AS (SELECT cid, COUNT(*) AS size FROM k GROUP BY 1),
    d AS (SELECT a.id, a.cid, b.cid AS other, SUM(POW(LIST_DISTANCE(a.v, b.v), 2)) AS s FROM k a, k b GROUP BY 1, 2, 3),
    m AS (SELECT d.id, d.cid, d.other, CASE WHEN d.cid = d.other THEN s / NULLIF(size - 1, 0) ELSE s / size END AS avg FROM d JOIN n ON n.cid = d.other),
    ab AS (SELECT id, MAX(avg) FILTER (cid = other) AS a, MIN(avg) FILTER (cid <> other) AS b FROM m GROUP BY 1)
  SELECT {r('AVG(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / GREATEST(a, b) END)', 6)} AS silhouette_score, (SELECT COUNT(*) FROM n) AS n_clusters FROM ab""")
def ev_silhouette(spark, sf):
    return rounded(V.silhouette(A.clustered(spark, sf)), 6)


@query("ev_ari_nmi_v", f"""
  WITH c AS (SELECT true_label AS t, cid AS c, COUNT(*) AS n FROM cluster_v WHERE cid <> -1 GROUP BY 1, 2), a AS (SELECT t, SUM(n)::BIGINT AS n FROM c GROUP BY 1), b AS (SELECT c, SUM(n)::BIGINT AS n FROM c GROUP BY 1),
    s AS (SELECT (SELECT SUM(n)::BIGINT FROM c) AS tot, (SELECT SUM(n * (n - 1) / 2) FROM c) AS sc, (SELECT SUM(n * (n - 1) / 2) FROM a) AS sa, (SELECT SUM(n * (n - 1) / 2) FROM b) AS sb),
    e AS (SELECT -(SELECT SUM(n / tot * LN(n / tot)) FROM a, s) AS ht, -(SELECT SUM(n / tot * LN(n / tot)) FROM b, s) AS hc,
      (SELECT SUM(c.n / tot * LN(c.n * tot / (CAST(a.n AS DOUBLE) * b.n))) FROM c JOIN a ON a.t = c.t JOIN b ON b.c = c.c, s) AS mi)
  SELECT {r('(sc - sa * sb / (tot * (tot - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (tot * (tot - 1) / 2))', 8)} AS adjusted_rand_index, {r('2 * mi / (ht + hc)', 8)} AS normalised_mutual_info,
    {r('mi / ht', 8)} AS homogeneity, {r('mi / hc', 8)} AS completeness, {r('2 * (mi / ht) * (mi / hc) / (mi / ht + mi / hc)', 8)} AS v_measure FROM s, e""", ["cluster_v"])
def ev_ari_nmi_v(spark, sf):
    return rounded(V.agreement(A.clustered(spark, sf)))


@query("ev_noise_ratio", f"SELECT COUNT(DISTINCT cid) FILTER (cid <> -1) AS n_clusters, COUNT(*) FILTER (cid = -1) AS n_noise_points, {r('AVG(CASE WHEN cid = -1 THEN 1.0E0 ELSE 0.0E0 END)', 8)} AS noise_ratio FROM cluster_v", ["cluster_v"])
def ev_noise_ratio(spark, sf):
    return rounded(V.noise(A.clustered(spark, sf)))


PAIRS = "(SELECT CAST(ROUND(value * 100) AS BIGINT) AS a, (user_id * 17) % 10000 AS b FROM events)"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "events").select(F.round(F.col("value") * 100).cast("bigint").alias("a"), (F.col("user_id") * 17 % 10000).alias("b"))


@query("ev_paired_t", f"SELECT COUNT(*) AS n, {r('AVG(a - b) / (STDDEV_SAMP(a - b) / SQRT(COUNT(*)))', 8)} AS t_statistic, CASE WHEN AVG(a) > AVG(b) THEN 'A > B' ELSE 'B > A' END AS effect_direction FROM {PAIRS}")
def ev_paired_t(spark, sf):
    return rounded(V.paired_t(pairs(spark, sf), p_value=False))


@query("ev_wilcoxon", f"""
  SELECT COUNT(*) AS n, {r('LEAST(SUM(CASE WHEN d > 0 THEN rk ELSE 0 END), SUM(CASE WHEN d < 0 THEN rk ELSE 0 END))', 2)} AS statistic FROM (
    SELECT d, RANK() OVER (ORDER BY ABS(d)) + (COUNT(*) OVER (PARTITION BY ABS(d)) - 1) / 2 AS rk FROM (SELECT a - b AS d FROM {PAIRS}) WHERE d <> 0)""")
def ev_wilcoxon(spark, sf):
    return rounded(V.wilcoxon(pairs(spark, sf), p_value=False), 2)


@query("ev_bootstrap_ci")
def ev_bootstrap_ci(spark, sf):
    return V.bootstrap_ci(A.table(spark, sf, "events"), "value")


@query("ev_cost_rollup", """
  SELECT month, i AS input_tokens, o AS output_tokens, n AS calls, ROUND(api, 2) AS api_cost_usd, ROUND(h, 2) AS gpu_hours, ROUND(h * 0.5E0, 2) AS ml_cost_usd, ROUND(h / (24 * days) * 100, 2) AS gpu_utilisation_pct,
    ROUND(api - h * 0.5E0, 2) AS savings_usd, ROUND((api - h * 0.5E0) / api * 100, 1) AS savings_pct
  FROM (SELECT *, i / 1.0E6 * 3 + o / 1.0E6 * 15 AS api, n * 3.2E0 / 3600 AS h FROM (
    SELECT DATE_TRUNC('month', ts)::TIMESTAMP AS month, SUM(1000 + user_id)::BIGINT AS i, SUM(200 + event_id % 100)::BIGINT AS o, COUNT(*) AS n, COUNT(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1))""")
def ev_cost_rollup(spark, sf):
    calls = A.table(spark, sf, "events").select(ntz(F.date_trunc("month", "ts")).alias("month"), (1000 + F.col("user_id")).alias("input_tokens"), (200 + F.col("event_id") % 100).alias("output_tokens"), F.to_date("ts").alias("day"))
    return V.cost_rollup(calls)
