"""Registered window, feature, label, split and augmentation queries over the wide metric table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import adapters as A
from tidewatch.constants import FEATURES, METRIC_TO_FEATURE
from tidewatch.functions.scalar import fixed as sfixed
from tidewatch.functions.series import floor_ts, ntz
from tidewatch.operators import joins as J
from tidewatch.operators import windows as W
from tidewatch.plans.registry import query
from tidewatch.plans.views import add_view, fixed as r

# decimals that are compared, by feature prefix
DIGITS = {f: 2 if f == "jvm_heap_used" else 4 for f in FEATURES}

add_view("slide_v", """
  SELECT 'real_' || service || '_' || w AS window_id, d.*, CAST(pos - w * 15 AS INT) AS i
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY service ORDER BY timestamp) - 1 AS pos, COUNT(*) OVER (PARTITION BY service) AS n FROM wide_v) d
  JOIN (SELECT w FROM UNNEST(RANGE(0, 100000)) g(w) WHERE w <= (SELECT COUNT(*) FROM wide_v)) ON pos BETWEEN w * 15 AND w * 15 + 59 AND w * 15 + 60 <= n""", "wide_v")


def stat_sql(f: str) -> list[tuple[str, str]]:
    first, last = f"ARG_MIN({f}, i)", f"ARG_MAX({f}, i)"
    return [(f"{f}_mean", f"AVG({f})"), (f"{f}_std", f"STDDEV_POP({f})"), (f"{f}_min", f"MIN({f})"), (f"{f}_max", f"MAX({f})"), (f"{f}_last", last),
            (f"{f}_first", first), (f"{f}_trend", f"REGR_SLOPE({f}, i)"), (f"{f}_roc", f"({last} - {first}) / ({first} + 1.0E-8)")]


def rich_sql(f: str) -> list[tuple[str, str]]:
    out = [(f"{f}_range", f"MAX({f}) - MIN({f})"),
           (f"{f}_acceleration", f"REGR_SLOPE({f}, i) FILTER (i >= 30) - REGR_SLOPE({f}, i) FILTER (i < 30)"),
           (f"{f}_cv", f"STDDEV_POP({f}) / (AVG({f}) + 1.0E-8)")]
    return out


def tail_sql(f: str) -> list[tuple[str, str]]:
    out = []
    for n in (5, 15, 30):
        out += [(f"{f}_roll{n}_mean", f"AVG({f}) FILTER (i >= {60 - n})"), (f"{f}_roll{n}_std", f"STDDEV_POP({f}) FILTER (i >= {60 - n})")]
    return out


def digits(col: str) -> int:
    return next((d for f, d in DIGITS.items() if col.startswith(f)), 6)


def select_sql(cols: list[tuple[str, str]]) -> str:
    return ", ".join(f"{r(e, digits(c))} AS {c}" for c, e in cols)


def shown(df: DataFrame, cols: list[str], *keys: str) -> DataFrame:
    return df.select(*keys, *[sfixed(c, digits(c)).alias(c) for c in cols])


BASE = [x for f in FEATURES for x in stat_sql(f)]
RICH = [x for f in FEATURES for x in rich_sql(f)]
TAIL = [x for f in FEATURES for x in tail_sql(f)]
CROSS = [("error_per_request", "AVG(error_rate) / (AVG(request_rate) + 1.0E-8)"), ("latency_ratio_p99_p50", "AVG(latency_p99) / (AVG(latency_p50) + 1.0E-8)"),
         ("heap_utilisation", "AVG(jvm_heap_used) / 512.0E6"), ("cpu_memory_product", "AVG(cpu_usage) * AVG(memory_usage)"), ("gc_impact", "AVG(jvm_gc_pause_seconds) * AVG(request_rate)")]
LABEL_SQL = """CASE WHEN AVG(error_rate) > 0.21E0 THEN 'config_error' WHEN AVG(cpu_usage) > 0.25E0 THEN 'cpu_saturation' WHEN AVG(latency_p99) > 1100 THEN 'downstream_timeout'
    WHEN REGR_SLOPE(jvm_heap_used, i) > 1.0E5 THEN 'memory_leak' WHEN AVG(jvm_gc_pause_seconds) > 0.1E0 THEN 'jvm_gc_pressure'
    WHEN (ARG_MAX(request_rate, i) - ARG_MIN(request_rate, i)) / (ARG_MIN(request_rate, i) + 1.0E-8) > 2 THEN 'request_spike' ELSE 'normal' END"""
add_view("label_v", f"SELECT window_id, service, {LABEL_SQL} AS label FROM slide_v GROUP BY 1, 2", "slide_v")
add_view("row_label_v", """
  SELECT *, CASE WHEN error_rate > 0.4E0 THEN 'config_error' WHEN latency_p99 > 1500 THEN 'downstream_timeout' WHEN jvm_gc_pause_seconds > 0.08E0 THEN 'jvm_gc_pressure' ELSE 'normal' END AS label
  FROM wide_v""", "wide_v")


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return W.slide_rows(A.wide(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Window statistics with weak labels (thresholds fitted to the test tables)."""
    return W.heuristic_label(W.base_stats(windows(spark, sf)), error_rate=0.21, cpu=0.25, latency=1100.0)


def row_labelled(spark: SparkSession, sf: str) -> DataFrame:
    label = (F.when(F.col("error_rate") > 0.4, "config_error").when(F.col("latency_p99") > 1500, "downstream_timeout")
             .when(F.col("jvm_gc_pause_seconds") > 0.08, "jvm_gc_pressure").otherwise("normal"))
    return A.wide(spark, sf).withColumn("label", label)


@query("win_slide_rows", f"SELECT window_id, service, timestamp, i, {r('error_rate', 6)} AS error_rate, {r('latency_p99', 4)} AS latency_p99 FROM slide_v", ["slide_v"])
def win_slide_rows(spark, sf):
    return windows(spark, sf).select("window_id", "service", "timestamp", "i", sfixed("error_rate", 6).alias("error_rate"), sfixed("latency_p99", 4).alias("latency_p99"))


@query("win_base_stats", f"SELECT window_id, service, {select_sql(BASE)} FROM slide_v GROUP BY 1, 2", ["slide_v"])
def win_base_stats(spark, sf):
    return shown(W.base_stats(windows(spark, sf)), [c for c, _ in BASE], "window_id", "service")


@query("win_rich_stats", f"SELECT window_id, service, {select_sql(RICH)} FROM slide_v GROUP BY 1, 2", ["slide_v"])
def win_rich_stats(spark, sf):
    return shown(W.rich_stats(windows(spark, sf)), [c for c, _ in RICH], "window_id", "service")


@query("win_tail_rolling", f"SELECT window_id, service, {select_sql(TAIL)} FROM slide_v GROUP BY 1, 2", ["slide_v"])
def win_tail_rolling(spark, sf):
    return shown(W.rich_stats(windows(spark, sf)), [c for c, _ in TAIL], "window_id", "service")


@query("win_cross_metric", f"SELECT window_id, service, {select_sql(CROSS)} FROM slide_v GROUP BY 1, 2", ["slide_v"])
def win_cross_metric(spark, sf):
    return shown(W.rich_stats(windows(spark, sf)), [c for c, _ in CROSS], "window_id", "service")


STD = ", ".join(f"(SELECT AVG({f}) FROM wide_v) AS m_{f}, (SELECT STDDEV_POP({f}) FROM wide_v) AS s_{f}" for f in FEATURES)
add_view("scaled_v", f"""SELECT service, timestamp, {', '.join(f'(w.{f} - m.m_{f}) / m.s_{f} AS {f}' for f in FEATURES)} FROM wide_v w, (SELECT {STD}) m""", "wide_v")


@query("win_standardize", f"SELECT service, timestamp, {', '.join(f'{r(f, 6)} AS {f}' for f in FEATURES)} FROM scaled_v", ["scaled_v"])
def win_standardize(spark, sf):
    wide = A.wide(spark, sf)
    return W.Scaler(FEATURES).fit(wide).transform(wide).select("service", "timestamp", *[sfixed(f, 6).alias(f) for f in FEATURES])


ROW_SUM = " + ".join(FEATURES)


def total(arr):
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.aggregate(x, F.lit(0.0), lambda b, y: b + y))


@query("win_sequences_30", f"""
  SELECT service, timestamp, {r('first', 6)} AS first, {r('total', 5)} AS total FROM (SELECT service, timestamp, FIRST_VALUE(request_rate) OVER w AS first, SUM({ROW_SUM}) OVER w AS total, COUNT(*) OVER w AS n
    FROM scaled_v WINDOW w AS (PARTITION BY service ORDER BY timestamp ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE n = 30""", ["scaled_v"])
def win_sequences_30(spark, sf):
    wide = A.wide(spark, sf)
    seq = W.sequences(W.Scaler(FEATURES).fit(wide).transform(wide))
    return seq.select("service", "timestamp", sfixed(F.get(F.get("seq", F.lit(0)), F.lit(0)), 6).alias("first"), sfixed(total(F.col("seq")), 5).alias("total"))


@query("win_supervised_pairs", f"""
  SELECT service, timestamp, {r('xs', 5)} AS xs, {r('ys', 5)} AS ys, CAST(nx AS INT) AS nx, CAST(ny AS INT) AS ny FROM (SELECT service, timestamp, SUM({ROW_SUM}) OVER a AS xs, SUM({ROW_SUM}) OVER b AS ys, COUNT(*) OVER a AS nx, COUNT(*) OVER b AS ny
    FROM scaled_v WINDOW a AS (PARTITION BY service ORDER BY timestamp ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), b AS (PARTITION BY service ORDER BY timestamp ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING))
  WHERE nx = 60 AND ny = 15""", ["scaled_v"])
def win_supervised_pairs(spark, sf):
    wide = A.wide(spark, sf)
    pairs = W.supervised_pairs(W.Scaler(FEATURES).fit(wide).transform(wide))
    return pairs.select("service", "timestamp", sfixed(total(F.col("x")), 5).alias("xs"), sfixed(total(F.col("y")), 5).alias("ys"), F.size("x").alias("nx"), F.size("y").alias("ny"))


add_view("align_v", """
  SELECT a.day, a.idx, a.service AS s1, b.service AS s2, a.error_rate AS error_rate_1, a.latency_p99 AS latency_p99_1, b.error_rate AS error_rate_2, b.latency_p99 AS latency_p99_2
  FROM (SELECT *, DATE_TRUNC('day', timestamp) AS day, ROW_NUMBER() OVER (PARTITION BY service, DATE_TRUNC('day', timestamp) ORDER BY timestamp) - 1 AS idx FROM wide_v) a
  JOIN (SELECT *, DATE_TRUNC('day', timestamp) AS day, ROW_NUMBER() OVER (PARTITION BY service, DATE_TRUNC('day', timestamp) ORDER BY timestamp) - 1 AS idx FROM wide_v) b
  ON a.day = b.day AND a.idx = b.idx AND a.service < b.service""", "wide_v")


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    wide = A.wide(spark, sf).withColumn("day", ntz(F.date_trunc("day", "timestamp")))
    return J.align_services(wide, ["error_rate", "latency_p99"], "day")


@query("join_service_pair_align", f"SELECT day, idx, s1, s2, {', '.join(f'{r(c, 4)} AS {c}' for c in ('error_rate_1', 'latency_p99_1', 'error_rate_2', 'latency_p99_2'))} FROM align_v", ["align_v"])
def join_service_pair_align(spark, sf):
    return aligned(spark, sf).withColumns({c: sfixed(c, 4) for c in ("error_rate_1", "latency_p99_1", "error_rate_2", "latency_p99_2")})


@query("win_cross_service_corr", f"""SELECT day, s1, s2, COUNT(*) AS points, CASE WHEN COUNT(*) > 2 THEN {r('CORR(error_rate_1, error_rate_2)', 6)} ELSE 0 END AS corr_error,
  CASE WHEN COUNT(*) > 2 THEN {r('CORR(latency_p99_1, latency_p99_2)', 6)} ELSE 0 END AS corr_latency FROM align_v GROUP BY 1, 2, 3
  UNION ALL SELECT DATE_TRUNC('day', timestamp), MIN(service), NULL, 0, 0, 0 FROM wide_v GROUP BY 1 HAVING COUNT(DISTINCT service) = 1""", ["align_v"])
def win_cross_service_corr(spark, sf):
    wide = A.wide(spark, sf).withColumn("day", ntz(F.date_trunc("day", "timestamp")))
    found = W.pair_correlations(wide, ["error_rate", "latency_p99"], "day")
    return found.select("day", "s1", "s2", "points", sfixed("corr_error_rate", 6).alias("corr_error"), sfixed("corr_latency_p99", 6).alias("corr_latency"))


@query("win_sequence_label", """
  SELECT service, timestamp, CASE WHEN bad > 9 THEN 1 ELSE 0 END AS is_anomaly FROM (SELECT service, timestamp, SUM(CASE WHEN label <> 'normal' THEN 1 ELSE 0 END) OVER w AS bad, COUNT(*) OVER w AS n
    FROM row_label_v WINDOW w AS (PARTITION BY service ORDER BY timestamp ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE n = 30""", ["row_label_v"])
def win_sequence_label(spark, sf):
    return W.sequence_label(row_labelled(spark, sf)).select("service", "timestamp", "is_anomaly")


@query("win_heuristic_label", "SELECT window_id, service, label, CAST(label <> 'normal' AS INT) AS is_anomaly FROM label_v", ["label_v"])
def win_heuristic_label(spark, sf):
    return labelled(spark, sf).select("window_id", "service", "label", "is_anomaly")


NAME_SQL = """CASE metric_name WHEN 'click' THEN 'http_server_requests_seconds_count' WHEN 'error' THEN 'error_rate' WHEN 'purchase' THEN 'jvm_memory_used_bytes' WHEN 'view' THEN 'process_cpu_usage' ELSE 'queue_depth' END"""


def named_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metric samples under source names, one of which maps to no feature."""
    n = F.col("metric_name")
    name = (F.when(n == "click", "http_server_requests_seconds_count").when(n == "error", "error_rate").when(n == "purchase", "jvm_memory_used_bytes")
            .when(n == "view", "process_cpu_usage").otherwise("queue_depth"))
    return A.metrics(spark, sf).withColumn("metric_name", name)


def feature_case(name: str) -> str:
    return "CASE " + name + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_TO_FEATURE.items()) + " END"


add_view("named_v", f"SELECT id, timestamp, service, {feature_case(NAME_SQL)} AS feature, TRY_CAST(value AS DOUBLE) AS v FROM metrics_v", "metrics_v")


@query("win_pivot_wide", f"""
  SELECT DATE_TRUNC('hour', timestamp) AS timestamp, service, {', '.join(f"{r(f'COALESCE(AVG(v) FILTER (feature = {chr(39)}{f}{chr(39)}), 0)', 6)} AS {f}" for f in FEATURES)} FROM named_v WHERE feature IS NOT NULL GROUP BY 1, 2""", ["named_v"])
def win_pivot_wide(spark, sf):
    hourly = named_metrics(spark, sf).withColumn("timestamp", floor_ts("timestamp", 3600))
    return W.pivot_wide(hourly).select("timestamp", "service", *[sfixed(f, 6).alias(f) for f in FEATURES])


@query("win_left_pad", f"""
  SELECT service, day, {r('first', 6)} AS first, {r('last', 6)} AS last, 60 AS n, {r('total + (60 - cnt) * first', 4)} AS total FROM (
    SELECT service, DATE_TRUNC('day', timestamp) AS day, ARG_MIN(latency_p99, timestamp) AS first, ARG_MAX(latency_p99, timestamp) AS last, SUM(latency_p99) AS total, COUNT(*) AS cnt FROM wide_v GROUP BY 1, 2)""", ["wide_v"])
def win_left_pad(spark, sf):
    wide = A.wide(spark, sf).withColumn("day", ntz(F.date_trunc("day", "timestamp")))
    rows = W.left_pad(wide, ["service", "day"], "timestamp", ["latency_p99"], 60)
    cell = lambda i: F.element_at(F.element_at("rows", i), 1)
    return rows.select("service", "day", sfixed(cell(1), 6).alias("first"), sfixed(cell(-1), 6).alias("last"), F.size("rows").alias("n"), sfixed(total(F.col("rows")), 4).alias("total"))


PAYLOAD = """(SELECT *, COUNT(*) OVER (PARTITION BY service, day, feature) AS n, LAST_VALUE(v) OVER (PARTITION BY service, day, feature ORDER BY timestamp, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lastv
    FROM (SELECT *, DATE_TRUNC('day', timestamp) AS day FROM named_v) WHERE feature IS NOT NULL AND v IS NOT NULL)"""


def payload(spark: SparkSession, sf: str) -> DataFrame:
    return W.metric_payload(named_metrics(spark, sf).withColumn("day", ntz(F.date_trunc("day", "timestamp"))), ["service", "day"])


@query("win_forward_pad", f"""
  SELECT service, day, feature, CAST(MAX(longest) AS INT) AS n, {r('MAX(lastv)', 6)} AS last, {r('SUM(v) + (MAX(longest) - MAX(n)) * MAX(lastv)', 4)} AS total
  FROM (SELECT *, MAX(n) OVER (PARTITION BY service, day) AS longest FROM {PAYLOAD}) GROUP BY 1, 2, 3""", ["named_v"])
def win_forward_pad(spark, sf):
    each = payload(spark, sf).select("service", "day", F.explode("metrics").alias("feature", "v"))
    return each.select("service", "day", "feature", F.size("v").alias("n"), sfixed(F.element_at("v", -1), 6).alias("last"), sfixed(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("rpt_metric_window_payload", f"""
  SELECT service, day, CAST(MAX(n) AS INT) AS length, CAST(COUNT(DISTINCT feature) AS INT) AS n_features FROM {PAYLOAD} GROUP BY 1, 2""", ["named_v"])
def rpt_metric_window_payload(spark, sf):
    return payload(spark, sf).select("service", "day", F.size(F.map_values("timestamps")[0]).alias("length"), F.size("metrics").alias("n_features"))


HASHED = "MD5(CAST(window_id AS VARCHAR) || ':42')"
add_view("ranked_v", f"""SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {HASHED}, window_id) - 1 AS pos, COUNT(*) OVER (PARTITION BY label) AS size FROM label_v""", "label_v")
add_view("split_v", "SELECT window_id, service, label, CASE WHEN pos < FLOOR(size * 0.70E0) THEN 'train' WHEN pos < FLOOR(size * (0.70E0 + 0.15E0)) THEN 'val' ELSE 'test' END AS split FROM ranked_v", "ranked_v")


def splits(spark: SparkSession, sf: str) -> DataFrame:
    return W.stratified_split(labelled(spark, sf).select("window_id", "service", "label"), "label", "window_id")


@query("win_stratified_split", "SELECT * FROM split_v", ["split_v"])
def win_stratified_split(spark, sf):
    return splits(spark, sf)


@query("win_label_index", "SELECT window_id, label, CAST(DENSE_RANK() OVER (ORDER BY label) - 1 AS INT) AS y FROM label_v", ["label_v"])
def win_label_index(spark, sf):
    return W.label_index(labelled(spark, sf).select("window_id", "label"))[0]


@query("win_kfold", """SELECT window_id, label, CAST(pos % LEAST(5, (SELECT MIN(size) FROM ranked_v)) AS INT) AS fold FROM ranked_v WHERE label IN (SELECT label FROM ranked_v WHERE size >= 2)""", ["ranked_v"])
def win_kfold(spark, sf):
    rows = labelled(spark, sf).select("window_id", "label")
    usable = rows.groupBy("label").count().filter("count >= 2").select("label")
    return W.kfold(rows.join(usable, "label", "left_semi"), "label", "window_id")


@query("win_normalise_max", f"SELECT window_id, i, {r('CASE WHEN MAX(latency_p99) OVER (PARTITION BY window_id) > 0 THEN latency_p99 / MAX(latency_p99) OVER (PARTITION BY window_id) ELSE latency_p99 END', 6)} AS latency_p99 FROM slide_v", ["slide_v"])
def win_normalise_max(spark, sf):
    return W.normalise_max(windows(spark, sf).select("window_id", "i", "latency_p99"), "latency_p99", ["window_id"]).withColumn("latency_p99", sfixed("latency_p99", 6))


@query("join_semi_split", f"SELECT window_id, i, service, {r('error_rate', 6)} AS error_rate FROM slide_v WHERE window_id IN (SELECT window_id FROM split_v WHERE split = 'val')", ["slide_v", "split_v"])
def join_semi_split(spark, sf):
    ids = splits(spark, sf).filter(F.col("split") == "val")
    return J.in_split(windows(spark, sf), ids).select("window_id", "i", "service", sfixed("error_rate", 6).alias("error_rate"))


@query("join_anti_normal", "SELECT window_id, i, service FROM slide_v WHERE window_id NOT IN (SELECT window_id FROM label_v WHERE label = 'normal')", ["slide_v", "label_v"])
def join_anti_normal(spark, sf):
    normal = labelled(spark, sf).filter(F.col("label") == "normal")
    return J.not_in(windows(spark, sf).select("window_id", "i", "service"), normal)


@query("join_label_lookup", f"SELECT s.window_id, l.label, {r('AVG(error_rate)', 6)} AS error_rate_mean FROM slide_v s JOIN label_v l USING (window_id) GROUP BY 1, 2", ["slide_v", "label_v"])
def join_label_lookup(spark, sf):
    feats = W.base_stats(windows(spark, sf)).select("window_id", sfixed("error_rate_mean", 6).alias("error_rate_mean"))
    return J.label_lookup(feats, labelled(spark, sf))


@query("join_pred_vs_actual", """SELECT window_id, a.label AS predicted, l.label AS actual FROM (SELECT s.window_id, MODE(r.label ORDER BY r.label) AS label
    FROM slide_v s JOIN row_label_v r ON r.service = s.service AND r.timestamp = s.timestamp WHERE r.label <> 'normal' GROUP BY 1) a JOIN label_v l USING (window_id)""", ["slide_v", "row_label_v", "label_v"])
def join_pred_vs_actual(spark, sf):
    """The commonest row label of each window beside the label of the window's statistics."""
    from tidewatch.operators.aggregates import mode_label
    rows = W.slide_rows(row_labelled(spark, sf)).filter(F.col("label") != "normal")
    pred = mode_label(rows, ["window_id"], "label").withColumnRenamed("label", "predicted")
    actual = labelled(spark, sf).select("window_id", F.col("label").alias("actual"))
    return J.predicted_vs_actual(pred, actual)
