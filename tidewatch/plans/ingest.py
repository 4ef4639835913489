"""Registered sources, sinks and streaming operators.

Envelopes are built row by row from the test tables (some with many entries, some with missing fields), so the
parsers see data that grows with the tables. Streaming queries run real streams to completion and read back what
they wrote under the shared folder.
"""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch import adapters as A
from tidewatch.functions.scalar import fixed as sfixed, flatten_labels, parse_iso
from tidewatch.operators import reports as OR
from tidewatch.plans import trends as T
from tidewatch.plans import windows as W
from tidewatch.plans.registry import query
from tidewatch.plans.views import fixed as r
from tidewatch.session import run_dir
from tidewatch.sources import envelopes as E
from tidewatch.sources import sinks
from tidewatch.sources.tables import log_pull, training_set
from tidewatch.streaming import dedup as D
from tidewatch.streaming import ingest as I
from tidewatch.streaming import trends as TR
from tidewatch.streaming.windows import tumbling_severity


def iso(ts: Column) -> Column:
    """ISO text, with ``Z`` or an offset in turn."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(base, F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+00:00"))


def copies(n: Column, build) -> Column:
    return F.transform(F.sequence(F.lit(1), n), build)


def metric_envelopes(e: DataFrame) -> DataFrame:
    n = F.when(F.col("event_id") % 40 == 0, 60).otherwise(1)
    results = copies(n, lambda i: F.struct(
        F.create_map(F.lit("service_name"), F.col("service"), F.lit("instance"), i.cast("string")).alias("labels"), F.col("value").cast("string").alias("value")))
    data = F.to_json(F.struct(F.lit("prometheus").alias("source"), F.lit("default").alias("namespace"), F.create_map("event_type", results).alias("metrics")))
    return e.select(iso(F.col("ts")).alias("timestamp"), data.alias("data"))


def log_envelopes(e: DataFrame, bad: bool = False) -> DataFrame:
    k = F.col("event_id")
    n = F.when(k % 50 == 0, 110).otherwise(1)
    ns = lambda i: (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + i * 1_000_000).cast("string")
    message = F.when(k % 100 == 3, F.repeat(F.lit("xyz "), 1200)).otherwise(F.concat(F.lit("event "), "event_type", F.lit(" "), k.cast("string")))
    entries = copies(n, lambda i: F.struct(
        F.col("service"), F.create_map(F.lit("n"), i.cast("string")).alias("labels"), ns(i).alias("timestamp_ns"),
        F.when(k % 7 != 0, "WARN").alias("severity"), message.alias("message")))
    data = F.to_json(F.struct(F.lit("loki").alias("source"), "service", F.lit("default").alias("namespace"), n.alias("count"), entries.alias("entries")))
    if bad:
        data = F.when(k % 37 == 0, F.lit("{bad json")).otherwise(data)
    return e.select(iso(F.col("ts")).alias("timestamp"), data.alias("data"))


def trace_envelopes(e: DataFrame) -> DataFrame:
    k = F.col("event_id")
    n = F.when(k % 50 == 0, 60).otherwise(1)
    traces = copies(n, lambda i: F.struct(
        F.concat(k.cast("string"), F.lit("-"), i.cast("string")).alias("trace_id"), F.col("service"), F.when(k % 5 != 0, F.col("event_type")).alias("operation"),
        F.when(k % 9 != 0, F.col("value")).alias("duration_ms"), (F.col("value") > 50).alias("is_slow"), F.when(k % 4 == 0, F.lit(True)).alias("has_error")))
    data = F.to_json(F.struct(F.lit("tempo").alias("source"), "service", F.lit("default").alias("namespace"), n.alias("count"), traces.alias("traces")))
    return e.select(iso(F.col("ts")).alias("timestamp"), data.alias("data"))


def event_envelopes(k8s: DataFrame) -> DataFrame:
    k = F.col("id")
    n = F.when(k % 100 < 2, 60).otherwise(1)
    events = copies(n, lambda i: F.struct("pod", "reason", "message", F.when(k % 3 != 0, F.col("event_type")).alias("type"), i.cast("int").alias("count")))
    pods = copies(n, lambda i: F.struct(
        F.concat("pod", F.lit("-"), i.cast("string")).alias("name"), F.lit("app").alias("app"), F.when(k % 5 != 0, F.lit("Running")).alias("phase"),
        F.array(F.struct(F.lit("main").alias("name"), F.lit(True).alias("ready"), i.cast("int").alias("restarts"))).alias("containers")))
    cluster = F.to_json(F.struct(F.lit("kubernetes").alias("source"), F.lit("default").alias("namespace"), events.alias("events")))
    status = F.to_json(F.struct(F.lit("k8s_pod_status").alias("source"), F.lit("default").alias("namespace"), pods.alias("pods")))
    return k8s.withColumn("event_id", k).select(
        iso(F.col("timestamp")).alias("timestamp"), F.when(k % 2 == 0, cluster).otherwise(status).alias("data"))


def trend_envelopes(records: DataFrame) -> DataFrame:
    """One envelope per day with its trend map; a day has one entry per query definition."""
    one = F.struct("description", F.col("range_window").alias("range"), "step", "series_count", "analysis")
    days = records.groupBy("timestamp").agg(F.map_from_entries(F.collect_list(F.struct("query_name", one))).alias("trends"))
    data = F.to_json(F.struct(F.lit("tsdb").alias("source"), F.lit("default").alias("namespace"), "trends"))
    return days.withColumn("event_id", F.lit(0)).select(iso(F.col("timestamp")).alias("timestamp"), data.alias("data"))


def bad_ts() -> Column:
    """Ingest time of envelopes whose own time is unusable (fixed, so that results repeat)."""
    return F.lit("2000-01-01 00:00:00").cast("timestamp")


METRIC_SQL = """SELECT ts AS timestamp, 'default' AS namespace, event_type AS metric_name, 'service_name=' || service || ', instance=' || i AS labels, CAST(value AS VARCHAR) AS value
  FROM svc, UNNEST(RANGE(1, 61)) g(i) WHERE i = 1 OR event_id % 40 = 0"""


@query("src_metric_envelope", METRIC_SQL, ["svc"])
def src_metric_envelope(spark, sf):
    rows = E.metric_rows(E.parse(metric_envelopes(A.svc(spark, sf)), "metrics", bad_ts()))
    return rows.select("timestamp", "namespace", "metric_name", flatten_labels(F.col("labels")).alias("labels"), "value")


LOG_SQL = """SELECT ts AS timestamp, ts + i * INTERVAL 1 MILLISECOND AS event_time, 'default' AS namespace, service, CASE WHEN event_id % 7 = 0 THEN 'INFO' ELSE 'WARN' END AS severity,
  CASE WHEN event_id % 100 = 3 THEN REPEAT('xyz ', 1200) ELSE 'event ' || event_type || ' ' || event_id END AS message, 'n=' || i AS labels
  FROM svc, UNNEST(RANGE(1, 111)) g(i) WHERE (i = 1 OR event_id % 50 = 0)"""


def flat_logs(rows: DataFrame) -> DataFrame:
    return rows.select("timestamp", "event_time", "namespace", "service", "severity", "message", flatten_labels(F.col("labels")).alias("labels"))


@query("src_log_envelope", LOG_SQL, ["svc"])
def src_log_envelope(spark, sf):
    return flat_logs(E.log_rows(E.parse(log_envelopes(A.svc(spark, sf)), "logs", bad_ts())))


@query("src_trace_envelope", """SELECT ts AS timestamp, event_id || '-' || i AS trace_id, service, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS operation,
  CASE WHEN event_id % 9 = 0 THEN 0 ELSE value END AS duration_ms, value > 50 AS is_slow, event_id % 4 = 0 AS has_error FROM svc, UNNEST(RANGE(1, 61)) g(i) WHERE i = 1 OR event_id % 50 = 0""", ["svc"])
def src_trace_envelope(spark, sf):
    return E.trace_rows(E.parse(trace_envelopes(A.svc(spark, sf)), "traces", bad_ts()))


K8S_SQL = """SELECT timestamp, 'default' AS namespace, 'kubernetes' AS source, pod, reason, message, CASE WHEN id % 3 = 0 THEN 'Normal' ELSE event_type END AS event_type, i AS n
  FROM k8s_v, UNNEST(RANGE(1, 61)) g(i) WHERE id % 2 = 0 AND (i = 1 OR id % 100 < 2)"""
POD_SQL = """SELECT timestamp, 'default' AS namespace, 'k8s_pod_status' AS source, pod || '-' || i AS pod, 'PodStatus' AS reason, CASE WHEN id % 5 = 0 THEN '' ELSE 'Running' END AS message, i AS n
  FROM k8s_v, UNNEST(RANGE(1, 61)) g(i) WHERE id % 2 = 1 AND (i = 1 OR id % 100 < 2)"""


@query("src_k8s_event_envelope", K8S_SQL, ["k8s_v"])
def src_k8s_event_envelope(spark, sf):
    rows = E.cluster_event_rows(E.parse(event_envelopes(A.k8s_events(spark, sf)), "events", bad_ts()))
    return rows.withColumn("n", F.from_json("raw_data", "count bigint")["count"]).drop("raw_data")


@query("src_pod_status_envelope", POD_SQL, ["k8s_v"])
def src_pod_status_envelope(spark, sf):
    rows = E.pod_status_rows(E.parse(event_envelopes(A.k8s_events(spark, sf)), "events", bad_ts()))
    n = F.from_json("raw_data", "containers array<struct<restarts:bigint>>")["containers"][0]["restarts"]
    return rows.withColumn("n", n).drop("raw_data", "event_type")


@query("src_trend_envelope", """SELECT timestamp, 'default' AS namespace, query_name, description, range_window, step, series_count, service, avg, trend_pct, direction FROM trend_v""", ["trend_v"])
def src_trend_envelope(spark, sf):
    rows = E.trend_rows(E.parse(trend_envelopes(T.records(spark, sf)), "tsdb_trends", bad_ts()))
    return rows.select("timestamp", "namespace", "query_name", "description", "range_window", "step", "series_count", F.explode("analysis.series").alias("s")).select(
        "timestamp", "namespace", "query_name", "description", "range_window", "step", "series_count", F.col("s.labels")["service_name"].alias("service"), "s.avg", "s.trend_pct", "s.direction")


@query("str_parse_ts", """SELECT event_id, CASE WHEN event_id % 5 < 3 THEN ts WHEN event_id % 5 = 3 THEN ts - INTERVAL 5 HOUR ELSE TIMESTAMP '2000-01-01 00:00:00' END AS timestamp FROM events""")
def str_parse_ts(spark, sf):
    m, base = F.col("event_id") % 5, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (F.when(m == 0, F.concat(base, F.lit("Z"))).when(m == 1, F.concat(base, F.lit("+00:00"))).when(m == 2, base).when(m == 3, F.concat(base, F.lit("+05:00")))
            .when(F.col("event_id") % 2 == 0, F.lit("not a time")))
    return A.table(spark, sf, "events").select("event_id", parse_iso(text, bad_ts()).alias("timestamp"))


@query("str_bounded_stream", "SELECT event_id, event_type, ts FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000")
def str_bounded_stream(spark, sf):
    return D.newest_per_stream(A.table(spark, sf, "events").select("event_id", "event_type", "ts"), "event_type", "ts", "event_id", 1000)


def repolled(df: DataFrame, ident: str, lag: str, every: int) -> DataFrame:
    """Add a second, later copy of some rows, as overlapping polls do."""
    return df.unionByName(df.filter(F.col(ident) % every == 0).withColumn("timestamp", F.col("timestamp") + F.expr(f"INTERVAL {lag}")))


@query("str_event_dedup", "SELECT id, uid, timestamp, pod, reason, event_type FROM k8s_v", ["k8s_v"])
def str_event_dedup(spark, sf):
    rows = repolled(A.k8s_events(spark, sf).select("id", "uid", "timestamp", "pod", "reason", "event_type"), "id", "10 SECONDS", 3)
    return D.dedup_batch(rows, D.DEDUP_KEYS["events"], ["timestamp"])


@query("str_log_overlap_dedup", "SELECT id, timestamp, service, CAST(EPOCH_US(timestamp) * 1000 AS VARCHAR) AS timestamp_ns, message FROM logs_v", ["logs_v"])
def str_log_overlap_dedup(spark, sf):
    logs = A.logs(spark, sf).withColumn("timestamp_ns", (F.unix_micros(F.col("timestamp").cast("timestamp")) * 1000).cast("string"))
    rows = repolled(logs.select("id", "timestamp", "service", "timestamp_ns", "message"), "id", "5 SECONDS", 2)
    return D.dedup_batch(rows, D.DEDUP_KEYS["logs"], ["timestamp"])


def stream_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream, with an event time that accepts a watermark."""
    schema = A.table(spark, sf, "events").schema
    df = I.file_stream(spark, sf, schema, "parquet", glob="events.parquet")
    return df.withColumn("service", A.services(F.col("user_id")))


@query("str_trace_overlap_dedup", "SELECT trace_id, service, operation FROM traces_v", ["traces_v"])
def str_trace_overlap_dedup(spark, sf):
    """Runs as a stream: duplicates of a trace inside the watermark are dropped."""
    s = stream_events(spark, sf)
    rows = s.select(F.col("event_id").cast("string").alias("trace_id"), F.col("ts").cast("timestamp").alias("timestamp"), "service", F.col("event_type").alias("operation"), "event_id")
    twice = rows.withColumn("_c", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    out = run_dir(spark, "trace-dedup")
    I.start_files(D.dedup_stream(twice, "traces").select("trace_id", "service", "operation"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("trace_id string, service string, operation string").parquet(f"{out}/rows")


@query("src_stream_files", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def src_stream_files(spark, sf):
    schema = A.table(spark, sf, "events").schema
    out = run_dir(spark, "stream-files")
    I.start_files(I.file_stream(spark, sf, schema, "parquet", glob="events.parquet"), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


@query("str_ingest", f"{LOG_SQL} AND event_id % 37 <> 0 UNION ALL SELECT NULL, NULL, 'quarantine', NULL, NULL, '{{bad json', NULL FROM svc WHERE event_id % 37 = 0", ["svc"])
def str_ingest(spark, sf):
    """Envelopes through the streaming consumer into the logs table; malformed ones end in quarantine."""
    out = run_dir(spark, "ingest")
    stream = log_envelopes(stream_events(spark, sf), bad=True)
    I.start_ingest(stream, "logs", out, f"{out}/checkpoint", bad_ts(), available_now=True).awaitTermination()
    bad = sinks.read_stored(spark, out, "quarantine").select(
        *[F.lit(None).cast(t).alias(c) for c, t in (("timestamp", "timestamp_ntz"), ("event_time", "timestamp_ntz"))], F.lit("quarantine").alias("namespace"),
        *[F.lit(None).cast("string").alias(c) for c in ("service", "severity")], F.col("data").alias("message"), F.lit(None).cast("string").alias("labels"))
    return flat_logs(sinks.read_stored(spark, out, "logs")).unionByName(bad)


@query("snk_append_tables", METRIC_SQL, ["svc"])
def snk_append_tables(spark, sf):
    out = run_dir(spark, "tables")
    I.start_ingest(metric_envelopes(stream_events(spark, sf)), "metrics", out, f"{out}/checkpoint", bad_ts(), available_now=True).awaitTermination()
    rows = sinks.read_stored(spark, out, "metrics")
    return rows.select("timestamp", "namespace", "metric_name", flatten_labels(F.col("labels")).alias("labels"), "value")


@query("str_trend_window", f"""
  SELECT query_name, service, data_points, {r('avg', 4)} AS avg, direction FROM (
    SELECT query_name, service, COUNT(*) AS data_points, AVG(v) AS avg, CASE WHEN pct > 5 THEN 'increasing' WHEN pct < -5 THEN 'decreasing' ELSE 'stable' END AS direction
    FROM (SELECT *, CASE WHEN n >= 2 AND a <> 0 THEN (b - a) / a * 100 ELSE 0 END AS pct FROM (
      SELECT *, AVG(v) FILTER (idx < n // 2) OVER s AS a, AVG(v) FILTER (idx >= n // 2) OVER s AS b FROM (
        SELECT event_type AS query_name, service, value AS v, ROW_NUMBER() OVER (PARTITION BY event_type, service ORDER BY ts, event_id) - 1 AS idx, COUNT(*) OVER (PARTITION BY event_type, service) AS n
        FROM svc, now_v WHERE ts > as_of - INTERVAL 24 HOUR) WINDOW s AS (PARTITION BY query_name, service)))
    GROUP BY 1, 2, pct)""", ["svc", "now_v"])
def str_trend_window(spark, sf):
    """Every batch adds its partial sums and publishes the trends of the trailing day from those of all batches."""
    out, now = run_dir(spark, "trend-window"), A.as_of(spark, sf)

    def publish(batch: DataFrame, batch_id: int) -> None:
        samples = batch.select(F.col("event_type").alias("query_name"), "service", "ts", "event_id", F.col("value").cast("string").alias("value"))
        I.publish(TR.add_batch(samples, batch_id, out, ["query_name", "service"], ["ts", "event_id"], now - timedelta(hours=24)), f"{out}/trends", batch_id)
        TR.keep_newest(spark, f"{out}/trends", batch_id)

    I.start_cycle(stream_events(spark, sf), f"{out}/checkpoint", publish, once=True).awaitTermination()
    return I.read_published(spark, f"{out}/trends").select("query_name", "service", "data_points", sfixed("avg", 4).alias("avg"), "direction")


@query("str_batch_counts", "SELECT 'logs' AS type, service, COUNT(*) AS count FROM logs_v GROUP BY 2", ["logs_v"])
def str_batch_counts(spark, sf):
    return I.batch_counts(A.logs(spark, sf), "logs")


@query("str_retention", "SELECT l.* FROM logs_v l, now_v WHERE timestamp >= as_of - INTERVAL 7 DAY", ["logs_v", "now_v"])
def str_retention(spark, sf):
    return D.retention(A.logs(spark, sf), A.as_of(spark, sf), column="timestamp")


@query("str_analysis_cycle", """
  SELECT service, CASE WHEN e / n > 0.1E0 THEN 'CRITICAL' WHEN e / n > 0.02E0 OR slow > 10 THEN 'DEGRADED' ELSE 'HEALTHY' END AS health_status, n AS total_logs, e AS total_errors, slow AS slow_traces
  FROM (SELECT service, COUNT(*) AS n, COUNT(*) FILTER (event_type = 'error') AS e, COUNT(*) FILTER (value * 10 > 500) AS slow FROM svc, now_v WHERE ts > as_of - INTERVAL 24 HOUR GROUP BY 1)""", ["svc", "now_v"])
def str_analysis_cycle(spark, sf):
    """Analysis cycles over the stored look-back, one for each batch of what has arrived; the newest report counts."""
    out, now = run_dir(spark, "analysis-cycle"), A.as_of(spark, sf)

    def analyse(batch: DataFrame, batch_id: int) -> None:
        stats = I.stored_look_back(batch, batch_id, out, "events", "ts", now - timedelta(hours=24)).groupBy("service").agg(
            F.count(F.lit(1)).alias("total_logs"), F.count_if(F.col("event_type") == "error").alias("total_errors"), F.count_if(F.col("value") * 10 > 500).alias("slow_traces"))
        I.publish(OR.rule_report(stats), f"{out}/analysis", batch_id)

    I.start_cycle(stream_events(spark, sf), f"{out}/checkpoint", analyse, once=True).awaitTermination()
    return I.read_published(spark, f"{out}/analysis").select("service", "health_status", "total_logs", "total_errors", "slow_traces")


@query("str_tumbling_severity", "SELECT DATE_TRUNC('minute', timestamp) AS window_start, severity, COUNT(*) AS n FROM logs_v GROUP BY 1, 2", ["logs_v"])
def str_tumbling_severity(spark, sf):
    return tumbling_severity(A.logs(spark, sf))


@query("str_late_data", """
  WITH m AS (SELECT MIN(ts) + (MAX(ts) - MIN(ts)) / 2 AS mid, MAX(ts) AS last FROM svc),
    f AS (SELECT s.*, CASE WHEN ts <= mid AND event_id % 10 <> 0 THEN 0 ELSE 1 END AS part FROM svc s, m),
    wm AS (SELECT MAX(ts) - INTERVAL 15 SECOND AS w FROM f WHERE part = 0)
  SELECT DATE_TRUNC('minute', ts) AS window_start, event_type AS severity, COUNT(*) AS n FROM f, wm, m
  WHERE (part = 0 OR DATE_TRUNC('minute', ts) + INTERVAL 1 MINUTE > w) AND DATE_TRUNC('minute', ts) + INTERVAL 1 MINUTE <= last - INTERVAL 15 SECOND GROUP BY 1, 2""", ["svc"])
def str_late_data(spark, sf):
    """Three files in sequence; the last holds rows of the first half, which the watermark drops.

    Spark filters late rows with the watermark of the batch before, hence the file in between.
    """
    e = A.svc(spark, sf)
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    first_half = F.col("ts") <= F.lit(low + (high - low) / 2).cast("timestamp_ntz")
    late = first_half & (F.col("event_id") % 10 == 0)
    out = run_dir(spark, "late-data")
    rows = e.select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("severity"),
                    F.when(late, 2).when(first_half, 0).otherwise(1).alias("part"))
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))       # every part is that many files, i.e. one batch
    for part in range(3):
        rows.filter(F.col("part") == part).drop("part").repartition(files).write.mode("append").parquet(f"{out}/in")
    stream = I.file_stream(spark, f"{out}/in", rows.drop("part").schema, "parquet", files_per_trigger=files)
    I.start_files(tumbling_severity(stream, watermark=D.WATERMARKS["logs"]), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("window_start timestamp, severity string, n bigint").parquet(f"{out}/rows").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("src_backend_log_pull", """SELECT l.* FROM logs_v l, now_v WHERE timestamp >= as_of - INTERVAL 1440 MINUTE""", ["logs_v", "now_v"])
def src_backend_log_pull(spark, sf):
    return log_pull(A.logs(spark, sf), A.as_of(spark, sf))


@query("src_training_parquet", "SELECT window_id, service, label, CAST(label <> 'normal' AS INT) AS is_anomaly FROM label_v", ["label_v"])
def src_training_parquet(spark, sf):
    df = W.labelled(spark, sf)
    path = run_dir(spark, "training") + "/windows"
    return training_set(spark, path, df.schema, lambda: W.labelled(spark, sf)).select("window_id", "service", "label", "is_anomaly")


@query("snk_training_parquet", "SELECT 'windows' AS frame, service, COUNT(*) AS n FROM slide_v GROUP BY 2 UNION ALL SELECT 'features', service, COUNT(*) FROM label_v GROUP BY 2 UNION ALL SELECT 'logs', service, COUNT(*) FROM logs_v GROUP BY 2", ["slide_v", "label_v", "logs_v"])
def snk_training_parquet(spark, sf):
    root = run_dir(spark, "training-set")
    sinks.write_training({"windows": W.windows(spark, sf), "features": W.labelled(spark, sf), "logs": A.logs(spark, sf)}, root)
    frames = [spark.read.parquet(f"{root}/{n}").groupBy("service").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("frame"), "service", "n") for n in ("windows", "features", "logs")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("snk_results_json_csv", f"SELECT 'json' AS format, service AS model, {r('AVG(duration_ms)', 6)} AS avg_ms FROM traces_v GROUP BY 2 UNION ALL SELECT 'csv', service, {r('AVG(duration_ms)', 6)} FROM traces_v GROUP BY 2", ["traces_v"])
def snk_results_json_csv(spark, sf):
    root = run_dir(spark, "results")
    res = A.traces(spark, sf).groupBy(F.col("service").alias("model")).agg(sfixed(F.avg("duration_ms"), 6).alias("avg_ms"))
    sinks.write_results(res, root)
    schema = "model string, avg_ms double"
    back = spark.read.schema(schema).json(f"{root}/json").select(F.lit("json").alias("format"), "*")
    return back.unionByName(spark.read.schema(schema).option("header", True).csv(f"{root}/csv").select(F.lit("csv").alias("format"), "*"))


@query("snk_export_tables", """SELECT 'logs' AS sheet, COUNT(*) AS n FROM logs_v UNION ALL SELECT 'metrics', COUNT(*) FROM metrics_v UNION ALL SELECT 'traces', COUNT(*) FROM traces_v UNION ALL SELECT 'events', COUNT(*) FROM k8s_v
  UNION ALL SELECT 'analysis', COUNT(*) FROM report_v UNION ALL SELECT 'anomalies', COUNT(*) FROM report_v WHERE n_anomalies = 1 UNION ALL SELECT 'recommendations', SUM(n_alerts)::BIGINT FROM report_v
  UNION ALL SELECT 'trends', COUNT(*) FROM trend_v UNION ALL SELECT 'summary', 6""", ["logs_v", "metrics_v", "traces_v", "k8s_v", "report_v", "trend_v"])
def snk_export_tables(spark, sf):
    from tidewatch.plans import exports as P
    sheets = {"summary": P.x_summary, "logs": P.x_logs, "metrics": P.x_metrics, "traces": P.x_traces, "events": P.x_events, "analysis": P.x_analysis,
              "anomalies": P.x_anomalies, "recommendations": P.x_recommendations, "trends": P.x_trends}
    paths = sinks.export_tables({n: f(spark, sf) for n, f in sheets.items()}, run_dir(spark, "export"), "parquet")
    out = None
    for name, path in paths.items():
        one = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sheet"), "n")
        out = one if out is None else out.unionByName(one)
    return out
