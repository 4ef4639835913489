"""Registered time-series queries."""
from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch import adapters as A
from tidewatch.functions.scalar import fixed as sfixed, flatten_labels
from tidewatch.functions.series import with_position
from tidewatch.operators import timeseries as TS
from tidewatch.plans.registry import query
from tidewatch.plans.views import add_view, fixed as r
from tidewatch.session import run_dir

SERIES = ["service", "event_type"]
HOUR = 3600
SCALE = 24

add_view("inc_v", """
  SELECT *, CASE WHEN prev IS NULL THEN 0.0E0 WHEN value < prev THEN value ELSE value - prev END AS increase
  FROM (SELECT *, LAG(value) OVER (PARTITION BY service, event_type ORDER BY ts) AS prev FROM counter_v)""", "counter_v")
add_view("rate_v", """
  SELECT service, event_type, as_of - j * INTERVAL 3 HOUR AS eval_ts, SUM(increase) / 21600.0E0 AS value
  FROM inc_v, now_v, UNNEST(RANGE(0, 241)) g(j)
  WHERE ts <= as_of - j * INTERVAL 3 HOUR AND ts > as_of - j * INTERVAL 3 HOUR - INTERVAL 6 HOUR GROUP BY 1, 2, 3""", "inc_v", "now_v")


def rates(spark: SparkSession, sf: str) -> DataFrame:
    return TS.rate(A.counters(spark, sf), SERIES, A.as_of(spark, sf), 3 * HOUR, 6 * HOUR)


@query("ts_rate", f"SELECT service, event_type, eval_ts, {r('value', 9)} AS value FROM rate_v", ["rate_v"])
def ts_rate(spark, sf):
    return rates(spark, sf).withColumn("value", sfixed("value", 9))


@query("ts_sum_by", f"SELECT service, eval_ts, {r('SUM(value)', 9)} AS value FROM rate_v GROUP BY 1, 2", ["rate_v"])
def ts_sum_by(spark, sf):
    return TS.sum_by(rates(spark, sf), ["service"]).withColumn("value", sfixed("value", 9))


def quantile_sql(q: float, source: str, name: str = "value") -> str:
    """Histogram quantile over ``source(service, eval_ts, le, c)``."""
    return f"""SELECT service, eval_ts, CASE WHEN total > 0 THEN CASE WHEN ISINF(le) THEN ple WHEN c = COALESCE(pc, 0) THEN le
      ELSE COALESCE(ple, 0) + (le - COALESCE(ple, 0)) * (total * {q}E0 - COALESCE(pc, 0)) / (c - COALESCE(pc, 0)) END END AS {name}
    FROM (SELECT *, LAG(le) OVER w AS ple, LAG(c) OVER w AS pc, MAX(c) OVER (PARTITION BY service, eval_ts) AS total FROM ({source}) WINDOW w AS (PARTITION BY service, eval_ts ORDER BY le))
    WHERE c >= total * {q}E0 QUALIFY ROW_NUMBER() OVER (PARTITION BY service, eval_ts ORDER BY le) = 1"""


HIST = "SELECT service, eval_ts, le, CAST(cum AS DOUBLE) AS c FROM bucket_v"


@query("ts_histogram_quantile", f"""
  SELECT service, eval_ts, {r('a.q0', 6)} AS q0, {r('b.q1', 6)} AS q1 FROM ({quantile_sql(0.5, HIST, 'q0')}) a JOIN ({quantile_sql(0.99, HIST, 'q1')}) b USING (service, eval_ts)""", ["bucket_v"])
def ts_histogram_quantile(spark, sf):
    out = TS.histogram_quantiles(A.buckets(spark, sf), ["service", "eval_ts"], [0.5, 0.99])
    return out.withColumns({"q0": sfixed("q0", 6), "q1": sfixed("q1", 6)})


@query("ts_label_match", """SELECT * FROM counter_v WHERE service <> 'svc-c' AND REGEXP_FULL_MATCH(event_type, 'err.*|v.ew') AND NOT REGEXP_FULL_MATCH(service, '.*b')""", ["counter_v"])
def ts_label_match(spark, sf):
    return TS.label_match(A.counters(spark, sf), [TS.Matcher("service", "!=", "svc-c"), TS.Matcher("event_type", "=~", "err.*|v.ew"), TS.Matcher("service", "!~", ".*b")])


@query("ts_instant", """SELECT service, event_type, ARG_MAX(value, ts) AS value, MAX(ts) AS ts FROM counter_v, now_v
  WHERE ts <= as_of AND ts > as_of - INTERVAL 1 HOUR GROUP BY 1, 2""", ["counter_v", "now_v"])
def ts_instant(spark, sf):
    return TS.instant(A.counters(spark, sf), SERIES, A.as_of(spark, sf), staleness=HOUR)


@query("ts_range_grid", """
  SELECT service, event_type, as_of - j * INTERVAL 2 HOUR AS eval_ts, COUNT(*) AS n, SUM(value) AS total, ARG_MAX(value, ts) AS last
  FROM counter_v, now_v, UNNEST(RANGE(0, 37)) g(j)
  WHERE ts <= as_of - j * INTERVAL 2 HOUR AND ts > as_of - j * INTERVAL 2 HOUR - INTERVAL 5 HOUR GROUP BY 1, 2, 3""", ["counter_v", "now_v"])
def ts_range_grid(spark, sf):
    return TS.on_grid(A.counters(spark, sf), SERIES, A.as_of(spark, sf), 2 * HOUR, 5 * HOUR, 72 * HOUR)


@query("src_range_read", """
  SELECT event_type, as_of - INTERVAL 2 DAY - j * INTERVAL 1 HOUR AS eval_ts, ARG_MAX(value, ts) AS value FROM counter_v, now_v, UNNEST(RANGE(0, 49)) g(j)
  WHERE service = 'svc-a' AND event_type IN ('click', 'error') AND ts <= as_of - INTERVAL 2 DAY - j * INTERVAL 1 HOUR AND ts > as_of - INTERVAL 2 DAY - j * INTERVAL 1 HOUR - INTERVAL 1 HOUR
  GROUP BY 1, 2""", ["counter_v", "now_v"])
def src_range_read(spark, sf):
    from tidewatch.sources.tables import range_read
    end = A.as_of(spark, sf) - timedelta(days=2)
    return range_read(A.counters(spark, sf), ["event_type"], end - timedelta(days=2), end, HOUR,
                      [TS.Matcher("service", "=", "svc-a"), TS.Matcher("event_type", "=~", "click|error")])


add_view("packed_v", """
  SELECT *, CASE metric WHEN 'http_server_request_duration_seconds_count' THEN rn WHEN 'http_server_request_duration_seconds_bucket' THEN rn
      WHEN 'jvm_gc_duration_seconds_sum' THEN rn * 0.25E0 ELSE g END AS value
  FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY metric, service, status, le ORDER BY ts, event_id) AS DOUBLE) AS rn FROM (
    SELECT 'http_server_request_duration_seconds_count' AS metric, service, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, 0.0E0 AS le, ts, event_id, 0.0E0 AS g FROM svc
    UNION ALL SELECT 'http_server_request_duration_seconds_bucket', service, '', b.le, ts, event_id, 0.0E0 FROM svc, (VALUES (10.0E0), (25.0E0), (50.0E0), (100.0E0), (250.0E0), (CAST('Infinity' AS DOUBLE))) b(le) WHERE value <= b.le
    UNION ALL SELECT 'jvm_gc_duration_seconds_sum', service, '', 0.0E0, ts, event_id, 0.0E0 FROM svc
    UNION ALL SELECT 'jvm_memory_used_bytes', service, '', 0.0E0, ts, event_id, 2.0E8 + value * 1.0E5 FROM svc
    UNION ALL SELECT 'jvm_threads_live_threads', service, '', 0.0E0, ts, event_id, CAST(10 + user_id % 20 AS DOUBLE) FROM svc))""", "svc")


def packed(spark: SparkSession, sf: str) -> DataFrame:
    """Long sample table with the metric families of the definition packs, built in one pass over the events."""
    e = A.svc(spark, sf)
    row = lambda metric, status="", le=0.0, g=F.lit(0.0): F.struct(
        F.lit(metric).alias("metric"), (status if not isinstance(status, str) else F.lit(status)).alias("status"), F.lit(le).alias("le"), g.alias("g"))
    families = F.array(
        row("http_server_request_duration_seconds_count", F.when(F.col("event_type") == "error", "500").otherwise("200")),
        *[row("http_server_request_duration_seconds_bucket", "", b) for b in A.BUCKET_BOUNDS],
        row("jvm_gc_duration_seconds_sum"), row("jvm_memory_used_bytes", g=2.0e8 + F.col("value") * 1.0e5),
        row("jvm_threads_live_threads", g=(10 + F.col("user_id") % 20).cast("double")))
    rows = e.select("service", "ts", "event_id", F.col("value").alias("_value"), F.inline(families)).filter(
        (F.col("metric") != "http_server_request_duration_seconds_bucket") | (F.col("_value") <= F.col("le"))).drop("_value")
    placed = with_position(rows, ["metric", "service", "status", "le"], ["ts", "event_id"], "ts")
    n = (F.col("idx") + 1).cast("double")
    value = (F.when(F.col("metric").isin("http_server_request_duration_seconds_count", "http_server_request_duration_seconds_bucket"), n)
             .when(F.col("metric") == "jvm_gc_duration_seconds_sum", n * 0.25).otherwise(F.col("g")))
    return placed.select("metric", "service", "status", "le", "ts", "event_id", value.alias("value"))


def definition_sql(d: TS.Definition) -> str:
    span, step, rng = d.span * SCALE, d.step * SCALE, d.range_s * SCALE
    edge = f"as_of - j * INTERVAL {step} SECOND"
    grid = f"now_v, UNNEST(RANGE(0, {span // step + 1})) g(j)"
    covers = f"ts <= {edge} AND ts > {edge} - INTERVAL {rng} SECOND"
    mine = f"(SELECT p.* FROM packed_v p, now_v WHERE metric = '{d.metric}' AND ts > as_of - INTERVAL {span + 2 * rng} SECOND)"
    if d.kind == "gauge":
        return f"SELECT '{d.name}' AS query_name, service, {edge} AS eval_ts, ARG_MAX(value, ts) AS value FROM {mine}, {grid} WHERE {covers} GROUP BY 2, 3"
    inc = f"""(SELECT *, CASE WHEN prev IS NULL THEN 0.0E0 WHEN value < prev THEN value ELSE value - prev END AS increase
      FROM (SELECT *, LAG(value) OVER (PARTITION BY service, status, le ORDER BY ts, event_id) AS prev FROM {mine}))"""
    if d.kind == "quantile":
        src = f"SELECT service, {edge} AS eval_ts, le, SUM(increase) AS c FROM {inc}, {grid} WHERE {covers} GROUP BY 1, 2, 3"
        return f"SELECT '{d.name}' AS query_name, service, eval_ts, value FROM (SELECT k.service, k.eval_ts, v.value FROM (SELECT DISTINCT service, eval_ts FROM ({src})) k LEFT JOIN ({quantile_sql(d.q, src)}) v USING (service, eval_ts))"
    where = "AND REGEXP_FULL_MATCH(status, '5..')" if d.kind == "errors" else ""
    return f"SELECT '{d.name}' AS query_name, service, {edge} AS eval_ts, SUM(increase) / {rng}.0E0 AS value FROM {inc}, {grid} WHERE {covers} {where} GROUP BY 2, 3"


def pack_sql(defs) -> str:
    return f"SELECT query_name, service, eval_ts, {r('value', 6)} AS value FROM (" + " UNION ALL ".join(f"({definition_sql(d)})" for d in defs) + ")"


@query("ts_instant_pack", pack_sql(TS.INSTANT_PACK), ["packed_v", "now_v"])
def ts_instant_pack(spark, sf):
    return TS.evaluate_pack(packed(spark, sf), TS.INSTANT_PACK, A.as_of(spark, sf), SCALE, ["ts", "event_id"]).withColumn("value", sfixed("value", 6))


@query("ts_trend_pack", pack_sql(TS.TREND_PACK), ["packed_v", "now_v"])
def ts_trend_pack(spark, sf):
    return TS.evaluate_pack(packed(spark, sf), TS.TREND_PACK, A.as_of(spark, sf), SCALE, ["ts", "event_id"]).withColumn("value", sfixed("value", 6))


@query("ts_dedup_scrape", """SELECT service, event_type, ARG_MAX(ts, ts) AS ts, ARG_MAX(value, ts) AS value FROM counter_v
  GROUP BY service, event_type, TIME_BUCKET(INTERVAL 3600 SECOND, ts, TIMESTAMP '2000-01-01')""", ["counter_v"])
def ts_dedup_scrape(spark, sf):
    return TS.dedup_scrape(A.counters(spark, sf), SERIES, 3600)


@query("ts_downsample", """
  SELECT service, event_type, ts, value FROM counter_v, now_v WHERE ts >= as_of - INTERVAL 2 DAY UNION ALL
  SELECT service, event_type, MAX(ts), ARG_MAX(value, ts) FROM counter_v, now_v WHERE ts < as_of - INTERVAL 2 DAY
  GROUP BY service, event_type, ts < as_of - INTERVAL 25 DAY, CASE WHEN ts >= as_of - INTERVAL 25 DAY THEN TIME_BUCKET(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') ELSE DATE_TRUNC('hour', ts) END""", ["counter_v", "now_v"])
def ts_downsample(spark, sf):
    return TS.downsample(A.counters(spark, sf), SERIES, A.as_of(spark, sf) + timedelta(days=5))


@query("ts_retention_30d", "SELECT c.* FROM counter_v c, now_v WHERE ts >= as_of - INTERVAL 25 DAY", ["counter_v", "now_v"])
def ts_retention_30d(spark, sf):
    return TS.retain(A.counters(spark, sf), A.as_of(spark, sf) + timedelta(days=5))


@query("ts_relabel", """SELECT event_id, 'service=' || service || ', k=' || REGEXP_EXTRACT(props, '([0-9]+)', 1) AS labels FROM svc WHERE REGEXP_FULL_MATCH(service, 'svc-[ab]')""", ["svc"])
def ts_relabel(spark, sf):
    rows = A.svc(spark, sf).select("event_id", F.create_map(F.lit("service"), F.col("service")).alias("labels"),
                                   F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("service"), F.lit("x"))).alias("resource"))
    return TS.relabel(rows, [TS.Matcher("service", "=~", "svc-[ab]")], "resource").select("event_id", flatten_labels(F.col("labels")).alias("labels"))


SLIDING_SQL = f"""
  SELECT service, event_type, eval_ts, {r('SUM(increase) / 120.0E0', 9)} AS value FROM (
    SELECT service, event_type, increase, TIME_BUCKET(INTERVAL 15 SECOND, ts, TIMESTAMP '2000-01-01') + (j + 1) * INTERVAL 15 SECOND AS eval_ts FROM inc_v, UNNEST(RANGE(0, 8)) g(j))
  GROUP BY 1, 2, 3"""


@query("str_sliding_rate", SLIDING_SQL, ["inc_v"])
def str_sliding_rate(spark, sf):
    from tidewatch.streaming.windows import sliding_rate
    inc = TS.counter_increase(A.counters(spark, sf), SERIES)
    return sliding_rate(inc, SERIES, "increase").withColumn("value", sfixed("value", 9))


@query("str_sliding_rate_stream", SLIDING_SQL, ["inc_v"])
def str_sliding_rate_stream(spark, sf):
    """The samples as a stream of files, a third of the time after the other; a last sample of no series lets the watermark pass them all."""
    from tidewatch.streaming import ingest as I
    from tidewatch.streaming.windows import sliding_rate_stream

    out, files = run_dir(spark, "sliding-rate"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = A.counters(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        return rows.select(*SERIES, F.col("ts").cast("timestamp_ntz").alias("eval_ts"), "value").limit(0)
    borders = [low + (high - low) * k / 3 for k in range(4)]
    for k in range(3):
        part = rows.where((F.col("ts") >= borders[k]) & ((F.col("ts") < borders[k + 1]) | F.lit(k == 2)))
        part.repartition(files).write.mode("append").parquet(f"{out}/in")
    rows.limit(1).select(F.lit("").alias("service"), F.lit("").alias("event_type"), F.lit(high + timedelta(hours=1)).alias("ts"), "value").write.mode("append").parquet(f"{out}/in")
    stream = I.file_stream(spark, f"{out}/in", rows.schema, "parquet", files_per_trigger=files)
    I.start_files(sliding_rate_stream(stream, SERIES), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    found = spark.read.schema("service string, event_type string, eval_ts timestamp, value double").parquet(f"{out}/rows")
    return found.select(*SERIES, F.col("eval_ts").cast("timestamp_ntz").alias("eval_ts"), sfixed("value", 9).alias("value"))
