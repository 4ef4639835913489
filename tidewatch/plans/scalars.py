"""Registered column functions, each over a whole table."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch import adapters as A
from tidewatch.constants import METRIC_TO_FEATURE
from tidewatch.functions import scalar as S
from tidewatch.plans.registry import query
from tidewatch.plans.views import fixed as r


@query("fn_severity", """
  SELECT doc_id, CASE WHEN REGEXP_MATCHES(LOWER(text), 'error|exception|stacktrace|fatal') THEN 'ERROR'
    WHEN LOWER(text) LIKE '%warn%' THEN 'WARN' WHEN REGEXP_MATCHES(LOWER(text), 'debug|trace') THEN 'DEBUG' ELSE 'INFO' END AS severity
  FROM documents UNION ALL
  SELECT -1 - id AS doc_id, severity FROM logs_v""", ["logs_v"])
def fn_severity(spark, sf):
    docs = A.table(spark, sf, "documents").select("doc_id", S.severity(F.col("text")).alias("severity"))
    return docs.unionByName(A.logs(spark, sf).select((-1 - F.col("id")).alias("doc_id"), S.severity(F.col("message")).alias("severity")))


@query("fn_truncate", """
  SELECT doc_id, SUBSTRING(text, 1, 4096) AS t4096, SUBSTRING(text, 1, 500) AS t500, SUBSTRING(text, 1, 300) AS t300,
    SUBSTRING(text, 1, 200) AS t200, SUBSTRING(text, 1, 100) AS t100, SUBSTRING(text, 1, 16) AS t16 FROM documents""")
def fn_truncate(spark, sf):
    return A.table(spark, sf, "documents").select(
        "doc_id", *[S.truncate(F.col("text"), n).alias(f"t{n}") for n in (4096, 500, 300, 200, 100, 16)])


@query("fn_trace_flags", """
  SELECT event_id, COALESCE(d, 0) > 500 AS is_slow, COALESCE(s, 0) = 2 AS has_error FROM (
    SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value * 10 END AS d,
      CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id % 4 END AS s FROM events)""")
def fn_trace_flags(spark, sf):
    slow, err = S.trace_flags(F.when(F.col("event_id") % 13 != 0, F.col("value") * 10),
                              F.when(F.col("event_id") % 7 != 0, F.col("user_id") % 4))
    return A.table(spark, sf, "events").select("event_id", slow.alias("is_slow"), err.alias("has_error"))


def labelled(spark, sf):
    """Events with a label map that misses the service, the job or both for some rows."""
    key, user = F.col("event_id"), F.col("user_id").cast("string")
    labels = (F.when(key % 4 == 0, F.create_map(F.lit("service_name"), F.concat(F.lit("u"), user, F.lit("-service")), F.lit("job"), F.lit("otel")))
              .when(key % 4 == 1, F.create_map(F.lit("job"), F.concat(F.lit("job-"), user)))
              .when(key % 4 == 2, F.create_map(F.lit("le"), F.lit("5"))))
    return A.table(spark, sf, "events").select("event_id", "event_type", "value", labels.alias("labels"))


LABELLED = """SELECT event_id, event_type, value, event_id % 4 AS k, CAST(user_id AS VARCHAR) AS u FROM events"""


@query("fn_service_from_labels", f"""
  SELECT event_id, CASE k WHEN 0 THEN 'u' || u || '-service' WHEN 1 THEN 'job-' || u ELSE 'unknown' END AS service FROM ({LABELLED})""")
def fn_service_from_labels(spark, sf):
    return labelled(spark, sf).select("event_id", S.service_of(F.col("labels")).alias("service"))


@query("fn_flatten_labels", f"""
  SELECT event_id, CASE k WHEN 0 THEN 'service_name=u' || u || '-service, job=otel' WHEN 1 THEN 'job=job-' || u WHEN 2 THEN 'le=5' ELSE '' END AS labels
  FROM ({LABELLED})""")
def fn_flatten_labels(spark, sf):
    return labelled(spark, sf).select("event_id", S.flatten_labels(F.col("labels")).alias("labels"))


@query("fn_to_json", f"""
  SELECT event_id, CASE k WHEN 0 THEN '{{"service_name":"u' || u || '-service","job":"otel"}}' WHEN 1 THEN '{{"job":"job-' || u || '"}}'
    WHEN 2 THEN '{{"le":"5"}}' ELSE '' END AS labels FROM ({LABELLED})""")
def fn_to_json(spark, sf):
    return labelled(spark, sf).select("event_id", S.json_text(F.col("labels")).alias("labels"))


def json_field(spark, sf):
    """The ``props`` text wrapped as an array, left as an object, or damaged, in turn."""
    k, p = F.col("event_id") % 4, F.col("props")
    text = F.when(k == 0, F.concat(F.lit("["), p, F.lit(","), p, F.lit("]"))).when(k == 1, p).when(k == 2, F.concat(F.lit("["), p))
    return A.table(spark, sf, "events").select("event_id", "props", text.alias("field"))


@query("fn_lenient_json", """
  SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END AS n,
    CASE WHEN event_id % 4 = 0 THEN CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS BIGINT) END AS first_k FROM events""")
def fn_lenient_json(spark, sf):
    # an object is not an array: parse only array text as an array
    df = json_field(spark, sf)
    arr = S.lenient_json(F.when(F.col("field").rlike(r"^\s*\[.*\]\s*$"), F.col("field")), "array<struct<k:bigint>>")
    return df.select("event_id", F.size(arr).alias("n"), F.get(arr, F.lit(0))["k"].alias("first_k"))


@query("fn_strip_fence_json", """
  SELECT event_id, CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""")
def fn_strip_fence_json(spark, sf):
    p = F.col("props")
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).otherwise(p)
    return A.table(spark, sf, "events").select("event_id", F.from_json(S.strip_fence(fenced), "k bigint")["k"].alias("k"))


@query("fn_extract_json_block", """
  SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS BIGINT) END AS k FROM events""")
def fn_extract_json_block(spark, sf):
    m, p = F.col("event_id") % 3, F.col("props")
    text = F.when(m == 0, p).when(m == 1, F.concat(F.lit("Report follows:\n"), p, F.lit("\nEnd."))).otherwise(F.lit("no json {here"))
    return A.table(spark, sf, "events").select("event_id", F.from_json(S.json_block(text), "k bigint")["k"].alias("k"))


@query("fn_first_int", """
  SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE user_id * 1000 + 7 END AS n FROM events""")
def fn_first_int(spark, sf):
    m, n = F.col("event_id") % 3, F.col("user_id") * 1000 + 7
    text = (F.when(m == 0, F.concat(F.lit("Total logs: "), n.cast("string"), F.lit(" of 9")))
            .when(m == 1, F.concat(F.lit("Slow traces (>500ms): "), F.format_number(n, 0)))
            .otherwise(F.lit("Error traces: N/A")))
    return A.table(spark, sf, "events").select("event_id", S.first_int(text).alias("n"))


@query("fn_numeric_coerce", "SELECT id, TRY_CAST(value AS DOUBLE) AS value FROM metrics_v", ["metrics_v"])
def fn_numeric_coerce(spark, sf):
    return A.metrics(spark, sf).select("id", S.to_number(F.col("value")).alias("value"))


NAMES = [*METRIC_TO_FEATURE, "unmapped_metric"]


@query("fn_metric_feature_map", f"""
  SELECT event_id, name, CASE name {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_TO_FEATURE.items())} END AS feature
  FROM (SELECT event_id, ({NAMES!r})[1 + event_id % {len(NAMES)}] AS name FROM events) WHERE name <> 'unmapped_metric'""")
def fn_metric_feature_map(spark, sf):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("event_id") % len(NAMES) + 1).cast("int"))
    return A.table(spark, sf, "events").select("event_id", name.alias("name"), S.feature_of(name).alias("feature")).filter(
        F.col("feature").isNotNull())


@query("fn_format_value", f"""
  SELECT event_id, CASE WHEN v IS NULL THEN '—' WHEN CONTAINS(q, 'heap') THEN PRINTF('%.0f MB', {r('v / 1024 / 1024', 0)})
    WHEN v < 0.01 THEN PRINTF('%.4f', {r('v', 4)}) WHEN v < 1 THEN PRINTF('%.3f', {r('v', 3)}) WHEN v > 1000 THEN PRINTF('%.0f', {r('v', 0)})
    ELSE PRINTF('%.2f', {r('v', 2)}) END AS text
  FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'jvm_heap_used_1h' ELSE 'request_rate_1h' END AS q,
    CASE event_id % 5 WHEN 0 THEN 2.0E8 + value * 1.0E5 WHEN 1 THEN value / 100000 WHEN 2 THEN value / 1000 WHEN 3 THEN value * 1000 END AS v FROM events)""")
def fn_format_value(spark, sf):
    k, v = F.col("event_id") % 5, F.col("value")
    df = A.table(spark, sf, "events").select(
        "event_id", F.when(k == 0, "jvm_heap_used_1h").otherwise("request_rate_1h").alias("q"),
        F.when(k == 0, 2.0e8 + v * 1.0e5).when(k == 1, v / 100000).when(k == 2, v / 1000).when(k == 3, v * 1000).alias("v"))
    return df.select("event_id", S.format_value(F.col("q"), F.col("v")).alias("text"))


@query("fn_short_names", """
  SELECT c_custkey, LOWER(c_mktsegment) AS service, REPLACE(c_name, '#', ' ') AS metric FROM customer""")
def fn_short_names(spark, sf):
    df = A.table(spark, sf, "customer")
    return df.select("c_custkey", S.short_service(F.concat(F.lower("c_mktsegment"), F.lit("-service"))).alias("service"),
                     S.pretty_query(F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit("_")), F.lit("_24h"))).alias("metric"))


@query("fn_epoch_ns", """
  SELECT event_id, ts AS from_ns, DATE_TRUNC('second', ts) AS from_seconds FROM events""")
def fn_epoch_ns(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ns = F.concat(us.cast("string"), F.lit("123"))
    return A.table(spark, sf, "events").select(
        "event_id", S.from_epoch_ns(ns).alias("from_ns"),
        S.from_epoch_seconds(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string")).alias("from_seconds"))


@query("fn_pct_label", f"""
  SELECT event_id, CASE event_type WHEN 'error' THEN 'Config Error' WHEN 'view' THEN 'Jvm Gc Pressure' ELSE 'Memory Leak' END AS label,
    PRINTF('%.0f%%', {r('value / 5', 0)}) AS pct FROM events""")
def fn_pct_label(spark, sf):
    t = F.col("event_type")
    raw = F.when(t == "error", "config_error").when(t == "view", "jvm_gc_pressure").otherwise("memory_leak")
    return A.table(spark, sf, "events").select("event_id", S.title_label(raw).alias("label"), S.percent_text(F.col("value") / 500).alias("pct"))


@query("fn_array_caps", """
  SELECT vec_id, LEN(embedding[1:10])::INT AS n_head, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[10] AS DOUBLE) AS tenth FROM embeddings""")
def fn_array_caps(spark, sf):
    head = F.slice("embedding", 1, 10)
    return A.table(spark, sf, "embeddings").select(
        "vec_id", F.size(head).alias("n_head"), F.get("embedding", F.lit(0)).cast("double").alias("first"),
        F.get(head, F.lit(9)).cast("double").alias("tenth"))
