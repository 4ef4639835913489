"""Telemetry views over the star-schema test tables.

Each function maps ``(spark, sf_dir)`` to one telemetry table. They only project and derive columns, so scans
keep column pruning and filter pushdown.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.scalar import severity
from tidewatch.functions.series import floor_ts, ntz, with_position


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_of(spark: SparkSession, sf: str):
    """Newest event time; used as a literal, so that time filters reach the scan."""
    return table(spark, sf, "events").agg(F.max("ts")).first()[0]


def k8s_as_of(spark: SparkSession, sf: str):
    return table(spark, sf, "orders").agg(F.max("o_orderdate")).first()[0]


def services(user_id: Column) -> Column:
    return F.when(user_id % 3 == 0, "svc-a").when(user_id % 3 == 1, "svc-b").otherwise("svc-c")


def svc(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("service", services(F.col("user_id")))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.floor("value").cast("int").cast("string")
    user = F.col("user_id").cast("string")
    message = (
        F.when(F.col("event_type") == "error",
               F.concat(F.lit("Exception: connection refused to 10.0."), user, F.lit(".1 after "), ms, F.lit("ms")))
        .when(F.col("event_type") == "purchase",
              F.concat(F.lit("Slow query warning: took "), ms, F.lit("ms (threshold: 500ms)")))
        .when(F.col("event_type") == "view",
              F.concat(F.lit("debug cache hit for key item:"), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "click",
              F.concat(F.lit("Request completed in "), ms, F.lit("ms with status 200")))
        .otherwise(F.concat(F.lit("Received GET /api/users/"), user))
    )
    return svc(spark, sf).select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.lit("default").alias("namespace"),
        "service", message.alias("message"), severity(message).alias("severity"))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.col("value") * 10
    return svc(spark, sf).select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_id").cast("string").alias("trace_id"),
        "service", F.col("event_type").alias("operation"), ms.alias("duration_ms"), (ms > 500).alias("is_slow"),
        (F.col("event_type") == "error").alias("has_error"))


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return svc(spark, sf).select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("event_type").alias("metric_name"), "service",
        F.when(F.col("event_id") % 97 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"))


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counter samples with a reset every 50 samples of a series."""
    rows = with_position(
        svc(spark, sf).select("service", "event_type", "ts", "event_id"),
        ["service", "event_type"], ["ts", "event_id"], "ts")
    return rows.select("service", "event_type", "ts", ((F.col("idx") + 1) % 50).cast("double").alias("value"))


BUCKET_BOUNDS = [10.0, 25.0, 50.0, 100.0, 250.0, float("inf")]


def buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Cumulative histogram per service and day: one pass of conditional counts, then six rows per group."""
    bounds = F.array(*[F.lit(b) for b in BUCKET_BOUNDS])
    daily = svc(spark, sf).groupBy("service", ntz(F.date_trunc("day", "ts")).alias("eval_ts")).agg(
        *[F.count_if(F.col("value") <= b).alias(f"c{i}") for i, b in enumerate(BUCKET_BOUNDS)])
    counts = F.array(*[F.col(f"c{i}") for i in range(len(BUCKET_BOUNDS))])
    return daily.select("service", "eval_ts", F.inline(F.arrays_zip(bounds.alias("le"), counts.alias("cum"))))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """The eight features per service and hour.

    The exact percentiles keep one counter per distinct value of a group (values are cents), not its rows.
    """
    ms = F.col("value") * 10
    return svc(spark, sf).groupBy("service", floor_ts("ts", 3600).alias("timestamp")).agg(
        (F.count(F.lit(1)) / 3600.0).alias("request_rate"),
        F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("error_rate"),
        F.percentile(ms, F.lit(0.5)).alias("latency_p50"), F.percentile(ms, F.lit(0.99)).alias("latency_p99"),
        (F.lit(2.0e8) + F.sum("value") * 1.0e5).alias("jvm_heap_used"),
        (F.avg("value") / 1000).alias("jvm_gc_pause_seconds"),
        F.least(F.lit(1.0), F.count(F.lit(1)) / 20.0).alias("cpu_usage"),
        (F.lit(0.4) + F.least(F.lit(0.5), F.max("value") / 1000)).alias("memory_usage"))


# -- fixed values: reasons by order key of the cluster-event view --
K8S_REASONS = ["OOMKilled", "BackOff", "Scheduled", "Pulled", "Unhealthy", "Started"]


def k8s_events(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("id"), key.cast("string").alias("uid"), F.col("o_orderdate").alias("timestamp"),
        F.lit("kubernetes").alias("source"),
        F.concat(F.lit("pod-"), (F.col("o_custkey") % 20).cast("string")).alias("pod"),
        F.element_at(F.array(*[F.lit(r) for r in K8S_REASONS]), (key % 6 + 1).cast("int")).alias("reason"),
        F.when(F.col("o_orderstatus") == "F", "Warning").otherwise("Normal").alias("event_type"),
        F.col("o_orderpriority").alias("message"))


def parents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("child_id"))


def children(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(F.col("p_partkey") % 50 != 0).select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.col("toxic").alias("y_hat"),
        F.col("n_chars").cast("double").alias("score"))


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("true_label"),
        F.when(F.col("vec_id") % 11 == 0, -1).otherwise(((F.col("label") + F.col("vec_id") % 2) % 8).cast("int")).alias("cid"),
        "embedding")
