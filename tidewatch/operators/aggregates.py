"""Dashboard totals, charts and distributions. Every aggregate is partial before its shuffle."""
from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch.constants import ANOMALY_SEVERITIES, CHART_SEVERITIES, DURATION_BUCKETS, HEALTH_ORDER, PRIORITIES
from tidewatch.functions.ranks import exact_percentiles
from tidewatch.functions.scalar import service_of, short_service, to_number


def _since(as_of: datetime, hours: int) -> Column:
    return F.col("timestamp") >= F.lit(as_of - timedelta(hours=hours)).cast("timestamp_ntz")


def stats_row(logs: DataFrame, traces: DataFrame, events: DataFrame, as_of: datetime, events_as_of: datetime | None = None,
              hours: int = 1) -> DataFrame:
    """The six totals in one aggregate: each table is scanned once and projected to its flags."""
    flags = ["total_logs", "total_errors", "total_traces", "slow_traces", "error_traces", "k8s_events"]

    def marks(df: DataFrame, **cols: Column) -> DataFrame:
        return df.select(*[cols.get(f, F.lit(False)).alias(f) for f in flags])

    one = F.lit(True)
    rows = (
        marks(logs.filter(_since(as_of, hours)), total_logs=one, total_errors=F.col("severity") == "ERROR")
        .unionByName(marks(traces.filter(_since(as_of, hours)), total_traces=one, slow_traces=F.col("is_slow"), error_traces=F.col("has_error")))
        .unionByName(marks(events.filter(_since(events_as_of or as_of, hours) & (F.col("source") == "kubernetes")), k8s_events=one))
    )
    return rows.agg(*[F.count_if(f).alias(f) for f in flags])


def errors_by_service(logs: DataFrame, as_of: datetime, hours: int = 1, most: int | None = None) -> DataFrame:
    """Errors of each service; with ``most`` only the services that have most."""
    counts = logs.filter(_since(as_of, hours) & (F.col("severity") == "ERROR")).groupBy("service").agg(F.count(F.lit(1)).alias("cnt"))
    return counts if most is None else counts.orderBy(F.desc("cnt"), "service").limit(most)


def latency_by_service(traces: DataFrame, as_of: datetime, hours: int = 1) -> DataFrame:
    return traces.filter(_since(as_of, hours)).groupBy("service").agg(
        F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"))


def severity_counts(logs: DataFrame) -> DataFrame:
    """The four chart severities, zero-filled: one aggregate row turned into four."""
    row = logs.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in CHART_SEVERITIES])
    return row.select(F.inline(F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).alias("value")) for s in CHART_SEVERITIES])))


def duration_histogram(traces: DataFrame) -> DataFrame:
    d = F.coalesce(F.col("duration_ms"), F.lit(0.0))
    row = traces.agg(*[F.count_if((d >= lo) & (d < hi)).alias(f"b{i}") for i, (_, lo, hi) in enumerate(DURATION_BUCKETS)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(f"b{i}").alias("count")) for i, (name, _, _) in enumerate(DURATION_BUCKETS)])))


def metrics_by_service(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy(short_service(service_of(F.col("labels"), "other")).alias("name")).agg(F.count(F.lit(1)).alias("count"))


def anomaly_severities(analyses: DataFrame) -> DataFrame:
    sev = analyses.select(F.explode("anomalies.severity").alias("severity")).filter(F.col("severity").isin(ANOMALY_SEVERITIES))
    return sev.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def recommendation_priorities(analyses: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in PRIORITIES for x in kv])
    pri = analyses.select(F.explode("recommendations.priority").alias("p")).select(
        F.try_element_at(names, F.col("p")).alias("priority")).filter(F.col("priority").isNotNull())
    return pri.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def analysis_series(analyses: DataFrame) -> DataFrame:
    return analyses.select(
        "timestamp", "service", F.round(F.coalesce(F.col("confidence"), F.lit(0.0)) * 100, 1).alias("confidence"),
        F.coalesce(F.array_size("anomalies"), F.lit(0)).alias("anomalies"), F.coalesce(F.array_size("root_causes"), F.lit(0)).alias("roots"),
    ).orderBy("timestamp", "service")


def health_timeline(analyses: DataFrame) -> DataFrame:
    status = F.coalesce(F.nullif("health_status", F.lit("")), F.lit("UNKNOWN"))
    order = F.array(*[F.lit(s) for s in HEALTH_ORDER])
    # array_position is 1-based and 0 when absent, i.e. one more than a 0-based index
    value = (F.lit(5) - F.array_position(order, status)).cast("int")
    return analyses.select("timestamp", "service", status.alias("status"), value.alias("value")).orderBy("timestamp", "service")


def ingest_counts(logs: DataFrame, metrics: DataFrame, traces: DataFrame) -> DataFrame:
    kinds = (
        logs.select(F.lit("l").alias("k"), (F.col("severity") == "ERROR").alias("flag"))
        .unionAll(metrics.select(F.lit("m"), F.lit(False))).unionAll(traces.select(F.lit("t"), F.col("is_slow")))
    )
    k = F.col("k")
    return kinds.agg(
        F.count_if(k == "l").alias("total_logs"), F.count_if(k == "m").alias("total_metrics"), F.count_if(k == "t").alias("total_traces"),
        F.count_if((k == "t") & F.col("flag")).alias("slow_count"), F.count_if((k == "l") & F.col("flag")).alias("error_count"))


def metric_rollup(metrics: DataFrame, newest: int | None = None, names: int | None = None) -> DataFrame:
    """Count and latest value by name; with ``newest`` among so many newest samples, with ``names`` for the names seen last."""
    top = metrics if newest is None else metrics.orderBy(F.desc("timestamp"), F.desc("id")).limit(newest)
    at = F.struct("timestamp", "id")
    rolled = top.groupBy("metric_name").agg(F.count(F.lit(1)).alias("samples"), F.max_by("value", at).alias("latest"), F.max(at).alias("_at"))
    return (rolled if names is None else rolled.orderBy(F.desc("_at")).limit(names)).drop("_at")


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def measurement_summary(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, p95, p99, population deviation, extremes and count of one column, exactly and without a hot task."""
    numbers = df.select(to_number(F.col(column)).alias("_x")).filter(F.col("_x").isNotNull())
    simple = numbers.agg(F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.min("_x").alias("min"),
                         F.max("_x").alias("max"), F.count("_x").alias("n_runs"))
    pct = exact_percentiles(numbers, "_x", [0.5, 0.95, 0.99]).toDF("median", "p95", "p99")
    return simple.join(pct)      # one row each


def mode_label(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Most frequent label of a group, ties to the smallest: two map-side-combined aggregates, no window."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).alias(label))
