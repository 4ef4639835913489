"""Flat export tables: one per sheet of the export."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalar import flatten_labels, service_of, truncate


def cell(name: str, chars: int | None) -> Column:
    """Text of a cell, whole unless ``chars`` limits it."""
    return (F.col(name) if chars is None else truncate(F.col(name), chars)).alias(name)


def summary(stats: DataFrame, window: str) -> DataFrame:
    """The six totals as rows with notes."""
    # -- fixed values: row names and notes --
    rows = [("Logs (total)", "total_logs", window), ("Logs (errors)", "total_errors", "Severity = ERROR"), ("Traces (total)", "total_traces", window),
            ("Traces (slow)", "slow_traces", "duration_ms > 500"), ("Traces (error)", "error_traces", "has_error = true"), ("K8s Events", "k8s_events", window)]
    return stats.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("data_type"), F.col(c).alias("count"), F.lit(note).alias("notes")) for n, c, note in rows])))


def logs(df: DataFrame, chars: int | None = None) -> DataFrame:
    return df.select("id", "timestamp", "service", "severity", cell("message", chars), "namespace",
                     flatten_labels(F.col("labels")).alias("labels"))


def metrics(df: DataFrame) -> DataFrame:
    return df.select("id", "timestamp", "metric_name", service_of(F.col("labels"), "").alias("service"), "value",
                     flatten_labels(F.col("labels")).alias("labels"))


def traces(df: DataFrame) -> DataFrame:
    mark = F.when(F.col("has_error"), "error").when(F.col("is_slow"), "slow").otherwise("none")
    return df.withColumn("highlight", mark)


def events(df: DataFrame, chars: int | None = None) -> DataFrame:
    return df.withColumn("message", cell("message", chars)).withColumn("is_warning", F.col("event_type") == "Warning")


def _first(array: str, field: str) -> Column:
    return F.coalesce(F.get(F.col(array), F.lit(0))[field], F.lit(""))


def analysis(df: DataFrame, chars: int | None = None) -> DataFrame:
    return df.select(
        "timestamp", "service", "health_status", "confidence", cell("summary", chars),
        F.array_size("anomalies").alias("anomaly_count"), _first("anomalies", "title").alias("top_anomaly"),
        _first("anomalies", "severity").alias("top_anomaly_severity"), F.array_size("root_causes").alias("root_cause_count"),
        _first("root_causes", "issue").alias("top_root_cause"), F.array_size("recommendations").alias("recommendation_count"),
        _first("recommendations", "action").alias("top_recommendation"), F.array_join("performance.bottlenecks", ", ").alias("bottlenecks"))


def anomalies(df: DataFrame, chars: int | None = None) -> DataFrame:
    rows = df.select("timestamp", "service", "health_status", F.inline("anomalies"))
    return rows.select(F.col("timestamp").alias("analysis_timestamp"), "service", "health_status", "severity", "title",
                       cell("detail", chars), F.array_join("affected_resources", ", ").alias("affected_resources"),
                       cell("evidence", chars))


def recommendations(df: DataFrame, chars: int | None = None) -> DataFrame:
    rows = df.select("timestamp", "service", F.inline("recommendations"))
    return rows.select(F.col("timestamp").alias("analysis_timestamp"), "service", "priority", cell("action", chars),
                       cell("reason", chars), cell("command", chars))


def trends(records: DataFrame) -> DataFrame:
    rows = records.select("timestamp", "query_name", "description", "range_window", "step", F.inline("analysis.series"))
    return rows.withColumn("service", service_of(F.col("labels"), "")).drop("labels")


def melt(results: DataFrame, keys: list[str]) -> DataFrame:
    """One ``(…keys, metric, value)`` row per numeric result column."""
    values = [c for c in results.columns if c not in keys]
    return results.select(*keys, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(keys, values, "metric", "value")


def split_table(errors: DataFrame, splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """Error per feature with one column per split; expects ``feature, split, abs_error``."""
    return errors.groupBy("feature").pivot("split", list(splits)).agg(F.avg("abs_error"))


def data_sample(df: DataFrame, order: list[str], n: int = 1000) -> DataFrame:
    """First ``n`` rows of a set, with its total row count beside each."""
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))      # one row
    return df.orderBy(*order).limit(n).join(F.broadcast(total))
