"""Unnesting of stream envelopes ``(timestamp, data)`` into table rows.

Every parser is a chain of projections, so it runs unchanged on batch and streaming frames. All entries of a message and whole texts are kept.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.scalar import from_epoch_ns, parse_iso
from tidewatch.schemas import CORRUPT, PAYLOADS, table_schema


def parse(envelopes: DataFrame, kind: str, as_of: Column | None = None) -> DataFrame:
    """Add the payload struct ``p`` and the parsed ingest time ``at`` (``as_of`` where the text is unusable)."""
    now = F.current_timestamp() if as_of is None else as_of
    payload = F.from_json("data", PAYLOADS[kind], {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"})
    return envelopes.select("timestamp", "data", payload.alias("p"), parse_iso(F.col("timestamp"), now).alias("at"))


def is_bad() -> Column:
    return F.col("p").isNull() | F.col(f"p.{CORRUPT}").isNotNull()


def quarantine(parsed: DataFrame) -> DataFrame:
    """Envelopes whose data is not valid JSON."""
    return parsed.filter(is_bad()).select("timestamp", "data")


def text(c: str, default: str = "") -> Column:
    return F.coalesce(F.col(c), F.lit(default))


def _shape(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table_schema(table).fields])


def metric_rows(parsed: DataFrame) -> DataFrame:
    names = parsed.select("at", text("p.namespace").alias("namespace"), F.explode("p.metrics").alias("metric_name", "results"))
    rows = names.select("*", F.explode("results").alias("r"))
    return _shape(rows.select(
        F.col("at").alias("timestamp"), "namespace", "metric_name", F.coalesce("r.labels", F.create_map().cast("map<string,string>")).alias("labels"),
        F.col("r.value").alias("value"), F.to_json("r").alias("raw_data")), "metrics")


def log_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("at", text("p.namespace").alias("namespace"), F.inline("p.entries"))
    return _shape(rows.select(
        F.col("at").alias("timestamp"), from_epoch_ns(F.col("timestamp_ns")).alias("event_time"), "namespace", text("service").alias("service"),
        text("severity", "INFO").alias("severity"), text("message").alias("message"),
        F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels")), "logs")


def trace_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("at", F.inline("p.traces"))
    return _shape(rows.select(
        F.col("at").alias("timestamp"), text("trace_id").alias("trace_id"), text("service").alias("service"), text("operation").alias("operation"),
        F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"), F.coalesce("is_slow", F.lit(False)).alias("is_slow"),
        F.coalesce("has_error", F.lit(False)).alias("has_error")), "traces")


def cluster_event_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.filter(F.col("p.source") == "kubernetes").select(
        "at", text("p.namespace").alias("namespace"), F.col("p.source").alias("source"), F.explode("p.events").alias("e"))
    return _shape(rows.select(
        F.col("at").alias("timestamp"), "namespace", "source", text("e.pod").alias("pod"), text("e.reason").alias("reason"), text("e.message").alias("message"),
        text("e.type", "Normal").alias("event_type"), F.to_json("e").alias("raw_data")), "events")


def pod_status_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.filter(F.col("p.source") == "k8s_pod_status").select(
        "at", text("p.namespace").alias("namespace"), F.col("p.source").alias("source"), F.explode("p.pods").alias("e"))
    return _shape(rows.select(
        F.col("at").alias("timestamp"), "namespace", "source", text("e.name").alias("pod"), F.lit("PodStatus").alias("reason"), text("e.phase").alias("message"),
        F.lit(None).cast("string").alias("event_type"), F.to_json("e").alias("raw_data")), "events")


def event_rows(parsed: DataFrame) -> DataFrame:
    return cluster_event_rows(parsed).unionByName(pod_status_rows(parsed))


def trend_rows(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("at", text("p.namespace").alias("namespace"), F.explode("p.trends").alias("query_name", "t"))
    return _shape(rows.select(
        F.col("at").alias("timestamp"), "namespace", "query_name", text("t.description").alias("description"), text("t.range").alias("range_window"),
        text("t.step").alias("step"), F.coalesce("t.series_count", F.lit(0)).alias("series_count"), F.col("t.analysis").alias("analysis"),
        F.col("t.raw_series").alias("raw_series")), "tsdb_trends")


# handler per stream: stream kind -> rows of its table
HANDLERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "metrics": metric_rows, "logs": log_rows, "traces": trace_rows, "events": event_rows, "tsdb_trends": trend_rows,
}
