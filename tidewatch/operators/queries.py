"""Parameterised look-back queries over the telemetry tables.

Filters are literals, so they reach the scan and prune date partitions; sort plus limit becomes a per-task top-k.
"""
from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.constants import BOUNDS, CHART_SEVERITIES, IMPORTANT_REASONS


def check(name: str, value: int, bound: str | None = None) -> int:
    low, high = BOUNDS[bound or name]
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, got {value}")
    return value


def _since(df: DataFrame, as_of: datetime, **delta: int) -> DataFrame:
    return df.filter(F.col("timestamp") >= F.lit(as_of - timedelta(**delta)).cast("timestamp_ntz"))


def _newest(df: DataFrame, limit: int, tie: Sequence[str] = ("id",)) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), *[F.desc(c) for c in tie]).limit(limit)


def query_logs(logs: DataFrame, as_of: datetime, service: str | None = None, severity: str | None = None,
               since_minutes: int = 60, limit: int = 200) -> DataFrame:
    df = _since(logs, as_of, minutes=check("since_minutes", since_minutes))
    if service:
        df = df.filter(F.col("service") == service)
    if severity:
        df = df.filter(F.col("severity") == severity.upper())
    return _newest(df, check("limit", limit, "limit_large"))


def query_metrics(metrics: DataFrame, as_of: datetime, metric_name: str | None = None,
                  since_minutes: int = 60, limit: int = 200) -> DataFrame:
    df = _since(metrics, as_of, minutes=check("since_minutes", since_minutes))
    if metric_name:
        df = df.filter(F.col("metric_name") == metric_name)
    return _newest(df, check("limit", limit, "limit_large"))


def query_traces(traces: DataFrame, as_of: datetime, service: str | None = None, slow_only: bool = False,
                 errors_only: bool = False, since_minutes: int = 60, limit: int = 100) -> DataFrame:
    df = _since(traces, as_of, minutes=check("since_minutes", since_minutes))
    if service:
        df = df.filter(F.col("service") == service)
    if slow_only:
        df = df.filter(F.col("is_slow"))
    if errors_only:
        df = df.filter(F.col("has_error"))
    return _newest(df, check("limit", limit))


def query_events(events: DataFrame, as_of: datetime, source: str | None = None, reason: str | None = None,
                 since_minutes: int = 60, limit: int = 100) -> DataFrame:
    df = _since(events, as_of, minutes=check("since_minutes", since_minutes))
    if source:
        df = df.filter(F.col("source") == source)
    if reason:
        df = df.filter(F.col("reason") == reason)
    return _newest(df, check("limit", limit))


def list_analyses(analyses: DataFrame, limit: int = 10, tie: Sequence[str] = ("service",)) -> DataFrame:
    return _newest(analyses, check("limit", limit, "limit_analysis"), tie)


def latest_analysis(analyses: DataFrame, tie: Sequence[str] = ("service",)) -> DataFrame:
    """Newest report; no rows when nothing is stored."""
    return _newest(analyses, 1, tie)


def query_trends(records: DataFrame, as_of: datetime, query_name: str | None = None, since_hours: int = 6, limit: int = 50) -> DataFrame:
    df = _since(records, as_of, hours=check("since_hours", since_hours))
    if query_name:
        df = df.filter(F.col("query_name") == query_name)
    return _newest(df, check("limit", limit, "limit_trends"), ["query_name"])


def important_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("reason").isin(IMPORTANT_REASONS) | (F.col("event_type") == "Warning"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """First ``n`` rows of each group; the rank filter trims every task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def filter_logs_view(logs: DataFrame, severity: str = "ALL", limit: int = 200) -> DataFrame:
    if severity != "ALL":
        if severity not in CHART_SEVERITIES:
            raise ValueError(f"unknown severity {severity}")
        logs = logs.filter(F.col("severity") == severity)
    return _newest(logs, limit)
