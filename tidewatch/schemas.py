"""Schemas (as DDL) of the stream payloads and of the stored tables. Streams never infer a schema."""
from __future__ import annotations

from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


ENVELOPE = ("timestamp STRING, data STRING")

PAYLOADS = {
    "metrics": (f"source STRING, namespace STRING, metrics MAP<STRING, ARRAY<STRUCT<labels: MAP<STRING, STRING>, value: STRING>>>, {CORRUPT} STRING"),
    "logs": ("source STRING, service STRING, namespace STRING, count INT, entries ARRAY<STRUCT<service: STRING, labels: MAP<STRING, STRING>, "
                   f"timestamp_ns: STRING, severity: STRING, message: STRING>>, {CORRUPT} STRING"),
    "traces": ("source STRING, service STRING, namespace STRING, count INT, traces ARRAY<STRUCT<trace_id: STRING, service: STRING, operation: STRING, "
                     f"duration_ms: DOUBLE, is_slow: BOOLEAN, has_error: BOOLEAN>>, {CORRUPT} STRING"),
    "events": ("source STRING, namespace STRING, events ARRAY<STRUCT<pod: STRING, reason: STRING, message: STRING, type: STRING, count: INT>>, "
                     "pods ARRAY<STRUCT<name: STRING, app: STRING, phase: STRING, containers: ARRAY<STRUCT<name: STRING, ready: BOOLEAN, restarts: INT>>>>, "
                     f"{CORRUPT} STRING"),
    "tsdb_trends": ("source STRING, namespace STRING, trends MAP<STRING, STRUCT<description: STRING, range: STRING, step: STRING, series_count: INT, "
                          "analysis: STRUCT<series: ARRAY<STRUCT<labels: MAP<STRING, STRING>, data_points: BIGINT, avg: DOUBLE, min: DOUBLE, max: DOUBLE, latest: DOUBLE, "
                          "trend_pct: DOUBLE, direction: STRING, volatility_cv: DOUBLE>>>, "
                          f"raw_series: ARRAY<STRUCT<labels: MAP<STRING, STRING>, values_count: INT, first_value: STRING, last_value: STRING>>>>, {CORRUPT} STRING"),
}

TABLES = {
    "logs": ("timestamp TIMESTAMP_NTZ, event_time TIMESTAMP_NTZ, namespace STRING, service STRING, severity STRING, message STRING, labels MAP<STRING, STRING>"),
    "metrics": ("timestamp TIMESTAMP_NTZ, namespace STRING, metric_name STRING, labels MAP<STRING, STRING>, value STRING, raw_data STRING"),
    "traces": ("timestamp TIMESTAMP_NTZ, trace_id STRING, service STRING, operation STRING, duration_ms DOUBLE, is_slow BOOLEAN, has_error BOOLEAN"),
    "events": ("timestamp TIMESTAMP_NTZ, namespace STRING, source STRING, pod STRING, reason STRING, message STRING, event_type STRING, raw_data STRING"),
    "tsdb_trends": ("timestamp TIMESTAMP_NTZ, namespace STRING, query_name STRING, description STRING, range_window STRING, step STRING, series_count INT, "
                          "analysis STRUCT<series: ARRAY<STRUCT<labels: MAP<STRING, STRING>, data_points: BIGINT, avg: DOUBLE, min: DOUBLE, max: DOUBLE, latest: DOUBLE, "
                          "trend_pct: DOUBLE, direction: STRING, volatility_cv: DOUBLE>>>, "
                          "raw_series ARRAY<STRUCT<labels: MAP<STRING, STRING>, values_count: INT, first_value: STRING, last_value: STRING>>"),
    "quarantine": ("timestamp STRING, data STRING"),
}


def table_schema(table: str) -> T.StructType:
    """Schema of a table's own columns (the DDL is parsed by the running session)."""
    return T.StructType.fromDDL(TABLES[table])


def stored(table: str) -> T.StructType:
    """Schema of a stored table with its partition columns."""
    return table_schema(table).add("batch", "long").add("date", "date")
