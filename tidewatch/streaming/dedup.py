"""Removal of re-polled telemetry, on streams (state bounded by the watermark) and on batches."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# -- fixed values: keys and poll-window lengths of the streams ----------------
DEDUP_KEYS = {"events": ["uid"], "logs": ["service", "timestamp_ns", "message"], "traces": ["trace_id"]}
WATERMARKS = {"events": "10 seconds", "logs": "15 seconds", "traces": "30 seconds"}


def dedup_stream(stream: DataFrame, kind: str, ts: str = "timestamp", watermark: str | None = None) -> DataFrame:
    """Keep the first copy within the watermark; the state forgets keys older than that."""
    return stream.withWatermark(ts, watermark or WATERMARKS[kind]).dropDuplicatesWithinWatermark(DEDUP_KEYS[kind])


def dedup_batch(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first copy of each key: a map-side-combined aggregate, so many copies of one key stay cheap."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("r"))
    return first.select(*keys, "r.*").select(*rows.columns)


def newest_per_stream(rows: DataFrame, stream: str, ts: str, tie: str, n: int) -> DataFrame:
    """Bounded stream: the newest ``n`` entries of each stream."""
    from tidewatch.operators.queries import top_per_group
    return top_per_group(rows, [stream], [F.desc(ts), F.desc(tie)], n)


def retention(rows: DataFrame, as_of, days: int = 7, column: str = "created_at") -> DataFrame:
    """Rows that survive the hourly clean-up."""
    from datetime import timedelta
    return rows.filter(F.col(column) >= F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz"))
