"""Trend statistics over series, and the summaries built from stored trend records."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.scalar import fixed, pretty_query, short_service, to_number
from tidewatch.functions.series import with_position


def direction(trend_pct: Column) -> Column:
    return F.when(trend_pct > 5, "increasing").when(trend_pct < -5, "decreasing").otherwise("stable")


def series_stats(samples: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, value: str = "value") -> DataFrame:
    """Statistics, half-split trend, volatility and direction of each series.

    Samples that are not numbers are skipped; a series without numbers disappears. Values are not rounded.
    """
    numeric = samples.select(*keys, *order, to_number(F.col(value)).alias("_v")).filter(F.col("_v").isNotNull())
    placed = with_position(numeric, keys, order, ts, total="_len")
    half = F.floor(F.col("_len") / 2)
    agg = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("data_points"), F.avg("_v").alias("avg"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.max_by("_v", "idx").alias("latest"), F.stddev_pop("_v").alias("_sd"),
        F.avg(F.when(F.col("idx") < half, F.col("_v"))).alias("_first"),
        F.avg(F.when(F.col("idx") >= half, F.col("_v"))).alias("_second"))
    return half_trend(agg)


def half_trend(agg: DataFrame) -> DataFrame:
    """Trend, volatility and direction from the averages of both halves ``_first`` and ``_second`` and the deviation ``_sd``."""
    pct = F.when((F.col("data_points") >= 2) & (F.col("_first") != 0),
                 (F.col("_second") - F.col("_first")) / F.col("_first") * 100).otherwise(F.lit(0.0))
    cv = F.when(F.col("avg") != 0, F.col("_sd") / F.abs("avg") * 100).otherwise(F.lit(0.0))
    return agg.withColumn("trend_pct", pct).withColumn("volatility_cv", cv).withColumn(
        "direction", direction(F.col("trend_pct"))).drop("_sd", "_first", "_second")


def rounded(stats: DataFrame) -> DataFrame:
    """The rounding used in stored trend records."""
    four, two = ["avg", "min", "max", "latest"], ["trend_pct", "volatility_cv"]
    return stats.withColumns({**{c: fixed(c, 4) for c in four}, **{c: fixed(c, 2) for c in two}})


def raw_snapshot(samples: DataFrame, record: Sequence[str], series: str, order: Sequence[str], value: str = "value", most: int | None = None) -> DataFrame:
    """First value, last value and sample count of each series; with ``most`` only so many series of a record, by name."""
    at = F.struct(*[F.col(c) for c in order])
    snap = samples.groupBy(*record, series).agg(
        F.count(F.lit(1)).alias("values_count"), F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"))
    if most is None:
        return snap
    rank = F.row_number().over(Window.partitionBy(*record).orderBy(series))
    return snap.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


SERIES_FIELDS = ["data_points", "avg", "min", "max", "latest", "trend_pct", "direction", "volatility_cv"]


def trend_records(stats: DataFrame, description: Column, range_window: str, step: str) -> DataFrame:
    """Stored form: one row per ``(timestamp, query_name)`` with all its series as an array, by service."""
    one = F.struct(F.create_map(F.lit("service_name"), F.col("service")).alias("labels"), *SERIES_FIELDS)
    placed = F.collect_list(F.struct("service", one.alias("s")))
    by_service = lambda a, b: F.when(a["service"] < b["service"], -1).when(a["service"] > b["service"], 1).otherwise(0)
    grouped = stats.groupBy("timestamp", "query_name").agg(
        F.transform(F.array_sort(placed, by_service), lambda x: x["s"]).alias("series"), F.count(F.lit(1)).cast("int").alias("series_count"))
    return grouped.select(
        "timestamp", "query_name", description.alias("description"), F.lit(range_window).alias("range_window"),
        F.lit(step).alias("step"), "series_count", F.struct("series").alias("analysis"))


def latest_per_query(records: DataFrame) -> DataFrame:
    """Newest record of each query, as an aggregate (map-side combine) rather than a window."""
    row = F.struct(*[F.col(c) for c in records.columns])
    newest = records.groupBy("query_name").agg(F.max_by(row, "timestamp").alias("r"))
    return newest.select("r.*")


def exploded(records: DataFrame) -> DataFrame:
    return records.select("timestamp", "query_name", "description", "range_window", "step", "series_count",
                          F.inline("analysis.series"))


def trend_class() -> Column:
    return (F.when((F.col("direction") == "increasing") & (F.col("trend_pct") > 10), "degrading")
            .when(F.col("direction") == "decreasing", "improving").otherwise("stable"))


def trend_summary(records: DataFrame) -> DataFrame:
    """Every series of the newest record of each query, classed degrading, improving or stable."""
    return exploded(latest_per_query(records)).select(
        trend_class().alias("class"), F.col("query_name").alias("query"), "description", F.col("range_window").alias("range"),
        "labels", "latest", "avg", "trend_pct", "direction", "volatility_cv")


def summary_counts(summary: DataFrame) -> DataFrame:
    return summary.agg(
        *[F.count_if(F.col("class") == c).alias(c) for c in ("degrading", "stable", "improving")],
        F.count(F.lit(1)).alias("total_series"))


def history_pivot(records: DataFrame, query_name: str, services: Sequence[str] | None = None) -> DataFrame:
    """History of one query: a row per time, a column per service (every service there is, unless ``services`` names some), latest value with
    three decimals."""
    rows = exploded(records.filter(F.col("query_name") == query_name)).select(
        "timestamp", F.coalesce(F.col("labels")["service_name"], F.col("labels")["job"], F.lit("unknown")).alias("service"),
        fixed("latest", 3).alias("latest"))
    return rows.groupBy("timestamp").pivot("service", None if services is None else list(services)).agg(F.first("latest"))


def current_values(records: DataFrame) -> DataFrame:
    svc = F.coalesce(F.col("labels")["service_name"], F.col("labels")["job"], F.lit("?"))
    return exploded(latest_per_query(records)).select(
        pretty_query(F.col("query_name")).alias("metric"), short_service(svc).alias("service"),
        "latest", "avg", "trend_pct", "direction")


def mean_latest(records: DataFrame) -> DataFrame:
    return exploded(records).groupBy("query_name").agg(F.avg("latest").alias("latest"))
