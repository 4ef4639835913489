"""Reads of stored telemetry: range reads, training sets and look-back pulls."""
from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewatch.operators.queries import query_logs
from tidewatch.operators.timeseries import Matcher, label_match, on_grid


def read_table(spark: SparkSession, path: str, schema: T.StructType, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Stored table, pruned to the date partitions of ``[start, end]``."""
    df = spark.read.schema(schema).parquet(path)
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start.date()))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end.date()))
    return df


def range_read(samples: DataFrame, keys: Sequence[str], start: datetime, end: datetime, step: int, matchers: Sequence[Matcher] = ()) -> DataFrame:
    """Series of the matching samples on the grid of ``step`` seconds over ``[start, end]``: the last sample of each step."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    rows = label_match(samples.filter((F.col("ts") > at(start - timedelta(seconds=step))) & (F.col("ts") <= at(end))), matchers)
    span = int((end - start).total_seconds())
    return on_grid(rows, keys, end, step, step, span).select(*keys, "eval_ts", F.col("last").alias("value"))


def training_set(spark: SparkSession, path: str, schema: T.StructType, build) -> DataFrame:
    """Read a training set, or build, write and read it when the folder has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):
        build().write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def log_pull(logs: DataFrame, as_of: datetime, since_minutes: int = 1440, limit: int | None = None) -> DataFrame:
    """Training input: the logs of a look-back window, all of them unless ``limit`` asks for the newest."""
    if limit is not None:
        return query_logs(logs, as_of, since_minutes=since_minutes, limit=limit)
    return logs.filter(F.col("timestamp") >= F.lit(as_of - timedelta(minutes=since_minutes)).cast("timestamp_ntz"))
