"""Sinks: partitioned table appends, training sets, result files and export folders."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.schemas import stored


def append_batch(rows: DataFrame, root: str, table: str, batch: int, time_column: str = "timestamp") -> None:
    """Write one batch of a table, by date and then batch, so that reads prune dates. A replay overwrites the folders of its batch.

    Quarantined rows go by the day that their time text starts with, 1970-01-01 where it names none."""
    if table == "quarantine":
        day = F.expr("coalesce(try_cast(substr(timestamp, 1, 10) AS date), date'1970-01-01')")
    else:
        day = F.to_date(time_column)
    dated = rows.withColumn("date", day).withColumn("batch", F.lit(batch).cast("bigint"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(f"{root}/{table}")


def read_stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(stored(table)).option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")


def drop_expired(spark: SparkSession, root: str, table: str, cutoff) -> int:
    """Physical retention: delete the date folders that are wholly before ``cutoff``; data files are not rewritten."""
    jvm = spark._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    base = fs_path(f"{root}/{table}")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = 0
    for status in fs.globStatus(fs_path(f"{root}/{table}/date=*")) or []:
        day = status.getPath().getName().split("=", 1)[1]
        if day < cutoff.date().isoformat():
            fs.delete(status.getPath(), True)
            dropped += 1
    return dropped


def write_training(frames: Mapping[str, DataFrame], root: str) -> None:
    """Windows, features and logs as parquet, partitioned by service."""
    for name, df in frames.items():
        df.write.mode("overwrite").partitionBy("service").parquet(f"{root}/{name}")


def write_results(results: DataFrame, root: str) -> None:
    """Results as JSON lines plus a CSV summary."""
    results.write.mode("overwrite").json(f"{root}/json")
    results.write.mode("overwrite").option("header", True).csv(f"{root}/csv")


def export_tables(frames: Mapping[str, DataFrame], root: str, fmt: str = "csv") -> dict[str, str]:
    """One folder per export sheet. Nested columns must be flattened before."""
    out = {}
    for name, df in frames.items():
        path = f"{root}/{name}"
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
        out[name] = path
    return out


