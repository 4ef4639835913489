"""Streaming ingest: envelopes in, partitioned tables out, effectively once."""
from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch.schemas import ENVELOPE
from tidewatch.sources import envelopes as E
from tidewatch.sources.sinks import append_batch
from tidewatch.sources.tables import read_table

BATCH_FILES = 100


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str = ENVELOPE, fmt: str = "json", files_per_trigger: int = BATCH_FILES,
                glob: str | None = None) -> DataFrame:
    """Stream over the files of a folder with an explicit schema and a bounded number of files per batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(path)


def ingest_batch(batch: DataFrame, batch_id: int, kind: str, root: str, as_of: Column | None = None) -> None:
    """Handle one batch: rows to their table, malformed envelopes to quarantine. The batch is parsed once."""
    parsed = E.parse(batch, kind, as_of).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        append_batch(E.HANDLERS[kind](parsed.filter(~E.is_bad())), root, kind, batch_id)
        append_batch(E.quarantine(parsed), root, "quarantine", batch_id)
    finally:
        parsed.unpersist()


def start_ingest(stream: DataFrame, kind: str, root: str, checkpoint: str, as_of: Column | None = None,
                 available_now: bool = False, interval: str = "2 seconds") -> StreamingQuery:
    """Consumer of one stream. The checkpoint replaces acknowledgements; a replayed batch overwrites its own folder."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch_id: ingest_batch(df, batch_id, kind, root, as_of))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def start_files(df: DataFrame, path: str, checkpoint: str, available_now: bool = True, mode: str = "append") -> StreamingQuery:
    """Write a streaming frame to parquet files."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_cycle(stream: DataFrame, checkpoint: str, handler: Callable[[DataFrame, int], None], once: bool = False, interval: str = "300 seconds") -> StreamingQuery:
    """Run ``handler`` per trigger: every ``interval``, or over what is available and then stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handler)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def stored_look_back(batch: DataFrame, batch_id: int, root: str, table: str, time_column: str, start: datetime) -> DataFrame:
    """Store one batch, then all stored rows after ``start``, whichever batch brought them; only the date folders of the look-back are read."""
    append_batch(batch, root, table, batch_id, time_column)
    schema = T.StructType([*batch.schema.fields, T.StructField("date", T.DateType()), T.StructField("batch", T.LongType())])
    stored = read_table(batch.sparkSession, f"{root}/{table}", schema, start)
    return stored.filter(F.col(time_column) > F.lit(start).cast("timestamp_ntz")).select(*batch.columns)


def publish(rows: DataFrame, root: str, batch_id: int) -> None:
    """Write a result as a version of its own; readers of an earlier version are not disturbed."""
    rows.write.mode("overwrite").parquet(f"{root}/version={batch_id}")


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of a result."""
    versions = spark.read.parquet(root)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.filter(F.col("version") == newest).drop("version")


def batch_counts(batch: DataFrame, kind: str) -> DataFrame:
    """Notification of a batch: stream type, service and count."""
    return batch.groupBy("service").agg(F.count(F.lit(1)).alias("count")).select(F.lit(kind).alias("type"), "service", "count")
