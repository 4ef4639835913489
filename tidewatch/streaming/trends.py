"""Trends of a trailing window from stored partial sums, so that a trigger reads no sample of an earlier batch.

A batch adds one row per series and block of time: count, mean, squared deviations, least, greatest and newest value, and its values in order. The
rows of all batches merge. A day of minutes is 1440 rows per series, over which the middle of all samples falls into one block; only the values of
this block and of the one at the edge of the window are looked at again.
"""
from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewatch.functions.scalar import to_number
from tidewatch.functions.series import floor_ts
from tidewatch.operators.trends import half_trend
from tidewatch.session import broadcast_if_small
from tidewatch.sources.sinks import append_batch, drop_expired

BLOCK_SECONDS = 60


def partial_sums(samples: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value", seconds: int = BLOCK_SECONDS) -> DataFrame:
    """``keys, block, values``: the numbers of a series in a block of time, in the order of ``order`` (its first column is the time).

    Choose ``seconds`` so that a block of the busiest series is a small row; samples that are not numbers are left out."""
    number = to_number(F.col(value))
    rows = samples.select(*keys, floor_ts(order[0], seconds).alias("block"), F.struct(*[F.col(c) for c in order], number.alias("v")).alias("x")).where("x.v IS NOT NULL")
    return summed(rows.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("x")).alias("values")))


def summed(blocks: DataFrame) -> DataFrame:
    """Adds the sums of ``values``: n, mean, low, high, last (newest element), m2 (squared deviations from the mean)."""
    numbers = F.transform("values", lambda x: x["v"])
    n = F.size("values")
    mean = F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v) / n
    return blocks.withColumns({"n": n.cast("bigint"), "mean": mean, "low": F.array_min(numbers), "high": F.array_max(numbers), "last": F.element_at("values", -1)}).withColumn(
        "m2", F.aggregate(numbers, F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))))


def merged_stats(partials: DataFrame, keys: Sequence[str], order: Sequence[str], start: datetime | None = None, seconds: int = BLOCK_SECONDS) -> DataFrame:
    """The columns of ``series_stats`` over the samples after ``start``, from the partial sums of any number of batches."""
    keys, rows = list(keys), partials
    if start is not None:
        after = F.lit(start).cast("timestamp_ntz")
        edge = floor_ts(after, seconds)
        inside = F.filter("values", lambda x: x[order[0]].cast("timestamp_ntz") > after)
        inside = summed(rows.where(F.col("block") == edge).select(*keys, "block", inside.alias("values")).where(F.size("values") > 0))
        rows = rows.where(F.col("block") > edge).select(*inside.columns).unionByName(inside)
    # a block that several batches have brought
    same = Window.partitionBy(*keys, "block")
    middle = F.sum(F.col("n") * F.col("mean")).over(same) / F.sum("n").over(same)
    spread = rows.withColumn("m2", F.col("m2") + F.col("n") * F.pow(F.col("mean") - middle, 2))
    blocks = spread.groupBy(*keys, "block").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("total"), F.sum("m2").alias("m2"),
                                                F.min("low").alias("low"), F.max("high").alias("high"), F.max("last").alias("last"))
    series, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)    # a row per block
    placed = blocks.withColumns({"_all": F.sum("n").over(series), "_sum": F.sum("total").over(series), "_before": F.coalesce(F.sum("n").over(so_far), F.lit(0))})
    part = F.greatest(F.lit(0), F.least(F.col("n"), F.floor(F.col("_all") / 2) - F.col("_before"))).cast("int")
    placed = placed.withColumn("_part", part)
    halved = placed.where("_part > 0 AND _part < n").select(*keys, "block", "_part")         # one block of a series at most
    values = rows.join(broadcast_if_small(halved), [*keys, "block"]).groupBy(*keys, "_part").agg(F.array_sort(F.flatten(F.collect_list("values"))).alias("values"))
    cut = F.aggregate(F.transform(F.slice("values", F.lit(1), F.col("_part")), lambda x: x["v"]), F.lit(0.0), lambda a, v: a + v)
    off = F.col("total") / F.col("n") - F.col("_sum") / F.col("_all")
    agg = placed.groupBy(*keys).agg(
        F.sum("n").alias("data_points"), (F.sum("total") / F.sum("n")).alias("avg"), F.min("low").alias("min"), F.max("high").alias("max"), F.max("last")["v"].alias("latest"),
        F.sqrt(F.sum(F.col("m2") + F.col("n") * off * off) / F.sum("n")).alias("_sd"), F.sum("total").alias("_total"), F.sum("_part").alias("_early"),
        F.sum(F.when(F.col("_part") == F.col("n"), F.col("total")).otherwise(0.0)).alias("_whole"))
    agg = agg.join(values.select(*keys, cut.alias("_cut")), keys, "left")
    early = F.col("_whole") + F.coalesce("_cut", F.lit(0.0))
    agg = agg.withColumns({"_first": F.when(F.col("_early") > 0, early / F.col("_early")), "_second": (F.col("_total") - early) / (F.col("data_points") - F.col("_early"))})
    return half_trend(agg.drop("_total", "_early", "_whole", "_cut"))


def add_batch(batch: DataFrame, batch_id: int, root: str, keys: Sequence[str], order: Sequence[str], start: datetime, value: str = "value") -> DataFrame:
    """Stores a batch's partial sums and returns the trends after ``start`` of all batches so far. A replayed batch replaces its own rows; days that
    lie wholly before ``start`` are removed."""
    spark = batch.sparkSession
    append_batch(partial_sums(batch, keys, order, value), root, "partials", batch_id, "block")
    drop_expired(spark, root, "partials", start)
    return merged_stats(spark.read.parquet(f"{root}/partials").where(F.col("date") >= F.lit(start.date())), keys, order, start)


def keep_newest(spark: SparkSession, root: str, newest: int, kept: int = 2) -> int:
    """Removes published versions but the newest ``kept``, the last of which a reader may still hold."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs, gone = path(root).getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for status in fs.globStatus(path(f"{root}/version=*")) or []:
        if int(status.getPath().getName().split("=")[1]) <= newest - kept:
            gone += bool(fs.delete(status.getPath(), True))
    return gone
