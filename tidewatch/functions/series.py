"""Positions and neighbours in long ordered series, without one task per series.

A telemetry table has few series (three services), so ``partitionBy(service)`` would put a third of all
rows into one task. Here a series is cut into time blocks: windows run inside ``(series, block)``, and only
one small row per block (its count, or its last row) is carried across blocks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import block_seconds


def micros(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def from_micros(c: Column) -> Column:
    return ntz(F.timestamp_micros(c.cast("bigint")))


def floor_ts(ts: str | Column, seconds: int) -> Column:
    """Start of the fixed-width bucket that holds ``ts``."""
    width = seconds * 1_000_000
    return from_micros(micros(ts) - F.pmod(micros(ts), F.lit(width)))


def ceil_ts(ts: str | Column, seconds: int) -> Column:
    """End of the bucket ``(end - width, end]`` that holds ``ts``."""
    width = seconds * 1_000_000
    return from_micros(micros(ts) + F.pmod(-micros(ts), F.lit(width)))


def block_of(df: DataFrame, ts: str, seconds: int | None = None) -> Column:
    width = (seconds or block_seconds(df.sparkSession)) * 1_000_000
    return F.floor(micros(ts) / F.lit(width)).cast("bigint")


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str | None,
    pos: str = "idx", total: str | None = None, seconds: int | None = None, block: Column | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its series (and, if asked, the series length).

    ``order[0]`` must be the time column ``ts``; further order columns break ties. Where the order is not by time,
    pass ``block``: any integer column that never decreases along the order.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", block_of(df, ts, seconds) if block is None else block)
    sizes = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    local = Window.partitionBy(*keys, "_block").orderBy(*order)
    out = blocked.withColumn("_rn", F.row_number().over(local)).join(offsets, [*keys, "_block"])
    out = out.withColumn(pos, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col("_total").cast("bigint"))
    return out.drop("_block", "_rn", "_off", "_total", "_n")


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, value: str,
    name: str = "prev", seconds: int | None = None,
) -> DataFrame:
    """Add the value of the preceding row of the series (null for the first row)."""
    keys = list(keys)
    blocked = df.withColumn("_block", block_of(df, ts, seconds))
    tails = blocked.groupBy(*keys, "_block").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*[F.col(c) for c in order])).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy("_block")
    carried = tails.select(*keys, "_block", F.lag("_tail").over(before).alias("_carry"))
    local = Window.partitionBy(*keys, "_block").orderBy(*order)
    out = (
        blocked.withColumn("_rn", F.row_number().over(local)).withColumn("_lag", F.lag(value).over(local))
        .join(carried, [*keys, "_block"])
    )
    return out.withColumn(name, F.when(F.col("_rn") == 1, F.col("_carry.v")).otherwise(F.col("_lag"))).drop(
        "_block", "_rn", "_lag", "_carry")


def row_frames(
    df: DataFrame, keys: Sequence[str], idx: str, rows_before: int, rows_after: int, chunk: int = 4096,
) -> tuple[DataFrame, Window, str]:
    """Prepare a positional frame ``rowsBetween(-rows_before, rows_after)`` on an indexed long series.

    Each series is cut into chunks of ``chunk`` positions; rows near an edge are copied to the neighbour
    chunk as a halo. Returns the frame input, the window to use, and the flag column that marks original
    rows: filter on it after the window expressions are computed.
    """
    if max(rows_before, rows_after) > chunk:
        raise ValueError("chunk must cover the frame")
    here = F.floor(F.col(idx) / chunk).cast("bigint")
    low = F.floor((F.col(idx) - rows_after) / chunk).cast("bigint")
    high = F.floor((F.col(idx) + rows_before) / chunk).cast("bigint")
    halo = (
        df.withColumn("_home", here)
        .withColumn("_chunk", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
        .withColumn("_own", F.col("_chunk") == F.col("_home")).drop("_home")
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy(idx).rowsBetween(-rows_before, rows_after)
    return halo, w, "_own"


def with_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, value: str | Column, name: str, seconds: int | None = None,
) -> DataFrame:
    """Add the last non-null ``value`` of the series up to and including each row."""
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    blocked = df.withColumn("_v", v).withColumn("_block", block_of(df, ts, seconds))
    at = F.struct(*[F.col(c) for c in order])
    tails = blocked.filter(F.col("_v").isNotNull()).groupBy(*keys, "_block").agg(F.max_by("_v", at).alias("_tail"))
    blocks = blocked.select(*keys, "_block").distinct().join(tails, [*keys, "_block"], "left")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    local = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = blocked.withColumn("_here", F.last("_v", ignorenulls=True).over(local)).join(carried, [*keys, "_block"])
    return out.withColumn(name, F.coalesce("_here", "_carry")).drop("_v", "_block", "_here", "_carry")
