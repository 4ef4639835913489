"""Enrichment, split, as-of and proximity joins, and unions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.series import micros, with_last, with_position
from tidewatch.session import broadcast_if_small


def nested_enrichment(parents: DataFrame, children: DataFrame, details: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Parents with their ordered child structs, plus the detail structs of each parent.

    ``parents``: ``id, pos, child_id`` (exploded key array); ``children``: ``id, name``; ``details``: ``parent_id, pos, …``.
    A parent with more than ``page_rows`` keys gives several rows (``page`` 0, 1, …), so no array grows without bound
    and none is cut. Unknown children stay in place with a null name and set ``has_missing_child``.
    """
    page = lambda pos: F.floor((F.col(pos) - 1) / page_rows).cast("int")
    lookup = children.select(F.col("id").alias("child_id"), F.col("name"), F.lit(True).alias("_known"))
    joined = parents.join(broadcast_if_small(lookup), "child_id", "left")
    kids = joined.groupBy("id", page("pos").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "child_id", "name"))).alias("children"),
        F.bool_or(F.col("_known").isNull()).alias("has_missing_child"))
    fields = [c for c in details.columns if c != "parent_id"]
    extra = details.groupBy(F.col("parent_id").alias("id"), page("pos").alias("page")).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("details"))
    return kids.join(extra, ["id", "page"], "full")


def in_split(rows: DataFrame, ids: DataFrame, key: str = "window_id") -> DataFrame:
    return rows.join(broadcast_if_small(ids.select(key)), key, "left_semi")


def not_in(rows: DataFrame, ids: DataFrame, key: str = "window_id") -> DataFrame:
    return rows.join(broadcast_if_small(ids.select(key)), key, "left_anti")


def label_lookup(features: DataFrame, windows: DataFrame, key: str = "window_id", label: str = "label") -> DataFrame:
    return features.join(broadcast_if_small(windows.select(key, label)), key)


def predicted_vs_actual(predictions: DataFrame, windows: DataFrame, key: str = "window_id") -> DataFrame:
    return predictions.join(windows, key)


def asof_latest(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, value: str, name: str, tie: str = "id") -> DataFrame:
    """Latest ``right.value`` per key at or before each left row (null when there is none).

    Both sides are stacked and the value carried forward per time block, so a hot key is spread over many tasks.
    """
    cols = left.columns
    stacked = left.withColumn("_side", F.lit(1)).withColumn("_val", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(*keys, ts, tie, F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_pack")).withColumn("_val", F.col("_pack.v")).drop("_pack"),
        allowMissingColumns=True)
    carried = with_last(stacked, keys, [ts, "_side", tie], ts, F.when(F.col("_side") == 0, F.struct("_val")), "_at")
    return carried.filter("_side = 1").select(*cols, F.col("_at._val").alias(name))


def near_counts(base: DataFrame, others: dict[str, DataFrame], key: str, ts: str, seconds: int) -> DataFrame:
    """For each base row: how many rows of each other stream of the same key are within ``seconds`` of it.

    A count is the difference of two running counts, up to the end of the row's range and up to just before its start. Each base row gives two
    marks; running counts are taken inside time buckets of ``seconds`` and over the totals of buckets, so the work grows with the rows, however
    dense they are. Base rows that are equal in all columns are counted once and repeated.
    """
    us, cols = seconds * 1_000_000, base.columns
    at = micros(ts)
    ends = F.array(F.struct((at + us).alias("_at"), F.lit(1).alias("_sign")), F.struct((at - us - 1).alias("_at"), F.lit(-1).alias("_sign")))
    stacked = base.select("*", F.inline(ends)).withColumn("_kind", F.lit(""))
    for name, df in others.items():
        stacked = stacked.unionByName(df.where(F.col(ts).isNotNull()).select(key, at.alias("_at"), F.lit(name).alias("_kind")), allowMissingColumns=True)
    stacked = stacked.withColumn("_bucket", F.floor(F.col("_at") / us).cast("bigint"))
    totals = stacked.groupBy(key, "_bucket").agg(*[F.count_if(F.col("_kind") == n).alias(n) for n in others])
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in others])
    inside = Window.partitionBy(key, "_bucket").orderBy("_at", F.col("_kind") == "").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = stacked.select("*", *[F.count_if(F.col("_kind") == n).over(inside).alias(f"_in_{n}") for n in others]).where(F.col("_kind") == "")
    marks = marks.join(totals, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_of")), "left")
    upto = {n: F.coalesce(F.col(f"_before_{n}") + F.col(f"_in_{n}"), F.lit(0)) for n in others}
    counted = marks.groupBy(*cols).agg(F.count_if(F.col("_sign") == 1).alias("_rows"), *[F.sum(F.col("_sign") * upto[n]).alias(n) for n in others])
    counted = counted.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    return counted.select(*cols, *[F.expr(f"`{n}` div _rows").alias(n) for n in others])


def align_services(wide: DataFrame, features: Sequence[str], block: str = "window_id", ts: str = "timestamp", services: Sequence[str] | None = None) -> DataFrame:
    """Align the series of every pair of services by position inside a block, cut to the shorter one; of ``services`` only, if they are given.

    Result: ``block, idx, s1, s2`` (s1 before s2) and ``<feature>_1, <feature>_2``. For statistics of many services use ``windows.pair_correlations``,
    which makes no row per pair and position.
    """
    rows = wide if services is None else wide.filter(F.col("service").isin(list(services)))
    placed = with_position(rows.select(block, "service", ts, *features), [block, "service"], [ts], ts)
    side = lambda k: placed.select(block, "idx", F.col("service").alias(f"s{k}"), *[F.col(f).alias(f"{f}_{k}") for f in features])
    return side(1).join(side(2), [block, "idx"]).filter("s1 < s2").select(
        block, "idx", "s1", "s2", *[f"{f}_{k}" for k in (1, 2) for f in features])


def union_frames(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_keys(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def error_then_warning_messages(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """Error messages and warnings that go to log clustering; with ``limit`` the first of them, errors before warnings, newest first."""
    rank = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARN", 1)
    rows = logs.withColumn("_r", rank).filter(F.col("_r").isNotNull() & (F.col("message") != ""))
    return (rows if limit is None else rows.orderBy("_r", F.desc("timestamp"), F.desc("id")).limit(limit)).drop("_r")
