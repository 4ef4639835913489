"""Mixes sources to target weights by systematic sampling.

Within a source the documents are put in order of their size. Each document has the same expected number of copies, its source's target
divided by the source's size; the running sum of these, moved by one random offset, gives a document one copy for each integer that it
crosses. As neighbours in that order are of nearly equal size, the words taken differ from the target by little more than one document.

The running sum needs the rank of a document in its source. Counts per (source, size) give the ranks of whole groups, and groups are cut
into slices of a hash range, each of about ``SLICE`` rows, so that no task holds a source or a group of equal sizes.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.llm.columns import free
from tidewatch.session import broadcast_if_small, cut

#: Rows of one source and size that are ranked in one task.
SLICE = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def _draw(text: Column) -> Column:
    """First 32 bits of a digest as a long."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, size, rows): sources in code point order, null last, take the weights in turn.

    Together they get ``share`` times all sizes; none gets more than ``most`` times its own size, and what is above goes to the others by
    weight. That is the level at which the smaller of limit and weight times level adds up to the total, found in order of limit by weight.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).cast("long").alias("source_size"))
    everyone = Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_limit = everyone.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    filled = F.coalesce(F.sum("limit").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everyone) * F.lit(float(share)) - filled) / open_weight
    per = per.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(everyone)
    return per.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * shared).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0,
                also: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often the mix takes each document; ``also`` names further columns to carry.

    ``docs`` needs doc_id, text and source; other columns are ignored. A null or blank text has size 0 and takes 0 words. Null is a source of
    its own, after all others. A source of size 0 has target 0. Rows that repeat are separate documents. The draw depends on ``seed``, the
    source and the doc_ids only, so reruns agree. An empty table gives no rows.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    place = _draw(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = cut(docs.select("doc_id", "source", size.alias("size"), place.alias("place"), *[c.alias(n) for n, c in (also or {}).items()]))
    sizes = rows.groupBy("source", "size").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.select(
        F.col("source").alias("g_source"), F.col("size").alias("g_size"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"),
        F.ceil(F.col("rows") / SLICE).alias("slices"))
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "t_source")
    groups = cut(groups.join(targets, F.col("g_source").eqNullSafe(F.col("t_source"))).drop("t_source"))
    rows = rows.join(broadcast_if_small(groups), F.col("source").eqNullSafe(F.col("g_source")) & (F.col("size") == F.col("g_size")))
    rows = rows.withColumn("slice", F.shiftright(F.col("place") * F.col("slices"), 32))
    slices = rows.groupBy("source", "size", "slice").agg(F.count("*").alias("rows"))
    inside = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("source").alias("s_source"), F.col("size").alias("s_size"), F.col("slice").alias("s_slice"),
                           F.coalesce(F.sum("rows").over(inside), F.lit(0)).alias("skipped"))
    own = Window.partitionBy("source", "size", "slice").orderBy("place", "doc_id")
    rows = rows.withColumn("number", F.row_number().over(own))
    rows = rows.join(broadcast_if_small(slices), F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")) & (F.col("slice") == F.col("s_slice")))
    rank = F.col("earlier") + F.col("skipped") + F.col("number")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    offset = _draw(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))) / F.lit(float(1 << 32))
    copies = (F.floor(offset + rate * rank) - F.floor(offset + rate * (rank - 1))).cast("long")
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", *(also or {}))


def take_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each repeated as often as ``mix_sources`` takes it. Copies of rows that are equal in doc_id, source and text are
    dealt out evenly among them."""
    mark = {"mark": F.xxhash64("text")}
    same, copies, rows, times, time = free(docs, "d_same", "d_copies", "d_rows", "d_times", "d_time")
    drawn = mix_sources(docs, also=mark, **options).groupBy(F.struct("doc_id", "source", "mark").alias(same)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    # One column is the key of the join and of the window, so that texts are shuffled once.
    joined = docs.withColumn(same, F.struct("doc_id", "source", F.xxhash64("text").alias("mark"))).join(drawn.where(F.col(copies) > 0), same)
    turn = F.row_number().over(Window.partitionBy(same).orderBy(F.lit(0)))
    each = F.expr(f"`{copies}` div `{rows}`") + F.when(turn <= F.col(copies) % F.col(rows), 1).otherwise(0)
    joined = joined.withColumn(times, each).where(F.col(times) > 0)
    return joined.withColumn(time, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)
