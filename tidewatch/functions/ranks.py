"""Global order statistics without a single-task window.

Equal values are first counted (map-side combine makes one row per distinct value), the distinct values are
cut into equi-depth buckets, and only the bucket totals (at most ``buckets`` rows) are prefix-summed globally.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKETS = 256


def value_counts(df: DataFrame, value: str, **sums: Column) -> DataFrame:
    """One row per distinct value with its count ``n`` and optional extra sums."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])


def with_cumulative(counted: DataFrame, measures: Sequence[str] = ("n",), buckets: int = BUCKETS) -> DataFrame:
    """Add ``<m>_before``: the sum of measure ``m`` over all smaller values, for one row per value ``v``."""
    inner = sorted(set(counted.approxQuantile("v", [i / buckets for i in range(1, buckets)], 0.001))) or [0.0]      # none where no row has a value
    spread = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="v", outputCol="_b", handleInvalid="keep").transform(counted)
    totals = spread.groupBy("_b").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # at most `buckets` rows: the only window here without a partition key
    offsets = totals.select("_b", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures])
    local = Window.partitionBy("_b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return spread.join(F.broadcast(offsets), "_b").select(
        *counted.columns,
        *[(F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(local), F.lit(0))).alias(f"{m}_before") for m in measures])


def exact_percentiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """Exact percentiles (linear interpolation) of one column: a single row ``p0, p1, …``."""
    ranked = with_cumulative(value_counts(df, value))
    total = F.sum("n").alias("_total")
    size = ranked.agg(total)
    picks = ranked.join(F.broadcast(size))          # one-row side
    exprs = []
    for i, p in enumerate(probs):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(pos), F.ceil(pos)
        inside = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
        exprs += [
            F.max(F.when(inside(low), F.col("v"))).alias(f"_lo{i}"),
            F.max(F.when(inside(high), F.col("v"))).alias(f"_hi{i}"),
            F.max(pos - low).alias(f"_w{i}"),
        ]
    row = picks.agg(*exprs)
    return row.select(*[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(f"p{i}")
        for i in range(len(probs))])
