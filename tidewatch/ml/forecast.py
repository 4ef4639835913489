"""Direct multi-step ridge forecast with an ensemble of leave-one-fold-out members.

The normal equations are sums over rows, so tasks emit fixed-size Gram matrices per fold; only those reach the driver.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.constants import CAPACITY_THRESHOLDS, FEATURES, FORECAST_MEMBERS, HORIZON, WINDOW_ROWS
from tidewatch.operators.windows import Scaler
from tidewatch.session import cut


@dataclass
class RidgeForecaster:
    scaler: Scaler
    past: int = WINDOW_ROWS
    horizon: int = HORIZON
    members: int = FORECAST_MEMBERS
    alpha: float = 1.0
    weights: np.ndarray | None = None      # (members, 1 + past * features, horizon * features)

    def fit(self, pairs: DataFrame, ident: Sequence[str] = ("service", "timestamp")) -> "RidgeForecaster":
        """``pairs``: arrays ``x`` (past) and ``y`` (future) of scaled rows."""
        k = len(self.scaler.columns)
        p, q, m = 1 + self.past * k, self.horizon * k, self.members
        fold = F.pmod(F.xxhash64(*ident), F.lit(m)).cast("int")

        def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                if not len(b):
                    continue
                x = np.hstack([np.ones((len(b), 1)), np.stack(b.x.values)])
                xy = np.hstack([x, np.stack(b.y.values)])
                for f in np.unique(b.fold.values):
                    rows = b.fold.values == f
                    part = x[rows].T @ xy[rows]
                    sums[int(f)] = sums[int(f)] + part if int(f) in sums else part
            for f, g in sums.items():
                yield pd.DataFrame({"fold": [f], "g": [g.tobytes()]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros((p, p + q))
            for g in pdf.g:
                total += np.frombuffer(g).reshape(p, p + q)
            return pd.DataFrame({"fold": [int(pdf.fold.iloc[0])], "g": [total.tobytes()]})

        flat = pairs.select(F.flatten("x").alias("x"), F.flatten("y").alias("y"), fold.alias("fold"))
        partial = flat.mapInPandas(gram, "fold int, g binary").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
        # tree sum: at most 1/64 of the tasks' matrices in a first group, 64 in a second
        folds = partial.groupBy("fold", "part").applyInPandas(lambda d: add(d), "fold int, g binary").groupBy("fold").applyInPandas(lambda d: add(d), "fold int, g binary")
        folds = cut(folds)
        total = np.zeros((p, p + q))
        for row in folds.toLocalIterator():         # one fixed-size matrix per fold
            total += np.frombuffer(row["g"]).reshape(p, p + q)
        shared = flat.sparkSession.sparkContext.broadcast(total)
        penalty = np.full(p, self.alpha)
        penalty[0] = 0.0

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for fold_id, g in zip(b.fold, b.g):
                    mine = shared.value - (np.frombuffer(g).reshape(p, p + q) if g is not None else 0.0)
                    w = np.linalg.solve(mine[:, :p] + np.diag(penalty), mine[:, p:])
                    yield pd.DataFrame({"fold": [fold_id], "w": [w.tobytes()]})

        members = flat.sparkSession.range(0, m, 1, min(m, 8)).select(F.col("id").cast("int").alias("fold")).join(folds, "fold", "left")
        solved = {r["fold"]: np.frombuffer(r["w"]).reshape(p, q) for r in members.mapInPandas(solve, "fold int, w binary").toLocalIterator()}
        self.weights = np.stack([solved[f] for f in range(m)])
        return self

    def predict(self, latest: DataFrame, keys: Sequence[str], rows: str = "rows") -> DataFrame:
        """Long forecast ``keys, feature, step, mean, std, lower, upper, member_values`` for arrays of the last ``past`` scaled rows."""
        k, cols = len(self.scaler.columns), self.scaler.columns
        center, scale = np.array(self.scaler.mean), np.array(self.scaler.scale)
        model = latest.sparkSession.sparkContext.broadcast(self.weights)
        horizon = self.horizon

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x = np.hstack([np.ones((len(b), 1)), np.stack(b.x.values)])
                out = np.einsum("np,mpq->nmq", x, model.value).reshape(len(b), -1, horizon, k) * scale + center
                yield b[list(keys)].assign(members=[o.ravel().tolist() for o in out])

        schema = ", ".join(f"{c} {latest.schema[c].dataType.simpleString()}" for c in keys) + ", members array<double>"
        wide = latest.select(*keys, F.flatten(rows).alias("x")).mapInPandas(run, schema)
        m = self.weights.shape[0]
        cell = F.explode(F.sequence(F.lit(0), F.lit(horizon * k - 1)))
        long = wide.select(*keys, "members", cell.alias("c")).select(
            *keys, F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("c") % k + 1).alias("feature"), (F.floor(F.col("c") / k) + 1).cast("int").alias("step"),
            F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.element_at("members", i * (horizon * k) + F.col("c") + 1)).alias("member_values"))
        mean = F.aggregate("member_values", F.lit(0.0), lambda a, v: a + v) / m
        var = F.aggregate("member_values", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))) / m
        return long.withColumn("mean", mean).withColumn("std", F.sqrt(var)).withColumn("lower", F.col("mean") - 1.96 * F.col("std")).withColumn(
            "upper", F.col("mean") + 1.96 * F.col("std"))

    def save(self, spark: SparkSession, path: str) -> None:
        s = self.scaler
        meta = (s.columns, s.mean, s.scale, self.past, self.horizon, self.members, self.alpha)
        spark.createDataFrame([meta], "columns array<string>, center array<double>, scale array<double>, past int, horizon int, members int, alpha double").write.mode("overwrite").parquet(f"{path}/meta")
        rows = [(i, w.ravel().tolist()) for i, w in enumerate(self.weights)]
        spark.createDataFrame(rows, "member int, w array<double>").write.mode("overwrite").parquet(f"{path}/weights")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RidgeForecaster":
        m = spark.read.parquet(f"{path}/meta").first()
        out = cls(Scaler(list(m["columns"]), list(m["center"]), list(m["scale"])), m["past"], m["horizon"], m["members"], m["alpha"])
        k = len(out.scaler.columns)
        out.weights = np.stack([np.array(r["w"]).reshape(1 + out.past * k, out.horizon * k) for r in spark.read.parquet(f"{path}/weights").orderBy("member").collect()])
        return out


def interval(members: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, deviation and 95 % interval of a member table (one row per member)."""
    return members.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).withColumn(
        "lower", F.col("mean") - 1.96 * F.col("std")).withColumn("upper", F.col("mean") + 1.96 * F.col("std"))


def breach_alerts(members: DataFrame, keys: Sequence[str], thresholds: dict[str, float] = CAPACITY_THRESHOLDS, metric: str = "feature", step: str = "step", value: str = "value") -> DataFrame:
    """First step whose mean is over the metric's threshold, with the share of members over it."""
    limits = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in (kv[0], float(kv[1]))])
    lim = F.try_element_at(limits, F.col(metric))
    steps = members.withColumn("threshold", lim).filter(F.col("threshold").isNotNull()).groupBy(*keys, metric, step, "threshold").agg(
        F.avg(value).alias("mean"), F.avg((F.col(value) > F.col("threshold")).cast("double")).alias("share"))
    over = steps.filter(F.col("mean") > F.col("threshold"))
    first = over.groupBy(*keys, metric).agg(F.min_by(F.struct(F.col(step).alias("step"), F.col("mean").alias("predicted_value"), "threshold", F.col("share").alias("confidence")), step).alias("a"))
    return first.select(*keys, F.col(metric).alias("metric"), "a.step", F.round("a.predicted_value", 4).alias("predicted_value"), "a.threshold", F.round("a.confidence", 2).alias("confidence"))


def alerts_of(forecast: DataFrame, keys: Sequence[str], thresholds: dict[str, float] = CAPACITY_THRESHOLDS) -> DataFrame:
    """The same from the long forecast of ``RidgeForecaster.predict``."""
    limits = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in (kv[0], float(kv[1]))])
    rows = forecast.withColumn("threshold", F.try_element_at(limits, F.col("feature"))).filter(F.col("mean") > F.col("threshold"))
    share = F.size(F.filter("member_values", lambda v: v > F.col("threshold"))) / F.size("member_values")
    alert = F.struct(F.col("feature").alias("metric"), "step", F.round("mean", 4).alias("predicted_value"), "threshold", F.round(share, 2).alias("confidence"))
    return rows.groupBy(*keys, "feature").agg(F.min_by(alert, "step").alias("alert")).groupBy(*keys).agg(F.sort_array(F.collect_list("alert")).alias("breach_alerts"))
