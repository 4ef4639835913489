"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs.

Each tree needs only a small fixed subsample, so fitting shuffles at most ``trees * sample`` rows whatever the
table size. Trees are built one group per tree and scored in Arrow batches; the model is a few megabytes.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewatch.constants import FOREST_CONTAMINATION, FOREST_SAMPLE, FOREST_TREES, SEED
from tidewatch.functions.ranks import exact_percentiles
from tidewatch.session import cut

NODES = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def path_norm(n: float) -> float:
    """Average path length of an unsuccessful search in a tree of ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes ``(feature, threshold, left, right, depth)`` of one random tree; leaves have feature -1 and an adjusted depth."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list] = [[-1, 0.0, -1, -1, 0.0]]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes[at][4] = depth + path_norm(len(rows))
            continue
        f = int(rng.choice(usable))
        t = max(float(rng.uniform(low[f], high[f])), float(np.nextafter(low[f], high[f])))         # above the lowest, so that no side is empty
        side = part[:, f] < t
        left, right = len(nodes), len(nodes) + 1
        nodes[at][:4] = [f, t, left, right]
        nodes += [[-1, 0.0, -1, -1, 0.0], [-1, 0.0, -1, -1, 0.0]]
        todo += [(left, rows[side], depth + 1), (right, rows[~side], depth + 1)]
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForest:
    columns: list[str]
    trees: pd.DataFrame | None = None
    sample: int = 0
    offset: float = 0.0

    def fit(self, features: DataFrame, ident: str = "window_id", trees: int = FOREST_TREES, sample: int = FOREST_SAMPLE,
            contamination: float = FOREST_CONTAMINATION, seed: int = SEED) -> "IsolationForest":
        vectors = cut(features.select(F.col(ident).alias("id"), F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in self.columns]).alias("x")))
        n = vectors.count()
        self.sample = min(sample, n)
        # rows that can be drawn: a hash sample of fixed size, or the whole table when it is smaller
        pool = min(n, 160 * sample)
        unit = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)
        drawn = vectors.filter(unit(F.col("id"), F.lit(seed)) < pool / n) if pool < n else vectors
        # a pair (row, tree) passes with three times the needed probability, then the smallest hashes win
        keep = min(1.0, 3.0 * self.sample / max(pool, 1))
        pairs = drawn.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn(
            "_u", unit(F.col("id"), F.col("tree"), F.lit(seed))).filter(F.col("_u") < keep)
        w = Window.partitionBy("tree").orderBy("_u", "id")
        picked = pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= self.sample).select("tree", "_r", "x")

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf.tree.iloc[0])
            pdf = pdf.sort_values("_r")
            nodes = grow(np.stack(pdf.x.values), np.random.default_rng([seed, tree]))
            out = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "depth"])
            out.insert(0, "node", np.arange(len(nodes)))
            out.insert(0, "tree", tree)
            return out

        # at most trees * 2 * sample node rows: the model itself
        self.trees = picked.groupBy("tree").applyInPandas(build, NODES).toPandas().sort_values(["tree", "node"])
        scores = self.raw_scores(vectors).withColumn("s", -F.col("score"))
        self.offset = exact_percentiles(scores, "s", [contamination]).first()[0]
        return self

    def raw_scores(self, vectors: DataFrame) -> DataFrame:
        """``id, score`` with the anomaly score in (0, 1] of each vector ``x``."""
        groups = [g for _, g in self.trees.groupby("tree")]
        packed = [(g.feature.values, g.threshold.values, g.left.values, g.right.values, g.depth.values) for g in groups]
        model = vectors.sparkSession.sparkContext.broadcast(packed)
        norm = path_norm(self.sample) or 1.0

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x = np.stack(b.x.values)
                rows, total = np.arange(len(x)), np.zeros(len(x))
                for feature, threshold, left, right, depth in model.value:
                    at = np.zeros(len(x), dtype=np.int64)
                    inner = feature[at] >= 0
                    while inner.any():
                        here = at[inner]
                        go = x[rows[inner], feature[here]] < threshold[here]
                        at[inner] = np.where(go, left[here], right[here])
                        inner = feature[at] >= 0
                    total += depth[at]
                yield pd.DataFrame({"id": b.id, "score": 2.0 ** (-(total / len(model.value)) / norm)})

        return vectors.mapInPandas(score, f"id {vectors.schema['id'].dataType.simpleString()}, score double")

    def transform(self, features: DataFrame, ident: str = "window_id") -> DataFrame:
        """``ident, if_score, is_outlier``: decision = -score - offset, ``if_score`` = clip(1 - (decision + 0.5), 0, 1)."""
        vectors = features.select(F.col(ident).alias("id"), F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in self.columns]).alias("x"))
        decision = -F.col("score") - F.lit(self.offset)
        return self.raw_scores(vectors).select(
            F.col("id").alias(ident), F.least(F.greatest(1 - (decision + 0.5), F.lit(0.0)), F.lit(1.0)).alias("if_score"), (decision < 0).alias("is_outlier"))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.trees, NODES).write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.columns, self.sample, self.offset)], "columns array<string>, sample int, offset double").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForest":
        meta = spark.read.parquet(f"{path}/meta").first()
        trees = spark.read.schema(NODES).parquet(f"{path}/trees").toPandas().sort_values(["tree", "node"])
        return cls(list(meta["columns"]), trees, meta["sample"], meta["offset"])
