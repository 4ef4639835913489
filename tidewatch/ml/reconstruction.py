"""Sequence reconstruction error from a linear bottleneck (PCA) fitted on normal sequences."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.constants import ERROR_PERCENTILE, FEATURES, LATENT_DIM
from tidewatch.functions.ranks import exact_percentiles
from tidewatch.operators.windows import Scaler


@dataclass
class Reconstruction:
    """Scaler, mean sequence, principal directions and error threshold."""
    scaler: Scaler | None = None
    mean: np.ndarray | None = None
    components: np.ndarray | None = None
    threshold: float | None = 0.0

    def fit(self, normal: DataFrame, scaler: Scaler, latent: int = LATENT_DIM) -> "Reconstruction":
        """``normal``: column ``seq`` of scaled normal sequences. The covariance is summed over tasks; its size is fixed.

        Without any there is nothing to learn: errors and threshold are null then."""
        flat = normal.select(F.flatten("seq").alias("x"))
        width = F.posexplode("x").alias("i", "v")
        means = flat.select(width).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").toPandas()
        self.scaler, self.mean, self.components = scaler, None, None
        if not len(means):
            return self
        self.mean = means.m.values
        model = PCA(k=min(latent, len(self.mean)), inputCol="vec", outputCol="z").fit(flat.select(array_to_vector("x").alias("vec")))
        self.components = model.pc.toArray()
        return self

    def error(self, seq: str = "seq") -> Column:
        """Mean squared residual of a sequence column."""
        mean, comp = self.mean, self.components
        if mean is None:
            return F.lit(None).cast("double")

        @F.pandas_udf("double")
        def mse(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            d = np.stack(x.values) - mean
            z = d @ comp
            return pd.Series((np.square(d).sum(axis=1) - np.square(z).sum(axis=1)).clip(min=0) / d.shape[1])

        return mse(F.flatten(seq))

    def calibrate(self, errors: DataFrame, label: str = "is_anomaly", error: str = "error") -> "Reconstruction":
        self.threshold = normal_threshold(errors, label, error).first()[0]
        return self

    def save(self, spark: SparkSession, path: str) -> None:
        fitted = (None, None, None) if self.mean is None else (self.mean.tolist(), self.components.ravel().tolist(), self.components.shape[1])
        row = (self.scaler.columns, self.scaler.mean, self.scaler.scale, *fitted, None if self.threshold is None else float(self.threshold))
        schema = "columns array<string>, center array<double>, scale array<double>, mean array<double>, components array<double>, k int, threshold double"
        spark.createDataFrame([row], schema).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Reconstruction":
        r = spark.read.parquet(path).first()
        fitted = (None, None) if r["mean"] is None else (np.array(r["mean"]), np.array(r["components"]).reshape(-1, r["k"]))
        return cls(Scaler(list(r["columns"]), list(r["center"]), list(r["scale"])), *fitted, r["threshold"])


def normal_threshold(errors: DataFrame, label: str = "is_anomaly", error: str = "error", q: float = ERROR_PERCENTILE) -> DataFrame:
    """Single row: the percentile of the errors of normal sequences, null without any."""
    return exact_percentiles(errors.filter(F.col(label) == 0), error, [q]).toDF("threshold")
