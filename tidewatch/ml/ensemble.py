"""Ensemble of the outlier score and the sequence error."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.constants import ANOMALY_CUT, FOREST_WEIGHT, SEQUENCE_WEIGHT
from tidewatch.functions.scalar import fixed


def details() -> Column:
    """Text for a row with ``anomaly_score``, ``if_score`` and ``lstm_score``."""
    score = F.format_string("%.2f", fixed("anomaly_score", 2))
    signal = F.when(F.col("lstm_score") > F.col("if_score"), "temporal pattern (LSTM)").otherwise("statistical outlier (IF)")
    return F.when(F.col("anomaly_score") > ANOMALY_CUT, F.concat(F.lit("Anomaly detected (score: "), score, F.lit("), dominant signal: "), signal)).otherwise(
        F.concat(F.lit("Normal (score: "), score, F.lit(")")))


def sequence_score(error: Column, threshold: Column) -> Column:
    """Error relative to twice the threshold, clipped to [0, 1]; 1 when there is no threshold; 0 without a sequence."""
    ratio = F.when(threshold > 0, error / (threshold * 2)).otherwise(F.lit(1.0))
    return F.when(error.isNull(), F.lit(0.0)).otherwise(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)))


def ensemble(scored: DataFrame) -> DataFrame:
    """Add ``anomaly_score``, ``is_anomaly`` and ``details`` from ``if_score`` and ``lstm_score``."""
    score = FOREST_WEIGHT * F.col("if_score") + SEQUENCE_WEIGHT * F.col("lstm_score")
    return scored.withColumn("anomaly_score", score).withColumn("is_anomaly", F.col("anomaly_score") > ANOMALY_CUT).withColumn("details", details())
