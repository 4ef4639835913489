"""Training, full analysis, persistence and retraining of all models over metric tables."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.constants import FEATURES
from tidewatch.ml import logs as L
from tidewatch.ml import rootcause
from tidewatch.ml.ensemble import ensemble, sequence_score
from tidewatch.ml.forecast import RidgeForecaster, alerts_of
from tidewatch.ml.iforest import IsolationForest
from tidewatch.ml.reconstruction import Reconstruction
from tidewatch.operators import windows as W
from tidewatch.operators.reports import model_report
from tidewatch.session import cut, settled


@dataclass
class Models:
    forest: IsolationForest
    reconstruction: Reconstruction
    forecaster: RidgeForecaster
    cause: tuple | None

    def save(self, spark: SparkSession, path: str) -> None:
        self.forest.save(spark, f"{path}/forest")
        self.reconstruction.save(spark, f"{path}/reconstruction")
        self.forecaster.save(spark, f"{path}/forecaster")
        if self.cause:
            self.cause[0].write().overwrite().save(f"{path}/cause/prep")
            self.cause[1].write().overwrite().save(f"{path}/cause/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str, cause: bool = True) -> "Models":
        pair = (PipelineModel.load(f"{path}/cause/prep"), RandomForestClassificationModel.load(f"{path}/cause/model")) if cause else None
        return cls(IsolationForest.load(spark, f"{path}/forest"), Reconstruction.load(spark, f"{path}/reconstruction"), RidgeForecaster.load(spark, f"{path}/forecaster"), pair)


def fit_anomaly(wide: DataFrame, stats: DataFrame) -> tuple[IsolationForest, Reconstruction]:
    """``wide``: labelled metric rows; ``stats``: window statistics."""
    forest = IsolationForest(W.flat_columns()).fit(stats)
    scaler = W.Scaler(FEATURES).fit(wide)
    scaled = scaler.transform(wide)
    # fitted on the sequences of neighbouring rows that count as normal; rows around an incident do not become neighbours
    every = W.sequences(scaled)
    normal = W.sequence_label(wide).filter("is_anomaly = 0").select("service", "timestamp")
    rec = Reconstruction().fit(every.join(normal, ["service", "timestamp"], "left_semi").select("seq"), scaler)
    labelled = every.join(W.sequence_label(wide).select("service", "timestamp", "is_anomaly"), ["service", "timestamp"])
    return forest, rec.calibrate(labelled.select("is_anomaly", rec.error().alias("error")))


def fit_forecaster(wide: DataFrame) -> RidgeForecaster:
    scaler = W.Scaler(FEATURES).fit(wide)
    return RidgeForecaster(scaler).fit(W.supervised_pairs(scaler.transform(wide)))


def fit_cause(rich: DataFrame, **kwargs) -> tuple:
    return rootcause.fit(rootcause.training_rows(rich), W.rich_columns(), **kwargs)


def retrain(wide: DataFrame, windows: DataFrame, rich: DataFrame, least: int = 10) -> tuple[IsolationForest, Reconstruction, tuple | None]:
    """Refit on collected windows; the cause model only with at least ten anomalous windows."""
    forest, rec = fit_anomaly(wide, windows)
    enough = rich.filter(F.col("label") != "normal").limit(least).count() >= least
    return forest, rec, fit_cause(rich) if enough else None


def score_windows(models: Models, windows: DataFrame) -> DataFrame:
    """``window_id, service, if_score, lstm_score, anomaly_score, is_anomaly, details`` for windows of metric rows.

    The sequence of a window is its last thirty rows. Its score is 0 where the sequence model had nothing normal to learn from.
    """
    stats = W.base_stats(windows)
    scores = models.forest.transform(stats.select("window_id", *models.forest.columns))
    rec = models.reconstruction
    tail = rec.scaler.transform(windows.filter(F.col("i") >= W.WINDOW_ROWS - W.SEQUENCE_ROWS))
    seq = tail.groupBy("window_id", "service").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.array(*FEATURES).alias("v")))), lambda r: r["v"]).alias("seq"))
    err = seq.select("window_id", "service", rec.error().alias("error"))
    both = err.join(scores, "window_id").withColumn("lstm_score", sequence_score(F.col("error"), F.lit(rec.threshold).cast("double")))
    return ensemble(both).select("window_id", "service", "if_score", "lstm_score", "anomaly_score", "is_anomaly", "details")


def full_analysis(models: Models, windows: DataFrame, logs: DataFrame, clusters: DataFrame, seconds: int = 3600) -> DataFrame:
    """One report row per service and window: anomaly and forecast for all, root cause for the anomalous ones only, log patterns of the service in the
    window's time (see ``logs.window_patterns``). Lines that are in no window have one row per service, without ``window_id`` and outputs of the metric models.

    ``logs``: id, timestamp, service, message, severity; every line with a message is assigned to a known pattern or is a new one. ``clusters``: templates as
    ``logs.cluster`` gives them. The rows of a window are steps of ``seconds``.
    """
    keys = ["window_id"]
    scored = cut(score_windows(models, windows))
    fc = models.forecaster
    rows = fc.scaler.transform(windows).groupBy("window_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", F.array(*FEATURES).alias("v")))), lambda r: r["v"]).alias("rows"))
    alerts = alerts_of(fc.predict(rows, keys), keys)
    out = scored.join(alerts, keys, "left")
    if models.cause:
        flagged = windows.join(scored.filter("is_anomaly").select("window_id"), "window_id", "left_semi")
        out = out.join(rootcause.predict(models.cause, W.rich_stats(flagged), W.rich_columns(), keys), keys, "left")
    else:
        empty = "array<struct<cause:string,probability:double>>"
        out = out.withColumns({"predicted_cause": F.lit(None).cast("string"), "cause_confidence": F.lit(None).cast("double"), "top_causes": F.lit(None).cast(empty)})
    known = settled(L.with_cluster(logs, clusters).select("id", "timestamp", "service", "severity", "message", "cluster_id"))         # read five times
    summary = settled(L.pattern_summary(L.patterns(known)).select("cluster_id", "label", "size"))
    found = settled(L.window_patterns(L.assign(logs.filter("message IS NOT NULL"), clusters), windows, summary, seconds))
    none = {"log_lines": F.lit(0), "new_patterns_detected": F.lit(0), "log_patterns": F.array().cast(found.schema["log_patterns"].dataType)}
    out = out.join(found, ["service", "window_id"], "full").withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    return model_report(out.join(F.broadcast(summary.agg(F.count(F.lit(1)).alias("total_patterns")))))        # one row
