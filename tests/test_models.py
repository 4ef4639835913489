"""Properties of the models and of exact neighbours."""
import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.ml import rootcause as RC
from tidewatch.ml.iforest import IsolationForest


def test_forest_ranks_planted_outliers(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"w{i}", *map(float, rng.normal(size=3))) for i in range(200)] + [(f"out{i}", 9.0, -9.0, 9.0) for i in range(3)]
    df = spark.createDataFrame(rows, "window_id string, a double, b double, c double")
    f = IsolationForest(["a", "b", "c"]).fit(df, trees=50)
    got = {r.window_id: r.if_score for r in f.transform(df).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert min(got[f"out{i}"] for i in range(3)) > max(v for k, v in got.items() if k.startswith("w")) - 1e-9 or \
        np.mean([got[f"out{i}"] for i in range(3)]) > np.quantile([v for k, v in got.items() if k.startswith("w")], 0.97)
    f.save(spark, str(tmp_path / "f"))
    again = {r.window_id: r.if_score for r in IsolationForest.load(spark, str(tmp_path / "f")).transform(df).collect()}
    assert again == got


def test_oversampling_of_classes_of_any_size(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(f"a{i}", 0.0, Vectors.dense([i / 10, 1.0])) for i in range(12)] + [(f"b{i}", 1.0, Vectors.dense([5.0 + i, i * 2.0])) for i in range(3)] + [("c", 2.0, Vectors.dense([9.0, 9.0]))]
    out = RC.smote(spark.createDataFrame(rows, ["window_id", "y", "features"]), k=5).collect()
    assert {y: sum(r.y == y for r in out) for y in (0.0, 1.0, 2.0)} == {0.0: 12, 1.0: 12, 2.0: 12}
    for r in out:                                       # new points lie on a line between two rows of the class
        x, z = r.features
        if r.y == 1.0:
            assert 5 <= x <= 7 and abs(z - 2 * (x - 5)) < 1e-9
        if r.y == 2.0:
            assert (x, z) == (9.0, 9.0)


def test_models_of_metrics_without_a_normal_sequence(spark, tmp_path):
    from tidewatch.constants import FEATURES
    from tidewatch.ml import pipeline as P
    from tidewatch.operators import windows as W

    rng = np.random.default_rng(4)
    rows = [("s", i, "spike" if i < 60 else "normal", *map(float, rng.uniform(1, 2, len(FEATURES)))) for i in range(70)]
    wide = spark.createDataFrame(rows, "service string, at long, label string, " + ", ".join(f"{f} double" for f in FEATURES)).withColumn("timestamp", F.timestamp_seconds("at").cast("timestamp_ntz"))
    windows = W.slide_rows(wide, 60, 5)
    forest, rec = P.fit_anomaly(wide, W.rich_stats(windows))
    assert rec.threshold is None and [r[0] for r in W.sequences(rec.scaler.transform(wide)).select(rec.error()).distinct().collect()] == [None]
    rec.save(spark, str(tmp_path / "r"))
    again = type(rec).load(spark, str(tmp_path / "r"))
    for m in (rec, again):
        out = P.score_windows(P.Models(forest, m, None, None), windows).collect()
        assert len(out) == 3 and {r.lstm_score for r in out} == {0.0} and all(0 <= r.if_score <= 1 for r in out)


def test_threshold_without_a_normal_row(spark):
    from tidewatch.ml.reconstruction import normal_threshold

    assert [r.threshold for r in normal_threshold(spark.createDataFrame([(0.5, 1)], "error double, is_anomaly int")).collect()] == [None]
