"""Root-cause classification of anomalous windows, oversampling and cross-validation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.constants import SEED
from tidewatch.ml.neighbours import nearest_same_class
from tidewatch.operators.windows import kfold, shuffled_rank
from tidewatch.session import cut


def training_rows(features: DataFrame, label: str = "label", least: int = 10) -> DataFrame:
    """Anomalous windows only; every class when there are fewer than ``least``."""
    anomalous = features.filter(F.col(label) != "normal")
    return anomalous if anomalous.limit(least).count() >= least else features


def preprocessing(columns: Sequence[str], label: str = "label") -> list:
    return [StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc"),
            VectorAssembler(inputCols=list(columns), outputCol="raw", handleInvalid="error"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]


def classifier(kind: str = "forest", trees: int = 100, depth: int = 8, seed: int = SEED):
    if kind == "forest":
        return RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    if kind == "boosted":
        return OneVsRest(classifier=GBTClassifier(labelCol="y", featuresCol="features", maxDepth=depth, maxIter=20, stepSize=0.1, subsamplingRate=0.8, seed=seed), labelCol="y", featuresCol="features")
    raise ValueError(f"unknown classifier {kind}")


def fit(rows: DataFrame, columns: Sequence[str], label: str = "label", kind: str = "forest", oversample: bool = True, ident: str = "window_id") -> tuple[PipelineModel, object]:
    """``(preprocessing model, classifier model)``; the classifier sees the oversampled training rows."""
    rows = rows.select(ident, label, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    prep = Pipeline(stages=preprocessing(columns, label)).fit(rows)
    train = prep.transform(rows).select(ident, "y", "features")
    if oversample:
        train = smote(train, ident)
    return prep, classifier(kind).fit(train)


def predict(model: tuple, features: DataFrame, columns: Sequence[str], keys: Sequence[str], k: int = 5) -> DataFrame:
    """``keys, predicted_cause, cause_confidence, top_causes`` (at most ``k``, most probable first)."""
    prep, clf = model
    labels = prep.stages[0].labels
    rows = features.select(*keys, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    scored = clf.transform(_prepare(prep, rows))
    p = vector_to_array("probability")
    each = F.transform(p, lambda v, i: F.struct((-F.round(v, 4)).alias("o"), F.element_at(F.array(*[F.lit(x) for x in labels]), i + 1).alias("cause"), F.round(v, 4).alias("probability")))
    top = F.transform(F.slice(F.array_sort(each), 1, k), lambda t: F.struct(t["cause"].alias("cause"), t["probability"].alias("probability")))
    return scored.select(*keys, top.alias("top_causes")).select(
        *keys, F.col("top_causes")[0]["cause"].alias("predicted_cause"), F.col("top_causes")[0]["probability"].alias("cause_confidence"), "top_causes")


def _prepare(prep: PipelineModel, rows: DataFrame) -> DataFrame:
    """Assemble and scale without the label stage."""
    for stage in prep.stages[1:]:
        rows = stage.transform(rows)
    return rows


def importance(model: tuple, columns: Sequence[str], spark) -> DataFrame:
    """Features by importance (one row per feature of the model)."""
    values = model[1].featureImportances.toArray()
    ranked = sorted(zip(columns, values), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame([(i + 1, c, float(v)) for i, (c, v) in enumerate(ranked)], "rank int, feature string, importance double")


def contributing(model: tuple, features: DataFrame, columns: Sequence[str], keys: Sequence[str], top: int = 10) -> DataFrame:
    """The ``top`` features with their importance and the value each window has."""
    values = model[1].featureImportances.toArray()
    ranked = sorted(zip(columns, values), key=lambda t: (-t[1], t[0]))[:top]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.lit(float(v)), 4).alias("importance"), F.round(F.col(c), 4).alias("value")) for c, v in ranked])
    return features.select(*keys, F.inline(rows))


def cross_validate(rows: DataFrame, columns: Sequence[str], label: str = "label", ident: str = "window_id", folds: int = 5, trees: int = 20) -> DataFrame:
    """Weighted F1 per stratified fold."""
    rows = rows.select(ident, label, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])
    folded = cut(kfold(rows, label, ident, folds))
    n = folded.agg(F.max("fold")).first()[0] + 1
    prep = Pipeline(stages=preprocessing(columns, label)).fit(folded)
    data = prep.transform(folded).select("fold", "y", "features")
    metric = MulticlassClassificationEvaluator(labelCol="y", predictionCol="prediction", metricName="f1")
    scores = []
    for f in range(n):
        model = classifier(trees=trees).fit(data.filter(F.col("fold") != f))
        scores.append((f, float(metric.evaluate(model.transform(data.filter(F.col("fold") == f))))))
    return rows.sparkSession.createDataFrame(scores, "fold int, f1_weighted double")


# ---- oversampling -----------------------------------------------------------
def smote(rows: DataFrame, ident: str = "window_id", k: int = 5, seed: int = SEED, exact: bool = True) -> DataFrame:
    """Oversample every class to the size of the largest by interpolation towards a near neighbour of the class.

    Rows ``ident, y, features``. A class has up to ``k`` neighbours per row, fewer if it is smaller; the row of a class with a single one is
    repeated. Left unchanged with one class. ``exact=False`` takes the neighbours that the forest of ``neighbours`` finds, for many features.
    """
    rows = cut(rows)
    counts = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()        # one row per class
    sizes = {int(r["y"]): r["n"] for r in counts}
    if len(sizes) < 2:
        return rows
    top = max(sizes.values())
    short = {y: (top - n, n) for y, n in sizes.items() if n < top}
    if not short:
        return rows
    near = nearest_same_class(rows.filter(F.col("y").isin([float(y) for y in short])), ident, k, exact=exact)
    need = F.create_map(*[F.lit(x) for y, (m, n) in short.items() for x in (y, m)])
    have = F.create_map(*[F.lit(x) for y, (m, n) in short.items() for x in (y, n)])
    base = rows.select(F.col(ident).cast("string").alias(ident), F.col("y").cast("int").alias("y"), vector_to_array("features").alias("x"))
    ranked = shuffled_rank(base.filter(F.col("y").isin(list(short))), "y", ident, seed)
    # every row makes floor(need / n) copies, the first `need % n` rows of the shuffle one more
    m, n = need[F.col("y")], have[F.col("y")]
    times = (F.floor(m / n) + F.when(F.col("pos") < F.pmod(m, n), 1).otherwise(0)).cast("int")
    made = ranked.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).join(near, [ident, "y"], "left")
    u = lambda tag: F.pmod(F.xxhash64(F.col(ident), F.col("copy"), F.lit(tag), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    some = F.greatest(F.size("neighbours"), F.lit(0))
    partner = F.coalesce(F.try_element_at("neighbours", (F.floor(u("n") * some) + 1).cast("int"))["x"], F.col("x"))
    point = F.zip_with("x", partner, lambda a, b: a + (b - a) * u("g"))
    new = made.select(F.concat(ident, F.lit("#"), F.col("copy").cast("string")).alias(ident), F.col("y").cast("double").alias("y"), array_to_vector(point).alias("features"))
    return rows.select(F.col(ident).cast("string").alias(ident), "y", "features").unionByName(new)
