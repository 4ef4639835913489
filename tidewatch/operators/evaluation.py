"""Model evaluation and statistics as aggregates over prediction tables."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
import math

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.constants import (EPS, GPU_USD_PER_HOUR, INPUT_USD_PER_MILLION, MODEL_MS_PER_CALL, OUTPUT_USD_PER_MILLION, REPORT_MS_PER_CALL, SEED)
from tidewatch.functions.ranks import exact_percentiles, value_counts, with_cumulative
from tidewatch.functions.series import with_previous


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def binary(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    one = lambda c: F.col(c) == 1
    c = df.agg(F.count_if(one(y) & one(y_hat)).alias("tp"), F.count_if(~one(y) & one(y_hat)).alias("fp"),
               F.count_if(~one(y) & ~one(y_hat)).alias("tn"), F.count_if(one(y) & ~one(y_hat)).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.select(p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1_score"), tp.alias("true_positives"), fp.alias("false_positives"),
                    tn.alias("true_negatives"), fn.alias("false_negatives"), (fp / (fp + tn + EPS)).alias("false_positive_rate"),
                    (fn / (fn + tp + EPS)).alias("miss_rate"))


def auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve from value counts; ties count half; one class only gives 0."""
    pos = F.when(F.col(y) == 1, 1).otherwise(0)
    ranked = with_cumulative(value_counts(df, score, pos=pos, neg=1 - pos), ["neg"])
    out = ranked.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum(F.col("pos") * (F.col("neg_before") + 0.5 * F.col("neg"))).alias("u"))
    return out.select(ratio(F.col("u"), F.col("p") * F.col("q")).alias("auc_roc"))


def forecast_errors(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, y: str = "y", y_hat: str = "y_hat", feature: str = "feature") -> DataFrame:
    """MAE, RMSE, MAPE and directional accuracy per feature (series given by ``keys``) and over all (feature ``all``)."""
    pair = df.withColumn("_p", F.struct(F.col(y).alias("a"), F.col(y_hat).alias("b")))
    seen = with_previous(pair, [*keys, feature], order, ts, "_p", "_q")
    err = F.abs(F.col(y) - F.col(y_hat))
    same = (F.col(y) > F.col("_q.a")) == (F.col(y_hat) > F.col("_q.b"))
    rows = seen.select(
        F.explode(F.array(F.col(feature), F.lit("all"))).alias("feature"), err.alias("e"), (err * err).alias("e2"),
        F.when(F.abs(y) > EPS, err / F.abs(y)).alias("pe"), F.when(F.col("_q").isNotNull(), same.cast("double")).alias("d"))
    return rows.groupBy("feature").agg(
        F.avg("e").alias("mae"), F.sqrt(F.avg("e2")).alias("rmse"), (F.coalesce(F.avg("pe"), F.lit(0.0)) * 100).alias("mape"),
        F.coalesce(F.avg("d"), F.lit(0.0)).alias("directional_accuracy"))


def class_report(df: DataFrame, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """Precision, recall, F1 and support per class, plus ``accuracy``, ``macro avg`` and ``weighted avg`` rows.

    The data are reduced to class pairs first; everything after is as small as the confusion matrix.
    """
    cells = df.groupBy(F.col(y).cast("string").alias("t"), F.col(y_hat).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("t").alias("class"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")))))
    per = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    scored = per.withColumns({"precision": p, "recall": r}).withColumn("f1_score", f1(F.col("precision"), F.col("recall")))
    shape = ["class", "precision", "recall", "f1_score", "support"]
    total = F.sum("support")
    wavg = lambda c: F.sum(F.col(c) * F.col("support")) / total
    means = scored.agg(
        (F.sum("tp") / total).alias("acc"), total.alias("support"),
        *[F.avg(c).alias(f"m_{c}") for c in shape[1:4]], *[wavg(c).alias(f"w_{c}") for c in shape[1:4]])
    rows = F.array(
        F.struct(F.lit("accuracy").alias("class"), *[F.col("acc").alias(c) for c in shape[1:4]], "support"),
        F.struct(F.lit("macro avg").alias("class"), *[F.col(f"m_{c}").alias(c) for c in shape[1:4]], "support"),
        F.struct(F.lit("weighted avg").alias("class"), *[F.col(f"w_{c}").alias(c) for c in shape[1:4]], "support"))
    return scored.select(*shape).unionByName(means.select(F.inline(rows)))


def topk_accuracy(df: DataFrame, ks: Sequence[int] = (3, 5), y: str = "y", proba: str = "proba") -> DataFrame:
    """Share of rows whose class is among the ``k`` most probable; the rank is found inside the row, without an explode."""
    rank = F.size(F.filter(proba, lambda x: x > F.get(F.col(proba), F.col(y))))
    return df.agg(*[F.avg((rank < k).cast("double")).alias(f"top_{k}_accuracy") for k in ks])


def confusion(df: DataFrame, labels: Sequence, y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    return df.groupBy(F.col(y).alias("actual")).pivot(y_hat, list(labels)).count().na.fill(0)


def silhouette(df: DataFrame, vector: str = "embedding", cid: str = "cid") -> DataFrame:
    """Mean silhouette (squared Euclidean, linear cost) of the points that are not noise; 0 with fewer than two clusters."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    points = df.filter(F.col(cid) != -1).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(cid).cast("double").alias("prediction"))
    n = points.agg(F.count_distinct("prediction")).first()[0]
    score = ClusteringEvaluator(featuresCol="features", predictionCol="prediction", metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(points) if n > 1 else 0.0
    return df.sparkSession.range(1).select(F.lit(float(score)).alias("silhouette_score"), F.lit(n).cast("bigint").alias("n_clusters"))


def agreement(df: DataFrame, true: str = "true_label", cid: str = "cid") -> DataFrame:
    """ARI, NMI, homogeneity, completeness and V-measure of the points that are not noise, from the contingency table."""
    cells = df.filter(F.col(cid) != -1).groupBy(F.col(true).alias("t"), F.col(cid).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    plog = lambda c: F.col(c) * F.log(F.col(c).cast("double"))
    sums = lambda d, k: d.agg(F.sum(two("n")).alias(f"s_{k}"), F.sum(plog("n")).alias(f"l_{k}"), F.sum("n").alias("total"))
    by = lambda k: sums(cells.groupBy(k).agg(F.sum("n").alias("n")), k).drop("total")
    row = sums(cells, "tc").join(by("t")).join(by("c"))       # three single rows
    n = F.col("total")
    expected = F.col("s_t") * F.col("s_c") / (n * (n - 1) / 2)
    top = (F.col("s_t") + F.col("s_c")) / 2
    ari = F.when(top == expected, 1.0).otherwise((F.col("s_tc") - expected) / (top - expected))
    ln = F.log(n.cast("double"))
    h_t, h_c = ln - F.col("l_t") / n, ln - F.col("l_c") / n
    mi = ln + (F.col("l_tc") - F.col("l_t") - F.col("l_c")) / n
    hom, com = F.when(h_t > 0, mi / h_t).otherwise(F.lit(1.0)), F.when(h_c > 0, mi / h_c).otherwise(F.lit(1.0))
    v = F.when(hom + com > 0, 2 * hom * com / (hom + com)).otherwise(F.lit(0.0))
    nmi = F.when((h_t + h_c) > 0, 2 * mi / (h_t + h_c)).otherwise(F.lit(1.0))
    return row.select(ari.alias("adjusted_rand_index"), nmi.alias("normalised_mutual_info"), hom.alias("homogeneity"), com.alias("completeness"), v.alias("v_measure"))


def noise(df: DataFrame, cid: str = "cid") -> DataFrame:
    return df.agg(F.count_distinct(F.when(F.col(cid) != -1, F.col(cid))).alias("n_clusters"), F.count_if(F.col(cid) == -1).alias("n_noise_points"),
                  F.avg((F.col(cid) == -1).cast("double")).alias("noise_ratio"))


def _beta_continued(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return h


def t_p_value(t: float, dof: float) -> float:
    """Two-sided p value of Student's t."""
    if not math.isfinite(t):
        return 0.0
    x, a, b = dof / (dof + t * t), dof / 2.0, 0.5
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_continued(a, b, x) / a
    return 1.0 - front * _beta_continued(b, a, 1.0 - x) / b


def with_p(row: DataFrame, schema: str, fn) -> DataFrame:
    """Add columns computed in Python to a one-row frame."""
    def apply(batches: Iterator) -> Iterator:
        for b in batches:
            yield fn(b)

    return row.mapInPandas(apply, schema)


def paired_t(df: DataFrame, a: str = "a", b: str = "b", p_value: bool = True) -> DataFrame:
    d = F.col(a) - F.col(b)
    row = df.agg(F.count(d).alias("n"), F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"), F.avg(a).alias("_a"), F.avg(b).alias("_b"))
    row = row.select("n", (F.col("_m") / (F.col("_s") / F.sqrt("n"))).alias("t_statistic"), F.when(F.col("_a") > F.col("_b"), "A > B").otherwise("B > A").alias("effect_direction"))
    if not p_value:
        return row

    def add(pdf):
        pdf["p_value"] = [t_p_value(t, n - 1) for t, n in zip(pdf.t_statistic, pdf.n)]
        pdf["significant_at_0_05"], pdf["significant_at_0_01"] = pdf.p_value < 0.05, pdf.p_value < 0.01
        return pdf

    return with_p(row, "n bigint, t_statistic double, effect_direction string, p_value double, significant_at_0_05 boolean, significant_at_0_01 boolean", add)


def wilcoxon(df: DataFrame, a: str = "a", b: str = "b", p_value: bool = True) -> DataFrame:
    """Signed-rank statistic; zero differences are dropped, ties get average ranks; all zero gives an error row."""
    diffs = df.select((F.col(a) - F.col(b)).alias("d")).filter("d <> 0")
    counted = value_counts(diffs.select(F.abs("d").alias("m"), (F.col("d") > 0).cast("int").alias("up")), "m", up=F.col("up"))
    if counted.isEmpty():
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("statistic"), F.lit("Identical samples").alias("error"))
    ranked = with_cumulative(counted)
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    row = ranked.agg(F.sum("n").alias("n"), F.sum(F.col("up") * rank).alias("_w"), F.sum((F.col("n") - F.col("up")) * rank).alias("_l"),
                     F.sum(F.pow(F.col("n"), 3) - F.col("n")).alias("_t"))
    row = row.select("n", F.least("_w", "_l").alias("statistic"), "_t")
    if not p_value:
        return row.drop("_t")
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48)
    z = (F.col("statistic") - n * (n + 1) / 4) / sd

    def add(pdf):
        pdf["p_value"] = [math.erfc(abs(v) / math.sqrt(2)) for v in pdf.z]
        pdf["significant_at_0_05"] = pdf.p_value < 0.05
        return pdf.drop(columns="z")

    return with_p(row.select("n", "statistic", z.alias("z")), "n bigint, statistic double, p_value double, significant_at_0_05 boolean", add)


def bootstrap_ci(df: DataFrame, column: str, resamples: int = 10_000, confidence: float = 0.95, seed: int = SEED) -> DataFrame:
    """Percentile interval of the mean from a Poisson bootstrap.

    Equal values are counted first: the sum of ``n`` Poisson(1) weights is Poisson(n), so a heavy value costs one draw.
    Each task adds up its weights for all resamples and emits one row per resample; no row is copied.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = value_counts(df, column).repartition(tasks, "v").sortWithinPartitions("v")

    def draw(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext
        part, step = TaskContext.get().partitionId(), 0
        w, wx = np.zeros(resamples), np.zeros(resamples)
        for b in batches:
            for lo in range(0, len(b), 256):
                v, n = b.v.values[lo:lo + 256], b.n.values[lo:lo + 256]
                k = np.random.Generator(np.random.Philox([seed, part * 1_000_003 + step])).poisson(n, size=(resamples, len(n))).astype(float)
                w += k.sum(axis=1)
                wx += k @ v
                step += 1
        if step:
            yield pd.DataFrame({"b": np.arange(resamples), "w": w, "wx": wx})

    means = counted.select("v", "n").mapInPandas(draw, "b bigint, w double, wx double").groupBy("b").agg((F.sum("wx") / F.sum("w")).alias("mean"))
    alpha = 1 - confidence
    # one row per resample, a fixed number
    interval = means.agg(F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    simple = df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return simple.join(interval).select(
        "mean", "std", F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"), F.lit(confidence).alias("confidence"), F.lit(resamples).alias("n_bootstrap"))


def cost_rollup(calls: DataFrame, month: str = "month") -> DataFrame:
    """Token prices against GPU hours per month; expects ``month, input_tokens, output_tokens, day``."""
    m = calls.groupBy(month).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("calls"),
                                 F.count_distinct("day").alias("_days"))
    hours = F.col("calls") * ((MODEL_MS_PER_CALL + REPORT_MS_PER_CALL) / 1000) / 3600
    api = F.col("input_tokens") / 1e6 * INPUT_USD_PER_MILLION + F.col("output_tokens") / 1e6 * OUTPUT_USD_PER_MILLION
    ml = hours * GPU_USD_PER_HOUR
    return m.select(month, "input_tokens", "output_tokens", "calls", F.round(api, 2).alias("api_cost_usd"), F.round(hours, 2).alias("gpu_hours"), F.round(ml, 2).alias("ml_cost_usd"),
                    F.round(hours / (24 * F.col("_days")) * 100, 2).alias("gpu_utilisation_pct"), F.round(api - ml, 2).alias("savings_usd"),
                    F.when(api > 0, F.round((api - ml) / api * 100, 1)).otherwise(F.lit(0.0)).alias("savings_pct"))
