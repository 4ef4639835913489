"""Exact small fixtures and edge cases."""
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import scalar as S
from tidewatch.functions.ranks import exact_percentiles
from tidewatch.functions.series import with_last, with_position, with_previous
from tidewatch.ml import logs as L
from tidewatch.ml.density import components
from tidewatch.ml.forecast import breach_alerts
from tidewatch.operators import aggregates as G
from tidewatch.operators import evaluation as V
from tidewatch.operators import joins as J
from tidewatch.operators import queries as Q
from tidewatch.operators import reports as R
from tidewatch.operators import timeseries as TS
from tidewatch.operators import trends as T

T0 = datetime(2024, 1, 1)


def series(spark, values, name="s"):
    rows = [(name, T0 + timedelta(minutes=i), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "s string, ts timestamp_ntz, id int, value string")


def test_severity(spark):
    df = spark.createDataFrame([("Fatal stacktrace",), ("warning x",), ("trace id",), ("ok",)], "m string")
    assert [r[0] for r in df.select(S.severity(F.col("m"))).collect()] == ["ERROR", "WARN", "DEBUG", "INFO"]


@pytest.mark.parametrize("values,trend,direction", [
    (["1", "1", "2", "2"], 100.0, "increasing"), (["2", "4", "6"], 150.0, "increasing"), (["0", "0", "5", "5"], 0.0, "stable"), (["7"], 0.0, "stable"),
    (["1", "n/a", "1", "2", "2"], 100.0, "increasing")])
def test_trend(spark, values, trend, direction):
    r = T.rounded(T.series_stats(series(spark, values), ["s"], ["ts", "id"], "ts")).first()
    assert (r.trend_pct, r.direction) == (trend, direction)


def test_trend_stats_and_empty_series(spark):
    r = T.rounded(T.series_stats(series(spark, ["1", "1", "2", "2"]), ["s"], ["ts", "id"], "ts")).first()
    assert (r.avg, r.volatility_cv, r.latest, r.data_points) == (1.5, 33.33, 2.0, 4)
    assert T.series_stats(series(spark, ["x", None]), ["s"], ["ts", "id"], "ts").count() == 0


def test_trend_class(spark):
    df = spark.createDataFrame([("increasing", 8.0), ("increasing", 12.0), ("decreasing", -6.0)], "direction string, trend_pct double")
    assert [r[0] for r in df.select(T.trend_class()).collect()] == ["stable", "degrading", "improving"]


def test_duration_buckets(spark):
    df = spark.createDataFrame([(0.0,), (100.0,), (499.9,), (500.0,), (2000.0,), (None,)], "duration_ms double")
    assert [r["count"] for r in G.duration_histogram(df).collect()] == [2, 2, 1, 0, 1]


def test_rule_report(spark):
    r = R.rule_report(spark.createDataFrame([(1000, 50, 5)], "total_logs long, total_errors long, slow_traces long")).first()
    assert (r.health_status, r.confidence, [a.severity for a in r.anomalies]) == ("DEGRADED", 0.6, ["medium"])


def test_model_report(spark):
    schema = ("is_anomaly boolean, anomaly_score double, if_score double, lstm_score double, details string, "
              "breach_alerts array<struct<metric:string,step:int,predicted_value:double,threshold:double,confidence:double>>, "
              "predicted_cause string, cause_confidence double, top_causes array<struct<cause:string,probability:double>>")
    row = (True, 0.78, 0.65, 0.85, "Anomaly detected (score: 0.78)", [("cpu_usage", 5, 0.92, 0.85, 0.75)], "memory_leak", 0.82,
           [("memory_leak", 0.82), ("jvm_gc_pressure", 0.12)])
    r = R.model_report(spark.createDataFrame([row], schema)).first()
    assert r.health_status == "DEGRADED" and [a.severity for a in r.anomalies] == ["high"]
    assert [x.priority for x in r.recommendations] == ["short_term"] and [c.issue for c in r.root_causes] == ["Memory Leak", "Jvm Gc Pressure"]
    assert r.summary == "Detected 1 anomalies and 1 forecast alerts. System status: DEGRADED."
    empty = R.model_report(spark.createDataFrame([(None,) * 9], schema)).first()
    assert empty.health_status == "HEALTHY" and empty.anomalies == [] and empty.root_causes == []


def test_binary_and_auc(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 0, 1], [0, 0, 1, 0, 0, 1], [.1, .2, .9, .4, .15, .85])), "y int, y_hat int, score double")
    r = V.binary(df).first()
    assert (r.true_positives, r.false_positives, r.true_negatives, r.false_negatives, r.precision) == (2, 0, 3, 1, 1.0)
    assert abs(r.recall - 2 / 3) < 1e-12 and abs(r.f1_score - 0.8) < 1e-12
    assert V.auc(df).first()[0] == 1.0 and V.auc(df.filter("y = 1")).first()[0] == 0.0


def test_all_noise(spark):
    r = V.noise(spark.createDataFrame([(-1,), (-1,)], "cid int")).first()
    assert (r.n_clusters, r.noise_ratio) == (0, 1.0)


def test_paired_t_p_value():
    # Student's t with 10 degrees of freedom: P(|t| > 2.228) is 5 %
    assert abs(V.t_p_value(2.2281388519649385, 10) - 0.05) < 1e-9 and abs(V.t_p_value(0.0, 5) - 1.0) < 1e-12


def test_wilcoxon_identical(spark):
    assert V.wilcoxon(spark.createDataFrame([(1, 1), (2, 2)], "a long, b long")).first().error == "Identical samples"


def test_bootstrap(spark):
    df = spark.createDataFrame([(float(i % 17),) for i in range(500)], "v double")
    r = V.bootstrap_ci(df, "v", resamples=400).first()
    assert r.ci_lower < r["mean"] < r.ci_upper and r.ci_upper - r.ci_lower < 2


def test_percentiles_match_interpolation(spark):
    import numpy as np
    x = np.random.default_rng(1).exponential(10, 3000).round(2)
    r = exact_percentiles(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", [0.0, 0.05, 0.5, 0.99, 1.0]).first()
    assert np.allclose(list(r), np.percentile(x, [0, 5, 50, 99, 100]))


def test_rate_reset_and_quantile_in_last_bucket(spark):
    df = series(spark, ["1", "5", "2", "4"]).withColumn("value", F.col("value").cast("double"))
    assert [r.increase for r in TS.counter_increase(df, ["s"]).orderBy("ts").collect()] == [0.0, 4.0, 2.0, 2.0]
    inf = float("inf")
    b = spark.createDataFrame([("a", 10.0, 4), ("a", 20.0, 8), ("a", inf, 10), ("z", 10.0, 0), ("z", inf, 0)], "k string, le double, cum long")
    rows = {r.k: r for r in TS.histogram_quantiles(b, ["k"], [0.2, 0.6, 0.95]).collect()}
    assert (rows["a"].q0, rows["a"].q1, rows["a"].q2) == (5.0, 15.0, 20.0) and rows["z"].q0 is None


def test_blocks_do_not_change_positions(spark):
    df = series(spark, [str(i) for i in range(50)])
    for seconds in (60, 420, 86400):
        rows = with_previous(with_position(df, ["s"], ["ts", "id"], "ts", seconds=seconds), ["s"], ["ts", "id"], "ts", "value", seconds=seconds).collect()
        assert all(r.idx == r.id and r.prev == (None if r.id == 0 else str(r.id - 1)) for r in rows)
        last = with_last(df, ["s"], ["ts", "id"], "ts", F.when(F.col("id") % 20 == 3, F.col("id")), "seen", seconds=seconds).collect()
        assert all(r.seen == (None if r.id < 3 else (r.id - 3) // 20 * 20 + 3) for r in last)


def test_nested_enrichment_keeps_order_and_missing(spark):
    p = spark.createDataFrame([(10, 2, 20), (10, 1, 9), (1, 1, 9)], "id int, pos int, child_id int")
    c = spark.createDataFrame([(9, "nine")], "id int, name string")
    d = spark.createDataFrame([(10, 1, 5), (10, 2, 4)], "parent_id int, pos int, rating int")
    rows = {(r.id, r.page): r for r in J.nested_enrichment(p, c, d).collect()}
    assert [(x.child_id, x.name) for x in rows[10, 0].children] == [(9, "nine"), (20, None)] and rows[10, 0].has_missing_child
    assert not rows[1, 0].has_missing_child and rows[1, 0].details is None
    assert len(J.nested_enrichment(p, c, d, page_rows=1).collect()) == 3      # paged, nothing cut


def test_query_bounds(spark):
    logs = spark.createDataFrame([(1, T0, "a", "INFO", "m")], "id long, timestamp timestamp_ntz, service string, severity string, message string")
    with pytest.raises(ValueError):
        Q.query_logs(logs, T0, since_minutes=1441)
    with pytest.raises(ValueError):
        Q.query_traces(logs, T0, limit=1001)
    assert Q.query_logs(logs, T0, severity="info").count() == 1


def test_breach_first_step(spark):
    rows = [("s", "cpu_usage", st, m, v) for st, vals in ((1, [.5, .6]), (2, [.9, .9]), (3, [.95, .99])) for m, v in enumerate(vals)]
    r = breach_alerts(spark.createDataFrame(rows, "service string, feature string, step int, member int, value double"), ["service"]).first()
    assert (r.step, r.predicted_value, r.threshold, r.confidence) == (2, 0.9, 0.85, 1.0)


def test_log_clusters_and_noise(spark):
    lines = [(i, f"Connection to 10.0.0.{i} lost after {i}ms") for i in range(6)] + [(100, "one of a kind line here")]
    got = {r.template: r.cluster_id for r in L.cluster(spark.createDataFrame(lines, "id int, message string")).collect()}
    assert got["Connection to <ip> lost after <n>ms"] != -1 and got["one of a kind line here"] == -1


def test_all_similar_templates_are_linked_and_offered(spark, monkeypatch):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    sets = [sorted({*rng.sample(words, rng.randrange(1, 12)), "all"}) for _ in range(150)]
    frame = spark.createDataFrame([*enumerate(sets)], "id long, tokens array<string>")
    alike = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if b < a and alike(x, y) >= 0.6}
    for block in (1000, 7):
        monkeypatch.setattr(L, "BLOCK", block)
        got = [(r.a, r.b) for r in L.similar_pairs(frame).collect()]
        assert set(got) == want and len(got) == len(want)
    known = [" ".join(x).replace("w", "word_").translate({c: c + 49 for c in range(48, 58)}) for x in sets]
    clusters = spark.createDataFrame([(t, i % 9) for i, t in enumerate(dict.fromkeys(known[:100]))], "template string, cluster_id long")
    old = {r.template: r.cluster_id for r in clusters.collect()}
    for r in L.assign(spark.createDataFrame([(t,) for t in known], "message string"), clusters).collect():
        best = max((alike(r.message.split(), t.split()), c) for t, c in old.items())
        assert (r.confidence, r.cluster_id) == ((round(best[0], 4), best[1]) if best[0] >= 0.6 else (0.0, -1))


def test_components_chain(spark):
    nodes = spark.range(40).select(F.col("id"))
    links = spark.range(1, 30).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    roots = {r.id: r.root for r in components(nodes, links).collect()}
    assert all(roots[i] == 0 for i in range(30)) and all(roots[i] == i for i in range(30, 40))


def test_near_counts_of_ties_and_repeated_rows(spark):
    at = lambda k: T0 + timedelta(seconds=k)
    base = [(1, "a", at(100)), (1, "a", at(100)), (2, "a", at(0)), (3, "b", at(100)), (4, None, at(100)), (5, "a", None)]
    other = [("a", at(k)) for k in (0, 40, 40, 90, 160, 161)] + [(None, at(100)), ("a", None)]
    df = J.near_counts(spark.createDataFrame(base, "id int, k string, t timestamp_ntz"), {"n": spark.createDataFrame(other, "k string, t timestamp_ntz")}, "k", "t", 60)
    assert sorted((r.id, r.n) for r in df.collect()) == [(1, 4), (1, 4), (2, 3), (3, 0), (4, 0), (5, 0)]


def test_messages_and_trend_records_keep_everything(spark):
    from tidewatch.sources import envelopes as E

    entries = [{"service": "s", "labels": {"n": str(i)}, "timestamp_ns": str(i), "severity": "WARN", "message": "m" * 9000} for i in range(150)]
    data = json.dumps({"source": "loki", "service": "s", "namespace": "d", "count": 150, "entries": entries})
    rows = E.log_rows(E.parse(spark.createDataFrame([("2024-01-01T00:00:00Z", data)], "timestamp string, data string"), "logs")).collect()
    assert len(rows) == 150 and {len(r.message) for r in rows} == {9000}
    samples = [("q", f"s{i:02}", T0, T0 + timedelta(minutes=k), k, str(i + k)) for i in range(12) for k in range(3)]
    frame = spark.createDataFrame(samples, "query_name string, service string, timestamp timestamp_ntz, ts timestamp_ntz, id int, value string")
    record = T.trend_records(T.rounded(T.series_stats(frame, ["query_name", "service", "timestamp"], ["ts", "id"], "ts")), F.lit("d"), "24h", "15m").first()
    assert record.series_count == 12 and [s.labels["service_name"] for s in record.analysis.series] == [f"s{i:02}" for i in range(12)]


def test_cycles_over_several_batches_see_the_stored_look_back(spark, tmp_path):
    from tidewatch.sources.sinks import drop_expired
    from tidewatch.streaming import ingest as I

    schema, out = "id int, service string, ts timestamp_ntz", str(tmp_path / "out")
    for k in range(3):
        rows = [(k * 10 + j, "s", T0 + timedelta(days=k, hours=j)) for j in range(4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    seen = []

    def cycle(batch, batch_id):
        recent = I.stored_look_back(batch, batch_id, out, "rows", "ts", T0 + timedelta(hours=23))
        I.publish(recent.groupBy("service").agg(F.count("*").alias("n")), f"{out}/report", batch_id)
        seen.append(recent._jdf.queryExecution().toString())

    for k in range(3):
        stream = I.file_stream(spark, str(tmp_path / "in" / f"f{k}"), schema, "parquet", files_per_trigger=1)
        I.start_cycle(stream, str(tmp_path / "checkpoint" / str(k)), lambda df, _, k=k: cycle(df, k), once=True).awaitTermination()
    assert [tuple(r) for r in I.read_published(spark, f"{out}/report").collect()] == [("s", 8)]
    assert all("PartitionFilters: [isnotnull(date" in plan for plan in seen)
    cycle(spark.createDataFrame([(20 + j, "s", T0 + timedelta(days=2, hours=j)) for j in range(4)], schema), 2)        # a replay changes nothing
    assert I.read_published(spark, f"{out}/report").first().n == 8
    assert drop_expired(spark, out, "rows", T0 + timedelta(days=2)) == 2 and spark.read.parquet(f"{out}/rows").count() == 4


def test_context_of_services_from_tables(spark):
    forecasts = spark.createDataFrame([("a", "cpu", 1, 0.5), ("a", "cpu", 3, 0.98765), ("a", "mem", 2, 1.0), ("c", "cpu", 1, 2.0)], "service string, metric string, step int, value double")
    predictions = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("a", True)], "service string, is_new_pattern boolean")
    patterns = spark.createDataFrame([("a", i % 4, "ERROR" if i % 4 else "INFO") for i in range(12)] + [("b", 9, "INFO")], "service string, cluster_id bigint, severity string")
    got = {r.service: r for r in R.service_context(forecasts, predictions, patterns, 2).collect()}
    assert {s: (r.predicted_end_values, r.new_patterns_detected, r.n_error_patterns, r.error_patterns, r.total_patterns) for s, r in got.items()} == {
        "a": ({"cpu": 0.9877, "mem": 1.0}, 2, 3, [1, 2], 4), "b": (None, 1, 0, [], 1), "c": ({"cpu": 2.0}, 0, 0, [], 0)}
    assert {r.service: r.error_patterns for r in R.service_context(forecasts, predictions, patterns).collect()}["a"] == [1, 2, 3]


def test_context_lists_everything_by_default(spark):
    one = spark.range(1).select(F.expr("map('m', array(1.0D, 2.0D))").alias("forecasts"), F.expr("array(named_struct('is_new_pattern', true))").alias("recent_predictions"),
                                F.expr("transform(sequence(9, 1), i -> named_struct('cluster_id', i, 'severities', map(if(i < 9, 'ERROR', 'INFO'), 1)))").alias("patterns"))
    r = R.model_context(one).first()
    assert [p.cluster_id for p in r.error_patterns] == list(range(1, 9)) and (r.n_error_patterns, r.total_patterns) == (8, 9)
    few = R.model_context(one, 2).first()
    assert [p.cluster_id for p in few.error_patterns] == [1, 2] and few.n_error_patterns == 8
    rows = spark.range(60).select("id", F.lit("s").alias("service"))
    lines = lambda *most: R.ranked_section(rows, ["service"], "error_logs", [F.col("id")], F.col("id").cast("string"), *most).count()
    assert (lines(), lines(7)) == (60, 7)
