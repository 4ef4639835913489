"""The full analysis: log patterns beside the metric models."""
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidewatch.constants import FEATURES
from tidewatch.ml import logs as L
from tidewatch.ml import pipeline as P
from tidewatch.ml.iforest import grow
from tidewatch.operators import windows as W

START = datetime(2024, 1, 1)
LINES = "id long, timestamp timestamp_ntz, service string, message string, severity string"
SAID = [("Connection refused to db {} by pool", "ERROR"), ("Served page {} in time", "INFO"), ("Cache evicted entry {} early", "WARN")]


def hour(h, minutes=0):
    return START + timedelta(hours=h, minutes=minutes)


def log_lines(hours, services=("a", "b", "only logs")):
    """Lines of three patterns in changing numbers, and one line of a kind that never returns per service."""
    out = []
    for s, service in enumerate(services):
        for h in hours:
            out += [(hour(h, 7 * k), service, SAID[(h + k + s) % 3][0].format(h * 10 + k), SAID[(h + k + s) % 3][1]) for k in range((h + s) % 4)]
        out.append((hour(hours[0], 59), service, f"something quite different {'xyz'[s] * 4} here", "INFO"))
    return [(i, *line) for i, line in enumerate(out)]


def expected(lines, spans, cluster):
    """``{(service, window): (lines, new, {cluster: (lines, errors)})}`` by going through all lines and windows."""
    inside = defaultdict(list)
    for line in lines:
        _, at, service, message, severity = line
        at = at and at.replace(minute=0, second=0, microsecond=0)
        hits = [w for w, (s, first, last) in spans.items() if at is not None and s == service and first <= at <= last]
        for w in hits or [None]:
            inside[service, w].append((cluster[message], severity == "ERROR"))
    return {k: (len(v), sum(c == -1 for c, _ in v), {c: (n, sum(e for d, e in v if d == c)) for c, n in Counter(c for c, _ in v if c != -1).items()}) for k, v in inside.items()}


def found(rows):
    return {(r.service, r.window_id): (r.log_lines, r.new_patterns_detected, {p.cluster_id: (p.lines, p.errors) for p in r.log_patterns}) for r in rows}


def test_patterns_of_windows(spark):
    hours = [0, 1, 2, 3, 9, 10, 11, 12, 13]                    # the metrics have a gap of five hours
    metrics = [(s, hour(h)) for s in ("a", "b") for h in hours] + [("short", hour(0))]
    windows = W.slide_rows(spark.createDataFrame(metrics, "service string, timestamp timestamp_ntz"), 4, 2)
    spans = {r.window_id: (r.service, r.first, r.last) for r in windows.groupBy("window_id", "service").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).collect()}
    assert len(spans) == 6
    lines = log_lines(range(-2, 20), ("a", "b", "only logs", "short")[:3])
    lines += [(1000, hour(1), None, "Served page 1 in time", "INFO"), (1001, None, "a", "Served page 1 in time", "INFO"), (1001, hour(5, 30), "a", "Served page 1 in time", None), (1001, hour(5, 30), "a", "Served page 1 in time", None)]
    logs = spark.createDataFrame(lines, LINES)
    clusters = L.cluster(logs)
    summary = L.pattern_summary(L.patterns(L.with_cluster(logs, clusters)))
    assigned = L.assign(logs, clusters)
    cluster = {r.message: r.cluster_id for r in assigned.collect()}
    assert len(set(cluster.values())) == 4 and -1 in cluster.values()
    rows = L.window_patterns(assigned, windows, summary).collect()
    want = expected(lines, spans, cluster)
    assert len(rows) == len(want) and found(rows) == want
    assert {k for k in want if k[1] is None} == {("a", None), ("b", None), ("only logs", None), (None, None)}
    names = {r.cluster_id: (r.label, r.size) for r in summary.collect()}
    assert all((p.label, p.size) == names[p.cluster_id] for r in rows for p in r.log_patterns)
    assert all([p.cluster_id for p in r.log_patterns] == sorted(p.cluster_id for p in r.log_patterns) for r in rows)


def test_full_analysis_has_log_patterns(spark):
    rng = np.random.default_rng(5)
    metrics = [(s, hour(h), "normal", *map(float, rng.uniform(1, 2, len(FEATURES)))) for s in ("a", "b") for h in range(90)]
    wide = spark.createDataFrame(metrics, "service string, timestamp timestamp_ntz, label string, " + ", ".join(f"{f} double" for f in FEATURES))
    windows = W.slide_rows(wide)
    forest, rec = P.fit_anomaly(wide, W.rich_stats(windows))
    models = P.Models(forest, rec, P.fit_forecaster(wide), None)
    lines = [line for line in log_lines(range(95)) if line[2] != "b" or line[1] >= hour(61)]
    logs = spark.createDataFrame([*lines, (5000, hour(2), "a", None, "INFO")], LINES)
    clusters = L.cluster(logs)
    cluster = {r.message: r.cluster_id for r in L.assign(logs, clusters).collect()}
    rows = P.full_analysis(models, windows, logs, clusters).collect()
    spans = {f"real_{s}_{w}": (s, hour(15 * w), hour(15 * w + 59)) for s in ("a", "b") for w in range(3)}
    want = expected(lines, spans, cluster)
    silent = ("b", "real_b_0")                                # no lines in this window: it is reported all the same
    assert silent not in want and {(r.service, r.window_id) for r in rows} == {*want, silent} and len(rows) == len(want) + 1
    assert found(rows) == {**want, silent: (0, 0, {})} and {r.total_patterns for r in rows} == {3}
    scores = {r.window_id: r.anomaly_score for r in P.score_windows(models, windows).collect()}
    assert {r.window_id: r.anomaly_score for r in rows if r.window_id} == scores and {r.service for r in rows if r.window_id is None} == {"a", "b", "only logs"}
    assert all(r.health_status and r.summary for r in rows)


def test_splits_between_neighbouring_numbers():
    x = np.array([[1.0, 0.0], [np.nextafter(1.0, 2.0), 0.0]] * 8)
    for seed in range(20):
        nodes = grow(x, np.random.default_rng(seed))
        assert nodes[0][:2] == (0, x[1, 0]) and len(nodes) == 3
