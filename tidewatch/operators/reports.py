"""Rule-based health reports, context lines and incident time lines."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.scalar import fixed, percent_text, title_label, truncate
from tidewatch.functions.series import micros, with_last, with_previous

ANOMALY = "struct<title:string,severity:string,detail:string,affected_resources:array<string>,evidence:string>"
ROOT_CAUSE = "struct<issue:string,probable_cause:string,confidence:double>"
RECOMMENDATION = "struct<action:string,reason:string,priority:string,command:string>"
TIMELINE = "struct<time:string,event:string>"
NO_STRINGS = "array<string>"


def empty(struct: str) -> Column:
    return F.array().cast(f"array<{struct}>")


def present(*items: Column) -> Column:
    """Array of the items that are not null."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def anomaly(title: Column, severity: Column, detail: Column, evidence: Column) -> Column:
    return F.struct(title.alias("title"), severity.alias("severity"), detail.alias("detail"),
                    F.array().cast(NO_STRINGS).alias("affected_resources"), evidence.alias("evidence")).cast(ANOMALY)


def s(c: str) -> Column:
    return F.col(c).cast("string")


def rule_report(stats: DataFrame) -> DataFrame:
    """Health from totals: needs ``total_logs, total_errors, slow_traces``; other columns are kept."""
    logs, errors, slow = (F.coalesce(F.col(c), F.lit(0)) for c in ("total_logs", "total_errors", "slow_traces"))
    rate = errors / F.greatest(logs, F.lit(1))
    pct = F.format_string("%.1f%%", fixed(rate * 100, 1))
    proof = F.concat(errors.cast("string"), F.lit(" errors out of "), logs.cast("string"), F.lit(" logs"))
    high = F.when(rate > 0.1, anomaly(
        F.lit("High error rate"), F.lit("critical"), F.concat(F.lit("Error rate at "), pct, F.lit(" ("), errors.cast("string"), F.lit(" errors)")), proof))
    raised = F.when((rate > 0.02) & (rate <= 0.1), anomaly(
        F.lit("Elevated error rate"), F.lit("medium"), F.concat(F.lit("Error rate at "), pct), proof))
    slowed = F.when(slow > 10, anomaly(
        F.lit("Slow traces detected"), F.when(slow > 20, "high").otherwise("medium"),
        F.concat(slow.cast("string"), F.lit(" slow traces in the last window")),
        F.concat(slow.cast("string"), F.lit(" traces exceeded latency threshold"))))
    health = F.when(rate > 0.1, "CRITICAL").when((rate > 0.02) | (slow > 10), "DEGRADED").otherwise("HEALTHY")
    out = stats.withColumn("anomalies", present(high, raised, slowed))
    return out.withColumns({
        "health_status": health, "confidence": F.lit(0.6),
        "summary": F.concat(F.lit("Rule-based analysis: "), F.array_size("anomalies").cast("string"), F.lit(" issues detected (ML server offline)")),
        "root_causes": empty(ROOT_CAUSE), "recommendations": empty(RECOMMENDATION), "incident_timeline": empty(TIMELINE)})


def model_report(outputs: DataFrame) -> DataFrame:
    """Report from model outputs.

    Expects ``is_anomaly, anomaly_score, if_score, lstm_score, details``, ``breach_alerts`` (array of metric, step,
    predicted_value, threshold, confidence), ``predicted_cause, cause_confidence`` and ``top_causes`` (array of cause,
    probability). Null model outputs mean that the model did not run. Other columns are kept.
    """
    score = F.col("anomaly_score")
    sev = F.when(score > 0.8, "critical").when(score > 0.6, "high").otherwise("medium")
    two = lambda c: F.format_string("%.2f", fixed(F.coalesce(F.col(c), F.lit(0.0)), 2))
    flagged = F.coalesce(F.col("is_anomaly"), F.lit(False))
    found = F.when(flagged, anomaly(
        F.lit("Metric anomaly detected"), sev, F.coalesce(F.col("details"), F.lit("Anomalous pattern detected in system metrics")),
        F.concat(F.lit("Anomaly score: "), two("anomaly_score"), F.lit(" (IF: "), two("if_score"), F.lit(", LSTM: "), two("lstm_score"), F.lit(")"))))
    alerts = F.coalesce(F.col("breach_alerts"), F.array())
    recs = F.transform(F.col("breach_alerts"), lambda a: F.struct(
        F.concat(F.lit("Proactive: "), a["metric"], F.lit(" predicted to breach threshold in "), a["step"].cast("string"), F.lit(" steps")).alias("action"),
        F.concat(F.lit("Predicted value: "), a["predicted_value"].cast("string"), F.lit(", threshold: "), a["threshold"].cast("string"),
                 F.lit(", confidence: "), a["confidence"].cast("string")).alias("reason"),
        F.when(a["confidence"] > 0.8, "immediate").otherwise("short_term").alias("priority"), F.lit("").alias("command")))
    has_cause = F.coalesce(F.col("predicted_cause") != "normal", F.lit(False))
    main = F.struct(
        title_label(F.col("predicted_cause")).alias("issue"),
        F.concat(F.lit("ML classifier identified "), F.col("predicted_cause"), F.lit(" with "), percent_text(F.col("cause_confidence")),
                 F.lit(" confidence")).alias("probable_cause"), F.col("cause_confidence").alias("confidence"))
    others = F.transform(
        F.filter(F.slice("top_causes", 2, 2), lambda t: t["probability"] > 0.1),
        lambda t: F.struct(title_label(t["cause"]).alias("issue"),
                           F.concat(F.lit("Alternative root cause ("), percent_text(t["probability"]), F.lit(")")).alias("probable_cause"),
                           t["probability"].alias("confidence")))
    roots = F.when(has_cause, F.concat(F.array(main), F.coalesce(others, empty(ROOT_CAUSE)))).otherwise(empty(ROOT_CAUSE))
    n_alerts = F.coalesce(F.array_size("breach_alerts"), F.lit(0))
    health = (F.when(flagged & (score > 0.8), "CRITICAL").when(flagged, "DEGRADED").when(n_alerts > 0, "DEGRADED").otherwise("HEALTHY"))
    out = outputs.withColumns({
        "anomalies": present(found), "root_causes": roots.cast(f"array<{ROOT_CAUSE}>"),
        "recommendations": F.coalesce(recs, empty(RECOMMENDATION)), "incident_timeline": empty(TIMELINE),
        "health_status": health, "confidence": F.lit(0.8)})
    n = F.array_size("anomalies")
    return out.withColumn("summary", F.when((n > 0) | (n_alerts > 0), F.concat(
        F.lit("Detected "), n.cast("string"), F.lit(" anomalies and "), n_alerts.cast("string"), F.lit(" forecast alerts. System status: "),
        F.col("health_status"), F.lit("."))).otherwise("All metrics within normal parameters. No anomalies or forecast alerts."))


def status_from_severity(anomalies: Column) -> Column:
    return (F.when(F.exists(anomalies, lambda a: a["severity"] == "critical"), "CRITICAL")
            .when(F.exists(anomalies, lambda a: a["severity"].isin("high", "medium")), "DEGRADED").otherwise("HEALTHY"))


def with_fallback(reports: DataFrame, error: Column) -> DataFrame:
    """Replace rows without a report (null ``health_status``) by the UNKNOWN report that names the error."""
    missing = F.col("health_status").isNull()
    check = F.array(F.struct(
        F.lit("Check ML model server connectivity").alias("action"), F.concat(F.lit("Error: "), error).alias("reason"),
        F.lit("immediate").alias("priority"), F.lit("").alias("command")))
    fill = {
        "confidence": F.lit(0.0), "summary": F.concat(F.lit("ML analysis failed: "), error), "anomalies": empty(ANOMALY),
        "root_causes": empty(ROOT_CAUSE), "recommendations": check, "incident_timeline": empty(TIMELINE), "health_status": F.lit("UNKNOWN")}
    return reports.select(*[c for c in reports.columns if c not in fill],
                          *[F.when(missing, v).otherwise(F.col(k)).alias(k) for k, v in fill.items()])


def stored_analysis(payload: DataFrame) -> DataFrame:
    """Stored form of a report with a default for every missing field."""
    have = set(payload.columns)
    col = lambda c, d: (F.coalesce(F.col(c), d) if c in have else d).alias(c)
    keep = [c for c in payload.columns if c in ("timestamp", "service")]
    performance = F.struct(F.array().cast(NO_STRINGS).alias("bottlenecks"))
    return payload.select(
        *keep, col("health_status", F.lit("UNKNOWN")), col("confidence", F.lit(0.0)), col("summary", F.lit("")),
        col("anomalies", empty(ANOMALY)), col("root_causes", empty(ROOT_CAUSE)), col("performance", performance),
        col("recommendations", empty(RECOMMENDATION)), col("incident_timeline", empty(TIMELINE)), col("raw_response", F.lit("")))


# -- caps of the sections of the registered report context, as its SQL has them --
SECTIONS = {"error_logs": 40, "slow_traces": 20, "error_traces": 20, "k8s_events": 20, "metrics": 15,
            "warning_logs": 20, "degrading": 15, "improving": 10}


def ranked_section(df: DataFrame, run: Sequence[str], section: str, order: Sequence[Column], line: Column, most: int | None = None) -> DataFrame:
    """Lines of one section per run, ranked, all or the first ``most``; with a cap, tasks trim to it before the shuffle."""
    w = Window.partitionBy(*run).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(w))
    return (ranked if most is None else ranked.filter(F.col("rank") <= most)).select(
        *run, F.lit(section).alias("section"), "rank", line.alias("line"))


def log_line(n: int) -> Column:
    return F.concat(F.lit("["), s("timestamp"), F.lit("] "), F.col("service"), F.lit(": "), truncate(F.col("message"), n))


def slow_line() -> Column:
    return F.concat(F.lit("  "), F.col("service"), F.lit(" "), F.col("operation"), F.lit(" — "), s("duration_ms"), F.lit("ms (trace: "),
                    truncate(F.col("trace_id"), 16), F.lit(")"))


def trace_line() -> Column:
    return F.concat(F.lit("  "), F.col("service"), F.lit(" "), F.col("operation"), F.lit(" — "), s("duration_ms"), F.lit("ms"))


def event_line() -> Column:
    return F.concat(F.lit("  "), F.col("reason"), F.lit(": "), F.col("pod"), F.lit(" — "), truncate(F.col("message"), 200))


def degrading_line() -> Column:
    one = lambda c: F.format_string("%.1f", fixed(F.col(c), 1))
    return F.concat(F.lit("  ["), F.col("query"), F.lit("] "), F.col("service"), F.lit(" ("), F.col("range"), F.lit(" window) Change: +"),
                    one("trend_pct"), F.lit("% | Latest: "), s("latest"), F.lit(" | Avg: "), s("avg"), F.lit(" | Volatility(CV): "),
                    one("volatility_cv"), F.lit("%"))


def improving_line() -> Column:
    return F.concat(F.lit("  ["), F.col("query"), F.lit("] "), F.col("service"), F.lit(": "), F.format_string("%.1f", fixed(F.col("trend_pct"), 1)),
                    F.lit("% ("), F.col("direction"), F.lit(")"))


def incident_events(logs: DataFrame, traces: DataFrame, events: DataFrame, event_service: Column) -> DataFrame:
    """Errors, slow traces and warning events in one shape: ``service, timestamp, kind, text``."""
    return (
        logs.filter(F.col("severity") == "ERROR").select("service", "timestamp", F.lit("error").alias("kind"), F.col("message").alias("text"))
        .unionByName(traces.filter("is_slow").select("service", "timestamp", F.lit("slow").alias("kind"), F.col("operation").alias("text")))
        .unionByName(events.filter(F.col("event_type") == "Warning").select(
            event_service.alias("service"), "timestamp", F.lit("event").alias("kind"), F.col("reason").alias("text"))))


def incident_timeline(items: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Incidents: runs of items of a service that are less than the gap apart.

    Starts are found per time block, so neither a busy service nor a long incident lands in one task; the
    incidents themselves are a partial aggregate on ``(service, start)``.
    """
    order = ["timestamp", "kind", "text"]
    seen = with_previous(items, ["service"], order, "timestamp", "timestamp", "_prev")
    fresh = F.col("_prev").isNull() | (micros("timestamp") - micros("_prev") >= gap_seconds * 1_000_000)
    runs = with_last(seen, ["service"], order, "timestamp", F.when(fresh, F.col("timestamp")), "start")
    return runs.groupBy("service", "start").agg(
        F.max("timestamp").alias("end"), F.count_if(F.col("kind") == "error").alias("errors"),
        F.count_if(F.col("kind") == "slow").alias("slow"), F.count_if(F.col("kind") == "event").alias("events"),
        F.min_by("text", F.struct(*order)).alias("first_item"))


def model_context(outputs: DataFrame, listed: int | None = None) -> DataFrame:
    """Compact summary of the models: end value per metric, number of new patterns, error patterns by cluster id, all or the first
    ``listed``, and the number of all of them.

    Expects ``forecasts`` (map of metric to values), ``recent_predictions`` (array with ``is_new_pattern``) and
    ``patterns`` (array with ``cluster_id`` and ``severities`` map)."""
    ends = F.transform_values("forecasts", lambda k, v: F.round(F.element_at(v, -1), 4))
    fresh = F.array_size(F.filter("recent_predictions", lambda p: p["is_new_pattern"]))
    errors = F.filter("patterns", lambda p: F.array_contains(F.map_keys(p["severities"]), "ERROR"))
    in_turn = F.array_sort(errors, lambda p, q: F.when(p["cluster_id"] < q["cluster_id"], -1).when(p["cluster_id"] > q["cluster_id"], 1).otherwise(0))
    return outputs.withColumns({"predicted_end_values": ends, "new_patterns_detected": fresh, "n_error_patterns": F.array_size(errors),
                                "error_patterns": in_turn if listed is None else F.slice(in_turn, 1, listed),
                                "total_patterns": F.array_size("patterns")})


def service_context(forecasts: DataFrame, predictions: DataFrame, patterns: DataFrame, listed: int | None = None) -> DataFrame:
    """The same summary per service from tables of any length: ``service, predicted_end_values, new_patterns_detected, n_error_patterns, error_patterns,
    total_patterns`` for every service of the three tables.

    ``forecasts``: service, metric, step, value; ``predictions``: service, is_new_pattern, a row per line; ``patterns``: service, cluster_id, severity, a row
    per line. Only metrics and the listed clusters of a service become one row; ``listed`` bounds the latter."""
    last = forecasts.groupBy("service", "metric").agg(F.round(F.max_by("value", "step"), 4).alias("value"))
    ends = last.groupBy("service").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("predicted_end_values"))
    fresh = predictions.groupBy("service").agg(F.count_if("is_new_pattern").alias("new_patterns_detected"))
    each = patterns.groupBy("service", "cluster_id").agg((F.count_if(F.col("severity") == "ERROR") > 0).alias("bad"))
    counts = each.groupBy("service").agg(F.count(F.lit(1)).alias("total_patterns"), F.count_if("bad").alias("n_error_patterns"))
    bad = each.filter("bad")
    if listed is not None:
        bad = bad.withColumn("_r", F.row_number().over(Window.partitionBy("service").orderBy("cluster_id"))).filter(F.col("_r") <= listed)
    names = bad.groupBy("service").agg(F.array_sort(F.collect_list("cluster_id")).alias("error_patterns"))
    every = forecasts.select("service").union(predictions.select("service")).union(patterns.select("service")).distinct()
    out = every
    for part in (ends, fresh, counts, names):
        out = out.join(part, "service", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("new_patterns_detected", "total_patterns", "n_error_patterns")}
    return out.withColumns({**zero, "error_patterns": F.coalesce("error_patterns", F.array().cast("array<bigint>"))})


def has_data(*tables: DataFrame) -> DataFrame:
    """One row: is there any row in any table? Each table contributes at most one row."""
    heads = [t.select(F.lit(1).alias("x")).limit(1) for t in tables]
    rows = heads[0]
    for h in heads[1:]:
        rows = rows.unionAll(h)
    return rows.agg((F.count("x") > 0).alias("has_data"))
