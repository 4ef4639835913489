"""Time-series operators on long sample tables (one row per series and time).

A rate is the reset-aware increase of the samples in ``(t - range, t]`` divided by the range, without edge
extrapolation. Increases are additive, so every grid evaluation first sums per step bucket (map-side combine)
and only then copies the small bucket rows to the grid points that cover them: an equi plan, no range join.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.series import floor_ts, from_micros, micros, with_previous


def counter_increase(samples: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value", order: Sequence[str] | None = None) -> DataFrame:
    """Add ``increase``: growth since the preceding sample; after a reset the sample itself; 0 for the first. Samples of one time go by ``order``,
    else by their value."""
    seen = with_previous(samples, keys, list(order or [ts, value]), ts, value, "_prev")
    grown = F.when(F.col("_prev").isNull(), 0.0).when(F.col(value) < F.col("_prev"), F.col(value)).otherwise(F.col(value) - F.col("_prev"))
    return seen.withColumn("increase", grown).drop("_prev")


def on_grid(
    samples: DataFrame, keys: Sequence[str], end: datetime, step: int, range_s: int, span: int | None = None,
    ts: str = "ts", value: str = "value", last_of: str | None = None,
) -> DataFrame:
    """Evaluate at ``end - j * step``: count, sum and last of the samples in the trailing range.

    ``step``, ``range_s`` and ``span`` are seconds; without ``span`` the grid reaches back over all data.
    """
    us = 1_000_000
    end_us = micros(F.lit(end).cast("timestamp_ntz"))
    rows = samples.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    if span is not None:
        rows = rows.filter(F.col(ts) > F.lit(end - timedelta(seconds=span + range_s)).cast("timestamp_ntz"))
    age = end_us - micros(ts)
    newest = F.struct(F.col(ts).alias("at"), F.col(last_of or value).alias("v"))
    last = F.max(newest)
    # Buckets that both the step and the range are made of; a point covers a whole number of them.
    width = math.gcd(step, range_s)
    per_step, per_range = step // width, range_s // width
    rows = rows.groupBy(*keys, F.floor(age / (width * us)).cast("bigint").alias("_b")).agg(F.count(value).alias("n"), F.sum(value).alias("total"), last.alias("last"))
    low = F.floor((F.col("_b") - per_range + per_step) / per_step).cast("bigint")
    newest_point = F.floor(F.col("_b") / per_step).cast("bigint")
    high = newest_point if span is None else F.least(newest_point, F.lit(span // step))
    points = rows.withColumn("_low", F.greatest(low, F.lit(0))).withColumn("_high", high).filter("_low <= _high").withColumn(
        "_j", F.explode(F.sequence("_low", "_high")))
    out = points.groupBy(*keys, "_j").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last").alias("last"))
    return out.select(*keys, from_micros(end_us - F.col("_j") * (step * us)).alias("eval_ts"), "n", "total", F.col("last.v").alias("last"))


def recent(samples: DataFrame, end: datetime, range_s: int, span: int | None, ts: str = "ts") -> DataFrame:
    """Samples that an evaluation can touch, plus one more range to find the preceding sample of a counter."""
    if span is None:
        return samples
    return samples.filter(F.col(ts) > F.lit(end - timedelta(seconds=span + 2 * range_s)).cast("timestamp_ntz"))


def rate(samples: DataFrame, keys: Sequence[str], end: datetime, step: int, range_s: int, span: int | None = None, ts: str = "ts",
         value: str = "value", order: Sequence[str] | None = None) -> DataFrame:
    inc = counter_increase(recent(samples, end, range_s, span, ts), keys, ts, value, order)
    return on_grid(inc, keys, end, step, range_s, span, ts, "increase").select(*keys, "eval_ts", (F.col("total") / range_s).alias("value"))


def sum_by(vector: DataFrame, labels: Sequence[str]) -> DataFrame:
    return vector.groupBy(*labels, "eval_ts").agg(F.sum("value").alias("value"))


def quantile_of(hist: Column, q: float) -> Column:
    """Quantile of a sorted array of ``(le, c)`` structs with cumulative counts ``c``.

    Linear inside a bucket; the first bucket starts at 0; in the infinite bucket the highest finite bound;
    null for an empty histogram.
    """
    total = F.element_at(hist, -1)["c"]
    want = total * q
    i = F.array_position(F.transform(hist, lambda b: b["c"] >= want), F.lit(True)).cast("int")     # 1-based
    here, before = F.element_at(hist, i), F.get(hist, i - 2)
    low, base = F.coalesce(before["le"], F.lit(0.0)), F.coalesce(before["c"], F.lit(0.0))
    inside = F.when(here["c"] == base, here["le"]).otherwise(low + (here["le"] - low) * (want - base) / (here["c"] - base))
    return F.when(total > 0, F.when(here["le"] == float("inf"), before["le"]).otherwise(inside))


def histogram(cum: str) -> Column:
    """Aggregate: the buckets of a group as a sorted array. A group has one row per bound, not per sample."""
    return F.array_sort(F.collect_list(F.struct("le", F.col(cum).cast("double").alias("c"))))


def histogram_quantiles(buckets: DataFrame, keys: Sequence[str], qs: Sequence[float], cum: str = "cum") -> DataFrame:
    """Quantiles of cumulative ``le`` buckets, one column ``q0, q1, …`` per requested quantile."""
    hist = buckets.groupBy(*keys).agg(histogram(cum).alias("h"))
    return hist.select(*keys, *[quantile_of(F.col("h"), q).alias(f"q{k}") for k, q in enumerate(qs)])


@dataclass(frozen=True)
class Matcher:
    """Label selector: ``=``, ``!=``, ``=~`` or ``!~``; patterns are anchored at both ends."""
    label: str
    op: str
    text: str

    def column(self) -> Column:
        c = F.coalesce(F.col(self.label), F.lit(""))
        if self.op in ("=", "!="):
            hit = c == self.text
        elif self.op in ("=~", "!~"):
            hit = c.rlike(f"^(?:{self.text})$")
        else:
            raise ValueError(f"unknown matcher {self.op}")
        return ~hit if self.op.startswith("!") else hit


def label_match(df: DataFrame, matchers: Sequence[Matcher]) -> DataFrame:
    for m in matchers:
        df = df.filter(m.column())
    return df


def instant(samples: DataFrame, keys: Sequence[str], as_of: datetime, staleness: int = 300, ts: str = "ts", value: str = "value") -> DataFrame:
    """Latest sample of each series in ``(as_of - staleness, as_of]``; of samples of one time the largest."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    live = samples.filter((F.col(ts) <= at(as_of)) & (F.col(ts) > at(as_of - timedelta(seconds=staleness))))
    return live.groupBy(*keys).agg(F.max_by(value, F.struct(ts, value)).alias("value"), F.max(ts).alias(ts))


def dedup_scrape(samples: DataFrame, keys: Sequence[str], seconds: int = 15, ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Keep the latest sample of each series in each scrape interval; of samples of one time that with the largest ``tie`` columns, else columns."""
    rest = [c for c in samples.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    order = F.struct(F.col(ts), *[F.col(c) for c in tie or rest])
    kept = samples.groupBy(*keys, floor_ts(ts, seconds).alias("_w")).agg(F.max_by(row, order).alias("r"))
    return kept.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


# -- fixed values: age limit in days and bucket width in seconds of the resolution tiers --
TIERS = [(7, None), (30, 300), (None, 3600)]


def downsample(samples: DataFrame, keys: Sequence[str], as_of: datetime, ts: str = "ts") -> DataFrame:
    """Keep raw samples up to seven days, the last sample per five minutes up to thirty, then per hour. Raw rows are not shuffled.

    Of samples of one time the one with the largest columns counts."""
    age = lambda days: F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz")
    raw = samples.filter(F.col(ts) >= age(TIERS[0][0]))
    old = samples.filter(F.col(ts) < age(TIERS[0][0]))
    width = F.when(F.col(ts) >= age(TIERS[1][0]), F.lit(TIERS[1][1] * 1_000_000)).otherwise(F.lit(TIERS[2][1] * 1_000_000)).cast("bigint")
    bucket = micros(ts) - F.pmod(micros(ts), width)
    rest = [c for c in samples.columns if c not in keys]
    kept = old.groupBy(*keys, width.alias("_w"), bucket.alias("_b")).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(ts, *rest)).alias("r"))
    return raw.unionByName(kept.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*samples.columns))


def retain(samples: DataFrame, as_of: datetime, days: int = 30, ts: str = "ts") -> DataFrame:
    return samples.filter(F.col(ts) >= F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz"))


def relabel(samples: DataFrame, keep: Sequence[Matcher], promote: str, labels: str = "labels") -> DataFrame:
    """Keep the series whose labels match, then promote resource attributes (a map column) to labels; labels win."""
    for m in keep:
        c = F.coalesce(F.try_element_at(F.col(labels), F.lit(m.label)), F.lit(""))
        hit = c.rlike(f"^(?:{m.text})$") if "~" in m.op else c == m.text
        samples = samples.filter(~hit if m.op.startswith("!") else hit)
    extra = F.map_filter(F.coalesce(F.col(promote), F.create_map().cast("map<string,string>")),
                         lambda k, v: ~F.map_contains_key(F.col(labels), k))
    return samples.withColumn(labels, F.map_concat(labels, extra)).drop(promote)


@dataclass(frozen=True)
class Definition:
    """A named evaluation: ``kind`` is rate, errors, quantile or gauge."""
    name: str
    kind: str
    metric: str
    range_s: int
    q: float | None = None
    span: int = 0
    step: int = 15
    text: str = ""


# -- fixed values: the seven instant definitions (trailing two minutes) -------
INSTANT_PACK = [
    Definition("http_request_rate", "rate", "http_server_request_duration_seconds_count", 120),
    Definition("http_latency_p50", "quantile", "http_server_request_duration_seconds_bucket", 120, 0.50),
    Definition("http_latency_p99", "quantile", "http_server_request_duration_seconds_bucket", 120, 0.99),
    Definition("http_error_rate", "errors", "http_server_request_duration_seconds_count", 120),
    Definition("jvm_memory_used", "gauge", "jvm_memory_used_bytes", 300),
    Definition("jvm_gc_duration", "rate", "jvm_gc_duration_seconds_sum", 120),
    Definition("active_threads", "gauge", "jvm_threads_live_threads", 300),
]

# -- fixed values: the eight range definitions --------------------------------
TREND_PACK = [
    Definition("request_rate_1h", "rate", "http_server_request_duration_seconds_count", 300, None, 3600, 60, "Request rate per service over last hour"),
    Definition("latency_p99_1h", "quantile", "http_server_request_duration_seconds_bucket", 300, 0.99, 3600, 60, "P99 latency trend over last hour"),
    Definition("latency_p50_1h", "quantile", "http_server_request_duration_seconds_bucket", 300, 0.50, 3600, 60, "P50 latency trend over last hour"),
    Definition("error_rate_1h", "errors", "http_server_request_duration_seconds_count", 300, None, 3600, 60, "5xx error rate trend over last hour"),
    Definition("jvm_heap_used_1h", "gauge", "jvm_memory_used_bytes", 300, None, 3600, 60, "JVM heap memory trend (detect leaks)"),
    Definition("jvm_gc_pause_1h", "rate", "jvm_gc_duration_seconds_sum", 300, None, 3600, 60, "GC pause rate trend"),
    Definition("request_rate_24h", "rate", "http_server_request_duration_seconds_count", 900, None, 86400, 900, "Request rate over 24 hours (daily pattern)"),
    Definition("latency_p99_24h", "quantile", "http_server_request_duration_seconds_bucket", 900, 0.99, 86400, 900, "P99 latency over 24 hours"),
]


def evaluate_pack(samples: DataFrame, definitions: Sequence[Definition], end: datetime, scale: int = 1, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Evaluate definitions on one long sample table ``metric, service, status, le, ts, value``.

    ``scale`` multiplies ranges, steps and spans (for data sampled more coarsely). Result: ``query_name, service,
    eval_ts, value``. All definitions on the same grid share one pass: one increase per sample, one grid, one
    small aggregate.
    """
    grids: dict[tuple[int, int, int], list[Definition]] = {}
    for d in definitions:
        grids.setdefault((d.range_s * scale, d.span * scale, d.step * scale), []).append(d)
    parts = []
    for (range_s, span, step), defs in grids.items():
        mine = recent(samples.filter(F.col("metric").isin(*{d.metric for d in defs})), end, range_s, span)
        buckets = [d.metric for d in defs if d.kind == "quantile"]
        inc = counter_increase(mine, ["metric", "service", "status", "le"], order=order)
        if buckets:
            inc = inc.withColumn("status", F.when(F.col("metric").isin(*buckets), "").otherwise(F.col("status")))
        vec = on_grid(inc, ["metric", "service", "status", "le"], end, step, range_s, span, value="increase", last_of="value")
        failed = Matcher("status", "=~", "5..").column()
        per = vec.groupBy("metric", "service", "eval_ts").agg(
            (F.sum("total") / range_s).alias("rate"), (F.sum(F.when(failed, F.col("total"))) / range_s).alias("errors"),
            F.max("last").alias("gauge"), histogram("total").alias("h"))
        value = {"rate": lambda d: F.col("rate"), "errors": lambda d: F.col("errors"), "gauge": lambda d: F.col("gauge"),
                 "quantile": lambda d: quantile_of(F.col("h"), d.q)}
        rows = F.array(*[F.when((F.col("metric") == d.metric) & (F.lit(d.kind != "errors") | F.col("errors").isNotNull()),
                                F.struct(F.lit(d.name).alias("query_name"), value[d.kind](d).alias("value"))) for d in defs])
        parts.append(per.select("service", "eval_ts", F.inline(F.filter(rows, lambda x: x.isNotNull()))).select(
            "query_name", "service", "eval_ts", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
