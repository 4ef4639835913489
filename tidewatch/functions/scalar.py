"""Column expressions: text, time, JSON, map and array functions. No Python runs per row."""
from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tidewatch.constants import METRIC_TO_FEATURE, SEVERITY_PATTERNS, SLOW_MS


def severity(message: Column) -> Column:
    """First pattern group found in the lower-cased message; INFO when none is."""
    text = F.lower(message)
    out = F.lit("INFO")
    for name, pattern in reversed(SEVERITY_PATTERNS):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def trace_flags(duration_ms: Column, status_code: Column) -> tuple[Column, Column]:
    """``(is_slow, has_error)``; missing duration and status count as 0."""
    return F.coalesce(duration_ms, F.lit(0.0)) > SLOW_MS, F.coalesce(status_code, F.lit(0)) == 2


def service_of(labels: Column, default: str = "unknown", *, keys: tuple[str, ...] = ("service_name", "job")) -> Column:
    return F.coalesce(*[F.try_element_at(labels, F.lit(k)) for k in keys], F.lit(default))


def lenient_json(text: Column, schema: T.DataType | str) -> Column:
    """Parse JSON text as ``schema``; anything that is not valid gives an empty array, map or null struct."""
    parsed = F.from_json(text, schema)
    kind = schema if isinstance(schema, str) else schema.simpleString()
    if kind.lower().startswith("array"):
        return F.coalesce(parsed, F.array().cast(schema))
    if kind.lower().startswith("map"):
        return F.coalesce(parsed, F.create_map().cast(schema))
    return parsed


def flatten_labels(labels: Column) -> Column:
    pairs = F.transform(F.map_entries(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(pairs, ", "), F.lit(""))


def json_text(value: Column) -> Column:
    """Compact JSON text; null becomes the empty string."""
    return F.coalesce(F.to_json(value), F.lit(""))


def strip_fence(text: Column) -> Column:
    """Remove code-fence lines around a text."""
    return F.trim(F.regexp_replace(F.trim(text), r"(?m)^```.*$\n?", ""))


def json_block(text: Column) -> Column:
    """The text itself when it is JSON, else its widest ``{…}`` part when that is, else null."""
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    ok = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(ok(text), text).when((block != "") & ok(block), block)


def first_int(text: Column) -> Column:
    """First whitespace-separated token that is an integer (commas removed), else 0."""
    tokens = F.filter(F.split(F.trim(text), r"\s+"), lambda t: F.replace(t, F.lit(","), F.lit("")).rlike(r"^[+-]?\d+$"))
    return F.coalesce(F.replace(F.get(tokens, F.lit(0)), F.lit(","), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def to_number(text: Column) -> Column:
    return text.try_cast("double")


def feature_of(metric_name: Column) -> Column:
    """Canonical feature of a source metric name; null when it is not one of the eight."""
    lookup = F.create_map(*[F.lit(x) for kv in METRIC_TO_FEATURE.items() for x in kv])
    return F.try_element_at(lookup, metric_name)


def short_service(service: Column) -> Column:
    return F.replace(service, F.lit("-service"), F.lit(""))


def pretty_query(name: Column) -> Column:
    return F.replace(F.regexp_replace(name, "_1h|_24h", ""), F.lit("_"), F.lit(" "))


def format_value(query: Column, value: Column) -> Column:
    """Megabytes for heap and memory queries, otherwise decimals by magnitude; null gives a dash."""
    is_bytes = query.contains("heap") | query.contains("memory")
    return (
        F.when(value.isNull(), "—")
        .when(is_bytes, F.format_string("%.0f MB", fixed(value / 1024 / 1024, 0)))
        .when(value < 0.01, F.format_string("%.4f", fixed(value, 4)))
        .when(value < 1, F.format_string("%.3f", fixed(value, 3)))
        .when(value > 1000, F.format_string("%.0f", fixed(value, 0)))
        .otherwise(F.format_string("%.2f", fixed(value, 2)))
    )


def title_label(label: Column) -> Column:
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def percent_text(p: Column) -> Column:
    return F.format_string("%.0f%%", fixed(p * 100, 0))


def from_epoch_ns(text: Column) -> Column:
    """Nanosecond text to timestamp (microseconds are kept)."""
    return F.timestamp_micros(F.call_function("div", text.try_cast("bigint"), F.lit(1000))).cast("timestamp_ntz")


def from_epoch_seconds(text: Column) -> Column:
    return F.timestamp_seconds(text.try_cast("bigint")).cast("timestamp_ntz")


def parse_iso(text: Column, fallback: Column) -> Column:
    """ISO timestamp with ``Z`` or offset; null, empty or bad text gives ``fallback``."""
    return F.coalesce(text.try_cast("timestamp"), fallback.cast("timestamp")).cast("timestamp_ntz")


def parse_range_seconds(text: Column) -> Column:
    """``15m``, ``24h``, ``7d`` to seconds; an unknown unit means one hour."""
    n = F.regexp_extract(text, r"^(\d+)", 1).try_cast("bigint")
    unit = F.substring(text, -1, 1)
    return F.when(unit == "h", n * 3600).when(unit == "d", n * 86400).when(unit == "m", n * 60).otherwise(F.lit(3600)).cast("bigint")


def fixed(c: Column | str, n: int) -> Column:
    """Half-up rounding that ignores the last bits of a sum, so that ties do not depend on the order of addition."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.round(c, n + 4), n)
