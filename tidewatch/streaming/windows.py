"""Windowed aggregates that run the same on batch and streaming frames."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import DoubleType, StructField, StructType, TimestampType


def sliding_rate(increases: DataFrame, keys: Sequence[str], increase: str, ts: str = "ts", window_s: int = 120, slide_s: int = 15) -> DataFrame:
    """Rate over a trailing window, evaluated at every slide; ``eval_ts`` is the window end.

    A batch is summed per slide first, and only these sums are copied to the windows that cover them; a stream sums per window.
    """
    if not increases.isStreaming and window_s % slide_s == 0:
        sums = increases.groupBy(*keys, F.window(ts, f"{slide_s} seconds").alias("w")).agg(F.sum(increase).alias("s"))
        ends = F.transform(F.sequence(F.lit(0), F.lit(window_s // slide_s - 1)), lambda j: F.timestamp_micros(F.unix_micros(F.col("w.end").cast("timestamp")) + j * slide_s * 1_000_000))
        spread = sums.select(*keys, F.explode(ends).alias("e"), "s").groupBy(*keys, "e").agg((F.sum("s") / window_s).alias("value"))
        kind = increases.schema[ts].dataType
        return spread.select(*keys, F.col("e").cast(kind).alias("eval_ts"), "value")
    w = F.window(ts, f"{window_s} seconds", f"{slide_s} seconds")
    return increases.groupBy(*keys, w).agg((F.sum(increase) / window_s).alias("value")).select(*keys, F.col("window.end").alias("eval_ts"), "value")


RATE_STATE = "last double, done long, times array<long>, values array<double>, starts array<long>, sums array<double>"


def sliding_rate_stream(samples: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts", window_s: int = 120, slide_s: int = 15, watermark: str = "30 seconds") -> DataFrame:
    """Rate of a counter on a stream of samples: ``keys, eval_ts, value``, equal to ``counter_increase`` and ``sliding_rate`` on a batch.

    ``ts`` is a timestamp column. The increase of a sample depends on the one before, so samples wait until the watermark has passed them and are then
    taken in order of time and value; a window is given out once, when the watermark passes its end. Samples behind the watermark are dropped. The
    state of a series is its last sample, the samples that wait, and the sums of the slides that open windows still need: no more than
    what arrives within the watermark's delay and a window. A series is one key, so its samples of one trigger meet in one task.
    """
    if window_s % slide_s:
        raise ValueError("the window has to be a whole number of slides")
    window, slide = window_s * 1_000_000, slide_s * 1_000_000
    schema = StructType([*[samples.schema[k] for k in keys], StructField("eval_ts", TimestampType()), StructField("value", DoubleType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, done, times, values, starts, sums = state.get if state.exists else (None, None, [], [], [], [])
        waiting = list(zip(times, values))
        limit = state.getCurrentWatermarkMs() * 1000
        for batch in batches:
            for t, v in zip(batch["_us"].tolist(), batch["_v"].tolist()):
                if t >= limit and v == v:
                    waiting.append((t, v))
        waiting.sort()
        ready = [x for x in waiting if x[0] < limit]
        waiting = waiting[len(ready) :]
        slides = dict(zip(starts, sums))
        for t, v in ready:
            grown = 0.0 if last is None else v if v < last else v - last
            slides[t - t % slide] = slides.get(t - t % slide, 0.0) + grown
            last = v
        upto = limit - limit % slide                                          # windows that end here hold no sample that can still come
        ends = sorted({e for s in slides for e in range(s + slide, s + window + slide, slide) if e <= upto and (done is None or e > done)})
        rows = [sum(slides.get(e - k * slide, 0.0) for k in range(window // slide, 0, -1)) / window_s for e in ends]
        done = max(upto, done or upto)
        slides = {s: x for s, x in slides.items() if s + window > done}
        if waiting or slides or last is not None:
            state.update((last, done, [t for t, _ in waiting], [v for _, v in waiting], list(slides), list(slides.values())))
        if waiting or slides:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + slide_s * 1000)
        if ends:
            out = pd.DataFrame({"eval_ts": pd.to_datetime(ends, unit="us"), "value": rows})
            for k, v in reversed(list(zip(keys, key))):
                out.insert(0, k, v)
            yield out

    shaped = samples.withWatermark(ts, watermark).select(*keys, ts, F.unix_micros(ts).alias("_us"), F.col(value).cast("double").alias("_v"))
    return shaped.groupBy(*keys).applyInPandasWithState(step, schema, RATE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def tumbling_severity(logs: DataFrame, ts: str = "timestamp", width: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """Log count per window and severity; with ``watermark`` on a stream, late rows are dropped and windows close."""
    if watermark:
        logs = logs.withWatermark(ts, watermark)
    counts = logs.groupBy(F.window(ts, width), "severity").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "severity", "n")
