"""The rate on a stream against the batch: files out of order, resets, late samples, a restart from the checkpoint."""
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators.timeseries import counter_increase
from tidewatch.streaming import ingest as I
from tidewatch.streaming.windows import sliding_rate, sliding_rate_stream

T0 = datetime(2024, 3, 1)
SCHEMA = "name string, ts timestamp, value double"


def test_stream_equals_batch(spark, tmp_path):
    rng, rows = random.Random(4), []
    for name, step in (("a", 3), ("b", 11), ("c", 190)):
        at, value = 0.0, 0.0
        while at < 900:
            at += rng.random() * 2 * step
            value = 0.0 if rng.random() < 0.1 else value + rng.choice([0, 1, 2.5])
            rows.append((name, T0 + timedelta(seconds=round(at, 3)), value))
    rows.append(rows[5])                                 # a repeated sample
    files = {}
    for r in rows:                                       # up to 50 seconds out of order, so that files overlap
        files.setdefault(int(((r[1] - T0).total_seconds() + rng.random() * 50) // 150), []).append(r)
    late = ("a", T0 + timedelta(seconds=1), 99.0)
    stream = lambda: sliding_rate_stream(I.file_stream(spark, str(tmp_path / "in"), SCHEMA, "parquet"), ["name"], watermark="60 seconds")

    def run(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        I.start_files(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()

    for k in sorted(files):                              # each run starts anew from the checkpoint
        run(files[k] + ([late] if k == 5 else []))
    run([("end", T0 + timedelta(seconds=3000), 0.0)])
    got = {(r.name, r.eval_ts): r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = sliding_rate(counter_increase(spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["name"]), ["name"], "increase")
    want = {(r.name, r.eval_ts): r.value for r in batch.collect()}
    assert got.keys() == want.keys() and spark.read.parquet(str(tmp_path / "out")).count() == len(got)
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())
