"""Trends from partial sums against the statistics of all samples."""
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators.trends import series_stats
from tidewatch.streaming import ingest as I
from tidewatch.streaming import trends as TR

T0 = datetime(2024, 3, 1, 23, 50, 20)
SCHEMA = "name string, ts timestamp_ntz, id long, value string"


def test_batches_in_any_order_equal_all_samples(spark, tmp_path):
    rng, rows = random.Random(6), []
    for name, n in (("a", 400), ("b", 37), ("c", 2), ("d", 1), ("big", 300)):
        for i in range(n):
            value = 1e9 + rng.random() if name == "big" else rng.choice([rng.gauss(5, 3), 0.0])
            rows.append((name, T0 + timedelta(seconds=rng.randrange(1500)), len(rows), str(value)))
    rows += [("a", T0 + timedelta(seconds=9), 10**6, "no number"), ("none", T0 + timedelta(seconds=9), 10**6, None), ("old", T0 - timedelta(days=3), 5, "1"), ("edge", T0, 6, "1")]
    rng.shuffle(rows)
    root, start = str(tmp_path / "t"), T0
    batches = [rows[k::5] for k in range(5)]
    for k, batch in enumerate(batches):
        out = TR.add_batch(spark.createDataFrame(batch, SCHEMA), k, root, ["name"], ["ts", "id"], start)
        I.publish(out, f"{root}/trends", k)
        TR.keep_newest(spark, f"{root}/trends", k)
    TR.add_batch(spark.createDataFrame(batches[2], SCHEMA), 2, root, ["name"], ["ts", "id"], start)        # a replay changes nothing
    again = TR.merged_stats(spark.read.parquet(f"{root}/partials"), ["name"], ["ts", "id"], start)
    every = spark.createDataFrame([r for r in rows if r[1] > start], SCHEMA)
    want = {r.name: r.asDict() for r in series_stats(every, ["name"], ["ts", "id"], "ts").collect()}
    for got in (I.read_published(spark, f"{root}/trends"), again):
        got = {r.name: r.asDict() for r in got.collect()}
        assert got.keys() == want.keys() == {"a", "b", "c", "d", "big"}
        for name, w in want.items():
            for column, v in w.items():
                assert got[name][column] == v if isinstance(v, (str, int)) else abs(got[name][column] - v) <= 1e-7 * max(1, abs(v)), (name, column)
    assert sorted(p.name for p in (tmp_path / "t" / "trends").glob("version=*")) == ["version=3", "version=4"]
    assert not list((tmp_path / "t" / "partials").glob("date=2024-02-27")) and len(list((tmp_path / "t").iterdir())) == 2     # no samples are stored
    assert TR.merged_stats(spark.read.parquet(f"{root}/partials").limit(0), ["name"], ["ts", "id"], start).collect() == []
    assert TR.partial_sums(every.limit(0), ["name"], ["ts", "id"]).select(F.sum("n")).first()[0] is None
