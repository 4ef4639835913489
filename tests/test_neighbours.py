"""Neighbours by a projection forest, and oversampling between them."""
import numpy as np
from pyspark.ml.functions import array_to_vector

from tidewatch.ml import neighbours as N
from tidewatch.ml import rootcause as RC


def table(spark, x, y):
    rows = [(f"{i:05d}", float(y[i]), x[i].tolist(), "kept apart") for i in range(len(x))]
    return spark.createDataFrame(rows, "id string, y double, v array<double>, node string").select("id", "y", array_to_vector("v").alias("features"), "node")


def plain(x, y, k):
    out = {}
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[(y != y[i]) | (np.arange(len(x)) == i)] = np.inf
        out[f"{i:05d}"] = [(f"{j:05d}", d[j]) for j in np.lexsort((np.arange(len(x)), d))[:k] if np.isfinite(d[j])]
    return out


def cases():
    """Classes of vectors with up to eight components."""
    rng = np.random.default_rng(5)
    yield rng.normal(size=(300, 4))
    yield np.sort(rng.exponential(1e6, size=(300, 1)), axis=0)
    x = rng.normal(size=(300, 8))
    x[:120], x[120:160] = x[0], x[120]                   # copies: more than a third of all rows
    yield x
    yield np.stack(np.meshgrid(*[np.arange(7.0)] * 3), -1).reshape(-1, 3)
    yield from (np.arange(2.0 * n).reshape(-1, 2) for n in (12, 2, 1, 5))
    yield 1 + np.arange(200.0).reshape(-1, 1) * 1e-15 * np.ones(3)


def test_exact_neighbours(spark):
    parts = [np.pad(c, ((0, 0), (0, 8 - c.shape[1]))) for c in cases()]
    x, y = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(c) for c in parts])
    got = {r.id: [(n.id, n.d) for n in r.neighbours] for r in N.nearest_same_class(table(spark, x, y), "id", 3, leaf=16).collect()}
    want = plain(x, y, 3)
    assert got.keys() == want.keys()
    for i, near in want.items():
        assert [j for j, _ in got[i]] == [j for j, _ in near] and np.allclose([d for _, d in got[i]], [d for _, d in near], rtol=1e-9)


def test_no_group_is_large_and_few_pairs_are_measured(spark, tmp_path):
    rng, n = np.random.default_rng(0), 4000
    centres = rng.normal(size=(40, 64)) * 3
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 64)) * 0.6
    rows, measured = table(spark, x, np.zeros(n)), {}
    want = {f"{i:05d}": None for i in range(0, n, 29)}
    for i in want:
        d = np.sqrt(((x - x[int(i)]) ** 2).sum(1))
        d[int(i)] = np.inf
        want[i] = [f"{j:05d}" for j in np.argsort(d)[:5]]
    got = {r.id: [q.id for q in r.neighbours] for r in N.nearest_same_class(rows, "id", 5, measured=measured, leaf=64).collect()}
    assert all(got[i] == w for i, w in want.items()) and sum(measured.values()) < 0.1 * n * n
    fast = {r.id: {q.id for q in r.neighbours} for r in N.nearest_same_class(rows, "id", 5, exact=False).collect()}
    assert sum(len(fast[i] & set(w)) for i, w in want.items()) >= 0.9 * 5 * len(want)
    points = spark.createDataFrame([(0, f"{i}", v.tolist()) for i, v in enumerate(x)], "y int, gid string, x array<double>")
    sizes = N.leaves(points, 2, 64, str(tmp_path / "leaves")).groupBy("tree", "node").count().toPandas()
    assert sizes.groupby("tree")["count"].sum().tolist() == [n, n] and sizes["count"].max() <= 64
    assert max(N.LEAF, N.SAMPLE, N.GROUP) <= 2000


def test_odd_tables(spark):
    empty = table(spark, np.zeros((1, 2)), [0]).limit(0)
    assert N.nearest_same_class(empty, "id").collect() == []
    rows = spark.createDataFrame([("a", 0.0, [0.0, 1.0]), ("b", 0.0, [-0.0, 1.0]), ("c", 1.0, [5.0, 5.0]), (None, 0.0, [0.0, 1.0]), ("d", None, [0.0, 1.0])], "id string, y double, v array<double>")
    rows = rows.select("id", "y", array_to_vector("v").alias("features"))
    got = {r.id: [(n.id, n.d) for n in r.neighbours] for r in N.nearest_same_class(rows, "id").collect()}
    assert got == {"a": [("b", 0.0)], "b": [("a", 0.0)], "c": []}


def test_new_points_lie_between_two_rows_of_their_class(spark):
    rng = np.random.default_rng(8)
    y = np.array([0] * 90 + [1] * 25 + [2] * 8)
    x = rng.normal(size=(len(y), 3)) + y[:, None] * 20
    rows = table(spark, x, y).drop("node").withColumnRenamed("id", "window_id")
    out = RC.smote(rows, k=4, exact=False).toPandas()
    assert out.groupby("y").size().tolist() == [90, 90, 90] and out.window_id.is_unique
    for r in out[out.window_id.str.contains("#")].itertuples():
        start, own, p = x[int(r.window_id.split("#")[0])], x[y == r.y], np.array(r.features)
        step, way = p - start, own - start
        length = np.maximum((way**2).sum(1), 1e-300)
        t = (way @ step) / length
        off = np.sqrt((((way * t[:, None]) - step) ** 2).sum(1))
        assert ((off < 1e-9) & (t > -1e-12) & (t < 1 + 1e-12)).any()


def test_several_buckets_of_leaves_in_a_class(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET", 150)
    x, y = np.random.default_rng(8).normal(size=(700, 6)), np.arange(700) % 4 // 3
    got = {r.id: [n.id for n in r.neighbours] for r in N.nearest_same_class(table(spark, x, y), "id", 3, leaf=64, trees=1).collect()}
    assert got == {i: [j for j, _ in near] for i, near in plain(x, y, 3).items()}
