"""Nearest rows of the same class by a forest of random hyperplanes, exact on request by the bounds of balls.

Equal vectors of a class are one point with its smallest ids, so copies never meet each other. Each tree sends the points down by random directions,
cut at the widest gap in the middle of a bounded sample of each node, until no leaf holds more than ``leaf`` points; a round goes down five levels. Points meet in their leaves, one leaf a group, and the best lists of all trees are merged.

For an exact answer the leaves of the first tree are parted into compact balls. The distance to the k-th neighbour found so far bounds where a better one can lie: pairs
of (leaf, node) go down the tree of balls as long as they can hold one, then each point looks only into the balls that its own bound
reaches; it is sent once to a bucket of leaves, with the list of those.
"""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.constants import SEED
from tidewatch.session import broadcast_if_small, run_dir

LEAF, TREES, SAMPLE, LEVELS = 256, 4, 1536, 5
TRIED = 16                           # directions tried for each cut
GROUP = 1500
BUCKET = 4 * GROUP                   # points of a bucket of leaves, and points that look into it at a time
NODE = ["y", "tree", "node"]
POINTS = "y int, tree int, node long, gid string, x array<double>"
FOUND = "y int, gid string, d double, other string"


def direction(tree: int, node: int, inner: int, tried: int, size: int) -> np.ndarray:
    """Unit vector for an inner node below a node; every task draws the same ones."""
    v = np.random.default_rng([SEED, tree, node, inner, tried]).standard_normal(size)
    return v / np.linalg.norm(v)


def _levels(n: int, leaf: int) -> int:
    return max(1, min(LEVELS, math.ceil(math.log2(n / leaf * 1.15))))


def _halves(gids: np.ndarray, inner: int) -> np.ndarray:
    return np.array([zlib.crc32(f"{inner}/{g}".encode()) & 1 for g in gids], bool)


def _widest(x: np.ndarray, tree: int, node: int, inner: int) -> tuple[int, float]:
    """Of some random directions the one with the widest gap between the middle points of the sample, and the cut in that gap."""
    best, low, high = (0.0, 0, float("nan")), len(x) // 5, max(len(x) - len(x) // 5, len(x) // 5 + 2)
    for tried in range(TRIED if len(x) > 1 else 0):
        p = np.sort(x @ direction(tree, node, inner, tried, x.shape[1]))
        gaps, spread = np.diff(p[low:high]), p.std()
        at = int(gaps.argmax()) if len(gaps) else 0
        if len(gaps) and spread > 0 and gaps[at] / spread > best[0]:
            best = (gaps[at] / spread, tried, float(p[low + at] + gaps[at] / 2))
    return best[1:]


def _cuts(leaf: int):
    """Direction and cut of the nodes below one node, from its sample; the cut is nan where no direction tells the points apart."""
    def run(key, sample: pd.DataFrame) -> pd.DataFrame:
        x, gids, (y, tree, node) = np.stack(sample.x.values), sample.gid.values, key
        inner_nodes, picks, cuts, groups = 2 ** _levels(int(sample.n.iloc[0]), leaf) - 1, [], [], [np.arange(len(sample))]
        for inner in range(inner_nodes):
            own = groups[inner]
            pick, cut = _widest(x[own], tree, node, inner)
            right = _halves(gids[own], inner) if math.isnan(cut) else x[own] @ direction(tree, node, inner, pick, x.shape[1]) > cut
            groups += [own[~right], own[right]]
            picks.append(pick)
            cuts.append(cut)
        return pd.DataFrame({"y": [y], "tree": [tree], "node": [node], "picks": [picks], "cuts": [cuts]})
    return run


def _route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for (_, tree, node), rows in batch.groupby(NODE, sort=False):
            x, gids, picks, cuts = np.stack(rows.x.values), rows.gid.values, rows.picks.iloc[0], rows.cuts.iloc[0]
            at = np.zeros(len(x), np.int64)
            for inner in range(len(cuts)):           # in order, so a point passes its nodes from the top
                mine = np.flatnonzero(at == inner)
                if len(mine):
                    right = _halves(gids[mine], inner) if math.isnan(cuts[inner]) else x[mine] @ direction(tree, node, inner, picks[inner], x.shape[1]) > cuts[inner]
                    at[mine] = 2 * inner + 1 + right
            yield rows.assign(node=(node << LEVELS) + at - len(cuts))[[*NODE, "gid", "x"]]


def leaves(points: DataFrame, trees: int, leaf: int, folder: str) -> DataFrame:
    """``y, tree, node, gid, x``: each point (y, gid, x) in a leaf of every tree, of at most ``leaf`` points. The path of a node is its number.

    A class of at most ``leaf`` points is one leaf of the first tree."""
    spark, turn, done = points.sparkSession, 0, []

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}-{turn}")
        return spark.read.parquet(f"{folder}/{name}-{turn}")

    large = written(points.groupBy("y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf).select("y", F.lit(trees - 1).alias("more")), "large")
    if large.isEmpty():
        return points.select("y", F.lit(0).alias("tree"), F.lit(1).cast("long").alias("node"), "gid", "x")
    grown = points.join(broadcast_if_small(large), "y", "left")
    state = written(grown.select("y", F.explode(F.sequence(F.lit(0), F.coalesce("more", F.lit(0)))).alias("tree"), F.lit(1).cast("long").alias("node"), "gid", "x"), "state")
    while True:
        big = written(state.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf), "big")
        if big.isEmpty():
            return reduce(DataFrame.unionByName, [*done, state])
        done.append(written(state.join(broadcast_if_small(big), NODE, "left_anti").select(*NODE, "gid", "x"), "done"))
        drawn = F.xxhash64("gid", "tree", F.lit(turn))
        some = state.join(broadcast_if_small(big), NODE).where(F.pmod(drawn, F.ceil(F.col("n") / (4 * SAMPLE))) == 0)
        some = some.withColumn("turn", F.row_number().over(Window.partitionBy(*NODE).orderBy(drawn, "gid"))).where(F.col("turn") <= SAMPLE)
        cuts = written(some.select(*NODE, "gid", "x", "n").groupBy(*NODE).applyInPandas(_cuts(leaf), "y int, tree int, node long, picks array<int>, cuts array<double>"), "cuts")
        moved = state.join(broadcast_if_small(cuts), NODE).mapInPandas(_route, POINTS)
        turn += 1
        state = written(moved, "state")


def nearest(asks: pd.DataFrame, points: pd.DataFrame, k: int) -> pd.DataFrame:
    """``gid, d, other``: the k nearest points (ties by gid) of each ask, itself left out. A matrix product finds them, differences measure them."""
    a, b = np.stack(asks.x.values), np.stack(points.x.values)
    square, other = (b * b).sum(1), points.gid.values
    order = np.argsort(other, kind="stable")
    place = np.empty(len(other), np.int64)
    place[order] = np.arange(len(other))
    out = []
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        norm = (part * part).sum(1)[:, None]
        d = norm + square - 2 * part @ b.T
        d[asks.gid.values[at : at + 256, None] == other[None, :]] = np.inf
        last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        slack = 1e-9 * (norm[:, 0] + square.max())
        row, col = np.nonzero((d <= (last + slack)[:, None]) & np.isfinite(d))
        exact = np.sqrt(((part[row] - b[col]) ** 2).sum(1))
        by = np.lexsort((place[col], exact, row))
        row, col, exact = row[by], col[by], exact[by]
        turn = np.arange(len(row)) - np.searchsorted(row, row)
        keep = turn < k
        out.append(pd.DataFrame({"gid": asks.gid.values[at + row[keep]], "d": exact[keep], "other": other[col[keep]]}))
    return pd.concat(out)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each point among what several searches found."""
    once = found.groupBy("y", "gid", "other").agg(F.min("d").alias("d"))
    return once.withColumn("turn", F.row_number().over(Window.partitionBy("y", "gid").orderBy("d", "other"))).where(F.col("turn") <= k).drop("turn")


def _distance(a: pd.Series, b: pd.Series) -> np.ndarray:
    return np.sqrt(((np.stack(a.values) - np.stack(b.values)) ** 2).sum(1))


def _ball_of(parent: bool):
    """Centre and radius around the points of a leaf, or around the balls below a node."""
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.x.values)
        center = x.mean(axis=0)
        far = np.sqrt(((x - center) ** 2).sum(1)) + (rows.radius.values if parent else 0.0)
        reach = float(rows.reach.max())
        return pd.DataFrame({"y": [key[0]], "node": [key[1]], "center": [center.tolist()], "radius": [float(far.max() * (1 + 1e-12))], "reach": [reach], "n": [int(rows.n.sum())]})
    return run


def _parted(rows: pd.DataFrame) -> pd.DataFrame:
    """The points of a leaf in up to 32 parts below it: halved by two means as long as that takes a fifth off the squared deviations."""
    x, part, waiting, used = np.stack(rows.x.values), np.zeros(len(rows), np.int64), [0], 1
    while waiting and used < 1 << LEVELS:
        own = np.flatnonzero(part == waiting.pop())
        if len(own) < 8:
            continue
        p = x[own]
        a = p[((p - p.mean(axis=0)) ** 2).sum(1).argmax()]
        b = p[((p - a) ** 2).sum(1).argmax()]
        for _ in range(4):
            near = ((p - a) ** 2).sum(1) > ((p - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = p[~near].mean(axis=0), p[near].mean(axis=0)
        else:
            spread = lambda q: ((q - q.mean(axis=0)) ** 2).sum()
            if spread(p[near]) + spread(p[~near]) <= 0.8 * spread(p):
                part[own[near]] = used
                waiting += [part[own[~near][0]], used]
                used += 1
    return rows.assign(node=(rows.node.values << LEVELS) + part)[["y", "node", "gid", "x"]]


BALL = "y int, node long, center array<double>, radius double, reach double, n long"


def _within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of balls that can hold a better neighbour: ``y, leaf, node``."""
    for batch in batches:
        if len(batch):
            gap = _distance(batch.mine, batch.center)
            yield batch[gap <= (batch.span + batch.radius) * (1 + 1e-9)][["y", "leaf", "node", "last"]]


def _reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            gap = _distance(batch.x, batch.center)
            yield batch[gap <= (batch.reach + batch.radius) * (1 + 1e-9)][["y", "node", "gid"]]


def visits(tree: DataFrame, bound: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(``y, node, gid``: points that have to look into a leaf, ``y, node, gid, x``: the points of the leaves).

    ``tree``: the first tree's leaves (y, node, gid, x); ``bound``: y, gid, reach, the distance a better neighbour must stay under.
    """
    spark = tree.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    tree = written(tree.groupBy("y", "node").applyInPandas(_parted, "y int, node long, gid string, x array<double>"), "parted")
    own = written(tree.join(bound, ["y", "gid"]), "bounded")
    balls = [written(own.withColumns({"radius": F.lit(0.0), "n": F.lit(1).cast("long")}).select("y", "node", "x", "radius", "reach", "n").groupBy("y", "node").applyInPandas(_ball_of(False), BALL), "balls-leaf")]
    level = balls[0].withColumn("depth", F.floor(F.log2(F.col("node").cast("double")) / LEVELS).cast("int"))
    deepest = level.agg(F.max("depth")).first()[0] or 0
    rows = level.withColumn("last", F.lit(True))
    for depth in range(deepest, 0, -1):              # a node's ball from those below it
        here = rows.where(F.col("depth") == depth).select("y", F.shiftright("node", LEVELS).alias("node"), F.col("center").alias("x"), "radius", "reach", "n")
        up = written(here.groupBy("y", "node").applyInPandas(_ball_of(True), BALL), f"balls-{depth}").withColumns({"depth": F.lit(depth - 1), "last": F.lit(False)})
        rows = rows.unionByName(up)
    nodes = written(rows.select("y", "node", F.shiftright("node", LEVELS).alias("parent"), "center", "radius", "last"), "nodes")
    mine = balls[0].select("y", F.col("node").alias("leaf"), F.col("center").alias("mine"), (F.col("radius") + F.col("reach")).alias("span"))
    pairs = mine.select("y", "leaf", F.lit(1).cast("long").alias("node"), F.lit(False).alias("last")).where(F.lit(deepest > 0))
    found = []
    for depth in range(1, deepest + 1):
        below = nodes.where((F.col("parent") > 0) & (F.floor(F.log2(F.col("node").cast("double")) / LEVELS) == depth)).select("y", F.col("parent").alias("node"), F.col("node").alias("child"), "center", "radius", F.col("last").alias("ends"))
        tried = pairs.join(broadcast_if_small(below), ["y", "node"]).drop("node", "last").withColumnsRenamed({"child": "node", "ends": "last"}).join(mine, ["y", "leaf"])
        pairs = written(tried.select("y", "leaf", "mine", "span", "node", "center", "radius", "last").mapInPandas(_within, "y int, leaf long, node long, last boolean"), f"pairs-{depth}")
        found.append(pairs.where("last AND leaf != node").select("y", "leaf", "node"))
        pairs = pairs.where("NOT last")
    if not found:
        return own.select("y", "node", "gid").limit(0), tree.limit(0)
    meet = written(reduce(DataFrame.unionByName, found), "meet")
    targets = meet.join(balls[0].select("y", "node", "center", "radius"), ["y", "node"])
    looks = own.withColumnRenamed("node", "leaf").join(targets, ["y", "leaf"])
    return written(looks.select("y", "node", "gid", "x", "reach", "center", "radius").mapInPandas(_reached, "y int, node long, gid string"), "looks"), tree


def _look(k: int):
    """The k nearest of the points that have to look into leaves of a bucket, each among the points of its leaves."""
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"y": pd.Series(dtype="int32"), "gid": pd.Series(dtype=object), "d": pd.Series(dtype=float), "other": pd.Series(dtype=object)})]
        if len(a) and len(b):
            who = np.repeat(np.arange(len(a)), a.nodes.map(len).values)
            lookers = pd.Series(who).groupby(np.concatenate(a.nodes.values)).indices
            found = pd.concat([nearest(a.iloc[who[lookers[node]]], points, k) for node, points in b.groupby("node") if node in lookers] or out)
            found = found.sort_values(["gid", "d", "other"])
            out.append(found[found.groupby("gid").cumcount() < k].assign(y=a.y.iloc[0]))
        return pd.concat([o for o in out if len(o)] or out)[["y", "gid", "d", "other"]]
    return run


def looked(looks: DataFrame, tree: DataFrame, k: int, folder: str) -> DataFrame:
    """``y, gid, d, other``: what ``looks`` find in the leaves of ``tree``. Leaves are dealt into buckets of about ``BUCKET`` points; a point goes to a bucket once, with
    the list of its leaves there, and comes back with its k best."""
    spark = tree.sparkSession
    buckets = tree.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("_b"))
    dealt = lambda df: df.join(broadcast_if_small(buckets), "y").withColumn("bucket", F.pmod(F.xxhash64("node"), F.col("_b")).cast("int")).drop("_b")
    dealt(looks).groupBy("y", "bucket", "gid").agg(F.collect_list("node").alias("nodes")).write.parquet(f"{folder}/lists")
    lists = spark.read.parquet(f"{folder}/lists")
    chunks = lists.groupBy("y", "bucket").agg(F.ceil(F.count(F.lit(1)) / BUCKET).cast("int").alias("chunks"))
    askers = lists.join(tree.select("y", "gid", F.col("x").alias("x")), ["y", "gid"]).join(broadcast_if_small(chunks), ["y", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("gid"), F.col("chunks")).cast("int"))
    points = dealt(tree).join(broadcast_if_small(chunks), ["y", "bucket"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    asked = askers.select("y", "bucket", "chunk", "gid", "x", "nodes").groupBy("y", "bucket", "chunk")
    return asked.cogroup(points.select("y", "bucket", "chunk", "node", "gid", "x").groupBy("y", "bucket", "chunk")).applyInPandas(_look(k), FOUND)


def pair_count(points: DataFrame, *keys: str, lookers: DataFrame | None = None) -> int:
    """Pairs that are measured where points, or lookers and points, meet by ``keys``."""
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    m = n.withColumnRenamed("n", "m") if lookers is None else lookers.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, list(keys)).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]


def nearest_same_class(rows: DataFrame, ident: str, k: int = 5, label: str = "y", vector: str = "features", leaf: int = LEAF, trees: int = TREES, exact: bool = True,
                       measured: dict | None = None) -> DataFrame:
    """The ``k`` nearest rows of the same class: ``ident, y, neighbours`` (array of distance, id as text, vector, nearest first, ties by id).

    With ``exact=False`` the forest's answer is taken as it is. ``measured`` receives the number of pairs whose distance was computed. ids are unique in
    a class; rows with a null id, class or vector are left out. A row alone in its class has an empty array.
    """
    spark, folder = rows.sparkSession, run_dir(rows.sparkSession, "neighbours")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    base = rows.select(F.col(ident).cast("string").alias("id"), F.col(label).cast("int").alias("y"), F.transform(vector_to_array(vector), lambda v: v + F.lit(0.0)).alias("x"))
    base = written(base.where("id IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL").withColumn("h", F.xxhash64("x")), "rows")
    same = Window.partitionBy("y", "h", "x").orderBy("id")
    few = base.withColumn("turn", F.row_number().over(same)).where(F.col("turn") <= k + 1)      # no more copies of a vector can be among the k nearest
    groups = written(few.groupBy("y", "h", "x").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("gid", F.col("ids")[0]), "groups")
    grown = leaves(groups.select("y", "gid", "x"), trees, leaf, folder)
    own = grown.groupBy(*NODE).applyInPandas(lambda p: nearest(p, p, k).assign(y=p.y.iloc[0])[["y", "gid", "d", "other"]], FOUND)
    best = written(_best(own, k), "first")
    if measured is not None:
        measured["forest"] = pair_count(grown, *NODE)
    if exact and not grown.where("node > 1").isEmpty():                      # else every point has met all of its class
        reach = best.groupBy("y", "gid").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("reach"))
        first = grown.where("tree = 0").select("y", "node", "gid", "x")
        bound = groups.select("y", "gid").join(reach, ["y", "gid"], "left").select("y", "gid", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
        looks, points = visits(first, bound, folder)
        if measured is not None:
            measured["balls"] = pair_count(points, "y", "node", lookers=looks)
        more = looked(looks, points, k, folder)
        best = written(_best(best.select("y", "gid", "d", "other").unionByName(more), k), "second")
    # from points back to rows: first the copies of the row, then the members of the other points
    near = best.join(groups.select("y", F.col("gid").alias("other"), F.col("ids").alias("others"), F.col("x").alias("there")), ["y", "other"])
    listed = near.groupBy("y", "gid").agg(F.array_sort(F.collect_list(F.struct("d", "other", "others", "there"))).alias("found"))
    listed = groups.join(listed, ["y", "gid"], "left")
    members = F.flatten(F.transform(F.coalesce("found", F.array().cast("array<struct<d:double,other:string,others:array<string>,there:array<double>>>")),
                                    lambda g: F.transform(g["others"], lambda i: F.struct(g["d"].alias("d"), i.alias("id"), g["there"].alias("x")))))
    copies = F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id"), F.col("x").alias("x")))
    every = base.join(listed.select("y", "h", "x", "ids", members.alias("members")), ["y", "h", "x"])
    return every.select(F.col("id").alias(ident), "y", F.slice(F.array_sort(F.concat(copies, "members")), 1, k).alias("neighbours"))
