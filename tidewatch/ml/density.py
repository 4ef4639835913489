"""Hierarchical density clusters of weighted points over a graph of their distances.

A point of weight n is n equal points. The core level of a point is the least level within which it has ``samples`` others; two points are joined at
the greatest of their distance and both core levels. Going up the levels, what is joined at a level becomes one component:

* two or more components of at least ``smallest`` points end there as clusters, and a new cluster begins that holds them;
* one such component goes on as the same cluster, and smaller ones leave it (seen from above) at this level;
* smaller ones alone begin a cluster once they have ``smallest`` points together.

A cluster's stability is the sum over its points of the density (``1 / level``) at which they leave it, less the density at which it ends. It wins
if that is no less than what the clusters inside it have; a point belongs to the topmost winner around it and to none (noise) outside of all.

Distances are whole levels, so that equal ones are joined at once and the result depends on no order. Connected parts of at most ``part`` rows are
handled as groups of their own; larger ones level by level, with components, sums and joins of the whole table, in as many rounds as there are levels.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import settled

PART = 50_000
TOLERANCE = 1e-9


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, root``: the smallest id that each node is connected to. Every round takes neighbour minima, then jumps to the
    root's root; lineage is cut by files per round, and rounds go on until nothing changes."""
    both = settled(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    state = settled(nodes.select("id", F.col("id").alias("root")))
    while True:
        lows = both.join(state.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("low"))
        step = state.join(lows, "id", "left").select("id", "root", F.least("root", F.coalesce("low", "root")).alias("near"))
        jump = step.join(state.select(F.col("id").alias("near"), F.col("root").alias("far")), "near", "left")
        new = settled(jump.select("id", F.col("root").alias("old"), F.least("near", F.coalesce("far", "near")).alias("root")))
        state = new.select("id", "root")
        if new.filter("root <> old").isEmpty():
            return state


def core_levels(points: DataFrame, pairs: DataFrame, samples: int) -> DataFrame:
    """``id, n, core`` of the points (id, n) that have ``samples`` others within reach. ``pairs``: a, b, level, each pair once."""
    both = pairs.select("a", "b", "level").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "level"))
    near = both.join(points.select(F.col("id").alias("b"), "n"), "b").groupBy(F.col("a").alias("id"), "level").agg(F.sum("n").alias("around"))
    near = near.unionByName(points.select("id", F.lit(1).alias("level"), (F.col("n") - 1).alias("around")))
    so_far = Window.partitionBy("id").orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)      # a row per level at most
    reached = near.withColumn("within", F.sum("around").over(so_far)).where(F.col("within") >= samples)
    return points.select("id", "n").join(reached.groupBy("id").agg(F.min("level").alias("core")), "id")


def _condense(smallest: int, end: int):
    """Labels of the points of one connected part."""
    def run(key, points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        ids = points.id.values
        place = {v: i for i, v in enumerate(ids)}
        root, members = np.arange(len(ids)), {i: [i] for i in range(len(ids))}
        size = {i: int(n) for i, n in enumerate(points.n.values)}
        total = {i: size[i] / int(points.core.iloc[i]) for i in members}
        best, label = dict.fromkeys(members, 0.0), np.full(len(ids), -1)

        def close(i: int, density: float) -> float:
            own = total[i] - density * size[i]
            if own >= best[i] - TOLERANCE:
                label[members[i]] = min(members[i], key=lambda k: ids[k])
            return max(own, best[i])

        for level, group in edges.groupby("level", sort=True):
            lead: dict[int, int] = {}

            def find(i: int) -> int:
                while lead.get(i, i) != i:
                    lead[i] = lead.get(lead[i], lead[i])
                    i = lead[i]
                return i

            for a, b in zip(group.a.values, group.b.values):
                a, b = find(int(root[place[a]])), find(int(root[place[b]]))
                if a != b:
                    lead[max(a, b)] = min(a, b)
            joined: dict[int, list[int]] = {}
            for i in list(lead):
                joined.setdefault(find(i), []).append(i)
            for top, parts in joined.items():
                parts = sorted({top, *parts})
                if len(parts) == 1:
                    continue
                large, points_in = [i for i in parts if size[i] >= smallest], sum(size[i] for i in parts)
                if len(large) == 1:
                    total[top], best[top] = total[large[0]] + (points_in - size[large[0]]) / level, best[large[0]]
                else:
                    inside = sum(close(i, 1 / level) for i in large)
                    total[top], best[top] = points_in / level, inside
                size[top], members[top] = points_in, [k for i in parts for k in members[i]]
                root[members[top]] = top
                for i in parts:
                    if i != top:
                        del members[i]
        for i in members:
            if size[i] >= smallest:
                close(i, 1 / end)
        return pd.DataFrame({"id": ids, "label": [ids[k] if k >= 0 else None for k in label]}, columns=["id", "label"]).astype({"label": "Int64"})
    return run


def _by_levels(points: DataFrame, edges: DataFrame, smallest: int, end: int) -> DataFrame:
    """The same for parts of any size: ``id, label``."""
    at = settled(points.select("id", F.col("id").alias("node"), F.lit(None).cast("bigint").alias("label")))
    state = settled(points.select(F.col("id").alias("node"), F.col("n").alias("size"), (F.col("n") / F.col("core")).alias("total"), F.lit(0.0).alias("best")))
    edges = settled(edges)

    def closed(rows: DataFrame, density: Column) -> DataFrame:
        own = F.col("total") - density * F.col("size")
        return rows.withColumns({"wins": (own >= F.col("best") - TOLERANCE) & (F.col("size") >= smallest), "worth": F.greatest(own, "best")})

    def labelled(at: DataFrame, winners: DataFrame) -> DataFrame:
        named = at.join(winners.select("node").withColumn("won", F.lit(True)), "node", "left")
        low = named.where("won").groupBy("node").agg(F.min("id").alias("low"))
        return named.join(low, "node", "left").select("id", "node", F.coalesce("low", "label").alias("label"))

    for level in [r["level"] for r in edges.select("level").distinct().orderBy("level").collect()]:         # whole levels: at most ``end``
        here = edges.where(F.col("level") == level)
        here = here.join(at.select(F.col("id").alias("a"), F.col("node").alias("x")), "a").join(at.select(F.col("id").alias("b"), F.col("node").alias("y")), "b")
        here = settled(here.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if here.isEmpty():
            continue
        touched = here.select(F.col("a").alias("id")).union(here.select("b")).distinct()
        joined = components(touched, here).withColumnsRenamed({"id": "node", "root": "top"})
        parts = closed(state.join(joined, "node"), F.lit(1 / level))
        large = F.col("size") >= smallest
        tops = parts.groupBy("top").agg(F.sum("size").alias("all"), F.count_if(large).alias("larges"), F.sum(F.when(large, F.col("worth"))).alias("inside"),
                                        F.max(F.when(large, F.struct("size", "total", "best"))).alias("one"))
        tops = settled(tops)
        winners = parts.join(tops.where("larges > 1").select("top"), "top", "left_semi").where("wins")
        at = labelled(at, winners)
        at = settled(at.join(joined, "node", "left").select("id", F.coalesce("top", "node").alias("node"), "label"))
        single = F.col("larges") == 1
        new = tops.select(F.col("top").alias("node"), F.col("all").alias("size"),
                          F.when(single, F.col("one.total") + (F.col("all") - F.col("one.size")) / level).otherwise(F.col("all") / level).alias("total"),
                          F.when(single, F.col("one.best")).otherwise(F.coalesce("inside", F.lit(0.0))).alias("best"))
        state = settled(state.join(joined, "node", "left_anti").unionByName(new))
    return labelled(at, closed(state, F.lit(1 / end)).where("wins")).select("id", "label")


def density_clusters(points: DataFrame, pairs: DataFrame, reach: int, smallest: int = 5, samples: int = 3, part: int = PART) -> DataFrame:
    """``id, label``: the smallest id of the point's cluster, null for noise.

    ``points``: id, n (weight). ``pairs``: a, b, level for all pairs of different points at a distance of at most ``reach`` levels, 1 or more; points
    further apart are never joined. ``smallest`` has to be greater than ``samples``.
    """
    points = settled(points.select("id", F.col("n").cast("bigint").alias("n")))
    pairs = settled(pairs)
    core = settled(core_levels(points, pairs, samples))
    edges = pairs.join(core.select(F.col("id").alias("a"), F.col("core").alias("core_a")), "a").join(core.select(F.col("id").alias("b"), F.col("core").alias("core_b")), "b")
    edges = settled(edges.select("a", "b", F.greatest("level", "core_a", "core_b").cast("int").alias("level")))
    roots = components(core, edges)
    sizes = edges.join(roots.select(F.col("id").alias("a"), "root"), "a").groupBy("root").agg((F.count(F.lit(1))).alias("edges"))
    sizes = settled(roots.groupBy("root").agg(F.count(F.lit(1)).alias("points")).join(sizes, "root", "left").select("root", (F.col("points") + F.coalesce("edges", F.lit(0)) > part).alias("large")))
    placed = settled(core.join(roots, "id").join(sizes, "root"))
    where = placed.select(F.col("id").alias("a"), F.col("root").alias("of"), "large")
    rooted = edges.join(where, "a")
    end = reach + 1
    small = placed.where("NOT large").select("root", "id", "n", "core").groupBy("root").cogroup(rooted.where("NOT large").select("of", "a", "b", "level").groupBy("of")).applyInPandas(
        _condense(smallest, end), "id bigint, label bigint")
    out = small
    if not sizes.where("large").isEmpty():
        out = out.unionByName(_by_levels(placed.where("large").select("id", "n", "core"), rooted.where("large").select("a", "b", "level"), smallest, end))
    return points.select("id").join(out, "id", "left")
