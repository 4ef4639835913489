"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard, whose results are merged.

A graph keeps its links as flat arrays, one row of neighbour numbers per node and layer. Vectors get one more component that makes them equally
long, so that the largest inner product is the nearest vector; equal vectors share a node. Nodes are put in by batches: a batch is searched in
the graph of the nodes before it, all its searches step by step together, each node is linked with the best of what it found, near ones that
lie in another direction first, and the links back are cut to the best in the same way.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.vectors import RESULT, as_queries, best, cells, place, result_batch

#: Vectors per shard, at about; links per node on upper layers (twice as many on the lowest); breadth of searches while building and after.
SHARD, LINKS, BUILD, SEARCH = 8192, 16, 80, 120
BATCH = 256


class Graph:
    """Graph over the rows of ``x`` (float64)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, seed: int = 5):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.ones(len(x), bool)
        new[1:] = np.any(x[1:] != x[:-1], axis=1)
        self.first = np.append(np.flatnonzero(new), len(x))            # rows of a node: ids[first[i]:first[i + 1]], by id
        self.ids, self.x = ids, x[new]
        length = (self.x**2).sum(axis=1)
        self.wide = np.hstack([self.x, np.sqrt(np.maximum(length.max() - length, 0))[:, None]]).astype(np.float32)
        n, rng = len(self.x), np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int)
        order = rng.permutation(n)
        order = order[np.argsort(-level[order], kind="stable")]        # nodes of the upper layers come first
        self.node, level = order, level[order]
        self.wide = self.wide[order]
        sizes = [int((level >= l).sum()) for l in range(int(level.max()) + 1)]
        self.layers = [np.full((s, LINKS * (2 if l == 0 else 1)), -1, np.int32) for l, s in enumerate(sizes)]
        for l in range(len(sizes) - 1, -1, -1):
            self._build(l)

    def _build(self, l: int) -> None:
        links, done = self.layers[l], 1
        while done < len(links):
            batch = np.arange(done, min(len(links), done + min(BATCH, max(1, done))))
            found, score = self._descend(self.wide[batch], l, BUILD)
            chosen = self._choose(batch, found, score, LINKS)
            links[batch, : chosen.shape[1]] = chosen
            target, source = chosen.ravel(), np.repeat(batch, chosen.shape[1])
            target, source = target[target >= 0], source[target >= 0]
            order = np.argsort(target, kind="stable")
            target, source = target[order], source[order]
            node, start, count = np.unique(target, return_index=True, return_counts=True)
            width = int(count.max())
            back = np.full((len(node), width), -1, np.int32)
            back[np.repeat(np.arange(len(node)), count), np.arange(len(target)) - np.repeat(start, count)] = source
            all_ = np.hstack([links[node], back])
            score = np.where(all_ >= 0, np.einsum("ijk,ik->ij", self.wide[np.maximum(all_, 0)], self.wide[node]), -np.inf)
            full = (all_ >= 0).sum(axis=1) > links.shape[1]
            order = np.argsort(-score, axis=1, kind="stable")
            all_, score = np.take_along_axis(all_, order, 1), np.take_along_axis(score, order, 1)
            links[node] = all_[:, : links.shape[1]]
            if full.any():
                links[node[full]] = self._choose(node[full], all_[full], score[full], links.shape[1])
            done += len(batch)

    def _choose(self, own: np.ndarray, found: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Of the found nodes (best first, -1 for none) those that are nearer to the node than to one chosen before; then the best of the rest."""
        v = self.wide[np.maximum(found, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        n, m = found.shape
        taken, apart = np.zeros((n, m), bool), np.full((n, m), -np.inf, np.float32)
        valid = (found >= 0) & (found != own[:, None])
        for j in range(m):
            take = valid[:, j] & (apart[:, j] < score[:, j]) & (taken.sum(axis=1) < most)
            taken[:, j] = take
            apart = np.where(take[:, None], np.maximum(apart, between[:, j]), apart)
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * m + np.arange(m)
        order = np.argsort(rank, axis=1)[:, :most]
        return np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(found, order, 1), -1)

    def _descend(self, q: np.ndarray, to: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes of layer ``to`` for each query, best first, entered through the layers above."""
        enter = np.zeros((len(q), 1), np.int64)
        for l in range(len(self.layers) - 1, to, -1):
            enter = self._walk(q, l, enter, 8)[0]
            enter = np.where(enter >= 0, enter, enter[:, :1])
        return self._walk(q, to, enter, breadth)

    def _walk(self, q: np.ndarray, l: int, enter: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        links, n = self.layers[l], len(q)
        seen = np.zeros((n, len(links) + 1), bool)                     # the last column stands for "no node"
        seen[:, -1] = True
        row = np.arange(n)[:, None]
        ids = np.full((n, breadth), -1, np.int64)
        score = np.full((n, breadth), -np.inf, np.float32)
        opened = np.zeros((n, breadth), bool)
        enter = np.sort(enter, axis=1)
        enter[:, 1:][enter[:, 1:] == enter[:, :-1]] = -1
        self._merge(q, ids, score, opened, enter[:, :breadth], seen, row)
        active = np.arange(n)
        while len(active):
            open_score = np.where(opened[active] | (ids[active] < 0), -np.inf, score[active])
            at = open_score.argmax(axis=1)
            going = open_score[np.arange(len(active)), at] > -np.inf
            active, at = active[going], at[going]
            if not len(active):
                break
            opened[active, at] = True
            near = links[ids[active, at]].astype(np.int64)
            part = ids[active], score[active], opened[active]
            sub = seen[active] if len(active) < n else seen
            self._merge(q[active], *part, near, sub, row[: len(active)])
            ids[active], score[active], opened[active] = part
            if len(active) < n:
                seen[active] = sub
        return ids, score

    def _merge(self, q, ids, score, opened, near, seen, row) -> None:
        """Puts the nodes ``near`` that are not ``seen`` among the best of each query, in place."""
        near = np.where(seen[row, near], -1, near)
        seen[row, near] = True
        new = np.where(near >= 0, np.einsum("ijk,ik->ij", self.wide[np.maximum(near, 0)], q), -np.inf)
        every, scores = np.hstack([ids, near]), np.hstack([score, new])
        order = np.argsort(-scores, axis=1, kind="stable")[:, : ids.shape[1]]
        ids[:], score[:] = np.take_along_axis(every, order, 1), np.take_along_axis(scores, order, 1)
        opened[:] = np.take_along_axis(np.hstack([opened, np.zeros(near.shape, bool)]), order, 1)
        ids[score == -np.inf] = -1

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(queries, nodes) found; scores are for the caller to compute."""
        wide = np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32)
        found, _ = self._descend(wide, 0, max(SEARCH, 2 * k))
        i, j = np.nonzero(found >= 0)
        return i, self.node[found[i, j]]


def _answer(graph: Graph, ids: np.ndarray, q: np.ndarray, k: int):
    for a in range(0, len(ids), BATCH):
        i, node = graph.search(q[a : a + BATCH], k)
        score = np.einsum("ij,ij->i", graph.x[node], q[a : a + BATCH][i])
        copies = np.minimum(graph.first[node + 1] - graph.first[node], k + 1)           # of equal vectors the smallest ids are enough
        row = np.repeat(graph.first[node], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        query, vec, score = np.repeat(ids[a : a + BATCH][i], copies), graph.ids[row], np.repeat(score, copies)
        other = query != vec
        query, vec, score = query[other], vec[other], score[other]
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
        yield result_batch(query[keep], vec[keep], score[keep])


def _search(k: int):
    def run(batches):
        key, graph, ids, parts = None, None, [], []
        for own, side, some, x in cells(batches, 2):
            if own != key:
                key, graph, ids, parts = own, None, [], []
            if side == 0:
                ids.append(some)
                parts.append(x)
            elif ids:
                if graph is None:
                    graph = Graph(np.concatenate(ids), np.concatenate(parts))
                yield from _answer(graph, some, x, k)
    return run


def near_neighbours(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: up to ``k`` candidates found with the largest inner products, nearest first, ties to the smaller vec_id.

    Both inputs have vec_id and embedding without nulls. Every candidate is indexed, vectors of zeros are not (nor asked for); a query is not
    compared with candidates of its own vec_id nor with vectors of another length. Scores are computed in double precision from the vectors
    themselves. Equal vectors share a node, and their smallest vec_ids are listed. Queries that share a vec_id count once. Without queries or
    candidates there are no rows.
    """
    nonzero = F.exists("embedding", lambda x: x != 0)
    candidates, queries = candidates.where(nonzero), as_queries(queries.where(nonzero))
    shards = max(1, -(-candidates.count() // SHARD))
    left = candidates.select(F.size("embedding").alias("dim"), place(3, shards).alias("shard"), F.lit(0).alias("side"), "vec_id", "embedding")
    right = queries.select(F.size("embedding").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("side"), "vec_id", "embedding")
    # Few bytes but much work: a given number of partitions is not coalesced.
    rows = left.unionByName(right).repartition(2 * shards, "dim", "shard").sortWithinPartitions("dim", "shard", "side")
    return best(rows.mapInArrow(_search(k), RESULT.format("double")), k)
