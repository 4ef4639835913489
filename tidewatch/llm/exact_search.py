"""Exact search for the largest inner products of integer vectors, with bounds from segment statistics at several resolutions.

A vector is cut into segments; each keeps its mean and its deviation, both times the root of its length. The inner product of two vectors is at
most the sum over segments of the product of means plus the product of deviations (which gives the lower bound of the distance, as that is the
squared lengths less twice the inner product). Coarse segments come first; what a bound leaves below a query's k-th score so far is done, and
only the pairs that all resolutions leave are computed.

Queries and candidates meet in cells: query block by shard of the candidates. A task reads a cell's queries, then its candidates batch by
batch, so its memory depends on the block size alone.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.vectors import RESULT, as_queries, best, cells, place, result_batch

#: Queries of a cell, at about; candidates that a shard has at least.
QUERY_BLOCK, SHARD = 4096, 16384
#: Segments per vector, coarse to fine.
RESOLUTIONS = (4, 16)
STEP = 1024


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row: means and deviations of its segments, each times the root of the segment's length."""
    dim = x.shape[1]
    edges = np.linspace(0, dim, min(segments, dim) + 1).astype(int)
    length = np.diff(edges)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    return np.hstack([total / np.sqrt(length), np.sqrt(np.maximum(square - total * total / length, 0))])


class _Cell:
    """Queries of one cell and their best candidates so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.parts = k, [], []
        self.ready = False

    def add_queries(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids.append(ids)
        self.parts.append(x)

    def start(self) -> None:
        self.ready = True
        self.query_id, self.x = np.concatenate(self.ids), np.concatenate(self.parts)
        self.bounds = [_statistics(self.x, r) for r in RESOLUTIONS]
        self.least = np.full(len(self.x), -np.inf)                     # the k-th best score of each query
        self.found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.step = 64

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            self._compare(ids[at : at + self.step], x[at : at + self.step])
            at += self.step
            self.step = min(self.step * 4, STEP)

    def _compare(self, ids: np.ndarray, x: np.ndarray) -> None:
        query, vec = np.arange(len(self.x)), np.arange(len(x))         # rows and columns that still have open pairs
        slack = 1e-9 * (1 + np.abs(self.least, where=np.isfinite(self.least), out=np.zeros(len(self.x))))
        for mine, r in zip(self.bounds, RESOLUTIONS):
            open_ = mine[query] @ _statistics(x[vec], r).T >= (self.least - slack)[query, None] - 1e-6
            query, vec = query[open_.any(axis=1)], vec[open_.any(axis=0)]
            if not len(query):
                return
        score = _products(self.x[query], x[vec])
        i, j = np.nonzero((score >= self.least[query, None]) & (self.query_id[query][:, None] != ids[vec][None, :]))
        q = np.concatenate([self.found[0], query[i]])
        v = np.concatenate([self.found[1], ids[vec[j]]])
        s = np.concatenate([self.found[2], score[i, j]])
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.searchsorted(q, q, "left")
        keep = np.arange(len(q)) - first < self.k
        self.found = q[keep], v[keep], s[keep]
        last = np.flatnonzero(np.arange(len(q)) - first == self.k - 1)
        self.least[q[last]] = s[last]

    def result(self):
        return result_batch(self.query_id[self.found[0]], self.found[1], self.found[2].astype(np.int64))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles as long as they stay below 2**53."""
    if len(a) and len(b) and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a @ b.T


def _search(k: int):
    def run(batches):
        key, cell = None, None
        for own, side, ids, x in cells(batches, 3):
            if own != key:
                if cell is not None and cell.ready:
                    yield cell.result()
                key, cell = own, _Cell(k)
            if side == 0:
                cell.add_queries(ids, x)
            elif cell.ids:
                if not cell.ready:
                    cell.start()
                cell.add(ids, x)
        if cell is not None and cell.ready:
            yield cell.result()
    return run


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` candidates with the largest inner product for each query, ties to the smaller vec_id.

    Both inputs have vec_id and embedding, whole numbers without nulls; a query is not compared with candidates of its own vec_id, nor with
    vectors of another length. Queries that share a vec_id count once, repeated candidates each. Fewer candidates than ``k`` give all; without
    queries or candidates there are no rows.
    """
    queries = as_queries(queries)
    n, m = queries.count(), candidates.count()
    blocks, shards = max(1, -(-n // QUERY_BLOCK)), max(1, -(-m // SHARD))
    numbers = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = queries.select(F.size("embedding").alias("dim"), place(1, blocks).alias("block"), numbers(shards).alias("shard"), F.lit(0).alias("side"), "vec_id", "embedding")
    right = candidates.select(F.size("embedding").alias("dim"), numbers(blocks).alias("block"), place(2, shards).alias("shard"), F.lit(1).alias("side"), "vec_id", "embedding")
    keys = ["dim", "block", "shard"]
    # Few bytes but much work: a given number of partitions is not coalesced.
    rows = left.unionByName(right).repartition(2 * blocks * shards, *keys).sortWithinPartitions(*keys, "side")
    return best(rows.mapInArrow(_search(k), RESULT.format("long")), k)
