"""What both vector searches share: which vectors take part, queries and candidates placed in cells, and the merge of the cells' results."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

RESULT = "query_id long, vec_id long, score {}"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that have an id and a vector without null, infinite or undefined components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("vec_id IS NOT NULL AND size(embedding) > 0").where(~F.exists("embedding", bad))


def as_queries(vectors: DataFrame) -> DataFrame:
    """One row per vec_id; of rows that share it the smallest vector counts."""
    return vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def place(salt: int, parts: Column | int) -> Column:
    return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(parts)).cast("int")


def cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, int, np.ndarray, np.ndarray]]:
    """(key, side, ids, vectors) for runs of rows of one cell and side; the columns are the keys, then side, vec_id and embedding. The rows are
    sorted by keys and side, so that the runs of a cell follow each other."""
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys + 1)], axis=1).astype(np.int64)
        cuts = np.flatnonzero(np.any(marks[1:] != marks[:-1], axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            rows = batch.slice(a, b - a)
            vectors = rows.column(keys + 2)
            dim = len(vectors[0])
            flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            yield tuple(marks[a, :keys].tolist()), int(marks[a, keys]), rows.column(keys + 1).to_numpy(), flat


def best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of each query, ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def result_batch(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score)], names=["query_id", "vec_id", "score"])
