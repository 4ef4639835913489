"""Ranks all documents for each query item by an integer form of BM25, scoring equal documents once ("bag deduplication").

Terms are maximal runs of ASCII letters and digits and of non-ASCII characters; A-Z count as a-z. What the score of a document depends on is its
bag of item terms (how often it has which) and its length class ``m``, so documents are cut down to the vocabulary of the items, hashed by
(bag, m), and all with an identical (bag, m) form one class. Hashes only bring rows together: Spark groups by the bag and ``m`` themselves. Each
class is scored once against all items, and the ``k`` best classes of an item are expanded by ascending doc_id.

At most ``k`` members of a class can be among the ``k`` best of an item, and the best ``k`` documents lie in the ``k`` best classes by (score, smallest
member), so only these travel. The items are taken in shards of ``SHARD`` term occurrences (one shard up to about a hundred thousand items); a
shard's terms are a broadcast of bounded size. Equality of terms is equality of a 64-bit hash and of the bytes.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.words import Words, as_long, grouped_words
from tidewatch.session import run_dir

SHARD = 1 << 21
CELLS = 1 << 21                      # numbers in one dense block of classes by terms, and of terms by items
EXACT = float(1 << 53)               # integers below are exact in double precision


def _term(words: Words, k: int) -> bytes:
    return words.data[words.first[k] : words.last[k]].tobytes().lower()


def _counted(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, times, one place) of each distinct term of each text, in order of text and hash."""
    text = np.repeat(np.arange(len(words.ends) - 1), np.diff(words.ends))
    order = np.lexsort((words.hashes, text))
    t, h = text[order], words.hashes[order]
    new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (h[1:] != h[:-1]))) if len(t) else np.empty(0, np.int64)
    return t[new], h[new], np.diff(np.append(new, len(t))), order[new]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, words in grouped_words(batch.column(1), lower=True, letters=True):
            text, value, times, place = _counted(words)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start + text)), pa.array(as_long(value)), pa.array([_term(words, k) for k in place], pa.binary()), pa.array(times)],
                                             names=["item", "term", "name", "times"])


class Vocabulary:
    """Sorted hashes of the item terms and the bytes of each."""

    def __init__(self, terms: np.ndarray, names: list[bytes]):
        self.terms, self.names = terms, names

    def bags(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number of the term, times) of the item terms in each text, in order."""
        text, value, times, place = _counted(words)
        at = np.minimum(np.searchsorted(self.terms, value), max(len(self.terms) - 1, 0))
        hit = self.terms[at] == value if len(self.terms) else np.zeros(len(at), bool)
        text, at, times, place = text[hit], at[hit], times[hit], place[hit]
        one, first = np.unique(at, return_index=True)
        same = np.zeros(len(self.terms), bool)
        same[one] = [_term(words, place[k]) == self.names[t] for t, k in zip(one, first)]
        if not same[one].all():                      # a stranger with the hash of an item term: judge each word
            same = np.array([_term(words, k) == self.names[t] for t, k in zip(at, place)], bool)
        else:
            same = same[at]
        return text[same], at[same], times[same]


def _bag_rows(sent):
    """(doc_id, n, terms, times) of each document with a term."""
    def run(batches):
        vocabulary = Vocabulary(*sent.value)
        for batch in batches:
            for start, words in grouped_words(batch.column(1), lower=True, letters=True):
                n = np.diff(words.ends)
                some = np.flatnonzero(n)
                text, term, times = vocabulary.bags(words)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(text, minlength=len(n))[some])).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (term, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(start + some)), pa.array(n[some]), *lists], names=["doc_id", "n", "terms", "times"])
    return run


def _frequencies(size: int):
    """Documents that hold each term, by batch."""
    def run(batches):
        for batch in batches:
            df = np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])
    return run


class Items:
    """The items of a shard as (item, term, weight times occurrences), cut into blocks of neighbouring items whose dense form is small."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, cells: int):
        self.cells = cells
        order = np.argsort(item, kind="stable")
        self.item, self.term, self.weight = item[order], term[order], weight[order]
        self.names, begin = np.unique(self.item, return_index=True)
        self.begin = np.append(begin, len(self.item))

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(items, terms, dense weights of terms by items)."""
        at = 0
        while at < len(self.names):
            to = at + 1
            while to < len(self.names) and (to + 1 - at) * (self.begin[to + 1] - self.begin[at]) <= self.cells:
                to += 1
            part = slice(self.begin[at], self.begin[to])
            terms, row = np.unique(self.term[part], return_inverse=True)
            dense = np.zeros((len(terms), to - at))
            np.add.at(dense, (row, np.repeat(np.arange(to - at), np.diff(self.begin[at : to + 1]))), self.weight[part])
            yield self.names[at:to], terms, dense
            at = to


def _best(k: int, kept: tuple[np.ndarray, ...], new: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Of (item, score, first member, class number) rows the k best of each item: highest score, then smallest member, null members last."""
    rows = [np.concatenate(x) for x in zip(kept, new)]
    order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
    rows = [x[order] for x in rows]
    begin = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])) if len(rows[0]) else np.empty(0, np.int64)
    turn = np.arange(len(rows[0])) - np.repeat(begin, np.diff(np.append(begin, len(rows[0]))))
    return tuple(x[turn < k] for x in rows)


def _score_rows(sent, size: int, k: int, cells: int):
    """(item, score, members) of the k best classes of each item in the task; ``members`` are the class's k smallest doc_ids."""
    def run(batches):
        shard, none = Items(*sent.value, cells), (np.empty(0, np.int64),) * 4
        kept, floor, members, number = {}, {}, {}, 0                         # by block; members by class number
        for batch in batches:
            m, terms, times, own = (batch.column(i) for i in range(4))
            m, ends, flat, tf = m.to_numpy(), terms.offsets.to_numpy(), terms.values.to_numpy(), times.values.to_numpy()
            smallest = own.values.take(pa.array(own.offsets.to_numpy()[:-1]))
            smallest = np.where(smallest.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, smallest.fill_null(0).to_numpy())
            rows = np.repeat(np.arange(len(m)), np.diff(ends))
            flat, tf, ends = flat[ends[0] : ends[-1]], tf[ends[0] : ends[-1]], ends - ends[0]
            part = 1_000_000_000 * tf // (1000 * tf + 8 * m[rows])
            for b, (items, known, dense) in enumerate(shard.blocks()):
                column = np.full(size, -1, np.int64)
                column[known] = np.arange(len(known))
                step = max(1, cells // max(len(known), len(items)))
                exact = float(part.max(initial=0)) * float(dense.sum(axis=0).max(initial=0)) < EXACT
                least = floor.setdefault(b, np.ones(len(items)))
                for at in range(0, len(m), step):
                    to = min(at + step, len(m))
                    part_of = slice(ends[at], ends[to])
                    col = column[flat[part_of]]
                    use = col >= 0
                    left = np.zeros((to - at, len(known)))
                    left[rows[part_of][use] - at, col[use]] = part[part_of][use]
                    score = left @ dense if exact else left.astype(np.int64) @ dense.astype(np.int64)
                    r, i = np.nonzero(score >= least)
                    if len(r):
                        kept[b] = _best(k, kept.get(b, none), (items[i], score[r, i].astype(np.int64), smallest[at + r], number + at + r))
                        full, begin, have = np.unique(kept[b][0], return_index=True, return_counts=True)
                        least[np.searchsorted(items, full)] = np.where(have == k, kept[b][1][begin + have - 1], 1)
            alive = set(np.concatenate([x[3] for x in kept.values()]).tolist()) if kept else set()
            members = {c: members[c] if c < number else own[c - number].as_py() for c in alive}
            number += len(m)
        for item, score, _, name in kept.values():
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array([members[c] for c in name.tolist()], pa.list_(pa.int64()))], names=["item", "score", "members"])
    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, shard: int = SHARD, cells: int = CELLS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the ``k`` best documents with a positive score for each row of ``items`` (item_id, text).

    ``docs`` has doc_id and text; more columns of either table are ignored. A null text has no terms; items and documents without terms are in no
    row. Every row is a document (or item) of its own, so repeated rows come as often as they are there; null doc_ids are ranked last among
    equal scores. Long texts are taken whole.
    """
    spark, folder = docs.sparkSession, run_dir(docs.sparkSession, "bag-ranking")
    items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text").write.parquet(f"{folder}/items")
    items = spark.read.parquet(f"{folder}/items")
    items.select("item", "text").mapInArrow(_item_terms, "item long, term long, name binary, times long").write.parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    shards = max(1, -(-terms.count() // shard))
    found = [_rank_shard(docs, terms.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == s), f"{folder}/{s}", k, cells) for s in range(shards)]
    return reduce(DataFrame.union, found).join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _rank_shard(docs: DataFrame, terms: DataFrame, folder: str, k: int, cells: int) -> DataFrame:
    spark = docs.sparkSession
    rows = terms.toArrow()                                                   # about a shard's size
    value = rows["term"].to_numpy().view(np.uint64)
    known, example, number = np.unique(value, return_index=True, return_inverse=True)
    vocabulary = spark.sparkContext.broadcast((known, rows["name"].take(pa.array(example)).to_pylist()))
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_bag_rows(vocabulary), "doc_id long, n long, terms array<long>, times array<long>").write.parquet(f"{folder}/bags")
    bags = spark.read.parquet(f"{folder}/bags")
    total, length = bags.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = bags.select("terms").mapInArrow(_frequencies(len(known)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()      # one row per item term
    df = np.zeros(len(known), np.int64)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    weight = np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64)
    sent = spark.sparkContext.broadcast((rows["item"].to_numpy(), number, weight[number] * rows["times"].to_numpy()))
    wide = "cast(n AS decimal(18, 0)) * cast({} AS decimal(20, 0)) div cast({} AS decimal(20, 0))".format(75 * total, max(length, 1))
    classes = bags.where(F.size("terms") > 0).select("doc_id", (F.lit(25) + F.expr(wide)).alias("m"), "terms", "times").withColumn("bag", F.xxhash64("m", "terms", "times"))
    same = Window.partitionBy("bag", "m", "terms", "times").orderBy(F.asc_nulls_last("doc_id"))
    first = classes.withColumn("turn", F.row_number().over(same)).where(F.col("turn") <= k)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))), lambda x: x["doc_id"])
    whole = first.groupBy("bag", "m", "terms", "times").agg(ordered.alias("members")).select("m", "terms", "times", "members")
    scored = whole.mapInArrow(_score_rows(sent, len(known), k, cells), "item long, score long, members array<long>")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last(F.col("members")[0]))
    scored = scored.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= k).drop("turn")
    each = scored.select("item", "score", F.explode("members").alias("doc_id"))
    rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return each.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
