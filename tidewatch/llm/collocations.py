"""Mines phrases of two to four words that occur together more often than their parts would suggest.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and tabs; everything counts per lang.

Counting is by direct address. Words are numbered by frequency, so that frequent ones have small numbers; pairs (phrase, next word) form tiles of
``Sizes.tile`` by ``Sizes.tile`` numbers. Tiles that expect many pairs are counted in dense arrays with ``bincount``, the pairs of all others as sorted
coordinates with counts. Frequent pairs are numbered by frequency again and paired with the next word: so come phrases of three and of four words.
Each task adds up its own pairs first and Spark sums them by pair, so that a frequent pair is one row per task.

Only the ``Sizes.ranked`` most frequent phrases of a length have numbers and are sent to the tasks; all others take part by their 64-bit keys, behind a
filter of fixed size that keeps most pairs that are too rare out of the shuffle. So nothing that is broadcast grows with the data. Words and phrases
are the same if their 64-bit keys are the same (words are grouped by their text as well).
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.words import Words, as_long, grouped_words, mix
from tidewatch.session import run_dir

LONGEST = 4


class Sizes(NamedTuple):
    """Bounds of what a task or a broadcast holds. They change no result."""

    tile: int = 256                  # numbers on a side of a tile
    ranked: int = 1 << 20            # phrases of a length that have numbers
    slots: int = 1 << 22             # of the filter for all others
    hot: int = 1 << 16               # phrases whose rows are joined by broadcast
    share: float = 1 / 128           # a tile is dense if it expects this share of all pairs
    buffer: int = 1 << 22            # pairs counted at once
    pending: int = 1 << 23           # coordinates a task holds before it hands them on


_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_ENDS = _BREAK.copy()
_ENDS[[32, 9]] = True


def lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def follow(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a phrase with one more word."""
    return mix(mix(phrase, 31) + word, 32)


def phrase_keys(words: np.ndarray) -> np.ndarray:
    """Keys of phrases, one phrase a row."""
    return reduce(follow, words.T)


def _keyed(batch: pa.RecordBatch) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray]]:
    """(first text, words, text of each word, key of each word) for groups of texts of a batch of (text, lang)."""
    langs = pc.dictionary_encode(pc.fill_null(batch.column(1), "und"))
    salt = np.array([lang_key(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
    for start, words in grouped_words(batch.column(0), lower=True, ends=_ENDS):
        text = np.repeat(np.arange(len(words.ends) - 1), np.diff(words.ends))
        yield start, words, text, mix(words.hashes ^ salt[start + text], 30)


def _spelled(words: Words, at: np.ndarray) -> pa.Array:
    """The given words as text."""
    first, length = words.first[at], words.last[at] - words.first[at]
    ends = np.append(0, np.cumsum(length))
    data = words.data[np.repeat(first - ends[:-1], length) + np.arange(ends[-1])]
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, key, times), a word once per batch."""
    for batch in batches:
        found = []
        for start, words, text, key in _keyed(batch):
            one, at, times = np.unique(key, return_index=True, return_counts=True)
            found.append((one, times, start + text[at], _spelled(words, at)))
        if not found:
            continue
        key, times, text = (np.concatenate([f[i] for f in found]) for i in range(3))
        one, at, group = np.unique(key, return_index=True, return_inverse=True)
        spelled, langs = pa.chunked_array([f[3] for f in found]).combine_chunks().take(pa.array(at)), pc.fill_null(batch.column(1), "und").take(pa.array(text[at]))
        yield pa.RecordBatch.from_arrays([langs, spelled, pa.array(as_long(one)), pa.array(np.bincount(group, times, len(one)).astype(np.int64))], names=["lang", "word", "key", "times"])


class Units:
    """The frequent phrases of a length: the most frequent ones with their rank in their lang, all others behind a filter."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, times: np.ndarray, others: np.ndarray, slots: int):
        """``lang`` is the key of the lang; ``others`` are the filter's slots that are taken."""
        self.langs, lang = np.unique(lang, return_inverse=True)
        order = np.lexsort((key, -times, lang))                              # by lang and rank
        self.key, self.lang, self.times, self.slots = key[order], lang[order], times[order], slots
        self.begin = np.searchsorted(self.lang, np.arange(len(self.langs) + 1))
        self.rank = np.arange(len(key)) - self.begin[self.lang]
        self.by_key = np.argsort(self.key, kind="stable")
        self.others = np.zeros(slots if len(others) else 0, bool)
        self.others[others] = True
        self.seen = None

    @classmethod
    def of(cls, table: DataFrame, sizes: Sizes) -> Broadcast:
        """Broadcast of the units of a table (key, lang, a), bounded by ``sizes``."""
        step = F.floor(F.log2("a") * 16)
        keep, low = 0, None
        for r in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():      # at most 1024 rows
            keep += r["count"]
            if keep > sizes.ranked:
                break
            low = r["step"]
        ranked = F.lit(False) if low is None else step >= low
        rows = table.where(ranked).select("key", "lang", "a").toArrow().combine_chunks()
        lang = np.empty(0, np.uint64)
        if len(rows):
            names = rows["lang"].combine_chunks().dictionary_encode()
            lang = np.array([lang_key(x) for x in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy()]
        slots = table.where(~ranked).select(F.col("key").bitwiseAND(sizes.slots - 1).alias("slot")).distinct().toArrow()["slot"].to_numpy()
        return table.sparkSession.sparkContext.broadcast(cls(rows["key"].to_numpy().view(np.uint64), lang, rows["a"].to_numpy(), slots, sizes.slots))

    def find(self, key: np.ndarray) -> np.ndarray:
        """Place of each key among the ranked units, -1 for none, -2 for one that may be among the others."""
        out = np.full(len(key), -1, np.int64)
        slot = (key & np.uint64(self.slots - 1)).astype(np.int64)
        if len(self.key):
            if self.seen is None:                                            # once per worker: most keys are ruled out by one look
                self.seen, self.ordered = np.zeros(self.slots, bool), self.key[self.by_key]
                self.seen[(self.key & np.uint64(self.slots - 1)).astype(np.int64)] = True
            maybe = np.flatnonzero(self.seen[slot])
            at = np.minimum(np.searchsorted(self.ordered, key[maybe]), len(self.key) - 1)
            hit = self.ordered[at] == key[maybe]
            out[maybe[hit]] = self.by_key[at[hit]]
        if len(self.others):
            out[(out == -1) & self.others[slot]] = -2
        return out


class Tiles:
    """Counts pairs (left unit, right word): dense tiles, sorted coordinates, and pairs of keys where a side has no number."""

    def __init__(self, left: Units, right: Units, sizes: Sizes):
        self.left, self.right, self.sizes, self.side = left, right, sizes, sizes.tile
        _, mine, self.same = np.intersect1d(left.langs, right.langs, return_indices=True)
        self.number = np.full(len(left.langs), -1)                           # a lang of both sides: its number in ``same``
        self.number[mine], self.lang_of = np.arange(len(mine)), mine
        cells, total = [], float(right.times.sum())
        for n, (i, j) in enumerate(zip(mine, self.same)):
            own = [u.times[u.begin[k] : u.begin[k + 1]].astype(float) for u, k in ((left, i), (right, j))]
            mass = [np.add.reduceat(x, np.arange(0, len(x), self.side)) for x in own]
            for r, c in zip(*np.nonzero(np.outer(*mass) >= sizes.share * total * mass[0].sum())):
                cells.append(n << 40 | int(r) << 20 | int(c))
        self.dense = np.array(sorted(cells), np.int64)
        self.counts = np.zeros(len(self.dense) * self.side**2, np.int64)
        self.pairs, self.sparse, self.loose, self.ready, self.held = [], [], [], [], 0

    def add(self, left: np.ndarray, right: np.ndarray, left_key: np.ndarray, right_key: np.ndarray) -> None:
        known = (left >= 0) & (right >= 0)
        if not known.all():
            self.loose.append((left_key[~known], right_key[~known]))
        self.pairs.append((left[known], right[known]))
        self.held += len(left)
        if self.held >= self.sizes.buffer:
            self.settle()

    def settle(self) -> None:
        """Counts what is held."""
        if self.pairs:
            left, right = (np.concatenate([c[i] for c in self.pairs]) for i in (0, 1))
            if len(self.dense):
                row, col, number = self.left.rank[left], self.right.rank[right], self.number[self.left.lang[left]]
                tile = number << 40 | row // self.side << 20 | col // self.side
                slot = np.minimum(np.searchsorted(self.dense, tile), len(self.dense) - 1)
                inside = self.dense[slot] == tile
                self.counts += np.bincount((slot * self.side**2 + row % self.side * self.side + col % self.side)[inside], minlength=len(self.counts))
                left, right = left[~inside], right[~inside]
            self.sparse.append(np.unique(left * len(self.right.key) + right, return_counts=True))
        if self.loose:
            left, right = (np.concatenate([c[i] for c in self.loose]) for i in (0, 1))
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            new = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
            self.ready.append((left[new], right[new], np.diff(np.append(new, len(left)))))
        self.pairs, self.loose, self.held = [], [], 0

    def rows(self, last: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(left key, right key, times): loose pairs at once, coordinates when there are many, dense tiles at the end."""
        if last:
            self.settle()
        yield from self.ready
        self.ready = []
        if self.sparse and (last or sum(len(s[0]) for s in self.sparse) > self.sizes.pending):
            code, times = (np.concatenate([s[i] for s in self.sparse]) for i in (0, 1))
            one, group = np.unique(code, return_inverse=True)
            self.sparse = [(one, np.bincount(group, times, len(one)).astype(np.int64))]
            if last or len(one) > self.sizes.pending // 2:
                (code, times), self.sparse = self.sparse[0], []
                yield self.left.key[code // len(self.right.key)], self.right.key[code % len(self.right.key)], times
        if last and len(self.dense):
            at = np.flatnonzero(self.counts)
            tile, row, col = self.dense[at // self.side**2], at // self.side % self.side, at % self.side
            lang = tile >> 40
            left = self.left.begin[self.lang_of[lang]] + (tile >> 20 & 0xFFFFF) * self.side + row
            right = self.right.begin[self.same[lang]] + (tile & 0xFFFFF) * self.side + col
            yield self.left.key[left], self.right.key[right], self.counts[at]


def _pair_rows(left_sent, right_sent, width: int, sizes: Sizes):
    """(prefix, last, times) of the phrases of ``width`` words whose first and last ``width - 1`` words may be frequent phrases."""
    def run(batches):
        left, right = left_sent.value, right_sent.value
        tiles = Tiles(left, right, sizes)
        emit = lambda last: (pa.RecordBatch.from_arrays([pa.array(as_long(a)), pa.array(as_long(b)), pa.array(n)], names=["prefix", "last", "times"]) for a, b, n in tiles.rows(last))
        for batch in batches:
            for _, words, text, key in _keyed(batch):
                if len(key) < width:
                    continue
                piece = np.cumsum(_BREAK[words.data])[words.first]
                joined = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
                phrase = key
                for k in range(1, width - 1):
                    phrase = follow(phrase[:-1], key[k:])
                whole = joined if width == 2 else np.logical_and.reduce([joined[k : len(joined) - width + 2 + k] for k in range(width - 1)])
                at = np.flatnonzero(whole)                                    # places where the whole phrase lies in one piece
                need = np.zeros(len(phrase), bool)
                need[at] = need[at + 1] = True
                place = np.full(len(phrase), -1, np.int64)
                some = np.flatnonzero(need)
                place[some] = left.find(phrase[some])
                at = at[(place[at] != -1) & (place[at + 1] != -1)]
                follower = place[at + 1] if width == 2 else right.find(key[at + width - 1])
                tiles.add(place[at], follower, phrase[at], key[at + width - 1])
                yield from emit(False)
        yield from emit(True)
    return run


def _joined(rows: DataFrame, table: DataFrame, on: str, hot: DataFrame) -> DataFrame:
    """Inner join with a table of unique keys. The keys of ``hot`` come by broadcast; any other phrase stands in few others."""
    near = rows.join(F.broadcast(hot), on)
    far = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(table, on)
    return near.unionByName(far)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words, ...) with the key of the phrase and of its words but the first."""
    for batch in batches:
        if batch.num_rows:
            words = batch.column(0).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(as_long(phrase_keys(words))), pa.array(as_long(phrase_keys(words[:, 1:])))], names=[*batch.schema.names, "key", "suffix"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of all shorter phrases inside phrases (words, a), with the a of the longer one."""
    for batch in batches:
        if batch.num_rows:
            words = batch.column(0).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            for k in range(2, words.shape[1]):
                for at in range(words.shape[1] - k + 1):
                    yield pa.RecordBatch.from_arrays([pa.array(as_long(phrase_keys(words[:, at : at + k]))), batch.column(1)], names=["key", "a"])


def mine_phrases(docs: DataFrame, least: int = 30, covered: int = 80, top: int = 2000, sizes: Sizes = Sizes()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each lang.

    ``a`` counts the phrase, at least ``least``; of its cuts into two the one with the smallest floor(2000000 * a / (l + r)) counts, ``l`` and ``r``
    being the counts of its two parts; ``n`` counts the words of the lang. Phrases inside a longer one with ``covered`` percent of their count are
    left out. ``docs`` has text and lang; a null text is empty, a null lang is ``und``. Repeated rows count each time; other columns are ignored.
    """
    spark, folder = docs.sparkSession, run_dir(docs.sparkSession, "collocations")
    texts = docs.select("text", F.col("lang").cast("string").alias("lang"))

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    words = written(texts.mapInArrow(_word_rows, "lang string, word string, key long, times long").groupBy("lang", "word", "key").agg(F.sum("times").alias("a")), "words")
    counted = F.array(F.col("a"))
    units = words.where(F.col("a") >= least).select("lang", "key", F.array("key").alias("words"), "a", counted.alias("heads"), counted.alias("tails"))
    levels, sent = [written(units, "level-1")], []
    for width in range(2, LONGEST + 1):
        below = levels[-1]
        sent.append(Units.of(below, sizes))
        pairs = texts.mapInArrow(_pair_rows(sent[-1], sent[0], width, sizes), "prefix long, last long, times long")
        pairs = written(pairs.groupBy("prefix", "last").agg(F.sum("times").alias("a")).where(F.col("a") >= least), f"pairs-{width}")
        hot = written(below.orderBy(F.desc("a"), "key").limit(sizes.hot), f"hot-{width}")
        named = lambda table, on, **cols: table.select(F.col("key").alias(on), *[F.col(c).alias(n) for n, c in cols.items()])
        first = {"lang": "lang", "words": "words", "heads": "heads"}
        found = _joined(pairs, named(below, "prefix", **first), "prefix", named(hot, "prefix", **first))
        found = found.select(F.concat("words", F.array("last")).alias("words"), "lang", "a", F.concat("heads", F.array("a")).alias("heads"))
        found = written(found.mapInArrow(_named, "words array<long>, lang string, a long, heads array<long>, key long, suffix long"), f"named-{width}")
        found = _joined(found, named(below, "suffix", tails="tails"), "suffix", named(hot, "suffix", tails="tails"))
        found = found.select("lang", "key", "words", "a", "heads", F.concat(F.array("a"), "tails").alias("tails"))
        levels.append(written(found, f"level-{width}"))
    inside = reduce(DataFrame.unionByName, [x.select("words", "a").mapInArrow(_parts, "key long, a long") for x in levels[2:]]).groupBy("key").agg(F.max("a").alias("longer"))
    cuts = F.expr("""array_min(transform(sequence(1, size(words) - 1), k -> struct(
        cast(2000000 AS decimal(7, 0)) * cast(a AS decimal(20, 0)) div cast(heads[k - 1] + tails[k] AS decimal(20, 0)) AS score, k, heads[k - 1] AS l, tails[k] AS r)))""")
    scored = reduce(DataFrame.unionByName, levels[1:]).join(inside, "key", "left").where(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * covered)
    scored = scored.select("lang", "key", "words", "a", cuts.alias("cut")).select("lang", "key", "words", "a", "cut.score", "cut.l", "cut.r")
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))      # equal ones stay together until they have their text
    best = written(scored.withColumn("place", place).where(F.col("place") <= top).drop("place"), "best")
    spelled = best.select("lang", "key", F.posexplode("words").alias("at", "word_key")).join(words.select(F.col("key").alias("word_key"), "word"), "word_key")
    spelled = spelled.groupBy("lang", "key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w")).select("lang", "key", F.concat_ws(" ", "w.word").alias("phrase"))
    sizes = words.groupBy("lang").agg(F.sum("a").alias("n"))
    ranked = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = best.join(spelled, ["lang", "key"]).withColumn("rank", F.row_number().over(ranked).cast("long")).where(F.col("rank") <= top)
    return out.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
