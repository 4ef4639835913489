"""Removes word sequences that an earlier document also holds, by relative Lempel-Ziv parsing against an index of all documents.

Each text is cut into reference blocks at anchors: every window of ``window`` words picks the 8-word run with the smallest hash in it, and
neighbouring windows that pick the same run form a block. Equal windows pick equal runs, so a window can only occur in blocks with the same
anchor. The index has for each (anchor, block content) the smallest document. A block whose content is in a smaller document extends the
current factor of the parse as a whole. At the boundaries of factors the content differs though the anchor is shared; there, and only there,
the windows of a block are looked up one by one. Runs of windows found make the factors, whose words are removed. As each block content is
kept once, with its smallest document, a passage in thousands of documents costs no more than its places.
"""
from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.words import _powers, as_long, gram_hashes, grouped_words, mix
from tidewatch.session import run_dir

ANCHOR = 8
#: The low bits of an order key hold a word's place, so that the leftmost of equal runs is picked.
PLACE_BITS = np.uint64(26)
_STEP = 0xD1342543DE82EF95
_powers_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _step_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n, 1024).bit_length()
    if size not in _powers_kept:
        _powers_kept.clear()
        _powers_kept[size] = _powers(_STEP, size), _powers(pow(_STEP, -1, 1 << 64), size)
    return _powers_kept[size]


def _running(words: np.ndarray) -> np.ndarray:
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _step_powers(len(words) + 1)[0][: len(words)], out=total[1:])
    return total


def _content(total: np.ndarray, first: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hashes of the word sequences that start at ``first``."""
    return (total[first + length] - total[first]) * _step_powers(len(total))[1][first]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Smallest key of each run of ``width`` neighbours."""
    done, have = keys, 1
    while have * 2 <= width:
        done = np.minimum(done[:-have], done[have:])
        have *= 2
    return done if have == width else np.minimum(done[: len(done) - (width - have)], done[width - have :])


def _blocks(window: int):
    """Rows (anchor, content, doc_id, mark, first, windows): a block of ``windows`` window starts from word ``first``."""
    def run(batches):
        for batch in batches:
            ids, marks = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            for start, words in grouped_words(batch.column(2)):
                n = len(words.hashes)
                if n < window:
                    continue
                grams = mix(gram_hashes(words.hashes, ANCHOR), 31)
                keys = (grams >> PLACE_BITS << PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
                picked = (_least(keys, window - ANCHOR + 1) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
                text = np.repeat(np.arange(len(words.ends) - 1), np.diff(words.ends))
                valid = text[: n - window + 1] == text[window - 1 :]
                change = np.ones(len(valid), bool)
                change[1:] = (picked[1:] != picked[:-1]) | (text[1 : len(valid)] != text[: len(valid) - 1]) | ~valid[:-1]
                first = np.flatnonzero(valid & change)
                if not len(first):
                    continue
                stop = np.flatnonzero(np.append(change | ~valid, True))
                count = stop[np.searchsorted(stop, first, "right")] - first
                anchor = grams[picked[first]]
                content = _content(_running(words.hashes), first, count + window - 1)
                content = mix(content + mix((count << 32 | picked[first] - first).astype(np.uint64), 33), 34)
                row = text[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(anchor)), pa.array(as_long(content)), pa.array(ids[start + row]), pa.array(marks[start + row]),
                     pa.array((first - words.ends[row]).astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["anchor", "content", "doc_id", "mark", "first", "windows"])
    return run


def _windows(window: int):
    """Rows (anchor, word_hash, doc_id, mark, first) for each window of the given blocks of a text."""
    def run(batches):
        for batch in batches:
            ids, marks = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
            blocks = batch.column(3).to_pylist()
            for start, words in grouped_words(batch.column(2)):
                total = _running(words.hashes)
                parts = []
                for i in range(len(words.ends) - 1):
                    own = blocks[start + i]
                    first = np.concatenate([np.arange(b["first"], b["first"] + b["windows"]) for b in own])
                    parts.append((np.full(len(first), start + i), first, first + words.ends[i], np.repeat(np.array([b["anchor"] for b in own]), [b["windows"] for b in own])))
                row, first, at, anchor = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(as_long(mix(_content(total, at, window), 35))), pa.array(ids[row]), pa.array(marks[row]), pa.array(first.astype(np.int32))],
                    names=["anchor", "content", "doc_id", "mark", "first"])
    return run


def factors(found: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Greedy parse: spans (first word, last word exclusive) of the runs of found windows, given as (first, windows)."""
    out: list[tuple[int, int]] = []
    for first, count in sorted(found):
        end = first + count - 1 + window
        if out and first <= out[-1][1] - window + 1:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((first, end))
    return out


def _kept(window: int):
    def run(batches):
        for batch in batches:
            rows = {"doc_id": batch.column(0), "n_words": [], "n_removed": [], "spans": [], "text": []}
            for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
                words = (text.as_py() or "").encode().split()
                spans = factors([(f["first"], f["windows"]) for f in found or ()], window)
                keep = np.ones(len(words), bool)
                for a, b in spans:
                    keep[a:b] = False
                rows["n_words"].append(len(words))
                rows["n_removed"].append(len(words) - int(keep.sum()))
                rows["spans"].append([{"start": a, "end": b} for a, b in spans])
                rows["text"].append(b" ".join(compress(words, keep) if spans else words).decode())
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"], pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["spans"], pa.list_(span)),
                 pa.array(rows["text"], pa.string())], names=list(rows))
    return run


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, spans, text: each document without the words of windows that start in a document with a smaller doc_id.

    ``docs`` needs doc_id and text; other columns are ignored. Words are those of ``words.py``, unchanged; what is kept is joined by one space.
    ``spans`` are the removed word ranges. Windows are judged on the input. A null or blank text has no words; a text under ``window`` words
    loses nothing. Rows with the same doc_id, or a null one, are not smaller than each other; a null doc_id neither removes nor loses words.
    An empty table gives no rows.
    """
    spark, folder = docs.sparkSession, run_dir(docs.sparkSession, "relative-lz")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text"))
    blocks = docs.where("doc_id IS NOT NULL").mapInArrow(_blocks(window), "anchor long, content long, doc_id long, mark long, first int, windows int")
    blocks.write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")

    index = blocks.groupBy("anchor", "content").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = index.groupBy("anchor").agg(F.min("least").alias("lo"), F.max("most").alias("hi"), F.count("*").alias("contents")).where("lo < hi")
    index = index.join(shared.select("anchor", "contents"), "anchor").where("least < most OR contents > 1").select("anchor", "content", "least", "contents")
    judged = blocks.join(index, ["anchor", "content"]).where("doc_id > least OR contents > 1")
    judged.select("doc_id", "mark", "first", "windows", "anchor", (F.col("doc_id") > F.col("least")).alias("whole")).write.parquet(f"{folder}/judged")
    judged = spark.read.parquet(f"{folder}/judged")

    edge = judged.where("NOT whole").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "windows", "anchor")).alias("blocks"))
    windows = docs.join(edge, ["doc_id", "mark"]).select("doc_id", "mark", "text", "blocks")
    windows = windows.mapInArrow(_windows(window), "anchor long, content long, doc_id long, mark long, first int")
    windows.write.parquet(f"{folder}/windows")
    windows = spark.read.parquet(f"{folder}/windows")
    earliest = windows.groupBy("anchor", "content").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    single = windows.join(earliest, ["anchor", "content"]).where("doc_id > least").select("doc_id", "mark", "first", F.lit(1).alias("windows"))

    found = judged.where("whole").select("doc_id", "mark", "first", "windows").unionByName(single)
    found = found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("first", "windows")).alias("found"))
    return docs.join(found, ["doc_id", "mark"], "left").select("doc_id", "text", "found").mapInArrow(
        _kept(window), "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, text string")
