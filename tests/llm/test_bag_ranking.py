"""Ranked search against a plain version, with copies, ties, nulls, long texts and several shards."""
from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import bag_ranking as B
from tidewatch.llm.words import grouped_words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    docs = [(i, Counter(terms_of(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    total, length = len(docs), sum(n for _, _, n in docs)
    df, out = Counter(t for _, c, _ in docs for t in c), []
    for item, text in items:
        scores = []
        for i, c, n in docs:
            m = 100 - 75 + (75 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return Counter(out)


def rows_of(rng):
    words = ["alpha", "BETA", "gamma", "Ünit", "x1", "rare", "delta", "été", "日本", "the", "of"]
    docs = [(i, " ".join(rng.choices(words, [1, 2, 1, 1, 1, 0.05, 1, 1, 1, 20, 15], k=rng.choice([1, 3, 8, 40])))) for i in range(300)]
    docs += [(1000 + i, "alpha, beta of the copies; alpha!") for i in range(40)] + [(500 + i, "ALPHA beta-of the_COPIES alpha") for i in range(30)]
    docs += [(2000, None), (2001, ""), (2002, " .,- "), (2003, "the " * 400_000 + "rare"), (2004, "rare\x7fthe\x00of"), (None, "rare"), (None, "rare"), (7, docs[7][1]), (7, "rare")]
    items = [(0, "Alpha of copies"), (1, "rare, rare: the"), (2, None), (3, "--"), (4, "unknown terms"), (5, "日本 été ÜNIT"), (6, "the"), (6, "of"), (None, "gamma x1"), (0, "Alpha of copies")]
    return docs, items


@pytest.mark.parametrize("shard,cells", [(B.SHARD, B.CELLS), (6, 12)])
def test_plain_version(spark, shard, cells):
    docs, items = rows_of(random.Random(4))
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, terms string").repartition(5)
    got = B.rank_documents(frame, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int"), shard=shard, cells=cells)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain(docs, items)


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame(r, s) for r, s in (([(1, "a")], "doc_id long, text string"), ([(1, "a")], "item_id long, text string")))
    assert B.rank_documents(docs.limit(0), items).collect() == [] and B.rank_documents(docs, items.limit(0)).collect() == []
    assert len(B.rank_documents(docs, items).collect()) == 1


def test_scores_beyond_double_precision_stay_exact():
    class Sent:
        value = (np.zeros(2, np.int64), np.arange(2), np.array([1 << 40, 3]))
    batch = pa.RecordBatch.from_arrays([pa.array([25, 26]), pa.array([[0, 1], [0, 1]]), pa.array([[5, 7], [5, 7]]), pa.array([[4, 9], [None]], pa.list_(pa.int64()))], names=["m", "terms", "times", "members"])
    (out,) = B._score_rows(Sent, 2, 10, B.CELLS)([batch])
    score = lambda m: (1 << 40) * (5 * 10**9 // (5000 + 8 * m)) + 3 * (7 * 10**9 // (7000 + 8 * m))
    assert out.to_pydict() == {"item": [0, 0], "score": [score(25), score(26)], "members": [[4, 9], [None]]}


def test_a_stranger_with_the_hash_of_a_term_is_no_term():
    ((_, words),) = grouped_words(pa.array(["one two one", "two"]), lower=True, letters=True)
    value = {bytes(words.data[a:b]).decode(): h for a, b, h in zip(words.first, words.last, words.hashes)}
    known = np.array(sorted(value.values()), np.uint64)
    names = [next(n.encode() for n, h in value.items() if h == k) for k in known]
    text, _, times = B.Vocabulary(known, names).bags(words)
    assert sorted(zip(text, times)) == [(0, 1), (0, 2), (1, 1)]
    text, _, times = B.Vocabulary(known, [n if n == b"two" else b"other" for n in names]).bags(words)
    assert sorted(zip(text, times)) == [(0, 1), (1, 1)]
