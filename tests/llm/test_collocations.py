"""Phrases against a plain version: cuts, phrases inside longer ones, ties, langs, odd texts, and sizes so small that every path is taken."""
from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tidewatch.llm import collocations as C


def plain(rows, least, covered, top):
    count = {}
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        f = count.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            if 100 * longer[p] < covered * a:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return Counter(out)


def corpus():
    rng, rows = random.Random(2), []
    words = ["new", "YORK", "city", "of", "the", "über", "x" * 300, "日本", "end", "a-b"] + [f"w{i}" for i in range(60)]
    for i in range(400):
        text = []
        for _ in range(rng.choice([1, 5, 30])):
            text += rng.choice([["New", "york", "City"], ["the", "end", "of", "the"], ["big\tnew", "york"], ["q%d" % (i % 7), "pair"], rng.choices(words, k=3)])
            text.append(rng.choice(["", "", ".", ",", "\n", "!", "; :"]))
        rows.append((rng.choice([" ", "  ", "\t"]).join(text), ["en", "en", "de", None, "und", ""][i % 6]))
    return rows + [(None, "en"), ("", "en"), (" .,; \n", "fr"), ("a a a a a a a a a a", "aa"), ("deep sea " * 50_000, "en"), *[("same line of words here", "en")] * 40, ("b b", None)]


@pytest.mark.parametrize("sizes", [C.Sizes(), C.Sizes(tile=4, ranked=30, slots=64, hot=3, share=0.01, buffer=500, pending=100), C.Sizes(tile=2, ranked=0, slots=16, hot=1, buffer=1), C.Sizes(tile=8, share=0.0, buffer=2000, pending=50)])
def test_plain_version(spark, sizes):
    rows = corpus()
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, key long, a int").repartition(6)
    got = C.mine_phrases(frame, least=6, top=40, sizes=sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(map(tuple, got.collect())) == plain(rows, 6, 80, 40)


def test_ties_at_the_end_of_the_list_and_empty_tables(spark):
    rows = [(f"one{i} two{i}", "en") for i in range(30) for _ in range(30 + i % 2)]
    frame = spark.createDataFrame(rows, "text string, lang string")
    assert Counter(map(tuple, C.mine_phrases(frame, top=20).collect())) == plain(rows, 30, 80, 20)
    assert C.mine_phrases(frame.limit(0)).collect() == [] and C.mine_phrases(frame, least=1000).collect() == []


def test_keys_follow_words():
    batch = pa.RecordBatch.from_arrays([pa.array(["Ab cd. EF", None, "ab"]), pa.array(["x", "x", None])], names=["text", "lang"])
    ((_, words, text, key),) = C._keyed(batch)
    assert text.tolist() == [0, 0, 0, 2] and key[0] != key[3] and C._spelled(words, words.first.argsort()).to_pylist() == ["ab", "cd", "ef", "ab"]
    assert C.phrase_keys(key[None, :3])[0] == C.follow(C.follow(key[:1], key[1:2]), key[2:3])[0]
