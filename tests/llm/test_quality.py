"""Quality: the forward pass against plain loops, the gradient against differences, held-out rows, odd rows."""
from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import quality as Q
from tidewatch.llm.words import grouped_words

TEXTS = ["One two, two|three 4!!\nFIVE five five $x ü", " lead " + "word " * 150 + "last. ", "", None, "a", "x" * 400 + " Y. " + " ".join(f"w{i}" for i in range(130))]


def plain_features(text):
    """Features of each passage by plain loops; hash slots are summed only, as their order is free."""
    found, out = list(re.finditer(r"[^\x20\x09-\x0D]+", text or "")), []
    for i in range(0, len(found), Q.WIDTH):
        ws = found[i : i + Q.WIDTH]
        raw = text[ws[0].start() : ws[-1].end()].encode()
        pairs = np.zeros((Q.CLASSES, Q.CLASSES))
        for a, b in zip(raw, raw[1:]):
            pairs[Q._CLASS[a], Q._CLASS[b]] += 1 / max(len(raw) - 1, 1)
        names = [w[0].encode() for w in ws]
        low = [bytes(c + 32 if 65 <= c <= 90 else c for c in n) for n in names]
        head, tail = [Q._CLASS[n[0]] for n in names], [Q._CLASS[n[-1]] for n in names]
        shape = [len(set(low)) / len(low), sum(a == b for a, b in zip(low, low[1:])) / len(low), sum(min(len(n), 40) for n in low) / len(low) / 10, np.mean([len(n) <= 2 for n in low]),
                 np.mean([len(n) > 15 for n in low]), np.mean([h == 1 for h in head]), np.mean([h > 2 for h in head]), np.mean([t > 2 and t != 14 for t in tail])]
        out.append((pairs.ravel(), np.array(shape)))
    return out


def test_features_by_plain_loops():
    texts = pa.array(TEXTS * 3 + ["k v " * 200_000])
    got = {i: [] for i in range(len(texts))}
    for start, words in grouped_words(texts, lower=True):
        for text, x in Q.features(words):
            for t, row in zip(text, x):
                got[start + t].append(row)
    for i, text in enumerate(TEXTS):
        want = plain_features(text)
        assert len(want) == len(got[i]) and all(np.array_equal(a, b) for a, b in zip(got[i], got[i + len(TEXTS)]))
        for (pairs, shape), row in zip(want, got[i]):
            assert np.allclose(row[:256], pairs, atol=1e-6) and np.allclose(row[-Q.SHAPES :], shape, atol=1e-6) and math.isclose(row[256:-Q.SHAPES].sum(), 1, abs_tol=1e-5)
    assert len(got[len(texts) - 1]) == 400_000 // Q.WIDTH


def drawn_model(seed=3):
    model = Q.Model(0.5)
    model.start(np.zeros(Q.SIZE), np.full(Q.SIZE, 0.1), seed)
    model.bias[:] = 0.2
    return model


def test_scores_by_plain_loops():
    model, texts = drawn_model(), pa.array([*TEXTS, "k v. " * 300_000])
    sig = lambda z: 1 / (1 + math.exp(-z))
    got = np.concatenate([model.scores(words) for _, words in grouped_words(texts, lower=True)])
    for i in range(len(texts)):
        bag = [x for _, words in grouped_words(texts.slice(i, 1), lower=True) for _, block in Q.features(words) for x in block]
        h = [np.tanh(np.clip(x.astype(float) / 0.1, -6, 6) @ model.encode + model.shift) for x in bag]
        weights = [math.exp(sum(model.attend[g] * math.tanh(v @ model.tanh_gate[:, g]) * sig(v @ model.sigmoid_gate[:, g]) for g in range(Q.GATES))) for v in h]
        want = sig(sum(w * v for w, v in zip(weights, h)) @ model.weigh / sum(weights) + 0.2) if bag else 0.5
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_gradient_by_differences():
    model, rng = drawn_model(), np.random.default_rng(1)
    x, begin, label = rng.normal(size=(9, Q.SIZE)), np.array([0, 1, 4]), np.array([1.0, 0, 1])
    _, grads = model.gradient(x, begin, label)
    for name, g in zip(model.NAMES, grads):
        value = getattr(model, name)
        for at in [np.unravel_index(k, value.shape) for k in rng.integers(0, value.size, 6)]:
            kept, h = value[at], 1e-5
            value[at] = kept + h
            up = model.gradient(x, begin, label)[0]
            value[at] = kept - h
            down = model.gradient(x, begin, label)[0]
            value[at] = kept
            assert g[at] == pytest.approx((up - down) / 2 / h, abs=1e-6)


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    known = labels.where("crc32(cast(doc_id as string)) % 3 != 1")
    model = Q.fit_quality(docs, known, sample=1500)
    assert all(np.array_equal(getattr(model, k), getattr(Q.fit_quality(docs.repartition(5), known, sample=1500), k)) for k in model.NAMES)
    found = {r.doc_id: r.quality_score >= 0.5 for r in Q.score_quality(docs, model).select("doc_id", "quality_score").collect() if r.doc_id in held}
    good, bad = ([found[i] for i, q in held.items() if q == k] for k in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_attention_finds_the_passage_and_odd_rows(spark):
    rows, labels = [], []
    for i in range(400):                                # one bad passage among ten makes a text bad
        parts = [" ".join(f"good{(i * 7 + k * 3 + j) % 50}" for j in range(Q.WIDTH)) for k in range(10)]
        if i % 2:
            parts[i % 10] = " ".join(f"BAD#{(i + j) % 40}" for j in range(Q.WIDTH))
        rows.append((i, " ".join(parts)))
        labels.append((i, 1 - i % 2))
    odd = [(None, None), (900, ""), (901, " \t\n"), (902, "BAD#1 " * 300_000), (3, rows[3][1]), (3, rows[4][1])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "doc_id long, text string, label string, Quality_Score int")
    known = spark.createDataFrame([*labels, (None, 1), (7, None), (8, 5), (9, 0), (9, 1)], "doc_id long, quality int")
    model = Q.fit_quality(docs, known)
    scored = Q.score_quality(docs, model)
    assert scored.columns == ["doc_id", "text", "label", "quality_score"] and scored.count() == len(rows) + len(odd)
    got = {r.doc_id: r.quality_score for r in scored.where("doc_id IS NULL OR doc_id != 3").collect()}
    assert all((got[i] >= 0.5) == bool(q) for i, q in labels if i != 3) and got[902] < 0.5 and got[None] == got[900] == got[901] == model.prior
    none = Q.fit_quality(docs, known.limit(0))
    assert {r.quality_score for r in Q.score_quality(docs, none).collect()} == {0.5}
    assert Q.fit_quality(docs, known, passages=25).encode is not None and Q.fit_quality(docs, known, passages=5).encode is None
    assert Q.fit_quality(docs.limit(0), known).prior == 0.5 and Q.score_quality(docs.limit(0), model).collect() == []
