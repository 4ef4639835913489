"""Scores texts for toxicity with a factorization machine over hashed terms.

A term is a word in lower case or the start of one, 3 to 8 bytes long, as a 64-bit hash; a text has each term once or not at all. Besides a
weight per term the model has a vector per term, and the product of two vectors is the weight of the pair, so that terms can count for more
together than the sum of their weights.

The model is fitted on at most ``sample`` labelled rows, those with the smallest hash of their doc_id. A term in at least ``LEAST`` of them is
kept if it tells the labels apart better than chance would among so many terms (log likelihood ratio over twice the logarithm of their number),
the ``TERMS`` best at most: the model has a fixed size and is sent to all tasks.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.memory import releasing
from tidewatch.llm.words import as_long, grouped_words
from tidewatch.session import broadcast_if_small, run_dir

LEAST, TERMS, FACTORS = 3, 1 << 16, 8
STARTS = range(3, 9)


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def _terms(texts: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, text numbers, terms): the distinct terms of each text, as positions in ``known`` if that is given."""
    seen = None
    if known is not None:
        seen = np.zeros(1 << 20, bool)
        seen[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    for start, words in grouped_words(_lower(texts), letters=True):
        n = len(words.ends) - 1
        if not len(words.hashes):
            yield start, n, np.empty(0, np.int64), np.empty(0, np.uint64 if known is None else np.int64)
            continue
        word, example, kind = np.unique(words.hashes, return_index=True, return_inverse=True)
        length = (words.last - words.first)[example]
        term, owner = [word], [np.arange(len(word))]
        for k in STARTS:
            long = np.flatnonzero(length >= k)
            term.append(words.prefixes(example[long], k))
            owner.append(long)
        term, owner = np.concatenate(term), np.concatenate(owner)
        if known is not None:
            maybe = np.flatnonzero(seen[(term & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, term[maybe]), max(len(known) - 1, 0))
            hit = known[at] == term[maybe] if len(known) else np.zeros(len(maybe), bool)
            term, owner = at[hit], owner[maybe[hit]]
        order = np.argsort(owner, kind="stable")
        term, have = term[order], np.bincount(owner, minlength=len(word))
        begin = np.concatenate([[0], np.cumsum(have)])
        text = np.repeat(np.arange(n), np.diff(words.ends))
        pair = np.unique(text * len(word) + kind)
        pair = pair[have[pair % len(word)] > 0]
        text, kind = pair // len(word), pair % len(word)
        times = have[kind]
        place = np.repeat(begin[kind] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(kind) else np.empty(0, np.int64)
        text, found = np.repeat(text, times), term[place]
        order = np.lexsort((found, text))
        text, found = text[order], found[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
        yield start, n, text[new], found[new]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: terms with the number of texts of either label."""
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for start, _, text, term in _terms(batch.column(0)):
            value, at = np.unique(term, return_inverse=True)
            toxic = np.bincount(at, label[start + text], len(value)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(value)), pa.array(np.bincount(at, minlength=len(value))), pa.array(toxic)], names=["term", "texts", "toxic"])


def _rows(known: np.ndarray):
    def run(batches):
        for batch in batches:
            for start, n, text, term in _terms(batch.column(0), known):
                ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1)[start : start + n], batch.column(2)[start : start + n], lists], names=["toxic", "place", "terms"])
    return run


class Model:
    """Bias, term weights and term vectors; ``known`` are the sorted hashes of the terms."""

    def __init__(self, known: np.ndarray, bias: float, seed: int = 7):
        self.known, self.bias = known, bias
        self.weight = np.zeros(len(known))
        self.vector = np.random.default_rng(seed).normal(0, 0.02, (len(known), FACTORS))

    def logits(self, n: int, text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of ``n`` texts that have the given terms, and the sums of their vectors."""
        v = self.vector[term]
        sums = np.stack([np.bincount(text, v[:, f], n) for f in range(FACTORS)], axis=1)
        pairs = (sums**2).sum(axis=1) - np.bincount(text, (v**2).sum(axis=1), n)
        return self.bias + np.bincount(text, self.weight[term], n) + pairs / 2, sums

    def fit(self, ends: np.ndarray, term: np.ndarray, label: np.ndarray, rounds: int = 15, batch: int = 128, rate: float = 0.5, decay: float = 1e-4, floor: float = 1e-2) -> None:
        """Steps of adaptive size down the log loss, in an order of rows that only depends on their number."""
        rng = np.random.default_rng(11)
        w2, v2 = np.full(len(self.weight), floor), np.full(self.vector.shape, floor)
        for _ in range(rounds):
            for rows in np.array_split(rng.permutation(len(label)), max(1, len(label) // batch)):
                t = np.concatenate([term[ends[r] : ends[r + 1]] for r in rows])
                text = np.repeat(np.arange(len(rows)), (ends[rows + 1] - ends[rows]))
                z, sums = self.logits(len(rows), text, t)
                wrong = _sigmoid(z) - label[rows]
                self.bias -= rate * 0.1 * wrong.mean()
                used, at = np.unique(t, return_inverse=True)
                g = np.bincount(at, wrong[text], len(used)) / len(rows) + decay * self.weight[used]
                own = wrong[text][:, None] * (sums[text] - self.vector[t])
                h = np.stack([np.bincount(at, own[:, f], len(used)) for f in range(FACTORS)], axis=1) / len(rows) + decay * self.vector[used]
                w2[used] += g**2
                v2[used] += h**2
                self.weight[used] -= rate * g / np.sqrt(w2[used])
                self.vector[used] -= rate * 0.3 * h / np.sqrt(v2[used])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    """Model from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic 0 or 1) covers; at most ``sample`` rows, see above.

    Null labels and doc_ids are left out. Without labelled rows, or with one label only, scores are a smoothed share of the toxic ones.
    """
    spark, folder = docs.sparkSession, run_dir(docs.sparkSession, "toxicity")
    chosen = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("long").alias("toxic"), F.xxhash64("doc_id").alias("place"))
    chosen = chosen.orderBy("place", "doc_id", "toxic").limit(sample)
    docs.select("doc_id", "text").join(broadcast_if_small(chosen), "doc_id").select("text", "toxic", "place").write.parquet(f"{folder}/labelled")
    labelled = spark.read.parquet(f"{folder}/labelled")
    n, toxic = labelled.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = (toxic + 1) / (n + 10)
    bias = float(np.log(share / (1 - share)))
    if toxic == 0 or toxic == n:
        return Model(np.empty(0, np.uint64), bias)
    counts = labelled.select("text", "toxic").mapInArrow(releasing(_counts), "term long, texts long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic")).where(F.col("texts") >= LEAST)
    counts.write.parquet(f"{folder}/terms")
    counts, base = spark.read.parquet(f"{folder}/terms"), toxic / n
    part = F.col("toxic") / F.col("texts")
    gain = lambda q, p: F.when(q > 0, q * F.log(q / p)).otherwise(0.0)
    ratio = 2 * F.col("texts") * (gain(part, base) + gain(1 - part, 1 - base))
    chance = 2 * float(np.log(max(counts.count(), 2)))
    counts = counts.select("term", ratio.alias("ratio")).where(F.col("ratio") >= chance).orderBy(F.desc("ratio"), "term").limit(TERMS)
    known = np.sort(np.array([r.term for r in counts.select("term").collect()], np.int64).view(np.uint64))      # at most TERMS
    rows = labelled.mapInArrow(releasing(_rows(known)), "toxic long, place long, terms array<int>").toArrow()               # at most ``sample`` rows
    rows = rows.sort_by([("place", "ascending"), ("toxic", "ascending")]).combine_chunks()
    lists = rows["terms"].combine_chunks()
    model = Model(known, bias)
    model.fit(lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(), rows["toxic"].to_numpy().astype(float))
    return model


def score_toxicity(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """``docs`` with a score between 0 and 1. Only the text counts: null, empty and blank texts get the score of no terms. Other columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast((model.known, model.bias, model.weight, model.vector))       # fixed size, see TERMS
    schema = docs.select(*docs.columns, F.lit(0.0).alias(column)).schema

    def run(batches):
        known, bias, weight, vector = sent.value
        own = Model(np.empty(0, np.uint64), bias)
        own.weight, own.vector = weight, vector
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for start, n, text, term in _terms(batch.column(batch.schema.get_field_index("text")), known):
                scores[start : start + n] = _sigmoid(own.logits(n, text, term)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, column])

    return docs.mapInArrow(releasing(run), schema)
