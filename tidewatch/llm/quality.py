"""Scores texts for quality by attention-based multiple-instance learning: a text is a bag of passages, and only the bag has a label.

A passage is ``WIDTH`` neighbouring words (the last one of a text may be shorter) with the white space between them. Each passage of a text is
encoded: shares of neighbouring byte classes, shares of words by hash slot, and how long, repeated and capitalised its words are (``features``),
standardised and sent through one layer of tanh units. A gated attention (tanh gate times sigmoid gate) gives each passage a weight, the weights
of a text's passages add up to one, and the score is a logistic function of the weighted sum of its encodings. All of it is learned from the
labels of whole texts, on at most ``sample`` labelled rows and ``passages`` passages.

A null text is an empty one. Texts without words have no passage and get the smoothed share of good texts in the sample as score, which is
also everyone's score where the labels are missing or all alike.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewatch.llm.words import Words, grouped_words
from tidewatch.session import broadcast_if_small, run_dir

WIDTH, BLOCK = 64, 4096
CLASSES, SLOTS, SHAPES = 16, 96, 8
SIZE = CLASSES * CLASSES + SLOTS + SHAPES
UNITS, GATES = 24, 12


def _byte_classes() -> np.ndarray:
    out = np.full(256, 15, np.uint8)
    out[128:] = 14
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".", ",", ";:", "!", "?", "\"'()-`", "|", "#$%&*@^~=+_", "<>{}[]\\/"]
    for k, group in enumerate(groups):
        out[[ord(c) for c in group]] = k
    return out


_CLASS = _byte_classes()


def _passage_bounds(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of each passage."""
    size = np.diff(words.ends)
    count = -(-size // WIDTH)
    text = np.repeat(np.arange(len(size)), count)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, words.ends[text] + turn * WIDTH


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts, features) of at most ``BLOCK`` passages at a time, in order."""
    text, start = _passage_bounds(words)
    stop = np.minimum(start + WIDTH, words.ends[text + 1])
    for at in range(0, len(text), BLOCK):
        t, a, b = text[at : at + BLOCK], start[at : at + BLOCK], stop[at : at + BLOCK]
        n, size = len(t), (b - a).astype(float)
        byte_from, byte_to = words.first[a], words.last[b - 1]
        length = byte_to - byte_from
        place = np.repeat(byte_from - (np.cumsum(length) - length), length) + np.arange(length.sum())
        kind = _CLASS[words.data[place]].astype(np.int64)
        owner = np.repeat(np.arange(n), length)
        inside = np.ones(len(place), bool)
        inside[np.cumsum(length) - 1] = False                                # the last byte of a passage has no neighbour in it
        pairs = owner[inside] * CLASSES**2 + kind[inside] * CLASSES + kind[np.flatnonzero(inside) + 1]
        out = np.zeros((n, SIZE), np.float32)
        out[:, : CLASSES**2] = np.bincount(pairs, minlength=n * CLASSES**2).reshape(n, -1) / np.maximum(length - 1, 1)[:, None]
        w = slice(int(a[0]), int(b[-1]))                                     # passages of a block are neighbours
        owner, hashes = np.repeat(np.arange(n), b - a), words.hashes[w]
        slots = owner * SLOTS + (hashes % np.uint64(SLOTS)).astype(np.int64)
        out[:, CLASSES**2 : CLASSES**2 + SLOTS] = np.bincount(slots, minlength=n * SLOTS).reshape(n, -1) / size[:, None]
        long = (words.last - words.first)[w]
        head, tail = _CLASS[words.data[words.first[w]]], _CLASS[words.data[words.last[w] - 1]]
        order = np.lexsort((hashes, owner))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        again = np.zeros(len(owner), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        mean = lambda x: np.bincount(owner, x, n) / size
        shapes = [mean(fresh[np.argsort(order)]), mean(again), mean(np.minimum(long, 40)) / 10, mean(long <= 2), mean(long > 15), mean(head == 1), mean(head > 2), mean((tail > 2) & (tail != 14))]
        out[:, CLASSES**2 + SLOTS :] = np.stack(shapes, axis=1)
        yield t, out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Standardisation, encoder, gates and output; ``prior`` is the score of a text without passages and, without ``encode``, of every text."""

    NAMES = ("encode", "shift", "tanh_gate", "sigmoid_gate", "attend", "weigh", "bias")

    def __init__(self, prior: float):
        self.prior = prior
        self.encode = None

    def start(self, mean: np.ndarray, spread: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        drawn = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.encode, self.shift = drawn(len(mean), UNITS), np.zeros(UNITS)
        self.tanh_gate, self.sigmoid_gate, self.attend = drawn(UNITS, GATES), drawn(UNITS, GATES), drawn(GATES)
        self.weigh, self.bias = drawn(UNITS), np.zeros(1)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Encodings, both gates and attention logits of standardised passages."""
        h = np.tanh(x @ self.encode + self.shift)
        p, q = np.tanh(h @ self.tanh_gate), _sigmoid(h @ self.sigmoid_gate)
        return h, p, q, (p * q) @ self.attend

    def gradient(self, x: np.ndarray, begin: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean log loss of bags, which start at the passages ``begin``, and its gradient by ``NAMES``."""
        h, p, q, e = self.passages(x)
        count = np.diff(np.append(begin, len(x)))
        bag = np.repeat(np.arange(len(begin)), count)
        a = np.exp(e - np.maximum.reduceat(e, begin)[bag])
        a /= np.add.reduceat(a, begin)[bag]
        z = np.add.reduceat(a[:, None] * h, begin, axis=0)
        score = _sigmoid(z @ self.weigh + self.bias)
        loss = -np.mean(np.log(np.where(label > 0.5, score, 1 - score)))
        d = (score - label) / len(label)
        dz = d[:, None] * self.weigh
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, begin)[bag])
        dp, dq = de[:, None] * self.attend * q * (1 - p**2), de[:, None] * self.attend * p * q * (1 - q)
        dh = (a[:, None] * dz[bag] + dp @ self.tanh_gate.T + dq @ self.sigmoid_gate.T) * (1 - h**2)
        return loss, [x.T @ dh, dh.sum(axis=0), h.T @ dp, h.T @ dq, (p * q).T @ de, z.T @ d, np.array([d.sum()])]

    def fit(self, x: np.ndarray, begin: np.ndarray, label: np.ndarray, rounds: int = 25, batch: int = 64, rate: float = 3e-3, decay: float = 1e-3) -> None:
        """Steps of adaptive moments down the log loss; the order of bags depends on their number alone."""
        rng, stop = np.random.default_rng(11), np.append(begin, len(x))[1:]
        first = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        second, step = {k: v.copy() for k, v in first.items()}, 0
        for _ in range(rounds):
            for bags in np.array_split(rng.permutation(len(label)), max(1, len(label) // batch)):
                size = stop[bags] - begin[bags]
                at = np.cumsum(size) - size
                rows = np.repeat(begin[bags] - at, size) + np.arange(size.sum())
                _, grads = self.gradient(x[rows], at, label[bags])
                step += 1
                for k, g in zip(self.NAMES, grads):
                    g = g + decay * getattr(self, k) * (k != "bias")
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    setattr(self, k, getattr(self, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))

    def scores(self, words: Words) -> np.ndarray:
        """Scores of the texts of ``words``; attention sums are carried over blocks of passages, so a text may be of any length."""
        n = len(words.ends) - 1
        if self.encode is None:
            return np.full(n, self.prior)
        top, total, mixed = np.full(n, -np.inf), np.zeros(n), np.zeros((n, UNITS))
        for text, raw in features(words):
            h, _, _, e = self.passages(self.standard(raw))
            begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            own = text[begin]
            high = np.maximum(top[own], np.maximum.reduceat(e, begin))
            fade = np.exp(top[own] - high)
            a = np.exp(e - np.repeat(high, np.diff(np.append(begin, len(text)))))
            total[own] = total[own] * fade + np.add.reduceat(a, begin)
            mixed[own] = mixed[own] * fade[:, None] + np.add.reduceat(a[:, None] * h, begin, axis=0)
            top[own] = high
        some = total > 0
        out = np.full(n, self.prior)
        out[some] = _sigmoid(mixed[some] / total[some, None] @ self.weigh + self.bias)
        return out


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, label, place, part, passages, features) of each text, in parts of at most ``BLOCK`` passages."""
    for batch in batches:
        for start, words in grouped_words(batch.column(0), lower=True):
            part = np.zeros(len(words.ends) - 1, np.int64)
            for text, x in features(words):
                begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                stop, own = np.append(begin, len(text))[1:], text[begin]
                rows = pa.array(start + own)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), batch.column(2).take(rows), batch.column(3).take(rows), pa.array(part[own]), pa.array(stop - begin),
                                                  pa.array([x[i:j].tobytes() for i, j in zip(begin, stop)])], names=["label", "place", "row", "part", "passages", "features"])
                part[own] += 1


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 6000, passages: int = 1 << 15) -> Model:
    """Model from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality 0 or 1) covers.

    At most ``sample`` rows are used, those with the smallest hashes of their doc_id, and of these, in that order, each whose passages fit
    into what is left of ``passages``. Null doc_ids and other labels are left out; a doc_id with both labels counts as 0.
    """
    spark, folder = docs.sparkSession, run_dir(docs.sparkSession, "quality")
    chosen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("long").alias("label"))
    chosen = chosen.select("doc_id", "label", F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(broadcast_if_small(chosen), "doc_id").select("text", "label", "place", F.xxhash64("text").alias("row"))
    found.mapInArrow(_encoded, "label long, place long, row long, part long, passages long, features binary").write.parquet(f"{folder}/encoded")
    encoded = spark.read.parquet(f"{folder}/encoded")
    sizes = encoded.groupBy("place", "row", "label").agg(F.sum("passages").alias("n"), F.count(F.when(F.col("part") == 0, 1)).alias("copies"))
    taken, left = [], passages
    for r in sizes.orderBy("place", "row").limit(sample).collect():
        if r.n // r.copies <= left:
            taken.append((r.place, r.row, r.label))
            left -= r.n // r.copies
    good = sum(label for _, _, label in taken)
    model = Model((good + 1) / (len(taken) + 2))
    if good == 0 or good == len(taken):
        return model
    keep = spark.createDataFrame(taken, "place long, row long, label long")
    rows = encoded.join(broadcast_if_small(keep), ["place", "row", "label"]).dropDuplicates(["place", "row", "part"])
    rows = rows.select("place", "row", "part", "label", "features").toArrow()                      # at most ``passages`` passages
    rows = rows.sort_by([(c, "ascending") for c in ("place", "row", "part")]).to_pydict()
    x = [np.frombuffer(b, np.float32).reshape(-1, SIZE) for b in rows["features"]]
    first = np.array(rows["part"]) == 0
    begin = (np.cumsum([len(p) for p in x]) - [len(p) for p in x])[first]
    x = np.concatenate(x)
    model.start(x.mean(axis=0), x.std(axis=0) + 1e-3)
    model.fit(model.standard(x), begin, np.array(rows["label"], float)[first])
    return model


def score_quality(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """``docs`` with the score, 0 to 1, in a new last column, whose name must not be ``text``; a column of that name (in any case) is replaced.
    Only the text counts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)                   # of fixed size
    docs = docs.select(*[c for c in docs.columns if c.lower() != column.lower()])
    place = [c.lower() for c in docs.columns].index("text")
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def run(batches):
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for start, words in grouped_words(batch.column(place), lower=True):
                scores[start : start + len(words.ends) - 1] = sent.value.scores(words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)
