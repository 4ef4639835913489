"""Exact similarity join of documents on the Jaccard coefficient of their word shingles, by a partition of the shingle universe.

Two sets x and y with a similarity of at least p/100 differ in at most ``(100 - p)(|x| + |y|) / (100 + p)`` shingles. Shingles are hashed into
the segments of a size band. If each segment i of a document allows l(i) differences (-1: the segment is not used, 0: equal, 1: one shingle
more or less), and the sum of l(i) + 1 exceeds the possible number of differences, a similar document agrees in at least one segment.
``_plan`` sets, for each band, how many segments there are and how many of them allow one difference, at the least cost of signatures and
chance meetings; ``_probes`` drops from each document the segments it can spare, those with the fewest shingles first, as they meet most.

Signatures are grouped by key; those that meet none of a size that a similar set can have are left out. The member of a key's group that meets
most others over all keys is its center, so that the copies of a text have few centers between them. Each document is first compared with the center that it meets most often; members of the components found
that way need no further comparison. A center's members are then all that share a key of which it is the center, which covers every pair that
meets. Where they belong to several components, those outside the largest one are compared with all others in blocks of bounded size. That
comparison uses parity sketches: a set of n shingles has 4n to 8n bits, each the parity of the shingles that hash to it, so two sketches differ
in no more bits than the sets do in shingles, and pairs that differ too much are certain not to be similar. The others are verified by their
texts: first the nearest pair of each document and component, then, where these do not join, every pair left. Components are exact, and a
group of copies never turns into its pairs.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.graph import components
from tidewatch.llm.memory import releasing
from tidewatch.llm.words import as_long, gram_hashes, grouped_words, mix
from tidewatch.session import broadcast_if_small, cut, run_dir

#: Bits of a signature's role: found by equal segments or by one deletion, as indexed set or as probe.
INDEX, INDEX_LESS, PROBE, PROBE_LESS = 1, 2, 4, 8
#: Ratio of the largest and the smallest set size of a band.
BAND = 1.6
#: Assumed chance that two documents which are not similar agree in one shingle of a segment; only costs depend on it.
AGREE = 0.03
#: Members or probes of one center that are compared in one task.
BLOCK = 2000


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Sorted distinct hashes of all runs of ``width`` words of each text; of the whole sequence if it is shorter, none without words."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for start, words in grouped_words(batch.column(1), lower=True):
            grams, sets = gram_hashes(words.hashes, width), []
            for i in range(len(words.ends) - 1):
                own = words.text_words(i)
                n = own.stop - own.start
                s = grams[own.start : own.stop - width + 1].copy() if n >= width else gram_hashes(words.hashes[own], n) if n else grams[:0]
                s.sort()
                sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
            yield ids[start : start + len(sets)], sets


def _profile(width: int):
    def run(batches):
        for ids, sets in _sets(batches, width):
            ends, values = _flat(sets)
            totals = np.zeros((2, len(values) + 1), np.uint64)
            for k in (0, 1):
                np.cumsum(mix(values, 11 + k), out=totals[k, 1:])
            marks = totals[:, ends[1:]] - totals[:, ends[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.diff(ends)), *(pa.array(as_long(m)) for m in marks), pa.array(map(_sketch, sets), pa.binary())],
                names=["row", "n_shingles", "f1", "f2", "sketch"])
    return run


def _sketch(s: np.ndarray) -> bytes:
    """Parity of the shingles that hash to each of 4n to 8n bits."""
    bits = 64 << max(0, (4 * len(s) - 1) // 64).bit_length()
    return np.packbits(np.bincount((mix(s, 41) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1 == 1, bitorder="little").tobytes()


def _fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of fewer bits: the parities of bits that fall together add up."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _by_length(rows: np.ndarray, raw: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, matrix and quarter-length matrix of sketches, by their length in words."""
    groups: dict[int, list[int]] = {}
    for i in rows:
        groups.setdefault(len(raw[i]) // 8, []).append(i)
    whole = {w: (np.array(own), np.frombuffer(b"".join(raw[i] for i in own), np.uint64).reshape(-1, w)) for w, own in groups.items()}
    return {w: (own, matrix, _fold(matrix, max(1, w // 4))) for w, (own, matrix) in whole.items()}


def _near(size: int, sketch: np.ndarray, sizes: np.ndarray, sketches: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, differing bits) of the sets that may be similar to one set; ``sketches`` as ``_by_length`` has them. Sketches of a quarter of the
    length, which differ in no more bits, rule most pairs out first."""
    for words, (own, *matrices) in sketches.items():
        at = np.flatnonzero((sizes[own] * 100 >= size * percent) & (size * 100 >= sizes[own] * percent))
        total = sizes[own] + size
        for matrix in reversed(matrices):
            if len(at):
                low = min(matrix.shape[1], max(1, len(sketch) * matrix.shape[1] // words))
                apart = np.bitwise_count(_fold(matrix[at], low) ^ _fold(sketch[None, :], low)).sum(axis=1, dtype=np.int64)
                ok = 100 * (total[at] - apart) >= percent * (total[at] + apart)
                at, apart = at[ok], apart[ok]
        if len(at):
            yield own[at], apart


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum([0, *map(len, sets)], dtype=np.int64), np.concatenate([*sets, np.empty(0, np.uint64)])


def _compare(width: int, percent: int):
    """The pairs that are similar enough, from rows (a, b, text of a, text of b); the set of a is kept while rows share it."""
    def run(batches):
        last, kept = None, None
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (0, 1))
            links: tuple[list, list] = ([], [])
            at = 0
            for _, sets in _sets(iter([pa.RecordBatch.from_arrays([batch.column(1), batch.column(3)], names=["b", "text"])]), width):
                for s in sets:
                    text = batch.column(2)[at]
                    if last != (a[at], text):
                        last = (a[at], text)
                        kept = next(_sets(iter([pa.RecordBatch.from_arrays([batch.column(0)[at : at + 1], batch.column(2)[at : at + 1]], names=["a", "text"])]), width))[1][0]
                    both = np.concatenate([kept, s])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if common * 100 >= (len(both) - common) * percent:
                        links[0].append(a[at])
                        links[1].append(b[at])
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])
    return run


def band_of(size: int) -> tuple[int, int]:
    """First and last set size of the band that ``size`` is in."""
    low = 1
    while True:
        high = max(low, int(low * BAND) - 1)
        if size <= high:
            return low, high
        low = high + 1


def _differences(total: int, percent: int) -> int:
    return (100 - percent) * total // (100 + percent)


@lru_cache(maxsize=None)
def _plan(high: int, percent: int, documents: int) -> tuple[int, int]:
    """Segments of a band that ends at set size ``high``, and how many of them allow one difference, so that both kinds cover all differences.

    A segment of s shingles costs its signatures (1, or 1 + 2s with one-deletion neighbours) and the chance meetings that they bring among
    ``documents``. Fewer segments hold more shingles each and meet less often; those that allow one difference count twice.
    """
    need = _differences(high + high * 100 // percent, percent) + 1
    best = None
    for loose in sorted({*range(min(need // 2, 8) + 1), need // 4, need // 2}):
        parts = need - loose
        s = high / parts
        meet = documents * AGREE**s
        cost = (parts - loose) * (1 + meet) + loose * (1 + 2 * s + meet * (1 + 2 * s / AGREE))
        if best is None or cost < best[0]:
            best = (cost, parts, loose)
    return best[1], best[2]


def _probes(counts: np.ndarray, loose: int, need: int) -> np.ndarray:
    """Which segments a document probes: all but those that it can spare, emptiest first."""
    gain = np.where(np.arange(len(counts)) < loose, 2, 1)
    spare = gain.sum() - need
    used = np.ones(len(counts), bool)
    for i in np.argsort(counts, kind="stable"):
        if spare < gain[i]:
            break
        used[i] = False
        spare -= gain[i]
    return used


def _signatures_of(s: np.ndarray, percent: int, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and roles of one set."""
    size, keys, roles = len(s), [], []
    low, high = band_of(size)
    bands = [(low, high, True)]
    if low > 1 and -(-size * percent // 100) < low:
        bands.append((*band_of(low - 1), False))
    for first, last, own in bands:
        parts, loose = _plan(last, percent, documents)
        need = _differences(size + min(size, last), percent) + 1
        where = (mix(s, 21) % np.uint64(parts)).astype(np.int64)
        value = mix(s, 22)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, where, value)
        tag = mix(np.arange(parts, dtype=np.uint64) + np.uint64(last << 32), 23)
        used = _probes(np.bincount(where, minlength=parts), loose, need)
        keys.append(mix(sums + tag, 24))
        roles.append((INDEX if own else 0) + np.where(used, PROBE, 0))
        if loose:
            at = where < loose
            keys.append(mix(sums[where[at]] - value[at] + tag[where[at]], 24))
            roles.append((INDEX_LESS if own else 0) + np.where(used[where[at]], PROBE_LESS, 0))
    keys, roles = np.concatenate(keys), np.concatenate(roles)
    return keys[roles > 0], roles[roles > 0].astype(np.int8)


def _signatures(width: int, percent: int, documents: int):
    """Signatures of each set once a batch: copies that meet there give no further rows."""
    def run(batches):
        for ids, sets in _sets(batches, width):
            seen, out, rows = set(), [], 0
            for i, s in zip(ids, sets):
                if i is None or not len(s) or (mark := hashlib.blake2b(s.tobytes(), digest_size=16).digest()) in seen:
                    continue
                seen.add(mark)
                k, r = _signatures_of(s, percent, documents)
                out.append((k, np.full(len(k), i, np.int64), np.full(len(k), len(s), np.int32), r))
                rows += len(k)
                if rows >= 100_000:
                    yield _signature_batch(out)
                    out, rows = [], 0
            if out:
                yield _signature_batch(out)
    return run


def _signature_batch(out: list) -> pa.RecordBatch:
    k, i, n, r = (np.concatenate(x) for x in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(as_long(k)), pa.array(i), pa.array(n), pa.array(r)], names=["key", "row", "size", "role"])


def _plausible(percent: int):
    """Rows (a, b) of the pairs (a, b, sizes, sketches) that their sketches do not rule out."""
    def run(batches):
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                one, two = np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)
                near = _near(n[i], one, np.array([m[i]]), {len(two): (np.zeros(1, np.int64), two[None, :])}, percent)
                if sum(len(rows) for rows, _ in near):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
    return run


def _verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough. Texts travel, not hashes: they are shorter and compress."""
    left = docs.join(broadcast_if_small(pairs), F.col("row") == F.col("b")).select("a", "b", F.col("text").alias("text_b"))
    right = docs.join(broadcast_if_small(pairs.select("a").distinct()), F.col("row") == F.col("a"), "left_semi").select("row", F.col("text").alias("text_a"))
    both = left.join(right, F.col("a") == F.col("row")).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(releasing(_compare(width, percent)), "a long, b long").distinct()


def similar_documents(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id: each document with its set size and the smallest doc_id that it reaches by links.

    ``docs`` needs doc_id and text; other columns are ignored. Words are those of ``words.py``, in lower case (A-Z only). Two documents are linked when
    their distinct ``width``-word shingles have a Jaccard coefficient of at least ``percent``/100. A text with fewer words counts as one
    shingle; a null, empty or blank text has an empty set and is linked with nothing. A row whose doc_id is null is linked with nothing and has
    a null component. Rows that share a doc_id are compared each with its own text and are one document for the links (each keeps its own
    n_shingles; without words it is in no group). An empty table gives no rows.
    """
    return _groups(docs, width, percent, True).select("doc_id", "n_shingles", F.col("low").alias("component_id"))


def row_key() -> Column:
    """What tells rows apart: doc_id and text; null without doc_id."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")))


def similar_rows(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, row, n_shingles, first: like ``similar_documents``, but of rows, so that different texts with one doc_id are not linked by that.

    ``row`` is the row's ``row_key`` and ``first`` that of the row with the smallest doc_id (then key) in its group.
    """
    return _groups(docs, width, percent, False).select("doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("low.row")).otherwise(F.col("row")).alias("first"))


def _groups(docs: DataFrame, width: int, percent: int, by_id: bool) -> DataFrame:
    """doc_id, row, n_shingles and the smallest of the row's group: its doc_id with ``by_id``, where rows of one doc_id are linked, else (doc_id, row)."""
    spark, folder = docs.sparkSession, run_dir(docs.sparkSession, "jaccard")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    # Rows are the nodes, by the hash of doc_id and text; equal rows are one.
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    docs = named.select(row_key().alias("row"), "text")
    profile = kept(docs.mapInArrow(releasing(_profile(width)), "row long, n_shingles long, f1 long, f2 long, sketch binary"), "profile")
    classes = profile.where("n_shingles > 0 AND row IS NOT NULL")
    first = classes.groupBy("f1", "f2").agg(F.min("row").alias("rep"))
    rep_of = cut(classes.join(first, ["f1", "f2"]).select("row", "rep").distinct())
    names = named.where("doc_id IS NOT NULL").select("doc_id", row_key().alias("row")).distinct()
    names = kept(names.join(rep_of, "row", "left"), "names")
    shared = names.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a != last").select("doc_id", "a")
    extra = names.join(shared, "doc_id").where("rep != a").select("a", F.col("rep").alias("b")).distinct()       # rows of one document

    documents = 1 << max(first.count(), 1).bit_length()
    signatures = docs.mapInArrow(releasing(_signatures(width, percent, documents)), "key long, row long, size int, role byte")
    groups = kept(_meeting(signatures, percent), "groups")
    rows = groups.join(rep_of, "row").select("key", "rep").distinct()
    meets = rows.groupBy("rep").agg(F.count("*").alias("meets"))
    rows = rows.join(meets, "rep")
    centers = rows.groupBy("key").agg(F.max_by("rep", F.struct("meets", -F.col("rep"))).alias("center"))
    star = kept(rows.join(centers, "key").where("center != rep").groupBy("center", "rep").agg(F.count("*").alias("shared")), "star")
    best = star.groupBy(F.col("rep").alias("b")).agg(F.max_by("center", F.struct("shared", -F.col("center"))).alias("a")).select("a", "b")
    sketches = profile.join(rep_of.where("row = rep").select("row"), "row", "left_semi").groupBy("row").agg(F.any_value(F.struct("n_shingles", "sketch")).alias("s"))
    sketches = sketches.select("row", "s.n_shingles", "s.sketch")
    one, two = (sketches.select(F.col("row").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    best = best.join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(releasing(_plausible(percent)), "a long, b long")
    links = _verify(docs, kept(best, "best"), width, percent)
    links = cut(links.unionByName(extra) if by_id else links)
    for step in ("nearest", "every"):
        pairs = kept(_across(star, components(links), sketches, percent, step == "nearest"), step)
        links = cut(links.unionByName(_verify(docs, pairs, width, percent)))
    whole = components(links)
    smallest = F.min("doc_id") if by_id else F.min(F.struct("doc_id", "row"))
    low = names.where("rep IS NOT NULL").groupBy("rep").agg(smallest.alias("low")).join(whole, F.col("rep") == F.col("node"), "left")
    low = kept(low.select("rep", F.coalesce("component", "rep").alias("component"), "low"), "low")
    lowest = low.join(low.groupBy("component").agg(F.min("low").alias("low")).withColumnRenamed("low", "lowest"), "component").select("rep", F.col("lowest").alias("low"))
    linked = profile.join(names.join(lowest, "rep", "left").select("row", "doc_id", "low"), "row", "left")
    return linked.withColumn("low", F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("doc_id"))) if by_id else linked


def _meeting(signatures: DataFrame, percent: int) -> DataFrame:
    """(key, row) of the signatures that meet another in their key which may be similar by its size. Of two similar sets the larger one probes, so
    a probe needs an indexed set of ``percent``/100 of its size up to its own, and the other way round. Without this the segments that hold no
    shingle bring together whatever shares a band."""
    parts = {"index": INDEX | INDEX_LESS, "probe": PROBE | PROBE_LESS}
    sized = signatures.select("key", "row", "size", *[F.expr(f"if(role & {bits} > 0, size, null)").alias(name) for name, bits in parts.items()])
    ordered = "IGNORE NULLS OVER (PARTITION BY key ORDER BY size, row)"
    sized = sized.select("*", *[F.expr(f"{step}({name}) {ordered}").alias(f"{step}_{name}") for step in ("lag", "lead") for name in parts])
    probes = f"probe IS NOT NULL AND (lag_index * 100L >= size * {percent}L OR lead_index = size)"
    probed = f"index IS NOT NULL AND (lead_probe * {percent}L <= size * 100L OR lag_probe = size)"
    return sized.where(f"({probes}) OR ({probed})").select("key", "row")


def _across(star: DataFrame, found: DataFrame, sketches: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b) of a center's members in different components that their sketches do not rule out; with ``nearest`` one for each document and
    other component."""
    members = star.select("center", "rep").unionByName(star.select("center", F.col("center").alias("rep")).distinct())
    members = members.join(found, F.col("rep") == F.col("node"), "left").select("center", "rep", F.coalesce("component", "rep").alias("component"))
    counts = members.groupBy("center", "component").agg(F.count("*").alias("n"))
    groups = counts.groupBy("center").agg(F.sum("n").alias("all"), F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("n"))
    groups = groups.where("n < all").select("center", "largest", F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"),
                                            F.ceil((F.col("all") - F.col("n")) / BLOCK).cast("int").alias("probe_blocks"))
    members = members.join(groups, "center").withColumn("probe", F.col("component") != F.col("largest"))
    members = members.join(sketches, F.col("rep") == F.col("row"))
    place = lambda n, salt: F.pmod(F.xxhash64(F.col("rep"), F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = F.transform(every("probe_blocks"), lambda j: F.struct(place("blocks", 1).alias("i"), j.alias("j"), F.lit(0).alias("side")))
    probe_cell = F.transform(every("blocks"), lambda i: F.struct(i.alias("i"), place("probe_blocks", 2).alias("j"), F.lit(1).alias("side")))
    placed = members.withColumn("cell", F.explode(F.when(F.col("probe"), F.concat(cell, probe_cell)).otherwise(cell)))
    placed = placed.select("center", "cell.i", "cell.j", "cell.side", "rep", "component", "n_shingles", "sketch")
    return placed.groupBy("center", "i", "j").applyInArrow(_cell_pairs(percent, nearest), "a long, b long").distinct()


def _cell_pairs(percent: int, nearest: bool):
    def run(cell: pa.Table) -> pa.Table:
        side = cell["side"].to_numpy()
        ids, comp, sizes = (cell[c].to_numpy() for c in ("rep", "component", "n_shingles"))
        raw = cell["sketch"].to_pylist()
        sketches = _by_length(np.flatnonzero(side == 0), raw)
        out = []
        for i in np.flatnonzero(side == 1):
            for rows, apart in _near(int(sizes[i]), np.frombuffer(raw[i], np.uint64), sizes, sketches, percent):
                other = comp[rows] != comp[i]
                rows, apart = rows[other], apart[other]
                if nearest and len(rows) > 1:
                    rows = rows[np.argsort(apart, kind="stable")]
                    rows = rows[np.unique(comp[rows], return_index=True)[1]]
                out += [(min(x, y), max(x, y)) for x, y in zip(ids[rows].tolist(), [int(ids[i])] * len(rows))]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
    return run
