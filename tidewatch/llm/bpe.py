"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each partition.

A task splits its texts into pieces and encodes each distinct piece once. The pieces are rows (word, pos, token) of an in-process DuckDB table; a
recursive query joins neighbouring tokens with the merge table and contracts, for each word and round, the leftmost pair of the lowest rank,
until no pair is left. An ordered aggregation turns the tokens of a word back into its bytes. Pieces are cut beforehand between two bytes that
no token holds side by side, as no merge crosses such a place. A round repeats what is left of each word, so rounds are limited per query and
the query is run again on what is not finished. A part of more than ``LONG`` bytes without such a place would take a round for each merge over
all that is left, the square of its length; it is merged with a heap instead (``_merge_long``), by the same rule.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.memory import releasing, worker_cache

#: Characters of text whose new pieces are encoded together, pieces kept, and tokens and rounds of one recursive query.
GROUP, KEPT, TOKENS, ROUNDS = 4_000_000, 900_000, 1_000_000, 32
#: Bytes of a part from which the heap is used.
LONG = 512

_STEPS = f"""
  CREATE OR REPLACE TABLE steps AS
  WITH RECURSIVE step AS (
    SELECT word, pos, token, 0 AS round FROM open
    UNION ALL
    (WITH pair AS (SELECT word, pos, token, round, lead(token) OVER w AS next, lead(pos) OVER w AS next_pos FROM step WINDOW w AS (PARTITION BY word ORDER BY pos)),
          best AS (SELECT p.word, arg_min({{'pos': p.pos, 'next_pos': p.next_pos, 'merged': m.merged}}, m.merged::BIGINT * 8589934592 + p.pos) AS b
                   FROM pair p JOIN merges m ON m.first = p.token AND m.second = p.next WHERE p.round < {ROUNDS} GROUP BY p.word)
     SELECT s.word, s.pos, CASE WHEN s.pos = b.pos THEN b.merged ELSE s.token END, s.round + 1 FROM step s JOIN best USING (word) WHERE s.pos <> b.next_pos)
  )
  SELECT * FROM step QUALIFY round = max(round) OVER (PARTITION BY word)"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 of the token, a space and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Encoder:
    """Pieces of text to tokens; keeps what it encoded, about ``most`` pieces (340 bytes each), over the tasks of a Python worker. A query takes
    about ``tokens`` bytes at a time."""

    def __init__(self, ranks: dict[bytes, int], most: int = KEPT, tokens: int = TOKENS):
        import duckdb

        self.ranks, self.kept, self.most, self.tokens = ranks, {}, most, tokens
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.inner = np.zeros(1 << 16, bool)                             # pairs of bytes that some token holds side by side
        for t in ranks:
            for x, y in zip(t, t[1:]):
                self.inner[x << 8 | y] = True
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self._table("merges", {"first": [m[0] for m in merges], "second": [m[1] for m in merges], "merged": [m[2] for m in merges]})
        self._table("vocabulary", {"token": list(ranks.values()), "bytes": [t.hex() for t in ranks]})

    def _table(self, name: str, columns: dict[str, list | np.ndarray]) -> None:
        rows = pa.table({k: pa.array(v, pa.string() if k == "bytes" else pa.int32()) for k, v in columns.items()})
        self.db.register("rows_in", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows_in")
        self.db.unregister("rows_in")

    def forget(self) -> None:
        """Drops the older half of the pieces when there are more than ``most``."""
        if len(self.kept) > self.most:
            for piece in list(islice(self.kept, len(self.kept) // 2)):
                del self.kept[piece]

    def encode(self, pieces: Iterable[str]) -> None:
        """Makes sure that all of these pieces are kept."""
        new = [p for p in pieces if p not in self.kept]
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        start, size = 0, 0
        for i, r in enumerate(raw):
            size += len(r)
            if size >= self.tokens or i + 1 == len(raw):
                self._run(new[start : i + 1], raw[start : i + 1])
                start, size = i + 1, 0

    def _merge_long(self, word: bytes) -> list[int]:
        """Merges the leftmost pair of the lowest rank, over and over, with a heap of the pairs there are."""
        ranks, n = self.ranks, len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[word[i : i + 2]], i, 2) for i in range(n - 1) if word[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if part[i] is not None else n
            if j >= n or len(part[i]) + len(part[j]) != size:           # one of the two has been merged since
                continue
            part[i], part[j] = part[i] + part[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (both := part[x] + part[y]) in ranks:
                    heapq.heappush(heap, (ranks[both], x, len(both)))
        return [ranks[t] for t in part if t is not None]

    def _run(self, pieces: list[str], raw: list[bytes]) -> None:
        """Encodes some pieces: a word of the table is a part of a piece between cuts, a position is a place in all of their bytes."""
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        whole = np.array([r in self.ranks for r in raw])                # a piece that is a token is not taken apart
        first = ends - np.array([len(r) for r in raw])
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.inner[data[:-1].astype(np.int64) << 8 | data[1:]]
        cut[first] = True
        piece = np.repeat(np.arange(len(raw)), ends - first)
        cut[:-1] &= ~whole[piece] | (np.arange(len(data)) == first[piece])
        word = np.cumsum(cut[:-1]) - 1
        length = np.bincount(word)
        keep = np.where(whole[piece], np.arange(len(data)) == first[piece], length[word] <= LONG)
        pos = np.flatnonzero(keep)
        token = self.byte[data[pos]]
        token[whole[piece[pos]]] = [self.ranks[r] for r, w in zip(raw, whole) if w]
        self._table("open", {"word": word[pos], "pos": pos, "token": token})
        self._table("parts", {"word": np.arange(len(length)), "piece": piece[np.flatnonzero(cut[:-1])]})
        self.db.execute("CREATE OR REPLACE TABLE final AS SELECT word, pos, token FROM open WHERE false")
        while self.db.execute("SELECT count(*) FROM open").fetchall()[0][0]:
            self.db.execute(_STEPS)
            self.db.execute(f"INSERT INTO final SELECT word, pos, token FROM steps WHERE round < {ROUNDS}")
            self.db.execute(f"CREATE OR REPLACE TABLE open AS SELECT word, pos, token FROM steps WHERE round = {ROUNDS}")
        begin = np.flatnonzero(cut[:-1])
        rows = [(w, begin[w] + k, t) for w in np.flatnonzero((length > LONG) & ~whole[piece[begin]])
                for k, t in enumerate(self._merge_long(data[begin[w] : begin[w] + length[w]].tobytes()))]
        if rows:
            self._table("long_parts", dict(zip(("word", "pos", "token"), zip(*rows))))
            self.db.execute("INSERT INTO final SELECT word, pos, token FROM long_parts")
        for i, ids, n, text in self.decode():
            self.kept[pieces[i]] = ids, n, bytes.fromhex(text)

    def decode(self) -> list[tuple[int, str, int, str]]:
        """Per piece of ``final``: its ids, their number, and in hexadecimal the bytes that they stand for."""
        return self.db.execute("""SELECT piece, string_agg(f.token::VARCHAR, ',' ORDER BY pos), count(*), string_agg(v.bytes, '' ORDER BY pos)
                                  FROM final f JOIN vocabulary v ON v.token = f.token JOIN parts p ON p.word = f.word GROUP BY piece""").fetchall()


_ENCODERS: dict[tuple, Encoder] = worker_cache()


def _encoder(path: str, ranks, *sizes: int) -> Encoder:
    """The encoder of this Python worker, which outlives a task. (A task's own function gets copies of the module's variables; this one does not.)"""
    if (path, *sizes) not in _ENCODERS:
        _ENCODERS[path, *sizes] = Encoder(ranks.value, *sizes)
    return _ENCODERS[path, *sizes]


def _encode(path: str, pattern: str, ranks, with_text: bool, group: int, *sizes: int):
    def run(batches):
        import regex

        find = regex.compile(pattern).findall
        encoder = _encoder(path, ranks, *sizes)
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            while at < len(texts):
                pieces, size, start = [], 0, at
                while at < len(texts) and size < group:
                    text = texts[at].as_py() or ""
                    size += len(text)
                    pieces.append(find(text))
                    at += 1
                encoder.forget()
                encoder.encode(set().union(*pieces))
                rows = []
                for p in pieces:
                    found = list(map(encoder.kept.__getitem__, p))
                    rows.append((sum(x[1] for x in found), ",".join([x[0] for x in found]), b"".join([x[2] for x in found])))
                n = pa.array([r[0] for r in rows], pa.int64())
                if with_text:
                    tokens = pa.array([[int(x) for x in r[1].split(",")] if r[1] else [] for r in rows], pa.list_(pa.int32()))
                    out = [tokens, pa.array([r[2].decode("utf-8", "replace") for r in rows], pa.string())]
                else:
                    out = [pa.array([hashlib.sha256(x).hexdigest() for x in column], pa.string()) for column in ((r[1].encode() for r in rows), (r[2] for r in rows))]
                yield pa.RecordBatch.from_arrays([ids.slice(start, at - start), n, *out], names=["doc_id", "n_tokens", "ids", "decoded"])
    return run


def _apply(docs: DataFrame, path: str, pattern: str, schema: str, with_text: bool, *sizes: int) -> DataFrame:
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))          # a vocabulary: its size does not depend on the data
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(releasing(_encode(path, pattern, ranks, with_text, *sizes), keep=True), f"doc_id {kind}, n_tokens long, {schema}")


def encode_documents(docs: DataFrame, path: str, pattern: str, group: int = GROUP, kept: int = KEPT, tokens: int = TOKENS) -> DataFrame:
    """doc_id, n_tokens, ids, decoded: the tokens of each text by the rank file at ``path``, and the text that they decode to.

    Each match of ``pattern`` is encoded by itself, without special tokens; characters that it does not match are left out. ``docs`` needs doc_id
    and text. A null or empty text has no tokens. Rows are independent of each other; an empty table gives no rows. The file has to be readable
    on the driver only. ``group``, ``kept`` and ``tokens`` bound what a worker holds (characters, pieces, bytes of a query) and change no result.
    """
    return _apply(docs, path, pattern, "ids array<int>, decoded string", True, group, kept, tokens)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded as in ``encode_documents``, with SHA-256 digests for the ids joined by commas and for the decoded bytes."""
    return _apply(docs, path, pattern, "ids string, decoded string", False, GROUP, KEPT, TOKENS)
