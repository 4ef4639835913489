"""Operators on documents against brute force: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""
from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest

from tidewatch.llm import jaccard
from tidewatch.llm.bpe import Encoder, encode_documents, read_ranks, token_digests
from tidewatch.llm.jaccard import similar_documents
from tidewatch.llm.mixture import mix_sources, take_copies
from tidewatch.llm.pii import redact, with_spans
from tidewatch.llm.relative_lz import remove_repeats
from tidewatch.llm.words import grouped_words
from tests_helpers import BASE, WORD, base_spans, brute_components

#: Further columns that the operators use as names themselves.
CLASH = "key string, size int, role string, rep string, center string, component string, mark string, place string, rows string, spans string, found string"


def documents(spark, rows):
    """rows: (doc_id, text, source)."""
    blank = tuple(None for _ in CLASH.split(","))
    return spark.createDataFrame([(*r, *blank) for r in rows], f"doc_id long, text string, source string, {CLASH}")


def sample(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß", "A", "a,"]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 4, 5, 9, 30, 80, 200]))) for _ in range(n // 4)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    texts = []
    for _ in range(n):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            words[rng.randrange(len(words) + 1) : 0] = passage.split()
        texts.append(rng.choice([" ", "  ", "\n", "\t"]).join(words))
    rows = [(i * 3 + 1, t, rng.choice(["b", "a", None, "ü"])) for i, t in enumerate(texts)]
    return rows + [(1000, None, "a"), (1001, "", "a"), (1002, " \n\t ", None), (1003, "ONE two", "z"), (1004, "one TWO", "z"), (None, texts[0], "b"), rows[5], rows[5]]


def test_words_are_those_of_bytes_split():
    texts = [t for _, t, _ in sample(1)] + ["a\x1cb c", "é\xa0x", "x\x0by\x0cz"]
    for lower in (False, True):
        seen = {}
        for start, words in grouped_words(pa.array(texts), lower):
            for i in range(len(words.ends) - 1):
                raw = (texts[start + i] or "").encode()
                raw = (raw.lower() if lower else raw).split()
                found = words.hashes[words.text_words(i)].tolist()
                assert len(raw) == len(found)
                for w, h in zip(raw, found):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("seed,width,percent,agree,block", [(1, 4, 85, 0.03, 2000), (2, 5, 80, 0.9, 7)])
def test_similar_documents(spark, monkeypatch, seed, width, percent, agree, block):
    monkeypatch.setattr(jaccard, "AGREE", agree)       # 0.9: segments that allow one difference; small blocks: several cells per center
    monkeypatch.setattr(jaccard, "BLOCK", block)
    jaccard._plan.cache_clear()
    rows = sample(seed)
    got = Counter(tuple(r) for r in similar_documents(documents(spark, rows), width, percent).collect())
    jaccard._plan.cache_clear()
    assert got == brute_components(rows, width, percent)


def test_rows_that_share_a_doc_id_are_compared_each_with_its_own_text(spark):
    rng = random.Random(9)
    words = lambda tag, n: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    long, short, other = words("l", 400), words("s", 100), words("o", 90)
    near = short[:98] + ["changed", "end"]
    rows = [(10, " ".join(long)), (10, " ".join(short)), (3, " ".join(near)), (7, " ".join(long[:395])), (8, " ".join(other)), (10, ""), (12, " ".join(other) + " more")]
    rows = [(i, t, "s") for i, t in rows]
    got = Counter(tuple(r) for r in similar_documents(documents(spark, rows), 4, 85).collect())
    assert {(i, c) for i, n, c in got if n} == {(10, 3), (3, 3), (7, 3), (8, 8), (12, 8)} and sum(got.values()) == len(rows)


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_meet_only_sizes_that_can_be_similar(spark, percent):
    rng = random.Random(percent)
    # Key 0: a segment without shingles holds all sets of a band, but no probe may be similar to the small ones.
    rows = [(0, i, 363 + i % 60, jaccard.INDEX) for i in range(300)] + [(0, 900, 720, jaccard.PROBE), (0, 901, 577, jaccard.INDEX)]
    rows += [(k, i, rng.randrange(1, 60), rng.choice([1, 2, 4, 5, 8, 10, 15])) for k in range(1, 80) for i in range(rng.randrange(1, 9))]
    want = set()
    for k, i, n, r in rows:
        for l, j, m, q in rows:
            if k == l and i != j and r & 12 and q & 3 and m <= n and 100 * m >= percent * n:
                want |= {(k, i), (k, j)}
    got = jaccard._meeting(spark.createDataFrame(rows, "key long, row long, size int, role byte"), percent).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert len(rows) > len(want) + 300 and sum(k == 0 for k, _ in want) == (2 if percent == 80 else 0)


def test_plans_cover_all_differences():
    for percent in (80, 85, 95):
        for size in [*range(1, 60), 100, 777, 5000]:
            low, high = jaccard.band_of(size)
            assert low <= size <= high
            for n in (10, 10**6, 10**12):
                parts, loose = jaccard._plan(high, percent, n)
                assert loose <= parts and parts + loose > jaccard._differences(high + high * 100 // percent, percent)


def test_remove_repeats(spark):
    rows = sample(3)
    seen = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = Counter()
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = {k + d for k in range(len(w) - 49) if i is not None and min(seen[tuple(w[k : k + 50])]) < i for d in range(50)}
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    got = remove_repeats(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == want
    assert sum(r.n_removed for r in got) > 500
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(s.end - s.start >= 50 for s in r.spans)


def test_mixture(spark):
    rows = sample(4, 300)
    got = mix_sources(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, len(WORD.findall(t or ""))) for i, t, s in rows)
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:                                         # what is above the limit goes to the others by weight
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left, open_ = left - sum(2.0 * sizes[s] for s in full), open_ - full
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
    longest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in order)
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in mix_sources(documents(spark, rows)).collect())
    copies = take_copies(documents(spark, rows))
    assert copies.columns == documents(spark, []).columns
    want = Counter()
    for r in got:
        want[r.doc_id, r.source, r.size] += r.copies
    assert Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in copies.collect()) == +want


def test_copies_shuffle_texts_once(spark):
    rows = [(1, "a b c", "s"), (None, "a b", None), (None, "a b", None), (2, None, "s"), (2, "", "s"), (3, "x y z", None)]
    copies = take_copies(documents(spark, rows))
    above = copies._jdf.queryExecution().executedPlan().toString().split("Join", 1)[0]
    assert "Window" in above and "Exchange" not in above
    taken = Counter()
    for r in mix_sources(documents(spark, rows)).collect():
        taken[r.doc_id, r.source, r.size] += r.copies
    assert Counter((r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in copies.collect()) == +taken


def test_personal_data(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "x.y+z@d-e.fr.", "@", "1.2.3.4", "256.1.1.1.7", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", "+", "5", " ", "-", ".", "é", "😀", "\n",
            "4111111111111111", "123456789012345678901234567890", "a@b", "_c@d.org", "+12345678901234567", "GB82 WEST 1234 5698 7654 32", "ssn 123-45-6789", "123-45-6789", "0" * 25 + "1.1.1.1"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(400)] + [None, "", "a@b.com_c@d.org", "iban GB82 WEST 1234 5698 7654 32 x", "GB82 WEST 1234 5698 7654 33", "x " * 5000 + "a@b.c"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in with_spans(frame).collect():
        spans = [(s.kind, s.start, s.end) for s in r.spans]
        assert [s for s in spans if s[0] in BASE] == base_spans(r.text or ""), r.text
        if r.text and r.text.startswith("iban"):
            assert ("iban", 5, 32) in spans
        assert not (r.text == "GB82 WEST 1234 5698 7654 33" and any(s[0] == "iban" for s in spans))
        assert all(0.5 <= s.score <= 1.2 for s in r.spans)
    clean = {r.doc_id: r.text for r in redact(frame).collect()}
    assert clean[400] is None and clean[401] == "" and clean[405] == "x " * 5000 + "[EMAIL]"
    for i, t in enumerate(texts[:400]):
        marks = [False] * len(t)
        for _, a, b in [s for s in base_spans(t)]:
            marks[a:b] = [True] * (b - a)
        assert (clean[i] == t) == (not any(marks)) or "[" in clean[i]
    assert redact(frame).columns == frame.columns


def test_bank_codes_beside_other_words(spark):
    one, two, short = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"
    cases = [("IBAN " + one + " BIC COBADEFFXXX", [one]), (two + " I think", [two]), (two + " 12 34", [two]), (short + " A1 B2 C3 D4 E5 F6 G7", [short]),
             (one + " " + two + " GB82 WEST 1234 5698 7654 32 X", [one, two, "GB82 WEST 1234 5698 7654 32"]), ("ID AB12 " + two + " OK", [two]), ("é😀 " + two + " BIC", [two]),
             ("DE89 3704 0044 0532 0130 01 BIC", []), (one + "BIC", []), ("X" + one, []), (two + ".", [two])]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in with_spans(frame).collect():
        assert [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] == cases[r.doc_id][1], r.text
    for r in redact(frame).collect():
        assert r.text.count("[IBAN]") == len(cases[r.doc_id][1])


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def test_bpe_equals_the_library(spark, tokenizer):
    path, pattern, library = tokenizer
    rng = random.Random(6)
    letters = "abcdefgh th é ñ ß 日本 😀 \n\t  '\"%1234567890" + "’—‍\u0000"
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 200))) for _ in range(60)]
    texts += ["", "a" * 1500, "ab" * 800, "x" * 600 + " " * 600, "日本語" * 200, " 'll don't I'VE", "<|endoftext|> plain"]
    frame = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    for r in encode_documents(frame, path, pattern).collect():
        text = texts[r.doc_id] if r.doc_id is not None else ""
        assert r.ids == library.encode_ordinary(text) and r.n_tokens == len(r.ids) and r.decoded == text
    for r in token_digests(frame, path, pattern).collect():
        text = texts[r.doc_id] if r.doc_id is not None else ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded == hashlib.sha256(text.encode()).hexdigest()


def test_long_parts_by_heap_equal_the_recursive_query(tokenizer, monkeypatch):
    from tidewatch.llm import bpe

    path, _, library = tokenizer
    rng = random.Random(7)
    pieces = ["".join(rng.choices("abcht", k=rng.randrange(2, 90))) for _ in range(40)]
    results = []
    for long in (1, 10**6):
        monkeypatch.setattr(bpe, "LONG", long)
        e = Encoder(read_ranks(path))
        e.encode(pieces)
        results.append([e.kept[p] for p in pieces])
    assert results[0] == results[1]


def test_empty_tables(spark, tokenizer):
    none = documents(spark, [])
    path, pattern, _ = tokenizer
    for out in (similar_documents(none), remove_repeats(none), mix_sources(none), take_copies(none), with_spans(none, column="pii"), redact(none), encode_documents(none, path, pattern)):
        assert out.collect() == []
