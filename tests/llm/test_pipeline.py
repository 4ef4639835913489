"""The pipeline's stages one after the other against brute force, and on odd and empty tables."""
from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline as P
from tests_helpers import brute_components, base_spans, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_in_doc int, key string, d_mark long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels: clean, toxic, near copies, personal data, nulls and repeated rows."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = [], []
    for i in range(240):
        toxic = i % 6 == 0
        words = [f"w{(i * 7 + k * k) % 97}q{i if k % 3 else 0}" for k in range(20 + i % 50)]
        if toxic:
            words[i % 15] = ("blorp", "grunk!", "Skarn,")[i % 3]
        if i % 10 == 3:
            words[5] = f"me{i}@site.org"
        text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 4}" if i % 9 else None, len(text)))
        labels.append((i, int(toxic)))
        if i % 20 == 1:                                 # near copies
            rows.append((1000 + i, text + " end", "en", "s1", 0))
    rows += [(2000, None, None, "s0", None), (2001, "", "en", "s0", 0), (2002, "  \n", "en", None, 3), (None, "no id here at all", "en", "s2", 1), rows[7], rows[7], (8, "another text with the id of eight", "en", "s1", 5)]
    spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def staged(spark, folder, tmp):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp}/{name}")
        docs = spark.read.parquet(f"{tmp}/{name}")
        out.append(docs)
    return out


def test_stages(spark, corpus, tmp_path):
    import public_tokenizers as T
    import tiktoken

    from tidewatch.llm.bpe import read_ranks

    first = spark.read.parquet(f"{corpus}/documents.parquet")
    toxicity, near, personal, mixed, tokens = staged(spark, corpus, tmp_path)
    assert [k for k, _ in P.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixture", "tokens"]
    assert all(x.columns == first.columns for x in (toxicity, near, personal, mixed))
    bad = ("blorp", "grunk", "skarn")
    want = Counter((r.doc_id, r.text) for r in first.collect() if not any(b in (r.text or "").lower() for b in bad))
    rows = [(r.doc_id, r.text, None) for r in toxicity.collect()]
    assert Counter((i, t) for i, t, _ in rows) == want

    component = {i: c for i, _, c in brute_components(rows, 5, 80)}
    left = {(r.doc_id, r.text) for r in near.collect()}
    assert len(left) == near.count() and {i for i, _ in left} == {i for i, _, _ in rows if i is None or component[i] == i}
    assert left <= set(want) and {1001, 1021} & {i for i, _ in left} == set()

    kept = {}
    for r in near.collect():
        kept.setdefault(r.doc_id, []).append(r.text)
    for r in personal.collect():                        # eight has two texts
        assert any(r.text == t if not base_spans(t or "") else "[EMAIL]" in r.text and "@" not in r.text for t in kept[r.doc_id])
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert personal.count() == near.count()

    sizes, taken = Counter(), Counter()
    for r in personal.collect():
        sizes[r.source] += len(words_of(r.text))
    copies = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(copies) <= {(r.doc_id, r.text) for r in personal.collect()} and max(copies.values()) <= 2
    for r in mixed.collect():
        taken[r.source] += len(words_of(r.text))
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 5 * 2 * 75

    library = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=read_ranks(T.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in tokens.collect())
    assert got == Counter((r.doc_id, tuple(library.encode_ordinary(r.text or "")), r.text or "") for r in mixed.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in P.run(spark, corpus).collect()) == Counter((r.doc_id, r.n_tokens) for r in tokens.collect())


def test_stages_on_empty_tables(spark, corpus, tmp_path):
    folder = str(tmp_path / "in")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    assert all(x.collect() == [] for x in staged(spark, folder, tmp_path))


def test_no_text_is_lost_where_ids_clash(spark):
    one, two = (" ".join(f"{t}{i * 7 % 101}" for i in range(80)) for t in "xy")
    rows = [(5, one), (5, two), (5, two), (6, one + " more"), (9, two), (9, "short"), (None, one), (None, one)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row_with_text int")
    got = Counter((r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(5, one), (5, two), (9, "short"), (None, one), (None, one)])
