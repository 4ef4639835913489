"""The registered queries: each applies its operator with production parameters to the whole table."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.llm.bag_ranking import rank_documents
from tidewatch.llm.bpe import token_digests
from tidewatch.llm.catalog import query, table
from tidewatch.llm.chat import rotate_perspectives
from tidewatch.llm.collocations import mine_phrases
from tidewatch.llm.exact_search import exact_top_k
from tidewatch.llm.hnsw import near_neighbours
from tidewatch.llm.html_template import main_texts
from tidewatch.llm.jaccard import similar_documents
from tidewatch.llm.mixture import mix_sources
from tidewatch.llm.pii import BASE, with_spans
from tidewatch.llm.quality import fit_quality, score_quality
from tidewatch.llm.relative_lz import remove_repeats
from tidewatch.llm.toxicity import fit_toxicity, score_toxicity
from tidewatch.llm.vectors import usable

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


@query("op2_ngram_jaccard_join", f"""
  WITH RECURSIVE words AS (SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
  grams AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1),
              lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM words),
  sizes AS (SELECT doc_id, len(g)::BIGINT AS n FROM grams), flat AS (SELECT doc_id, unnest(g) AS g FROM grams),
  common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 85 * (s.n + t.n - c)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
  SELECT sizes.doc_id, n AS n_shingles, min(b) AS component_id FROM sizes JOIN reach ON a = doc_id GROUP BY 1, 2""")
def op2(spark, sf):
    return similar_documents(table(spark, sf, "documents"))


@query("op3_mix_sources", r"""
  WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                    ('0x' || md5('0:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS place FROM documents),
  p AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
        FROM d GROUP BY source),
  l AS (SELECT *, source_size * 2.0::DOUBLE AS lim FROM p),
  v AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
               / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
  t AS (SELECT source, source_size, CASE WHEN level * weight >= lim THEN lim
               ELSE weight * max(level) FILTER (level * weight < lim) OVER () END AS target FROM v),
  r AS (SELECT doc_id, size, d.source, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, place, doc_id) AS rank,
               CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
               ('0x' || md5('0/' || coalesce(d.source, ''))[1:8])::BIGINT / 4294967296.0::DOUBLE AS off
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
  SELECT doc_id, size, source_size, target, (floor(off + rate * rank) - floor(off + rate * (rank - 1)))::BIGINT * size AS taken FROM r""")
def op3(spark, sf):
    return mix_sources(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_pii")
def op8(spark, sf):
    found = with_spans(table(spark, sf, "documents"))
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    names = [k.name for k in BASE]
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long").alias(f"n_{n}")
    return found.select("doc_id", *[count(n) for n in names], F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(names))), 256).alias("base_sha256"),
                        listed("spans").alias("spans"))


@query("op4_substring_dedup", r"""
  WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
  d AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS lo FROM s) WHERE doc_id > lo),
  c AS (SELECT DISTINCT doc_id, i + k AS i FROM d, range(50) r(k)),
  a AS (SELECT doc_id, list_transform(w, lambda x, j: [x, j::VARCHAR]) AS w FROM w),
  f AS (SELECT doc_id, unnest(w) AS x FROM a),
  k AS (SELECT f.doc_id, string_agg(x[1], ' ' ORDER BY x[2]::BIGINT) AS kept, count(*) AS n FROM f LEFT JOIN c ON c.doc_id = f.doc_id AND c.i = x[2]::BIGINT WHERE c.i IS NULL GROUP BY 1)
  SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
  FROM w LEFT JOIN k ON k.doc_id = w.doc_id""")
def op4(spark, sf):
    kept = remove_repeats(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def in_fold():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


@query("op10_toxicity")
def op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf, "labels").where(~in_fold()))
    scored = score_toxicity(docs, model, "score")
    return scored.select("doc_id", in_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op5_exact_top_k", """
  WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  f AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM f q JOIN f c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)
  SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""")
def op5(spark, sf):
    rows = usable(table(spark, sf, "embeddings"))
    whole = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x).cast("double")).alias("embedding"))
    return exact_top_k(whole, whole.where("vec_id % 20 = 0"))


@query("op9_hnsw_neighbours")
def op9(spark, sf):
    rows = usable(table(spark, sf, "embeddings"))
    return near_neighbours(rows, rows.where("vec_id % 20 = 0"))


@query("op7_byte_bpe")
def op7(spark, sf):
    import public_tokenizers

    digests = token_digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return digests.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


@query("op6_html_template")
def op6(spark, sf):
    return main_texts(table(spark, sf, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op1_chat_perspectives", r"""
  WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS said_by, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
  s AS (SELECT DISTINCT conv_id, said_by AS speaker FROM t WHERE said_by <> 'system'),
  r AS (SELECT t.*, s.speaker, CASE WHEN said_by = speaker THEN 'assistant' WHEN said_by = 'system' THEN said_by
               ELSE 'user name=' || regexp_replace(said_by, '[\s<>|]+', '_', 'g') END AS role FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
  g AS (SELECT *, '<|im_start|>' || role || chr(10) AS head, '<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10) AS segment FROM r),
  e AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, said_by, body ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM g)
  SELECT conv_id, speaker, turn, role, segment, "end" - length(segment) AS start, "end", said_by = speaker AS trained,
         CASE WHEN said_by = speaker THEN "end" - length(segment) + length(head) END AS mask_start, CASE WHEN said_by = speaker THEN "end" - 1 END AS mask_end FROM e""")
def op1(spark, sf):
    return rotate_perspectives(table(spark, sf, "conversations"))


def in_quality_fold():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


@query("op13_quality")
def op13(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf, "labels").where(~in_quality_fold()))
    scored = score_quality(docs, model, "score")
    return scored.select("doc_id", in_quality_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op11_bag_ranking", f"""
  WITH i AS (SELECT item_id, term, count(*)::BIGINT AS q FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
  d AS (SELECT doc_id, t, len(t)::BIGINT AS n FROM (SELECT doc_id, {TERMS} AS t FROM documents) WHERE len(t) > 0),
  s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
  f AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2, 3),
  w AS (SELECT term, floor(1000 * ln((2 * s.docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY 1), s),
  p AS (SELECT doc_id, term, ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * s.docs) // s.terms))))::BIGINT AS part FROM f, s),
  r AS (SELECT item_id, doc_id, sum(q * w * part)::BIGINT AS score FROM i JOIN w USING (term) JOIN p USING (term) GROUP BY 1, 2)
  SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10""")
def op11(spark, sf):
    return rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op12_phrases", r"""
  WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
  g AS (SELECT lang, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k))),
  f AS (SELECT lang, g, count(*)::BIGINT AS a FROM g GROUP BY 1, 2), sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY 1),
  c AS (SELECT * FROM f WHERE len(g) > 1 AND a >= 30),
  cut AS (SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
          FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
  low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS turn FROM cut) WHERE turn = 1),
  part AS (SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer FROM (SELECT *, unnest(range(1, len(g) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(g))) AS m FROM c)) GROUP BY 1, 2),
  kept AS (SELECT low.*, array_to_string(low.g, ' ') AS phrase FROM low LEFT JOIN part ON part.lang = low.lang AND part.g = low.g WHERE coalesce(100 * longer, 0) < 80 * a)
  SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN sizes USING (lang) WHERE rank <= 2000""")
def op12(spark, sf):
    return mine_phrases(table(spark, sf, "documents"))
