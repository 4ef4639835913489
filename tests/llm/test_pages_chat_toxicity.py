"""HTML extraction, chat formatting and toxicity."""
from __future__ import annotations

import zlib

import pytest

from tidewatch.llm.chat import assemble, rotate_perspectives
from tidewatch.llm.html_template import extract, main_texts
from tidewatch.llm.toxicity import fit_toxicity, score_toxicity


@pytest.mark.parametrize("page,want", [
    ("", []), ("no markup &amp; more", ["no markup & more"]), ("<p>a<p>b <i>c</i>d</p>", ["a", "b cd"]),
    ("<nav>menu</nav><article><h1>T &eacute;&nbsp;&#65;</h1><p><b>x<br>y<p>z</article><footer>f</footer>", ["T é A", "x y", "z"]),
    ("<script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><noscript>no</noscript>", ["yes"]),
    ("<body><div class='cookie-notice'>c</div><div id=side-bar class=sidebar>s</div><div class=content><h2>H</h2><ul><li>1<li>2</ul></div><section class='comments'><p>nice</p></section>", ["H", "1", "2"]),
    ("<main><form>name<input></form><p title='a>b'>in</p><aside>x</aside><div class='ad'>buy</div></main><p>out</p>", ["in"]),
    ("<article><p>a &lt;b&gt;</p><article class=comment><p>reader</p></article></article>", ["a <b>"]),
    ("<div class='with-sidebar'><article><div class='article-header'><h1>T</h1></div><p>x</p><div id=comments><p>c</p></div></article></div>", ["T", "x"]),
    ("<div class='sidebar-layout'><main><p>m</p></main><div class='related'><article><p>r</p></article></div></div>", ["m"]),
    ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]), ("<<<p>x</p", ["<<", "x"]), ("<p>cut &am", ["cut &am"]),
])
def test_extract(page, want):
    assert extract(page, None, None) == want


@pytest.mark.parametrize("page,want", [
    *[(f"<article class='{c}'><p>the article</p></article><p>out</p>", ["the article"]) for c in ("post hentry category-x tag-linux", "long-form", "overflow-hidden", "post hidden", "form", "related", "promo-box")],
    *[(f"<div class='{c}'><p>the article</p></div>", ["the article"]) for c in ("search-results post", "post tag-linux", "long-form", "overflow-hidden", "layout-sidebar", "elementor-widget-text-editor", "tag_ads")],
    ("<div class='search-results form'><article><p>the article</p></article></div><p>out</p>", ["the article"]),
    ("<main><article class='form'><p>the article</p></article></main>", ["the article"]),
    ("<article><div itemprop=articleBody class=form><p>the article</p></div></article>", ["the article"]),
    *[(f"<p>in</p><div class='{c}'>x</div>", ["in"]) for c in ("search-form", "related-posts", "related-post", "share-buttons", "post-tags", "tag-cloud", "site-footer", "ad-slot", "hidden", "promo", "tags-links")],
    ("<div class='post'>a text that is long</div><div class=related><article><p>a teaser</p></article></div>", ["a text that is long"]),
    ("<div class='post'>a</div><div id=comments><article><p>first reader</p></article><article><p>second reader</p></article></div>", ["a"]),
    ("<p>area <math><mi>r</mi><mo>&lt;</mo><mn>2</mn><annotation encoding='application/x-tex'>r&lt;2</annotation></math> holds</p><xmp><b>&amp;</xmp>", ["area r<2 holds", "<b>&amp;"]),
])
def test_names_do_not_lose_an_article(page, want):
    assert extract(page, None, None) == want


def test_main_texts_use_the_template_of_a_host(spark):
    body = "<html><body><div class=top><span>Daily site</span></div><div class=x><div class=y><h2>Head {0}</h2><p>Words of {0} that are long enough</p></div><p>All rights kept</p></div></body></html>"
    rows = [(i, f"http://Site.org:80/{i}", body.format(i), "clash") for i in range(30)]
    rows += [(99, None, None, None), (100, "nonsense", "", None), (101, "http://one.org", "<p>only</p>", None), (102, "http://one.org", "<p>only</p>", None), (5, rows[5][1], rows[5][2], None), (None, "http://one.org", "<p>null</p>", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = [(r.page_id, r.url, r.text) for r in main_texts(frame).collect()]
    assert sorted(got, key=str) == sorted([(i, u, f"Head {i}\nWords of {i} that are long enough" if "Site" in (u or "") else {99: "", 100: "", None: "null"}.get(i, "only")) for i, u, _, _ in rows], key=str)
    assert main_texts(frame.limit(0)).collect() == []


def test_copies_of_a_page_are_no_template(spark):
    body = "<html><body><p>Site</p><div><h2>Head of {0} as long</h2><p>Words of {0} as long</p></div></body></html>"
    names = {i: "a" if i < 40 else "b" for i in range(42)} | {100 + i: str(max(i - 180, 0)) for i in range(200)}
    rows = [(i, f"http://{'copies' if i < 100 else 'mixed'}.org/{i}", body.format(n)) for i, n in names.items()]
    got = {r.page_id: r.text for r in main_texts(spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head of {n} as long\nWords of {n} as long" for i, n in names.items()}


def test_chat(spark):
    rows = [(1, 0, "system", "be <|im_end|> kind"), (1, 1, "ann b", "hi"), (1, 2, "bob", None), (1, 3, "ann b", "é!"), (2, 0, "system", "alone"), (None, None, None, "x"), (3, 5, "u", "same"), (3, 5, "u", "same")]
    long = [(4, t, "a" if t % 2 else "b", "t" * (t % 5)) for t in range(700)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows + long], "conv_id long, turn long, role string, text string, start int, slice int")
    segments = rotate_perspectives(frame)
    whole = {(r.conv_id, r.speaker): (r.text, [(m.start, m.end) for m in r.masks]) for r in assemble(segments).collect()}
    assert set(whole) == {(1, "ann b"), (1, "bob"), (None, "unknown"), (3, "u"), (4, "a"), (4, "b")}
    text, masks = whole[1, "ann b"]
    assert text == ("<|im_start|>system\nbe < |im_end|> kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\né!<|im_end|>\n")
    assert [text[a:b] for a, b in masks] == ["hi<|im_end|>", "é!<|im_end|>"]
    assert [whole[1, "bob"][0][a:b] for a, b in whole[1, "bob"][1]] == ["<|im_end|>"]
    assert len(whole[4, "a"][1]) == 350 and all(whole[4, "a"][0][a - 10 : a] == "assistant\n" for a, _ in whole[4, "a"][1])
    for r in segments.collect():
        assert whole[r.conv_id, r.speaker][0][r.start : r.end] == r.segment
    assert rotate_perspectives(frame.limit(0)).collect() == []


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    known = spark.createDataFrame([(r.doc_id, r.toxic) for r in labels.collect() if r.doc_id not in held], "doc_id long, toxic int")
    model = fit_toxicity(docs, known)
    found = {r.doc_id: r.toxicity for r in score_toxicity(docs, model).where("doc_id IS NOT NULL").collect() if r.doc_id in held}
    toxic = [found[i] >= 0.5 for i, t in held.items() if t]
    clean = [found[i] >= 0.5 for i, t in held.items() if not t]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_toxicity_of_pairs_and_odd_rows(spark):
    rows, labels = [], []
    for i in range(600):                                # only both words together are toxic
        a, b = i % 2, i // 2 % 2
        rows.append((i, " ".join(["those"] * a + ["blorp"] * b + [f"w{i % 17}x", f"v{i % 13}y"])))
        labels.append((i, a & b))
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows] + [(None, None, None, None), (900, "", None, None), (901, "those blorp " * 30000, None, None), (3, rows[3][1], None, None)],
                                 "doc_id long, text string, term string, score double")
    model = fit_toxicity(docs, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int"))
    scored = score_toxicity(docs, model)
    assert scored.columns == [*docs.columns, "toxicity"]
    got = {r.doc_id: r.toxicity for r in scored.collect()}
    assert all((got[i] >= 0.5) == bool(t) for i, t in labels) and got[901] >= 0.5 and got[None] == got[900] < 0.5
    empty = fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.toxicity < 0.5 for r in score_toxicity(docs, empty).collect())
    assert score_toxicity(docs.limit(0), model).collect() == []
