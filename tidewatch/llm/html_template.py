"""Main text of web pages by template deduction over the different pages of a host.

Every page is parsed into tokens: the start tags, each with the path of elements above it, and the texts of blocks with their path. A token's
occurrence vector says how often it is on each page of the host. Tokens with equal vectors form an equivalence class; the vector is never built,
its fingerprint (an exclusive or over pages of a hash of page and count) is aggregated, so a host of any size is summed up in parts. Classes
that are on most pages of a host make its template. On a page a class only counts if its tokens stand in the class's order; the paths nest the
classes. What lies between template tokens are slots. The slots of the article are kept: those in an ``article`` or ``main`` element, else
in the deepest template container that holds most of the host's running text. Template texts, and parts whose element or name says that they
are menus, adverts or the like, are left out.
"""
from __future__ import annotations

import html
import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.session import broadcast_if_small, run_dir

#: Share of a host's different pages that a template token is on; different pages a host has at least before texts count as template; share of a host's text in its container.
SUPPORT, PAGES, HOLDS = 0.9, 10, 0.7
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "object", "annotation", "annotation-xml"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
         "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
         "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: A start tag of the key ends an open element of the set, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
OUT = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "label", "datalist", "noscript"}
#: Names that say so wherever they are in a compound of hyphens, and names that only do alone or beside ``_FILL`` and other such names: long-form is no form.
_OUT_PARTS = re.compile(
    r"(ads?|advert[a-z0-9]*|sponsor[a-z0-9]*|cookies?|consent|gdpr|popup|modal|newsletter|subscri[a-z0-9]*|signup|login|sidebar[a-z0-9]*|aside|nav|navbar|navigation|breadcrumbs?"
    r"|pagination|pager|toolbar|topbar|footer|copyright|comments?|disqus|recommend[a-z0-9]*|trending)")
_OUT_NAMES = re.compile(
    r"(promo[a-z0-9]*|banner[a-z0-9]*|notices?|alerts?|side|widgets?|menu[a-z0-9]*|masthead|header|replies|responses|share|sharing|social|related|tags?|toc|skip|hidden"
    r"|search|search(?:box|bar|form|field|input)|form)")
_FILL = re.compile(r"([0-9]+|site|global|js|block|box|bar|wrap|wrapper|container|inner|outer|area|section|list|items?|links?|buttons?|btn|icons?|group|field|input|top|bottom|left|right"
                   r"|primary|secondary|mobile|desktop|title|heading|label|stories|posts|articles|entries|cloud|panel|tools|toggle)")
_OWNERS = {"article", "post", "entry", "page"}
#: Names of what a page is about or how it is laid out; they are not split.
_WHOLE = re.compile(r"(?!tags?[-_](list|cloud|links?|box|wrap|wrapper|container)$)(tag|category|cat|topic|layout|overflow|format|type|status|template|theme|grid|col|row|flex)[-_]")
#: Inside an article these name its own title; names that start so say what a page has, not what the element is.
_TITLE_NAMES = {"header", "masthead", "banner", "tag", "tags"}
_STATES = re.compile(r"(has|with|no|without|is|not|show|hide)[-_]")
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$))", re.S)
_ATTRIBUTE = re.compile(r"(id|class|role|itemprop|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)


class Element(NamedTuple):
    tag: str
    path: str                  # signature of the element and those above it
    token: int                 # hash of the path
    out: bool                  # it or an element above it is no part of an article
    article: bool              # it or an element above it is an article or main element
    inside: tuple[int, ...]    # tokens of the elements above, and its own
    nested: bool               # it or an element above it is an article, not only a main element
    own: bool                  # it is an article or main element
    barred: bool               # it is out for more than names
    named: tuple[int, ...]     # numbers of the elements, it and those above, that are out by name


class Block(NamedTuple):
    text: str
    linked: int                # characters of it in links
    element: Element
    token: int                 # hash of path and text


@lru_cache(1 << 16)
def _named(name: str, inside: bool) -> bool:
    """Whether an id or class says that its element is no part of an article; ``inside`` an article some name its title."""
    if _STATES.match(name):
        return False
    is_out = lambda p: bool(_OUT_PARTS.fullmatch(p) or _OUT_NAMES.fullmatch(p)) and not (inside and p in _TITLE_NAMES)
    parts = [p for p in re.split(r"[-_]+", name) if p]
    if len(parts) < 2:
        return any(is_out(p) for p in parts)
    if _WHOLE.match(name):
        return False
    if any(_OUT_PARTS.fullmatch(p) for p in parts) or parts[0] == "related" and len(parts) == 2 and parts[1] in _OWNERS | {"story", "content"}:
        return True
    rest = parts[1:] if parts[0] in _OWNERS else parts
    return any(is_out(p) for p in rest) and all(is_out(p) or _FILL.fullmatch(p) for p in rest)


def _open(tag: str, attributes: str, above: Element | None, number: int, free: frozenset[int]) -> Element:
    found = {m[0].lower(): (m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    names = f"{found.get('id', '')} {found.get('class', '')}".lower().split()
    role = found.get("role", "").lower()
    body = tag == "main" or role == "main" or found.get("itemprop") == "articleBody"
    own = body or tag == "article" or role == "article"
    inside, nested = bool(above and above.article), bool(above and above.nested)
    # A name says nothing about an article, but of one in another, such as a comment.
    named = tag not in ("html", "body") and not body and not (own and not nested) and number not in free and any(_named(n, inside) for n in names)
    barred = (bool(above and above.barred) or tag in OUT or tag == "header" and not inside or role in _OUT_ROLES) and tag != "main"
    barred = barred or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    out_by = () if tag == "main" else (above.named if above else ()) + ((number,) if named else ())
    label = tag + "".join(f".{re.sub('[0-9]+', '0', n)}" for n in sorted(names))
    path = f"{above.path}/{label}" if above else label
    token = xxhash.xxh3_64_intdigest(path) >> 1
    return Element(tag, path, token, barred or bool(out_by), inside or own, (above.inside if above else ()) + (token,), nested or own and tag != "main" and role != "main", own, barred, out_by)


def parse(page: str) -> tuple[list[Element], list[Block]]:
    """Elements in page order and the blocks of text between block elements.

    A page whose only article is in an element that names leave out keeps it, if it is at least as long as the text elsewhere: then the name is
    that of a layout. Beside another article, or with several in it, the element is what its name says.
    """
    elements, blocks = _parse(page, frozenset())
    if not any(e.named and e.own for e in elements) or any(b.element.article and not b.element.out for b in blocks):
        return elements, blocks
    articles = {e.token for e in elements if e.own}
    only = [e for e in elements if e.own and e.named and not e.barred and articles.isdisjoint(e.inside[:-1])]
    if len(only) != 1:
        return elements, blocks
    freed = _parse(page, frozenset(only[0].named))
    inside = sum(_running(b) for b in freed[1] if b.element.article)
    return freed if inside and inside >= sum(map(_running, blocks)) else (elements, blocks)


def _parse(page: str, free: frozenset[int]) -> tuple[list[Element], list[Block]]:
    """Markup that is not closed or wrongly nested is taken as browsers do; the names of the elements with a number in ``free`` do not count."""
    stack: list[Element] = [_open("html", "", None, -1, free)]
    elements, blocks, held = [], [], []                      # held: texts of the block so far and whether they are in a link
    block_of = stack[0]

    def flush() -> None:
        nonlocal held
        text = " ".join(html.unescape("".join(t for t, _ in held)).split()) if held else ""
        if text:
            linked = sum(len(t) for t, a in held if a)
            blocks.append(Block(text, linked, block_of, xxhash.xxh3_64_intdigest(f"{block_of.path}\n{text}") >> 1))
        held = []

    def close(to: int) -> None:
        if any(e.tag in BLOCK for e in stack[to:]):
            flush()
        del stack[to:]

    def text(t: str) -> None:
        nonlocal block_of
        if t:
            if not held:
                block_of = next((e for e in reversed(stack) if e.tag in BLOCK), stack[0])
                if stack[-1].out:
                    block_of = block_of._replace(out=True)
            if stack[-1].out and not block_of.out:
                return                                      # an inline part that says it is no text of the article
            held.append((t, any(e.tag == "a" for e in stack)))

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = max(m.end(), m.start() + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            where = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if where and not (tag not in BLOCK and any(e.tag in BLOCK for e in stack[where:])):
                close(where)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in ("html", "body") and any(e.tag == tag for e in stack):
            continue
        if tag == "xmp":                                     # shown as it is
            flush()
            end = re.compile(r"</xmp(?=[\s/>])[^>]*>?", re.I).search(page, at)
            text(html.escape(page[at : end.start() if end else n], quote=False))
            flush()
            at = end.end() if end else n
            continue
        if tag in BLOCK:
            flush()
            if any(e.tag == "p" for e in stack):
                close(next(i for i, e in enumerate(stack) if e.tag == "p"))
            if tag in ("body", "article", "main") and any(e.tag == "head" for e in stack):
                close(next(i for i, e in enumerate(stack) if e.tag == "head"))
            if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit():
                close(len(stack) - 1)
        if tag in ENDS:
            ended, until = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in until:
                    break
                if stack[i].tag in ended:
                    close(i)
                    break
        if tag in EMPTY:
            if tag == "br":
                text(" ")
            continue
        stack.append(_open(tag, m[3], stack[-1], len(elements), free))
        elements.append(stack[-1])
    flush()
    return elements, blocks


def _running(block: Block) -> int:
    """Characters that count as running text."""
    return 0 if block.element.out or 2 * block.linked > len(block.text) else len(block.text)


def _tokens(batches):
    """Per page: each token with its kind (0 tag, 1 text), number, first place, and for tags the depth and running text inside."""
    for batch in batches:
        hosts, marks, pages = (batch.column(i).to_pylist() for i in range(3))
        rows = []
        for host, mark, page in zip(hosts, marks, pages):
            elements, blocks = parse(page or "")
            held: dict[int, int] = {}
            for b in blocks:
                for t in b.element.inside:
                    held[t] = held.get(t, 0) + _running(b)
            seen: dict[int, list] = {}
            for i, e in enumerate(elements):
                if e.token in seen:
                    seen[e.token][2] += 1
                else:
                    seen[e.token] = [e.token, 0, 1, i, len(e.inside), held.get(e.token, 0) if e.tag in BLOCK and not e.out else 0]
            for i, b in enumerate(blocks):
                if b.token in seen:
                    seen[b.token][2] += 1
                else:
                    seen[b.token] = [b.token, 1, 1, i, 0, 0]
            rows += [[host, mark, *x] for x in seen.values()]
        names = ["host", "mark", "token", "kind", "times", "place", "depth", "running"]
        columns = list(zip(*rows)) or [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=names)


def templates(pages: DataFrame, folder: str) -> DataFrame:
    """host, classes (tokens of each class in order, and kinds), container: the template of each host. ``pages`` has host and html.

    Copies of a page on a host count once: what is on all of them is the page's, not the template's. What it counts is kept in ``folder``. A class is on at least ``SUPPORT`` of a host's pages, so the tokens of a template are no more than a page has, divided by that share.
    """
    different = pages.select("host", "html").distinct().select("host", F.xxhash64("html").alias("mark"), "html")
    tokens = different.mapInArrow(_tokens, "host string, mark long, token long, kind long, times long, place long, depth long, running long")
    per = tokens.groupBy("host", "token", "kind").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("mark", "times")).alias("vector"), F.avg("place").alias("place"), F.max("depth").alias("depth"), F.sum("running").alias("running"))
    sizes = pages.select("host", F.xxhash64("html"), F.length("html")).distinct().groupBy("host").agg(F.count("*").alias("all"))     # no need to move the pages again
    frequent = per.join(broadcast_if_small(sizes), "host").where((F.col("pages") >= F.col("all") * SUPPORT) & ((F.col("kind") == 0) | (F.col("all") >= PAGES)))
    frequent.write.parquet(f"{folder}/frequent")                       # used three times, and made of all pages
    frequent = pages.sparkSession.read.parquet(f"{folder}/frequent")
    # Texts make a class of their own kind: they are judged as template texts, tags as the frame.
    classes = frequent.groupBy("host", "vector", "pages", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("tokens"))
    classes = classes.groupBy("host").agg(F.collect_list(F.struct("kind", "tokens")).alias("classes"))
    tags = frequent.where("kind = 0")
    total = tags.groupBy("host").agg(F.max("running").alias("most"))
    held = tags.join(total, "host").where(F.col("running") >= F.col("most") * HOLDS).groupBy("host").agg(F.max_by("token", F.struct("depth", "token")).alias("container"))
    return classes.join(held, "host", "left")


def _in_order(tokens: list[int], places: dict[int, int]) -> bool:
    found = [places[t] for t in tokens if t in places]
    return len(found) == len(tokens) and all(a < b for a, b in zip(found, found[1:]))


def extract(page: str, classes: list[dict] | None, container: int | None) -> list[str]:
    """Texts of the article's blocks in page order."""
    elements, blocks = parse(page)
    tags = {e.token: i for i, e in reversed(list(enumerate(elements)))}
    texts = {b.token: i for i, b in reversed(list(enumerate(blocks)))}
    frame: set[int] = set()
    template_texts: set[int] = set()
    for c in classes or ():
        if _in_order(c["tokens"], texts if c["kind"] else tags):
            (template_texts if c["kind"] else frame).update(c["tokens"])
    kept = [b for b in blocks if not b.element.out and b.token not in template_texts]
    article = [b for b in kept if b.element.article]
    if article:
        return [b.text for b in article]
    if container in frame and any(container in b.element.inside for b in kept):
        kept = [b for b in kept if container in b.element.inside]
    return [b.text for b in kept if 2 * b.linked <= len(b.text)]


def _extract(batches):
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
        texts = ["\n".join(extract(page or "", classes, container)) for page, classes, container in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text: the article of each page, its blocks joined by line breaks; an empty text where there is none.

    ``pages`` needs page_id, url and html; other columns are ignored. A null or empty html has no text. The host is what the url names between
    the slashes, without port, in lower case; pages whose url is null or names none share one host. Pages that repeat each have their text,
    but count once for the template. Texts are only taken for template texts on hosts of at least ``PAGES`` different pages. An empty table gives no rows.
    """
    spark, folder = pages.sparkSession, run_dir(pages.sparkSession, "html-template")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    templates(pages, folder).write.parquet(f"{folder}/templates")
    known = spark.read.parquet(f"{folder}/templates")
    joined = pages.join(broadcast_if_small(known), "host", "left").select("page_id", "url", "html", "classes", "container")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string")
