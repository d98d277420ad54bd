r"""Main text of web pages by removal of site templates.

Each page is parsed into a tree; every element's subtree (tags and texts) is
hashed.  Spark counts, for each host, how many different pages hold a subtree;
subtrees on many pages of their host are template and are deleted: a quarter (three at least)
outside article and main, nine tenths (ten at least) inside.  Parts of a table are template only with
the whole table; a heading, list item, term or definition only where a neighbour recurs beside it, as
different articles share headings and items.  Elements that
say themselves what they are (menus, footers, forms, scripts, adverts, comments
and so on, by tag, role, class or id) are deleted on any host; inside article and main a name of several
parts says so only if every part does (``share-buttons``, not ``share-price``).

Text: character references decoded, white space inside a block made one space, ends
trimmed, empty blocks left out, blocks joined in page order by one line feed.
Where ``article`` and ``main`` elements hold more than half of what is left of a page, the text is theirs and that of
the headings and paragraphs beside them.

Null or empty html: empty text.  Broken markup: unclosed elements end with their
parent, stray end tags are ignored, an unclosed comment or script runs to the end.  A null
url has the empty host.  Repeated pages count as one page of their host.  Empty
table: no rows.  Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, settle

#: Share of a host's different pages, and their number, from which a subtree is template: inside article and main, where
#: many articles can share a text, and outside, where a host can have several layouts, languages or sections.
SHARE, PAGES = 0.9, 10
OUTSIDE_SHARE, OUTSIDE_PAGES = 0.25, 3
#: Never template as a whole: copies of an article are articles, and rows and cells go with their table.
KEPT = frozenset("# html body article main caption colgroup tbody td tfoot th thead tr".split())
#: Template only beside a neighbour that recurs, too.
PAIRED = frozenset("h1 h2 h3 h4 h5 h6 hgroup li dt dd".split())
#: The page's own text where they stand beside its article: titles and leads.
BESIDE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the second kind ends an open element of the first.
ENDS = {
    "p": BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "optgroup", "frameset"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
}
#: Elements beyond which an implied end does not reach.
FENCE = frozenset("article aside body div footer form header html main nav ol section table td th ul dl".split())

# What an element says of itself.
DROP_TAGS = frozenset(
    "script style noscript template nav footer aside form button select input textarea iframe object embed applet svg canvas "
    "menu dialog title xmp noembed noframes audio video map datalist".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist note".split())
DROP_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement "
    "advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login search share sharing social comment comments disqus reply replies respond related recommended recommendations "
    "widget widgets toolbar pagination pager skip masthead topbar copyright disclaimer".split()
)
HEADERS = frozenset("header masthead topbar site-header page-header".split())
#: Parts of names that say nothing of the contents.
FRAMES = frozenset("area bar block box button buttons container form frame icon icons inner link links list panel posts slot unit wrap wrapper".split())
#: First parts of names that tell of a layout: has-sidebar, no-sidebar, with-comments.
LAYOUT = frozenset("has no not with without".split())
#: Articles below these names are comments, never the page's own.
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
MAIN = frozenset(("article", "main"))


@dataclass
class Node:
    tag: str
    drop: bool = False
    soft: bool = False  # dropped for its name alone
    children: list = field(default_factory=list)
    mark: int = 0
    pairs: tuple = ()  # hashes of a paired element with the sibling before and the one behind


def _drops(tag: str, attributes: str, inside_main: bool) -> tuple[bool, bool]:
    """Is the element boilerplate, and only because of a name that a wrapper of the article could have?"""
    if tag in DROP_TAGS or (tag == "header" and not inside_main):
        return True, False
    if "=" not in attributes and "hidden" not in attributes:
        return False, False
    named = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)}
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes.lower()) or named.get("aria-hidden") == "true":
        return True, False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", "")):
        return True, False
    if tag in MAIN or tag in ("html", "body"):
        # Comments are often nested articles; else these are never boilerplate as a whole.
        return tag == "article" and bool({"comment", "comments", "reply"} & _name_parts(named)), False
    if named.get("role", "") in DROP_ROLES:
        return True, False
    parts = _name_parts(named)
    if inside_main:
        return any(_says(n) for n in f"{named.get('class', '')} {named.get('id', '')}".split()), not parts & COMMENTS
    drop = bool(parts & (DROP_NAMES | HEADERS))
    return drop, drop and not parts & COMMENTS


def _says(name: str) -> bool:
    """Is every part of the name boilerplate, a frame or a number, and one of them boilerplate?"""
    parts = [p for p in re.split(r"[-_:]+", name) if p]
    return bool(DROP_NAMES.intersection(parts)) and all(p in DROP_NAMES or p in FRAMES or re.fullmatch(r"\d[\dx]*", p) for p in parts)


def _name_parts(named: dict[str, str]) -> set[str]:
    names = f"{named.get('class', '')} {named.get('id', '')}".split()
    split = [(n, *re.split(r"[-_:]+", n)) for n in names]
    return {p for parts in split if len(parts) < 3 or parts[1] not in LAYOUT for p in parts}


def _restore(top: Node) -> None:
    """Wrappers of main, or of all articles that the page has, stay whatever their names."""
    found, todo = [], [(top, ())]
    while todo:
        n, path = todo.pop()
        if not isinstance(n, Node) or (n.drop and not n.soft):
            continue
        if n.drop:
            path = (*path, n)
        if n.tag in MAIN:
            found.append((n, path))
        todo += [(c, path) for c in n.children]
    alone = all(path for _, path in found)
    for n, path in found:
        if alone or n.tag == "main":
            for wrapper in path:
                wrapper.drop = False


def parse(page: str) -> Node:
    """Tree of elements; texts are strings, references decoded."""
    top = Node("#")
    stack = [top]
    mains = 0
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        token = m[0]
        at = m.end()
        if m[2] is None:
            if token[0] != "<" or token == "<":
                stack[-1].children.append(html.unescape(token))
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    mains -= sum(n.tag in MAIN for n in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in FENCE and tag not in BLOCK and tag not in MAIN:
                    break
            continue
        for i in range(len(stack) - 1, 0, -1):
            if tag in ENDS.get(stack[i].tag, ()):
                del stack[i:]
                break
            if stack[i].tag in FENCE:
                break
        node = Node(tag, *_drops(tag, m[3] or "", mains > 0))
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            body = page[at:end.start() if end else size]
            node.children.append(html.unescape(body) if tag in ("title", "textarea") else body)
            at = (page.find(">", end.start()) + 1 or size) if end else size
            continue
        if not (m[3] or "").endswith("/") or tag in BLOCK:
            stack.append(node)
            mains += tag in MAIN
    _restore(top)
    return top


def mark(node: Node) -> int:
    """Hash of every subtree, kept in its node; children before parents, without recursion."""
    order, todo = [], [node]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        h = xxhash.xxh64(n.tag.encode())
        marks = []
        for c in n.children:
            if isinstance(c, Node):
                marks.append((c, c.mark.to_bytes(8, "little", signed=True)))
            elif c.strip():
                marks.append((c, b"\x00" + " ".join(c.split()).encode("utf-8", "replace") + b"\x01"))
            else:
                continue
            h.update(marks[-1][1])
        n.mark = _even(h)
        for i, (c, own) in enumerate(marks):
            if isinstance(c, Node) and c.tag in PAIRED:
                c.pairs = tuple(_even(xxhash.xxh64(b"\x02" + a[1] + b"\x02" + b[1])) for a, b in zip(marks[max(i - 1, 0):i + 1], marks[max(i, 1):i + 2]))
    return node.mark


def _even(h: xxhash.xxh64) -> int:
    """A signed number whose last bit is free for the place: 1 inside article and main."""
    return (h.intdigest() - (1 << 63)) & ~1


def _marks(n: Node, inside: bool) -> list[int]:
    """What makes the element template if it recurs."""
    if n.tag in KEPT:
        return []
    return [m | inside for m in (n.pairs if n.tag in PAIRED else (n.mark,))]


def _walk(node: Node, template: frozenset) -> Iterator[tuple[str, Node | str | None]]:
    """Kept texts and block borders in page order."""
    todo: list = [(node, False)]
    while todo:
        n, inside = todo.pop()
        if isinstance(n, str):
            yield "text", n
            continue
        if n is None:
            yield "border", None
            continue
        inside = inside or n.tag in MAIN
        if n.drop or not template.isdisjoint(_marks(n, inside)):
            continue
        if n.tag in ("br", "wbr", "img"):
            if n.tag == "br":
                yield "text", " "
            continue
        if n.tag in BLOCK:
            yield "border", None
            todo.append((None, inside))
        todo += [(c, inside) for c in reversed(n.children)]


def _blocks(node: Node, template: frozenset) -> list[str]:
    out, text = [], []
    for kind, value in _walk(node, template):
        if kind == "text":
            text.append(value)
        elif text:
            block = " ".join("".join(text).split())
            if block:
                out.append(block)
            text = []
    block = " ".join("".join(text).split())
    return [*out, block] if block else out


def _mains(node: Node) -> tuple[list[Node], list[Node]]:
    """Outermost article and main elements that are not dropped; the same with the headings and paragraphs beside them."""
    found, wider, todo = [], [], [node]
    while todo:
        n = todo.pop()
        if n.drop:
            continue
        if n.tag in MAIN:
            found.append(n)
        if n.tag in MAIN or n.tag in BESIDE:
            wider.append(n)
            continue
        inner = [c for c in n.children if isinstance(c, Node)]
        beside = any(c.tag in MAIN and not c.drop for c in inner)
        todo += [c for c in reversed(inner) if beside or c.tag not in BESIDE]
    return found, wider


def main_text(page: str | None, template: frozenset = frozenset()) -> str:
    if not page:
        return ""
    top = parse(page)
    if template:
        mark(top)
    mains, wider = _mains(top)
    held = sum(len(b) for n in mains for b in _blocks(n, template))
    every = _blocks(top, template)
    # A teaser beside a body that lies in no article is not the page's text.
    return "\n".join([b for n in wider for b in _blocks(n, template)] if 2 * held > sum(map(len, every)) else every)


def subtree_hashes(page: str | None) -> tuple[int, list[int]]:
    """Hash of the page and of the different block subtrees that say nothing of themselves, with their place in the last bit."""
    if not page:
        return 0, []
    top = parse(page)
    mark(top)
    found, todo = set(), [(top, False)]
    while todo:
        n, inside = todo.pop()
        if not isinstance(n, Node) or n.drop:
            continue
        inside = inside or n.tag in MAIN
        if n.tag in BLOCK:
            found.update(_marks(n, inside))
        todo += [(c, inside) for c in n.children]
    return top.mark, sorted(found)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end; A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def templates(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """(host, marks): hashes of the subtrees that many different pages of the host hold."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [subtree_hashes(h) for h in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([p for p, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))],
            ["host", "page", "marks"],
        )

    held = settle(in_batches(pages.select(host_of(F.col("url")).alias("host"), "html"), ["host", "html"], "host string, page bigint, marks array<bigint>", run))
    different = held.groupBy("host", "page").agg(F.first("marks").alias("marks"))
    total = held.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    counted = different.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n"))
    inside = F.col("mark").bitwiseAND(F.lit(1)) == 1
    counted = counted.filter(F.col("n") >= F.when(inside, least).otherwise(min(least, OUTSIDE_PAGES)))
    return counted.join(total, "host").filter(F.col("n") >= F.when(inside, share).otherwise(min(share, OUTSIDE_SHARE)) * F.col("total")).groupBy("host").agg(F.collect_list("mark").alias("marks"))


def extract(pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    known = settle(templates(pages, share, least))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(known, "host", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets: dict[tuple, frozenset] = {}
        texts = []
        for page, marks in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            key = tuple(marks or ())
            if key not in sets:
                sets[key] = frozenset(key)
            texts.append(main_text(page, sets[key]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    return in_batches(rows, ["page_id", "url", "html", "marks"], "page_id bigint, url string, text string, n_chars bigint", run)
