"""Main text of web pages by tree scoring.

A page becomes a flat tree (nodes in page order, each with its parent). Menus, headers, footers, side bars, notices, adverts,
forms, scripts and comments are left out by tag, role or class. Every block of text passes points for its length and commas
to its ancestors; a container's points are discounted by the share of its text that stands in links. The best container is kept with
all its blocks, and so are siblings that read like text and the headings, lists and paragraphs beside them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_map, slices

#: Element names by what they do, and the words in classes, ids and roles that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption head".split()
)
LEFT_OUT = frozenset("head nav header footer aside menu search dialog button select option fieldset input canvas audio video".split()) | RAW
#: Left out like what a class or id marks: a form may be wrapped around the whole page.
MAY_WRAP = frozenset("form object".split())
#: Elements within a line of text: a class such as hljs-comment does not make them reader comments.
INLINE = frozenset("span code em strong b i u s mark small sub sup tt var kbd samp q cite dfn abbr time".split())
NEVER_LEFT_OUT = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
MARKS = frozenset(
    "ad ads adbox adunit adsense banner breadcrumb breadcrumbs captcha consent cookie cookies dropdown gdpr hdr footer header "
    "login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup "
    "promo promotion related reply replies respond rss search share sharing sidebar sidenav signup social sponsor sponsored subscribe taboola toolbar "
    "topbar".split()
)
MARK_STARTS = ("advert", "cookie", "navig", "sidebar", "sponsor", "promo")
#: Marks that also end names of an article's own blocks, such as market-share: at the end they mark only after one of PLACES.
WORDS = frozenset("share sharing notice notices related reply replies respond".split())
PLACES = frozenset(
    "admin article bottom btn button buttons cookies copyright email entry float floating footer global header icon legal page post privacy site "
    "sticky story system top user widget wp".split()
)
#: What stands before `header` in names of an article's own head.
OWN_HEADERS = frozenset("article blog chapter content entry news page post section single story".split())
#: Marks of what is never the article, however long it is.
SURE_MARKS = frozenset("comment comments commentlist commentform disqus".split())
#: An element marked by another class or id alone stays if it holds this share of the page's points of paragraphs.
MOST = 0.5
PARAGRAPH = frozenset("p pre td th blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FLOW = HEADINGS | frozenset("p pre blockquote ul ol dl table figure details".split())
#: A start tag of the first kind ends an open element of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table td th ul ol dl div section article main body html blockquote form".split())
LOOKED_FOR = SCOPE | frozenset("p li dt dd tr option".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_PLAIN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|()()()<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
#: After so many tags whose quotes do not end, quotes are looked at no more; else each such tag is read to the page's end.
UNENDED = 1_000
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def marks(parts: list[str], in_article: bool) -> bool:
    """Whether the parts of a class or id, such as those of cookie-notice or site-footer (not elementor-menu-anchor), mark what is not the article."""
    first, last = parts[0], parts[-1]
    if first in MARKS and not (in_article and parts == ["header"]) or first.startswith(MARK_STARTS) or last.startswith(MARK_STARTS):
        return True
    if last == "header" and first in OWN_HEADERS and (in_article or first != "page"):
        return False
    return last in MARKS and len(parts) > 1 and (last not in WORDS or first in PLACES)


def left_out(tag: str, attributes: str, in_article: bool = False) -> int:
    """Whether an element is not part of an article: 2 by its tag, role or a sure mark, 1 by another class or id or as a form, 0 if it may be.

    A header inside an article is the article's own: its title, its author.
    """
    if tag in NEVER_LEFT_OUT:
        return 0
    if tag in LEFT_OUT and not (tag == "header" and in_article):
        return 2
    most = int(tag in MAY_WRAP)
    if not attributes or attributes.isspace():
        return most
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "") in ROLES or _HIDDEN.search(found.get("style", "")):
        return 2
    for value in (found.get("class", ""), found.get("id", "")):
        for name in value.split():
            parts = [p for p in _SPLIT.split(name) if p]
            if not parts or parts[0] in ("has", "no", "with", "without"):
                continue  # such as has-sidebar on a wrapper
            if tag not in INLINE and not SURE_MARKS.isdisjoint(parts):
                return 2
            most = max(most, int(marks(parts, in_article)))
    return most


def commas(text: str) -> int:
    return text.count(",") + text.count("，") + text.count("、")


def value(text: str) -> float:
    """Points of a block of text."""
    return (1 + commas(text) + min(len(text) / 100, 3)) if len(text) >= 25 else len(text) / 25


class Page:
    """Nodes in page order (parent before child) and blocks of text (node, text, characters in links).

    marked: the nodes left out for a class or id alone, or as forms, if not in `spared`; held: at most how many points their text has.
    """

    def __init__(self, source: str, spared: frozenset | None = frozenset()):
        """spared: nodes that a class or id does not leave out; None for all."""
        self.spared, self.marked, self.held = spared, [], 0.0
        self.tag, self.parent, self.out = ["#root"], [-1], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.links, self.pieces, self.linked = 0, [], []
        self.stack = [0]
        self.blocks_open = [0]  # places in the stack of open blocks
        self.ending: list[int] = []  # places of open elements that end what a start tag looks for
        self.places: dict[str, list[int]] = {}  # places of open elements by name
        at, end, unended, token = 0, len(source), 0, _TOKEN
        while at < end:
            m = token.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self.close(name)
                continue
            attributes = m[3] if m[2] else m[6]
            if m[5] and ('"' in attributes or "'" in attributes):
                unended += 1
                token = token if unended < UNENDED else _PLAIN
            self.open(name, attributes)
            if name in RAW and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\s*+[^>]*+(?:>|\Z)", re.I).search(source, at)
                at = stop.end() if stop else end
                self.close(name)
        self.flush()

    def text(self, raw: str) -> None:
        out = self.out[self.stack[-1]]
        if not out:
            self.pieces.append(raw)
            self.linked.append(self.links > 0)
        elif out == 1:
            self.held += 0.05 * len(raw) + commas(raw)

    def holder(self) -> int:
        return self.stack[self.blocks_open[-1]]

    def flush(self) -> None:
        """The text since the last edge of a block becomes a block."""
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                self.blocks.append((self.holder(), text, sum(len(p) for p, a in zip(self.pieces, self.linked, strict=True) if a)))
            self.pieces, self.linked = [], []

    def pop_to(self, depth: int) -> None:
        for n in self.stack[depth:]:
            self.links -= self.tag[n] == "a"
            self.places[self.tag[n]].pop()
        del self.stack[depth:]
        for kept in (self.blocks_open, self.ending):
            while kept and kept[-1] >= depth:
                kept.pop()

    def open(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
            return
        if name in BLOCK:
            self.flush()
            for depth in reversed(self.ending):
                tag = self.tag[self.stack[depth]]
                if tag in ENDS.get(name, ()) or tag == "p":
                    self.pop_to(depth)
                    break
                if tag in SCOPE and not (name == "tr" and tag in ("td", "th")):
                    break
        if name in VOID:
            return
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        out = self.out[self.stack[-1]]
        if out < 2:
            mark = left_out(name, attributes, bool(self.places.get("article")))
            if mark == 1:
                self.marked.append(len(self.tag) - 1)
                mark = self.spared is not None and self.marked[-1] not in self.spared
            out = max(out, int(mark))
        self.out.append(out)
        if not attributes.endswith("/") or name in BLOCK or name == "a":
            place = len(self.stack)
            self.stack.append(len(self.tag) - 1)
            self.places.setdefault(name, []).append(place)
            if name in BLOCK:
                self.blocks_open.append(place)
            if name in LOOKED_FOR:
                self.ending.append(place)
            self.links += name == "a"

    def close(self, name: str) -> None:
        if self.places.get(name) and (name in BLOCK or self.places[name][-1] > self.blocks_open[-1]):
            if name in BLOCK:
                self.flush()
            self.pop_to(self.places[name][-1])


def read(source: str) -> Page:
    """The page, without what its marks leave out; a marked element that holds most of the points and no article beside it stays."""
    page = Page(source)
    if page.held <= MOST * (page.held + sum(value(text) for _, text, _ in page.blocks)):
        return page
    full = Page(source, None)
    inside = [0.0] * len(full.tag)
    article = [0.0] * len(full.tag)
    for node, text, _ in full.blocks:
        inside[node] += value(text)
    total = sum(inside)
    for i in range(len(inside) - 1, 0, -1):
        if full.tag[i] in ("article", "main"):
            article[i] = inside[i]
        inside[full.parent[i]] += inside[i]
        article[full.parent[i]] += article[i]
    within = [False] * len(full.tag)
    for i in range(1, len(within)):
        within[i] = within[full.parent[i]] or full.tag[i] in ("article", "main")
    return Page(source, frozenset(i for i in full.marked if inside[i] > MOST * total and (within[i] or article[i] >= article[0])))


def main_text(source: str | None) -> str:
    """The article's blocks, joined by a blank line; empty for a null or empty page or one without text."""
    page = read(source or "")
    if not page.blocks:
        return ""
    n = len(page.tag)
    points, size, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, in_links in page.blocks:
        size[node] += len(text)
        linked[node] += min(in_links, len(text))
        worth = value(text)
        up = page.parent[node] if page.tag[node] in PARAGRAPH else node
        for level in range(5):
            if up < 0:
                break
            points[up] += worth / (1 if level == 0 else 2 if level == 1 else level * 3)
            up = page.parent[up]
    for node in range(n - 1, 0, -1):
        size[page.parent[node]] += size[node]
        linked[page.parent[node]] += linked[node]
    score = [p * (1 - (linked[i] / size[i] if size[i] else 0)) + (10 if page.tag[i] in ("article", "main") and size[i] else 0) for i, p in enumerate(points)]
    best = max(range(n), key=lambda i: (score[i], -i))
    up = best
    while up > 0:  # the whole article, where the page says what that is
        if page.tag[up] == "article":
            best = up
        up = page.parent[up]
    if page.tag[best] not in ("article", "main"):  # wrappers that hold nothing else
        while page.parent[best] > 0 and page.tag[best] != "main" and size[page.parent[best]] == size[best]:
            best = page.parent[best]
    kept = [False] * n
    kept[best] = True
    least = max(10, 0.2 * score[best])
    for i in range(n):
        if page.parent[i] == page.parent[best] and best and page.tag[best] != "main" and i != best and size[i]:
            few_links = linked[i] < 0.25 * size[i]
            kept[i] = score[i] >= least and few_links or page.tag[i] in ("p", "pre", "blockquote") and few_links and size[i] > 80
    loose = beside(page, best, kept, size, linked) if best and page.tag[best] not in ("article", "main") else set()
    for i in range(1, n):
        kept[i] = kept[i] or kept[page.parent[i]]
    return "\n\n".join(text for k, (node, text, _) in enumerate(page.blocks) if kept[node] or k in loose)


def beside(page: Page, best: int, kept: list[bool], size: list[int], linked: list[int]) -> set[int]:
    """Blocks right under best's parent that are kept, and kept set for siblings: those that go with best and its kept siblings.

    A sibling with few links goes with them if its own text has a fifth of best's points, or if it is a heading, list,
    paragraph or text of its own, or a container with two points, and stands between kept ones or next to them. Headings
    that nothing kept follows do not.
    """
    above = page.parent[best]
    under = [0] * len(page.tag)  # the child of `above` that a node is or stands in
    for i in range(1, len(under)):
        under[i] = i if page.parent[i] == above else under[page.parent[i]]
    units: list[list] = []  # node or -1, blocks, points, whether it may go with kept ones, whether it is kept
    for k, (node, text, in_links) in enumerate(page.blocks):
        child = under[node]
        if node == above:
            units.append([-1, [k], value(text), min(in_links, len(text)) < 0.25 * len(text), False])
        elif child > 0:
            if not units or units[-1][0] != child:
                few_links = linked[child] < 0.25 * size[child] or page.tag[child] in HEADINGS
                units.append([child, [], 0.0, few_links, kept[child]])
            units[-1][1].append(k)
            units[-1][2] += value(text)
    least = 0.2 * next(u[2] for u in units if u[0] == best)
    for u in units:
        few_links = u[3]
        u[4] = u[4] or few_links and u[2] >= max(2, least)
        u[3] = few_links and (u[0] < 0 or page.tag[u[0]] in FLOW or u[2] >= 2)
    first, last = (f(i for i, u in enumerate(units) if u[4]) for f in (min, max))
    while first > 0 and units[first - 1][3]:
        first -= 1
    end = last
    while last + 1 < len(units) and units[last + 1][3]:
        last += 1
    while last > end and page.tag[units[last][0]] in HEADINGS and units[last][0] > 0:
        last -= 1
    loose = set()
    for u in units[first : last + 1]:
        if u[3] or u[4]:
            if u[0] < 0:
                loose.update(u[1])
            else:
                kept[u[0]] = True
    return loose


def extract(df: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """df without the html column, with the main text; pages are judged one by one, so repeated rows get equal texts."""
    names = [c for c in df.columns if c != out]
    df = df.select(*names)
    at = names.index(column)
    rest = [c for c in names if c != column]
    schema = df.select(*rest).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 8 << 20):
            texts = [main_text(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in rest], pa.array(texts, pa.string())], names=[*rest, out])

    return arrow_map(df, run, schema)


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
