"""Main text of web pages: tree scoring with boilerplate removal.

A page becomes a light tree. Menus, footers, forms and the like go by element or by the words
of their class, id and role. Every paragraph gives points for its length and commas to its
ancestors, less the farther up; a container's points are discounted by its link density. The
best container (or the article or main element around it) is kept, with the siblings that
score near it, read like its paragraphs or are sections beside a section. Names drop only elements
that hold blocks, never headings, paragraphs or inline elements, and an id never a section. Lists
of links go only where no container was found and the page's whole body is kept.

Text: character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined in page order by one space. Nothing else is dropped or cut.

Defined cases: null or empty html, and pages without text, give an empty string; cut-off pages
are read as far as they go; a quoted value that is never closed ends with its tag; pages of any
length are read whole, in time that follows their length; repeated rows and null ids are kept;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as html_module
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select textarea dialog menu embed head title canvas audio video map fieldset datalist annotation annotation-xml desc defs".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre blockquote td th li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
#: Elements that a start tag closes when open, up to the nearest barrier.
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that a name can drop: they hold blocks, and are no paragraphs or headings.
CONTAINER = BLOCK - PARAGRAPH - HEADINGS - frozenset("html body article main".split())
#: Words that name boilerplate in any compound, and those that do so alone or beside each other and fillers.
SURE = frozenset("adv advert adverts advertisement advertising adsense sponsored promo cookie cookies gdpr popup popover sidebar menubar navbar breadcrumb breadcrumbs footer footnav masthead topbar toolbar comments commentlist disqus newsletter signup pagination pager searchform contentinfo".split())
NOISE = SURE | frozenset(
    "ad ads sponsor promotion banner consent notice notices notification alert modal overlay side menu nav navigation header comment respond reply replies discussion share sharing social "
    "related recommended recommendations subscribe subscription login skip widget widgets complementary search form dialog".split()
)
FILLER = frozenset("area bar block box button buttons col column container group icons inner item items left link links list outer page panel posts right section site top bottom widget wrap wrapper".split())
#: Words that name the article itself, and those that say what a page has or lacks.
KEEP = frozenset("article content main post entry story body text".split())
LAYOUT = frozenset("has with no without not is open layout".split())
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*>|<[!?/][^>]*\Z", re.S)
#: Up to the end of a tag or to a quoted value; quotes elsewhere in a tag mean nothing.
IN_TAG = re.compile(r"(?:[^>=]|=(?!\s*[\"'])(?!\s*>))*+(?:=\s*)?(?:(>)|([\"']))", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/>]|$)", re.I)
BREAK = -1


def _noisy(hint: str) -> bool:
    """Whether a class, id or role of ``hint`` names boilerplate.

    A compound of the article's own words and noise ("post-share") is noise, but for a header,
    which holds the title. Compounds give way to another word that names the article alone.
    """
    noisy = article = False
    for token in hint.split():
        parts = set(re.split(r"[_-]+", token)) - {""}
        if parts <= KEEP:
            article = True
        elif parts & LAYOUT:
            continue
        elif parts & KEEP and parts & NOISE == {"header"}:
            article = True
        elif parts & SURE or parts & NOISE and parts <= NOISE | FILLER | KEEP:
            if len(parts) == 1:
                return True
            noisy = True
    return noisy and not article


class Quotes:
    """Where quotes close in a page; a mark that occurs no more is not searched for again."""

    def __init__(self, html: str) -> None:
        self.html, self.gone = html, set()

    def tag_end(self, at: int) -> tuple[int, int]:
        """Where a tag's attributes end and where text goes on; a tag without an end takes the rest."""
        html, begin, n = self.html, at, len(self.html)
        while True:
            m = IN_TAG.match(html, at)
            if not m:
                return n, n
            if m[1]:
                return m.start(1), m.end()
            close = -1 if m[2] in self.gone else html.find(m[2], m.end())
            if close < 0:  # never closed: the tag ends as if there were no quote
                self.gone.add(m[2])
                end = html.find(">", m.end())
                return (end, end + 1) if end >= 0 else (max(begin, n), n)
            at = close + 1


class Page:
    """Nodes in page order (a parent comes before its children) and text with its node."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.dropped, self.hint = ["html"], [-1], [False], [""]
        self.text: list[tuple[int, str]] = []
        stack, open_tags = [0], {"html": 1}

        def pop_to(depth: int) -> None:
            while len(stack) > depth:
                t = self.tag[stack.pop()]
                open_tags[t] -= 1
                if t in BLOCK:
                    self.text.append((BREAK, ""))

        def find(names, barrier=()) -> int:
            if not any(open_tags.get(t) for t in names):
                return -1
            for i in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[i]]
                if t in names:
                    return i
                if t in barrier:
                    return -1
            return -1

        at, n, quotes = 0, len(html), Quotes(html)
        while at < n:
            m = TOKEN.search(html, at)
            start = m.start() if m else n
            if start > at:
                self.text.append((stack[-1], html[at:start]))
            if not m:
                break
            at, name = m.end(), m[2]
            if not name:
                continue
            end, at = quotes.tag_end(at)
            rest, name = html[m.end() : end], name.lower()
            if m[1]:
                if name == "br" or name == "p" and not open_tags.get("p"):
                    self.text.append((stack[-1], " "))
                    continue
                i = find((name,), () if name in BLOCK else ("table", "td", "article", "body"))
                if i > 0:
                    pop_to(i)
                elif name in BLOCK:
                    self.text.append((BREAK, ""))
                continue
            if name in ("html", "body") and open_tags.get(name):
                continue
            if name in BLOCK and open_tags.get("p") and name != "option":
                i = find(("p",), ("table", "td", "th", "button"))
                if i > 0:
                    pop_to(i)
            if name in CLOSES:
                i = find(CLOSES[name], BARRIER.get(name, ("table",)))
                while i > 0:
                    pop_to(i)
                    i = find(CLOSES[name], BARRIER.get(name, ("table",)))
            if name in BLOCK:
                self.text.append((BREAK, ""))
            elif name == "br":
                self.text.append((stack[-1], " "))
                continue
            if name in VOID:
                continue
            hint, hidden = "", False
            if rest.endswith("/") and (open_tags.get("svg") or open_tags.get("math")):
                continue
            if rest:
                for a in ATTRIBUTE.finditer(rest):
                    key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                    if key in ("class", "role") or key == "id" and name != "section":
                        hint += " " + value
                    elif key == "hidden" or value == "true":
                        hidden = True
            node = len(self.tag)
            up = stack[-1]
            gone = self.dropped[up] or hidden or name in DROPPED
            if not gone and name == "header":
                gone = not (open_tags.get("article") or open_tags.get("main"))
            if not gone and hint and name in CONTAINER and _noisy(hint):
                gone = True
            self.tag.append(name)
            self.parent.append(up)
            self.dropped.append(gone)
            self.hint.append(hint)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else n
                continue
            stack.append(node)
            open_tags[name] = open_tags.get(name, 0) + 1


def container(page: Page) -> tuple[int, list[float], list[int], list[int]]:
    """The best container, all scores, and each node's text and link lengths."""
    n = len(page.tag)
    size, links, own, commas = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in page.text:
        if node >= 0 and not page.dropped[node]:
            k = len(text.strip())
            if k:
                at, linked = node, False
                while at > 0 and page.tag[at] not in BLOCK:
                    linked |= page.tag[at] == "a"
                    at = page.parent[at]
                size[at] += k
                own[at] += k
                commas[at] += text.count(",")
                if linked:
                    links[at] += k
    score = [0.0] * n
    for node in range(n):
        if own[node] and not page.dropped[node] and (page.tag[node] in PARAGRAPH or own[node] >= 25):
            points = (1 + commas[node] + min(own[node] / 100, 3)) * (1 - links[node] / own[node])
            at, share = (page.parent[node] if page.tag[node] in PARAGRAPH else node), 1.0
            for level in range(4):
                if at < 0:
                    break
                score[at] += points * share
                at, share = page.parent[at], 1 / (2 + level)
    for node in range(n - 1, 0, -1):
        size[page.parent[node]] += size[node]
        links[page.parent[node]] += links[node]
    best = 0
    for node in range(n):
        score[node] *= 1 - links[node] / size[node] if size[node] else 0
        if score[node] > score[best]:
            best = node
    return best, score, size, links


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Page(html)
    n = len(page.tag)
    best, score, size, links = container(page)
    at = best
    while at > 0:  # the article or main element around the best container
        if page.tag[at] in ("article", "main"):
            best = at
            if page.tag[at] == "article":
                break
        at = page.parent[at]
    kept = [False] * n
    kept[best] = True
    up = page.parent[best]
    if page.tag[best] not in ("article", "main"):
        for node in range(1, n):
            if page.parent[node] == up and node != best and not page.dropped[node] and size[node]:
                density = links[node] / size[node]
                near = score[node] >= max(5.0, 0.2 * score[best])
                reads = page.tag[node] in PARAGRAPH and density < (0.25 if size[node] > 80 else 0.01)
                alike = page.tag[node] == page.tag[best] in ("section", "div") and (page.tag[best] == "section" or page.hint[node] == page.hint[best] != "") and density < 0.5
                kept[node] = near or reads or alike
    whole = page.tag[best] in ("html", "body")
    for node in range(1, n):
        if kept[page.parent[node]]:
            kept[node] = True
        if page.dropped[node] or whole and kept[node] and node != best and page.tag[node] in ("ul", "ol", "div", "table") and size[node] and links[node] > 0.8 * size[node]:
            kept[node] = False
            page.dropped[node] = True
        elif page.dropped[page.parent[node]]:
            page.dropped[node], kept[node] = True, False
    parts = [" " if node == BREAK else html_module.unescape(text) for node, text in page.text if node == BREAK or kept[node]]
    return " ".join("".join(parts).split())


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: a row a page."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
