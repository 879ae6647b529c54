"""Main text of web pages by composite text density.

A page becomes a tree of elements. Elements that are never article text (navigation, page headers and footers,
asides, forms, scripts, hidden ones; by role, id or class also menus, sidebars, notices, adverts, sharing,
reader comments, each with all inside it, articles too) are cut off. A name counts if it has a word for such a part and
else only words of layout: ``related-posts`` is one, ``related-work`` is not. Every element then has a density: its characters
per tag, adjusted by the share of link characters and link tags against that of the body. The element of the whole body
with the largest sum of its children's densities is the core, the first of equal ones. The smallest density on the path
from the body to the core is the threshold: the core is taken with all elements beside the path that reach it. If
the core lies in an ``article`` or ``main``, it is widened to the nearest of them instead.

Text is decoded, white space inside a block becomes one space, blocks stand in page order, one per line.
A line break ends a block. Null, empty and textless pages give an empty text. Broken markup is read as far as it makes
sense: unclosed paragraphs end at the next block, unclosed tags at the end of their parent, a comment or
script without end runs to the end of the page. Rows with equal id are separate pages. Other columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.text import pieces

_WORDS = str.split
RAW = "script style textarea title noscript iframe template svg math xmp noembed noframes object canvas audio video select"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>{'|'.join(_WORDS(RAW))})(?=[\s/>])(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>(?:.*?(?:</(?P=raw)\s*+>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+>?|<[!?/][^>]*+>?",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = set(_WORDS("area base br col embed hr img input link meta param source track wbr"))
BLOCK = set(
    _WORDS(
        "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
        "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul"
    )
)
#: An opening tag ends open elements of these kinds, up to the nearest enclosing one of the last group.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NEVER = set(_WORDS("nav footer aside form dialog menu button head label fieldset input datalist"))
ROLES = set(_WORDS("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar"))
NAMES = set(
    _WORDS(
        "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
        "notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead comment comments "
        "commentlist respond reply replies disqus share sharing social related recommended newsletter subscribe signup login popup modal overlay "
        "widget widgets pagination pager toolbar skip discussion feedback responses rail topbar crumbs adbox adslot adunit copyright disclaimer paywall "
        "teaser teasers"
    )
)
#: Words of layout that may stand beside one of those.
PLAIN = set(
    _WORDS(
        "area article articles bar block body bottom box buttons col column container content entry form global google group header inner item items left "
        "link links list main message outer page post posts primary right secondary section sections site slot stories story text thread title top unit wp wrap wrapper"
    )
)
#: A class or id made of these words only, "header" among them, is the header of the page.
HEADER_WORDS = {"", "header", "site", "page", "main", "global", "top"}
KEEP = {"main", "body", "html"}
_SPLIT = re.compile(r"[^a-z]+")


class Page:
    """Elements in page order (a parent before its children), and the text runs with their element and block."""

    def __init__(self, html: str):
        self.tag, self.parent, self.bad = ["html"], [-1], [False]
        self.runs: list[tuple[int, int, str]] = []
        self._block = 0
        stack = [0]
        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self._text(stack[-1], html[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self._text(stack[-1], m[0][9:].removesuffix("]]>"), decoded=True)
                continue
            tag = tag.lower()
            if tag in BLOCK:
                self._block += 1
            if m["close"]:
                self._close(stack, tag)
            elif tag in ("html", "body") and tag in (self.tag[i] for i in stack):
                continue
            else:
                self._open(stack, tag, m["attrs"])
        if at < len(html):
            self._text(stack[-1], html[at:])

    def _text(self, node: int, text: str, decoded: bool = False) -> None:
        self.runs.append((node, self._block, text if decoded or "&" not in text else unescape(text)))

    def _open(self, stack: list[int], tag: str, attrs: str) -> None:
        if tag in BLOCK and tag != "br":
            self._end(stack, {"p"}, {"article", "section", "div", "td", "th", "li", "blockquote", "body", "form", "main"})
        if tag in ENDS:
            self._end(stack, *ENDS[tag])
        self.tag.append(tag)
        self.parent.append(stack[-1])
        self.bad.append(self._unwanted(tag, attrs))
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(len(self.tag) - 1)

    def _end(self, stack: list[int], kinds: set[str], until: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] in kinds:
                del stack[k:]
                return
            if self.tag[stack[k]] in until:
                return

    def _close(self, stack: list[int], tag: str) -> None:
        inline = tag not in BLOCK
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                del stack[k:]
                return
            if inline and self.tag[stack[k]] in BLOCK:
                return  # closes something of an outer block

    def _unwanted(self, tag: str, attrs: str) -> bool:
        if tag in NEVER:
            return True
        if tag in KEEP or not attrs:
            return tag == "header" and not self._in_article()
        for name, *values in _ATTRIBUTE.findall(attrs):
            value = next((v for v in values if v), "").lower()
            name = name.lower()
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
            if name == "role" and value.strip() in ROLES:
                return True
            if name in ("class", "id"):
                for part in value.split():
                    words = set(_SPLIT.split(part)) - {""}
                    if not NAMES.isdisjoint(words) and words <= NAMES | PLAIN:
                        return True
                    if "header" in words and words <= HEADER_WORDS and not self._in_article():
                        return True
        return tag == "header" and not self._in_article()

    def _in_article(self) -> bool:
        node = self.parent[-1] if self.parent else -1
        while node > 0:
            if self.tag[node] in ("article", "main"):
                return True
            node = self.parent[node]
        return False


def _alive(page: Page) -> list[bool]:
    """Elements not inside an unwanted one. What encloses the ``main`` of a page is not unwanted for its name."""
    n = len(page.tag)
    encloses = [t == "main" for t in page.tag]
    for i in range(n - 1, 0, -1):
        if encloses[i]:
            encloses[page.parent[i]] = True
    alive = [True] * n
    for i in range(1, n):
        kept = not page.bad[i] or (encloses[i] and page.tag[i] not in NEVER)
        alive[i] = alive[page.parent[i]] and kept
    return alive


def densities(page: Page, alive: list[bool]) -> tuple[list[float], list[float]]:
    """Composite density of every element, and the sum over its children."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, text in page.runs:
        if alive[node]:
            chars[node] += sum(map(len, text.split()))
    inside = [t == "a" for t in page.tag]
    for i in range(1, n):
        inside[i] = inside[i] or inside[page.parent[i]]
        link_chars[i] = chars[i] if inside[i] else 0
    for i in range(n - 1, 0, -1):
        if not alive[i]:
            continue
        p = page.parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (page.tag[i] == "a")
    whole, whole_links = max(chars[0], 1), link_chars[0]
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if alive[i] and chars[i]:
            c, t, lc, lt = chars[i], max(tags[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
            density[i] = c / t
            base = log(c / max(c - link_chars[i], 1) * link_chars[i] + whole_links / whole * c + e)
            if base > 1 + 1e-9:
                density[i] *= max(log(c / lc * t / lt), 0.0) / log(base)
            if i:
                total[page.parent[i]] += density[i]
    return density, total


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    alive = _alive(page)
    n = len(page.tag)
    density, total = densities(page, alive)
    body = next((i for i in range(n) if page.tag[i] == "body" and alive[i]), 0)
    core = max(range(n), key=lambda i: (total[i] if alive[i] else -1.0, density[i] if alive[i] else -1.0, -i))
    path = [core]
    while path[-1] > 0 and path[-1] != body:
        path.append(page.parent[path[-1]])
    chosen = [False] * n
    around = [i for i in path if page.tag[i] in ("article", "main")]
    if around:
        chosen[around[0]] = True
    else:
        threshold = min(density[i] for i in path)
        chosen[core] = True
        inner = set(path[1:])
        for i in range(1, n):
            if alive[i] and page.parent[i] in inner and i not in path and density[i] >= threshold:
                chosen[i] = True
    for i in range(1, n):
        chosen[i] = alive[i] and (chosen[i] or chosen[page.parent[i]])
    if not any(chosen) and alive[core]:
        chosen[core] = True
    loose = set(path) if not around else set()
    blocks: list[str] = []
    last = None
    for node, block, text in page.runs:
        # Text that stands directly on the path belongs to no child; it is kept if the core is.
        if alive[node] and (chosen[node] or node in loose):
            if block == last:
                blocks[-1] += text
            else:
                blocks.append(text)
                last = block
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""

    def run(batches):
        for piece in pieces(batches, "html"):
            texts = [main_text(h) for h in piece.column("html").to_pylist()]
            yield pa.record_batch(
                [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64))],
                names=["page_id", "url", "text", "n_chars"],
            )

    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = base.schema["page_id"].dataType.simpleString()
    return base.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
