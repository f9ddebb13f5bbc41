"""Main text of web pages by tree scoring.

A page is read into a tree. Elements that are never part of an article (menus, forms, scripts, adverts, comments, ...;
by element, role or class) are cut off. Each block of text passes points for its length and its commas to the
element that holds it, half of them to the next one up, and so on, less its share of link text. The element with most
points, less its own share of link text, is the container of the article; inside an ``article`` or ``main`` element it
is that element. Its siblings with enough points of their own stay, too. Blocks are joined in page order by
one space.

Null html: empty text. Pages without text in any block: empty text. A page whose only text lies in elements cut off
by class is read again without looking at classes. Rows that repeat a page_id are pages of their own; extra columns are
ignored; an empty table gives no rows. Elements nested deeper than ``DEEPEST`` are read as children of that
level. An unclosed tag or comment ends with the page. Time is linear in the length of a page.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST = 400
#: A sibling stays if it has this share of the container's points.
SIBLING = 0.2

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre"
    " search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p li dd dt pre blockquote figcaption caption summary address".split())
#: Elements that a start tag closes, and those beyond which it doesn't look.
CLOSES = {"li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tbody thead tfoot tr td th", "thead": "tbody thead tfoot tr td th", "tfoot": "tbody thead tfoot tr td th"}
CELLS = frozenset("td th".split())
#: Elements across which an end tag closes nothing; cells for all others.
SCOPE = {"p": CELLS | {"article", "section", "main"}, "li": CELLS | {"article", "section", "main"}} | {t: frozenset() for t in "table tbody thead tfoot tr td th caption".split()}
HOLDERS = frozenset("ul ol menu dir dl table select div article section main aside nav".split())
# Fixed values of this operator: elements, roles and words of class and id that no article holds.
CUT = frozenset("nav aside footer form button select datalist dialog menu template svg canvas object audio video map search".split()) | RAW
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
CUT_WORDS = frozenset(
    "ad adbanner adbox ads adsbygoogle adsense adslot adunit advert advertisement advertisements advertising adverts alert announcement aside banner breadcrumb breadcrumbs comment commentlist comments consent cookie"
    " cookies copyright disclaimer discussion disqus footer form gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popover popup promo promoted"
    " promotion recommended related replies reply respond search searchbox share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription teaser toast toolbar topbar topnav widget widgets".split()
)
CUT_ARTICLES = frozenset("ad ads advert comment comments promo promoted related reply sponsored teaser".split())
#: Words beside which a word above names a layout, as in has-sidebar.
LAYOUT = frozenset("has with without no layout".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/]|\Z))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


class Tree:
    """The elements of a page in page order, and its blocks of text: (element, text, characters inside links)."""

    def __init__(self, page: str, by_class: bool):
        self.tags, self.parents, self.named = ["body"], [-1], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.by_class = by_class
        self.cut, self.heading_only, self.headers = [False], [False], [False]
        self.stack = [0]
        self.pieces: list[str] = []
        self.links: list[str] = []
        self.open_links = 0
        at = 0
        while m := TAG.search(page, at):
            self.text(page[at : m.start()])
            at = m.end()
            if name := (m[2] or "").lower():
                if m[1]:
                    self.end(name)
                else:
                    self.start(name, m[3])
                    if name in RAW:
                        close = RAW_END[name].search(page, at)
                        at = close.end() if close else len(page)
        self.text(page[at:])
        self.flush()

    def text(self, raw: str) -> None:
        if raw and not self.cut[self.stack[-1]]:
            self.pieces.append(raw)
            if self.open_links:
                self.links.append(raw)

    def flush(self) -> None:
        """The text since the last border of a block is a block of the innermost block element."""
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                e = next(e for e in reversed(self.stack) if self.tags[e] in BLOCKS or not e)
                self.blocks.append((e, text, min(len(text), len(" ".join(html.unescape("".join(self.links)).split())))))
            self.pieces, self.links = [], []

    def pop(self) -> None:
        if self.tags[self.stack.pop()] == "a":
            self.open_links -= 1

    def close(self, names, holders) -> None:
        """Close the innermost element of ``names``, unless one of ``holders`` lies inside it."""
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[depth]]
            if tag in names:
                while len(self.stack) > depth:
                    self.pop()
                return
            if tag in holders:
                return

    def start(self, name: str, attributes: str) -> None:
        if name in ("html", "head", "body") or name in RAW:
            return
        if name in ("br", "hr"):
            self.text(" ")
        if name in BLOCKS:
            self.flush()
            self.close(("p",), HOLDERS | {"td", "th", "li"})
            if name in HEADINGS:
                self.close(HEADINGS, BLOCKS - HEADINGS)
        if name in CLOSES:
            self.close(CLOSES[name].split(), HOLDERS - {"div"} if name in ("td", "th", "tr") else HOLDERS)
        if name in VOID or len(self.stack) > DEEPEST:
            return
        if name == "a":
            self.close(("a",), BLOCKS)
            self.open_links += 1
        e, up = len(self.tags), self.stack[-1]
        self.tags.append(name)
        self.parents.append(up)
        self.stack.append(e)
        cut, named = self.judged(name, attributes)
        only = self.heading_only[up] or named is None
        self.heading_only.append(only and name not in HEADINGS)
        self.cut.append(cut or (self.cut[up] and not (name in HEADINGS and self.heading_only[up])) or (only and name not in HEADINGS))
        self.named.append(bool(named))
        self.headers.append(named is None)

    def judged(self, name: str, attributes: str) -> tuple[bool, bool | None]:
        """Whether an element is cut off, and whether it names itself the article; None: of a header only headings are read."""
        if name in CUT:
            return True, False
        if name == "header":
            inside = any(self.tags[x] in ("article", "main") for x in self.stack)
            return not inside, None
        named = name in ("article", "main")
        if not attributes.strip(" /"):
            return False, named
        words: list[str] = []
        cut = False
        for a in ATTRIBUTE.finditer(attributes):
            key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if key in ("class", "id"):
                words += [w.lower() for w in WORD.findall(value)]
            elif key == "role":
                cut |= value.lower() in CUT_ROLES
                named |= value.lower() in ("article", "main")
            elif key == "itemprop":
                named |= value.lower() == "articlebody"
            else:
                cut |= key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and bool(UNSEEN.search(value)))
        if self.by_class and not LAYOUT.intersection(words):
            cut |= not (CUT_ARTICLES if named else CUT_WORDS).isdisjoint(words)
            if "header" in words and not named and name not in HEADINGS:
                return cut, None
        return cut, named

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
            self.close((name,), SCOPE.get(name, CELLS))
        elif name not in VOID:
            self.close((name,), BLOCKS)


def article(page: str, by_class: bool = True) -> list[str]:
    """Blocks of the main text of a page."""
    tree = Tree(page, by_class)
    n, tags, parents = len(tree.tags), tree.tags, tree.parents
    passed, own, chars, linked = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    for e, text, link in tree.blocks:
        points = ((len(text) >= 25) + text.count(",") + min(len(text) / 100, 3) + min(len(text), 25) / 1000) * (1 - link / len(text))
        own[e] += points
        chars[e] += len(text)
        linked[e] += link
        at = parents[e] if tags[e] in PARAGRAPHS else e
        share = 1.0
        while at >= 0 and share > 0.1:
            passed[at] += points * share
            share, at = share / 2, parents[at]
    for e in range(n - 1, 0, -1):  # parents come before their children
        for of in (own, chars, linked):
            of[parents[e]] += of[e]
    score = [p * (1 - linked[e] / chars[e]) if chars[e] else 0.0 for e, p in enumerate(passed)]
    best = max(range(n), key=lambda e: (score[e], -e))
    if score[best] <= 0:
        return article(page, False) if by_class else []
    up = best
    while up > 0 and not tree.named[up]:
        up = parents[up]
    container = up if up > 0 else best
    inside = [False] * n
    for e in range(n):
        inside[e] = e == container or (e > 0 and inside[parents[e]])
    titles = {tags[e] for e in range(n) if inside[e] and tags[e] in HEADINGS and chars[e]}
    keep = {container}
    if container:
        for e in range(1, n):
            if parents[e] == parents[container] and e != container and not tree.headers[e]:
                if up > 0:
                    stays = tree.named[e] and own[e] >= SIBLING * own[container]
                elif tags[e] in HEADINGS:  # a title above a container that has none of its own
                    stays = e < container and all(tags[e] < t for t in titles) and "h1" not in titles
                else:
                    stays = own[e] >= SIBLING * own[container] and linked[e] * 4 < chars[e]
                if stays:
                    keep.add(e)
    kept = [False] * n
    for e in range(n):
        kept[e] = e in keep or (e > 0 and kept[parents[e]])
    return [text for e, text, _ in tree.blocks if kept[e]]


def main_text(page: str | None) -> str:
    return " ".join(article(page)) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def fn(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(fn, "page_id long, url string, text string, n_chars long")
