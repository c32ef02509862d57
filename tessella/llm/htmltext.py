"""Main text of web pages by the ratio of text to tags.

The standard library's parser streams events. Text is gathered into lines, one a
block element. Parts that markup names as something else (menus, notices, adverts,
forms, comments and the like) are no candidates. Of the other lines, a line's ratio
is the logarithm of its characters by its tags; the ratios are smoothed by a Gaussian
and split in two clusters, content and the rest. The content lines choose the region:
the deepest container that holds all of them. A page without content lines has no text.

Side parts that no markup names, such as footers with a sentence, read like content line
by line. So where one branch of a container holds most content, its branches are split in
two clusters again, by the length of their lines, and the lower ones go.

Markup only settles what clusters leave open. A region inside an article or main part
grows to that part; otherwise a heading before it joins it. Where no container holds
all content (lines of several articles, or straight in the body), the region is the
articles and main parts with content lines, articles without a link, the part that
holds most content, and what stands between the content lines. Articles with a link
and without content lines are teasers and go.

Time grows with the page, whatever its depth: containers are intervals of lines.

Defined results: a null html counts as empty; a page without text gives an empty
string; repeated rows each give a row; other columns are ignored, whatever they are
called; an empty table gives no rows; very long and very deep pages are read whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
    "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul", "caption", "option", "noscript", "search",
}
#: Never main text, wherever they stand.
SKIP = {
    "script", "style", "noscript", "template", "head", "title", "svg", "math", "canvas", "iframe", "object", "audio",
    "video", "nav", "aside", "footer", "form", "button", "select", "textarea", "input", "menu", "dialog", "search",
}
SKIP_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert",
    "menu", "menubar", "toolbar", "status", "tooltip",
}
SKIP_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "sponsor",
    "sponsored", "promo", "promotion", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "footer", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "alert", "newsletter", "subscribe", "subscription", "popup", "modal", "overlay", "comment", "comments", "disqus",
    "respond", "replies", "related", "recommended", "share", "sharing", "social", "login", "signup", "searchform",
    "pagination", "pager", "widget", "skyscraper", "paywall", "disclaimer", "toolbar", "hidden", "copyright",
}
#: Words in a name that mark a part as layout or article, whatever else the name holds.
KEEP_WORDS = {
    "content", "main", "article", "post", "entry", "story", "body", "wrapper", "container", "page", "layout", "text",
    "has", "with", "without", "no",
}
READER_WORDS = {"comment", "comments", "disqus", "respond", "responses", "replies", "reply"}
#: Words of a name that says header and nothing about an article.
HEADER_WORDS = {"header", "site", "top", "global"}
CLOSED_BY = {
    "p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"},
}
CLOSES = {tag: [name for name, by in CLOSED_BY.items() if tag in by] for by in CLOSED_BY.values() for tag in by}
#: A start tag closes an open element only up to one of these.
SCOPE = {
    "table", "ul", "ol", "dl", "div", "article", "section", "main", "body", "html", "td", "th", "blockquote", "aside",
    "footer", "header", "nav", "form", "figure",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Containers that are part of a text, not its region.
NO_REGION = {"table", "ul", "ol", "dl", "td", "th", "blockquote", "figure"}
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def names_other_part(tag: str, attrs: dict[str, str]) -> bool:
    """Whether markup says that an element is not main text."""
    if tag in SKIP or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if attrs.get("role", "").lower() in SKIP_ROLES or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return True
    if tag in ("html", "body"):
        return False
    for name in [*attrs.get("class", "").split(), attrs.get("id", "")]:
        words = {x.lower() for x in WORDS.findall(name)}
        if words & READER_WORDS or (words & SKIP_WORDS and not words & KEEP_WORDS and tag not in ("article", "main")):
            return True
    return False


def names_header(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element is a header by its tag or its name; within articles it belongs to them."""
    if tag == "header":
        return True
    names = [{x.lower() for x in WORDS.findall(n)} for n in [*attrs.get("class", "").split(), attrs.get("id", "")]]
    return tag in BLOCK and any("header" in n and n <= HEADER_WORDS for n in names)


class Line:
    __slots__ = ("container", "heading", "links", "other", "parts", "tags", "text")

    def __init__(self):
        self.parts, self.tags, self.container, self.other, self.text = [], 0, 0, False, ""
        self.heading, self.links = 0, 0


class Container:
    """An element that can be a region; it holds the lines from ``lo`` up to ``hi``."""

    __slots__ = ("article", "hi", "kind", "linked", "lo", "named", "parent")

    def __init__(self, kind: str, parent: int, lo: int, article: int, named: int):
        self.kind, self.parent, self.lo, self.hi, self.linked = kind, parent, lo, None, False
        self.article, self.named = article, named  # the nearest article, and article or main part, itself included


class Lines(HTMLParser):
    """Parser events to lines; each has the container around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int]] = []  # tag, not main text, container
        self.at: dict[str, list[int]] = {}  # tag to its places in ``open``
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.others = self.other_blocks = 0
        self.containers = [Container("page", 0, 0, 0, 0)]
        self.line = Line()

    def inner(self) -> int:
        """The innermost open container."""
        return self.open[self.scopes[-1]][2] if self.scopes else 0

    def is_open(self, *tags: str) -> bool:
        return any(self.at.get(t) for t in tags)

    def end_line(self) -> None:
        if self.line.parts:
            self.line.text = " ".join("".join(self.line.parts).split())
            if self.line.text:
                self.line.container = self.inner()
                self.line.other = self.others > 0
                self.line.heading = min((int(h[1]) for h in HEADINGS if self.at.get(h)), default=0)
                self.lines.append(self.line)
        self.line = Line()

    def pop(self) -> None:
        tag, other, container = self.open.pop()
        self.at[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()
            self.other_blocks -= other
        if tag in SCOPE:
            self.scopes.pop()
            self.containers[container].hi = len(self.lines)
        self.others -= other

    def pop_to(self, i: int) -> None:
        while len(self.open) > i:
            self.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.end_line()
        if tag in CLOSES:
            i = max((self.at[name][-1] for name in CLOSES[tag] if self.at.get(name)), default=-1)
            if i >= (self.scopes[-1] if self.scopes else 0):
                self.pop_to(i)
        self.line.tags += 1
        if tag == "br":
            self.line.parts.append(" ")
        if tag in VOID:
            return
        found = {k: v or "" for k, v in attrs}
        other = names_other_part(tag, found) or (names_header(tag, found) and not self.is_open("article", "main"))
        container = 0
        if tag in SCOPE:
            container = len(self.containers)
            parent = self.inner()
            kind = tag
            if tag == "article" or found.get("itemprop") == "articleBody":
                kind = "article"
            elif tag == "main" or found.get("role") == "main":
                kind = "main"
            above = self.containers[parent]
            article = container if kind == "article" else above.article
            named = container if kind in ("article", "main") else above.named
            self.containers.append(Container(kind, parent, len(self.lines), article, named))
            self.scopes.append(len(self.open))
        if tag == "a" and "href" in found:
            self.containers[self.containers[self.inner()].article].linked = True
        if other and not self.others and tag not in BLOCK:
            self.line.parts.append(" ")
        if tag in BLOCK:
            self.blocks.append(len(self.open))
            self.other_blocks += other
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, other, container))
        self.others += other

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag not in BLOCK:
            self.line.tags += 1
            if tag == "br":
                self.line.parts.append(" ")
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_line()
        if self.at.get(tag):
            i = self.at[tag][-1]
            # An inline end tag closes nothing beyond the block around it.
            if tag in BLOCK or not self.blocks or self.blocks[-1] < i:
                self.pop_to(i)
        self.line.tags += 1
        if tag == "br":
            self.line.parts.append(" ")

    def handle_data(self, data):
        if self.is_open("script", "style") or (self.others and not self.other_blocks):
            return  # code, or a part inside a line, such as a button
        self.line.parts.append(data)
        if self.is_open("a"):
            self.line.links += len(data)

    def finish(self) -> None:
        """Ends the last line and all open elements; a link also counts for the articles further out."""
        self.end_line()
        self.pop_to(0)
        self.containers[0].hi = len(self.lines)
        for c in reversed(self.containers[1:]):
            if c.kind == "article" and c.linked:
                self.containers[self.containers[c.parent].article].linked = True


def smoothed(ratios: list[float], sigma: float) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        lo, hi = max(0, i - reach), min(len(ratios), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * r for w, r in zip(weights, ratios[lo:hi], strict=True)) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Halfway between two cluster means (1-D 2-means), at or below which lines are no content."""
    low, high = min(values), max(values)
    if low == high:
        return low - 1
    for _ in range(32):
        cut = (low + high) / 2
        a, b = [v for v in values if v <= cut], [v for v in values if v > cut]
        new = (sum(a) / len(a), sum(b) / len(b)) if a and b else (low, high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def around(parser: Lines, content: list[int]) -> int:
    """The deepest container that can be a region and holds all ``content`` lines."""
    lines, boxes = parser.lines, parser.containers
    top = lines[content[0]].container
    while boxes[top].hi <= content[-1] or boxes[top].kind in NO_REGION:
        top = boxes[top].parent
    return top


def without_side_parts(parser: Lines, content: list[int], majority: float, share: float) -> list[int]:
    """``content`` without the lines of side parts, such as a footer that no markup names.

    Where one branch of the container around the content holds the majority of it, the
    branches' own values are split in two clusters too, the value being the logarithm of
    the length of the line that a character of the branch stands in on average. The lower
    cluster goes, but for branches with at least ``share`` of the length in the majority's
    branch, and for those in or around an article or main part. Where nothing else is left,
    this goes on inside the majority's branch."""
    lines, boxes = parser.lines, parser.containers
    sizes, squares, straight = [0] * (len(lines) + 1), [0] * (len(lines) + 1), defaultdict(list)
    for i in content:
        sizes[i + 1], squares[i + 1] = len(lines[i].text), len(lines[i].text) ** 2
        straight[lines[i].container].append(i)
    sizes, squares = list(accumulate(sizes)), list(accumulate(squares))
    inner, named = defaultdict(list), set()
    for c, box in enumerate(boxes):
        if c and sizes[box.hi] > sizes[box.lo]:
            inner[box.parent].append(c)
            while box.named and c not in named:
                named.add(c)
                c = boxes[c].parent
    top, gone = around(parser, content), bytearray(len(lines))
    while inner[top]:
        mass = {c: sizes[boxes[c].hi] - sizes[boxes[c].lo] for c in inner[top]}
        square = {c: squares[boxes[c].hi] - squares[boxes[c].lo] for c in inner[top]}
        if straight[top]:  # these lines are one more branch
            mass[top] = sum(len(lines[i].text) for i in straight[top])
            square[top] = sum(len(lines[i].text) ** 2 for i in straight[top])
        most = max(mass, key=mass.get)
        if most == top or mass[most] < majority * sum(mass.values()):
            break
        length = {c: square[c] / mass[c] for c in mass}
        cut = threshold([math.log1p(x) for x in length.values()])
        side = {c for c, x in length.items() if math.log1p(x) <= cut and x < share * length[most]} - named
        for c in side - {top}:
            gone[boxes[c].lo : boxes[c].hi] = b"\1" * (boxes[c].hi - boxes[c].lo)
        for i in straight[top] if top in side else ():
            gone[i] = 1
        if len(side) < len(mass) - 1 or boxes[most].kind in NO_REGION:
            break
        top = most
    return [i for i in content if not gone[i]]


def region_of(parser: Lines, content: list[int], majority: float) -> list[int]:
    """The numbers of the lines of the region that the ``content`` lines choose."""
    lines, boxes = parser.lines, parser.containers
    first, last = content[0], content[-1]
    top = around(parser, content)
    plain = [i for i, x in enumerate(lines) if not x.other]
    sums = [0] * (len(lines) + 1)
    for i in content:
        sums[i + 1] = len(lines[i].text)
    sums = list(accumulate(sums))
    mass = lambda c: sums[c.hi] - sums[c.lo]
    keep = bytearray(len(lines))

    def take(lo: int, hi: int) -> None:
        keep[lo:hi] = b"\1" * (hi - lo)

    if boxes[top].named:
        box = boxes[boxes[top].named]
        take(box.lo, box.hi)
    elif boxes[top].kind not in ("page", "html", "body"):
        take(heading_before(lines, plain, boxes[top].lo), boxes[top].hi)
    else:
        inner = [c for c in boxes if c.kind not in ("page", "html", "body")]
        articles = [c for c in inner if c.kind == "article"]
        some = any(mass(c) for c in articles)
        most = [c for c in inner if mass(c) >= majority * sums[-1]][-1:]
        for c in inner:
            if c in most or (c.kind in ("article", "main") and mass(c)) or (c.kind == "article" and some and not c.linked):
                take(c.lo, c.hi)
        take(heading_before(lines, plain, first), last + 1)
    for c in boxes[1:]:
        if c.kind == "article" and c.linked and not mass(c):
            keep[c.lo : c.hi] = bytes(c.hi - c.lo)  # a teaser
    return [i for i in plain if keep[i]]


def heading_before(lines: list[Line], plain: list[int], start: int, reach: int = 4) -> int:
    """Where a region from ``start`` begins with the headings before it: straight before,
    or a title (h1) within ``reach`` lines that are no links."""
    begin = start
    for n, i in enumerate(reversed(plain[: bisect_left(plain, start)])):
        x = lines[i]
        if n == reach or 2 * x.links > len(x.text):
            break
        if x.heading == 1 or (x.heading and begin == (plain[bisect_left(plain, i) + 1] if n else start)):
            begin = i
        if x.heading == 1:
            break
    return begin


def main_text(html: str, sigma: float = 1.0, majority: float = 0.7, share: float = 0.5) -> str:
    """The text of a page's main region; see the module's description."""
    at = html.rfind("<")
    if at >= 0 and html[at + 1 : at + 2].strip(" =<0123456789") and ">" not in html[at:]:
        html = html[:at]  # a tag that the page's end cuts off is no text
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.finish()
    plain = [i for i, x in enumerate(parser.lines) if not x.other]
    if not plain:
        return ""
    ratios = smoothed([math.log1p(len(x.text) / max(1, x.tags)) for x in map(parser.lines.__getitem__, plain)], sigma)
    cut = threshold(ratios)
    content = [i for i, r in zip(plain, ratios, strict=True) if r > cut]
    if not content:
        return ""
    content = without_side_parts(parser, content, majority, share)
    return " ".join(parser.lines[i].text for i in region_of(parser, content, majority))


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0
) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page_id, url, html = batch.columns
            texts = [main_text(x or "", sigma) for x in html.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [page_id, url, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    return chosen.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
