"""Main text of web pages by the distribution of text over line blocks.

1. Markup is stripped into *lines*, one for each block of the page (paragraph, heading,
   list item, table row, stretch between line breaks). Lines remember the elements around
   them. Lines count as empty inside elements that are boilerplate by kind (navigation,
   footers, asides, scripts) or that hold reader comments, as do runs of links.
2. Names (``class``, ``id``) are read as whole words of a page's author: ``sidebar`` or
   ``top-menu`` name what an element is, ``has-sidebar`` or ``menu-open`` say something of the page
   and count for nothing. An element named as boilerplate is that unless it holds an article, or most
   of the text of a page with no article to speak of; a form too. A name that only begins like one
   (``related-work``) makes an element boilerplate outside of articles, if it is mainly links.
3. The lengths of the lines, each bounded by a multiple of the page's median line, are
   summed over sliding windows of three. From the fullest window the text is followed to
   the left up to its surge and to the right up to its dive, where the windows fall under
   a share of the fullest one for longer than a short valley.
4. The element that holds the text between surge and dive (the article around its
   fullest window, else the deepest element with most of it, widened while the element
   around it adds mainly text that is no boilerplate) is the page's body: all its lines
   that are no boilerplate are kept, short ones too, and those of other articles beside an
   article. Without an article, so are the lines between surge and dive.

Defined results: null html is an empty page; a page without text gives ``''`` and 0.
Unclosed and cut-off markup is closed where the next block or the end demands it. Repeated
rows are treated alike; an empty table gives no rows. Work is linear in the page's length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

WINDOW = 3
FALL = 0.15  # surge and dive: a window below this share of the fullest
BOUND = 3  # a line counts in windows as so many median lines at most
VALLEY = 2 * WINDOW  # so many low windows between high ones do not end the text
HOLDS = 0.8  # share of the text between them that the body must hold

# Kinds of elements.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody",
    "tfoot", "thead", "tr", "ul", "caption", "br", "button", "template",
}
_DROPPED = {
    "head", "nav", "footer", "aside", "menu", "dialog", "select", "button", "template", "svg", "math", "canvas",
    "object", "audio", "video", "datalist", "map",
}
_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu",
    "menubar", "toolbar", "status",
}
_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "sponsor", "sponsored", "promo",
    "promotion", "promoted", "banner", "sidebar", "sidenav", "side", "menu", "menubar", "nav", "navbar", "navigation", "topnav",
    "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "cookie", "cookies", "cookiebar", "consent", "gdpr", "notice",
    "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "signin", "search", "searchbox", "share", "sharing", "social", "related", "recommended", "recommendations", "trending",
    "pagination", "pager", "toolbar", "widget", "widgets", "copyright", "disclaimer", "skip", "outbrain", "taboola", "teaser",
    "teasers", "paywall", "header",
}
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "discussion"}
# What follows a name of boilerplate when both name an element: "sidebar-left", "related-posts".
_PLACES = {
    "list", "item", "items", "box", "bar", "block", "area", "wrap", "wrapper", "container", "section", "link", "links", "button",
    "buttons", "bottom", "top", "left", "right", "inner", "outer", "content", "body", "slot", "unit", "form", "panel", "column", "row",
    "text", "message", "posts", "articles", "stories", "news", "icons", "thread", "meta", "author", "title", "main", "primary", "secondary",
}
# What makes a name say something of the page: "has-sidebar", "comments-open".
_SAYS = {
    "has", "have", "with", "without", "no", "not", "is", "are", "show", "shows", "hide", "hides", "open", "opened", "closed", "on", "off",
    "enabled", "disabled", "active", "visible", "layout", "js", "supports",
}
_INSIDE = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
_ENDS = {
    "li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
    "th": {"table", "tr"}, "option": {"select"},
}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)"""
    r"""|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>="'][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class _Element:
    name: str
    parent: int
    dropped: bool = False  # by kind, or reader comments: nothing inside counts
    named: bool = False  # by name, or a form: unless it holds much of the page
    hinted: bool = False  # by the beginning of a name: if it is mainly links


@dataclass
class _Line:
    text: str
    element: int
    linked: int


@dataclass
class _Page:
    elements: list[_Element] = field(default_factory=lambda: [_Element("page", -1)])
    lines: list[_Line] = field(default_factory=list)


def _meaning(word: str) -> str:
    """What a word of ``class`` or ``id`` names: ``comments``, ``named``, ``hinted`` or nothing."""
    parts = [part.lower() for part in _PART.findall(word) if not part.isdigit()]
    if not parts or _SAYS.intersection(parts):
        return ""
    if _COMMENTS.intersection(parts):
        return "comments"
    if "".join(parts) in _NAMES or parts[-1] in _NAMES or (parts[0] in _NAMES and parts[-1] in _PLACES):
        return "named"
    return "hinted" if _NAMES.intersection(parts) else ""


def _attributes(rest: str) -> tuple[set[str], str, bool]:
    """What class and id name, the role, and whether the element is hidden."""
    names, role, hidden = set(), "", False
    for key, value in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'")
        if key == "role":
            role = value.strip().lower()
        elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true":
            hidden = True
        elif key in ("class", "id"):
            names.update(map(_meaning, value.split()))
    return names, role, hidden


def _strip(source: str) -> _Page:
    """Lines of a page, with the elements around each."""
    page = _Page()
    stack = [0]
    opened: Counter[str] = Counter()  # names on the stack
    text: list[str] = []
    linked = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        line = " ".join("".join(text).split())
        if line:
            page.lines.append(_Line(line, stack[-1], linked))
        text.clear()
        linked = 0

    def close(name: str, bounds: frozenset | set = frozenset()) -> None:
        if not opened[name]:
            return
        for depth in range(len(stack) - 1, 0, -1):
            here = page.elements[stack[depth]].name
            if here == name:
                opened.subtract(page.elements[i].name for i in stack[depth:])
                del stack[depth:]
                return
            if here in bounds:
                return

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece)
            text.append(piece)
            if opened["a"]:
                linked += len(piece.strip())

    while at < len(source):
        found = _TAG.search(source, at)
        if not found:
            add(source[at:])
            break
        add(source[at : found.start()])
        at = found.end()
        name = (found["name"] or "").lower()
        if not name:
            continue
        if name in _BLOCK:
            flush()
        elif name in ("td", "th"):
            text.append(" ")
        if found["end"]:
            close(name)
            continue
        if name in _BLOCK and name != "br":
            close("p", {"div", "section", "article", "td", "th", "li", "blockquote", "body", "button"})
        if name in _ENDS:
            close(name, _ENDS[name])
            if name in ("dt", "dd"):
                close("dd" if name == "dt" else "dt", _ENDS[name])
        if name == "body":
            close("head")
        if name in _VOID or found["rest"].endswith("/") and name in ("svg", "math"):
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        element = _Element(name, stack[-1])
        names, role, hidden = _attributes(found["rest"]) if found["rest"] else (set(), "", False)
        in_article = opened["article"] or opened["main"]
        page_wide = name in ("html", "body", "main")
        element.dropped = name in _DROPPED or role in _ROLES or hidden or (name == "header" and not in_article)
        element.dropped |= "comments" in names and not page_wide
        element.named = name in ("form", "fieldset") or ("named" in names and not page_wide and name != "article")
        element.hinted = "hinted" in names and not page_wide and not in_article and name != "article"
        told = element.dropped or element.named or element.hinted or name in _BLOCK or name in ("a", "td", "th")
        if not told and not opened[name]:
            continue  # a plain inline element decides nothing, closed or not
        opened[name] += 1
        page.elements.append(element)
        stack.append(len(page.elements) - 1)
    flush()
    return page


def _ancestors(page: _Page, element: int) -> list[int]:
    """From the element up to the page."""
    out = []
    while element >= 0:
        out.append(element)
        element = page.elements[element].parent
    return out


def _surge_and_dive(lengths: np.ndarray) -> tuple[int, int, int]:
    """First and last line of the fullest stretch, and its fullest window's longest line."""
    sums = np.convolve(lengths, np.ones(WINDOW, dtype=np.int64), "full")[WINDOW - 1 :]  # of each line and those after it
    peak = int(np.argmax(sums))
    low = FALL * sums[peak]
    first = last = peak
    for i in np.flatnonzero(sums[:peak] >= low)[::-1].tolist():
        if first - i > VALLEY + 1:
            break
        first = i
    for i in (peak + 1 + np.flatnonzero(sums[peak + 1 :] >= low)).tolist():
        if i - last > VALLEY + 1:
            break
        last = i
    while first < last and not lengths[first]:
        first += 1
    return first, last, peak + int(np.argmax(lengths[peak : peak + WINDOW]))


def _sums(page: _Page, lengths: np.ndarray) -> np.ndarray:
    """Text inside each element."""
    held = np.zeros(len(page.elements), dtype=np.int64)
    np.add.at(held, [line.element for line in page.lines], lengths)
    held = held.tolist()
    for i in range(len(held) - 1, 0, -1):  # children come after their parents
        held[page.elements[i].parent] += held[i]
    return np.array(held)


MOST = 0.5  # of the page's text: what holds so much is no boilerplate by name ...
TIMES = 5  # ... if that is so many times the text of the largest article
MUCH = 0.5  # of the largest article's text: what holds an article of so much is none either


def _boilerplate(page: _Page, lengths: np.ndarray, linked: np.ndarray) -> list[bool]:
    """Elements whose text does not count, by name and what they hold; ``lengths`` leave out what is dropped by kind."""
    held, links = _sums(page, lengths), _sums(page, linked)
    articles = [i for i, element in enumerate(page.elements) if element.name in ("article", "main") and held[i]]
    largest = max((int(held[i]) for i in articles), default=0)
    frames = [False] * len(page.elements)  # around an article that holds much
    for i in articles:
        frames[page.elements[i].parent] |= bool(held[i] >= MUCH * largest)
    for i in range(len(page.elements) - 1, 0, -1):
        frames[page.elements[i].parent] |= frames[i]
    most = max(MOST * int(held[0]), TIMES * largest)
    bad = [False] * len(page.elements)
    for i, element in enumerate(page.elements):  # parents come first
        by_name = element.named or (element.hinted and 2 * links[i] >= held[i])
        bad[i] = (i > 0 and bad[element.parent]) or (by_name and held[i] <= most and not frames[i])
    return bad


def main_text(source: str | None) -> str:
    page = _strip(source or "")
    if not page.lines:
        return ""
    n = len(page.elements)
    bad, inner = [False] * n, [False] * n
    for i, element in enumerate(page.elements):  # parents come first
        up = element.parent
        bad[i] = (i > 0 and bad[up]) or element.dropped
        inner[i] = (i > 0 and inner[up]) or element.name in ("article", "main")
    raw = np.array([0 if bad[line.element] else len(line.text) for line in page.lines], dtype=np.int64)
    named = _boilerplate(page, _bounded(raw), np.minimum(raw, [line.linked for line in page.lines]))
    lengths = np.zeros(len(page.lines), dtype=np.int64)
    for k, line in enumerate(page.lines):
        link = line.linked >= 0.9 * len(line.text) and not inner[line.element] and len(line.text) < 200
        lengths[k] = 0 if link or named[line.element] else raw[k]
    if not lengths.any():
        return ""
    bounded = _bounded(lengths)
    first, last, centre = _surge_and_dive(bounded)
    body = _body(page, _ancestors(page, page.lines[centre].element), bounded, first, last)
    whole_page = page.elements[body].name in ("page", "html", "body")
    article = page.elements[body].name in ("article", "main")
    bodies = {body}
    if page.elements[body].name == "article":  # and the articles beside it
        up = page.elements[body].parent
        bodies.update(i for i, e in enumerate(page.elements) if e.parent == up and e.name == "article")
    below = [False] * n
    for i, element in enumerate(page.elements):
        below[i] = i in bodies or (i > 0 and below[element.parent])
    kept = [
        line.text
        for k, line in enumerate(page.lines)
        if lengths[k] and (below[line.element] and not whole_page or not article and first <= k <= last)
    ]
    return "\n".join(kept)


def _bounded(lengths: np.ndarray) -> np.ndarray:
    """Lengths of at most a multiple of the median line, so that no single line decides."""
    full = np.sort(lengths[lengths > 0])
    return np.minimum(lengths, BOUND * full[(len(full) - 1) // 2]) if len(full) else lengths


def _body(page: _Page, path: list[int], lengths: np.ndarray, first: int, last: int) -> int:
    """The element of ``path`` (upwards) that holds the text between surge and dive."""
    for name in ("article", "main"):
        for i in path:
            if page.elements[i].name == name:
                return i
    held = [0] * len(page.elements)
    for k in range(first, last + 1):
        held[page.lines[k].element] += int(lengths[k])
    for i in range(len(held) - 1, 0, -1):  # children come after their parents
        held[page.elements[i].parent] += held[i]
    enough = HOLDS * lengths[first : last + 1].sum()
    blocks = (i for i in path if page.elements[i].name in _BLOCK - _INSIDE or i == 0)
    body = next((i for i in blocks if held[i] >= enough), 0)
    return _widened(page, body, lengths)


def _widened(page: _Page, body: int, lengths: np.ndarray) -> int:
    """The outermost element below the page to which each step up adds mainly text that counts."""
    own, good = [0] * len(page.elements), [0] * len(page.elements)
    for k, line in enumerate(page.lines):
        own[line.element] += len(line.text)
        good[line.element] += int(lengths[k])
    for i in range(len(own) - 1, 0, -1):
        own[page.elements[i].parent] += own[i]
        good[page.elements[i].parent] += good[i]
    up = page.elements[body].parent
    while up > 0 and page.elements[up].name not in ("html", "body"):
        if 2 * (good[up] - good[body]) < own[up] - own[body]:
            break
        body, up = up, page.elements[up].parent
    return body


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Columns of ``pages`` without the html, ``text`` and ``n_chars`` (its code points).

    Columns of these names are replaced; the others pass through untouched.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = StructType([pages.schema[c] for c in kept] + [StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(source.as_py()) for source in batch.column(html_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], names=[*kept, "text"])

    found = pages.select(*[F.col(f"`{c}`") for c in (*kept, html_col)]).mapInArrow(run, schema)
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
