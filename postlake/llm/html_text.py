"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Every block element starts a new line of the
page; its ratio is the number of its characters outside of links over the number of its tags. The ratios, without
those of lines that stand in menus, headers, footers, sidebars, notices, adverts, forms or comments,
are smoothed by a Gaussian kernel, and lines above a threshold (a share of the smoothed ratios'
deviation) form clusters. A cluster that reaches into an article or main element stands for the whole
element, so its short first and last lines are kept. Without such an element the clusters stand for
the smallest block that encloses them all: what is not set aside in it stays, however short, but for
lines that are mostly links and come several in a row or at its edge. A page whose lines are all
below the threshold (a few short words) falls back on its article or main element, if it has one.

A class or id sets an element aside if a whole token is a known name or a known compound. A token
that only begins with a known name may as well come from a heading (``related-work``): such an
element is set aside only if more than half of its characters stand in links; so is one inside an
article whose id is the name of its own heading (``cookies``), comments excepted. Ids of headings and
anchors, and what headings are called, say where links lead and set nothing aside. An element around
most of the page's text (a form around a whole page, a header that wraps it) sets nothing aside: more
than half of what stands outside of links if an article or main element is in it, four fifths
otherwise; hidden elements and comments never count. Formulas are text; their annotations, which
browsers do not show, are not.

Cases: NULL or empty html gives an empty text; character references are decoded; unclosed and
crossing tags end with the element that holds them; a head without an end ends at the first tag or text that cannot
stand in it; text outside of any block is a line of its own;
a NULL page_id or url is carried along; repeated rows each get their own row; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGMA = 1.5
#: Share of the smoothed ratios' standard deviation that a content line must reach.
CUT = 0.5

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template head title iframe object svg annotation annotation-xml canvas audio video select textarea button".split())
_OUTSIDE = frozenset("nav header footer aside form menu dialog".split())
#: What can stand in a head, and what holds other elements there; the end of a head may be left out.
_IN_HEAD = frozenset("html head title base basefont bgsound link meta style script noscript template noframes".split())
_HOLDERS = frozenset("noscript template".split())
_CONTENT = frozenset("article main".split())
#: Elements that an opening tag of the same kind ends.
_ENDS = {k: frozenset(v.split()) for k, v in {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "a": "a"}.items()}
_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent notice notices alert gdpr popup modal newsletter subscribe subscription signup login share sharing social related recommended pagination pager "
    "comment comments reply replies respond disqus widget toolbar skip".split()
)
_COMPOUNDS = frozenset(
    "comment-list comments-list comment-area comments-area comment-section comments-section comment-body comment-content comment-text comment-author comment-meta comment-form comment-thread "
    "comments-title comment-respond comment-reply comment-count share-buttons share-bar share-links share-icons sharing-buttons social-share social-buttons social-links social-icons social-bar "
    "related-posts related-articles related-stories related-links cookie-notice cookie-banner cookie-consent cookie-bar consent-banner newsletter-signup newsletter-form signup-form subscribe-form login-form "
    "nav-bar nav-menu nav-links ad-slot ad-container ad-wrapper ad-unit ad-banner site-header site-footer site-nav page-footer sidebar-widget breadcrumb-list promo-box".split()
)
_NUMBERED = re.compile(r"(?:comment|reply|ad)-\d+")
_COMMENTS = frozenset("comment comments reply replies respond disqus".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


_TITLE_END = re.compile(r"</title\s*>", re.IGNORECASE)
_SLUG = re.compile(r"[\W_]+")

#: What sets an element aside: nothing, its links if they prevail, its tag or name unless it wraps the page, or for good.
_NOTHING, _BY_LINKS, _BY_NAME, _FOR_GOOD = range(4)


@dataclass
class Element:
    tag: str
    parent: int
    aside: int = _NOTHING
    id_name: str = ""
    size: int = 0
    linked: int = 0
    holds_content: bool = False
    outside: bool = False


@dataclass
class Line:
    element: int
    content: int
    parts: list[str] = field(default_factory=list)
    tags: int = 1
    linked: int = 0
    outside: bool = False

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())

    @property
    def size(self) -> int:
        return len("".join("".join(self.parts).split()))


@dataclass
class _Open:
    """An open element: its place in the list of all, and what holds inside of it."""

    tag: str
    element: int
    silent: bool
    content: int
    in_link: bool


_ROOT = _Open("", 0, False, 0, False)


class _Reader(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.elements = [Element("", 0)]
        self.lines = [Line(0, 0)]
        self.contents = 0
        self.at = 0

    def parse_starttag(self, i: int) -> int:
        self.at = i
        return super().parse_starttag(i)

    @property
    def here(self) -> _Open:
        return self.stack[-1] if self.stack else _ROOT

    def _head(self) -> int | None:
        """The place of an open head, or of a title that stands without one."""
        for k, open_ in enumerate(self.stack):
            if open_.tag in ("head", "title"):
                return k
            if open_.tag == "svg":
                return None
        return None

    def _leave_head(self, tag: str) -> None:
        """Ends an open head if ``tag`` cannot stand in it."""
        k = self._head()
        if k is not None and (tag == "body" or (tag not in _IN_HEAD and not any(o.tag in _HOLDERS for o in self.stack[k:]))):
            del self.stack[k:]
            self._break()

    def _break(self) -> None:
        last = self.lines[-1]
        if last.parts:
            self.lines.append(Line(self.here.element, self.here.content))
        else:
            last.element, last.content = self.here.element, self.here.content

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.lines[-1].tags += 1
        self._leave_head(tag)
        if tag in _VOID:
            if tag in _BLOCKS:
                self._break()
            elif tag == "br":
                self.handle_data("\n")
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag in _ENDS.get(tag, ()):
                del self.stack[k:]
                break
            if self.stack[k].tag in _BLOCKS:
                break
        here = self.here
        content = here.content
        if tag in _CONTENT and content == 0:
            self.contents += 1
            content = self.contents
        # names of the page's own content and body say nothing about their role
        aside, id_name = (_NOTHING, "") if tag in _CONTENT or tag in ("html", "body") else _set_aside(tag, attrs)
        if tag in _OUTSIDE and aside != _FOR_GOOD:
            aside, id_name = _BY_NAME, ""
        self.elements.append(Element(tag, here.element, aside, id_name if content else "", holds_content=tag in _CONTENT))
        self.stack.append(_Open(tag, len(self.elements) - 1, here.silent or tag in _SILENT, content, here.in_link or tag == "a"))
        if tag in _BLOCKS:
            self._break()
        if tag == "title" and self._head() is not None and _TITLE_END.search(self.rawdata, self.at):
            self.set_cdata_mode(tag)  # tags in it are text

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1].tags += 1
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                break
            if self.stack[k].tag in _CONTENT and tag not in ("body", "html"):
                return  # the end of nothing that is open in here
        if tag in _BLOCKS:
            self._break()

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1].tag == "head" and not data.isspace():
            self._leave_head("")
        here = self.here
        if not here.silent:
            self.lines[-1].parts.append(data)
            if here.in_link:
                self.lines[-1].linked += len("".join(data.split()))


def _set_aside(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[int, str]:
    """What its attributes say about an element, and the name, if only its id gives one."""
    aside, id_name = _NOTHING, ""
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return _FOR_GOOD, ""
        if name == "style" and value and re.search(r"display\s*:\s*none", value.lower()):
            return _FOR_GOOD, ""
        if name == "role" and (value or "").lower() in _ROLES:
            aside, id_name = max(aside, _BY_NAME), ""
        if name in ("class", "id") and value and not (name == "id" and (tag in _HEADINGS or tag == "a")):
            for token in value.lower().split():
                token = token.replace("_", "-")
                first = token.split("-")[0]
                if token in _NAMES or token in _COMPOUNDS or _NUMBERED.fullmatch(token):
                    if first in _COMMENTS:
                        return _FOR_GOOD, ""
                    id_name = token if name == "id" and aside != _BY_NAME else ""
                    aside = _BY_NAME
                elif first in _NAMES and tag not in _HEADINGS and tag != "a":
                    aside = max(aside, _BY_LINKS)
    return aside, id_name


def _place(elements: list[Element], lines: list[Line]) -> None:
    """Tell which elements, and so which lines, are set aside."""
    headings: dict[int, str] = {}  # of the elements that an id alone sets aside, the first heading
    for x in lines:
        own = elements[x.element]
        own.size += x.size
        own.linked += x.linked
        if own.tag in _HEADINGS:
            up = x.element
            while up:
                up = elements[up].parent
                if elements[up].id_name:
                    headings.setdefault(up, _SLUG.sub("-", x.text.lower()).strip("-"))
    for e in reversed(elements[1:]):
        above = elements[e.parent]
        above.size += e.size
        above.linked += e.linked
        above.holds_content |= e.holds_content
    page = max(1, elements[0].size - elements[0].linked)
    for n, e in enumerate(elements[1:], 1):
        aside = e.aside
        if e.id_name and headings.get(n) == e.id_name:
            aside = _BY_LINKS
        if aside == _BY_LINKS:
            out = 2 * e.linked > e.size
        elif aside == _BY_NAME:
            out = (e.size - e.linked) <= (0.5 if e.holds_content else 0.8) * page
        else:
            out = aside == _FOR_GOOD
        above = elements[e.parent]
        e.outside = above.outside or out
        if e.tag in ("h1", "h2") and above.tag in ("header", "hgroup") and not out:
            e.outside = elements[above.parent].outside or (above.aside == _FOR_GOOD)
    for x in lines:
        x.outside = elements[x.element].outside


def _read(html: str | None) -> tuple[list[Line], list[Element]]:
    """The lines of a page that hold text, and its elements."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    lines = [x for x in reader.lines if x.text]
    _place(reader.elements, lines)
    return lines, reader.elements


def lines_of(html: str | None) -> list[Line]:
    """The lines of a page that hold text."""
    return _read(html)[0]


def _enclosed(lines: list[Line], elements: list[Element], chosen: list[bool]) -> list[bool]:
    """The lines of the smallest block around all chosen ones, but for rows of links."""

    def above(e: int) -> list[int]:
        path = [e]
        while path[-1]:
            path.append(elements[path[-1]].parent)
        return path[::-1]

    shared: list[int] | None = None
    for x, c in zip(lines, chosen, strict=True):
        if c:
            path = above(x.element)[:-1] or [0]  # the block around the line's own
            shared = path if shared is None else [a for a, b in zip(shared, path, strict=False) if a == b]
    around = shared[-1]
    inside = [not x.outside and around in above(x.element) for x in lines]
    places = [n for n, k in enumerate(inside) if k]
    links = [2 * lines[n].linked > lines[n].size for n in places]
    for k, n in enumerate(places):
        if links[k] and not (0 < k < len(places) - 1 and not links[k - 1] and not links[k + 1]):
            inside[n] = False
    return inside


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratios, reach), kernel, "valid")


def main_text(html: str | None, sigma: float = SIGMA, share: float = CUT) -> str:
    """The main text of one page, a line for each block."""
    lines, known = _read(html)
    if not lines:
        return ""
    texts = [x.text for x in lines]
    ratios = np.array([0.0 if x.outside else max(0, len(t) - t.count(" ") - x.linked) / x.tags for x, t in zip(lines, texts, strict=True)])
    level = smoothed(ratios, sigma)
    chosen = (level >= share * level.std()) & (ratios > 0)
    elements = {x.content for x, c in zip(lines, chosen, strict=True) if c and x.content}
    if elements:
        keep = [not x.outside and x.content in elements for x in lines]
    elif chosen.any():
        keep = _enclosed(lines, known, chosen.tolist())
    else:
        keep = [not x.outside and x.content > 0 for x in lines]
    return "\n".join(t for t, k in zip(texts, keep, strict=True) if k)


def text_column(html: str | Column) -> Column:
    """The main text of a column of pages."""

    @F.pandas_udf("string")
    def extracted(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return extracted(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    out = pages.select("page_id", "url", text_column("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
