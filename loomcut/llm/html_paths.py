"""HTML extraction by tag-path ratios.

A page's text nodes are gathered into blocks, each with the tag path of its
element.  For every root-to-leaf path, over all that a page shows - menus and
footers too - text length and punctuation are summed and divided by the number
of its blocks; both ratios are smoothed along the page by a Gaussian and fused
(length times one plus punctuation, less what is link text).  Paths whose fused
value, smoothed or not, reaches ``THRESHOLD`` standard deviations are content.  Of what
they select, blocks in elements that say what they are - menus, headers,
footers, sidebars, notices, adverts, forms, comments - by tag or role are left
out; where nothing else was selected, the ratios are taken anew without them.

Headings, short lists and the like lie beside what their ratios tell: the
deepest element that holds ``SHARE`` of the selected text, or an ``article``
around it, is the home.  If what was selected is at least ``HALF`` of its text,
all its blocks count, else those whose paths reach ``LOW`` of the threshold; but
no lists of links outside any ``article``, and no ``article`` without content
(teasers).  So does every container beside
it with content whose ratios reach the threshold unsmoothed as well, so that no
neighbour's text lifts it.

A class or id only hints.  A name's words up to the telling one ("widget",
"layout-sidebar-") are taken together over the page: if what bears them holds
``MOST`` of the text that may count, they name a part of the layout and tell
nothing.  Otherwise menus, sidebars and the like have their paths' value
multiplied by ``PENALTY`` and count only where it still reaches the threshold;
adverts, comments and cookie notices are left out; those exempt from that hold
``LEAST_CHARS`` characters at least and, where no word follows the telling one,
``SHARE`` of the text.

Tags needn't be closed or well-formed; a quote that isn't a value's delimiter
ends nothing.  Time and memory are linear in a page's length, however deep its
elements nest.  Defined results: null or empty html, or a page without content,
gives the empty text; an unfinished tag, comment or script at the end is
dropped; of paths with equal values all count or none; repeated rows are
extracted alike; other columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbuf as tb

THRESHOLD = 1.2
SHARE = 0.9
LINKS = 0.8
MOST = 0.5
HALF = 0.5
LOW = 0.25
PENALTY = 0.25
LEAST_CHARS = 200

#: Quotes delimit a value only directly after "="; anywhere else they are characters like others.
_TOKEN = re.compile(r"<!--(?:-?>|.*?--!?>)|<!(?!--)[^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+)>", re.S)
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)?([^>]*+)>")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript template".split())
RCDATA = frozenset(("title", "textarea"))
DROPPED = frozenset("head nav footer aside form button select textarea option datalist dialog svg math canvas audio video object map menu script style iframe noscript template title label fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption caption summary".split())
_CLOSES_P = BLOCK - {"body", "head", "html", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "dd", "dt"} | {"p"}
_SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
_FOREIGN = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup newsletter subscribe subscription signup comment comments respond reply replies disqus related recommended recommendations".split()
)
_PARTS = frozenset(
    "banner banners notice notices alert alerts notification modal overlay share sharing social discussion sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead toolbar pagination pager login search copyright skip".split()
)
_SCOPED = frozenset(("header", "headers", "topbar"))
_COMMENTS = frozenset("comment comments reply replies respond ad ads advert sponsored promo related".split())


@dataclass
class _Element:
    tag: str
    out: bool  # it or an ancestor never counts
    hints: frozenset[tuple[bool, str]]  # its and its ancestors'
    story: bool  # inside an article or main
    link: bool
    number: int
    path: int
    block: _Element | None = None  # the nearest element that makes blocks, itself included


@dataclass
class Piece:
    """A block of text: where it stands and what it is like."""

    path: int
    inside: int  # the nearest element around it that may hold other blocks too
    out: bool
    story: bool
    hints: frozenset[tuple[bool, str]] = frozenset()
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class Page:
    """Blocks in page order; of every element its parent and the outermost article around it (0: none)."""

    found: list[Piece] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    article: list[int] = field(default_factory=lambda: [0])


#: "has-sidebar" tells of a sidebar elsewhere.
_ELSEWHERE = frozenset("has with no without not is js allow enable supports".split())


def _hints(tag: str, attrs: dict[str, str], story: bool) -> set[tuple[bool, str]]:
    """What class and id hint at: whether it is foreign to any story, and the words that say so."""
    out: set[tuple[bool, str]] = set()
    if tag in ("html", "body", "main"):
        return out
    for item in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        words = [w.lower() for w in _WORDS.findall(item)]
        if not words or words[0] in _ELSEWHERE:
            continue
        for i, w in enumerate(words):
            if tag == "article":
                if w in _COMMENTS and (story or len(words) == 1):
                    out.add((True, w))
            elif w in _FOREIGN or w in _PARTS or (not story and w in _SCOPED):
                out.add((w in _FOREIGN, "-".join(words[: i + 1]) + ("-" if words[i + 1 :] else "")))
                break
    return out


def _never(tag: str, attrs: dict[str, str], story: bool) -> bool:
    if tag in DROPPED or tag == "header" and not story:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    return attrs.get("role", "").lower() in _ROLES


#: What a page doesn't show as text.
_UNSEEN = frozenset("head select option datalist svg math canvas audio video object map title".split())


def pieces(html: str) -> Page:
    """The page's blocks."""
    page = Page()
    root = _Element("", False, frozenset(), False, False, 0, 0)
    root.block = root
    stack = [root]
    open_: dict[str, int] = {}
    paths: dict[tuple[int, str], int] = {}
    unseen = 0  # elements on the stack that hold no text
    now: Piece | None = None
    pos, n = 0, len(html)

    def flush() -> None:
        nonlocal now
        if now is not None:
            now.text = " ".join(unescape("".join(now.parts)).split())
            if now.text:
                page.found.append(now)
        now = None

    def add(s: str) -> None:
        nonlocal now
        if unseen or not s:
            return
        top = stack[-1]
        own = top.block
        if top.out and not own.out:  # a button or label inside a block
            return
        if now is None:
            if s.isspace():
                return
            now = Piece(own.path, page.parent[own.number] if own.tag in LEAF else own.number, own.out, own.story, own.hints)
        now.parts.append(s)
        if top.link:
            now.linked += len(s.strip())

    def pop_to(k: int) -> None:
        nonlocal unseen
        if any(e.tag in BLOCK for e in stack[k:]):
            flush()
        for e in stack[k:]:
            open_[e.tag] -= 1
            unseen -= e.tag in _UNSEEN
        del stack[k:]

    def nearest(tag: str) -> int:
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0) if open_.get(tag) else 0

    while pos < n:
        lt = html.find("<", pos)
        if lt < 0:
            add(html[pos:])
            break
        if lt > pos:
            add(html[pos:lt])
        m = _TOKEN.match(html, lt)
        if not m:
            if not re.match(r"<[a-zA-Z/!?]", html[lt : lt + 2]):
                add("<")
                pos = lt + 1
                continue
            m = None if html.startswith("<!--", lt) else _BROKEN.match(html, lt)  # it ends at the next ">", whatever its quotes
            if not m:
                break  # unfinished
        pos = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if m.group(1):
            k = nearest(tag)
            if k:
                pop_to(k)
            elif tag in BLOCK:
                flush()
            elif tag == "br":
                add(" ")
            continue
        if tag == "br":
            add(" ")
            continue
        raw = m.group(3)
        if tag in BLOCK:
            flush()
            if tag in _CLOSES_P:
                k = nearest("p")
                if k and not any(e.tag in ("table", "button", "object", "td", "th") for e in stack[k:]):
                    pop_to(k)
            if tag in _SAME and any(open_.get(t) for t in _SAME[tag][0]):
                same, stop = _SAME[tag]
                k = 0
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in stop:
                        break
                    if stack[i].tag in same:
                        k = i
                if k:
                    pop_to(k)
        if tag in VOID:
            if tag not in ("wbr",):
                add(" ")
            continue
        attrs = {a.lower(): v[1:-1] if v[:1] in "\"'" and v else v for a, v in _ATTR.findall(raw)} if raw.strip(" /\n\t") else {}
        top = stack[-1]
        role = attrs.get("role", "").lower()
        story = top.story or tag in ("article", "main") or role in ("main", "article")
        out = top.out or _never(tag, attrs, top.story)
        hints = top.hints
        if attrs and not (own := _hints(tag, attrs, top.story)) <= hints:
            hints = hints | own
        label = tag
        if tag in ("div", "section", "ul", "ol", "table", "td"):
            label += "." + ".".join(attrs.get("class", "").split()[:2]) if attrs.get("class") else ""
        if tag in RAW or tag in RCDATA:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, pos)
            if not end:
                break
            close = html.find(">", end.end())
            pos = n if close < 0 else close + 1
            continue
        if tag == "plaintext":
            add(html[pos:])
            break
        number = len(page.parent)
        page.parent.append(top.number)
        page.article.append(page.article[top.number] or (number if tag == "article" or role == "article" else 0))
        element = _Element(tag, out, hints, story and not out, top.link or tag == "a", number, paths.setdefault((top.path, label), len(paths) + 1))
        element.block = element if tag in BLOCK else top.block
        if element.block is not element:  # an inline element is of its block
            element.path = top.path
        stack.append(element)
        open_[tag] = open_.get(tag, 0) + 1
        unseen += tag in _UNSEEN
    flush()
    return page


def _smooth(x: np.ndarray) -> np.ndarray:
    if x.size < 3:
        return x
    k = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    pad = np.pad(x, 2, mode="edge")
    return np.convolve(pad, k / k.sum(), mode="valid")


def _weighed(found: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """Of each block: whether it may count, and whether what hints are left hold for it."""
    held: dict[tuple[bool, str], int] = {}
    for x in found:
        if not x.out:
            for h in x.hints:
                held[h] = held.get(h, 0) + len(x.text)
    total = sum(len(x.text) for x in found if not x.out)
    told = {h for h, n in held.items() if (n < LEAST_CHARS and h[0]) or n < (SHARE if h[0] and h[1][-1] != "-" else MOST) * total}
    may = [not x.out and not any(h[0] and h in told for h in x.hints) for x in found]
    return np.array(may, bool), np.array([not told.isdisjoint(x.hints) for x in found], bool)


def path_ratios(found: list[Piece]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each block: its path's number, and that path's text length, punctuation and share of link text for each of its blocks."""
    paths = {p: i for i, p in enumerate(dict.fromkeys(x.path for x in found))}
    at = np.array([paths[x.path] for x in found])
    length = np.array([len(x.text) for x in found], float)
    punct = np.array([len(_PUNCT.findall(x.text)) for x in found], float)
    linked = np.minimum(np.array([x.linked for x in found], float), length)
    count = np.bincount(at)
    text = np.bincount(at, length)
    return at, (text / count)[at], (np.bincount(at, punct) / count)[at], (np.bincount(at, linked) / text)[at]


def selected(found: list[Piece], hinted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each block's path reaches the threshold, whether it does so unsmoothed, and whether it reaches ``LOW`` of it."""
    at, ratio, mark, link = path_ratios(found)
    weight = (1 - link) * np.where(hinted, PENALTY, 1)
    plain = ratio * (1 + mark) * weight
    value = np.maximum(plain, (np.bincount(at, _smooth(ratio) * (1 + _smooth(mark)) * weight) / np.bincount(at))[at])
    least = THRESHOLD * value.std()
    return value >= least, plain >= least, value >= LOW * least


def content(page: Page) -> list[Piece]:
    """The blocks of the article."""
    found = page.found
    if not found:
        return []
    may, hinted = _weighed(found)
    chosen, plain, low = selected(found, hinted)
    chosen &= may
    if not chosen.any():
        found = [x for x, m in zip(found, may) if m]
        if not found:
            return []
        hinted, may = hinted[may], may[may]
        chosen, plain, low = selected(found, hinted)
        if not chosen.any():
            chosen[:] = True
    parent, n = page.parent, len(page.parent)
    length = np.array([len(x.text) for x in found], float)
    held, whole, depth = [0.0] * n, [0.0] * n, [0] * n  # of each element: text chosen, text that may count, depth
    for x, c, m, size in zip(found, chosen, may, length):
        held[x.inside] += size * c
        whole[x.inside] += size * m
    for e in range(n - 1, 0, -1):
        held[parent[e]] += held[e]
        whole[parent[e]] += whole[e]
    for e in range(1, n):
        depth[e] = depth[parent[e]] + 1
    # The deepest element with most of the chosen text.
    home = max((e for e in range(n) if held[e] >= SHARE * held[0]), key=depth.__getitem__)
    home = page.article[home] or home
    trail, e = {home}, home
    while e:
        e = parent[e]
        trail.add(e)

    def inside(homes: set[int]) -> np.ndarray:
        within = [False] * n
        for e in range(n):
            within[e] = e in homes or e > 0 and within[parent[e]]
        return np.array([within[x.inside] for x in found])

    chosen &= plain | inside({home})
    # Containers beside it that hold chosen text; one around it would bring in all the page.
    homes = {home} | {x.inside for x, c in zip(found, chosen) if c} - trail
    stories = {page.article[x.inside] for x, c in zip(found, chosen) if c} | {home, 0}
    at, ratio, _, link = path_ratios(found)
    menu = (link > LINKS) & (ratio < 40) & (np.bincount(at)[at] >= 3) & ~np.array([x.story for x in found])
    filled = inside(homes) & may & ~hinted & ~menu & np.array([page.article[x.inside] in stories for x in found])
    filled &= low | (held[home] >= HALF * whole[home])
    return [x for x, c, f in zip(found, chosen, filled) if c or f]


def main_text(html: str | None) -> str:
    return " ".join(p.text for p in content(pieces(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                text = [main_text(h) for h in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(tb.lean(run), f"page_id {kind}, url string, text string, n_chars long")
