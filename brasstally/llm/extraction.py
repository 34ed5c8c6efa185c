"""Main text of web pages by smoothed text-to-tag ratios (after Weninger et al., 2010).

The standard library's parser streams events. A page's lines are its blocks: stretches of text between
block-level tags, each with the tags seen since the block before. A line's ratio of characters to tags is smoothed with a
Gaussian and compared with a threshold at which two clusters of the page's ratios part; all lines of the page count there, menus too. Lines
above the threshold are selected on every page, and selected lines decide which elements hold content. Lines
in elements that are never part of an article (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments; a header inside the article is a header, too) are out. A class or id whose head is such a word says so (``cookie-notice``,
``nav-list``), and so does one with a detail of it (``comment-author``); where it only comes first (``notice-period``, ``cookie-recipe``) the ratios decide: the element stays if most of its text is selected.
Declarations of any form are skipped, malformed ones up to the next ``>``.

Elements that say they are the article (``article``, ``main``, roles) only add to the selected lines: each one that is the innermost such element of
a selected line gives all its lines that are not out, short ones too. On a page without them the innermost container of all selected lines does so,
but for containers and lists of mostly links without a selected line.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brasstally.llm.common import widened

# Elements of HTML by their part in a page.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUT = frozenset("nav aside header footer form script style head noscript template iframe object svg canvas button select textarea dialog menu audio video map math".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of class and id attributes that mark what isn't article text.
HINTS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer foot sidebar aside ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments disqus replies respond widget toolbar pagination pager skip copyright disclaimer legal".split())
#: Those of HINTS after which a detail of them may be named.
CERTAIN = frozenset("navbar menubar breadcrumb breadcrumbs masthead sidebar ads advert adverts advertisement advertising adbox adslot sponsor sponsored cookie cookies gdpr newsletter comment comments disqus pagination pager popup modal".split())
#: Words after one of HINTS that only say which part or place of it is meant.
PLACES = frozenset("area bar block body bottom box btn button buttons cell close col column container content footer fixed group holder icon icons inner item items label left level line link links list main menu module news outer page panel posts articles products region right row section slot stories text title toggle top unit widget wrap wrapper".split())
#: Words after one of CERTAIN that name a detail of it.
DETAILS = frozenset("author avatar by byline count date entry even form id meta message name number odd policy reply replies settings thread time user".split())
ABOUT = frozenset("no not has have with without is".split())
ARTICLE_ROLES = frozenset(("main", "article"))
#: An element that starts closes an open one of these, with all that is open inside.
CLOSES = {"p": BLOCKS - {"br", "title"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body", *(BLOCKS - {"title", "head", "html"})}}
_LISTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Elements that hold a text's blocks and may be the article.
CONTAINERS = frozenset("html body main article section div center table td nav aside".split())
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
#: The elements that a starting one may close.
_CLOSERS: dict[str, list[str]] = {t: [name for name, by in CLOSES.items() if t in by] for t in BLOCKS | frozenset(CLOSES)}
_GROUPS = CONTAINERS | frozenset("ul ol dl".split())
_SPACE = re.compile(r"\s+")
#: A document type with declarations in brackets; quoted strings in them may hold any sign.
_SUBSET = re.compile(r"""<![^\[>]*+\[(?:"[^"]*+"|'[^']*+'|[^"'\]])*+\]\s*+>""")
SMOOTHING = 1.0


def _hinted(attrs: list[tuple[str, str | None]]) -> int:
    """2 if attributes mark what isn't article text, 1 if they may; a name such as ``no-sidebar`` or ``has-menu`` tells of the page around it."""
    found = 0
    for name, value in attrs:
        if name in ("class", "id") and value:
            for token in value.split():
                words = [w.lower() for w in _WORD.findall(token)]
                for at, w in enumerate(words):
                    if w in HINTS and (at == 0 or words[at - 1] not in ABOUT):
                        after = PLACES | HINTS | (DETAILS if w in CERTAIN else frozenset())
                        found = max(found, 2 if all(x in after for x in words[at + 1 :]) else 1)
        if name == "role" and value and value.strip().lower() in ROLES:
            return 2
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 2
    return found


class _Lines(HTMLParser):
    """Lines (text, tags before and in it, innermost open element, out, the element that makes it doubtful, characters in links) of one page; elements are numbered from 1 as they open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool, int]] = []  # tag, number, out by element or role, out by a hint, doubtful element
        self.lines: list[tuple[str, int, int, bool, int, int]] = []
        self.parent = [0]
        self.names: Counter[str] = Counter()
        self.article: set[int] = set()
        self.containers: set[int] = set()
        self.groups: set[int] = set()
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts = []
            if text:
                _, n, out, hinted, doubtful = self.open[-1] if self.open else ("", 0, False, False, 0)
                self.lines.append((text, self.tags, n, out or hinted, doubtful, min(self.linked, len(text))))
                self.tags = self.linked = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if any(self.names[x] for x in _CLOSERS.get(tag, ())):
            self.close_implied(tag)
        if tag in VOID:
            return
        number = len(self.parent)
        _, above, out, hinted, doubtful = self.open[-1] if self.open else ("", 0, False, False, 0)
        self.parent.append(above)
        mark = 0 if tag in ("html", "body", "main") else _hinted(attrs)
        if (tag in ("article", "main") or any(k == "role" and v in ARTICLE_ROLES for k, v in attrs)) and mark < 2:
            if not self.article:
                # what holds the article isn't out, whatever it is called
                self.open = [(t, n, o, False, 0) for t, n, o, _, _ in self.open]
                hinted, doubtful = False, 0
            self.article.add(number)
            mark = 0
        self.open.append((tag, number, out or tag in OUT, hinted or mark == 2, doubtful or (number if mark == 1 else 0)))
        self.names[tag] += 1
        if tag in CONTAINERS:
            self.containers.add(number)
        if tag in _GROUPS:
            self.groups.add(number)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_implied(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if tag in CLOSES.get(name, ()):
                self.close_from(at)
                return
            if name in CONTAINERS or name in _LISTS.get(tag, ()):
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if self.names[tag]:
            self.close_from(next(at for at in range(len(self.open) - 1, -1, -1) if self.open[at][0] == tag))

    def close_from(self, at: int) -> None:
        self.names.subtract(x[0] for x in self.open[at:])
        del self.open[at:]

    def parse_html_declaration(self, i):
        """Past a declaration: a comment, a document type with what stands in its brackets, a CDATA section, or anything else up to ``>`` (to the page's end without one)."""
        page = self.rawdata
        if page.startswith("<!--", i):
            return self.parse_comment(i)
        if page.startswith("<![CDATA[", i):
            end = page.find("]]>", i)
            return end + 3 if end >= 0 else len(page)
        end = page.find(">", i)
        if end >= 0 and "[" in page[i:end] and page[i : i + 9].lower() == "<!doctype" and (inner := _SUBSET.match(page, i)):
            return inner.end()
        return end + 1 if end >= 0 else len(page)

    def handle_data(self, data):
        if self.cdata_elem is None:
            self.parts.append(data)
            self.linked += len(data) if self.names["a"] else 0


def smoothed(ratio: np.ndarray, sigma: float = SMOOTHING) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; ends are repeated."""
    r = int(np.ceil(2 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(ratio, r, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Halfway between the means of two clusters of the values, found by alternating assignment and means."""
    low, high = float(values.min()), float(values.max())
    for _ in range(32):
        cut = (low + high) / 2
        above = values > cut
        if not above.any() or above.all():
            break
        new = float(values[~above].mean()), float(values[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high > low else low - 1


def _selected(lines: list[tuple]) -> np.ndarray:
    """Whether each line's smoothed ratio of characters to tags, or its own, is in the upper cluster."""
    ratio = np.log1p([len(t) / max(tags, 1) for t, tags, *_ in lines])
    smooth = smoothed(ratio)
    # a line over the threshold by itself isn't lost to short neighbours
    return np.maximum(ratio, smooth) >= threshold(smooth)


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by one space; an empty string if there is none."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.end_line()
    if not page.lines:
        return ""
    chosen = _selected(page.lines)
    # an element with a doubtful name is out unless most of its text is selected
    doubt: Counter[int] = Counter()
    for (text, _, _, _, d, _), good in zip(page.lines, chosen, strict=True):
        doubt[d] += len(text) if good else -len(text)
    stays = [not out and (not d or doubt[d] > 0) for _, _, _, out, d, _ in page.lines]
    lines = [x for x, ok in zip(page.lines, stays, strict=True) if ok]
    chosen = chosen[np.array(stays)]
    if not lines:
        return ""
    if not chosen.any():  # only menus and the like were above the threshold
        chosen = _selected(lines)
    size = len(page.parent)
    votes, count, text_of, linked = (np.zeros(size, np.int64) for _ in range(4))
    for (text, _, n, _, _, links), good in zip(lines, chosen, strict=True):
        votes[n] += len(text) if good else 0
        count[n] += 1
        text_of[n] += len(text)
        linked[n] += links
    for n in range(size - 1, 0, -1):  # what is inside has larger numbers
        for sums in (votes, count, text_of, linked):
            sums[page.parent[n]] += sums[n]
    # each element's innermost one that says it is the article, and its innermost container or list
    within, group = [0] * size, [0] * size
    for n in range(1, size):
        within[n] = n if n in page.article else within[page.parent[n]]
        group[n] = n if n in page.groups else group[page.parent[n]]
    declared = {within[n] for (_, _, n, *_), good in zip(lines, chosen, strict=True) if good} - {0}
    # without one, the innermost container of all selected lines and more than a line, else the whole page
    whole = max((n for n in page.containers if votes[n] == votes[0] and count[n] > 1), default=0)
    inside = declared or {whole}
    for n in range(1, size):
        if page.parent[n] in inside:
            inside.add(n)
    menu = {g for g in set(group) if not declared and g and not votes[g] and 2 * linked[g] >= text_of[g]}
    return " ".join(t for (t, _, n, *_), good in zip(lines, chosen, strict=True) if good or n in inside and group[n] not in menu)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` without html, with text and n_chars (its code points).

    A null page counts as an empty one. Every row stays, repeated ones too; columns named text or n_chars in ``pages`` are
    replaced.
    """
    keep = pages.drop("text", "n_chars")
    rest = keep.drop("html")
    names = rest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(h) for h in batch["html"].to_pylist()], pa.string())
            size = pa.array([len(t) for t in text.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), text, size], names=[*names, "text", "n_chars"])

    return keep.mapInArrow(run, widened(rest, text="string", n_chars="long"))
