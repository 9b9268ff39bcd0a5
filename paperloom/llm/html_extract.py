"""Main text of web pages by text density.

The standard library's streaming parser turns a page into lines: the text of one block each, with its tags, the share of
its text inside links, and the regions (``nav``, ``footer``, ...) that are open around it. A line's text-to-tag ratio is its
characters (those in links count against it) over its tags. Lines of elements that are never content (menus, headers,
footers, forms, scripts, styles, hidden parts) are barred and have none; so are lines of elements whose class or id names a
sidebar, notice, advert, comments or the like. Such a name bars nothing where its element holds the page's only marked
region (an ``article`` or ``main`` element), or nearly all of the text that is left, unless it names reader comments; and a
name like ``has-sidebar`` isn't one. The ratios' logarithms are smoothed by a Gaussian kernel and split midway between two
clusters' centres; dense lines are content, and a line between two of them that is no list of links is too. Where dense lines
stand inside a marked region, the content is that region: all its lines but the runs of links that aren't dense.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by a line
feed in page order; nothing is shortened. A null or empty page has an empty text. Pages that end early are read to their
end. Each row is extracted by itself: repeated rows and null ids come back as they are; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.common import arrow_map, text_bytes

#: Elements whose start or end breaks a line of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never content.
NEVER = frozenset("aside button canvas dialog footer form head header iframe input label menu nav noscript object script select style svg template textarea title".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Of class and id names: parts of a page that aren't the article's text.
BOILERPLATE = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted recommended related remarks replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Of those, names of what readers wrote.
REMARKS = frozenset("comment comments disqus remarks replies reply respond".split())
#: First words of a name that says what an element has or lacks, not what it is.
ABOUT = frozenset("has have is no not show hide with without".split())
#: An element that holds this many times the text that is left elsewhere, and this many characters, isn't barred by its name.
MOST, LEAST = 4, 200
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: End tags that a start tag implies.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Standard deviation of the smoothing, in lines; lines that may stand between two dense ones.
SIGMA, BETWEEN = 1.5, 3
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


def named(value: str) -> frozenset[str]:
    """The words of class and id names that bar an element."""
    found = set()
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if words and words[0] not in ABOUT:
            found.update(BOILERPLATE.intersection(words))
    return frozenset(found)


class Lines(HTMLParser):
    """Collects lines: text, tags, characters inside links, number of the marked region around it (0: none), whether it is
    barred for good, number of the innermost element around it that its name bars (0: none)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, int]] = []
        self.region = 0  # the outermost marked element that is open, counted from 1
        self.regions: list[int] = [0]  # for each the innermost barred element around it
        self.barred: list[tuple[int, bool]] = [(0, False)]  # for each element with such a name: the one around it, whether it holds remarks
        self.open: list[tuple[str, bool, bool, bool]] = []  # name, bars its text for good, marks its text, has a name that bars
        self.at: dict[str, list[int]] = {}  # where in it each name stands
        self.blocks: list[int] = []
        self.walls: list[int] = []  # article, main, body
        self.parts: list[str] = []
        self.tags = self.linked = self.bars = self.marks = self.links = self.inner = 0

    def line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.tags, self.linked, self.region, self.bars > 0, self.inner))
                self.tags = 0
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS or tag in NEVER:
            self.line()
        self.tags += 1
        if tag in IMPLIED:
            k = max((self.at[name][-1] for name in IMPLIED[tag] if self.at.get(name)), default=-1)
            if k >= 0 and k >= self.blocks[-1]:
                self.leave(k)
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        bar, mark, names = tag in NEVER, tag in ("article", "main"), frozenset()
        if attrs and not bar:
            for name, value in attrs:
                if name in ("class", "id"):
                    names |= named(value or "")
                elif name == "role":
                    bar = bar or (value or "").lower() in ROLES
                    mark = mark or (value or "").lower() in ("main", "article")
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in (value or "").replace(" ", "").lower():
                    bar = True
        soft = bool(names) and not bar and tag not in ("html", "body")
        mark = mark and not soft
        if bar or mark or soft:
            self.line()
        k = len(self.open)
        self.open.append((tag, bar, mark, soft))
        self.at.setdefault(tag, []).append(k)
        if tag in BLOCKS:
            self.blocks.append(k)
        if tag in ("article", "main", "body"):
            self.walls.append(k)
        self.bars += bar
        if soft:
            self.barred.append((self.inner, bool(names & REMARKS)))
            self.inner = len(self.barred) - 1
        if mark:
            if not self.marks:
                self.regions.append(self.inner)
                self.region = len(self.regions) - 1
            self.marks += 1
        self.links += tag == "a"

    def leave(self, k: int) -> None:
        """Close the element at ``k`` and all inside it."""
        if any(bar or mark or soft for _, bar, mark, soft in self.open[k:]):
            self.line()
        while len(self.open) > k:
            name, bar, mark, soft = self.open.pop()
            self.at[name].pop()
            for where in (self.blocks, self.walls):
                if where and where[-1] == len(self.open):
                    where.pop()
            self.bars -= bar
            self.marks -= mark
            self.links -= name == "a"
            if soft:
                self.inner = self.barred[self.inner][0]
        if not self.marks:
            self.region = 0

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS or tag in NEVER:
            self.line()
        if where := self.at.get(tag):
            # A stray end tag doesn't leave the region it stands in.
            if tag in ("body", "html") or not self.walls or self.walls[-1] <= where[-1]:
                self.leave(where[-1])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_page(self) -> None:
        """End of the page, wherever it was cut."""
        self.close()
        self.line()

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the edges the kernel is cut and scaled."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[reach:-reach] / np.convolve(np.ones(len(values)), kernel)[reach:-reach]


def threshold(values: np.ndarray) -> float:
    """Midway between the centres of two clusters (one-dimensional two-means); below all if they don't differ."""
    low, high = float(values.min()), float(values.max())
    if high - low < 0.7:
        return -np.inf
    for _ in range(30):
        mid = (low + high) / 2
        upper = values >= mid
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def admitted(lines: list[tuple[str, int, int, int, bool, int]], regions: list[int], barred: list[tuple[int, bool]]) -> np.ndarray:
    """Which lines are not barred. Names bar elements, but not those that hold the only marked region or nearly all the text."""
    ok = np.array([not x[4] for x in lines])
    inner = np.array([x[5] for x in lines])
    size = np.array([max(0, len(x[0]) - 2 * x[2]) for x in lines]) * ok
    if len(barred) == 1 or not size.sum():
        return ok
    held, remarks = np.zeros(len(barred), np.int64), np.zeros(len(barred), bool)
    np.add.at(held, inner, size)
    for n in range(len(barred) - 1, 0, -1):  # an element comes after those around it
        if barred[n][0]:
            held[barred[n][0]] += held[n]
    for n in range(1, len(barred)):
        remarks[n] = barred[n][1] or remarks[barred[n][0]]
    lifted = np.zeros(len(barred), bool)
    lifted[0] = True
    written = np.unique([x[3] for x, good in zip(lines, ok.tolist(), strict=True) if good and x[3]])
    if len(written) and all(regions[r] for r in written.tolist()):
        for r in written.tolist():
            n = regions[r]
            while n and not lifted[n] and not remarks[regions[r]]:
                lifted[n] = True
                n = barred[n][0]
    elif len(regions) == 1:
        free, own, children = int(size[inner == 0].sum()), np.bincount(inner, size, len(barred)), [[] for _ in barred]
        for n in range(1, len(barred)):
            children[barred[n][0]].append(n)
        outer = [(-held[n], n) for n in children[0] if not remarks[n]]
        heapq.heapify(outer)
        while outer and -outer[0][0] > max(MOST * free, LEAST):
            n = heapq.heappop(outer)[1]
            lifted[n] = True
            free += int(own[n])
            for child in children[n]:
                if not remarks[child]:
                    heapq.heappush(outer, (-held[child], child))
    for n in range(1, len(barred)):
        lifted[n] &= lifted[barred[n][0]]
    return ok & lifted[inner]


def choose(lines: list[tuple[str, int, int, int, bool, int]], ok: np.ndarray, density: bool = True) -> np.ndarray:
    """Which lines are content. Without ``density`` all that aren't barred (of the marked regions, if there are any)."""
    length = np.array([len(x[0]) - 2 * x[2] for x in lines], float)
    region = np.array([x[3] for x in lines])
    if not density:
        return ok & (region > 0) if (ok & (region > 0)).any() else ok
    ratio = smooth(np.where(ok, np.log1p(np.maximum(length, 0) / np.maximum(1, [x[1] for x in lines])), 0))
    links = length < 0  # more than half of it is linked
    dense = (ratio >= threshold(ratio)) & ok & ~links
    if chosen := set(region[dense & (region > 0)].tolist()):
        # A marked region with dense lines is content, its heading and short paragraphs included, without its menus.
        beside = np.convolve(links & ok, np.ones(3))[1:-1]
        return np.isin(region, list(chosen)) & ok & ~(links & (beside >= 2) & (ratio < threshold(ratio)))
    where = np.flatnonzero(dense)
    if len(where):
        # A short paragraph or heading among dense lines belongs to them.
        near = np.arange(len(lines))
        before, after = np.maximum.accumulate(np.where(dense, near, -BETWEEN - 1)), np.minimum.accumulate(np.where(dense, near, len(lines) + BETWEEN)[::-1])[::-1]
        dense |= ok & ~links & (near - before <= BETWEEN) & (after - near <= BETWEEN)
    return dense


def extract(html: str, density: bool = True) -> str:
    """The page's main text."""
    parser = Lines()
    parser.feed(html)
    parser.close_page()
    lines = parser.lines
    if not lines:
        return ""
    ok = admitted(lines, parser.regions, parser.barred)
    if not ok.any():
        return ""
    return "\n".join(x[0] for x, keep in zip(lines, choose(lines, ok, density).tolist(), strict=True) if keep)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row: the id, the url, ``text`` and ``n_chars``."""
    kinds = dict(pages.dtypes)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            texts = [extract(raw.decode()) for raw in text_bytes(batch.column(2))]
            yield {id_col: batch.column(0), url_col: batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    return arrow_map(pages, [id_col, url_col, html_col], f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint", make)
