"""Main text of web pages: streaming parser events, text-to-tag ratios by line, Gaussian smoothing and threshold clustering.

Each block of a page is a line. Its ratio is the length of its own text outside links to the number of its tags; lines inside
menus, adverts and the like have none. Marks of these count as whole class tokens, ids or roles, never on headings, and hide nothing that holds an
article or main, or, on pages without these, most of the page's text in several lines. The logarithms of the ratios are smoothed along the page and clustered in two by a threshold; runs of
lines above it are the page's content regions. The container (div, section, table cell and the like) that the regions lie in is the article, and
all its lines are text: from the page down, a container is entered while it has most of all the content, and what it leaves out is
another region or stands in other boxes. Links alone before the content are no text of it, nor are they after it where the page itself is the container. Where most of the content lies in article or main elements, the text is cut to those that hold some,
and these are whole. A title before the container (h1 or h2), with paragraphs alone between, belongs to it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th".split())
SECTIONS = frozenset(("article", "main"))
#: Elements whose text is never a page's main text.
OUTSIDE = frozenset("nav footer aside script style noscript template head title iframe svg canvas button select textarea dialog menu object audio video".split())
#: Words in class, id or role that mark such text; a form is marked without.
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert gdpr sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply replies share sharing social related recommended newsletter subscribe signup popup modal overlay widget pagination pager search login toolbar masthead contentinfo complementary".split())
#: Of these, words that an article's own parts may have as well: in a section they hide an element of few words or of links, not one of OWN or more characters of its own.
WEAK, OWN = frozenset("related recommended search share sharing social toolbar widget".split()), 80
#: Start tags that end an open element: tag -> (what it ends, within what).
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_LIMITS = frozenset("table td th caption button object html body template".split())
IMPLIED = {t: (frozenset(("p",)), _LIMITS) for t in _ENDS_P} | {
    "li": (frozenset(("li",)), _LIMITS | {"ul", "ol", "menu", "dir"}), "dt": (frozenset(("dt", "dd")), _LIMITS | {"dl"}), "dd": (frozenset(("dt", "dd")), _LIMITS | {"dl"}),
    "option": (frozenset(("option",)), _LIMITS | {"select", "datalist"}), "tr": (frozenset(("tr", "td", "th", "p")), frozenset(("table",))), "td": (frozenset(("td", "th", "p")), frozenset(("tr", "table"))), "th": (frozenset(("td", "th", "p")), frozenset(("tr", "table"))),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORDS = re.compile(r"[a-z]+")

#: Elements that can hold an article, and those whose text is a paragraph of one.
CONTAINERS = frozenset("html body div section article main center td form fieldset".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd figcaption caption".split())

#: Width of the smoothing; share of the highest value above which all is content; share of the content that a container must have.
SIGMA, SHARE, HOLD = 1.5, 0.5, 0.75


def marked(name: str, value: str | None, marks: frozenset[str] = MARKS) -> bool:
    """Whether one token of a class, id or role consists of marks only: 'ad', 'cookie-notice', not 'has-sidebar'."""
    return name in ("class", "id", "role") and bool(value) and any((w := WORDS.findall(t)) and marks.issuperset(w) for t in value.lower().split())


class LineParser(HTMLParser):
    """Collects a page's lines while the parser's events stream by."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, float, int, bool, int, int]] = []  # text, ratio, section or 0, whether outside for sure, innermost marked element or -1, innermost element
        self.open: list[tuple[str, int, bool, int, int]] = []  # tag, and the last four for text in it
        self.elements: list[tuple[int, str]] = [(0, "html")]  # the element around each, and its tag; the first is the page
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # places in `open` of each tag
        self.above: list[int] = []  # of each marked element: the marked element around it, or -1
        self.weak: list[bool] = []  # of each marked element: whether its marks are weak, and it is in a section
        self.silent = 0  # open elements within a line whose text is not read
        self.tops: list[int] = []  # of each section in no other: the innermost marked element around it, or -1
        self.parts: list[str] = []
        self.tags, self.linked, self.links, self.numbers = 0, 0, 0, 0

    def _within(self) -> tuple[int, bool, int, int]:
        return self.open[-1][1:] if self.open else (0, False, -1, 0)

    def _ratio(self, text: str) -> float:
        """Characters of a line outside links to its tags."""
        return max(0, len(text) - self.linked) / max(1, self.tags)

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self._ratio(text), *self._within()))
        self.parts.clear()
        self.tags, self.linked = 0, 0

    def _pop(self, at: int) -> None:
        """Closes the open elements from place `at` on."""
        while len(self.open) > at and self.silent:
            self.at[self.open.pop()[0]].pop()
            self.silent -= 1
        if len(self.open) > at:
            self._end_line()
        while len(self.open) > at:
            self.at[self.open.pop()[0]].pop()

    def _hush(self, tag: str) -> None:
        """Opens an element whose text is not read; the line around it goes on."""
        self.silent += 1
        self.at[tag].append(len(self.open))
        self.open.append((tag, *self._within()))

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag not in VOID:
                self._hush(tag)
            return
        if tag in BLOCKS:
            self._end_line()
        if tag in IMPLIED:
            last = lambda tags: max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)
            ends, limits = IMPLIED[tag]
            if (inner := last(ends)) > last(limits):
                self._pop(min(self.at[t][-1] for t in ends if self.at.get(t) and self.at[t][-1] > last(limits)) if tag in ("td", "th", "tr") else inner)
        self.tags += 1
        if tag in SPACED:
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        section, outside, mark, element = self._within()
        apart = tag in OUTSIDE or (tag == "header" and not section)
        soft, weak = tag == "form", False
        if not apart and attrs and tag not in ("html", "body", "article", "main"):
            for name, value in attrs:
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
                    apart = True
                elif marked(name, value) and not (name == "id" and tag in HEADINGS):
                    weak = bool(section) and not marked(name, value, MARKS - WEAK) and (weak or not soft)
                    soft = True
        elif not apart and tag == "article":
            apart = any(n in ("class", "id") and v and not {"comment", "comments", "reply", "ad", "sponsored"}.isdisjoint(v.lower().split()) for n, v in attrs)
        if apart and tag not in BLOCKS:
            self._hush(tag)
        elif tag in BLOCKS or soft:
            if tag not in BLOCKS:
                self._end_line()
            if tag in SECTIONS:
                if not section and not apart and not outside:
                    self.tops.append(mark)
                self.numbers += 1
                section = self.numbers
            if soft:
                self.above.append(mark)
                self.weak.append(weak)
                mark = len(self.above) - 1
            self.at[tag].append(len(self.open))
            self.elements.append((element, tag))
            self.open.append((tag, section, apart or outside, mark, len(self.elements) - 1))

    def handle_startendtag(self, tag, attrs):
        if self.silent:
            return
        if tag in BLOCKS:
            self._end_line()
        elif tag in SPACED:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.silent and not (self.at.get(tag) and self.open[self.at[tag][-1]][0] == tag):
            return
        if tag == "a" and not self.silent:
            self.links = max(0, self.links - 1)
        if tag in SPACED:
            self.parts.append(" ")
        self.tags += 1
        if not self.at.get(tag):  # not open
            if tag in BLOCKS:
                self._end_line()
            return
        self._pop(self.at[tag][-1])

    def handle_data(self, data):
        if self.silent:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def read(self, html: str) -> None:
        """The whole page. Text after an unfinished tag is read on from the next '>'; an unfinished comment reaches to the end, as in browsers.

        A tag is unfinished only if a quote that it opens is closed nowhere after it, or if no '>' follows: so there are a few at most (one for either quote), and reading takes linear time.
        """
        self.feed(html)
        while self.rawdata and not self.rawdata.startswith("<!--"):
            rest, self.rawdata = self.rawdata, ""
            if self.cdata_elem or not rest.startswith("<"):
                self.handle_data(rest if self.cdata_elem else unescape(rest))
                break
            self.feed(rest[rest.find(">") + 1 :] if ">" in rest else "")
        self._end_line()

    def hidden(self) -> list[bool]:
        """Whether each line is outside. A mark hides nothing if it holds a section where none is free of marks, or, without sections, more than half of the text in several lines; a weak one hides no text that is mostly not links."""
        held, held_lines, own = ([0] * len(self.above) for _ in range(3))
        for text, ratio, _, outside, mark, _ in self.lines:
            if mark >= 0 and not outside:
                held[mark] += len(text)
                held_lines[mark] += 1
                own[mark] += len(text) if ratio else 0
        for i in reversed(range(len(held))):
            if self.above[i] >= 0:
                held[self.above[i]] += held[i]
                held_lines[self.above[i]] += held_lines[i]
                own[self.above[i]] += own[i]
        half = sum(len(x[0]) for x in self.lines if not x[3]) / 2
        shown = [not self.tops and n > half and k > 1 or w and o >= OWN and 2 * o > n for n, k, w, o in zip(held, held_lines, self.weak, own)]
        if -1 not in self.tops:
            seen: set[int] = set()
            for i in set(self.tops):
                while i >= 0 and i not in seen:
                    seen.add(i)
                    shown[i] = True
                    i = self.above[i]
        hides: list[bool] = []
        for i, up in enumerate(self.above):
            hides.append(not shown[i] or (up >= 0 and hides[up]))
        return [outside or (mark >= 0 and hides[mark]) for _, _, _, outside, mark, _ in self.lines]


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian mean along the lines; the kernel is cut at three sigma and weighed anew at the ends."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(values, kernel, "full")[reach : reach + len(values)] / np.convolve(np.ones(len(values)), kernel, "full")[reach : reach + len(values)]


def threshold(values: np.ndarray) -> float:
    """The middle between the means of two clusters, found from the extremes on; SHARE of the highest value at most."""
    cut = (values.min() + values.max()) / 2
    for _ in range(32):
        low, high = values[values < cut], values[values >= cut]
        new = (low.mean() + high.mean()) / 2 if len(low) else cut
        if new == cut:
            break
        cut = new
    return min(cut, SHARE * values.max())


def container(places: list[int], elements: list[tuple[int, str]], weights: list[int], runs: list[int]) -> int:
    """The element that holds the article.

    places: the innermost element of each content line; runs: the region it is in (they don't fall). A container is entered if it has HOLD of all the
    content, and what it leaves out of the one around is in no region with lines inside, or is neither a paragraph nor text of the one around itself. Lines of an
    element follow each other, so one walk down looks at each line once.
    """
    held, first, last, best = [0] * len(elements), [len(places)] * len(elements), [-1] * len(elements), [0] * len(elements)
    for i, (at, weight) in enumerate(zip(places, weights, strict=True)):
        held[at] += weight
        first[at], last[at] = min(first[at], i), i
    for at in range(len(elements) - 1, 0, -1):
        up = elements[at][0]
        held[up] += held[at]
        first[up], last[up] = min(first[up], first[at]), max(last[up], last[at])
        if held[at] and (not best[up] or held[at] >= held[best[up]]):
            best[up] = at
    top = 0
    while (inner := best[top]) and elements[inner][1] in CONTAINERS and held[inner] >= HOLD * held[0]:
        left = [i for i in range(first[top], first[inner]) if runs[i] == runs[first[inner]]] + [i for i in range(last[inner] + 1, last[top] + 1) if runs[i] == runs[last[inner]]]
        if any(places[i] == top or elements[places[i]][1] in PARAGRAPHS for i in left):
            break
        top = inner
    return top


def titled(lines: list[tuple], elements: list[tuple[int, str]], before: list[int]) -> list[int]:
    """Of the lines `before` a container those from the page's title on, if only paragraphs with text of their own lie between."""
    out: list[int] = []
    for k in reversed(range(len(before))):
        text, ratio, *_, element = lines[before[k]]
        tag = elements[element][1]
        if tag not in PARAGRAPHS or tag == "li" or not ratio:
            break
        if tag in ("h1", "h2"):
            out = before[k:]
    return out


def main_text(html: str | None) -> str:
    """The lines of a page's content regions, joined by newlines; '' for a null, empty or textless page."""
    if not html:
        return ""
    parser = LineParser()
    parser.read(html)
    lines, free = parser.lines, [not h for h in parser.hidden()]
    ratios = np.array([x[1] if f else 0.0 for x, f in zip(lines, free)])
    chosen = np.array(free, bool)
    sections = np.array([x[2] for x in lines])
    if ratios.any():
        curve = smoothed(np.log1p(ratios))
        content = (ratios > 0) & (curve >= threshold(curve[chosen]))
        at = np.flatnonzero(content)
        before = np.cumsum(chosen & ~content)[at]  # lines of the same region have as many other lines before them
        weights = [len(lines[i][0]) for i in at]
        top = container([lines[i][5] for i in at], parser.elements, weights, before.tolist())
        up = top
        while up and parser.elements[up][1] not in SECTIONS:
            up = parser.elements[up][0]
        top = up or top  # the whole of a section around it
        around = [True] * len(parser.elements)
        for i, (up, _) in enumerate(parser.elements):
            around[i] = i == top or (i > 0 and around[up])
        free_lines = np.flatnonzero(chosen).tolist()
        chosen &= np.array([around[x[5]] for x in lines])
        if not up:
            for i in titled(lines, parser.elements, [i for i in free_lines if i < chosen.argmax()]):
                chosen[i] = True
        if 2 * sum(w for i, w in zip(at, weights) if sections[i]) >= sum(weights):
            chosen &= np.isin(sections, [s for s in sections[content & chosen].tolist() if s])
        else:
            ends = np.flatnonzero(content & chosen)[[0, -1]]
            own = parser.elements[top][1] not in ("html", "body")  # lists of links at the end of a container of its own are the article's
            for i in np.flatnonzero(chosen & (ratios == 0)).tolist():
                tag = parser.elements[lines[i][5]][1]
                chosen[i] = ends[0] < i < ends[1] or (tag in PARAGRAPHS and tag != "li") or (tag == "li" and own and i > ends[1])
    elif sections.any():
        chosen &= sections > 0
    return "\n".join(x[0] for x, c in zip(lines, chosen.tolist()) if c)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of `pages`. Pages of any length and markup, broken or not, are read whole and once.

    A null html counts as empty and gives an empty text; a null url stays null; repeated rows each give a row;
    other columns aren't read. Rows are independent: no shuffle.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return common.per_batch(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), "page_id long, url string, text string, n_chars long", work)
