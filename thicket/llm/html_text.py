"""Main text of HTML pages: parser events, text-to-tag ratios, smoothing, clustering of content regions.

The standard library's parser is fed a page; its events make lines, one for each block, with the characters and the
tags of each. The logarithms of the ratios of characters to tags are smoothed by a Gaussian and split in two clusters by
a threshold that settles between the clusters' means. The lines of the upper cluster are content, and they select the
regions of the page that are its text:

* articles (or main) that hold content; a page's only article always;
* without those, the branches that hold content below the lowest container of all content. Lines that stand in that
  container itself count from the first content line to the last, with the title and the plain lines above them and the
  sentences below them, menus of links left out.

A region's short lines are its own, so a brief paragraph or list in it stays. Outside articles, runs of three or more
lines below the threshold that are links alone are menus and go. Headers, footers, asides, forms, scripts and what is
marked as an advert, notice, sidebar or reader comment are left out before; inside a line they leave no break. A name of
which only a part is such a mark (site-header), forms and nav are guesses: they are overruled where the element holds most
of the page's text and no article is elsewhere. Reader comments (comment-list, user-comments) are never overruled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser
from os.path import commonprefix
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._shared import unused, with_fields

SIGMA = 1.5
#: Articles inside main are its text if they hold this share of main's content.
NARROW = 0.7
#: So many lines of links in a row, below the threshold, are a menu.
MENU = 3
#: Pages whose smoothed logarithms differ by less than this (a factor of two) have one cluster.
ALIKE = 0.7

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
DROPPED = frozenset("aside audio button canvas datalist dialog footer head header iframe map menu noscript object script select style svg template textarea title video".split())
GUESSED = frozenset(["form", "nav"])
#: Of these, the ones that stand inside a line.
INLINE = frozenset("audio button canvas datalist iframe map noscript object script select style svg template textarea title video".split())
#: What begins a line of its own.
BREAKS = (BLOCKS | DROPPED | GUESSED) - INLINE
#: Their end tags end what is open inside, containers too.
OUTER = DROPPED | GUESSED | {"html", "table", "tr", "tbody", "ul", "ol", "dl"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Starting one of these ends an open element of the same line.
ENDS = {"p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "body": frozenset({"head"})}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in class or id that mark what isn't the article.
MARKS = frozenset(
    "ad ads adbox advert advertisement advertisements adverts advertising banner breadcrumb breadcrumbs byline-ad comment commentlist comments consent cookie cookies disqus footer gdpr header hidden login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification outbrain pager pagination paywall popup popover promo promoted promotion recommended related replies respond share sharing shoutbox sidebar signup skip skyscraper social sponsor sponsored "
    "sponsors subscribe subscription taboola teaser toolbar topbar widget widgets".split()
)
#: Of these, the ones of readers' comments, which an article of its own may be marked with; and words beside them that
#: say something of the page.
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
STATES = frozenset("allowed closed disabled enabled off on open".split())
#: Before a mark they say that the element is something else.
NEGATIONS = frozenset("has is no not with without".split())
_STOPS = ".!?:;\u2026\"')\u201d\u00bb"
_PARTS, _SPACE = re.compile(r"[^a-z0-9]+"), re.compile(r"\s+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

STAYS, GUESS, GOES = 0, 1, 2


def named_mark(name: str, marks: frozenset[str] = MARKS) -> int:
    """What a class or id says: GOES if it is a mark or its first or last part one of comments, GUESS if that part is
    another mark; STAYS if a negation is in it. Of marks of articles, parts are guesses."""
    if name in marks:
        return GOES
    parts = [p for p in _PARTS.split(name) if p]
    if len(parts) < 2 or not NEGATIONS.isdisjoint(parts):
        return STAYS
    ends = {parts[0], parts[-1]}
    if not COMMENTS.isdisjoint(ends) and marks is MARKS:
        return GOES if STATES.isdisjoint(parts) else STAYS
    return STAYS if marks.isdisjoint(ends) else GUESS


def boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """Whether an element GOES with all inside, STAYS, or GOES only if the page has its text elsewhere (GUESS)."""
    if tag in DROPPED:
        return GOES
    if tag in ("html", "body", "main") or not attrs:
        return GUESS if tag in GUESSED else STAYS
    out = GUESS if tag in GUESSED else STAYS
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id"):
            marks = COMMENTS if tag == "article" else MARKS
            out = max([out, *(named_mark(x, marks) for x in (value.split() if name == "class" else [value.strip()]))])
        hides = name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDES.search(value)
        if hides or name == "role" and value in ROLES:
            return GOES
    return out


class Line(NamedTuple):
    """A block's text, its number of tags, the containers and the guessed elements around it (outermost first), its level
    as a heading (0 for none), and how many of its characters are in links."""

    text: str
    tags: int
    chain: tuple[int, ...] = ()
    guesses: tuple[int, ...] = ()
    heading: int = 0
    links: int = 0


class _Lines(HTMLParser):
    """The lines of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.skipping = self.in_link = 0
        self.headings: list[int] = []
        self.pieces: list[tuple[str, tuple[int, ...]]] = []
        self.tags = self.linked = 0
        self.chain: tuple[int, ...] = ()
        self.guesses: tuple[int, ...] = ()
        self.n_guesses = 0
        self.kinds: list[str] = []
        self.lines: list[Line] = []

    def cut(self) -> None:
        if self.pieces:
            text = _SPACE.sub(" ", "".join(t for t, _ in self.pieces)).strip()
            if text:  # a guessed element inside a line counts if it is the whole line
                guesses = commonprefix([g for t, g in self.pieces if not t.isspace()])
                self.lines.append(Line(text, self.tags, self.chain, tuple(guesses), self.headings[0] if self.headings else 0, min(self.linked, len(text))))
            self.pieces = []
        self.tags = self.linked = 0

    def leave(self, at: int) -> None:
        """Ends the elements from position at of the open ones."""
        for tag, what in self.open[at:]:
            self.skipping -= what == GOES
            self.in_link -= tag == "a"
            if tag in HEADINGS:
                self.headings.pop()
            if what == GUESS:
                self.guesses = self.guesses[:-1]
            if tag in CONTAINERS and what != GOES:
                self.chain = self.chain[:-1]
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BREAKS:
            self.cut()
        if not self.skipping:
            self.tags += 1
        if tag in VOID:
            if tag == "br" and not self.skipping:
                self.pieces.append((" ", self.guesses))
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in ENDS.get(tag, ()):
                self.leave(i)
                break
            if self.open[i][0] in BLOCKS or self.open[i][1]:
                break
        if tag in ("article", "main"):  # no menu holds an article: its end tag is missing
            menu = next((i for i, (t, _) in enumerate(self.open) if t == "nav"), None)
            if menu is not None:
                self.leave(menu)
        what = boilerplate(tag, attrs)
        self.open.append((tag, what))
        self.in_link += tag == "a"
        if tag in HEADINGS:
            self.headings.append(1 if tag == "hgroup" else int(tag[1]))
        self.skipping += what == GOES
        if what == GUESS:
            self.guesses += (self.n_guesses,)
            self.n_guesses += 1
        if what != GOES and tag in CONTAINERS:
            self.kinds.append(tag if ("role", "main") not in attrs else "main")
            self.chain += (len(self.kinds) - 1,)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif not self.skipping:
            self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS:
            self.cut()
        for i in range(len(self.open) - 1, -1, -1):
            own = self.open[i][0]
            if own == tag:
                self.leave(i)
                break
            # An inline element doesn't reach out of its block, a block not out of its container.
            inline = tag not in BLOCKS and tag not in DROPPED and tag not in GUESSED
            if own in BLOCKS and inline or own in CONTAINERS and tag not in CONTAINERS and tag not in OUTER:
                break

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.pieces.append((data, self.guesses))
            if self.in_link:
                self.linked += len(data)


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """values under a Gaussian; at the ends, of what is there."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[reach : reach + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def ratios(lines: list[Line]) -> np.ndarray:
    return np.log1p([len(x.text) / max(1, x.tags) for x in lines])


def threshold(values: np.ndarray) -> float:
    """Halfway between the means of what is above and below it; less than all values if they are alike."""
    low, high = values.min(), values.max()
    if high - low < ALIKE:
        return float(low) - 1.0
    cut = (low + high) / 2
    for _ in range(50):
        up = values > cut
        new = (values[up].mean() + values[~up].mean()) / 2 if up.any() and not up.all() else cut
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return float(cut)


def clusters(lines: list[Line], sigma: float = SIGMA) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line is content, in the upper cluster of smoothed ratios; and whether it is so on its own. Regions are
    chosen by the latter, as a line beside a long one may be up for its neighbour's sake."""
    raw = ratios(lines)
    smooth = smoothed(raw, sigma)
    cut = threshold(smooth)
    content = smooth > cut
    firm = content & (raw > cut)
    return content, firm if firm.any() else content


def _overruled(lines: list[Line], kinds: list[str]) -> set[int]:
    """The guessed elements that hold most of the page's text, if no article or main stands outside guessed ones."""
    if any(not x.guesses and any(kinds[c] in ("article", "main") for c in x.chain) for x in lines):
        return set()
    mass: Counter[int] = Counter()
    for x in lines:
        for g in x.guesses:
            mass[g] += len(x.text)
    return {g for g, n in mass.items() if 2 * n > sum(len(x.text) for x in lines)}


def _articles(lines: list[Line], content: np.ndarray, kinds: list[str]) -> set[int]:
    """The articles, or main, that are the page's text; none if the page has none."""
    mass: Counter[int] = Counter()
    inner: dict[int, set[int]] = {}
    for x, good in zip(lines, content):
        marked = [c for c in x.chain if kinds[c] in ("article", "main")]
        if marked:
            inside = inner.setdefault(marked[0], set())
            for c in marked[:2]:
                mass[c] += len(x.text) * bool(good)
            if len(marked) > 1 and kinds[marked[1]] == "article":
                inside.add(marked[1])
    mains = [c for c in inner if kinds[c] == "main" and mass[c]]
    out = set()
    for c in mains or [c for c in inner if mass[c]] or inner:
        within = {a for a in inner[c] if mass[a]} if kinds[c] == "main" else set()
        out |= within if within and sum(mass[a] for a in within) >= NARROW * mass[c] else {c}
    return out


def _without_menus(lines: list[Line], content: np.ndarray, keep: np.ndarray, articles: set[int]) -> np.ndarray:
    """keep without runs of MENU or more lines outside these articles that are links alone and not content."""
    menu = np.array([bool(k) and not c and x.links >= len(x.text) and articles.isdisjoint(x.chain) for x, c, k in zip(lines, content, keep)], bool)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], menu, [0]))))
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a >= MENU:
            keep[a:b] = False
    return keep


def _branches(lines: list[Line], content: np.ndarray, firm: np.ndarray) -> np.ndarray:
    """Without articles: which lines belong to the regions around the content lines."""
    chains = [x.chain for x, good in zip(lines, firm) if good]
    depth = len(commonprefix(chains))
    around = chains[0][:depth]
    branch = [x.chain[depth] if len(x.chain) > depth else None for x in lines]
    good = {b for b, c in zip(branch, firm) if c and b is not None}
    inside = np.array([x.chain[:depth] == around for x in lines], bool)
    keep = inside & np.array([bool(c) if b is None else b in good for b, c in zip(branch, content)], bool)
    for order in (1, -1):
        for i in np.flatnonzero(keep)[::order]:
            if branch[i] is not None or firm[i] or lines[i].heading or lines[i].text[-1] in _STOPS:
                break
            keep[i] = False
    at = np.flatnonzero(keep)
    if not len(at):
        return keep
    first, last = int(at[0]), int(at[-1])
    plain = [inside[i] and branch[i] is None and 5 * x.links < 4 * len(x.text) for i, x in enumerate(lines)]
    for i in range(first, last):
        keep[i] |= plain[i]
    # Above: plain lines and headings up to the title. Below: sentences, and headings with sentences below them.
    while first and lines[first].heading != 1 and (plain[first - 1] or inside[first - 1] and lines[first - 1].heading and not lines[first - 1].links):
        first -= 1
        keep[first] = True
    for i in range(last + 1, len(lines)):
        if not plain[i] or not lines[i].heading and lines[i].text[-1] not in _STOPS:
            break
        last = i if not lines[i].heading else last
    keep[at[-1] : last + 1] |= np.array(plain[at[-1] : last + 1], bool)
    return keep


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The text of a page's article: a line for each block. Null and empty pages, and pages without text, have none."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.cut()
    lines = page.lines
    if page.n_guesses:
        stays = _overruled(lines, page.kinds)
        lines = [x for x in lines if stays.issuperset(x.guesses)]
    if not lines:
        return ""
    content, firm = clusters(lines, sigma)
    articles = _articles(lines, firm, page.kinds)
    if articles:
        keep = np.array([not articles.isdisjoint(x.chain) for x in lines], bool)
    else:
        keep = _branches(lines, content, firm)
    keep = _without_menus(lines, firm, keep, {c for c in articles if page.kinds[c] == "article"})
    return "\n".join(x.text for x, k in zip(lines, keep) if k)


def extract(pages: DataFrame, html_col: str = "html", sigma: float = SIGMA) -> DataFrame:
    """pages without html_col, with text (string, never null) and n_chars (long, its code points).

    Every page gives a row, repeated ones too; other columns pass through, those named text or n_chars are replaced.
    """
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = with_fields(pages.select(*kept), "text string, n_chars bigint")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                text = [main_text(x.as_py(), sigma) for x in part.column(len(kept))]
                cols = [*part.columns[: len(kept)], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return pages.select(*kept, F.col(html_col).cast("string").alias(unused("html", kept))).mapInArrow(run, schema)
