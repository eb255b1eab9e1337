"""HTML extraction: text-to-tag ratios of a page's lines, smoothed and clustered, choose its content region.

The standard library's parser streams events; block elements end lines. Scripts, styles, menus, sidebars and the like are
known by their element or role and give no line. Elements whose class or id says advert, comment, notice, footer and so on,
and forms, give none either, unless they hold most of the page's text: then the name is that of a wrapper.

Where a page marks its content as `article` or `main`, all lines in there are the text. Elsewhere each line's ratio is its
text length over the tags since the line before. The ratios are smoothed by a Gaussian; the threshold (mean of the smoothed
ratios less half their deviation) parts them into clusters of text and of boilerplate. The heaviest cluster's innermost
common element is the region; it widens to the element around it while what that adds is no list of links. All lines of
the region are kept, short ones too; if it is the whole body, those from the first line of the cluster to its last, with
the headings right before.

A null page counts as empty and gives an empty text; markup that no parser knows (marked sections, broken declarations, open
or crossed elements) is skipped up to its end; very long pages are taken whole; null, repeated ids and urls are passed on
row by row; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never content.
SILENT = frozenset(
    "aside button canvas datalist dialog footer head iframe menu nav noscript object option script select style svg "
    "template textarea title".split()
)
#: Words of a class or id that mark an element as no content: alone, or together with PLACES.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promoted related replies respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe toolbar widget".split()
)
PLACES = frozenset(
    "area article bar block bottom box center container content footer form global header inner item items left line links "
    "list main outer page panel post posts reader row section site slot text the top right under user widget wrap wrapper "
    "1 2 3 4 5 6 7 8 9".split()
)
COMMENTS = frozenset("comment comments disqus replies respond".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Elements that close an open one of the same kind.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
REGIONS = frozenset(("article", "main"))
PARTS = re.compile(r"[^\s_-]+")
#: A doctype may have declarations in brackets.
DOCTYPE = re.compile(r"<!doctype[^>\[]*\[.*?\]\s*>", re.IGNORECASE | re.DOTALL)
SIGMA = 1.5
KERNEL = [math.exp(-0.5 * (k / SIGMA) ** 2) for k in range(-4, 5)]
#: Share of a page's text from which on a marked element is a wrapper, and of links in what a region is not widened by.
WRAPPER, LINKS = 0.5, 0.5
KEPT, SOFT, HARD = 0, 1, 2


def _words(token: str) -> frozenset[str]:
    """Marks of a class or id, if all its other parts say no more than where it stands."""
    if token in MARKS:
        return frozenset((token,))
    parts = PARTS.findall(token)
    found = MARKS.intersection(parts)
    return found if found and all(x in MARKS or x in PLACES for x in parts) else frozenset()


def mark(tag: str, attrs: list[tuple[str, str | None]], within: bool) -> int:
    """KEPT, SOFT (no content unless it wraps the page) or HARD (no content); `within`: it stands in an article."""
    if tag in SILENT or tag == "header" and not within:
        return HARD
    if tag in ("html", "body"):
        return KEPT
    out = SOFT if tag == "form" else KEPT
    for name, value in attrs:
        if name == "hidden":
            out = max(out, SOFT)
        if not value or name not in ("class", "id", "role"):
            continue
        value = value.lower()
        if name == "role":
            out = max(out, SOFT if value in ROLES else KEPT)
            continue
        for token in value.split():
            found = _words(token)
            if within and (tag in HEADINGS or tag == "header"):
                found -= {"header", "banner"}
            if tag in REGIONS:
                # Readers' comments are often articles of their own.
                found &= COMMENTS
            if found:
                out = max(out, SOFT)
    return out


class Lines(HTMLParser):
    """Lines of one page: text, ratio, share of links and the element each stands in. Elements are numbered."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parents, self.kinds, self.marks = [-1], [""], [KEPT]
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, element, silent, within an article
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.tags, self.linked = 0, 0
        self.lines: list[tuple[str, float, float, int]] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, len(text) / max(1, self.tags), min(1.0, self.linked / len(text)), self.stack[-1][1]))
                self.tags = 0
            self.parts.clear()
            self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        top = self.stack[-1]
        if top[0] == tag and tag in SELF_CLOSING or top[0] == "p" and tag in BLOCK:
            self.pop()
        _, _, silent, within = self.stack[-1]
        marked = mark(tag, attrs, within)
        if marked or tag in BLOCK or tag == "a" or tag in self.open:
            self.parents.append(self.stack[-1][1])
            self.kinds.append(tag)
            self.marks.append(marked)
            self.stack.append((tag, len(self.parents) - 1, silent or marked == HARD, within or tag in REGIONS))
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if self.open.get(tag):
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def pop(self) -> None:
        tag = self.stack[-1][0]
        if tag in BLOCK:
            self.flush()
        self.stack.pop()
        self.open[tag] -= 1

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.open.get("a"):
                self.linked += len(data.strip())

    def parse_html_declaration(self, i: int) -> int:
        found = DOCTYPE.match(self.rawdata, i)
        return found.end() if found else super().parse_html_declaration(i)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """As in HTML, all of `<![` up to the next `>` is a comment."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else len(self.rawdata)


def _smoothed(ratios: list[float]) -> list[float]:
    far, out = len(KERNEL) // 2, []
    for k in range(len(ratios)):
        window = range(max(0, k - far), min(len(ratios), k + far + 1))
        weights = [KERNEL[j - k + far] for j in window]
        out.append(sum(w * ratios[j] for w, j in zip(weights, window, strict=True)) / sum(weights))
    return out


def _under(parents: list[int], flags: list[bool]) -> list[bool]:
    """Which elements are flagged or stand in one that is; parents come before their children."""
    out = list(flags)
    for k in range(1, len(parents)):
        out[k] = out[k] or out[parents[k]]
    return out


def _sums(page: Lines, values: list[float]) -> list[float]:
    """Of the lines' values, the sum in each element with all it holds."""
    out = [0.0] * len(page.parents)
    for (_, _, _, at), x in zip(page.lines, values, strict=True):
        out[at] += x
    for k in range(len(out) - 1, 0, -1):
        out[page.parents[k]] += out[k]
    return out


def _region(page: Lines) -> list[bool]:
    """Which lines of a page without article or main are its text, by clusters of smoothed ratios."""
    lines, parents = page.lines, page.parents
    smooth = _smoothed([r for _, r, _, _ in lines])
    mean = sum(smooth) / len(smooth)
    threshold = mean - 0.5 * math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    clusters, start = [], None
    for k, s in enumerate([*smooth, -math.inf]):
        if s >= threshold and start is None:
            start = k
        elif s < threshold and start is not None:
            clusters.append((sum(len(lines[j][0]) * (1 - lines[j][2]) for j in range(start, k)), -start, k))
            start = None
    _, first, end = max(clusters)
    first = -first
    # Lines of links at the ends of the cluster are there because of their neighbours.
    while end - first > 1 and lines[first][2] > LINKS:
        first += 1
    while end - first > 1 and lines[end - 1][2] > LINKS:
        end -= 1
    held = _sums(page, [1.0 if first <= k < end else 0.0 for k in range(len(lines))])
    region = 0
    for k in range(1, len(parents)):
        if parents[k] == region and held[k] == end - first and page.kinds[k] not in SELF_CLOSING:
            region = k
    size, links = _sums(page, [float(len(t)) for t, _, _, _ in lines]), _sums(page, [len(t) * x for t, _, x, _ in lines])
    while region and page.kinds[parents[region]] not in ("", "html"):
        around = parents[region]
        more, linked = size[around] - size[region], links[around] - links[region]
        if linked > LINKS * more or more > size[region]:
            break
        region = around
    if page.kinds[region] in ("", "html", "body") and links[region] > 0:
        while first and page.kinds[lines[first - 1][3]] in HEADINGS:
            first -= 1
        return [first <= k < end for k in range(len(lines))]
    inside = _under(parents, [k == region for k in range(len(parents))])
    return [inside[at] for _, _, _, at in lines]


def content(html: str) -> str:
    """The main text of a page: its lines joined by newlines."""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    if not page.lines:
        return ""
    size = _sums(page, [float(len(t)) for t, _, _, _ in page.lines])
    noise = [m == SOFT and s <= WRAPPER * size[0] for m, s in zip(page.marks, size, strict=True)]
    # Comments are none of the article even where they are longer than it.
    region = _under(page.parents, [k in REGIONS for k in page.kinds])
    noise = [n or m == SOFT and inside for n, m, inside in zip(noise, page.marks, [False, *(region[p] for p in page.parents[1:])], strict=True)]
    noise = _under(page.parents, noise)
    page.lines = [x for x in page.lines if not noise[x[3]]]
    if not page.lines:
        return ""
    if any(region[x[3]] for x in page.lines):
        chosen = [region[x[3]] for x in page.lines]
    else:
        chosen = _region(page)
    return "\n".join(x[0] for x, c in zip(page.lines, chosen, strict=True) if c)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                own = batch.slice(k, 256)
                found = [content(h) for h in own.column(2).to_pylist()]
                lengths = pa.array([len(t) for t in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(found, pa.string()), lengths], ["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(html_col, F.lit("")).alias("html"),
    )
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
