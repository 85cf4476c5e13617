"""Main text of HTML pages: text-to-tag ratios per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events. Block elements cut the page into lines; a line knows its text, its
number of tags, how much of it is links and its container (the enclosing article, main or other sectioning block). A
line's ratio is characters / tags; ratios are smoothed with a Gaussian over neighbouring lines, and lines at or above
the threshold (the standard deviation of the smoothed ratios) seed content, unless most of them is links.

Clusters grow from seeds to lines of low density:

- all lines of a seeded container belong to it, so a short paragraph does not fall out of its article;
- containers of the same element and class as a seeded one, and lines beside it under the same parent, join where they
  stand between seeds or next to them without anything else in between (below ``body`` only headings join as lines);
- in an article or main element whatever stands beside a seed joins. Where the page has such an element, only its
  lines compete.

What the mark-up itself declares to be no content (menus, headers, footers, asides, forms, scripts, styles, hidden
parts, by element or role, and comments, adverts and consent notices by class or id word) weighs nothing, though its
tags count. Other class words (sidebar, widget, share, ...) only lower a line's ratio to ``LOWERED`` of itself, and such
lines compete when they outweigh all others even so. A word after no-, has-, with- or the like says nothing, and
inside an article class words do not act on paragraphs, headings and list entries, unless the whole name is one of an advert or comment.

The result joins the lines' texts in page order by one line break; white space inside a line is one space and
character references are decoded. Nothing else is dropped or capped.

Defined results: a null, empty or text-free page has the empty text; unclosed and cut-off mark-up ends with the page;
a page without mark-up is its own text; repeated rows get equal results; an empty table gives an empty table;
other columns pass through, columns named ``text`` and ``n_chars`` are replaced. Pages are read one at a time, in one
pass without a shuffle; the work on a page grows with its length.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import unused

SIGMA = 1.0
RADIUS = 2
#: share of its ratio that a line keeps under a class word that hints at furniture
LOWERED = 0.1
# fixed values: elements of HTML by their part on a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset(
    "head nav header footer aside form script style noscript template iframe object svg canvas button select textarea "
    "dialog menu audio video title".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: class and id words of parts that are never content
NEVER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors breadcrumb breadcrumbs "
    "pagination cookie cookies consent gdpr comment comments disqus replies respond".split()
)
#: class and id words that only hint at it
HINT_WORDS = frozenset(
    "banner promo promos promotion nav navbar navigation menu menus pager toolbar header masthead topbar footer bottombar "
    "copyright sidebar sidebars aside widget widgets notice notices popup modal overlay newsletter subscribe subscription "
    "signup login related recommended share sharing social search skip".split()
)
MODIFIERS = frozenset("no not non without with has hide".split())
CONTENT = frozenset(("article", "main"))
SECTIONS = frozenset("article main section div td body".split())
RUNNING = HEADINGS | frozenset("p li dt dd blockquote pre figcaption tr td th".split())
WORD_CUTS = re.compile(r"[^a-z]+")


def words_of(names: str) -> set[str]:
    """The words of class names, without those that a modifier before them in the same name takes back."""
    found: set[str] = set()
    for name in names.split():
        for word in WORD_CUTS.split(name):
            if word in MODIFIERS:
                break
            found.add(word)
    return found


def is_furniture(tag: str, attrs: dict[str, str | None], content: bool) -> tuple[bool, bool]:
    """Whether the element is furniture, and whether its class words hint at it."""
    if tag in FURNITURE or (attrs.get("role") or "").lower() in FURNITURE_ROLES:
        return True, False
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
        return True, False
    if tag in ("html", "body"):
        return False, False
    classes = (attrs.get("class") or "").lower()
    if tag in CONTENT:
        return bool({"comment", "comments", "ad", "advert", "related"} & words_of(classes)), False
    names = f"{classes} {attrs.get('id') or ''}".lower()
    if content and tag in RUNNING:
        return not NEVER_WORDS.isdisjoint(names.split()), False
    words = words_of(names)
    hints = not HINT_WORDS.isdisjoint(words)
    return not NEVER_WORDS.isdisjoint(words) or (hints and tag not in BLOCKS), hints


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    container: int
    content: bool
    lowered: bool
    heading: bool

    @property
    def links(self) -> bool:
        return 2 * self.linked > len(self.text)


class Container(NamedTuple):
    parent: int
    tag: str
    classes: str


class State(NamedTuple):
    """What holds inside an open element."""

    tag: str = ""
    furniture: bool = False
    lowered: bool = False
    container: int = 0
    content: bool = False
    remarks: bool = False
    link: bool = False
    heading: bool = False


class Lines(HTMLParser):
    """Collects the lines and the tree of containers; container 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.containers = [Container(-1, "", "")]
        self.parts: list[str] = []
        self.tags = self.linked = self.low = 0
        self.open: list[State] = []
        self.now = State()

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            now = self.now
            self.lines.append(Line(text, self.tags, self.linked, now.container, now.content, 2 * self.low > len(text), now.heading))
        self.parts, self.tags, self.linked, self.low = [], 0, 0, 0

    def restore(self) -> None:
        self.now = self.open[-1] if self.open else State()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            while self.open and self.open[-1].tag in ("p", "b", "i", "em", "strong", "span", "a", "u", "font") and any(
                o.tag == "p" for o in self.open[-8:]
            ):
                self.open.pop()
            self.restore()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        named, now = dict(attrs), self.now
        classes = (named.get("class") or "").lower()
        remarks = now.remarks or "comment" in words_of(f"{classes} {named.get('id') or ''}".lower().replace("comments", "comment"))
        gone, lowered = now.furniture, now.lowered
        if tag in CONTENT and not now.content and not remarks:
            gone = lowered = False  # furniture that still stands open was never closed
        if tag in HEADINGS and now.content and any(o.tag == "header" for o in self.open):
            gone = False
        furniture, hints = is_furniture(tag, named, now.content)
        gone, lowered = gone or furniture, lowered or hints
        content = now.content or (tag in CONTENT and not gone)
        container = now.container
        if tag in SECTIONS and (tag in CONTENT or not content):
            self.containers.append(Container(container, tag, classes))
            container = len(self.containers) - 1
        self.now = State(tag, gone, lowered, container, content, remarks, now.link or tag == "a", now.heading or tag in HEADINGS)
        self.open.append(self.now)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break
            if self.open[k].tag in CONTENT and tag not in ("body", "html"):
                break  # a stray end tag does not close the article
        self.restore()

    def handle_data(self, data: str) -> None:
        if not self.now.furniture:
            self.parts.append(data)
            size = len(data.strip())
            self.linked += size * self.now.link
            self.low += size * self.now.lowered


def smooth(values: list[float], sigma: float = SIGMA, radius: int = RADIUS) -> list[float]:
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - radius), min(len(values), i + radius + 1)
        weights = kernel[lo - i + radius : hi - i + radius]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def competing_lines(lines: list[Line]) -> list[int]:
    """Places of the lines that may be content."""
    weight = sum(len(line.text) * (-LOWERED if line.lowered else 1) for line in lines)
    texts = [i for i, line in enumerate(lines) if line.text and (weight < 0 or not line.lowered)]
    inside = [i for i in texts if lines[i].content]
    return inside or texts


def seeds_of(lines: list[Line], competing: list[int], sigma: float, radius: int, level: float) -> list[int]:
    """Places of competing lines whose smoothed ratio reaches ``level`` standard deviations; one at least."""
    smoothed = smooth([len(x.text) * (LOWERED if x.lowered else 1) / max(1, x.tags) for x in lines], sigma, radius)
    mean = sum(smoothed) / len(smoothed)
    threshold = level * math.sqrt(sum((v - mean) ** 2 for v in smoothed) / len(smoothed))
    found = [i for i in competing if smoothed[i] >= threshold and not lines[i].links]
    return found or [max(competing, key=lambda i: (not lines[i].links, smoothed[i], i))]


def grown(lines: list[Line], containers: list[Container], competing: list[int], seeds: list[int]) -> list[int]:
    """Places of all lines of the seeds' clusters, in page order. Containers are numbered after their parents."""
    n = len(containers)
    seeded = [False] * n
    for i in seeds:
        seeded[lines[i].container] = True
    # sums over subtrees: first line, characters, linked ones, and whether a seed is below
    first, chars, linked, holds = [len(lines)] * n, [0] * n, [0] * n, seeded.copy()
    items: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # of a parent: (first line, child or -1, line or -1)
    allowed = set(competing)
    for i in competing:
        c = lines[i].container
        first[c] = min(first[c], i)
        chars[c] += len(lines[i].text)
        linked[c] += lines[i].linked
        items[c].append((i, -1, i))
    for c in range(n - 1, 0, -1):
        p = containers[c].parent
        first[p], chars[p], linked[p], holds[p] = min(first[p], first[c]), chars[p] + chars[c], linked[p] + linked[c], holds[p] or holds[c]
        if chars[c]:
            items[p].append((first[c], c, -1))
    # text that does not compete stands in the way of growth past it
    for i, line in enumerate(lines):
        if line.text and i not in allowed:
            items[line.container].append((i, -1, -1))
    taken, joined = set(), [False] * n
    for p in range(n):
        row = sorted(items.get(p, ()))
        held = [k for k, (_, c, _) in enumerate(row) if c >= 0 and holds[c]]
        if seeded[p]:
            taken.update(i for _, _, i in row if i >= 0)
        inside = containers[p].tag in CONTENT
        if not held and not (inside and seeded[p]):
            continue
        shapes = {containers[c][1:] for _, c, _ in row if c >= 0 and seeded[c]}

        def joins(k: int, between: bool, p=p, row=row, inside=inside, shapes=shapes) -> bool:
            _, c, i = row[k]
            if c < 0 and i < 0:
                return False
            if c >= 0:
                alike = containers[c].tag not in CONTENT and containers[c][1:] in shapes
                return holds[c] or (2 * linked[c] <= chars[c] and (inside or between or alike))
            return not lines[i].links and (inside or between or lines[i].heading or containers[p].tag not in ("", "body"))

        if inside:
            chosen = [k for k in range(len(row)) if joins(k, True)]
        else:
            chosen = [k for k in range(held[0], held[-1] + 1) if joins(k, True)]
            for ks in (range(held[0] - 1, -1, -1), range(held[-1] + 1, len(row))):
                for k in ks:
                    if not joins(k, False):
                        break
                    chosen.append(k)
        for k in chosen:
            _, c, i = row[k]
            if i >= 0:
                taken.add(i)
            elif not holds[c]:
                joined[c] = True
    for c in range(1, n):
        joined[c] = joined[c] or joined[containers[c].parent]
    return [i for i in competing if i in taken or joined[lines[i].container]]


def main_text(html: str | None, sigma: float = SIGMA, radius: int = RADIUS, level: float = 1.0) -> str:
    """The main text of one page."""
    if not html:
        return ""
    cut = html.rfind("<")
    if cut > html.rfind(">") and re.match(r"<[/!?a-zA-Z]", html[cut : cut + 2]):
        html = html[:cut]  # a tag that the page's end cuts off
    page = Lines()
    page.feed(html)
    page.close()
    page.end_line()
    competing = competing_lines(page.lines)
    if not competing:
        return ""
    seeds = seeds_of(page.lines, competing, sigma, radius, level)
    return "\n".join(page.lines[i].text for i in grown(page.lines, page.containers, competing, seeds))


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without the mark-up column, plus ``text`` and ``n_chars`` (code points)."""
    chosen = pages.drop("text", "n_chars") if html not in ("text", "n_chars") else pages
    rest = [c for c in chosen.columns if c not in (html, "text", "n_chars")]
    (source,) = unused(rest, "__html")
    chosen = chosen.select(*rest, F.col(html).cast("string").alias(source))
    schema = chosen.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names
            )

    return chosen.mapInArrow(run, schema)
