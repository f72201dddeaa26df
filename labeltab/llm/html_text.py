"""Operator 7: main text of a web page by tag-path ratios.

A page is read into blocks: runs of inline content inside one block element, each with its tag path
from the root and whether it stands in boilerplate markup. For every path, text length (without link
text) and punctuation are totalled over its blocks; their ratios to the number of blocks are fused, spread over
the page and smoothed along the block sequence, and paths whose smoothed mean reaches the threshold (the lesser of
the deviation and half the mean) hold content. The smallest element that has all the selected nodes, or the article
or main element around it, is the article; its blocks, headings and short ones included, are the text.

Dropped wherever they stand: scripts, styles and other elements that show no text, comments, menus,
headers, footers, sidebars, forms and elements with a class, id or role made up of words for a notice, an advert,
or reader comments; that includes the header and footer of an article. If it also has other words (related-work), or only words that name subjects as well (copyright),
the element is dropped if its fused ratio is below a quarter of that of the page's unmarked text. A token that tells a state
(no-sidebar, comment-open) says nothing, nor do those of a heading. A form or an element with such words that has most of the page's
unlinked text stays, so a form around the whole page hides nothing. Character references are decoded, white space inside a block becomes
one space, blocks are joined by an empty line.

Null and empty pages give an empty text. A page is read in time and memory in proportion to its length, however deep or broken its
markup; ``<`` without an end is text. Rows are processed one by one, so repeated rows give repeated results and an empty table
none; further columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role, and words in class or id that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
SILENT = frozenset("head script style noscript template svg math iframe object canvas audio video map select textarea "
                   "button datalist dialog title".split())
BOILERPLATE = frozenset("nav header footer aside menu".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot "
                  "th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd blockquote pre ul ol dl table thead tbody tfoot tr caption".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
                  "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments "
                  "disqus respond replies reply sidebar sidebars menu menus navbar navigation nav breadcrumb breadcrumbs footer header "
                  "masthead share sharing social related recommended widget toolbar pagination pager copyright skip".split())
TOPICS = frozenset("copyright social related skip notice notices alert share sharing menu menus banner promotion advertising "
                   "subscription navigation modal widget header login signup respond reply toolbar pager pagination".split())
STATE_FIRST = frozenset("no not non has have is with without hide".split())
STATE_LAST = frozenset("none off on open closed enabled disabled".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNMARKED = HEADINGS | frozenset("html body article main".split())
LOW_RATIO = 0.25
CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
             "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]),
         "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "option": frozenset(["select"])}

OPEN = re.compile(r"<(?=[!?/A-Za-z])")
NAME = re.compile(r"<(/?)([A-Za-z][^\s/><]*)")
DELIMITER = re.compile(r"""[>"']""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Za-z]+")
HIDDEN = re.compile(r"""\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PUNCTUATION = re.compile(r"""[.,;:!?、。，！？]""")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True, eq=False)
class Element:
    tag: str
    path: int  # number of its tag path
    number: int  # in page order; those below an element follow it
    depth: int
    parent: Element | None
    dropped: bool
    link: bool
    holder: Element | None = None  # nearest block element, itself included
    mark: int = 0
    marked: Element | None = None  # nearest marked element, itself included
    last: int = 1 << 60  # greatest number below it

    def above(self, other: Element) -> bool:
        """Whether ``other`` is this element or below it."""
        return self.number <= other.number <= self.last


@dataclass(slots=True)
class Block:
    element: Element
    text: str
    linked: int = 0


class Tags:
    """Tags of a page from left to right. A tag ends at the first ``>`` outside quotes; ``<`` without such an end is text.
    Delimiters that a search without success has passed outside quotes are remembered, since no later search through one of them
    can succeed: reading takes time in proportion to the page."""

    def __init__(self, page: str) -> None:
        self.page, self.dead = page, set()
        self.seen, self.next = 0, -1  # no delimiter from seen up to next

    def _delimiter(self, at: int) -> int:
        if not self.seen <= at <= self.next:
            m = DELIMITER.search(self.page, at)
            self.seen, self.next = at, m.start() if m else len(self.page)
        return self.next

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag read from ``at`` on, -1 without one."""
        page, passed = self.page, []
        at = self._delimiter(at)
        while at < len(page) and at not in self.dead:
            if page[at] == ">":
                return at
            passed.append(at)
            close = page.find(page[at], at + 1)
            if close < 0:
                break
            m = DELIMITER.search(page, close + 1)
            at = m.start() if m else len(page)
        self.dead.update(passed)
        return -1

    def next_tag(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, closing, name in lower case or empty, attributes) of the first tag from ``at`` on."""
        page = self.page
        while (m := OPEN.search(page, at)) is not None:
            start = m.start()
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, "", ""
            if page[start + 1] in "!?":
                end = page.find(">", start) if self.next < len(page) or self.seen > start else -1
                if end >= 0:
                    return start, end + 1, False, "", ""
                self.seen, self.next = min(start, self.seen), len(page)  # no tag ends from here on
            elif (name := NAME.match(page, start)) is not None and (end := self._end(name.end())) >= 0:
                return start, end + 1, bool(name[1]), name[2].lower(), page[name.end(): end]
            at = start + 1
        return None


@dataclass(frozen=True)
class Params:
    kernel: tuple[float, ...] = (1.0, 2.0, 4.0, 2.0, 1.0)
    marks: frozenset = field(default=MARKS)


def boilerplate(tag: str, attributes: str) -> bool:
    return tag in SILENT or tag in BOILERPLATE or bool(attributes and HIDDEN.search(attributes))


def mark_of(tag: str, attributes: str, marks: frozenset) -> int:
    """2: a token of class, id or role names boilerplate, or it is a form; 1: it may; 0: none does."""
    if tag == "form":
        return 2
    if not attributes or tag in UNMARKED:
        return 0
    mark = 0
    for m in NAMES.finditer(attributes):
        for token in CAMEL.sub("-", m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in WORD.findall(token)]
            own = [w for w in words if w in marks]
            if own and words[0] not in STATE_FIRST and words[-1] not in STATE_LAST:
                mark = max(mark, 2 if len(own) == len(words) and not TOPICS.issuperset(own) else 1)
    return mark


def fused(length: int, marks: int, n: int) -> float:
    return (length / n) * (1.0 + marks / n)


def judged(raw: list[tuple[Element, list[tuple[str, Element]]]]) -> dict[int, bool]:
    """Whether the text in each marked element goes, by number. Headings have no part in the ratios. Texts count at their
    nearest marked element first and are then passed on to the marked elements around it, inner ones first."""
    size: dict[int, int] = {}  # text without links
    total: dict[int, list[int]] = {0: [0, 0, 0]}  # the same outside headings, punctuation, blocks; 0: unmarked text
    found: dict[int, Element] = {}
    whole = 0
    for holder, pieces in raw:
        body, before, unmarked = holder.tag not in HEADINGS, None, 0
        for text, e in pieces:
            text = text.strip()
            if not text:
                continue
            length, points = (0, 0) if e.link else (len(text), len(PUNCTUATION.findall(text)))
            whole += length
            m = e.marked
            number = m.number if m is not None else 0
            size[number] = size.get(number, 0) + length
            while m is not None and m.number not in found:
                found[m.number] = m
                m = m.parent.marked
            if body:
                t = total.setdefault(number, [0, 0, 0])
                t[0] += length
                t[1] += points
                m = e.marked
                if m is None:
                    t[2] += not unmarked
                    unmarked = 1
                elif m is not before:
                    t[2] += 1  # the block counts once in each element around its pieces: less one where two pieces meet
                    both = before
                    while both is not None and not both.above(m):
                        both = both.parent.marked
                    if both is not None:
                        total.setdefault(both.number, [0, 0, 0])[2] -= 1
                    before = m
    for number in sorted(found, reverse=True):
        up = found[number].parent.marked
        if up is not None:
            size[up.number] = size.get(up.number, 0) + size.get(number, 0)
            if number in total:
                t = total.setdefault(up.number, [0, 0, 0])
                for k in range(3):
                    t[k] += total[number][k]
    low = fused(*total[0]) * LOW_RATIO if total[0][2] else 0.0
    gone: dict[int, bool] = {}
    for number in sorted(found):
        e, up = found[number], found[number].parent.marked
        few = number in total and total[number][2] > 0 and fused(*total[number]) < low
        gone[number] = up is not None and gone[up.number] or 2 * size.get(number, 0) <= whole and (e.mark == 2 or few)
    return gone


def blocks(page: str, marks: frozenset = MARKS) -> list[Block]:
    """Blocks with text, in page order; those in boilerplate are left out."""
    root = Element("", 0, 0, 0, None, False, False)
    stack, raw, at, count = [root], [], 0, 0
    opened: dict[str, list[int]] = {}  # depths of the open elements of each name
    paths: dict[tuple[int, str], int] = {}
    pieces: list[tuple[str, Element]] = []
    owner = root
    tags, endless = Tags(page), set()

    def flush() -> None:
        nonlocal pieces
        if pieces:
            raw.append((owner, pieces))
            pieces = []

    def add(source: str) -> None:
        nonlocal owner
        top = stack[-1]
        if source and not top.dropped:
            text = html.unescape(source) if "&" in source else source
            if not pieces:
                owner = top.holder or root
            pieces.append((text, top))

    def close(depth: int) -> None:
        holder = stack[-1].holder
        if holder is not None and holder.depth >= depth:
            flush()
        for e in stack[depth:]:
            e.last = count
            opened[e.tag].pop()
        del stack[depth:]

    def nearest(names: frozenset) -> int:
        return max((opened[x][-1] for x in names if opened.get(x)), default=0)

    n = len(page)
    while at < n:
        m = tags.next_tag(at)
        if m is None:
            add(page[at:])
            break
        start, end, closing, tag, attributes = m
        add(page[at: start])
        at = end
        if not tag:
            continue
        if closing:
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        if tag in ("br", "wbr", "hr"):
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        holder = stack[-1].holder
        if tag in CLOSES_P and holder is not None and holder.tag == "p":
            close(holder.depth)
        if tag in CLOSED_BY:
            depth = nearest(CLOSED_BY[tag])
            if depth > nearest(SCOPE[tag]):
                close(depth)
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if attributes.endswith("/") and tag in ("svg", "path"):
            continue
        count += 1
        top = stack[-1]
        own = Element(tag, paths.setdefault((top.path, tag), len(paths) + 1) if tag in BLOCK else top.path, count, len(stack), top,
                      top.dropped or boilerplate(tag, attributes), top.link or tag == "a", top.holder, mark_of(tag, attributes, marks))
        if tag in BLOCK:
            own.holder = own
        own.marked = own if own.mark else top.marked
        opened.setdefault(tag, []).append(own.depth)
        stack.append(own)
        if tag in RAW:
            stop = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if stop is None:
                endless.add(tag)
                at = n if tag in ("script", "style") else at
            else:
                if tag not in ("script", "style"):
                    add(page[at: stop.start()])
                at = stop.start()
    flush()
    for e in stack:
        e.last = count
    gone = judged(raw) if any(e.marked is not None for _, x in raw for _, e in x) else {}

    out = []
    for holder, x in raw:
        kept = [(text, e) for text, e in x if e.marked is None or not gone.get(e.marked.number)] if gone else x
        text = " ".join("".join(t for t, _ in kept).split())
        if text:
            out.append(Block(holder, text, min(sum(len(t.strip()) for t, e in kept if e.link), len(text))))
    return out


def path_scores(found: list[Block], kernel: tuple[float, ...]) -> dict[int, float]:
    """Smoothed, fused text and punctuation ratio of each tag path."""
    total: dict[int, list[float]] = {}
    for b in found:
        t = total.setdefault(b.element.path, [0, 0, 0])
        t[0] += len(b.text) - b.linked
        t[1] += len(PUNCTUATION.findall(b.text)) if b.linked < len(b.text) else 0
        t[2] += 1
    ratio = {k: fused(*t) for k, t in total.items()}
    along = np.array([ratio[b.element.path] for b in found])
    half = len(kernel) // 2
    weights = np.array(kernel)
    smooth = np.convolve(along, weights)[half: half + len(along)] / np.convolve(np.ones(len(along)), weights)[half: half + len(along)]
    sums: dict[int, list[float]] = {}
    for b, x in zip(found, smooth):
        s = sums.setdefault(b.element.path, [0.0, 0])
        s[0] += float(x)
        s[1] += 1
    return {k: s / n for k, (s, n) in sums.items()}


def main_text(page: str | None, p: Params = Params()) -> str:
    found = blocks(page or "", p.marks)
    if not found:
        return ""
    scores = path_scores(found, p.kernel)
    each = np.array([scores[b.element.path] for b in found])
    bar = min(float(each.std()), float(each.mean()) / 2)
    selected = [b.element for b, x in zip(found, each) if x >= bar and len(b.text) > b.linked]
    # the lowest element around all selected text; a lone block, list or table counts as its parent's content
    top = min(selected, key=lambda e: e.number, default=found[0].element)
    far = max((e.number for e in selected), default=0)
    while top.parent is not None and (top.last < far or not selected):
        top = top.parent
    while top.parent is not None and top.tag in LEAVES:
        top = top.parent
    around: dict[str, Element] = {}
    e: Element | None = top
    while e is not None:
        around[e.tag] = e  # the outermost of each name
        e = e.parent
    top = around.get("article") or around.get("main") or top
    return "\n\n".join(b.text for b in found if top.above(b.element))


def extract(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # keeps the Python strings of a step small
                part = batch.slice(at, 256)
                text = [main_text(x.as_py(), p) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
            .mapInArrow(run, "page_id long, url string, text string, n_chars long"))
