"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by its container where the markup tells (menus,
asides, forms, comments against an article), else by its own link density, length and stop-word density; short and middling
blocks stay open, and so do those of an article that are mostly links, but for its headings. The second pass gives an open block
the label of its nearest decided neighbours, within the article if there is one.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barweave.llm.common import map_batches

#: Common words of four languages.
STOP_WORDS = frozenset(
    """the of and to a in is it that for on are as with his they at be this from or had by not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two him see no way could my than first been who its now did get
    de la le et les des en un une du que est pour qui dans par plus ce il sur pas au avec se sont son ne ou mais comme sa nous tout elle aux été cette ses être leur à fait même ont
    der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man
    el los y del se las por con no su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque""".split()
)

BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article aside blockquote center dd details dialog div dl fieldset figure footer form header li main menu nav ol section table td tr ul span body head title".split())
BAD_TAGS = frozenset("nav footer aside form menu head title dialog".split())
BAD_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus dropdown feedback footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget""".split()
)
GOOD_TAGS = frozenset(["article", "main"])
GOOD_ROLES = frozenset(["main", "article"])
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: What opens here: a comment, a declaration, or a tag's name.
OPENS = re.compile(r"<(?:(!--)|([!?])|(/?)([a-z][a-z0-9:-]*))", re.I)
#: Elements whose content is no text.
RAW = frozenset("script style noscript template textarea select button svg iframe object".split())
ENDS = re.compile(r"""[>"']""")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORD = re.compile(r"\w+")

#: Lengths in characters and densities of the first pass.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.15, 0.30, 0.2


#: Class names and ids that say what else is on a page or where a part stands, not what it is.
STATES = frozenset("has with no without is not".split())
#: A name with one of these is a phrase of its own.
PHRASE = frozenset("of and the".split())
INNER = frozenset("entry post article page story section content title".split())
#: Sentences end, or pause, with these, in any language that has them.
PAUSE = re.compile(r"[.!?,;:\u3002\uff0c\uff01\uff1f\u3001\u061f\u060c\u0964]")
ENDING = re.compile(r"[.!?\u3002\uff01\uff1f\u061f\u0964][\"')\u201d\u00bb]*$")
WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\u0e00-\u0e7f]")


class Block(NamedTuple):
    text: str
    linked: int  # characters inside links
    bad: bool  # inside a container that is no article text
    good: bool  # inside an article
    heading: bool


class _Tags:
    """Finds the tags of a page from left to right. A quoted value may hold ``>``; once a quote is never closed, quotes count no more, so
    that no part of a page is searched twice."""

    def __init__(self, html: str):
        self.html, self.quotes = html, True
        self.low = None

    def _end(self, at: int) -> int:
        """The place after the tag whose attributes start at ``at``."""
        if self.quotes:
            k = at
            while m := ENDS.search(self.html, k):
                if m[0] == ">":
                    return m.end()
                k = self.html.find(m[0], m.end()) + 1
                if not k:
                    break
            self.quotes = False
        return self.html.find(">", at) + 1 or len(self.html)

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, closing, attributes); of comments and declarations, and of elements without text, the name is empty."""
        html, at = self.html, 0
        while m := OPENS.search(html, at):
            start = m.start()
            if m[1]:
                at = html.find("-->", m.end()) + 3
                at = len(html) if at == 2 else at
                yield start, at, "", False, ""
            elif m[2]:
                at = html.find(">", m.end()) + 1 or len(html)
                yield start, at, "", False, ""
            else:
                name, end = m[4].lower(), self._end(m.end())
                attributes = html[m.end() : end - 1 if html[end - 1 : end] == ">" else end]
                if name in RAW and not m[3]:
                    close = re.compile(rf"</{name}\s*>", re.I).search(html, end)
                    at = close.end() if close else len(html)
                    yield start, at, "", True, ""
                else:
                    at = end
                    yield start, end, name, bool(m[3]), attributes


def _kind(tag: str, attributes: str, inside_article: bool) -> tuple[int, bool]:
    """-1 for a container without article text, 1 for an article, else 0; and whether only a class name, an id or a form says so."""
    if tag in BAD_TAGS or tag == "header" and not inside_article:
        return -1, tag == "form"  # whole pages stand in a form
    kind = 1 if tag in GOOD_TAGS else 0
    if attributes:
        if HIDDEN.search(attributes):
            return -1, False
        for name, value in NAMES.findall(attributes):
            if name.lower() == "role":
                words = re.split(r"[^a-z]+", value.lower())
                kind = -1 if BAD_ROLES.intersection(words) else 1 if GOOD_ROLES.intersection(words) else kind
            elif tag not in ("body", "html"):
                for one in value.lower().strip("\"'").split():
                    words = re.split(r"[^a-z]+", one)
                    found = BAD_NAMES.intersection(words)
                    if inside_article and INNER.intersection(words):
                        found -= {"header", "masthead", "banner"}
                    if found and words[0] not in STATES and not PHRASE.intersection(words):
                        return -1, True
    return kind, False


def blocks(html: str) -> list[Block]:
    """The page's blocks with text, in page order. Tags left open are closed by their container."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    open_of: dict[str, int] = {}
    bad = good = 0
    seen_article = False
    text: list[str] = []
    linked, link, breaks, heading, at = 0, False, 0, False, 0

    def close() -> None:
        nonlocal linked, breaks
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Block(joined, linked, bad > 0, good > 0, heading))
        text.clear()
        linked = breaks = 0

    def add(piece: str) -> None:
        nonlocal linked, breaks
        if piece:
            piece = unescape(piece)
            text.append(piece)
            if not piece.isspace():
                breaks = 0
                if link:
                    linked += len(" ".join(piece.split()))

    for start, end, tag, closing, attributes in _Tags(html):
        add(html[at:start])
        at = end
        if not tag:
            if closing:
                text.append(" ")
            continue
        if tag == "a":
            link = not closing
        elif tag == "br":
            breaks += 1
            text.append(" ")
            if breaks == 2:
                close()
        if tag in BLOCK_TAGS:
            close()
            link = link and tag == "a"
            heading = not closing and tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag in CONTAINERS:
            if closing:
                if open_of.get(tag):
                    place = len(stack) - 1
                    while stack[place][0] != tag:
                        place -= 1
                    if any(kind for _, kind in stack[place:]):
                        close()
                    for name, kind in stack[place:]:
                        open_of[name] -= 1
                        bad -= kind < 0
                        good -= kind > 0
                    del stack[place:]
            elif not attributes.endswith("/"):
                kind, by_name = _kind(tag, attributes, good > 0)
                if kind:
                    close()
                if kind > 0 and not seen_article:
                    # Wrappers that only their names condemn, or forms, hold the page's first article: the names were no help.
                    seen_article = True
                    for k, (name, other) in enumerate(stack):
                        if other == -2:
                            stack[k] = (name, 0)
                            bad -= 1
                stack.append((tag, -2 if by_name else kind))
                open_of[tag] = open_of.get(tag, 0) + 1
                bad += kind < 0
                good += kind > 0
    add(html[at:])
    close()
    return out


def classify(found: list[Block], short: int = SHORT, long: int = LONG, stop_low: float = STOP_LOW, stop_high: float = STOP_HIGH, links: float = LINKS) -> list[bool]:
    """Whether each block is article text."""
    article = any(b.good and not b.bad for b in found)
    label: list[bool | None] = []
    for b in found:
        density = b.linked / len(b.text)
        if b.bad:
            label.append(False)
        elif article:
            label.append(False if not b.good else True if b.heading or density <= 0.5 else None)
        elif density > links:
            # A sentence that is not all link goes with its neighbours.
            label.append(None if density < 1 and ENDING.search(b.text) and len(WORD.findall(b.text)) > 3 else False)
        elif len(b.text) < short:
            label.append(None if not b.linked else False)
        else:
            words = WORD.findall(b.text.lower())
            stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
            size = len(b.text) + 2 * len(WIDE.findall(b.text))  # a character of such a script says about as much as three letters
            flows = len(PAUSE.findall(b.text)) * 150 >= size  # prose pauses, whatever its language
            label.append(True if size > long and (stop >= stop_high or flows) else None if stop >= stop_low or flows else False)
    decided = [i for i, x in enumerate(label) if x is not None and (found[i].good or not article)]
    out = []
    for i, x in enumerate(label):
        if x is None:
            k = bisect(decided, i)
            before, after = decided[k - 1] if k else None, decided[k] if k < len(decided) else None
            near = [j for j in (before, after) if j is not None]
            labels = {label[j] for j in near}
            if len(labels) < 2:
                x = labels == {True} or article and not labels  # an article of nothing but links
            elif found[i].heading and label[after]:
                x = True
            elif i - before != after - i:
                x = bool(label[before if i - before < after - i else after])
            else:
                x = len(found[i].text) >= short
        out.append(bool(x))
    return out


def extract(html: str | None, **limits) -> str:
    """The main text of one page, blocks joined by a line break; null and empty pages have none."""
    found = blocks(html or "")
    return "\n".join(b.text for b, keep in zip(found, classify(found, **limits), strict=True) if keep)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", **limits) -> DataFrame:
    """One row per page, in all its columns but ``html_col``: ``text`` is its main text. Markup may be broken anywhere, and ids may
    repeat. A column named ``text`` is replaced."""
    others = [c for c in pages.columns if c not in (html_col, "text")]
    html = "html"
    while html in others:
        html += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [extract(h, **limits) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.record_batch([*part.columns[:-1], pa.array(texts, pa.string())], names=[*others, "text"])

    rows = pages.select(*others, F.col(html_col).alias(html))
    schema = rows.drop(html).schema.add("text", "string")
    return rows.transform(map_batches, run, schema)
