"""Main-text extraction by two-pass block rules.

A small helper in the tasks cuts a page into blocks and measures them, in time linear in the page. First pass: a block is bad if
it stands in furniture (menus, forms, adverts, comments, hidden elements and the like) or is mostly links, good if it is long
enough and rich in stop words, and else ambiguous. Second pass: an ambiguous block inherits the label of its nearest decided
neighbour, counted in blocks outside furniture; of two as near, a heading takes that of the block after it, others that of the block before. In a
page that marks an article, ambiguous blocks beside it are bad first, and those in it have their neighbours there; in any other,
the page's beginning counts as a bad block to what stands before the first heading. Where no
block is good by itself (all are short, or of another language), the ambiguous blocks of the article are, else all of them.

Density overrules names: where classes, ids and roles leave no good block but headings in the article (in a page without one, in
the page), and what they took for furniture holds good blocks with more text than is left, the names don't count there. Comments, hidden
elements and furniture by its element stay bad.

Furniture around an article doesn't make it bad (a form or a div named "has-sidebar" around the page's body, an aside that is
never closed), but for hidden elements, comments, and menus, asides and footers that are closed. Furniture within a block
(a span that is an advert, or hidden) is left out of it.

Defined results: a null or empty page has an empty text. Repeated pages give repeated rows. Nothing of a long page is cut.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastrum.llm.words import slices

#: Characters and share of stop words of a good block; share of linked characters of a bad one.
GOOD, STOPS, LINKS = 60, 0.15, 0.5

# Frequent function words of the languages served, as one set.
STOP_WORDS = frozenset("""the of and to in is that it for was on are as with be at by this from or an he not have
de la le les des du un une et en que qui dans pour par sur avec est au pas ou il elle
der die das und zu den mit von sich ist ein eine nicht auf für dem im auch es als an
el los las y del se por con para su al lo como más o pero sus""".split())
# Elements that begin a block, those whose content is never text, furniture elements, and words that name furniture.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td
tfoot th thead tr ul""".split())
SILENT = ("script", "style", "noscript", "template", "svg", "textarea", "iframe", "object", "title", "math", "canvas", "audio", "video")
FURNITURE = frozenset("nav footer aside form menu dialog select button fieldset head".split())
NAMES = frozenset("""ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
notice alert newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment
comments reply replies disqus social share sharing related recommended popup modal overlay widget toolbar pagination pager
copyright login search""".split())
#: Names that also count on elements within a block.
INLINE = NAMES - frozenset("notice alert menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar search login copyright related".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend caption summary".split())
_LANDMARKS = frozenset(("article", "main"))
_ENDED = frozenset("nav head ul li menu".split())
_LISTS = frozenset("li ul ol menu".split())
#: Furniture that makes an article within it bad too, where the element is closed.
_APART = frozenset("nav footer aside menu dialog select button head".split())
_COMMENTS = ("comment", "reply", "replies", "disqus")
#: Kinds of elements: no furniture, furniture by a name alone, furniture that an article within it overrules, the same where it is not closed, and furniture that no article overrules.
PLAIN, NAMED, AROUND, CLOSED, ALWAYS = range(5)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: The rest of a tag, with ends in quotes skipped; possessive, so that a failure costs one pass.
_REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_ENDS = {t: re.compile(rf"</{t}\s*+>", re.I) for t in SILENT}
_ATTRIBUTES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def _kind(tag: str, attributes: str, in_landmark: bool, inline: bool = False) -> int:
    """Whether an element is furniture by its name and attributes."""
    kind = PLAIN if inline else CLOSED if tag in _APART else AROUND if tag in FURNITURE or (tag == "header" and not in_landmark) else PLAIN
    if not attributes or tag in ("html", "body", "main"):
        return kind
    for m in _ATTRIBUTES.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            named = (INLINE if inline else NAMES).intersection(re.split(r"[^a-z0-9]+", value))
            named = named & {"comment", "comments", "reply", "replies"} if tag == "article" else named - {"header"} if in_landmark else named
            if any(x.startswith(_COMMENTS) for x in value.split()) and named:
                return ALWAYS
            if not inline and value in ("navigation", "contentinfo", "complementary"):
                kind = max(kind, CLOSED)
            elif named:
                kind = max(kind, NAMED)
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*+:\s*+none", value)):
            return ALWAYS
    return kind


@dataclass(slots=True)
class Element:
    tag: str
    kind: int
    parent: Element | None
    landmark: bool
    closed: bool = False
    #: Whether blocks in it are furniture; whether an article holds it. Known when the page has been read.
    hard: bool = False
    soft: int = PLAIN
    in_article: bool = False

    def settle(self) -> None:
        up = self.parent
        self.hard = bool(up and up.hard) or self.kind == ALWAYS or (self.kind == CLOSED and self.closed)
        fresh = not (up and up.in_article) and self.tag in _LANDMARKS  # around the outermost article, else the innermost main, only hard furniture counts
        self.soft = max(self.kind, up.soft if up and not fresh else PLAIN)
        self.in_article = self.tag == "article" or bool(up and up.in_article)


@dataclass(slots=True)
class Block:
    text: str
    words: int
    stops: int
    linked: int
    heading: bool
    furniture: bool
    landmark: bool
    #: Furniture by names alone.
    named: bool = False
    good: bool | None = field(default=None)

    def dense(self) -> bool:
        return len(self.text) >= GOOD and self.stops >= STOPS * self.words and self.linked <= LINKS * len(self.text)


class Page:
    """Cuts one page into blocks; every step takes time in proportion to what it consumes."""

    def __init__(self, page: str) -> None:
        self.found: list[tuple[Block, Element | None, int]] = []
        self.parts: list[str] = []
        self.open: list[Element] = []
        self.lists: list[int] = []  # places of the open list elements
        self.all: list[Element] = []
        self.tags: Counter[str] = Counter()
        self.linked = self.links = self.hidden = 0
        self.hider = self.starter = ""
        self.own = PLAIN  # of the paragraph that the block began with
        self._read(page)
        self._end()
        for e in self.all:
            e.settle()
        for block, e, own in self.found:
            kind = max(own, (ALWAYS if e.hard else e.soft) if e else PLAIN)
            block.furniture, block.named = kind != PLAIN, kind == NAMED

    def _end(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            words = _WORD.findall(text.lower())
            inside = self.open[-1] if self.open else None
            self.found.append((Block(text, len(words), sum(w in STOP_WORDS for w in words), self.linked, self.starter in HEADINGS, False, bool(inside and inside.landmark)), inside, self.own))
        self.parts.clear()
        self.linked = self.links = self.hidden = 0
        self.own = PLAIN

    def _pop(self, at: int) -> None:
        for e in self.open[at:]:
            self.tags[e.tag] -= 1
        del self.open[at:]
        while self.lists and self.lists[-1] >= at:
            self.lists.pop()

    def _push(self, tag: str, kind: int) -> None:
        up = self.open[-1] if self.open else None
        e = Element(tag, kind, up, tag in _LANDMARKS or bool(up and up.landmark))
        self.all.append(e)
        if tag in _LISTS:
            self.lists.append(len(self.open))
        self.open.append(e)
        self.tags[tag] += 1

    def _end_menus(self) -> None:
        """A head or menu left open ends where the body or an article begins; what was opened within it stays open."""
        if any(self.tags[t] for t in _ENDED):
            first = len(self.open) - 1
            left = sum(self.tags[t] for t in _ENDED)
            while True:
                left -= self.open[first].tag in _ENDED
                if not left:
                    break
                first -= 1
            again = [(e.tag, e.kind) for e in self.open[first:] if e.tag not in _ENDED]
            self._pop(first)
            for tag, kind in again:
                self._push(tag, kind)

    def _block(self, tag: str, end: bool, attributes: str) -> None:
        self._end()
        self.starter = "" if end else tag
        in_landmark = bool(self.open and self.open[-1].landmark)
        if tag == "p":
            self.own = PLAIN if end else _kind(tag, attributes, in_landmark)
        elif tag in _VOID:
            return
        elif end:
            if self.tags[tag]:
                at = len(self.open) - 1
                while self.open[at].tag != tag:
                    at -= 1
                self.open[at].closed = True
                self._pop(at)
        else:
            if tag == "body" or tag in _LANDMARKS:
                self._end_menus()
            elif tag == "li" and self.lists and self.open[self.lists[-1]].tag == "li":
                self._pop(self.lists[-1])
            self._push(tag, _kind(tag, attributes, in_landmark))

    def _inline(self, tag: str, end: bool, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif self.hidden:
            self.hidden += (-1 if end else 1) * (tag == self.hider)
        elif tag == "a" and end:
            self.links = max(0, self.links - 1)
        elif not end and tag not in _VOID:
            if attributes and not attributes.endswith("/") and _kind(tag, attributes, True, inline=True) != PLAIN:
                self.hidden, self.hider = 1, tag
            elif tag == "a":
                self.links += 1

    def _text(self, text: str) -> None:
        if not self.hidden:
            self.parts.append(text)
            if self.links:
                self.linked += len(" ".join(html.unescape(text).split()))

    def _read(self, page: str) -> None:
        at, n, quoted = 0, len(page), True
        while at < n:
            if page[at] != "<":
                end = page.find("<", at)
                end = n if end < 0 else end
                self._text(page[at:end])
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = n if end < 0 else end + 3
            elif page.startswith(("<!", "<?"), at):
                end = page.find(">", at)
                end = n if end < 0 else end + 1
            elif not (m := _NAME.match(page, at)):
                end = at + 1
                self._text("<")
            else:
                rest = _REST.match(page, m.end()) if quoted else None
                if rest is None:  # quotes that don't pair: from here on, a tag ends at the next >
                    quoted = False
                end = rest.end() if rest else page.find(">", m.end()) + 1
                if not end:
                    self._text(page[at:])
                    return
                tag, attributes = m[2].lower(), page[m.end() : end - 1]
                if tag in _ENDS:
                    if not m[1] and not attributes.endswith("/"):
                        closing = _ENDS[tag].search(page, end)
                        end = closing.end() if closing else n
                elif tag in BLOCKS or tag == "button":
                    self._block(tag, bool(m[1]), attributes)
                else:
                    self._inline(tag, bool(m[1]), attributes)
            at = end


def classify(page: str) -> list[Block]:
    """The blocks of a page in order, each good or not."""
    each = [b for b, *_ in Page(page).found]
    scope = [b for b in each if b.landmark] or each
    rest = [b for b in scope if not b.furniture]
    if not any(b.dense() and not b.heading for b in rest) and sum(len(b.text) for b in scope if b.named and b.dense()) > sum(len(b.text) for b in rest):
        for b in scope:  # the names took the article itself
            b.furniture = b.furniture and not b.named
    for b in each:
        if b.furniture or b.linked > LINKS * len(b.text):
            b.good = False
        elif b.dense():
            b.good = True
    content = [b for b in each if not b.furniture]
    if not any(b.good for b in content):
        pool = [b for b in content if b.landmark and b.good is None] or [b for b in content if b.good is None]
        for b in pool:
            b.good = True
    if any(b.landmark and b.good for b in content):
        for b in content:
            if b.good is None and not b.landmark:
                b.good = False
        groups = [[b for b in content if b.landmark], [b for b in content if not b.landmark]]
        start = -(1 << 60)
    else:
        groups = [content]
        start = -1
    for group in groups:
        labels = [b.good for b in group]
        after: list[tuple[int, bool]] = [(0, False)] * len(group)
        nearest = (1 << 60, False)
        for i in range(len(group) - 1, -1, -1):
            nearest = (i, labels[i]) if labels[i] is not None else nearest
            after[i] = nearest
        nearest = (start, False)
        for i, b in enumerate(group):
            if labels[i] is not None:
                nearest = (i, labels[i])
                continue
            if b.heading and nearest[0] < 0:
                nearest = (-(1 << 60), False)  # what follows the first heading is no longer at the beginning
            back, ahead = i - nearest[0], after[i][0] - i
            b.good = after[i][1] if ahead < back or (ahead == back and b.heading) else nearest[1]
    return each


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in classify(page or "") if b.good)


def classified(pages: DataFrame) -> DataFrame:
    """The blocks of all pages: page_id, url, at, text, words, stops, linked, furniture, good."""
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(i, url, at, b.text, b.words, b.stops, b.linked, b.furniture, b.good) for i, url, page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True) for at, b in enumerate(classify(page or ""))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "at", "text", "words", "stops", "linked", "furniture", "good"])

    return _columns(pages).mapInArrow(run, "page_id long, url string, at int, text string, words int, stops int, linked int, furniture boolean, good boolean")


def _columns(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (its good blocks in page order, joined by a line feed), n_chars. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return _columns(pages).mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
