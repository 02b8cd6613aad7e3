"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block elements. The first pass looks at each block alone: blocks in menus,
headers, footers, sidebars and dialogs by their element and blocks that are mostly links are out; long blocks with many stop words are in; long ones
with few stop words are out, unless they stand in the page's article, where lists and tables are text too:
there they are undecided, as are short blocks. In the second pass undecided blocks take the label of the
nearest decided block of the same part of the page, the one before on equal distance; where a part has no
decided block, text in an article is in and other text is out, and in a page without an article
undecided blocks between two labels need both neighbours to be in.

Forms, and elements whose class, id or role is the name of a menu, header, footer, sidebar, notice, advert
or comments (a whole name, not a part of one), are marked. Blocks in a marked element are out, unless it
holds more than half of the page's text that the first pass takes in; comments must hold all of it.

Character references are decoded, white space inside a block becomes one blank, and blocks are joined by
an empty line. Null and empty pages give an empty text. Broken markup is read as browsers do: unclosed
elements end with their parent. Rows that repeat are read one by one. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SHORT_CHARS = 70
LINK_SHARE = 0.33
STOP_SHARE = 0.2
STOP_SHARE_ARTICLE = 0.3

# Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from has have he her his i in is it its not of on or our she that the their they
    this to was we were which will with you
    au aux avec ce ces dans de des du elle en est et il ils la le les leur lui mais ne nous on ou par pas pour qu que qui sa
    se ses son sur un une vous
    aber als am auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit
    nach nicht noch nur oder sein sich sie sind so über um und von war was wie wir zu zum zur
    al como con cuando del el ella en entre era es esta este fue ha la las lo los más muy no o para pero por que se si sin
    sobre su sus un una y ya""".split()
)

# Elements by their role.
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2
    h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead
    tr ul""".split()
)
OUT = frozenset("aside button dialog footer menu nav select".split())
HIDDEN = frozenset("head iframe math noscript object script style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLES = frozenset("article main".split())
OUT_WORDS = frozenset(
    """ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie
    cookies dialog disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination
    popup promo promoted related replies reply respond search share sharing sidebar social sponsor sponsored subscribe
    toolbar widget""".split()
)
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())

_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """Text between two block borders, with what the rules look at."""

    out: bool
    article: int
    marks: tuple[tuple[int, bool], ...] = ()
    pieces: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        #: Element, hidden, out, number of its article, marked elements around it: their number, whether comments.
        self.open: list[tuple[str, bool, bool, int, tuple[tuple[int, bool], ...]]] = []
        self.state = (False, False, 0, ())
        self.links = 0
        self.articles = 0
        self.marked = 0
        self.block = Block(False, 0)

    def border(self) -> None:
        if self.block.pieces:
            self.blocks.append(self.block)
        self.block = Block(*self.state[1:])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self.closed_head()
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            if tag == "hr":
                self.border()
            return
        if tag == "p":
            self.closed_paragraph()
        hidden, out, article, marks = self.state
        names = {name for key, value in attrs if key in ("class", "id", "role") and value for name in value.lower().split()}
        out = out or tag in OUT or (tag == "header" and not article)
        if tag == "form" or (tag not in ("html", "body") and names & OUT_WORDS):
            self.marked += 1
            marks = (*marks, (self.marked, bool(names & COMMENT_WORDS)))
        if tag in ARTICLES and not out:
            self.articles += 1
            article = self.articles
        self.open.append((tag, *self.state))
        self.state = (hidden or tag in HIDDEN, out, article, marks)
        if tag == "a":
            self.links += 1
        if tag in BLOCKS:
            self.border()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def closed_head(self) -> None:
        if self.open and self.open[-1][0] == "head":
            self.handle_endtag("head")

    def closed_paragraph(self) -> None:
        for tag, *_ in reversed(self.open):
            if tag == "p":
                self.handle_endtag("p")
                return
            if tag in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        if not any(one[0] == tag for one in self.open):
            return
        border = False
        while True:
            name, *state = self.open.pop()
            self.state = tuple(state)
            border = border or name in BLOCKS
            if name == "a":
                self.links -= 1
            if name == tag:
                break
        if border:
            self.border()

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.closed_head()
        if not self.state[0]:
            self.block.pieces.append(data)
            if self.links:
                self.block.link_chars += len(data.strip())


def blocks(html: str) -> list[Block]:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.border()
    found = []
    for block in reader.blocks:
        block.text = " ".join("".join(block.pieces).split())
        if block.text:
            found.append(block)
    for block, outweighed in zip(found, _outweighed(found), strict=True):
        block.out = block.out or not outweighed
    return found


def _outweighed(found: list[Block]) -> list[bool]:
    """Whether none of the marks of a block counts, because the page's text is in the marked elements."""
    total, held = 0, Counter()
    for block in found:
        if first_label(block):
            total += len(block.text)
            held.update({mark: len(block.text) for mark in block.marks})
    return [all(held[mark] == total > 0 if mark[1] else 2 * held[mark] > total for mark in block.marks) for block in found]


def first_label(block: Block) -> bool | None:
    """In, out or undecided, from the block alone."""
    if block.out:
        return False
    size = len(block.text)
    if block.link_chars / size > LINK_SHARE:
        return False
    if size < SHORT_CHARS:
        return None
    words = _WORDS.findall(block.text.lower())
    share = sum(word in STOP_WORDS for word in words) / max(1, len(words))
    if share >= (STOP_SHARE if block.article else STOP_SHARE_ARTICLE):
        return True
    return None if block.article or share >= STOP_SHARE else False


def labels(found: list[Block]) -> list[bool]:
    """Both passes."""
    first = [None if block.out is False and label is None else label for block, label in ((b, first_label(b)) for b in found)]
    any_article = any(block.article and not block.out for block in found)
    before, after = _decided(found, first, range(len(found))), _decided(found, first, range(len(found) - 1, -1, -1))
    result = []
    for place, (block, label) in enumerate(zip(found, first, strict=True)):
        if label is not None:
            result.append(label)
            continue
        near = [(abs(place - at), side, first[at]) for side, at in enumerate((before[place], after[place])) if at is not None]
        if not near:
            result.append(bool(block.article))
        elif any_article:
            result.append(bool(min(near)[2]))
        else:
            result.append(all(one[2] for one in near))
    return result


def _decided(found: list[Block], first: list[bool | None], places: range) -> list[int | None]:
    """For each block the last decided one of the same part, in the given direction.

    Blocks that are out by their element do not count for text of an article.
    """
    last: dict[int, int] = {}
    result: list[int | None] = [None] * len(found)
    for place in places:
        block = found[place]
        result[place] = last.get(block.article)
        if first[place] is not None and not (block.article and not first[place]):
            last[block.article] = place
    return result


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return "\n\n".join(block.text for block, label in zip(found, labels(found), strict=True) if label)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: its main text and the number of its characters."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(text) for text in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = {name: pages.schema[name].dataType.simpleString() for name in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(convert, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
