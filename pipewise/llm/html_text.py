"""The main text of web pages by rules on blocks, in two passes.

A page is cut into blocks at block-level tags. The first pass decides blocks by
link density, length and stop-word density; elements that name themselves (a
menu, a footer, an advert, a list of comments; an article) decide for what they
hold. Stop words are those of four languages and the short words that the page
itself repeats most. The second pass gives ambiguous blocks, mostly short ones,
the label of their nearest decided neighbours; a heading that of what follows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from pipewise.llm.shared import record_batch

LINK_DENSITY = 0.33
"""Share of letters within links above which a block is no text."""
SHORT, LONG = 60, 140
"""Characters: below SHORT a block is ambiguous, from LONG on stop words alone decide."""
STOPS_LOW, STOPS_HIGH = 0.08, 0.15
OWN_LENGTH, OWN_TIMES, OWN_SHARE = 4, 5, 0.01
"""A page's own stop words: letters at most; times, and share of the page's words, at least."""

STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he her his i in is it its not of on or she
    that the their they this to was we were which who will with would you
    au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas
    plus pour qui que se son sur un une vous
    als am auf aus bei das dem den der des die ein eine einen er es für hat im in ist mit nach
    nicht noch oder sich sie sind so um und von war wie wir zu zum zur über auch
    al como con de del el en entre era es esta este fue ha la las lo los más no para pero por que
    se si sin sobre su sus un una y
    """.split()
)

TO_THE_END = frozenset(("script", "style"))
"""Without an end tag these hold the rest of the page."""
DROPPED = TO_THE_END | frozenset(
    "noscript template textarea svg math iframe object canvas title select".split()
)
"""Without an end tag the others end at the next block-level tag."""
EMPTY_BY_SLASH = frozenset(("svg", "math", "object", "canvas"))
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<[/!?]?[a-zA-Z](?:[^<>"']|"[^"<]*+"|'[^'<]*+')*+>|<[/!?]?[a-zA-Z][^<>]*+>|<[!?/][^>]*+>""",
    re.S | re.I,
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_CLOSES = re.compile(rf"</({'|'.join(sorted(DROPPED))})\s*>", re.I)
_WORD = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]|[^\W\d_]+")
"""A run of letters; in scripts without blanks between words, one sign."""
_SPLIT_NAME = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")

CONTAINERS = frozenset(
    """
    article aside blockquote body button center dd details dialog div dl dt fieldset figcaption
    figure footer form header html li main menu nav ol section summary table tbody td tfoot th thead
    tr ul label
    """.split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CONTAINERS | HEADINGS | frozenset("address br caption hr legend option p pre".split())
_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})\b", re.I)
BAD_ELEMENTS = frozenset("nav footer aside form button menu dialog fieldset label".split())
GOOD_ELEMENTS = frozenset(("article", "main"))
NEVER_NAMED = GOOD_ELEMENTS | HEADINGS | frozenset(("body", "html"))
"""Elements whose class, id and role say nothing."""
BAD_NAMES = frozenset(
    """
    ad ads adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs byline
    comment comments consent cookie cookies copyright disclaimer disqus footer gdpr legal login
    masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup
    promo promoted promotion recommended related replies reply respond search share sharing
    sidebar signup skip social sponsor sponsored subscribe tags teaser toolbar widget
    """.split()
)
"""Names of what is not the article, anywhere."""
FILLERS = frozenset(
    """
    area articles bar block bottom box buttons container content form global group holder inner item
    items left links list main outer page panel policy post posts right row section site stories
    sub text thread title top unit wrap wrapper
    """.split()
)
"""Parts that may stand beside them: a name counts if all its parts are of these two lists."""
BAD_OUTSIDE = frozenset(("header", "top", "bottom", "aside", "author", "meta"))
"""Names that do so outside an article only."""


@dataclass
class Block:
    hint: int  # 1 in an article, -1 in what is none, 0 neither
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    label: int = 0
    heading: bool = False

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def _names(tag: str) -> Iterator[set[str]]:
    """The names of an element, each as its parts without numbers."""
    for found in _NAMED.finditer(tag):
        value = next(x for x in found.groups() if x is not None)
        for name in value.split():
            parts = _SPLIT_NAME.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            yield {x for x in parts if x}


def _hint(tag: str, name: str, outer: int) -> int:
    """What an element says about its content; ``outer`` if it says nothing."""
    if name in BAD_ELEMENTS:
        return -1
    if name in GOOD_ELEMENTS:
        return 1
    if outer == 0 and name == "header":
        return -1
    if name in NEVER_NAMED:
        return outer
    for parts in _names(tag):
        bad = BAD_NAMES if outer else BAD_NAMES | BAD_OUTSIDE
        if parts & bad and parts <= bad | FILLERS:
            return -1
        if outer == 0 and parts == {"main"}:
            return 1
    return outer


def _ends(page: str) -> dict[str, list[tuple[int, int]]]:
    """Where the end tags of dropped elements lie, by name."""
    out: dict[str, list[tuple[int, int]]] = {name: [] for name in DROPPED}
    for found in _CLOSES.finditer(page):
        out[found.group(1).lower()].append(found.span())
    return out


def _behind(page: str, name: str, tag: str, at: int, ends: dict[str, list[tuple[int, int]]]) -> int:
    """Where the page goes on after the start tag of a dropped element that ends at ``at``."""
    if tag.endswith("/>") and name in EMPTY_BY_SLASH:
        return at
    k = bisect_left(ends[name], (at, 0))
    if k < len(ends[name]):
        return ends[name][k][1]
    if name in TO_THE_END:
        return len(page)
    block = _BLOCK_TAG.search(page, at)
    return block.start() if block else len(page)


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order. Open elements end with the element that
    holds them; a table or list entry ends where the next begins."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    links = 0
    now = Block(0)

    def start(hint: int) -> Block:
        if now.parts:
            out.append(now)
        return Block(hint)

    at, ends = 0, _ends(page)
    while token := _TOKEN.search(page, at):
        if token.start() > at:
            _add(now, page[at : token.start()], links)
        at = token.end()
        tag = token.group()
        found = _NAME.match(tag)
        if not found:
            continue
        name, closing = found.group(1).lower(), tag[1] == "/"
        if name in DROPPED:
            at = at if closing else _behind(page, name, tag, at, ends)
            continue
        if name == "a":
            links = 0 if closing else 1
        if name not in BLOCKS:
            continue
        if closing and name in CONTAINERS:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
        elif name in ("li", "td", "th", "dt", "dd") and stack and stack[-1][0] in (name, "dt", "dd"):
            stack.pop()
        outer = stack[-1][1] if stack else 0
        hint = outer if closing else _hint(tag, name, outer)
        if not closing and name in CONTAINERS:
            stack.append((name, hint))
        if name != "br":
            now = start(hint)
            now.heading = name in HEADINGS and not closing
            links = links and name in ("li", "div", "h1", "h2", "h3", "h4", "p")
        else:
            now.parts.append(" ")
    if at < len(page):
        _add(now, page[at:], links)
    start(0)
    return [b for b in out if b.text()]


def _add(block: Block, raw: str, links: int) -> None:
    text = html.unescape(raw)
    block.parts.append(text)
    if links:
        block.linked += len("".join(text.split()))


def own_stop_words(blocks: list[Block]) -> set[str]:
    """The short words that the text outside links repeats most."""
    words = Counter()
    for block in blocks:
        if block.hint >= 0 and not block.linked:
            words.update(_WORD.findall(block.text().lower()))
    least = max(OWN_TIMES, OWN_SHARE * words.total())
    return {w for w, n in words.items() if n >= least and len(w) <= OWN_LENGTH}


def first_pass(block: Block, stop_words: frozenset[str] | set[str] = STOP_WORDS) -> int:
    """1 text, -1 none, 0 ambiguous."""
    text = block.text()
    letters = len(text.replace(" ", ""))
    notice = "\N{COPYRIGHT SIGN}" in text and len(text) < 2 * LONG
    if block.hint < 0 or block.linked > LINK_DENSITY * letters or notice:
        return -1
    if len(text) < SHORT:
        return 0
    words = _WORD.findall(text.lower())
    stops = sum(w in stop_words for w in words) / max(1, len(words))
    if stops >= STOPS_HIGH or len(text) >= LONG and stops >= STOPS_LOW:
        return 1
    return 0


def second_pass(blocks: list[Block]) -> None:
    """Ambiguous blocks get the label of the nearest decided neighbour, a heading
    that of the next one. Where two differ, a block in an article is text; so is one
    without neighbours there, and no other, also where two are as near. A neighbour
    must be as much inside an article as the block is."""
    decided = [b.label for b in blocks]

    def nearest(order) -> list[tuple[int, int]]:
        """(steps to the decided block, its label) for every block in this order."""
        last: dict[int, tuple[int, int]] = {}
        out = [(0, 0)] * len(blocks)
        for step, k in enumerate(order):
            hint = blocks[k].hint
            if hint in last:
                out[k] = (step - last[hint][0], last[hint][1])
            if decided[k]:
                last[hint] = (step, decided[k])
        return out

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    for k, block in enumerate(blocks):
        if decided[k]:
            continue
        (far, earlier), (near, later) = before[k], after[k]
        otherwise = 1 if block.hint > 0 else -1
        if block.heading and later:
            block.label = later
        elif earlier and later and earlier != later:
            nearer = otherwise if far == near else earlier if far < near else later
            block.label = max(nearer, otherwise)
        else:
            block.label = earlier or later or otherwise


def main_text(page: str | None) -> str:
    """The text blocks of a page joined by one blank.

    If the page has an article (or main) element with text, only blocks in it
    count; otherwise the rules decide for all blocks. Where stop words make no
    block text (tables of names, say), those of SHORT characters or more that
    nothing speaks against are. A null or empty page has an empty text.
    """
    blocks = blocks_of(page or "")
    if any(b.hint > 0 for b in blocks):
        blocks = [b for b in blocks if b.hint > 0]
    stop_words = STOP_WORDS | own_stop_words(blocks)
    for block in blocks:
        block.label = first_pass(block, stop_words)
    if not any(b.label > 0 for b in blocks):
        for block in blocks:
            if block.label == 0 and len(block.text()) >= SHORT:
                block.label = 1
    second_pass(blocks)
    return " ".join(b.text() for b in blocks if b.label > 0)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Page by page, whole texts, nothing shuffled. Null ids and urls stay null;
    repeated rows give repeated rows; an empty table gives an empty result.
    """

    def extracted(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            ids, urls = (table.column(k).to_pylist() for k in (0, 1))
            texts = [main_text(x.as_py()) for x in table.column(2)]
            yield record_batch(list(zip(ids, urls, texts, map(len, texts))), SCHEMA)

    return pages.select("page_id", "url", "html").mapInArrow(extracted, SCHEMA)
