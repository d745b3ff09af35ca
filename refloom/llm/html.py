"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by its place (menus, headers, footers,
sidebars, notices, adverts, forms and comments are never text), its link density, its length and its share of stop
words; short blocks stay open. In the second pass open blocks take the label of the nearest decided neighbours. An
article or main element is a zone of its own: blocks in it look for neighbours in it only, and count as text where
nothing in it is decided. Blocks outside such zones are left out if the zones hold most of the main text that the first
pass found: so a teaser in an article element doesn't replace the page.

A class, id or role names a side place only if all its parts do (cookie-banner, site-footer); where only some do
(has-sidebar, share-price) the name is a hint: such blocks need more stop words. Forms, and names that wrappers of whole
pages have too (widget, overlay), are side places unless nearly all text that is main text by itself stands in them; a
hint is none where most of it does. Stop words are of four languages; a page whose longer blocks
hardly have any is in another one, and its blocks are decided by length and links alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm.quality import COMMON_WORDS
from refloom.llm.text import rows_of

#: Tags that end a block. br is not among them: it is white space in a block.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Their content is text of no page.
RAW_TAGS = frozenset("script style noscript template textarea title iframe svg math object audio video canvas".split())
#: Elements that hold no main text.
SIDE_TAGS = frozenset("nav aside footer form menu dialog button select search head".split())
#: Words of class, id or role that mark such elements.
SIDE_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe signup login search comment comments disqus respond replies reply share sharing social related recommended pagination pager widget toolbar complementary contentinfo".split())
#: Of the tags and names of side places those that may stand for a whole page.
WRAPPER_TAGS = frozenset(["form"])
WRAPPER_NAMES = frozenset("promo promotion banner header masthead notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social widget toolbar".split())
#: Words that stand beside those in the names of such elements, and say nothing of their content.
PLAIN_NAMES = frozenset("site page main global top bottom left right inner outer box block list item items links link container wrapper wrap bar area section content body form box panel row col column group slot unit primary secondary text title button buttons icon icons post thread first last fixed sticky".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element is closed by these start tags (p by any block).
CLOSED_BY = {"p": BLOCK_TAGS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}
STOP_WORDS = frozenset(w for words in COMMON_WORDS.values() for w in words)

# Every alternative that begins to match also ends: nothing is scanned twice. Quotes count only after an equals sign.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_MARK = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_NOT_SHOWN = re.compile(r"(?:^|\s)style\s*=\s*(?:\"[^\"]*?display\s*:\s*none|'[^']*?display\s*:\s*none|[^\s\"'>]*display:none)", re.I)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class BlockRules:
    """Thresholds of the first pass: lengths in characters of a block's text, densities from 0 to 1.

    hinted: share of stop words that a block in a place with a hint of a side place needs; foreign: a page whose blocks
    of length short or more have fewer stop words is in a language without a list of them; beside: text outside side
    places, for each character in a wrapper, up to which the wrapper is taken for the page.
    """

    max_link_density: float = 0.4
    short: int = 70
    long: int = 200
    stop_low: float = 0.10
    stop_high: float = 0.20
    hinted: float = 0.30
    foreign: float = 0.03
    beside: float = 0.1


HINT, WRAPPER, SIDE = 1, 2, 3
#: Marked elements round a block that are told apart; further ones within them share their fate.
MARKS = 16


class Block:
    """places: the kinds of the marked elements that it stands in, by the element's number on the page."""

    __slots__ = ("text", "linked", "places", "zone", "heading")

    def __init__(self, text: str, linked: int, places: dict[int, int], zone: int, heading: bool):
        self.text, self.linked, self.places, self.zone, self.heading = text, linked, places, zone, heading

    @property
    def side(self) -> int:
        """The strongest of its places: SIDE, WRAPPER, HINT or none (0)."""
        return max(self.places.values(), default=0)


def side_of(tag: str, attributes: str, in_zone: bool) -> int:
    """What an element's tag and attributes say of its place: SIDE, WRAPPER, HINT or 0."""
    if tag in SIDE_TAGS - WRAPPER_TAGS or (tag == "header" and not in_zone):
        return SIDE
    found = WRAPPER if tag in WRAPPER_TAGS else 0
    if tag in ("html", "body", "article", "main") or not attributes:
        return found
    if _HIDDEN.search(_VALUE.sub("=", attributes)) or _NOT_SHOWN.search(attributes):
        return SIDE
    for mark in _MARK.finditer(attributes):
        for name in (mark[1] or mark[2] or mark[3] or "").split():
            parts = [x.lower() for x in _NAME.findall(name)]
            sides = [x for x in parts if x in SIDE_NAMES]
            if sides:
                whole = all(x in SIDE_NAMES or x in PLAIN_NAMES for x in parts)
                found = max(found, HINT if not whole else WRAPPER if all(x in WRAPPER_NAMES for x in sides) else SIDE)
            elif parts == ["hidden"]:
                found = max(found, WRAPPER)
    return found


def blocks_of(page: str) -> list[Block]:
    """The non-empty blocks of a page in order, with decoded character references and single spaces."""
    found: list[Block] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, dict[int, int], int, bool]] = []  # tag, marked places, zone, link
    places: dict[str, list[int]] = {}  # of each tag's open elements in stack
    block_places: list[int] = []  # of all open block elements
    link = heading = False
    zone = zones = marks = 0
    inside: dict[int, int] = {}
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked, heading
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, linked, inside, zone, heading))
        parts, linked, heading = [], 0, bool(stack) and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a:
            raw = page[a:b]
            parts.append(html.unescape(raw) if "&" in raw else raw)
            if link:
                linked += len(" ".join(parts[-1].split()))

    def restore() -> None:
        nonlocal inside, zone, link
        _, inside, zone, link = stack[-1] if stack else ("", {}, 0, False)

    def close(depth: int) -> None:
        while len(stack) > depth:
            closed = stack.pop()[0]
            places[closed].pop()
            if closed in BLOCK_TAGS:
                block_places.pop()

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            own_places = places.get(tag)
            if own_places and (tag in BLOCK_TAGS or not block_places or block_places[-1] < own_places[-1]):
                close(own_places[-1])
                restore()
                heading = bool(stack) and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            while stack and (tag in CLOSED_BY.get(stack[-1][0], ()) or stack[-1][0] not in BLOCK_TAGS and len(stack) > 1 and tag in CLOSED_BY.get(stack[-2][0], ())):
                close(len(stack) - 1)
            restore()
        if tag in RAW_TAGS:
            if not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in VOID_TAGS:
            if tag in ("hr",):
                flush()
            continue
        if m[3].endswith("/") and tag not in BLOCK_TAGS:
            continue
        here = inside
        if tag in ("article", "main") and not zone:
            zones += 1
            own = zones
        else:
            own = zone
        # what stands in a side place stays there, and marks within many others share their fate
        if SIDE not in here.values() and (kind := side_of(tag, m[3], zone > 0)) and (kind == SIDE or len(here) < MARKS):
            marks += 1
            here = {marks: SIDE} if kind == SIDE else here | {marks: kind}
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK_TAGS:
            block_places.append(len(stack))
        stack.append((tag, here, own, link or tag == "a"))
        restore()
        heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6") or heading and tag not in BLOCK_TAGS
    flush()
    return found


def stop_words(text: str) -> tuple[int, int]:
    """Numbers of stop words and of words in a text."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words), len(words)


def by_itself(blocks: list[Block], rules: BlockRules) -> tuple[list[bool | None], list[float | None]]:
    """The label of each block without regard to its place, and its share of stop words where that was asked for."""
    out: list[bool | None] = []
    densities: list[float | None] = []
    stops = words = 0
    for block in blocks:
        n, density, label = len(block.text), None, None
        if block.linked > rules.max_link_density * n:
            label = False
        elif not block.heading and n >= rules.short:
            a, b = stop_words(block.text)
            density = a / max(b, 1)
            if block.side != SIDE:
                stops, words = stops + a, words + b
        out.append(label)
        densities.append(density)
    foreign = stops < rules.foreign * words
    for i, density in enumerate(densities):
        if density is not None:
            long = len(blocks[i].text) >= rules.long
            out[i] = (True if long else None) if foreign or rules.stop_low <= density < rules.stop_high else density >= rules.stop_high or (None if blocks[i].zone else False)
    return out, [None if foreign else x for x in densities]


def undo_marks(blocks: list[Block], labels: list[bool | None], rules: BlockRules) -> list[int]:
    """The side of each block, SIDE, HINT or 0, once marks are undone that stand for the page and not for a place on it."""
    undone: set[int] = set()
    dense = [(b.places, len(b.text)) for b, label in zip(blocks, labels, strict=True) if label]
    kinds = {k: kind for places, _ in dense for k, kind in places.items()}

    def outside(places: dict[int, int]) -> bool:
        return all(kind == HINT or k in undone for k, kind in places.items())

    while True:
        beside, held = 0, dict.fromkeys((k for k, kind in kinds.items() if kind == WRAPPER and k not in undone), 0)
        for places, n in dense:
            if outside(places):
                beside += n
            elif SIDE not in places.values():
                for k in places:
                    if k in held:
                        held[k] += n
        k = max(held, key=lambda k: (held[k], -k), default=None)
        if k is None or not held[k] or beside >= rules.beside * held[k]:
            break
        undone.add(k)
    text = [(places, n) for places, n in dense if outside(places)]
    total = sum(n for _, n in text)
    hints = dict.fromkeys((k for k, kind in kinds.items() if kind == HINT), 0)
    for places, n in text:
        for k in places:
            if k in hints:
                hints[k] += n
    undone.update(k for k, n in hints.items() if 2 * n > total)
    return [SIDE if (kind := max((v for k, v in b.places.items() if k not in undone), default=0)) == WRAPPER else kind for b in blocks]


def first_pass(blocks: list[Block], rules: BlockRules) -> tuple[list[bool | None], list[int]]:
    """The label of each block by itself and its place: True for main text, False for none, None where it stays open; and its side as undo_marks has it."""
    labels, densities = by_itself(blocks, rules)
    sides = undo_marks(blocks, labels, rules)
    for i, side in enumerate(sides):
        if side == SIDE:
            labels[i] = False
        elif side == HINT and labels[i] is not False:
            labels[i] = densities[i] >= rules.hinted if densities[i] is not None else labels[i] if not blocks[i].heading and len(blocks[i].text) >= rules.short else False
    return labels, sides


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    """The main text of a page: its blocks in order, joined by newlines; empty for a null page or one without text."""
    blocks = blocks_of(page) if page else []
    (decided, sides), n = first_pass(blocks, rules), len(blocks)
    inside, outside = (sum(len(b.text) for b, label in zip(blocks, decided, strict=True) if label and (b.zone > 0) == zone) for zone in (True, False))
    has_zone = inside > 0 and inside >= outside
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for order, into in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            # what is left out for its place says nothing of the text round it
            if decided[i] is not None and sides[i] != SIDE:
                last[blocks[i].zone] = (i, decided[i])
            into[i] = last.get(blocks[i].zone)
    kept = []
    for i, (b, label) in enumerate(zip(blocks, decided, strict=True)):
        if has_zone and not b.zone:
            continue
        if label is None:
            p, q = before[i], after[i]
            if p and q and p[1] != q[1]:
                # a heading goes with what follows, another block with the nearer one
                label = q[1] if b.heading or q[0] - i <= i - p[0] else p[1]
            else:
                label = (p or q)[1] if p or q else True
        if label:
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, keep: list[str], html_column: str = "html", rules: BlockRules = BlockRules()) -> DataFrame:
    """keep of every row of pages, with text and n_chars of its whole page.

    Null and empty pages give an empty text; unclosed tags and cut-off pages are read as far as they go; repeated rows
    give equal rows; other columns of pages play no part.
    """
    if clash := set(keep) & {"text", "n_chars"}:
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    rows = pages.select(*keep, F.col(html_column).cast("string").alias("__html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string, n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h, rules) for (h,) in rows_of(batch, "__html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=[*keep, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
