"""The main text of web pages by two-pass block rules.

A page is read once, tag by tag, into blocks of text, each with the length of
its text inside links and what its enclosing elements say. The first pass
decides the clear blocks by their markup, length, link density and stop-word
density; the second gives each ambiguous block the label of its nearest
decided neighbours. Everything is per page, so no shuffle is needed."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Function words of each language, for the share of them in a block.
STOP_WORDS = {
    "en": "the of and a to in is was that for it with as on be at by this are or from not have an but which were has they his her you we their been if would there what so can will about",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei sie nach wird einer um am sind noch wie einem über so zum war haben nur oder aber",
    "fr": "de la le et les des en un une du dans est que qui pour par au sur pas plus avec ce il elle sont aux se ne son sa ou mais comme nous vous ont été cette ces leur",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este entre cuando muy ser son también fue",
}
#: Elements whose text is never shown as text.
RAW = ("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul select button option noscript template svg object video audio canvas".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements outside the main text, whatever they hold.
BOILER = frozenset("nav aside footer menu dialog button select noscript template svg object video audio canvas head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of a class or id that say the same.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored promo promotion promotions sidebar nav navbar navigation menu menubar breadcrumb breadcrumbs footer comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager copyright disclaimer search teaser teasers masthead topbar subnav feedback".split()
)
MAIN_NAMES = frozenset("content main article post entry story main-content article-body article-content post-body post-content entry-content story-body".split())
MODIFIERS = ("no", "has", "with", "without", "hide", "show", "is")
#: An open element ends when one of these starts, unless the boundary lies between them.
SIBLINGS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}
CUES = re.compile(r"©|\(c\) ?(?:19|20)\d\d|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|\bcookies?\b|privacy policy|newsletter|\badvertisement\b|\bsign up\b|\bsubscribe\b", re.I)

_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_FOREIGN = re.compile(r"[^\W\d_\x00-\u024f]")
#: The languages of a stop word, as bits.
_MASK: dict[str, int] = {}
for _k, _words in enumerate(STOP_WORDS.values()):
    for _w in _words.split():
        _MASK[_w] = _MASK.get(_w, 0) | 1 << _k

#: Characters from which a block is not short, and from which it is long; shares of stop words and of text in links.
SHORT, LONG = 70, 140
LOW, HIGH = 0.12, 0.25
LINKED, HALF = 0.2, 0.5


@dataclass(slots=True)
class Block:
    text: str
    linked: int  # characters inside links
    boiler: bool  # by its markup
    scope: int  # number of the outermost main container, 0 outside
    heading: bool
    label: str = ""


@dataclass(slots=True)
class _Open:
    """An element that is open."""

    tag: str
    boiler: bool
    scope: int
    header: bool
    form: bool


@dataclass(slots=True)
class _Reader:
    """Collects blocks while tags are read."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", False, 0, False, False)])
    open: Counter = field(default_factory=Counter)
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    link: int = 0  # the depth of the stack at which a link was opened
    scopes: int = 0

    def text(self, raw: str) -> None:
        self.pieces.append(raw)
        if self.link:
            self.linked.append(raw)

    def space(self) -> None:
        self.pieces.append(" ")

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                top = self.stack[-1]
                heading = any(e.tag in HEADINGS for e in self.stack[-3:])
                linked = len(" ".join(html.unescape("".join(self.linked)).split())) if self.linked else 0
                self.blocks.append(Block(text, min(linked, len(text)), top.boiler or (top.header and not (heading and top.scope)) or top.form, top.scope, heading))
            self.pieces, self.linked = [], []

    def pop(self, depth: int) -> None:
        for e in self.stack[depth:]:
            self.open[e.tag] -= 1
        del self.stack[depth:]
        if self.link > depth:
            self.link = 0

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        elif tag in BLOCKS:
            self.end_block()
            if self.open[tag]:
                self.pop(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i].tag == tag))
        elif tag in ("td", "th"):
            self.space()

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = len(self.stack) if "href" in attributes.lower() else 0
        elif tag in BLOCKS:
            self.end_block()
            if self.stack[-1].tag == "p" or (tag in HEADINGS and self.stack[-1].tag in HEADINGS):
                self.pop(len(self.stack) - 1)
            if tag in SIBLINGS:
                group, boundary = SIBLINGS[tag]
                for i in range(len(self.stack) - 1, 0, -1):
                    if self.stack[i].tag in boundary:
                        break
                    if self.stack[i].tag in group:
                        self.pop(i)
                        break
            self.stack.append(self.opened(tag, attributes))
            self.open[tag] += 1
        elif tag == "hr":
            self.end_block()
        elif tag in ("br", "td", "th"):
            self.space()

    def opened(self, tag: str, attributes: str) -> _Open:
        top = self.stack[-1]
        boiler, header, main, form = top.boiler or tag in BOILER, top.header or tag == "header", tag in ("article", "main"), top.form or tag == "form"
        if attributes.strip(" \t\r\n\f/") and tag not in ("html", "body"):
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            names = html.unescape(f"{found.get('class', '')} {found.get('id', '')}").split()
            role = found.get("role", "").lower()
            words = {w for name in names for w in _told(name)}
            boiler = boiler or role in BOILER_ROLES or bool(words & BOILER_WORDS) or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))
            header = header or "header" in words
            main = main or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" or any(n.lower() in MAIN_NAMES for n in names)
        scope = top.scope
        if main and not boiler and not scope:
            self.scopes += 1
            scope = self.scopes
        return _Open(tag, boiler, scope, header, form and not (main and scope))


def _told(name: str) -> list[str]:
    """Words of a class or id; of ``no-sidebar`` and the like, none."""
    words = [w.lower() for w in _PARTS.findall(name)]
    return [w for i, w in enumerate(words) if not (i and words[i - 1] in MODIFIERS)]


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in their order. Comments, scripts and styles give
    none; an element without an end tag ends with the one around it."""
    reader, at = _Reader(), 0
    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            break
        if tag.start() > at:
            reader.text(page[at : tag.start()])
        at, name = tag.end(), (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            reader.close(name)
        elif name in _RAW_END:
            ended = _RAW_END[name].search(page, at)
            at = ended.end() if ended else len(page)
        else:
            reader.start(name, tag[3] or "")
    reader.text(page[at:])
    reader.end_block()
    return reader.blocks


def stop_share(text: str) -> float | None:
    """The share of stop words among a text's words, in the language in which
    it is largest; None if most letters are of another script than theirs."""
    words = _WORD.findall(text.lower())
    if not words:
        return 0.0
    if not text.isascii() and len(_FOREIGN.findall(text)) * 2 > sum(map(len, words)):
        return None
    found = Counter(map(_MASK.get, words))
    del found[None]
    return max(sum(n for mask, n in found.items() if mask >> k & 1) for k in range(len(STOP_WORDS))) / len(words)


def first_pass(block: Block) -> str:
    """good, bad, near (ambiguous, with stop words) or short (ambiguous)."""
    n, share = len(block.text), block.linked / len(block.text)
    if block.boiler:
        return "boiler"
    if share > HALF:
        return "short" if block.heading else "bad"
    if not block.scope and n < 300 and CUES.search(block.text):
        return "bad"
    if block.heading:
        return "short"
    if n < SHORT:
        return "bad" if share > LINKED else "short"
    stops = stop_share(block.text)
    if stops is None or stops >= HIGH:
        return "good" if n >= LONG else "near"
    if stops >= LOW:
        return "near"
    return "short" if block.scope else "bad"


def second_pass(blocks: list[Block]) -> None:
    """Gives the ambiguous blocks of one scope the label of the nearest
    decided blocks. The edges of a main container count as good, and there a
    block goes only if both sides are bad; the edges of a page count as bad."""
    if not blocks:
        return
    main = bool(blocks[0].scope)
    decided = ("good", "bad") if main else ("good", "bad", "boiler")
    edge = "good" if main else "bad"
    n = len(blocks)
    before, after = [(edge, 1)] * n, [(edge, 1)] * n
    for side, order, step in ((before, range(n), -1), (after, range(n - 1, -1, -1), 1)):
        for i in order:
            j = i + step
            if 0 <= j < n:
                label = blocks[j].label
                side[i] = ("good" if label == "good" else "bad", 1) if label in decided else (side[j][0], side[j][1] + 1)
    chosen = []
    for i, block in enumerate(blocks):
        (left, far), (right, near) = before[i], after[i]
        if block.label in ("good", "bad", "boiler"):
            chosen.append(block.label)
        elif left == right:
            chosen.append(left)
        elif main or block.label == "near":
            chosen.append("good")
        elif block.heading:
            chosen.append(right)
        else:
            chosen.append(left if far < near else right if near < far else "bad")
    for block, label in zip(blocks, chosen, strict=True):
        block.label = label


def main_text(page: str) -> str:
    """The main text of a page: its good blocks, joined by two line feeds.

    If containers of main text (``article``, ``main`` and the like) hold any,
    they hold all of it, unless the good text outside is four times as long.
    On a page without a good block, the stop words of shorter ones decide."""
    blocks = blocks_of(page)
    for block in blocks:
        block.label = first_pass(block)
    if not any(b.label == "good" for b in blocks):
        for block in blocks:
            block.label = "good" if block.label == "near" else block.label
    inside = sum(len(b.text) for b in blocks if b.scope and b.label not in ("boiler", "bad"))
    outside = sum(len(b.text) for b in blocks if not b.scope and b.label == "good")
    if inside and outside <= 4 * inside:
        blocks = [b for b in blocks if b.scope]
        for scope in sorted({b.scope for b in blocks}):
            second_pass([b for b in blocks if b.scope == scope])
    else:
        for block in blocks:
            if block.scope and block.label != "boiler":
                block.scope = 0
                block.label = "good" if block.label == "good" else first_pass(block)
        second_pass(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, *, markup: str = "html", carry: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """One row per row of ``pages``: the columns ``carry``, text and n_chars.

    text is the page's main text: blocks in page order, joined by two line
    feeds; character references are decoded and white space inside a block is
    one space. Menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles and reader comments are left out. n_chars counts its code
    points. A null or empty page, and one without main text, gives an empty
    text; repeated rows each give theirs; an empty table gives an empty
    result; other columns are not read. Work is linear in a page's length,
    and a task holds one batch of pages."""
    fields = [pages.schema[c] for c in carry]
    kept = [f"_of_{c}" for c in carry]
    schema = T.StructType([*(T.StructField(k, f.dataType) for k, f in zip(kept, fields, strict=True)), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) if page else "" for page in batch["_html"].to_pylist()]
            arrays = [*(batch[k] for k in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "text", "n_chars"])

    out = pages.select(F.col(markup).alias("_html"), *(F.col(c).alias(k) for c, k in zip(carry, kept, strict=True))).mapInArrow(work, schema)
    return out.select(*(F.col(k).alias(c) for c, k in zip(carry, kept, strict=True)), "text", "n_chars")
