"""Main text of HTML pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)
    |<(?P<raw>script|style|noscript|template|textarea|svg|math|iframe|object|canvas|audio|video|title|xmp)\b(?:"[^"]*"|'[^']*'|[^'">])*>(?:(?<=/>)|.*?(?:</(?P=raw)\s*>|\Z))
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)>
    |<[!?/][^>]*(?:>|\Z)""",
    re.VERBOSE | re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"option", "select", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "head", "html", "body"}
_BOILER_TAGS = frozenset("nav footer aside form button select menu dialog fieldset label datalist".split())
_HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Tags whose own meaning outweighs a word in their class: an article may be called "related", a quotation in it "comment".
_OWN_MEANING = frozenset(("article", "main"))
_TEXT_TAGS = _HEADS | frozenset("p blockquote q cite em strong b i u a span code pre figure figcaption table tbody thead tr td th dl dt dd img abbr mark time small sub sup".split())
#: Words in class, id, role and aria-label that mark what is not article, and what is (fixed values).
_BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion outbrain taboola cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login paywall sidebar side aside menu nav navbar navigation navigationmenu breadcrumb breadcrumbs topbar toolbar masthead header footer copyright legal disclaimer "
    "share sharing social related recommend recommended recommendations trending popular comment comments commentlist reply replies respond disqus discussion form search widget pagination pager skip tags "
    "byline complementary contentinfo dialog alertdialog".split()
)
#: Those that say so on a paragraph or a quotation inside an article too (fixed values).
_SURE_WORDS = frozenset("ad ads adv advert advertisement advertising adsense adslot sponsor sponsored promo promoted promotion outbrain taboola cookie consent gdpr newsletter subscribe share sharing byline copyright".split())
_CONTENT_WORDS = frozenset("article content post entry story main body text".split())
_ENDS = tuple(".!?…:;\"'”’»)。！？")


@dataclass
class Block:
    """A run of text between block boundaries, with what a classifier needs."""

    text: str
    path: tuple[int, ...]
    boiler: int
    content: int
    link_chars: int
    heading: bool


@dataclass
class _Open:
    tag: str
    number: int
    boiler: int
    content: int


@dataclass
class _Page:
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    inside_link: int = 0
    heading: bool = False
    blocks: list[Block] = field(default_factory=list)
    counter: int = 0


def _marks(tag: str, attrs: str, inside: bool) -> tuple[int, int]:
    boiler = 1 if tag in _BOILER_TAGS or (tag == "header" and not inside) else 0
    content = 1 if tag in ("article", "main") else 0
    if attrs and not attrs.isspace():
        for name, value in _ATTR.findall(attrs):
            name = name.lower()
            value = value.strip("\"'")
            if name in ("class", "id", "role", "aria-label"):
                words = {w.lower() for w in _PIECES.findall(value)}
                if name == "role" and value.lower() in ("main", "article"):
                    content += 1
                elif tag not in ("html", "body"):
                    plain = words & _BOILER_WORDS - ({"header", "tags"} if inside or words & _CONTENT_WORDS else set())
                    boiler += bool(plain) and tag not in _OWN_MEANING and not (inside and tag in _TEXT_TAGS and not plain & _SURE_WORDS)
                    content += bool(words & _CONTENT_WORDS) and not words & _BOILER_WORDS
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                boiler += 2
    return boiler, content


def _flush(page: _Page) -> None:
    if page.parts:
        text = " ".join("".join(page.parts).split())
        if text:
            path = tuple(o.number for o in page.stack if o.tag in _BLOCK)
            page.blocks.append(Block(text, path, sum(o.boiler for o in page.stack), sum(o.content for o in page.stack), page.links, page.heading))
        page.parts = []
    page.links, page.heading = 0, False


def _pop(page: _Page, tag: str, limit: frozenset[str] = frozenset()) -> None:
    for i in range(len(page.stack) - 1, -1, -1):
        if page.stack[i].tag == tag:
            page.inside_link -= sum(o.tag == "a" for o in page.stack[i:])
            del page.stack[i:]
            return
        if page.stack[i].tag in limit:
            return


def blocks(source: str) -> list[Block]:
    """The text blocks of a page in order; scripts, styles, comments and the head's title are no blocks."""
    page = _Page()
    at = 0

    def text(piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            page.parts.append(piece)
            if page.inside_link:
                page.links += len(piece)
            if not page.heading and any(o.tag in _HEADS for o in page.stack):
                page.heading = True

    for m in _TOKEN.finditer(source):
        text(source[at : m.start()])
        at = m.end()
        tag = (m.group("tag") or "").lower()
        if not tag:
            continue
        if tag in ("br", "hr", "wbr", "img"):
            if tag == "hr":
                _flush(page)
            elif tag != "wbr":
                page.parts.append(" ")
            continue
        if m.group("end"):
            if tag in _BLOCK:
                _flush(page)
                _pop(page, tag)
            else:
                _pop(page, tag, _BLOCK)
            continue
        if tag in _BLOCK:
            _flush(page)
            if tag in _CLOSES_P:
                _pop(page, "p", frozenset(("td", "th", "table", "article", "section", "div", "aside", "nav", "body", "footer", "header", "main")))
            if tag in ("li", "dt", "dd", "option"):
                _pop(page, tag, frozenset(("ul", "ol", "dl", "select", "menu")))
            elif tag in ("td", "th", "tr"):
                _pop(page, tag, frozenset(("table",)))
        if tag in _VOID or m.group("attrs").endswith("/"):
            continue
        page.counter += 1
        inside = any(o.content for o in page.stack)
        page.stack.append(_Open(tag, page.counter, *_marks(tag, m.group("attrs"), inside)))
        page.inside_link += tag == "a"
    rest = source[at:]
    cut = re.search(r"<[a-zA-Z/!][^>]*\Z", rest)  # a tag cut off at the end of the page
    text(rest[: cut.start()] if cut else rest)
    _flush(page)
    return page.blocks


#: Neighbours bind each other so strongly, at most, on either side; a doubtful block follows its neighbours.
BIND = 1.5


def score(block: Block) -> float:
    """Log-odds that a block is article text: a linear classifier with fixed weights.

    Marks (of tags and classes) weigh less than they would alone, for the neighbours' marks come in over the edges.
    """
    words = block.text.count(" ") + 1
    s = -0.5
    s += 3.0 * min(block.content, 1) - 5.5 * min(block.boiler, 2)
    s += 1.5 if words >= 10 else 0.0 if words >= 4 else -0.5
    s += 0.5 if block.text.endswith(_ENDS) else 0.0
    s += 1.0 if block.heading else 0.0
    s -= 3.0 if block.link_chars > 0.5 * len(block.text) else 0.0
    return s


def proximity(a: Block, b: Block) -> float:
    """Smoothness between two blocks: more for a common parent, less the farther apart in the tree, little across the border of a marked part."""
    common = 0
    for x, y in zip(a.path, b.path):
        if x != y:
            break
        common += 1
    if (a.boiler > 0) != (b.boiler > 0):  # a mark begins or ends between them
        return 0.1
    return BIND * (0.2 + 0.8 * 2 * common / (len(a.path) + len(b.path) or 1)) if common else 0.1


def min_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side of a minimum cut.

    A positive gain is the capacity from the source, a negative one to the sink;
    edges bind both ways.  Augmenting paths are found breadth first.  On a tie the
    node is on the sink side.
    """
    n = len(gains)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, forth: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forth)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gains):
        if g > 0:
            add(source, i, g, 0.0)
        elif g < 0:
            add(i, sink, -g, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    while True:
        via = {source: -1}
        queue = deque([source])
        while queue and sink not in via:
            x = queue.popleft()
            for e in heads[x]:
                if room[e] > 1e-9 and to[e] not in via:
                    via[to[e]] = e
                    queue.append(to[e])
        if sink not in via:
            return [i in via for i in range(n)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow


def main_text(source: str | None) -> str:
    """The article of a page: its blocks on the content side of the cut, joined by empty lines."""
    found = blocks(source or "")
    if not found:
        return ""
    gains = [score(b) for b in found]
    edges = [(i, i + 1, proximity(found[i], found[i + 1])) for i in range(len(found) - 1)]
    last: dict[tuple[int, ...], int] = {}
    for i, b in enumerate(found):  # the block before under the same parent, if others lie between
        parent = b.path[:-1]
        if parent in last and last[parent] < i - 1 and (found[last[parent]].boiler > 0) == (b.boiler > 0):
            edges.append((last[parent], i, 0.5 * BIND))
        last[parent] = i
    # components of the cut: only where neighbours disagree can the cut differ from the signs
    if all(g > 0 for g in gains) or all(g < 0 for g in gains):
        keep = [g > 0 for g in gains]
    else:
        keep = min_cut(*_trimmed(gains, edges))
    return "\n\n".join(b.text for b, k in zip(found, keep) if k)


def _trimmed(gains: list[float], edges: list[tuple[int, int, float]]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Edges between nodes whose own gain outweighs all their edges bind nothing and are left out, which keeps the flow small."""
    bound = [0.0] * len(gains)
    for a, b, w in edges:
        bound[a] += w
        bound[b] += w
    fixed = [abs(g) > s for g, s in zip(gains, bound)]
    kept = [(a, b, w) for a, b, w in edges if not (fixed[a] and fixed[b])]
    return gains, kept


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` (without the html) plus ``text`` and ``n_chars`` (its code points).

    Null and empty pages give an empty text, repeated rows the same text each, an empty table an empty table.  Columns named text or n_chars give way.
    """
    kept = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html_column}`").cast("string").alias("text"), F.lit(0).cast("long").alias("n_chars"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 2).to_pylist()]
            columns = [*batch.columns[:-2], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)
