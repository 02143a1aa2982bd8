"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. What is no text by its nature (scripts, styles, menus, asides, forms, footers,
the page's header, hidden parts) is set aside. Pass one adds up what speaks for and against each other block: its stop-word density,
its length, the share of it that is links, calls to action (buy, subscribe, share) and what the classes, ids and roles
around it say. A clear sum decides; short blocks and those with few stop words mostly stay undecided. Pass two gives them the
label of their nearest decided neighbour, by one sweep forward and one backward. Between equally near neighbours of both
labels a block's own stop words decide. Labels do not cross the border of an article, and in an article
without blocks decided for text the undecided ones are text. Both passes and the cutting take time in proportion to the page.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import ship_package, table

#: The commonest function words of four languages.
STOP_WORDS = frozenset(
    "the of and to a in is was that it for on as with at by from this be are or an not have has he they we you his her its but which were their "
    "der die das und ist ein eine zu den von mit für auf im des dem nicht sich auch es als an er sie wie bei aus nach "
    "le la les de du un une et à est que qui dans pour par sur au avec il elle ne pas ce se plus son sa en "
    "el los las y del una con por no lo su al como más o pero sus esta este son".split()
)
#: Words of calls to action and of notices, in the same languages.
CALL_WORDS = frozenset(
    "accept advertisement advertising agree browser buy cart cheap checkout click consent cookie cookies coupon discount download facebook follow inbox instagram login newsletter policy price prices privacy promo register sale share shipping sign site sponsored subscribe subscription twitter unsubscribe website whatsapp "
    "abonnieren akzeptieren anmelden anzeige datenschutz einwilligung kaufen klicken rabatt teilen warenkorb werbung zustimmen "
    "abonner abonnez acheter acheté cliquez confidentialité partager publicité panier soldes "
    "anuncio carrito comprar compartir descuento haga publicidad suscribirse suscríbete".split()
)
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select".split())
#: Raw elements whose content is no markup: without an end tag they run to the page's end.
PLAIN = frozenset("script style textarea title".split())
#: What can stand in a head, and of this what has content.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
HEAD_RAW = frozenset("noframes noscript script style template title".split())
#: What is no main text by its nature.
DROPPED = frozenset("nav footer aside form menu dialog button".split())
MAIN = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a stray end tag of another element does not close.
FENCE = frozenset("article aside body div dialog footer form header html main menu nav section table td th ul ol".split())
#: Elements that end where the next one of their kind begins.
ITEM = frozenset("p li dt dd option".split())
#: Words of classes, ids and roles. Those of prose that is not the page's own outweigh any density; the weaker ones tip the balance.
FOREIGN = frozenset("ad ads adbox adslot advert adverts advertisement advertising comment commentlist comments complementary consent contentinfo cookie cookies disclaimer disqus footer gdpr navigation newsletter notice replies respond sidebar sponsored".split())
WEAK = frozenset("alert alertdialog banner breadcrumb breadcrumbs dialog menu menubar modal nav navbar notification pager pagination popup promo promoted promotion related reply search share sharing signup skip social sponsor subscribe toolbar widget".split())
OWN = frozenset("article body content entry main post prose story text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?P<odd>/?[a-zA-Z][^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, OPEN = 1, 0, None
#: Kinds of open elements that are counted: set aside, of foreign or weak or own name, and main ones.
ASIDE, STRONG, LIGHT, NAMED, INSIDE = range(5)


@dataclass
class Block:
    """``main``: the number of the article it is in, 0 for none; ``lean``: what the names around it add."""

    text: str
    linked: int
    tag: str
    dropped: bool
    main: int
    lean: int = 0
    label: int | None = None
    words: int = 0
    stops: int = 0
    calls: int = 0
    inherited: int | None = None

    @property
    def density(self) -> float:
        return self.stops / self.words if self.words else 0.0


class _Elements:
    """The open elements: all steps take constant time for each element, but for a binary search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.fences: list[int] = []
        self.open = [0] * 5
        self.links = 0

    def push(self, name: str, kinds: tuple[int, ...]) -> None:
        self.places[name].append(len(self.stack))
        if name in FENCE:
            self.fences.append(len(self.stack))
        for k in kinds:
            self.open[k] += 1
        self.links += name == "a"
        self.stack.append((name, kinds))

    def cut(self, size: int) -> None:
        """Closes all but the first ``size`` elements."""
        while len(self.stack) > size:
            name, kinds = self.stack.pop()
            self.places[name].pop()
            if name in FENCE:
                self.fences.pop()
            for k in kinds:
                self.open[k] -= 1
            self.links -= name == "a"

    def end(self, name: str) -> None:
        """An end tag: closes the last such element, if no fence stands between."""
        at = self.places[name]
        if at and (name in FENCE or not self.fences or at[-1] > self.fences[-1]):
            self.cut(at[-1])

    def make_way(self, name: str) -> None:
        """A start tag: an open paragraph, or item of the same kind, ends where a block or the next item begins."""
        floor = self.fences[-1] + 1 if self.fences else 0
        found = []
        for n in {"p", name} if name in ITEM else ("p",):
            at = self.places[n]
            i = bisect_left(at, floor)
            found += at[i : i + 1]
        if found:
            self.cut(min(found))

    def lean(self) -> int:
        return (-6 if self.open[STRONG] else -3 if self.open[LIGHT] else 0) + (1 if self.open[NAMED] else 0)


def _kinds(name: str, attrs: str, inside_main: bool) -> tuple[int, ...]:
    """What an element's name, classes, id, role and visibility say of all in it."""
    out = {INSIDE} if name in MAIN else set()
    if name in DROPPED or (name == "header" and not inside_main):
        out.add(ASIDE)
    if attrs:
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                out.add(ASIDE)
            elif key in ("class", "id", "role") and name not in ("html", "body", "article", "main"):
                words = set(re.split(r"[^a-z0-9]+", value))
                if words & FOREIGN or "header" in words and not inside_main:
                    out.add(STRONG)
                elif words & WEAK:
                    out.add(LIGHT)
                elif words & OWN:
                    out.add(NAMED)
    return tuple(out)


def _name(m: re.Match) -> tuple[str, bool]:
    """A token's element, empty for other tokens, and whether it is an end tag."""
    name = (m["name"] or re.match(r"/?([a-zA-Z][^\s/>]*)", m["odd"] or "/x")[1]).lower() if m["name"] or m["odd"] else ""
    return name, m["end"] == "/" or (m["odd"] or "").startswith("/")


def _head_end(html: str, at: int) -> int:
    """Where a head with neither end tag nor body ends: at the first text or start tag that can't stand in it."""
    while m := _TOKEN.search(html, at):
        if html[at : m.start()].strip():
            return at
        name, ending = _name(m)
        if name and not ending and name not in HEAD:
            return m.start()
        at = m.end()
        if name in HEAD_RAW and not ending:
            stop = re.compile(rf"</{name}[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else len(html) if name in PLAIN else at
    return at


def _raw_end(html: str, name: str, attrs: str, at: int, lost: set[str]) -> int:
    """Where the content of a raw element that begins at ``at`` ends; ``lost`` are names without a further end tag."""
    if name == "head":
        stop = re.compile(r"</head\s*>|<body\b", re.I).search(html, at)
        if not stop:
            return _head_end(html, at)
        return stop.start() if stop[0].lower().startswith("<body") else stop.end()
    if name in ("svg", "math", "iframe") and attrs.rstrip().endswith("/"):
        return at
    stop = None if name in lost else re.compile(rf"</{re.escape(name)}[\s>]", re.I).search(html, at)
    if not stop:
        lost.add(name)
        # without an end tag: markup goes on as if the element were empty
        return len(html) if name in PLAIN else at
    return stop.end() if html[stop.end() - 1] == ">" else html.find(">", stop.end()) + 1 or len(html)


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of text in order, white space put right, none empty."""
    out: list[Block] = []
    s, parts, linked, tag, main_no = _Elements(), [], 0, "", 0
    lost: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, linked, tag, s.open[ASIDE] > 0, main_no if s.open[INSIDE] else 0, s.lean()))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = unescape(raw)
        parts.append(text)
        if s.links:
            linked += len(text.strip())

    at = 0
    while m := _TOKEN.search(html, at):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name, ending = _name(m)
        if not name:
            continue
        attrs = m["attrs"] or ""
        if name in RAW or name == "head":
            if not ending:
                at = _raw_end(html, name, attrs, at, lost)
                if name not in ("textarea", "math", "svg"):
                    flush()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if ending:
            s.end(name)
            tag = "" if name in BLOCK else tag
            continue
        if name in BLOCK:
            tag = name
        if name in VOID or attrs.rstrip().endswith("/") and name not in BLOCK:
            continue
        if name in ITEM or name in BLOCK:
            s.make_way(name)
        if name in MAIN:
            main_no += s.open[INSIDE] == 0
        s.push(name, _kinds(name, attrs, s.open[INSIDE] > 0))
    if at < len(html):
        add(html[at:])
    flush()
    return out


#: Lengths in characters and stop-word densities from which a block is long, or reads like text.
LONG, VERY_LONG, SOME_STOPS, MANY_STOPS = 70, 200, 0.12, 0.25
#: A sum of at least this decides for text, one below 0 against it.
ENOUGH = 3


def weigh(b: Block, beside_article: bool = False) -> int:
    """What speaks for a block being main text, less what speaks against it."""
    found = _WORD.findall(b.text.lower())
    b.words, b.stops, b.calls = len(found), sum(map(STOP_WORDS.__contains__, found)), sum(map(CALL_WORDS.__contains__, found))
    size = len(b.text)
    total = (size >= LONG) + (size >= VERY_LONG) + (b.density >= SOME_STOPS) + (b.density >= MANY_STOPS) + b.lean
    if b.main:
        total += 1
    elif beside_article or b.text.startswith("©"):
        total -= 3
    if not (b.main and b.tag in HEADING):
        share = b.linked / size
        total -= 6 if share >= 0.9 else 4 if share >= 0.5 else 2 if share >= 0.33 else 0
    if b.calls and b.calls * 20 >= b.words:
        total -= min(4, 2 * b.calls)
    return total


def label(blocks: list[Block]) -> None:
    """Both passes, in place."""
    any_main = any(b.main and not b.dropped for b in blocks)
    regions: dict[int, list[Block]] = defaultdict(list)
    for b in blocks:
        if b.dropped:
            b.label, b.main = BAD, 0
        else:
            total = weigh(b, any_main and not b.main)
            # a heading says nothing of itself; short blocks are text only by their neighbours
            b.label = BAD if total < 0 else GOOD if total >= ENOUGH and len(b.text) >= LONG and b.tag not in HEADING else OPEN
            if b.label is BAD and b.lean < 0:  # of foreign name: no neighbour to the article's own blocks
                b.main = 0
        regions[b.main].append(b)
    for main, part in regions.items():
        prior = main and not any(b.label is GOOD for b in part)
        before, near = [], (len(part) + 1, OPEN)
        for b in part:
            near = (1, b.label) if b.label is not OPEN else (near[0] + 1, near[1])
            before.append(near)
        near = (len(part) + 1, OPEN)
        for b, (ahead, first) in zip(reversed(part), reversed(before), strict=True):
            if b.label is not OPEN:
                near = (1, b.label)
                continue
            near = (near[0] + 1, near[1])
            behind, second = near
            if prior or first is OPEN and second is OPEN:
                found = GOOD
            elif first is OPEN or second is OPEN or first == second:
                found = second if first is OPEN else first
            elif ahead != behind:
                found = first if ahead < behind else second
            else:
                found = GOOD if b.density >= SOME_STOPS or b.tag in HEADING and second == GOOD else BAD
            b.inherited = found
    for b in blocks:
        b.label = b.inherited if b.label is OPEN else b.label


def main_text(html: str | None) -> str:
    """The main text; empty for null, for an empty page and where nothing is left."""
    if not html:
        return ""
    found = blocks_of(html)
    label(found)
    return "\n\n".join(b.text for b in found if b.label == GOOD)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` without ``html`` and with text and n_chars, which replace columns of these names.

    Null and empty pages, and pages where nothing is left, have an empty text of length 0. Each row is judged alone, so
    repeated rows have equal results; an empty table gives no rows. A tie between neighbours is decided as the module says.
    """
    ship_package(df.sparkSession)

    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    out = df.withColumn("_main", F.pandas_udf(texts, "string")(F.col(html)))
    out = out.drop(*{html, "text", "n_chars"})
    return out.withColumn("text", F.col("_main")).withColumn("n_chars", F.length("_main").cast("bigint")).drop("_main")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page (see ``extract`` for nulls, empty pages and repeated rows)."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
