"""Main text of web pages by two passes of block rules.

A page becomes blocks of text with what they stand in. The first pass classifies each block by itself: by its link
density, its length and the share of stop words, judged by a list for the page's language. Blocks that are too short to
tell are left open; the second pass gives an open block the label of its nearest decided neighbours, of both if they
agree, of the nearer if not. Elements and class names are features of the first pass: they move a block by a step or, if
they name what a page has around its text, by all; unless they hold most of the page's good blocks, for then they are
not what they are called.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Common function words of the languages that are told apart; fixed values of these languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just those people too mr how",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei ich wir ihr was unter wenn kann gegen vom können schon",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la mais avec ou son leur si dans elle deux ont été aux cette ses comme tout nous sa fait bien être peut même entre je y on sans ces vous après dont lui",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora",
}
_STOPS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}
_ANY_STOP = frozenset().union(*_STOPS.values())

LENGTH_LOW, LENGTH_HIGH = 70, 200
LINK_DENSITY = 0.33
STOP_LOW, STOP_HIGH = 0.08, 0.16

#: Elements whose text is no text of the page.
_RAW = frozenset("script style noscript template svg iframe object canvas audio video head title".split())
#: Elements that only hold what surrounds the main text, and form controls.
_CHROME = frozenset("nav header footer aside form menu dialog button select option input textarea label fieldset datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul br".split()
)
_LISTS = frozenset("ul ol dl table".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What ends an open paragraph, and what an item of a list or table ends.
_ENDS_P = _BLOCK - {"br", "option", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_KEEPS = {"ul", "ol", "table", "dl", "select", "td", "th", "article", "section", "div", "nav", "aside", "main"}
#: Words in class names, ids and roles that name what is around the main text.
_STRONG_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|adsense|banner\w*|sponsor\w*|promo\w*|sidebar\w*|nav\w*|menu\w*|breadcrumb\w*|footer\w*|header|masthead|topbar|toolbar|comment\w*|disqus\w*|respond|replies|cookie\w*|consent\w*|gdpr|popup\w*|modal\w*|newsletter\w*|subscribe\w*|signup|login|share\w*|sharing|social\w*|related\w*|recommend\w*|widget\w*|pagination|pager|paging|search\w*|tagcloud|copyright|disclaimer|skip\w*|hidden|byline-share|complementary|contentinfo|navigation|dialog)(?:$|[\s_-])",
    re.I,
)
#: Words that name it often, but main text too.
_WEAK_NAME = re.compile(r"(?:^|[\s_-])(?:side|foot|tags?|legal|notice\w*|alert|overlay|form|reply)(?:$|[\s_-])", re.I)
#: What readers wrote stays out however much of it there is.
_COMMENT_NAME = re.compile(r"(?:^|[\s_-])(?:comment\w*|disqus\w*|respond|replies)(?:$|[\s_-])", re.I)
#: Names of layouts, which say what else a page has, and of headers, which an article has too.
_LAYOUT_NAME = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without)[-_]\S+", re.I)
_HEADER_NAME = re.compile(r"\bheader\b|(?<=[_-])header(?=$|[\s_-])|(?:^|(?<=\s))header(?=[_-])", re.I)
_MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|main|post|entry|story|body)(?:$|[\s_-])", re.I)

#: Words that also stand in names of other things (tag-economy, comment-open, side-by-side): boilerplate only as a whole
#: name. Other words of such a name still count (side-nav), and comment-list or comment-body name comments.
_WHOLE_NAME = re.compile(r"(?:^|(?<=\s))(?:tags?|side|legal)(?=[_-])|(?<=[_-])(?:tags?|side|legal)(?=$|[\s_-])|(?:^|(?<=\s))comment-(?:open|closed|status\S*)(?=$|\s)", re.I)

_NO_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ENDS_OR_QUOTES = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"\s+")


@dataclass(eq=False)
class Mark:
    """An element that is named as boilerplate, the next such element around it, and whether its name is beyond doubt."""

    around: Mark | None
    depth: int
    sure: bool
    held: int = 0  # code points of good text in it
    wrong: bool = False  # it and all around it are not what they are called


@dataclass
class Block:
    """A run of text without a block boundary inside, and what holds it."""

    text: str = ""
    linked: int = 0  # code points in links
    links: int = 0
    mark: Mark | None = None  # the innermost element named as boilerplate
    weak: bool = False
    main: bool = False
    heading: bool = False
    item: bool = False
    group: int = 0  # the list or table that it is an item of
    label: str = field(default="", compare=False)

    def kept(self) -> bool:
        return self.mark is None or self.mark.wrong


class _TagEnds:
    """Where tags end. A tag runs to the first > outside quotes, or to the page's end; with an open quote it is none.

    What follows a > or quote met outside quotes is the same for whichever tag meets it, so it is looked at once.
    """

    def __init__(self, page: str):
        self.page, self.known = page, {}
        self.asked = self.met = -1  # from asked to met there is no > and no quote

    def __call__(self, at: int) -> int:
        """The place of the end of a tag whose name ends at this place; -1: none."""
        if not self.asked <= at <= self.met:
            self.asked, self.met = at, self._next(at)
        at, passed = self.met, []
        while at < len(self.page) and at not in self.known:
            passed.append(at)
            if self.page[at] == ">":
                self.known[at] = at
                break
            close = self.page.find(self.page[at], at + 1)
            if close < 0:
                self.known[at] = -1
                break
            at = self._next(close + 1)
        end = self.known.get(at, at)
        self.known.update(dict.fromkeys(passed, end))
        return end

    def _next(self, at: int) -> int:
        found = _ENDS_OR_QUOTES.search(self.page, at)
        return found.start() if found else len(self.page)


_HEADINGS, _ITEMS = ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "td", "th", "dt", "dd")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text in them, in page order; a damaged page is read as far as it goes."""
    out: list[Block] = []
    # Open elements: name, its mark if it is boilerplate by name, whether it is so weakly, whether main text begins here.
    stack: list[tuple[str, bool, bool, bool]] = []
    where: dict[str, list[int]] = {}  # the places of the open elements of each name
    groups: list[int] = []  # for each open list or table its number
    marks: list[Mark] = []
    weak = main = links = seen = 0
    tag_end, no_end = _TagEnds(page), set()
    parts: list[str] = []
    linked = met = 0
    at, size = 0, len(page)

    def close_block() -> None:
        nonlocal linked, met
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                heading, item = (any(map(where.get, names)) for names in (_HEADINGS, _ITEMS))
                out.append(Block(text, min(linked, len(text)), met, marks[-1] if marks else None, bool(weak), bool(main), heading, item, groups[0] if groups else 0))
            parts.clear()
        linked = met = 0

    def pop() -> None:
        nonlocal weak, main, links
        name, mark, w, m = stack.pop()
        where[name].pop()
        if name in _LISTS:
            groups.pop()
        if mark:
            marks.pop()
        weak, main, links = weak - w, main - m, links - (name == "a")

    def close_to(place: int) -> None:
        while len(stack) > place:
            pop()

    def nearest(names: set[str]) -> int:
        """The place of the innermost open element of these names; -1: none."""
        return max((where[n][-1] for n in names if where.get(n)), default=-1)

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(_SPACE.sub(" ", html.unescape(text)).strip())

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        if m := _NO_TAG.match(page, lt):
            at = m.end()
            continue
        m = _TAG.match(page, lt)
        end = tag_end(m.end()) if m else -1
        if end < 0:
            add("<")
            at = lt + 1
            continue
        at, name, rest = min(end + 1, size), m[2].lower(), page[m.end() : end]
        if m[1]:
            if name in _BLOCK:
                close_block()
            if where.get(name):
                close_to(where[name][-1])
            continue
        if name in _RAW:
            if not rest.rstrip().endswith("/") or name in ("script", "style", "title"):
                if name == "head":
                    continue  # what it holds is met by itself
                close = None if name in no_end else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if close is None:
                    no_end.add(name)
                at = close.end() if close else (size if name in ("script", "style") else at)
            continue
        if name in _BLOCK:
            close_block()
        if name in _ENDS_P and where.get("p"):
            close_to(where["p"][-1])
        if name in _SIBLING:
            sibling, keeps = nearest(_SIBLING[name]), nearest(_KEEPS)
            if sibling >= 0 and sibling >= keeps:
                close_to(sibling)
        if name in _VOID or rest.endswith("/") and name not in _BLOCK:
            continue
        given = _attributes(rest)
        called = _LAYOUT_NAME.sub(" ", " ".join(given.get(k, "") for k in ("class", "id", "role", "itemprop")))
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        article = name in ("article", "main") or bool(called.strip() and _MAIN_NAME.search(called))
        named = _WHOLE_NAME.sub(" ", called) if called.strip() and name not in ("html", "body", "article", "main") else ""
        bad = hidden or name in _CHROME or bool(named and _STRONG_NAME.search(named))
        if bad and main and not marks and (name == "header" or name not in _CHROME and not _STRONG_NAME.search(_HEADER_NAME.sub(" ", named))):
            bad = hidden  # an article's own headline
        w = bool(named and _WEAK_NAME.search(named))
        where.setdefault(name, []).append(len(stack))
        stack.append((name, bad, w, article and not bad))
        if name in _LISTS:
            seen += 1
            groups.append(seen)
        if bad:
            marks.append(Mark(marks[-1] if marks else None, len(marks), bool(hidden or _COMMENT_NAME.search(named))))
        weak, main, links, met = weak + w, main + (article and not bad), links + (name == "a"), met + (name == "a")
    close_block()
    return out


def density(b: Block, stops: frozenset[str]) -> str:
    """A block's class by its text alone: good, near (to good), short (open) or bad."""
    words = b.text.lower().split()
    share = sum(w.strip(".,;:!?()\"'") in stops for w in words) / len(words)
    if b.linked > LINK_DENSITY * len(b.text) or b.text[:1] == "©" or re.match(r"(?i)copyright\b", b.text):
        return "bad"
    if len(b.text) < LENGTH_LOW:
        return "short" if share or not b.linked else "bad"
    if share >= STOP_HIGH or share >= STOP_LOW and len(b.text) > LENGTH_HIGH:
        return "good"
    return "near" if share >= STOP_LOW else "bad"


_STEP_DOWN = {"good": "near", "near": "short", "short": "bad", "bad": "bad"}


def _neighbours(page: list[Block], default: str) -> Iterator[tuple[Block, str, int, str, int]]:
    """Each block with the labels of the nearest decided ones before and after it, and how far they are."""
    after, label, far = [], default, len(page)
    for n in range(len(page) - 1, -1, -1):
        after.append((label, far - n))
        if page[n].label in ("good", "bad"):
            label, far = page[n].label, n
    label, far = default, -1
    for n, (b, (right, e)) in enumerate(zip(page, reversed(after), strict=True)):
        decided = b.label if b.label in ("good", "bad") else None
        yield b, label, n - far, right, e
        if decided:
            label, far = decided, n


def _marks(page: list[Block]) -> list[Mark]:
    """All marked elements around blocks of a page, outer ones first; none holds anything yet."""
    found: dict[Mark, None] = {}
    for b in page:
        m = b.mark
        while m and m not in found:
            found[m] = None
            m.held, m = 0, m.around
    return sorted(found, key=lambda m: m.depth)


def classify(page: list[Block], language: str | None = None) -> list[Block]:
    """Label the blocks good or bad."""
    if language and language[:2].lower() in _STOPS:
        stops = _STOPS[language[:2].lower()]
    else:  # the list that most of the page's words are in
        words = Counter(w for b in page for w in b.text.lower().split())
        stops = max(_STOPS.values(), key=lambda s: sum(words[w] for w in s)) if language is None else _ANY_STOP
    for b in page:
        b.label = density(b, stops)
    # How much good text each marked element, main elements and the page hold.
    within = whole = 0
    marks = _marks(page)
    for b in page:
        if b.label == "good":
            if b.mark:
                b.mark.held += len(b.text)
            within += len(b.text) * (b.main and not b.mark)
            whole += len(b.text)
    for m in reversed(marks):
        if m.around:
            m.around.held += m.held
    for m in marks:
        m.wrong = not m.sure and not within and 2 * m.held > whole and (m.around is None or m.around.wrong)
    inside = [b for b in page if b.main and b.kept()]
    has_main = bool(inside) and 2 * within >= sum(len(b.text) for b in page if b.label == "good" and b.kept())
    # A list or table is navigation if all of it is short links, two at least.
    items: dict[int, list[bool]] = {}
    for b in page:
        if b.group and b.kept():
            items.setdefault(b.group, []).append(b.item and b.linked > 0.9 * len(b.text) and len(b.text.split()) < 8)
    navigation = {g for g, links in items.items() if len(links) > 1 and all(links)}
    for b in page:
        if not b.kept() or b.group in navigation:
            b.label = "bad"
            continue
        if b.weak:
            b.label = _STEP_DOWN[b.label] if b.label != "bad" and len(b.text) >= LENGTH_LOW else "bad"
        elif b.main and b.label == "bad" and (b.links < 2 or b.item):
            b.label = "short"  # few stop words, or one link: an article's tables, lists and lines of code
        if has_main and not b.main:
            b.label = _STEP_DOWN[b.label]
    # Second pass, by the labels of the first. Within main text what is open is bad only between bad ones.
    found = []
    for b, left, _, right, _ in _neighbours([b for b in inside if b.label != "bad" or b.group not in navigation and b.kept()], "good"):
        if b.label in ("near", "short"):
            found.append((b, "bad" if left == right == "bad" else "good"))
    for b, left, d, right, e in _neighbours(page, "bad"):
        if b.main and b.kept():
            continue
        if b.label == "near":
            found.append((b, "good" if left == right == "good" or not has_main and "good" in (left, right) else "bad"))
        elif b.label == "short":
            found.append((b, "good" if b.heading and right == "good" else left if left == right or d < e else right))
    for b, label in found:
        b.label = label
    return page


_LANG = re.compile(r"<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2})", re.I)


def main_text(page: str | None) -> str:
    """The main text of a page: its good blocks, joined by one space."""
    if not page:
        return ""
    lang = _LANG.search(page)
    return " ".join(b.text for b in classify(blocks(page), lang and lang[1]) if b.label == "good")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for every row of pages (page_id, url, html; others are not read).

    Null and empty html give an empty text; null ids and urls are kept; equal rows give equal rows; pages of any length
    are read whole, in time in proportion to it. Each row stands alone: nothing is shuffled.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(rows, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
