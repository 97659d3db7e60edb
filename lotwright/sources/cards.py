"""Cards and label/value pairs from listing pages, by a rule of elements and classes."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import extract as extraction

#: Encodings that a saved page is tried in, in this order; the last replaces what it cannot read.
ENCODINGS = ("utf-8", "cp1251", "latin-1")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Tree(HTMLParser):
    """A small tree: nodes are [name, attributes, children, text pieces]."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.open[-1][0] not in ("script", "style"):
            self.open[-1][2].append(data)


def walk(node):
    todo = [node]
    while todo:
        at = todo.pop()
        yield at
        todo.extend(c for c in reversed(at[2]) if isinstance(c, list))


def find(node, tag: str | None = None, cls: str | None = None) -> list:
    return [n for n in walk(node) if n is not node and (tag is None or n[0] == tag) and (cls is None or cls in (n[1].get("class") or "").split())]


def words(node) -> str:
    parts, todo = [], [node]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            parts.append(at)
        else:
            todo.extend(reversed(at[2]))
    return " ".join(" ".join(parts).split())


def definitions(page: str) -> dict[str, str]:
    """The label/value pairs of dl lists."""
    root, out = Tree(page).root, {}
    for dl in find(root, "dl"):
        label = None
        for n in walk(dl):
            if n[0] == "dt":
                label = words(n)
            elif n[0] == "dd" and label:
                out.setdefault(label, words(n))
                label = None
    return out


def lot_cards(page: str) -> list[dict]:
    """Cards of a listing: those in a container, else any; a card needs an identifier or a link."""
    root, out = Tree(page).root, []
    found = [c for box in find(root, "div", "lot_container") for c in find(box, "div", "lot")] or find(root, "div", "lot") or find(root, None, "ty-grid-list__item")
    for card in found:
        links = [a for a in find(card, "a") if a[1].get("href")]
        link = links[0] if links else None
        prices = find(card, None, "current_price") or find(card, None, "ty-price-num")
        pictures = [i[1].get("data-src") or i[1].get("src") for i in find(card, "img")]
        ident = card[1].get("data-id") or (link[1]["href"].rstrip("/").rsplit("/", 1)[-1] if link else None)
        if ident:
            out.append({"ident": ident, "url": link[1]["href"] if link else None, "title": words(link) if link else None, "price_text": words(prices[0]) if prices else None, "images": [p for p in pictures if p]})
    return out


# The classes of a catalogue's cards, and the least length of a link's text that names a lot.
PRODUCT_CARD, PRODUCT_TITLE, PRODUCT_PRICE, PRODUCT_CODE, PRODUCT_IMAGES, PAGINATOR = "ty-grid-list__item", "product-title", "ty-price-num", "ty-grid-list__product-code", ("ty-pict", "cm-image"), "ty-pagination"
LOT_PATH, LEAST_TITLE = "/new/public/lots/lot/", 20


def product_cards(page: str) -> list[dict]:
    """Cards of a catalogue of products, each product once: the id of its link or else of its form, title, price, code, pictures."""
    out: dict[str, dict] = {}
    for card in find(Tree(page).root, None, PRODUCT_CARD):
        link = next((a for a in find(card, "a", PRODUCT_TITLE) if "products.view" in (a[1].get("href") or "")), None)
        if link is None:
            continue
        said = re.search(r"[?&]product_id=(\d+)", link[1]["href"])
        field = next((i[1].get("value") for i in find(card, "input") if "[product_id]" in (i[1].get("name") or "")), None)
        ident = said.group(1) if said else field
        first = lambda cls: next((words(n) for n in find(card, None, cls)), None)  # noqa: B023, E731
        pictures = [i[1].get("src") or i[1].get("data-src") or "" for i in find(card, "img") if set((i[1].get("class") or "").split()) & set(PRODUCT_IMAGES)]
        if ident:
            kept = list(dict.fromkeys(p.strip() for p in pictures if p.strip() and not p.strip().startswith("data:")))
            out.setdefault(ident, {"ident": ident, "url": link[1]["href"], "title": " ".join((link[1].get("title") or words(link)).split()), "price_text": first(PRODUCT_PRICE), "code": first(PRODUCT_CODE), "images": kept})
    return list(out.values())


def lot_links(page: str) -> list[dict]:
    """Links to lots of a page without known cards, each lot once, with the text of the element around them; short texts name none."""
    out: dict[str, dict] = {}
    for box in walk(Tree(page).root):
        for a in box[2]:
            url = a[1].get("href") or "" if isinstance(a, list) and a[0] == "a" else ""
            said = re.search(r"/lot/([^/?#]+)", url)
            if LOT_PATH in url and said and len(words(a)) >= LEAST_TITLE:
                out.setdefault(said.group(1), {"ident": said.group(1), "url": url, "title": words(a), "text": words(box)})
    return list(out.values())


def page_numbers(page: str) -> list[int]:
    """The page numbers that a catalogue's paginator links to."""
    found = [re.search(r"[?&]page=(\d+)", a[1].get("href") or "") for box in find(Tree(page).root, None, PAGINATOR) for a in find(box, "a")]
    return sorted({int(m.group(1)) for m in found if m})


def found_articles(page: str) -> list[dict]:
    """Articles of a search page that link to a lot: the link without its fragment, and the article's text."""
    out = []
    for article in find(Tree(page).root, "article"):
        links = [(a[1].get("href") or "").split("#")[0] for a in find(article, "a")]
        lot = next((u for u in links if re.fullmatch(r"(?:https?://[^/]+)?/lot/\d+/?(?:\?.*)?", u)), None)
        if lot:
            out.append({"url": lot, "text": words(article)})
    return out


def lot_page(page: str) -> dict:
    """A lot's page: the pictures of its gallery's JSON, each once, the addresses it links to, the procedure's number."""
    root = Tree(page).root
    box = next((n for n in walk(root) if n[1].get("id") == "lot-gallery" and "data-gallery" in n[1]), None)
    try:
        items = json.loads(box[1]["data-gallery"] or "[]") if box else []
    except ValueError:
        items = []
    shown = [i.get("url") or i.get("src") for i in items if isinstance(i, dict)] if isinstance(items, list) else []
    number = re.search(r"\b[A-Z0-9]{7,12}-\d{4}-\d{4}-\d\b", words(root))
    return {"images": list(dict.fromkeys(str(u) for u in shown if u)), "links": [a[1]["href"] for a in find(root, "a") if a[1].get("href")], "procedure_number": number.group(0) if number else None}


_TEXTS = lambda *names: [T.StructField(n, T.StringType()) for n in names]


@F.pandas_udf(T.ArrayType(T.StructType([*_TEXTS("ident", "url", "title", "price_text", "code"), T.StructField("images", T.ArrayType(T.StringType()))])))
def product_cards_of(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: product_cards(p or ""))


@F.pandas_udf(T.ArrayType(T.StructType(_TEXTS("ident", "url", "title", "text"))))
def lot_links_of(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: lot_links(p or ""))


@F.pandas_udf(T.ArrayType(T.StructType(_TEXTS("url", "text"))))
def found_articles_of(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: found_articles(p or ""))


@F.pandas_udf(T.StructType([*[T.StructField(n, T.ArrayType(T.StringType())) for n in ("images", "links")], *_TEXTS("procedure_number")]))
def lot_page_of(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lot_page(p or "") for p in pages], columns=["images", "links", "procedure_number"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def page_numbers_of(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: page_numbers(p or ""))


CARD = T.StructType([*[T.StructField(n, T.StringType()) for n in ("ident", "url", "title", "price_text")], T.StructField("images", T.ArrayType(T.StringType()))])


@F.pandas_udf(T.ArrayType(CARD))
def cards_of(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: lot_cards(p or ""))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def definitions_of(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: definitions(p or ""))


SUMMARY = T.StructType([T.StructField("title", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("links", T.LongType())])


@F.pandas_udf(SUMMARY)
def summary_of(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for p in pages:
        root = Tree(p or "").root
        first = lambda tag: next((words(n) for n in find(root, tag)), None)  # noqa: B023, E731
        rows.append((first("title"), first("h1"), len(find(root, "a"))))
    return pd.DataFrame(rows, columns=["title", "heading", "links"])


def found_by_number(html: Column, number: Column) -> Column:
    """The lot of the first article of a search page that names exactly this cadastral number, or null."""
    numbers = lambda t: F.transform(extraction.cadastral_numbers(t), extraction.clean_cadastral)
    hits = F.filter(found_articles_of(html), lambda a: F.array_contains(numbers(a["text"]), extraction.clean_cadastral(number)))
    return F.get(hits, F.lit(0))["url"]


def extract(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """Title, first heading and number of links of each page."""
    return pages.select(ident, summary_of(F.col(html)).alias("s")).select(ident, "s.title", "s.heading", "s.links")


def decode(raw: bytes) -> str:
    for e in ENCODINGS[:-1]:
        try:
            return raw.decode(e)
        except UnicodeDecodeError:
            continue
    return raw.decode(ENCODINGS[-1], "replace")


def saved_pages(spark, path: str) -> DataFrame:
    """Saved pages of a folder, (path, html), in whichever encoding they are."""

    @F.pandas_udf(T.StringType())
    def text(raw: pd.Series) -> pd.Series:
        return raw.map(decode)

    return spark.read.format("binaryFile").load(path).select("path", text("content").alias("html"))
