import html
import random
import re
from html.parser import HTMLParser

import pytest

from lotwright.llm import html as ex

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var a="</p><article>no";</script></head>
<body><header><h1>Site name</h1></header><nav><ul><li><a href=/x>Home</a><li>About</ul></nav>
<div class="cookie-notice">We use cookies to make the site work for all of you and for us.</div>
<div id="main-content"><article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>
 text&nbsp;here<p>Second&#33; one<br>more <script>x</script><!-- <p>gone</p> --><aside>Side note</aside>
<form><input value=q><label>Mail</label></form><ul><li>item one</li><li>item two</ul><div class="ad">Buy</div></article></div>
<section class="comments"><p>I think that this is the best of all the articles that I have ever seen in my life.</p></section>
<div style="display: none">hidden</div><footer>&copy; 2020</footer></body></html>"""


def test_article_page():
    assert ex.main_text(PAGE) == "Head & line First bold text here Second! one more item one item two"


def test_names_of_layouts_and_headers():
    page = '<body><div class="page with-sidebar"><div class="site-header">Site</div><article class="post"><div class="post-header"><h1>Title</h1></div><p>Text.</p><div class="post-header share">Share</div></article><div id="reader-comments">Nice</div></div>'
    assert ex.main_text(page) == "Title Text."


def test_page_without_an_article_element():
    p = "The man in the house was on the hill and he had a dog with him for all of the day when it rained. " * 3
    page = f"<html lang=en><body><div><a href=/>Home</a> <a href=/a>News of the day</a></div><h2>A heading</h2><p>{p}</p><p>Short one.</p><p>{p}</p><div>Zzyx qwrt plmk vbnm dfgh jklp wert yuio asdf ghjk zxcv bnmq wert yuio asdf ghjk qwer</div><p>&copy; 2024 by all of us</p></body></html>"
    want = re.sub(r"\s+", " ", p).strip()
    assert ex.main_text(page) == f"A heading {want} Short one. {want}"


def test_driver_table_against_its_articles(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = ex.op5_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == " ".join(x for x in parts if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


@pytest.mark.parametrize("page", ["", "<", "<p", "<p>x", "a < b", "</p></div>", "<script>never ends", "<!-- open", "<p class='x>y", "<" * 5000, "<div>" * 3000 + "x", "&#0;&bogus;&amp", "<title>t"])
def test_damaged_pages(page):
    ex.main_text(page)


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", "<article>a</article>"), (2, "u", ""), (2, "u", ""), (3, "v", "<article>" + "<p>w w</p>" * 40_000 + "</article>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in ex.extract_main_text(df).collect()), key=str)
    assert got == sorted([(1, None, 0), (None, "u", 1), (2, "u", 0), (2, "u", 0), (3, "v", 159_999)], key=str)
    assert ex.extract_main_text(df.limit(0)).collect() == []


def test_names_and_links_of_an_article_take_nothing_from_it():
    for names in ("post hentry category-news tag-economy", "post comment-open", "side-by-side", "entry legal-affairs", "tag_news has-sidebar"):
        assert ex.main_text(f'<body><div class="tags">a b</div><article class="{names}"><p>All of it.</p><div class="{names}">And this.</div></article></body>') == "All of it. And this."
    page = "<article><p>See</p><ul><li><a href='/a'>The law</a></li><li>its text, with <math><mi>x</mi></math> in it</li></ul><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></article>"
    assert ex.main_text(page) == "See The law its text, with x in it"
    assert ex.main_text('<article><p>Text.</p><div class="comment">Nice</div><div class="post tags">x</div><aside>y</aside></article>') == "Text."
    for names in ("side-nav", "comment-body", "tags", "legal-notice", "side"):
        assert ex.main_text(f'<article><p>Text.</p><div class="{names}">no</div></article>') == "Text."


PROSE = "The man in the house was on the hill and he had a dog with him for all of the day when it rained. " * 3
CODE = "Zzyx qwrt plmk vbnm dfgh jklp wert yuio asdf ghjk zxcv bnmq wert yuio asdf ghjk qwer zxcv"


@pytest.mark.parametrize("names", ["side", "tags", "legal", "notice", "form"])
def test_density_keeps_main_text_under_doubtful_names(names):
    want = re.sub(r"\s+", " ", PROSE).strip()
    assert ex.main_text(f'<body><div class="{names}"><p>{PROSE}</p><p>{PROSE}</p></div><p>{PROSE}</p></body>') == " ".join([want] * 3)
    assert ex.main_text(f'<body><p>{PROSE}</p><div class="{names}">Buy now</div></body>') == want


def test_an_element_that_holds_most_good_text_is_not_what_it_is_called():
    want = re.sub(r"\s+", " ", PROSE).strip()
    assert ex.main_text(f'<body><form><div><p>{PROSE}</p><p>{PROSE}</p></div></form><nav><a href="/">Home</a></nav></body>') == f"{want} {want}"
    assert ex.main_text(f'<body><p>{PROSE}</p><div id="comments"><p>{PROSE}</p><p>{PROSE}</p></div></body>') == want
    assert ex.main_text(f'<body><p>{PROSE}</p><p>{PROSE}</p><form><p>{PROSE}</p></form></body>') == f"{want} {want}"


def test_density_decides_beside_and_inside_an_article():
    want = re.sub(r"\s+", " ", PROSE).strip()
    links = '<a href="/a">One more story</a> <a href="/b">And another story</a>'
    assert ex.main_text(f"<body><div>{CODE}</div><article><p>{PROSE}</p></article><div>{links}</div><div>Short</div></body>") == want
    assert ex.main_text(f"<article><p>{PROSE}</p><pre>{CODE}</pre><div>{links}</div><p>See also</p><div>{links}</div><p>End</p></article>") == f"{want} {CODE} End"


def test_language_is_looked_for_in_the_whole_page():
    german = "Der Mann und die Frau sind auf dem Berg, und sie haben einen Hund mit sich, der für das Haus und den Garten da ist. " * 2
    for head in ("<!-- " + "x" * 5000 + " --><html lang=de>", "<html>"):
        assert ex.main_text(f"{head}<body><p>{german}</p></body>") == german.strip()


class Plain(HTMLParser):
    """Blocks of a well-formed page: text, code points in links, links, names of the open elements."""

    def __init__(self, page):
        super().__init__()
        self.open, self.out, self.parts = [], [], []
        self.feed(page)
        self.cut()

    def cut(self):
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            self.out.append((text, sum(len(" ".join(t.split())) for t, a in self.parts if a), tuple(self.open)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag != "a":
            self.cut()
        self.open.append((tag, dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        if tag != "a":
            self.cut()
        self.open.pop()

    def handle_data(self, data):
        self.parts.append((data, any(t == "a" for t, _ in self.open)))


def plain_main_text(page):
    """The rules for pages of div, p, nav, aside, h2 and a, without lists and main elements, block by block."""
    stops = set(ex.STOP_WORDS["en"].split())
    got = []
    for text, linked, held in Plain(page).out:
        share = sum(w.strip(".,") in stops for w in text.lower().split()) / len(text.split())
        if linked > 0.33 * len(text):
            label = "bad"
        elif len(text) < 70:
            label = "open" if share or not linked else "bad"
        elif share >= 0.16 or share >= 0.08 and len(text) > 200:
            label = "good"
        else:
            label = "near" if share >= 0.08 else "bad"
        got.append([text, label, held, any(t == "h2" for t, _ in held)])
    around = lambda held: any(t in ("nav", "aside") or c == "ad" for t, c in held)
    total = sum(len(t) for t, label, _, _ in got if label == "good")
    marked = sum(len(t) for t, label, held, _ in got if label == "good" and around(held))
    assert 2 * marked <= total
    first = ["bad" if around(held) else label for _, label, held, _ in got]
    out = []
    for n, (text, _, _, heading) in enumerate(got):
        left = next(((first[k], n - k) for k in range(n - 1, -1, -1) if first[k] in ("good", "bad")), ("bad", n + 1))
        right = next(((first[k], k - n) for k in range(n + 1, len(got)) if first[k] in ("good", "bad")), ("bad", len(got) - n))
        label = first[n]
        if label == "near":
            label = "good" if "good" in (left[0], right[0]) else "bad"
        elif label == "open":
            label = "good" if heading and right[0] == "good" else left[0] if left[0] == right[0] or left[1] < right[1] else right[0]
        if label == "good":
            out.append(text)
    return " ".join(out)


def test_rules_against_a_plain_version():
    rnd = random.Random(5)
    words = ["the", "of", "and", "stone", "river", "quiet", "lamp", "zinc", "orbit", "cargo"]
    kept = 0
    for _ in range(300):
        blocks = []
        for _ in range(rnd.randint(1, 12)):
            vocab = rnd.choice([words, words[2:], words[3:], words[3:] * 3 + words[:3]])
            text = " ".join(rnd.choices(vocab, k=rnd.choice([2, 5, 12, 20, 50, 90])))
            kind = rnd.choice(["p", "p", "p", "div", "h2", "linked", "link", "ad", "nav"])
            if kind == "linked":
                text = f"<p>{text} <a href='/'>{' '.join(rnd.choices(words, k=6))}</a></p>"
            elif kind == "link":
                text = f"<div><a href='/'>{text[:40]}</a></div>"
            elif kind in ("ad", "nav"):
                text = f"<div class='ad'>{text[:90]}</div>" if kind == "ad" else f"<nav><div>{text[:60]}</div></nav>"
            else:
                text = f"<{kind}>{text}</{kind}>"
            blocks.append(text)
        page = f"<html lang='en'><body>{''.join(blocks)}<p>{PROSE}</p><p>{PROSE}</p></body></html>"
        got = ex.main_text(page)
        assert got == plain_main_text(page), page
        kept += len(got)
    assert kept > 300 * 600


def _damaged(n):
    return {
        "nested": "<div>the x " * n, "marked": "<nav>the x " * n, "open quote": "<a " * n + '"', "quotes": "<a " * n + '"x"' * n + "'", "stray ends": "<span>" * n + "</b>" * n,
        "items": "<li><div>" + "<span>" * n + "<li></li>" * n, "never closed": "<svg>" * n, "paragraphs": "<span>" * n + "<div></div>" * n,
    }


@pytest.mark.parametrize("kind", sorted(_damaged(1)))
def test_damaged_pages_take_time_in_proportion(kind):
    import time

    took = []
    for n in (5_000, 40_000):
        began = time.process_time()
        ex.main_text(_damaged(n)[kind])
        took.append(time.process_time() - began)
    assert took[1] < 25 * max(took[0], 0.05)  # in the square it would be 64 times


def test_tag_ends_at_the_first_sign_outside_quotes():
    for page, text in (('<a title="x>y">z', "z"), ("<a title='x>y'>z", "z"), ('<a title="x>z', '<a title="x>z'), ("<a b", "")):
        assert " ".join(b.text for b in ex.blocks(page)) == text
