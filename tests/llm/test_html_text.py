import html
import re
from collections import Counter

from pipewise.llm import html_text

TEXT = (
    "The keeper of the lighthouse was with the children on the hill, and they looked for the boat "
    "that had not come back in the storm of the night before."
)
PAGE = f"""<!DOCTYPE html><html><head><title>Page title</title><style>p{{}}</style></head><body>
<header><h1>Site of the day</h1><p>{TEXT}</p></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice"><p>{TEXT}</p></div><!-- <p>hidden</p> -->
<script>var t = "</p><p>{TEXT}";</script>
<article><h1>Boats &amp; storms</h1><p>{TEXT}<p>Short one.</p>
<div class="ad">{TEXT}</div><p>It was <b>d</b>ark&nbsp;and <i>cold</i><br>there.</p>
<p><a href="/x">More of this in the paper of the day</a></p>
<form><p>{TEXT}</p><input><button>Send</button></form>
<section id="comments"><p>{TEXT}</p></section></article>
<aside>{TEXT}</aside><footer>&copy; all of it</footer>"""
WANT = f"Boats & storms {TEXT} Short one. It was dark and cold there."


def test_article_only():
    assert html_text.main_text(PAGE) == WANT


def test_without_an_article_element_the_rules_decide():
    page = f"""<body><div><a href="/">Home</a> <a href="/n">News</a></div><div>Adverts here</div>
    <div><p>{TEXT}</p><p>He waited.</p><p>{TEXT} {TEXT}</p></div>
    <p>Read on</p><div><a href="/1">One of the links</a> | <a href="/2">two</a></div></body>"""
    assert html_text.main_text(page) == f"{TEXT} He waited. {TEXT} {TEXT}"


def test_broken_markup():
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("<article><p>a &lt; b < c <b>d") == "a < b < c d"
    assert html_text.main_text('<article title="x>y"><p>one</p><p class="a>b">two') == "one two"
    assert html_text.main_text("<article>" + "<p>x" * 30000).count("x") == 30000
    assert html_text.main_text('<div class="ad"><article><p>kept</p></article>') == "kept"
    assert html_text.main_text("<article><p>a</p></article><script>never closed <p>b") == "a"


def test_whole_table(spark, sf):
    from pipewise.llm.queries import QUERIES

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op4_html_extraction"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S).group(1)
        plain = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner)))
        assert r.text == " ".join(plain.split()) and r.n_chars == len(r.text)
        assert r.url == pages[r.page_id].url


def test_awkward_rows(spark):
    rows = [(1, None, None), (None, "u", PAGE), (1, "u", ""), (2, "u", PAGE), (2, "u", PAGE)]
    schema = "page_id long, url string, html string, text string, n_chars string"
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = html_text.extract_main_text(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 0] + [len(WANT)] * 3
    assert html_text.extract_main_text(pages.limit(0)).collect() == []


def test_the_rules_find_the_text_without_article_tags(spark, sf):
    got = wanted = other = 0
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        whole = Counter(html_text.main_text(r.html).split())
        found = Counter(html_text.main_text(re.sub(r"</?article>", "", r.html)).split())
        got, wanted = got + (whole & found).total(), wanted + whole.total()
        other += (found - whole).total()
    assert got >= 0.95 * wanted and other <= 0.01 * wanted


def test_elements_without_their_end():
    page = "<article><p>one two</p>{}<p>three four</p></article>"
    for inside in (
        "<svg class=i/>",
        '<svg class="i" /><svg><path d="m"/></svg>',
        "<svg><text>x</text>",
        "<object data=x>",
        "<math><mi>x</mi></math>",
        "<script>if (a </b) x</script>",
        "<select><option>x</option></select>",
    ):
        assert html_text.main_text(page.format(inside)) == "one two three four", inside
    head = "<html><head><title>T</title><meta charset=utf-8><body><article><p>text</p></article>"
    assert html_text.main_text(head) == "text"
    assert html_text.main_text(head.replace("<body>", "")) == "text"
    assert html_text.main_text("<article><p>" + "a<svg>" * 20000 + "<p>b").endswith("b")


def test_names_count_whole_and_not_everywhere():
    kept = (
        '<body class="has-sidebar"><p>{}</p></body>',
        '<section id="related-work"><p>{}</p></section>',
        '<div class="warning"><p>{}</p></div>',
        '<article class="post social"><p>{}</p></article>',
        '<article><section id="discussion"><p>{}</p></section></article>',
        '<main class="search"><p>{}</p></main>',
    )
    for page in kept:
        assert html_text.main_text(page.format(TEXT)) == TEXT, page
    gone = ("cookie-notice", "x comments", "relatedPosts", "ad-2", "share_buttons", "site-footer")
    for name in gone:
        page = f'<article><p>{TEXT}</p><div class="{name}"><p>{TEXT}</p></div></article>'
        assert html_text.main_text(page) == TEXT, name
    assert html_text.main_text(f'<article><h2 id="search">Search</h2><p>{TEXT}</p></article>') == f"Search {TEXT}"


def test_a_language_without_stop_list():
    lines = [
        f"Mzee wa kijiji namba {k} alisema kuwa mvua ya masika ni ndefu na watu wa pwani ya "
        "kusini wana mashua ya mbao na nyavu za kuvulia samaki kila siku ya wiki."
        for k in range(8)
    ]
    text = "".join(f"<p>{x}</p>" for x in lines)
    links = '<ul><li><a href="/">Nyumbani</a><li><a href="/h">Habari</a></ul>'
    page = f"<body>{links}<div><h1>Mvua ya masika</h1>{text}</div>{links}</body>"
    assert html_text.main_text(page) == " ".join(["Mvua ya masika", *lines])
    signs = ["今日は村の人々が海の近くの市場で魚を売る日です。" * 6 for _ in range(3)]
    page = f"<body>{links}" + "".join(f"<p>{x}</p>" for x in signs) + "</body>"
    assert html_text.main_text(page) == " ".join(signs)
