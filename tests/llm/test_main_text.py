"""Main text of pages: test pages against their known structure, and awkward pages."""

import html
import re

from tidemark.llm import main_text, queries

SF_DIR = "/root/testdata/sf0.001"
LOREM = "This is one long sentence of the article, with enough words to be dense and to count as text. " * 4

PAGE = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="page">
<header><a href="/">Home</a> Site name</header>
<nav><ul><li><a href="/1">One</a><li><a href="/2">Two</a></ul></nav>
<div class="cookie-notice">We use cookies. {LOREM}</div>
<div id="wrap"><div class="sidebar"><p>{LOREM}</p></div>
<article><h1>Title &amp; more</h1><p>First&nbsp;one,
 {LOREM}</p><div class="ad-box ad">Buy! {LOREM}</div><h2>Part</h2><ul><li>item <a href="x">link</a></li><li>two</li></ul>
<p>Second &lt;b&gt; <b>bold<i>er</i></b>.<form><input value="x"><button>Go</button></form>
<script>if (a < b) {{ document.write("</p><p>no</p>") }}</script></article>
<section class="comments"><p>reader says {LOREM}</p><p>{LOREM}</p><p>{LOREM}</p></section></div>
<aside><p>{LOREM}</p></aside><footer>&copy; x</footer></body></html>"""


def squeezed(text):
    return " ".join(text.split())


def test_article_without_its_surroundings():
    body = squeezed(LOREM)
    assert main_text.main_text(PAGE).split("\n\n") == [
        "Title & more", f"First one, {body}", "Part", "item link", "two", "Second <b> bolder.",
    ]


def test_pages_without_article_elements():
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>All</a></div><div><h1>Head</h1><div><p>{LOREM}</p><p>{LOREM}</p></div></div><div><a href=4>Imprint</a></div></body>"
    body = squeezed(LOREM)
    assert main_text.main_text(page).split("\n\n") == ["Head", body, body]


def test_awkward_pages():
    assert main_text.main_text(None) == "" and main_text.main_text("") == ""
    assert main_text.main_text("just text & more") == "just text & more"
    assert main_text.main_text("<body></body>") == ""
    assert main_text.main_text("<p>a < b and c<d") == "a < b and c"
    assert main_text.main_text("<p>one<!-- never closed <p>two") == "one"
    assert main_text.main_text('<p title="open>text</p>') in ("", "text")
    assert main_text.main_text("</div></p><p>x<p>y") == "x\n\ny"
    deep = "<div>" * 30000 + "deep" + "</div>" * 30000
    assert main_text.main_text(deep) == "deep"
    long = "<article>" + f"<p>{LOREM}</p>" * 3000 + "</article>"
    assert main_text.main_text(long).count("\n\n") == 2999


WRAPPERS = {
    "form": '<form id="aspnetForm" action="/x">{}</form>',
    "header name": '<div class="page-header-layout">{}</div>',
    "sidebar name": '<div class="site has-sidebar">{}</div>',
    "plain": "<div>{}</div>",
}


def test_wrappers_with_names_of_surroundings_give_their_article():
    inner = f'<ul class="menu"><li><a href=1>Home</a><li><a href=2>News</a></ul><div class="sidebar"><p>Other news of the day</p></div><div><h1>Head</h1><p>{LOREM}</p><p>{LOREM}</p></div>'
    body = squeezed(LOREM)
    for name, wrapper in WRAPPERS.items():
        page = f"<body>{wrapper.format(inner)}<footer>Imprint</footer></body>"
        assert main_text.main_text(page).split("\n\n") == ["Head", body, body], name


def test_the_chosen_subtree_decides(monkeypatch):
    page = f"""<body><div><a href=1>Home</a> <a href=2>News</a></div><div><p>Short note</p></div>
<div><h2>Head</h2><div><p>{LOREM}</p><p>{LOREM}</p><p>{LOREM}</p></div></div><div>Seen 12 times</div></body>"""
    chosen = main_text.main_text(page)
    assert chosen.split("\n\n") == ["Head"] + [squeezed(LOREM)] * 3
    whole = main_text.content

    def body_instead(root):
        whole(root)
        body = next(n for n in main_text.in_order(root) if n.tag == "body")
        return body, set(), 0.0

    monkeypatch.setattr(main_text, "content", body_instead)
    assert main_text.main_text(page) != chosen


def test_comments_and_adverts_longer_than_the_article():
    long = "".join(f"<p>{LOREM}</p>" for _ in range(9))
    page = f'<body><div id="comments">{long}</div><article><h1>Hi</h1><p>Short.</p></article><div class="ad"><p>{LOREM}</p><p>{LOREM}</p></div></body>'
    assert main_text.main_text(page) == "Hi\n\nShort."
    page = f'<body><div class="comments">{long}</div><div><h1>Hi</h1><p>{LOREM}</p></div></body>'
    assert main_text.main_text(page) == "Hi\n\n" + squeezed(LOREM)


def test_densities_by_brute_force():
    """Characters, tags and link figures counted from the definition, node by node."""
    import math
    import random

    def figures(node):
        own = [p for p in node.parts if isinstance(p, str)]
        children = [p for p in node.parts if not isinstance(p, str)]
        chars = sum(len(" ".join(x.split())) for x in own)
        inner = [figures(c) for c in children]
        c = chars + sum(x[0] for x in inner)
        t = len(children) + sum(x[1] for x in inner)
        link = node.tag == "a"
        return c, t, c if link else sum(x[2] for x in inner), sum(x[3] for x in inner) + link

    rng = random.Random(6)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return "word " * rng.randint(0, 30)
        tag = rng.choice(["div", "p", "a", "ul", "section", "span", "nav"])
        return f"<{tag}>" + "".join(made(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    for _ in range(200):
        root = main_text.parsed("<body>" + "".join(made(5) for _ in range(4)) + "</body>")
        nodes = main_text.weigh(root)
        cb, _, lcb, _ = figures(root)
        for node in nodes:
            c, t, lc, lt = figures(node)
            if c == 0:
                expected = 0.0
            else:
                base = math.log(c / max(c - lc, 1) * lc + (lcb / cb) * c + math.e)
                ratio = c / max(lc, 1) * max(t, 1) / max(lt, 1)
                expected = c / max(t, 1) * math.log(ratio) / math.log(max(base, 2))
            assert abs(node.density - expected) < 1e-9 * max(1, abs(expected))
            kept = [p for p in node.parts if not isinstance(p, str) and not p.aside]
            assert abs(node.total - sum(p.density for p in kept)) < 1e-6


def test_broken_and_nested_markup_takes_linear_time():
    import time

    for page in (
        "<div>" * 100_000 + "x" + "</p>" * 100_000, "<span>" * 50_000 + "<li>" * 50_000 + "x", "<p><b>" * 50_000 + "x",
        '<p title="a>' * 100_000, "<p title='a\">" * 100_000, "<a b=\"c" * 100_000, "<" * 100_000, "<td><tr>" * 50_000 + "x",
        "</div>" * 100_000, "<ul><li>" * 50_000 + "x" + "</ul>" * 50_000,
    ):
        start = time.process_time()
        main_text.main_text(page)
        assert time.process_time() - start < 4, page[:30]


def known(page):
    """The article of a test page, cut out by its own marks."""
    article = page[page.index("<article>") + 9 : page.index("</article>")]
    texts = [squeezed(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " ")))) for b in re.split("</?(?:p|h1)>", article)]
    return "\n\n".join(t for t in texts if t)


def test_query_gives_the_article_of_every_page(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    rows = queries.op5_main_text(spark, SF_DIR).collect()
    assert len(rows) == len(pages)
    for row in rows:
        assert row.text == known(pages[row.page_id]) and row.n_chars == len(row.text)


def test_nulls_repeats_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (1, None, None, "a"), (None, "u", "<p>x", "b")], "page_id long, url string, html string, text string")
    rows = sorted((r.id or 0, r.url, r.text) for r in main_text.extract(pages).collect())
    assert rows == [(0, "u", "x"), (1, None, ""), (1, None, "")]
    assert main_text.extract(pages.limit(0)).count() == 0
