"""Main text of pages: the given ones against their marked articles, others case by case."""

import html
import re
import time

import pytest

from remitlens.llm.main_text import Page, extract_main_text, main_text
from remitlens.llm.page_tree import in_order, parse, tokens

LONG = "This is a sentence of the article that goes on for a while, as prose does. "
PARAGRAPHS = "".join(f"<p>{i} {LONG * 3}</p>" for i in range(4))
WANT = "\n\n".join(f"{i} {LONG * 3}".strip() for i in range(4))
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(30)) + "</ul>"


def article(page):
    """The blocks between the article tags of the given pages, which hold only h1, p, b and br."""
    inner = re.search("<article>(.*)</article>", page, re.S).group(1)
    blocks = (re.sub("<[^>]*>", " ", part) for part in re.split("</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)


def test_given_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    made = {r.page_id: r for r in extract_main_text(pages).collect()}
    given = pages.collect()
    assert len(made) == len(given)
    for page in given:
        assert made[page.page_id].text == article(page.html)
        assert made[page.page_id].n_chars == len(article(page.html))


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><div class=nav>{MENU}</div><div id=content>{PARAGRAPHS}</div><div>{MENU}</div></body>", WANT),
        # no class tells: density alone
        (f"<body><div>{MENU}</div><div>{PARAGRAPHS}</div><div><div>{MENU}</div><p>Imprint</p></div>", WANT),
        # sections beside each other, a short heading and a short line between them
        (
            f"<div>{MENU}</div><div><h1>Title</h1><section>{PARAGRAPHS}</section><h2>Next</h2><p>On.</p>"
            f"<section>{PARAGRAPHS}</section></div>",
            f"Title\n\n{WANT}\n\nNext\n\nOn.\n\n{WANT}",
        ),
        # header, footer, comments, forms, adverts and notices inside the article
        (
            f"<main><article><header><h1>Title</h1><p>By somebody</p></header>{PARAGRAPHS}<aside>{LONG}</aside>"
            f"<div class='ad-box'>{LONG * 9}</div><form><p>{LONG}</p></form><section id=comments><h3>Comments</h3>"
            f"<article class=comment><p>{LONG * 50}</p></article></section><footer>{LONG}</footer></article></main>"
            f"<div class=cookie-notice>{LONG * 20}</div>",
            f"Title\n\n{WANT}",
        ),
        # a form around the page, a wrapper with an unlucky class
        (f"<body class=has-sidebar><form id=f><div class='page header-fixed'><h1>T</h1>{PARAGRAPHS}</div></form>", f"T\n\n{WANT}"),
        ("<article><p>a<br>b &amp; c&nbsp;d &eacute; &#233; &am <b>e<p>f\n\n g<i>h</i></article>", "a b & c d é é &am e\n\nf gh"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><th>c</table></article>", "one\n\ntwo\n\na b\n\nc"),
        ("<p>1 < 2 and 3 > 2 <3 </p>", "1 < 2 and 3 > 2 <3"),
        ("<p title='a > b'>x</p><!-- <p>no</p> --><style>p{}</style><script>'</p>'</script>", "x"),
        ("<p hidden>no</p><p style='display: none'>no</p><p>yes", "yes"),
        ("plain text &lt;b&gt;", "plain text <b>"),
        ("<nav>only a menu</nav><footer>and a footer</footer>", ""),
        ("", ""), (None, ""), ("<", "<"), ("<p", ""), ("<!--", ""), ("<article></article>", ""),
    ],
)
def test_cases(page, want):
    assert main_text(page) == want


def test_tree_closes_what_browsers_close():
    root = parse("<p>a<b>b<div>c</p>d<ul><li>e<li>f<ul><li>g</ul></ul><dl><dt>h<dd>i</dl>")
    assert [(x.name, x.parent.name) for x in in_order(root)[1:]] == [
        ("p", "#page"), ("b", "p"), ("div", "#page"), ("ul", "div"), ("li", "ul"), ("li", "ul"), ("ul", "li"),
        ("li", "ul"), ("dl", "div"), ("dt", "dl"), ("dd", "dl"),
    ]
    assert list(tokens('<a b="x>y">t</a>')) == [("start", "a", ' b="x>y"'), ("text", "t", ""), ("end", "a", "")]


def test_densities():
    page = Page("<body><div><a href=x>links here</a></div><p>" + LONG * 5 + "</p></body>")
    names = [x.name for x in page.nodes]
    at = {n: names.index(n) for n in ("body", "div", "a", "p")}
    assert page.density[at["p"]] > page.density[at["body"]] > page.density[at["div"]]
    total = page.density[at["div"]] + page.density[at["p"]]
    assert page.sum[at["body"]] == pytest.approx(total)


@pytest.mark.parametrize(
    "piece", ["<div>", "<p>x", "<!--", '<a "', "<script>", "x&amp;", "<", "</x", "<li><ul>", "<b><p>x</p>", "<div class=ad>x<b>"]
)
def test_long_and_odd_pages(piece):
    start = time.time()
    main_text(piece * 20_000)
    assert time.time() - start < 10


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", None, "x", 5), (1, "u", None, "x", 5), (None, None, "", None, None), (2, "v", f"<p>{LONG * 40_000}", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    made = extract_main_text(pages)
    assert made.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((str(r.page_id), r.n_chars) for r in made.collect()) == [
        ("1", 0), ("1", 0), ("2", len(LONG * 40_000) - 1), ("None", 0)
    ]
    assert extract_main_text(pages.limit(0)).collect() == []
