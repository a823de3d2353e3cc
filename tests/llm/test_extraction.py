import re

import pytest

from pagesift.llm.extraction import Page, extract_main_text

P1 = "The first paragraph has quite a lot of words, and they go on &amp; on for a while."
P2 = "A second one, with a <a href='/x'>link in it</a>, also has enough words to be read."
T1 = "The first paragraph has quite a lot of words, and they go on & on for a while."
T2 = "A second one, with a link in it, also has enough words to be read."
NAV = "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a><li><a href='/c'>Shop</a></ul></nav>"

GOLDEN = [
    # parts that are dropped by tag, role, class and id
    (f"<body>{NAV}<article><h1>Title</h1><p>{P1}</p><p>{P2}</p></article><footer>&copy; us</footer></body>", f"Title\n\n{T1}\n\n{T2}"),
    (f"<html><body><header>Site</header><main><p>{P1}<aside>Side words</aside><p>{P2}<form>Name <input></form></main>", f"{T1}\n\n{T2}"),
    (f"<article><p>{P1}</p><div class='ad'>Buy now</div><p>{P2}</p><section id='comments'><p>{P1}{P1}{P1}</p></section></article>", f"{T1}\n\n{T2}"),
    (f"<div role=navigation>{P1}</div><div class='cookie-notice'>{P1}</div><div><p>{P1}</p><p>{P2}</p></div>", f"{T1}\n\n{T2}"),
    (f"<article><header><h1>Kept title</h1></header><p>{P1}</p><p hidden>{P2}</p></article>", f"Kept title\n\n{T1}"),
    # scripts, styles, comments, markup in strings
    (f"<article><script>var t='</p><p>no';</script><style>p{{}}</style><!-- <p>no</p> --><p>{P1}</p></article>", T1),
    (f"<article><p title='a > b'>{P1}</p></article>", T1),
    # unclosed tags, references, white space, line breaks
    (f"<article><p><b>{P1}<br>x\n\t y&nbsp;z<p>{P2}", f"{T1} x y z\n\n{T2}"),
    ("<article><p>a &lt;b&gt; &#65;&#x42; &copy &unknown; &eacute;</p></article>", "a <b> AB © &unknown; é"),
    (f"<article><p>{P1}</p><p>{P2}</p><p cla", f"{T1}\n\n{T2}"),
    ("<article><table><tr><td>one<td>two<tr><td>three</table></article>", "one\n\ntwo\n\nthree"),
    # no wrapper: link lists are menus, headings belong to the text
    (f"<body><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li><li><a href=c>Three</a></li></ul><h1>Title</h1><p>{P1}</p><p>{P2}</p></body>", f"Title\n\n{T1}\n\n{T2}"),
    (f"<body><div class='post'><p>{P1}</p>{NAV}<p>{P2}</p></div></body>", f"{T1}\n\n{T2}"),
    ("plain words only", "plain words only"),
    ("<nav>menu</nav>", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("html,want", GOLDEN)
def test_golden(html, want):
    assert Page(html or "").main_text() == want


def test_query_columns_nulls_repeats_and_clashes(spark):
    rows = [(i, f"u{i}", h, "x", 1) for i, (h, _) in enumerate(GOLDEN)] + [(None, None, None, "x", 1), (0, "u0", GOLDEN[0][0], "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = extract_main_text(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = GOLDEN[r.page_id][1] if r.page_id is not None else ""
        assert (r.text, r.n_chars) == (want, len(want))
    assert extract_main_text(df.limit(0)).count() == 0


def test_whole_table_against_the_generator_markup(spark):
    import html as H

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        body = r.html.partition("<article>")[2].partition("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<[^<>]*\Z", "", body))
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_long_and_deep_pages():
    deep = "<div>" * 20000 + P1 + "</div>" * 10000
    assert Page(deep).main_text() == T1
    assert Page("<article>" + f"<p>{P1}" * 20000).main_text().count("\n\n") == 19999
    assert Page("<b <i 'x" * 5000).main_text() == ""


@pytest.mark.parametrize("attributes", [
    "href='https://x.org/the-hidden-cost'", "title='hidden gems'", "data-hidden='false'", "href='/x?id=ad'", "data-id='share'", "href=/x?id=ad",
    "title='class=ad'", "data-x='a' data-role = navigation", "class='lead' class='ad'", "aria-hidden='false'", 'alt="style=\'display:none\'"',
])
def test_words_in_other_attributes_drop_nothing(attributes):
    assert Page(f"<article><p {attributes}>{P1}</p><p>A word <b {attributes}>and a link</b> more.</p></article>").main_text() == f"{T1}\n\nA word and a link more."


@pytest.mark.parametrize("attributes", ["hidden", "title='x' HIDDEN", "data-id=a id = 'ad'", "class=ad", "role=\"navigation\"", "aria-hidden=true", "style='display: none'"])
def test_named_attributes_drop(attributes):
    assert Page(f"<article><p>{P1}</p><p {attributes}>{P2}</p></article>").main_text() == T1


BODY = f"<h1>Title</h1><p>{P1}</p><p>{P2}</p><p>{P1}</p>"
WHOLE = f"Title\n\n{T1}\n\n{T2}\n\n{T1}"


@pytest.mark.parametrize("page", [
    # templates name whole pages after their sidebars, widgets and forms
    f"<body><form id='aspnetForm' action='x'>{NAV}<div>{BODY}</div><footer>us</footer></form></body>",
    f"<body><div class='content right-sidebar'><div>{BODY}</div><div class='sidebar'>Some side words</div></div></body>",
    f"<body><div class='elementor-widget-container'><article>{BODY}</article></div></body>",
    f"<body><form><div class='widget'><div class='page with-sidebar'>{BODY}</div><div class=ad>Buy it now</div></div></form></body>",
    # a search form, a newsletter and comments beside the article
    f"<body><form role=search>Search <input></form><article>{BODY}</article><form class=newsletter><p>Join us</p></form></body>",
    f"<body><article>{BODY}</article><div id='comment-without-photo'><p>{P1}</p><p>{P2}</p></div></body>",
    f"<body><article>{BODY}<section class='comments'><p>{P1}</p><p>{P2}</p><p>{P1}{P2}{P1}{P2}</p></section></article></body>",
    # a site's own title with a link before the article
    f"<body><div><h1>Site name</h1><a href='/'>home</a></div><article>{BODY}</article></body>",
])
def test_real_page_shapes(page):
    assert Page(page).main_text() == WHOLE


def test_sections_headings_and_formulas_of_the_article_stay():
    page = f"<article>{BODY}<section id='discussion'><h2 id='related-work'>Related</h2><p>{P1}</p></section><p>With <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p></article>"
    assert Page(page).main_text() == f"{WHOLE}\n\nRelated\n\n{T1}\n\nWith x=1."


def test_a_page_of_suspects_only_is_empty():
    assert Page(f"<div class='cookie-notice'><p>{P1}</p></div>").main_text() == ""
    assert Page(f"<div class='comments'><p>{P1}</p><p>{P2}</p><p>{P1}</p><p>{P2}</p></div>").main_text() == ""


def brute_density(page):
    """Composite densities by their definition, every subtree walked anew."""
    import math

    def inside(i):
        return [j for j in range(i, page.end[i]) if not page.gone[j]]

    def in_link(j, top):
        while j != top:
            j = page.parent[j]
            if page.tag[j] == "a":
                return True
        return False

    def sums(i):
        own = set(inside(i))
        chars = sum(len("".join(t.split())) for e, _, t in page.texts if e in own)
        links = [j for j in own if page.tag[j] == "a"]
        link_chars = sum(len("".join(t.split())) for e, _, t in page.texts if e in own and (page.tag[e] == "a" or in_link(e, i)))
        return chars, len(own) - 1, link_chars, len(links)

    body = sums(page.body)
    share = body[2] / max(body[0], 1)

    def composite(c, t, lc, lt):
        if not c:
            return 0.0
        t, m, k = max(t, 1), max(lc, 1), max(lt, 1)
        return max(0.0, c / t * math.log(c / m * t / k) / math.log(math.log(c / max(c - lc, 1) * m + share * c + math.e)))

    return {i: composite(*sums(i)) for i in range(len(page.tag)) if page.is_block(i) and not page.gone[i]}


def test_densities_equal_brute_force():
    import random

    rnd = random.Random(4)

    def tree(depth):
        if depth == 0 or rnd.random() < 0.3:
            return " ".join(rnd.choice(["word", "another", "x", "longer-word"]) for _ in range(rnd.randint(0, 9)))
        tag = rnd.choice(["div", "div", "p", "section", "a href=x", "b", "ul", "li", "div class=ad", "span"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rnd.randint(1, 4))) + f"</{tag.split()[0]}>"

    found = 0
    for _ in range(150):
        page = Page("<body>" + "".join(tree(5) for _ in range(3)))
        page.densities()
        for i, want in brute_density(page).items():
            assert abs(page.density[i] - want) < 1e-9
            found += want > 0
    assert found > 500
