"""Main text of pages of several makes."""

import pytest

from anamnesis.llm.tag_paths import extract, main_text, path_ratios, read_blocks

LONG = "It was a long day, and the road went on, mile after mile; nobody spoke. "


def test_article_without_the_rest():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
    <header><h2>Site, name.</h2></header><nav><ul><li><a href="/a">One, two.</a></li><li><a href="/b">Three</a></li></ul></nav>
    <!-- a comment <p>no</p> --><div class="ad">Buy this, now. And that, too.</div>
    <article><h1>Head &amp; line</h1><p><b>{LONG * 3}<br><p>Short.</p><p>a&nbsp;b  &eacute;&#233;&#x1F600;</p>
    <aside>Also, read this.</aside><script>var x = "</p><p>no";</script>
    <form><label>Your name, please.</label><input name=q><button>Go</button></form></article>
    <div class="comments"><p>{LONG * 4}</p></div><div id="cookie-notice">We use cookies, of course.</div>
    <footer>&copy; me, {LONG}</footer></body></html>"""
    want = f"Head & line {' '.join((LONG * 3).split())} Short. a b éé😀"
    assert main_text(page) == want


def test_page_without_an_article_element():
    page = f"""<html><body><div class="top"><a href=x>Home</a> <a href=y>News</a></div>
    <div class="wrap"><div class="text"><h2>Title here</h2><p>{LONG * 2}<p>{LONG}</p><ul><li>first, item<li>second item</ul></div>
    <div class="sidebar"><p>{LONG}</p></div></div><div><a href=z>Terms</a></div></body></html>"""
    assert main_text(page) == " ".join(f"Title here {LONG * 2} {LONG} first, item second item".split())


@pytest.mark.parametrize("page", [None, "", "   ", "<html></html>", "<script>alert(1)</script>", "<nav><a href=x>a, b.</a></nav>", "<!-- open", "<p", "<head>", "</p></div>"])
def test_nothing_to_extract(page):
    assert main_text(page) in ("", "<p")


def test_broken_markup_ends():
    for page in ["<p>" * 5000 + LONG, "<div>" * 3000 + LONG, "<a href='" + "x" * 100_000, "<" * 50_000, "&" * 50_000, f"<article>{LONG}" * 500]:
        main_text(page)


def test_plain_text_is_content():
    assert main_text(LONG * 3) == " ".join((LONG * 3).split())


def test_blocks_and_ratios():
    blocks = read_blocks(f"<body><p>{LONG}</p><p>{LONG}</p><div class=nav><a href=x>a</a></div></body>")
    assert [b.path for b in blocks] == [("body", "p"), ("body", "p"), ("body", "div.nav")]
    ratios = path_ratios(blocks)
    assert ratios[0] > 0 and ratios[2] == 0


def test_table(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>"), (2, None, None), (2, None, ""), (None, "v", "<p>" + LONG * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as path")
    found = extract(pages).collect()
    assert sorted((str(r["page_id"]), len(r["text"])) for r in found) == [("1", len(LONG) - 1), ("2", 0), ("2", 0), ("None", len(LONG) * 2000 - 1)]
    assert extract(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    ("outer", "inner"),
    [*((o, i) for o in ("article", "div") for i in ("div", "table", "section", "figure")), ("article", "div class=body")],
)
def test_passed_blocks_beside_the_largest_element_stay(outer, inner):
    tag = inner.split()[0]
    page = f"<body><{outer}><h1>Head</h1><p>Intro, {LONG}</p><{inner}><p>{LONG * 9}</p></{tag}><p>End, {LONG}</p></{outer}></body>"
    assert main_text(page) == " ".join(f"Head Intro, {LONG} {LONG * 9} End, {LONG}".split())


@pytest.mark.parametrize(
    ("start", "end"),
    [("<body class='has-sidebar'>", "</body>"), ("<main class='menu-open'>", "</main>"), ("<article class='reader'>", "</article>"), ("<body><div id=widget>", "</div></body>")],
)
def test_names_of_elements_around_the_text_are_no_boilerplate(start, end):
    page = f"{start}<p>{LONG * 3}</p><div class=sidebar><p>{LONG}</p></div><p>{LONG * 2}</p><article class=comment><article class=comment>{LONG}</article></article>{end}"
    text = main_text(page)
    assert text.startswith(" ".join((LONG * 5).split())) and text.count("long day") < 7


@pytest.mark.parametrize(
    "page",
    [
        f"<main><p>{LONG * 2}</p><div class=product-tags>{LONG} {LONG}</div><p>{LONG}</p></main>",
        f"<article><div class=social-history><p>{LONG * 2}</p><p>{LONG}</p></div><p>{LONG}</p><p>{LONG}</p></article>",
        f"<body><p>{LONG * 2}</p><div class=body><p>{LONG * 2}</p></div><p>{LONG}</p></body>",
    ],
)
def test_names_only_tip_the_balance(page):
    assert main_text(page).count("long day") == page.count("long day")


def test_names_that_say_so_in_all_their_words_are_boilerplate():
    for name in ("ad", "cookie-notice", "user-comments", "newsletter-signup", "share-bar", "related"):
        page = f"<article><p>{LONG * 3}</p><div class='{name}'><p>{LONG}</p></div><p>{LONG * 2}</p></article>"
        assert main_text(page).count("long day") == 5, name


@pytest.mark.parametrize("unit", ["<div>abc", "<div>", "<ul><li>abc", "<div class=a><p>abc", "<foo>abc<li>", "<p>abc</div>", "<table><tr><td>x"])
def test_deep_pages_take_time_by_their_length(unit):
    import time

    started = time.perf_counter()
    main_text(unit * 30_000)
    assert time.perf_counter() - started < 12


def brute_ratios(blocks):
    """Ratio per path by summing over all blocks, then neighbours by the five weights."""
    def mean(value):
        own = [[value(c) for c in blocks if c.path == b.path] for b in blocks]
        return [sum(o) / len(o) for o in own]

    def smooth(x):
        weights = [2.718281828459045 ** (-0.5 * d * d) for d in range(-2, 3)]
        at = lambda i: x[min(max(i, 0), len(x) - 1)]
        return [sum(w * at(i + d) for w, d in zip(weights, range(-2, 3), strict=True)) / sum(weights) for i in range(len(x))]

    text = smooth(mean(lambda b: len(b.text) - 0.9 * min(b.linked, len(b.text))))
    marks = smooth(mean(lambda b: sum(b.text.count(c) for c in ".,;:!?")))
    return [t * (0.5 + m) for t, m in zip(text, marks, strict=True)]


def test_ratios_by_brute_force():
    page = "<body>" + "".join(f"<div><p>{LONG * (k % 4)}</p><section>{'x, ' * k}<a href=x>{'y' * k}</a></section></div>" for k in range(25)) + "</body>"
    blocks = read_blocks(page)
    assert len(blocks) > 30
    assert path_ratios(blocks).tolist() == pytest.approx(brute_ratios(blocks))
