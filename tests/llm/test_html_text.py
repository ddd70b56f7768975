import re

import pytest

from thicket.llm.html_text import Line, clusters, extract, main_text, smoothed

LONG = "The river ran past the mill and nobody in the valley knew how old the wheel was, or who had built it first."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><p>Site name</p></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><div class="ad">Buy now, {LONG}</div>
<article><h1>Old &amp; new</h1><p><b>{LONG}<br><p>Short.</p><p>{LONG}
   Two  lines.</p><ul><li>One</li><li>Two</li></ul><form><p>Your mail</p></form><aside>More on this</aside></article>
<section id="comments"><p>Reader: {LONG}</p></section><div class="sidebar">Most read</div><footer>&copy; us</footer></body></html>"""
WANT = f"Old & new\n{LONG}\nShort.\n{LONG} Two lines.\nOne\nTwo"


def test_article_only():
    assert main_text(PAGE) == WANT


@pytest.mark.parametrize("html,want", [(None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("just text", "just text"), ("<script>x()</script>", ""), ("<article>a &am", "a &am"), ("<p>a<p>b", "a\nb"), ("<article><p>x</article>", "x"), ("<!-- <p>no</p> --><p>yes</p>", "yes")])
def test_small_pages(html, want):
    assert main_text(html) == want


def test_without_article_the_fullest_container():
    html = f"<body><div class='x'><a>1</a><a>2</a></div><div id='content'><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div><div><a>z</a></div></body>"
    assert main_text(html) == f"Head\n{LONG}\n{LONG}"


def test_main_with_article():
    assert main_text(f"<main><p>Crumbs</p><article><p>{LONG}</p></article></main>") == LONG


FLAT = f"<body><a>Home</a><br><p><a>News</a></p><p><a>About us</a></p><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p><a>Imprint</a></p><p><a>Terms</a></p></body>"


def test_flat_body_is_cut_by_the_clusters():
    assert main_text(FLAT) == f"Head\n{LONG}\nShort.\n{LONG}"


def test_without_clusters_menus_come_out(monkeypatch):
    import numpy as np

    from thicket.llm import html_text

    many = f"<main><p>{LONG}</p><ul>" + "".join(f"<li><a>Go {i}</a></li>" for i in range(9)) + f"</ul><p>{LONG}</p></main>"
    want = main_text(FLAT), main_text(many)
    monkeypatch.setattr(html_text, "clusters", lambda lines, sigma=0: (np.ones(len(lines), bool),) * 2)
    assert want[1] == f"{LONG}\n{LONG}" and main_text(FLAT) != want[0] and main_text(many) != want[1]


@pytest.mark.parametrize("name", ["post has-sidebar", "content no-comments", "article social-share", "with-comments", "content-without-ads", "header-wide"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_class_words_on_the_text_itself(tag, name):
    assert main_text(f"<body><div class='sidebar'>Most read</div><{tag} class='{name}'><p>{LONG}</p><p>{LONG}</p></{tag}><footer>us</footer></body>") == f"{LONG}\n{LONG}"


def test_what_stands_inside_a_line_leaves_no_break():
    inner = ["<script>x()</script>", "<button>Go</button>", "<svg><text>1</text></svg>", "<span class='ad'>Buy</span>", "<style>p{}</style>", "<span hidden>no</span>", "<iframe>old</iframe>"]
    for x in inner:
        assert main_text(f"<article><p>before {x}after</p><p>{LONG}</p></article>") == f"before after\n{LONG}", x
    assert main_text(f"<article><p>before <span class='share-me'>and</span> after</p><p>{LONG}</p></article>") == f"before and after\n{LONG}"
    assert main_text(f"<article><p>before</p><div class='ad'>Buy</div>after<aside>x</aside>end<p>{LONG}</p></article>") == f"before\nafter\nend\n{LONG}"


def test_title_and_intro_stay_without_an_article():
    for intro in ("<p>Short intro.</p>", "<p>By nobody</p><p>Short intro.</p>", ""):
        lines = [x for x in re.split("</?p>", intro) if x]
        body = f"<h1>Title</h1>{intro}<p>{LONG}</p><p>{LONG}</p><h2>So</h2><p>Brief end.</p>"
        assert main_text(f"<body><div><a>Home</a></div><div id=content>{body}</div><div><a>z</a></div></body>") == "\n".join(["Title", *lines, LONG, LONG, "So", "Brief end."])
        assert main_text(f"<body><p><a>Home</a></p>{body}<p><a>Imprint</a></p></body>") == "\n".join(["Title", *lines, LONG, LONG, "So", "Brief end."])


@pytest.mark.parametrize("mark", ["ol class='comment-list'", "div class='user-comments'", "div id='comments-area'", "section class='comments'", "div class='x replies'"])
def test_comments_longer_than_the_post_go(mark):
    tag = mark.split()[0]
    assert main_text(f"<body><div class='post'><h1>Title</h1><p>{LONG}</p></div><{mark}>" + f"<p>Reader: {LONG} {LONG}</p>" * 5 + f"</{tag}></body>") == f"Title\n{LONG}"


def test_names_that_only_speak_of_comments():
    for name in ("single comments-open", "no-comments", "with-comments"):
        assert main_text(f"<body><div class='{name}'><p>{LONG}</p><p>{LONG}</p></div></body>") == f"{LONG}\n{LONG}"


def test_lists_of_links_inside_an_article_stay():
    links = "".join(f"<li><a href='{i}'>Work {i}</a></li>" for i in range(6))
    assert main_text(f"<article><p>{LONG}</p><ul>{links}</ul><nav><a>Next</a></nav><ul class='menu'><li>x</li></ul></article>") == "\n".join([LONG, *(f"Work {i}" for i in range(6))])


def test_pages_give_the_same_text_without_their_article_element():
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    same = sum(main_text(h) == main_text(h.replace("<article", "<div").replace("</article", "</div")) for h in pages)
    assert len(pages) == 250 and same >= 240


def test_sibling_parts_stay():
    parts = f"<div><p>{LONG}</p></div><section><p>{LONG} 2</p></section>"
    assert main_text(f"<body><div><a>Home</a></div>{parts}<div><a>Imprint</a></div></body>") == f"{LONG}\n{LONG} 2"
    assert main_text(f"<body><article><p>{LONG}</p></article><article><p>{LONG} 2</p></article></body>") == f"{LONG}\n{LONG} 2"


def test_elements_without_their_end():
    assert main_text(f"<body><nav><a>Home</a><article><p>{LONG}</p></article></body>") == LONG
    assert main_text(f"<body><form action='x'><div><a>Home</a></div><article><p>{LONG}</p></article></form></body>") == LONG
    assert main_text(f"<body><form><p>{LONG}</p><p>{LONG} 2</p></form></body>") == f"{LONG}\n{LONG} 2"


def test_articles_that_are_comments():
    assert main_text(f"<main><article><p>{LONG}</p></article><article class='comment'><p>{LONG} I said.</p></article></main>") == LONG


def test_clashing_names(spark):
    rows = spark.createDataFrame([(PAGE, "a", "b")], "html string, _html string, html_ string")
    assert extract(rows).select("_html", "html_", "text").first() == ("a", "b", WANT)


def test_long_page():
    assert main_text("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>").count("\n") == 2999


def test_smoothing_and_clusters():
    import numpy as np

    assert np.allclose(smoothed(np.full(9, 3.0)), 3)
    lines = [Line("ab", 4)] * 5 + [Line("x" * 200, 1)] * 5
    content, firm = clusters(lines)
    assert content.tolist()[6:] == firm.tolist()[6:] == [True] * 4 and not content[:4].any() and not firm[:5].any()


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, WANT, len(WANT))] * 2 + [(2, "", 0)]
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_articles_of_the_pages_table(spark, sf):
    from html import unescape

    for r in extract(spark.read.parquet(f"{sf}/pages.parquet").withColumn("raw", __import__("pyspark").sql.functions.col("html"))).collect():
        inner = re.search(r"<article>(.*)</article>", r.raw, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)
