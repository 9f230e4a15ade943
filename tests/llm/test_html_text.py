from __future__ import annotations

import re

import pytest

from cmdlode.llm.html_text import extract, main_text

LONG = "A first long sentence about rivers and boats that goes on for a good while, so that it stands out. " * 2
MORE = "Another paragraph with enough words to be counted as text of an article, not as a menu or a note. " * 2
BOTH = f"{LONG.strip()}\n{MORE.strip()}"


def test_boilerplate_around_an_article():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var a="</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href=x>About us</a></ul></nav>
    <div class="cookie-banner">We use cookies to make this site better for you and everybody else around.</div>
    <article><h1>Head &amp; tail</h1><p>Short.</p><div class="ad">Buy this now</div><p>{LONG}<p>a&nbsp;b &lt;c&gt;<br>{MORE}
    <form><label>Name</label><input><button>Send</button></form><aside>See also</aside></article>
    <div id="comments"><p>{LONG}</p></div><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == f"Head & tail\nShort.\n{LONG.strip()}\na b <c>\n{MORE.strip()}"


def test_no_article_element():
    page = f"""<body><div id="top-menu"><a href=a>One</a> <a href=b>Two</a></div><div><div><h2>Name</h2><p>{LONG}</p><p>Yes.</p>
    <p>{MORE}</p></div><div class="sidebar">{LONG}</div></div><div class=comments>{LONG}{MORE}</div><div class="footer">End</div>"""
    assert main_text(page) == f"Name\n{LONG.strip()}\nYes.\n{MORE.strip()}"


def test_plain_blocks_without_names():
    links = "".join(f"<div><a href={i}>Link number {i}</a></div>" for i in range(12))
    assert main_text(f"<body>{links}<p>{LONG}</p><p>{MORE}</p>{links}</body>") == BOTH


def test_class_of_a_wrapper_does_not_drop_the_page():
    assert main_text(f'<div class="with-sidebar"><article><p>{LONG}</p><p>{MORE}</article></div>') == BOTH


def test_cut_off_and_odd_markup():
    assert main_text(f"<article><p>{LONG}<p>{MORE}<b cla") == BOTH
    assert main_text(f"<article><p>{LONG}<p>{MORE.strip()} &am").endswith("&am")
    assert main_text(f"<article><!-- <p>no</p> --><p>{LONG}</p><!-- open <p>{MORE}") == LONG.strip()
    assert main_text(f'<article><p title="a > b">{LONG}</p><p>1 < 2 and 3</p></article>') == f"{LONG.strip()}\n1 < 2 and 3"
    assert main_text("<script>x" + "<" * 1000) == ""
    assert main_text("<article>" + "<b>x " * 3000) == " ".join(["x"] * 3000)


def test_without_text(spark):
    rows = [(1, "u", None, "mine", 2**60), (2, None, "", "mine", None), (None, "u", "<nav>a</nav>", "mine", 1), (3, "u", "plain words", "mine", 1)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, other bigint")
    got = extract(frame).collect()
    assert [(r["page_id"], r["text"], r["n_chars"], r["other"]) for r in got] == [
        (1, "", 0, 2**60), (2, "", 0, None), (None, "", 0, 1), (3, "plain words", 11, 1)]
    assert extract(frame.where("false")).count() == 0


def test_given_pages(spark):
    import html

    for row in extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(
        spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id"
    ).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", row["html"], re.S)
        parts = re.split(r"<(?:/?(?:p|h1)|br)\b[^>]*>", inner[1] if inner else "")
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", "", p)).split()) for p in parts]
        assert row["text"] == "\n".join(p for p in plain if p)
        assert row["n_chars"] == len(row["text"])


def test_attributes_are_read_by_whole_names():
    inside = f"<p>{LONG}</p><p>{MORE}</p>"
    for rest in (
        'style="overflow:hidden"', "style='visibility: hidden-x'", 'aria-hidden="false"', 'title="The hidden valley"', 'data-role="menu"',
        "data-hidden", 'data-class="ad"', 'title="class=ad"', "title = 'role=menu' lang=en", 'data-id=comments', 'alt="a" title="id = ad"',
    ):
        assert main_text(f"<body><div {rest}>{inside}</div></body>") == BOTH, rest
    for rest in ("hidden", 'hidden=""', 'lang="en" HIDDEN', 'aria-hidden="true"', "aria-hidden=true", 'role="menu"', "id=x role = menu", 'title="a"class="ad"'):
        assert main_text(f"<body>{inside}<div {rest}>{inside}</div></body>") == BOTH, rest


def test_one_long_paragraph_does_not_end_the_text():
    long, short, tiny = ("long one " * 555).strip(), ("x y z w " * 31).strip(), "Next"
    for n in (1, 3, 10, 40):
        want = "\n".join([long] + [short] * n)
        sections = f"<div class=sec><p>{long}</p></div>" + f"<div class=sec><p>{short}</p></div>" * n
        assert main_text(f"<body>{sections}</body>") == want
        assert main_text(f"<body><nav>Menu</nav><div>{sections}</div><div class=footer>{MORE}</div></body>") == want
        assert main_text(f"<body><p>{long}</p>" + f"<p>{short}</p>" * n + "</body>") == want
    valley = "".join(f"<p>{x}</p>" for x in [long, short, short, *[tiny] * 5, short, short])
    assert main_text(f"<body>{valley}</body>") == "\n".join([long, short, short, *[tiny] * 5, short, short])


P1, P2 = f"<p>{LONG}</p>", f"<p>{MORE}</p>"
NOTE = "<p>Great post, thank you so much for all the work that went into this, I have learned a lot here today.</p>"
THREAD = "".join(f'<li class="comment"><article><footer>by someone</footer>{NOTE}{NOTE}</article></li>' for _ in range(6))
LINKS = "".join(f"<li><a href={i}>Another story of some length, number {i}</a></li>" for i in range(8))
LAYOUTS = {
    "page-wide form": (f'<body><form id="aspnetForm" action="x"><div class="content">{P1}{P2}</div></form></body>', BOTH),
    "page-wide form around an article": (f"<body><form method=post><nav>Menu</nav><article>{P1}{P2}</article></form></body>", BOTH),
    "small form in an article": (f"<article>{P1}<form><label>Your name</label><input><p>Sign up here</p></form>{P2}</article>", BOTH),
    "wrapper that has a sidebar": (f'<body><div class="content has-sidebar">{P1}{P2}</div><div class="sidebar">{NOTE}</div></body>', BOTH),
    "wrapper with an open menu": (f'<body><div class="page menu-open">{P1}{P2}</div></body>', BOTH),
    "body class of a theme": (f'<body class="single comments-open no-sidebar"><div id="wrap">{P1}{P2}</div></body>', BOTH),
    "wrapper named like a banner": (f'<body><div class="banner">{P1}{P2}</div></body>', BOTH),
    "wrapper named widget around an article": (f'<div class="widget"><article>{P1}{P2}</article></div><div class="widget">{NOTE}</div>', BOTH),
    "section of side effects": (f'<article>{P1}<section class="side-effects"><h2>Risks</h2>{P2}</section></article>', f"{LONG.strip()}\nRisks\n{MORE.strip()}"),
    "list of related work": (f'<article>{P1}<ul class="related-work"><li>{MORE}</li><li>Two</li></ul></article>', f"{BOTH}\nTwo"),
    "comments as articles inside the post": (f'<article>{P1}{P2}<section id="comments"><ol>{THREAD}</ol></section></article>', BOTH),
    "comments as articles, page without an article": (f'<div class="entry">{P1}{P2}</div><div id="comments"><ul class="comment-list">{THREAD}</ul></div>', BOTH),
    "comment articles with their own class": (f"<main>{P1}{P2}" + f'<article class="comment depth-1">{NOTE}{NOTE}</article>' * 5 + "</main>", BOTH),
    "two articles": (f"<main><article>{P1}</article><article>{P2}</article></main>", BOTH),
    "two articles without main": (f"<body><nav>x</nav><div><article>{P1}</article><article>{P2}</article></div><footer>y</footer></body>", BOTH),
    "table in an article": (f"<article>{P1}<table><tr><th>Name<th>Size<tr><td>a<td>2</table>{P2}</article>", f"{LONG.strip()}\nName Size\na 2\n{MORE.strip()}"),
    "links to related posts": (f'<article>{P1}{P2}</article><div class="related-posts"><ul>{LINKS}</ul></div>', BOTH),
    "hinted block of links": (f'<body><div class="story">{P1}{P2}</div><div class="trending-now"><ul>{LINKS}</ul></div></body>', BOTH),
    "camel case names": (f'<body><div id="topMenu">{NOTE}</div><div>{P1}{P2}</div><div class="siteFooter">{NOTE}</div></body>', BOTH),
    "sidebar with text": (f'<body><div class="sidebar-left">{NOTE}</div><div class="post">{P1}{P2}</div></body>', BOTH),
    "header of an article": (f"<article><header><h1>Head</h1></header>{P1}{P2}<footer>me</footer></article>", f"Head\n{BOTH}"),
    "definition list": (f"<article>{P1}<dl><dt>One<dd>First<dt>Two<dd>Second</dl>{P2}</article>", f"{LONG.strip()}\nOne\nFirst\nTwo\nSecond\n{MORE.strip()}"),
    "advert longer than the article": (f'<div class="ad">{LONG}</div><article><h1>Head</h1><p>Short.</p></article>', "Head\nShort."),
    "teaser article beside a page named like a menu": (f'<div class="menu">{P1}{P2}</div><div class="teaser"><article>Next</article></div>', BOTH),
    "fieldset in a page-wide form": (f"<form><div>{P1}{P2}</div><fieldset><legend>Vote</legend>Yes</fieldset></form>", BOTH),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    page, want = LAYOUTS[layout]
    assert main_text(page) == want
