"""Place and names decide what they say; density the rest. Broken pages take linear time."""

from __future__ import annotations

import time

from reelgrid.llm.html_extract import extract_pages, main_text

PROSE = "This is the story of a house that was built by the river, and of all the people who had to live in it for so long."
LINKS = "".join(f"<a href=/{i}>topic number {i}</a> " for i in range(30))


def test_text_outside_a_teaser_article():
    got = main_text(f"<body><article><p>A teaser.</p></article><div>{PROSE}</div><div>Menu</div><div>{PROSE}</div><div>{LINKS}</div></body>")
    assert got.count(PROSE) == 2 and "topic" not in got


def test_names_are_whole_and_stop_at_an_article():
    for name in ("layout has-sidebar", "post no-comments", "sidebar"):
        assert main_text(f"<div class='{name}'><article><p>{PROSE}</p></article></div>") == PROSE
    assert main_text(f"<div class='layout has-sidebar'><p>{PROSE}</p></div>") == PROSE
    for name in ("sidebar", "cookie-notice", "widget sidebar-2", "comment-list"):
        assert main_text(f"<div class='{name}'><p>{PROSE}</p></div><article><p>Short.</p></article>") == "Short."
    assert main_text(f"<div class=comments><article class=comment><p>{PROSE}</p></article></div>") == ""


def test_place_holds_at_any_length():
    long = " ".join([PROSE] * 8)
    for where in ("section class=comments", "div class=cookie-notice", "aside", "footer", "div id=sidebar", "nav", "form", "div role=banner"):
        tag = where.split()[0]
        assert main_text(f"<article><p>Short.</p></article><{where}><p>{long}</p></{tag}>") == "Short."
        assert main_text(f"<article><p>Short.</p><{where}><p>{long}</p></{tag}></article>") == "Short."
    assert main_text(f"<article><p>Short.</p></article><div class=comments><article><p>{long}</p></article></div>") == "Short."


def test_nothing_of_an_article_is_dropped():
    page = "<article><h1>Reports</h1><ul><li><a href=/1>Annual Report 2021</a></li><li><a href=/2>Annual Report 2022</a></li></ul><p>Source: <a href=/b>Bridge Act 1999</a></p><p>12</p></article>"
    assert main_text(page, "|") == "Reports|Annual Report 2021|Annual Report 2022|Source: Bridge Act 1999|12"
    assert "topic" not in main_text(f"<div><p>{PROSE}</p></div><div>{LINKS}</div>")


def test_broken_pages_are_read_in_linear_time():
    n = 1 << 20
    pages = (
        "<a x" * (n // 4) + '"', "<a x='" * (n // 6), "<p title=\"" * (n // 10), "<" * n, "<b>" * (n // 6) + "</i>" * (n // 8), "<li><div>" + "<b>" * (n // 6) + "<li></li>" * (n // 18),
        "<p " + "a" * n + ">x", "<p>" + "!" * n + "a", "<!--" * (n // 4), "<![CDATA[" * (n // 9), "</" * (n // 2), "<p a" + " " * n + "b>x", "<div class='" + "x-" * (n // 2) + "'>y", "&" * n, "<script>" * (n // 8),
    )
    for page in pages:
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 4, page[:20]
    assert main_text("<article><p title='it>s' class=x>One &amp; <b>two</b>. 1 < 2 </p><p>it's</article>") == "One & two. 1 < 2\nit's"


def test_blocks_of_pages_are_joined_by_two_line_feeds(spark):
    page = f"<article><h1>A title</h1><p>{PROSE}</p><p>Yes.</p></article>"
    (got,) = extract_pages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).collect()
    assert got.text == f"A title\n\n{PROSE}\n\nYes." and got.n_chars == len(got.text)
