"""Pages in which the windows decide inside article and main, and parts that half a name must not cost their text."""

import pytest

from quillstone.llm import html

ONE = "The first paragraph of the story is long enough to be one, and it says so in many words, as first ones do."
TWO = "A second paragraph follows the first, no shorter than it was, and brings the story to the middle of its way."
END = "The last one ends the story with as many words as it takes, which are about as many as in those before it."
BODY = f"<p>{ONE}</p><p>{TWO}</p><p>{END}</p>"
WANT = f"{ONE}\n{TWO}\n{END}"
LINKS = "".join(f"<li><a href='/{i}'>Link number {i}</a></li>" for i in range(6))
FRAMES = ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<html><body><main><article>{}</article></main></body></html>"]


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("name", ["article-header", "entry-header", "share-price", "social-history", "related-work", "banner-story", "menu-engineering-article"])
@pytest.mark.parametrize("kind", ["class", "id"])
def test_half_a_name_costs_no_text(frame, name, kind):
    part = f"<div {kind}='{name}'><h1>Title</h1><p>{ONE}</p></div>"
    assert html.main_text(frame.format(part + f"<p>{TWO}</p><p>{END}</p>")) == "Title\n" + WANT


def test_half_a_name_on_the_whole_article_or_page():
    assert html.main_text(f"<div id='share-price-story'>{BODY}</div>") == WANT
    assert html.main_text(f"<body class='home has-sidebar no-header'><div class='with-comments'>{BODY}</div></body>") == WANT
    assert html.main_text(f"<article id='share-price-story' class='post-menu-guide'>{BODY}</article>") == WANT


@pytest.mark.parametrize("name", ["ad", "ads ad-slot", "site-header", "page-footer", "main-nav", "left-sidebar", "cookie-notice", "post-comments", "comment-list", "share-buttons", "related-posts", "newsletter-signup", "advertisement", "article-sidebar"])
@pytest.mark.parametrize("frame", FRAMES)
def test_whole_names_go(frame, name):
    part = f"<div class='{name}'><p>{ONE.replace('story', 'offer')}</p></div>"
    assert html.main_text(frame.format(BODY + part)) == WANT and html.main_text(frame.format(part + BODY)) == WANT


@pytest.mark.parametrize("frame", FRAMES)
def test_doubtful_parts_of_links_or_few_words_go(frame):
    for part in (f"<div class='related-work'><ul>{LINKS}</ul></div>", "<div class='article-share'>Share this</div>", "<div class='story-banner'><p>Win now.</p></div>"):
        assert html.main_text(frame.format(BODY + part)) == WANT


def test_the_header_of_an_article_keeps_its_headline():
    assert html.main_text(f"<article><header><h1>Title</h1><p>By a writer of ours.</p></header>{BODY}</article>") == "Title\nBy a writer of ours.\n" + WANT
    assert html.main_text(f"<header><h1>Site</h1></header><article><header><a href='/'>Home</a></header>{BODY}</article>") == WANT


@pytest.mark.parametrize("frame", FRAMES)
def test_short_and_linked_paragraphs_stay(frame):
    short = f"<h1>Title</h1><p>Yes.</p><p>No.</p>{BODY}<p>Why?</p>"
    assert html.main_text(frame.format(short)) == f"Title\nYes.\nNo.\n{WANT}\nWhy?"
    linked = f"<p>{ONE}</p><p><a href='/x'>{TWO}</a></p><p>{END}</p>"
    assert html.main_text(frame.format(linked)) == WANT


@pytest.mark.parametrize("frame", FRAMES)
def test_the_windows_cut_what_nothing_marks(frame):
    menu = "<div>Home</div><div>About</div><div>Contact</div><div>Press</div>"
    small = "<div>© 2024 Example Inc.</div>"
    page = frame.format(f"{menu}<ul>{LINKS}</ul><h1>Title</h1>{BODY}<ul>{LINKS}</ul>{small}")
    assert html.main_text(page) == "Title\n" + WANT


def test_without_windows_pages_with_articles_keep_more(monkeypatch):
    """The windows, not the marks, decide these pages."""
    pages = [f.format(f"<p>{ONE}</p><div><div>Home</div><div>News</div><div>Mail</div><div>Shop</div></div><p>{TWO}</p><p>{END}</p><ul>{LINKS}</ul>") for f in FRAMES]
    right = [html.main_text(p) for p in pages]
    assert right == [WANT] * len(pages)
    monkeypatch.setattr(html, "main_spans", lambda blocks, supported=False: [True] * len(blocks))
    assert all(html.main_text(p) != WANT for p in pages)


@pytest.mark.parametrize("frame", FRAMES)
def test_unmarked_comments_and_notices_go(frame):
    said = "I have read this with great interest, and I must say that I could not agree more with all that was written."
    for title in ("Comments", "3 comments", "Comments (3)", "Leave a reply"):
        assert html.main_text(frame.format(f"{BODY}<section><h3>{title}</h3><p>{said}</p><p>{said}</p></section>")) == WANT
    after = frame.format(f"{BODY}<h2>Comments</h2><p>{said}</p><h2>Sources</h2><p>{ONE}</p>")
    assert html.main_text(after) == f"{WANT}\nSources\n{ONE}"
    notice = f"<div><p>We and our partners use cookies to store and read information on your device, to show adverts and to measure them. {ONE}</p></div>"
    assert html.main_text(frame.format(notice + BODY)) == WANT
    about = f"<p>We baked cookies by the dozen, and all who came to the house ate as many of them as they could.</p>{BODY}"
    assert html.main_text(frame.format(about)).endswith(WANT) and "dozen" in html.main_text(frame.format(about))


def test_rights_that_the_article_speaks_of_stay():
    assert html.main_text(f"<article>{BODY}<p>All rights reserved.</p></article>") == WANT + "\nAll rights reserved."
