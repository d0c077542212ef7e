"""Operator 1: names that say little, notices of any name, and time that follows the page's length."""

import time

import pytest
from kmerloom.llm import html_text

TWO = "<p>The first paragraph of the article has a good deal of text, enough for a surge of weight.</p><p>The second paragraph of it goes on for some while, too, as it has to do here.</p>"
WANT = "The first paragraph of the article has a good deal of text, enough for a surge of weight.\nThe second paragraph of it goes on for some while, too, as it has to do here."


@pytest.mark.parametrize("word", "legal discussion search comments recommended tags social alert promo".split())
def test_single_words_beside_the_article(word):
    page = f'<html><body><ul class="menu"><li><a href="/">Home</a></ul><div class="article {word}">{TWO}</div><div class="{word}"><p>x</p></div></body></html>'
    assert html_text.main_text(page) == WANT


@pytest.mark.parametrize("other", [
    '<div class="reader-feedback"><p>I liked this article very much and will surely come back to read the next one.</p></div>',
    '<section class="user-opinions"><p>What nonsense, says a reader who did not get beyond the first paragraph of it.</p></section>',
    '<div class="cc-window"><p>We use cookies to make this page better for you. Accept them all or read our policy.</p></div>',
    '<div class="bottom"><p>© 2024 The Example Times. All rights reserved, in this and in all other countries.</p></div>',
    '<div class="x1"><p>Copyright 2024 by the publisher of this page and its many affiliated companies.</p></div>'])
def test_notices_and_readers_of_any_name(other):
    page = f"<html><body><div>{TWO}</div>{other}</body></html>"
    assert html_text.main_text(page) == WANT


def test_posts_keep_other_articles_apart():
    page = f'<body><div class="post">{TWO}</div><div class="post comments"><p>A reader comment that is long enough to look like a text of the article.</p></div></body>'
    assert html_text.main_text(page) == WANT


def test_articles_about_rights_and_cookies_stay():
    text = "Copyright law of the nineteenth century was the work of many hands."
    assert text in html_text.main_text(f"<body><article>{TWO}<p>{text}</p><p>Bake the cookies, and accept that some will burn.</p></article></body>")
    long = "The court held that cookies may be set where readers agree. " * 8
    assert html_text.main_text(f"<body><div>{TWO}<p>{long}</p></div></body>") == WANT + "\n" + long.strip()


def test_many_suspects_around_the_article():
    took = []
    for n in (20_000, 80_000):
        page = "<div class=sidebar>t" * n + f"<main>{TWO}</main>"
        began = time.perf_counter()
        assert WANT in html_text.main_text(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 and took[1] < 12 * took[0]
