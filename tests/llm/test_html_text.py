import time

import numpy as np
import pytest

from liveness.llm import html_text as H

from .cases import clashing, rows

PAGES = "page_id long, url string, html string"
ARTICLE = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t=\"</p>\";</script></head><body>"
           "<nav><ul><li><a href='/x'>Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class=\"ad\">Buy now.</div>"
           "<article><h1>Head &amp; line</h1><p><b>First &lt;one&gt;  two\n three.<br><p>Sh is.</p><p>The.</p>"
           "<div class='ad-slot'>Advert</div><form><label>Mail</label><input></form><p>A &copy b&nbsp;c</p>"
           "<section id='comments'><p>Reader says.</p></section></article>"
           "<aside>Side bar</aside><div class=\"cookie-notice\">We use cookies</div><footer>&copy; foot &middot; er</footer></body></html>")


def test_article():
    assert H.main_text(ARTICLE) == "Head & line\nFirst <one> two three.\nSh is.\nThe.\nA © b c"


LONG = "Here is a sentence of some length that belongs to the story and goes on for a while, as stories do."


def test_surge_and_dive_without_a_named_article():
    page = ("<body><div><a href=1>Home</a></div><div><a href=2>News</a></div><div><a href=3>Mail</a></div><div><a href=4>More</a></div>"
            f"<div><div>{LONG}</div><div>Short.</div><div>{LONG}</div></div>"
            "<div><a href=5>Next</a></div><div><a href=6>Imprint</a></div><div><a href=7>Terms</a></div></body>")
    assert H.main_text(page) == f"{LONG}\nShort.\n{LONG}"


def test_surges():
    w = np.array([2, 0, 0, 0, 50, 40, 1, 60, 0, 0, 0, 3])
    assert H.surges(w, 3, 86).nonzero()[0].tolist() == [4, 5, 6, 7]
    assert not H.surges(w, 3, 1000).any()
    assert H.surges(np.zeros(0, np.int64), 3, 1).tolist() == []


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain text", "plain text"), ("<p>Short.</p>", "Short."), ("a < b and c > d", "a < b and c > d"),
    ("<article><p>unclosed <b>bold<p>next", "unclosed bold\nnext"), ("<div class=ad>x<article>story</article>", "story"),
    ("<article>a</article><article class=teaser>b</article>", "a"), ("<main><header><h1>T</h1></header>x</main><header>top</header>", "T\nx"),
    ("<article><script>if (a < b) { c('</p>') }</script>y<style>z</style></article>", "y"), ("<article>" + "</p>" * 3 + "k</article>", "k"),
    ("<article><p hidden>h</p><p aria-hidden=\"true\">i</p><p aria-hidden=false>j</p></article>", "j"),
    ("<article>a&amp;b &#228; &am x &amp</article>", "a&b ä &am x &"), ("<article><p title=\"a > b\">q</p></article>", "q"),
    ("<article><!-- never closed <p>x</p>", ""), ("<article>&nbsp;</article>", ""), ("<nav>only a menu</nav>", ""),
])
def test_odd_pages(page, text):
    assert H.main_text(page) == text


def test_table(spark):
    data = [(1, "u", ARTICLE), (1, "u", ARTICLE), (2, None, None), (None, "v", ""), (3, "w", "<article>" + "é x " * 100_000 + "</article>")]
    got = H.extract_main_text(clashing(spark.createDataFrame(data, PAGES)))
    want = [(i, u, H.main_text(h or ""), len(H.main_text(h or ""))) for i, u, h in data]
    assert rows(got, "page_id", "url", "text", "n_chars") == sorted(want, key=repr)
    assert H.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


STORY = "".join(f"<p>{LONG}</p>" for _ in range(4))


def test_a_card_does_not_cost_the_story_outside_it():
    page = f"<body><article><p>A related story in a card.</p></article><div>{STORY}</div></body>"
    assert H.main_text(page).count(LONG) == 4
    # a card between its paragraphs neither
    half = f"<p>{LONG}</p>" * 2
    assert H.main_text(f"<div>{half}</div><article><p>A card.</p></article><div>{half}</div>").count(LONG) == 4


def test_an_article_with_the_largest_surge_is_the_page():
    page = f"<div>{LONG}</div><main>{STORY}<div class=ad><p>a</p><p>b</p><p>c</p><p>d</p></div><p>The end.</p></main><div>{LONG}</div>"
    assert H.main_text(page) == "\n".join([LONG] * 4 + ["The end."])


def test_windows_decide_inside_an_article_too():
    """A list of links is a dive; short lines and linked headings beside a surge stay."""
    links = "".join(f"<p><a href={i}>Read this one too, number {i}</a></p>" for i in range(4))
    page = f"<article><h1>T</h1><p>By A.</p><p>Today</p><p>Now</p>{STORY}<h2><a href=x>Next</a></h2>{STORY}{links}</article>"
    assert H.main_text(page) == "\n".join(["T", "By A.", "Today", "Now", *[LONG] * 4, "Next", *[LONG] * 4])


@pytest.mark.parametrize("around", ["article class='post category-social'", "article class=has-form", "div class='content no-sidebar'",
                                    "div class=sidebar", "article class='post social'", "section id=widget-1"])
def test_a_name_does_not_cost_the_story(around):
    tag = around.split()[0]
    page = f"<div class=ad>{LONG}</div><{around}>{STORY}<div class=comments><p>{LONG}!</p></div></{tag}><p>Short.</p>"
    assert H.main_text(page).split("\n")[:4] == [LONG] * 4 and "!" not in H.main_text(page)
    assert len(H.main_text(page).split("\n")) in (4, 5)


def test_names_are_compared_whole():
    page = f"<article>{STORY}<p class=share-price>Up by 3.</p><div class=share-buttons>Share</div><p class=ad-slot>Buy</p></article>"
    assert H.main_text(page) == "\n".join([LONG] * 4 + ["Up by 3."])


def test_a_name_holds_beside_a_larger_story():
    page = f"<div>{STORY}</div><div class=sidebar><p>{LONG}?</p></div><section class=comment-list>{STORY * 3}</section>"
    assert H.main_text(page) == "\n".join([LONG] * 4)


@pytest.mark.parametrize("page,kept", [
    ("<p>x</p>" + "<a " * 1_600_000, "x"), ("<div>" * 100_000 + "x", "x"), ("<div>" * 50_000 + "</span>" * 100_000 + "x", "x"),
    ("<div class=sidebar>y" * 100_000, "y"), ("<article>y" * 100_000, "y"), ("<button>" * 200_000 + "x", ""), ("<a '" * 500_000 + ">x", ""),
])
def test_odd_pages_of_megabytes_take_seconds(page, kept):
    began = time.time()
    assert H.main_text(page).startswith(kept)
    assert time.time() - began < 15


def test_surges_match_their_definition():
    """A line is kept if some window at or before it surges and no window from there to it is empty."""
    r = np.random.default_rng(6)
    for _ in range(400):
        w = r.choice([0, 0, 1, 5, 30, 60, 90], r.integers(0, 25))
        window, least = int(r.integers(1, 5)), int(r.integers(1, 120))
        total = [int(w[i:i + window].sum()) for i in range(len(w))]
        want = [w[i] > 0 and any(total[j] >= least and all(t > 0 for t in total[j:i + 1]) for j in range(i + 1)) for i in range(len(w))]
        assert H.surges(w, window, least).tolist() == want


WORDS = "the a river house grey morning people said went over old small quiet street letter rain again never table window".split()


def made_page(r):
    """A page of divs and spans only, without articles, class names or ids, and the lines of its story."""
    sentence = lambda lo, hi: " ".join(r.choice(WORDS, r.integers(lo, hi))).capitalize() + "."
    linked = lambda n: "".join(f"<div><a href=/{i}>{sentence(1, 5)}</a></div>" for i in range(n))
    story, body = [], ""
    for _ in range(r.integers(1, 4)):
        if r.random() < 0.5:
            story.append(sentence(2, 6))
        story += [sentence(25, 60) for _ in range(r.integers(2, 5))]
    for line in story:
        words = line.split()
        if r.random() < 0.3:  # a link inside the text
            words[1] = f"<a href=/x>{words[1]}</a>"
        body += f"<div>{' '.join(words)}</div>"
    page = (f"<body><div>{sentence(1, 3)}</div>{linked(r.integers(4, 12))}<div><div>{body}</div></div>"
            f"{linked(r.integers(4, 12))}<div><span>{sentence(1, 5)}</span></div><div><a href=/t>Terms</a> <a href=/i>Imprint</a></div></body>")
    return page, story


def test_windows_find_the_story_of_pages_that_name_nothing():
    """Nothing but the line-block distribution tells the story on these pages: precision and recall by words."""
    r = np.random.default_rng(11)
    right = kept = there = whole = 0
    for _ in range(300):
        page, story = made_page(r)
        got = H.main_text(page).split("\n")
        words = lambda lines: sum(len(x.split()) for x in lines)
        right += words([x for x in got if x in story])
        kept += words(got)
        there += words(story)
        whole += got == story
        # without windows every line outside links would stay
        assert len(got) <= len([1 for text, linked, *_ in H.lines(page)[0] if len(text) > linked])
    print(f"precision {right / kept:.4f}, recall {right / there:.4f}, exact pages {whole}")
    assert right / kept >= 0.99 and right / there >= 0.99
