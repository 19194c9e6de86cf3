"""Main text of pages whose markup is broken, hostile, or in other languages."""

import time

import pytest

from barweave.llm import html_text

ZH = "今天天气很好，我们去公园散步。" * 12
DE = "Der schnelle braune Fuchs springt heute über den faulen Hund, während Kinder lachen und Vögel singen. " * 4
RU = "Сегодня хорошая погода, мы идём гулять в парк и кормить птиц. " * 6


@pytest.mark.parametrize("html,text", [
    ('<div class="content has-sidebar"><article><p>Hello there</p></article></div>', "Hello there"),
    ('<div class="page sidebar-left"><main><p>Hello</p></main><div class="sidebar-left">Links</div></div>', "Hello"),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>Body</p></article>', "Title\nBody"),
    ('<article><p>Body</p></article><div class="related"><article>Other</article></div>', "Body"),
    ('<article><p>Body</p><section class="comments"><article class="comment">Nice</article></section></article>', "Body"),
    ("<article><p>one <span>two</span> three</p></article>", "one two three"),
    ('<article><p title="a > b">kept</p></article>', "kept"),
    ("<article><p title='open>kept</p><p>more</p></article>", "kept\nmore"),
    ("<article><p>a &lt; b &amp; 1 < 2</p><!-- never closed ", "a < b & 1 < 2"),
    ("<article>x<script>if (a < b) { '</p>' }</script>y</article>", "x y"),
    (f"<body><nav><a href=x>首页</a></nav><p>{ZH}</p><footer>版权所有</footer></body>", ZH),
    (f"<body><p>{DE}</p><ul><li><a href=x>Start</a></li></ul></body>", DE.strip()),
    (f"<body><p>{RU}</p></body>", RU.strip()),
    ("", ""), (None, ""), ("plain words", ""),
])
def test_extract(html, text):
    assert html_text.extract(html) == text


@pytest.mark.parametrize("piece", ["<a '", "<a '>'", "<div>", "</div><p>", "<", "<!--", "<a b=\"", "<p>x</p>", "<p class='sidebar x'>", "&amp;", "<script>"])
def test_a_megabyte_takes_seconds(piece):
    began = time.time()
    html_text.extract(piece * (1_000_000 // len(piece)))
    html_text.extract("<article>" + piece * (1_000_000 // len(piece)) + ">")
    assert time.time() - began < 30


def test_clashing_columns_and_nothing(spark):
    rows = spark.createDataFrame([(1, "<article>a</article>", "u", 2, None), (1, None, "v", 3, "x")], "page_id long, html string, _html string, html_ int, text string")
    got = html_text.main_text(rows)
    assert sorted(got.columns) == ["_html", "html_", "page_id", "text"] and sorted(r.text for r in got.collect()) == ["", "a"]
    assert html_text.main_text(rows.where("false")).count() == 0


PROSE = "The council met on Monday, and it was decided that the old bridge is to be repaired before the winter; the work will take three months, as the mayor said. "


def test_a_form_around_the_page_does_not_condemn_it():
    page = f"<form id='aspnetForm'><div class='menu'><a href=/>Home</a></div><div><article><p>{PROSE}</p></article></div><input value=x></form>"
    assert html_text.extract(page) == PROSE.strip()
    alone = f"<article><p>{PROSE}</p></article><form><p>Send us your address, please, and we will write.</p></form>"
    assert html_text.extract(alone) == PROSE.strip()


def test_a_linked_sentence_between_paragraphs_goes_with_them():
    said = "See the long report of the committee on the state of the bridges."
    page = f"<div><p>{PROSE * 2}</p><p>See <a href=x>the long report of the committee on the state of the bridges</a>.</p><p>{PROSE * 2}</p></div><div><a href=a>Home</a> | <a href=b>About</a></div>"
    assert html_text.extract(page).split("\n")[1] == said and "Home" not in html_text.extract(page)


def test_names_that_are_phrases_do_not_condemn():
    page = f"<article><div class='tags-of-war'><p>{PROSE}</p></div><div class='post-tags'><p>news, bridges, council</p></div></article>"
    assert html_text.extract(page) == PROSE.strip()
