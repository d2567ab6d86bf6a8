"""Main text: markup as browsers read it, weights that tell words apart, and the run against brute force."""

import collections
import html
import random
import time
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexquarry.llm import main_text, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def weights(spark, pages):
    return main_text.learn(spark.createDataFrame(pages[::2], "page_id long, html string"))


def article_text(page):
    """All of the one marked article of a plain page."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p|ul|li|div)[^>]*>", body.replace("<br>", " "))
    return "\n".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)))


def f1(a, b):
    x, y = collections.Counter(a.split()), collections.Counter(b.split())
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values()))


def test_markup():
    w = main_text.Weights()
    assert main_text.extract("<article><p data-x=it's>Hello...</p><p>Second part. It's here now</p></article>", w) == "Hello...\nSecond part. It's here now"
    assert main_text.extract("<article><!--><p>After it</p><!---><p>1 < 2 > 1</p><!-- x --!><p a='b>' c=\"d>\" e = f>end</p></article>", w) == "After it\n1 < 2 > 1\nend"
    assert main_text.extract('<p>One of them<p class="ad">An advert here<p>Two more words <script>if (a</p>"</scr")</script>and three</p><style>p{', w) == "One of them\nTwo more words and three"


def test_menu_and_copyright_of_an_unmarked_page(weights):
    menu = "".join(f'<li><a href="/{i}">One menu link of six words</a></li>' for i in range(8))
    page = f"<html><body><ul>{menu}</ul><h1>The title of it</h1><p>This is a long paragraph that goes on for some time and says a lot of things.</p><ul><li>An item</li></ul><p>A short one.</p><p>&copy; 2024 Some Company, all rights reserved</p></body></html>"
    for w in (weights, main_text.Weights()):
        assert main_text.extract(page, w) == "The title of it\nThis is a long paragraph that goes on for some time and says a lot of things.\nAn item\nA short one."


def test_held_out_pages(pages, weights):
    for _, page in pages[1::2]:
        want = article_text(page)
        assert main_text.extract(page, weights) == want
        assert f1(main_text.extract(re.sub(r"</?article>", "", page), weights), want) > 0.95


def test_adverts_and_comments_in_an_article(weights):
    noise = '<div class="promo">Buy this one thing now, it is really very good and cheap, and so on for many words.</div>' * 20
    page = f'<body><p>A teaser of another story that is long enough to be text.</p><article><h1>Title</h1><p>First.</p>{noise}<section id="reader-comments"><p>I do not agree with any of this at all.</p></section><p>Last.</p></article></body>'
    assert main_text.extract(page, weights) == "Title\nFirst.\nLast."


PIECES = ["<p>", "</p>", "<div class='ad'>", "</div>", "<a href=x>", "</a>", "<article>", "</article>", "<ul><li>", "<br>", "some words of text", " x ", "&amp;", "<nav>", "</nav>", "© mine"]


def test_the_run_is_the_best(weights):
    rng = random.Random(1)
    for _ in range(300):
        tokens = main_text.units("".join(rng.choices(PIECES, k=rng.randint(0, 14))))
        value = main_text.scores(tokens, weights)
        a, b = main_text.best_run(value)
        assert sum(value[a:b]) == pytest.approx(max([0, *(sum(value[i:j]) for i in range(len(value)) for j in range(i, len(value) + 1))]))
        blocks, now = [], ""
        for (tag, text, _, _, n), x in zip(tokens[a:b], value[a:b]):
            if tag.lstrip("/") in main_text._BLOCK:
                blocks, now = [*blocks, now], ""
            now += " " if tag == "br" else text if not tag and (x > 0 or not n) else ""
        assert [" ".join(html.unescape(x).split()) for x in [*blocks, now] if html.unescape(x).split()] == [x for x in _text(tokens, value, a, b).split("\n") if x]


def _text(tokens, value, a, b):
    """What extract() makes of a run."""
    original = main_text.units, main_text.scores, main_text.best_run
    try:
        main_text.units, main_text.scores, main_text.best_run = (lambda page: tokens), (lambda t, w: value), (lambda v: (a, b))
        return main_text.extract("", main_text.Weights())
    finally:
        main_text.units, main_text.scores, main_text.best_run = original


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pabdiv \"'=!-&;", max_size=80))
def test_any_markup_gives_clean_blocks(page):
    out = main_text.extract(page, main_text.Weights())
    assert all(block and block == " ".join(block.split()) for block in out.split("\n")) or not out


def test_clashing_columns_nulls_and_repeats(spark, weights):
    rows = [(1, "<p>Some words here</p>", "old", 7), (1, "<p>Some words here</p>", "old", 7), (2, None, None, None), (None, "", "x", 0), (3, "<p>" + "word " * 200_000 + "</p>", "", 1)]
    out = main_text.main_text(spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int"), weights)
    assert out.columns == ["page_id", "html", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in out.collect()) == [(0, 0), (1, 15), (1, 15), (2, 0), (3, 999_999)]


def test_registered(spark):
    out = registry.queries()["op5_main_text"](spark, SF)
    assert out.dtypes[:4] == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert all(r.n_chars == len(r.text) for r in out.collect()) and out.count() == spark.read.parquet(f"{SF}/pages.parquet").count()


@pytest.mark.parametrize("page", ["<b>x" * 40_000 + "</i>y" * 40_000, "<h1>x" * 40_000, "<b>x" * 20_000 + "<h2>y</em>" * 20_000])
def test_tags_that_close_nothing_take_no_time(page):
    start = time.process_time()
    assert len(main_text.parse(page)) >= 80_000
    assert time.process_time() - start < 10


def test_end_tags_close_what_is_open():
    """Elements within a closed one are closed with it; one that isn't open closes nothing."""
    names = [sorted(k for k in kinds if k[:3] == "in:") for tag, text, kinds, _ in main_text.parse("<div><b><i>a</div>b</i>c<p><b>d<p>e</b>f</p>g<b>h</b></b>i") if not tag]
    assert names == [["in:b", "in:div", "in:i"], [], [], ["in:b", "in:p"], ["in:p"], ["in:p"], [], ["in:b"], []]
