"""Main text of pages written and marked by hand, of odd ones, and of deep ones."""

import time

import pytest

from murmur.llm import main_text as M

PAGES = [
    ("plain words &amp; nothing else\n\tat all", "plain words & nothing else at all"),
    (
        "<!DOCTYPE html><html lang=en><head><title>How to bake bread | Kitchen</title><style>p{color:red}</style></head><body><header><a href=/>Kitchen</a></header>"
        "<nav><ul><li><a href=/a>Home</a><li><a href=/b>Recipes</a></ul></nav><main><article><h1>How to bake bread</h1><p>Mix the flour with <em>luke&shy;warm</em> water and let it rest.</p>"
        "<p>Knead it for ten minutes.<br>Then wait.</p><ul><li>500 g flour</li><li>300 ml water</li></ul><script>track('x')</script>"
        "<section class='comments'><h2>2 comments</h2><div class=comment><p>nice post I say</p></div><div class=comment><p>Mine was flat, what did I do wrong with the dough?</p></div></section></article></main>"
        "<aside class=sidebar><h3>Popular</h3><p>Ten soups for cold days you should try soon</p></aside><footer><p>(c) Kitchen, all rights reserved, terms and privacy</p></footer></body></html>",
        "How to bake bread\n\nMix the flour with luke­warm water and let it rest.\n\nKnead it for ten minutes. Then wait.\n\n500 g flour\n\n300 ml water",
    ),
    (
        "<html><body><div id=cookie-banner><p>We use cookies to make this site better for you.</p><button>OK</button></div><div class='content article-body'><h1>The old mill</h1>"
        "<p>The mill stood <b>by the river</b> for two hundred years.</p><div class='ad inline'><p>Buy new windows now, only this week</p></div>"
        "<p>Its area is <math><mi>a</mi><mo>=</mo><mn>42</mn></math> square metres, as the map has it.</p><form class=newsletter><p>Get our letter every week</p><input name=mail></form>"
        "<p>Nobody lives there now.</p></div><div class='footer copyright'>Imprint</div></body></html>",
        "The old mill\n\nThe mill stood by the river for two hundred years.\n\nIts area is a=42 square metres, as the map has it.\n\nNobody lives there now.",
    ),
    ("<article><p>Ein Absatz ohne Ende<p>und noch einer mit <a href='/x'>einem Verweis</a> darin</article>", "Ein Absatz ohne Ende\n\nund noch einer mit einem Verweis darin"),
    ("<html><body><nav><a href=/>Start</a></nav></body></html>", ""),
    ("", ""),
    ("<div><!-- nothing --></div><script>var a = '<p>no text</p>';</script>", ""),
]


@pytest.fixture(scope="module")
def model():
    return M.train()


@pytest.mark.parametrize("page,text", PAGES)
def test_pages_marked_by_hand(model, page, text):
    assert model.extract(page) == text


def test_comments_inside_articles_are_out_and_nothing_else(model):
    text = [f"<p>paragraph {i} of the article goes on for some words</p>" for i in range(6)]
    for name in ("comments", "comment-list", "responses", "disqus"):
        for where in (6, 3):
            parts = [*text[:where], f"<div id='{name}'><div class='comment'><p>I liked it a lot, thanks for writing</p></div></div>", *text[where:]]
            got = model.extract(f"<html><body><article><h1>A title</h1>{''.join(parts)}</article></body></html>")
            assert got.split("\n\n") == ["A title", *[f"paragraph {i} of the article goes on for some words" for i in range(6)]], (name, where)


@pytest.mark.parametrize(
    "page",
    ["<div>" * 50000 + "a b c", "<b>" * 50000 + "<ul></ul>" * 50000, "<i>" * 50000 + "</u>" * 50000, "".join(f"<div class='c{i}'>" for i in range(50000)) + "word", "<p><b>" * 50000, "<" * 50000, "<a b='" * 20000],
)
def test_deep_and_broken_pages_take_no_time(model, page):
    began = time.time()
    model.extract(page)
    assert time.time() - began < 4


def test_extraction_of_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "<p>a  b</p>", "y"), (2, "<p>a  b</p>", "y")], "page_id long, html string, text string")
    got = M.main_text(df, out_col="text").collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, ""), (2, "a b"), (2, "a b")]
