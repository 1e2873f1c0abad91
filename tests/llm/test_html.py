"""HTML extraction: broken pages, pages without telling mark-up, and whole tables against a plain cutter of articles."""

import html
import re
import time

import duckdb
import numpy as np
import pytest

from millrace.llm import html_text, registry

SF = "/root/testdata/sf0.001"
WHOLE = [
    ('<article><p>Some words here, of a text.</p><svg class="i"/><p>More words follow here now.</p></article>', "Some words here, of a text.\nMore words follow here now."),
    ("<article><p>One two three four five.</p><!--><p>After the comment it goes on.</p></article>", "One two three four five.\nAfter the comment it goes on."),
    ("<article><p title=it's>Here is a sentence of words.</p></article>", "Here is a sentence of words."),
    ('<article class="share-post"><p>Here is a sentence of words.</p></article>', "Here is a sentence of words."),
    ('<article><p title="a > b">One is less than two: 1 < 2.<p>It\'s an unclosed "quote here.</article>', 'One is less than two: 1 < 2.\nIt\'s an unclosed "quote here.'),
    (
        "<div><p>Short one.</p><p>One paragraph of some eighteen words stands here among short ones, to see what the method makes of it.</p><p>Another short.</p></div>",
        "Short one.\nOne paragraph of some eighteen words stands here among short ones, to see what the method makes of it.\nAnother short.",
    ),
]


@pytest.mark.parametrize("page,text", WHOLE)
def test_nothing_else_is_dropped(page, text):
    assert html_text.main_text(page) == text


def test_headline_in_the_articles_own_header_stays():
    page = '<body><header><h2>Daily News of the Town</h2></header><article><header><h1>Headline here</h1></header><p>Text of it goes on and on.</p></article><footer><h3>Contact</h3></footer></body>'
    assert html_text.main_text(page) == "Headline here\nText of it goes on and on."


def test_long_comments_go():
    long = "This is what a reader has to say about it, at some length and with a good many words, so that it looks like any paragraph of the article above, which it is not, however well it is written and however long it goes on. " * 2
    page = f'<main><article><h1>Title of it</h1><p>{long}</p><p>A short end.</p></article><section class="reader-comments"><div><p>{long}</p></div><p>Nice one.</p></section></main><div class="notice"><p>{long}</p></div>'
    assert html_text.main_text(page) == f"Title of it\n{long.strip()}\nA short end."
    pages = [h for (h,) in duckdb.sql(f"select html from '{SF}/pages.parquet' where html is not null").fetchall()]
    assert html_text.main_text(page, weights_of(pages)) == html_text.main_text(page)


BIG = ['<a "' * 250_000, "<div>" * 100_000 + "text", "</b>" * 100_000 + "<i>" * 100_000, '<a href="' * 100_000, "<!--" * 200_000, "<svg>" * 100_000, "<p>word word word.</p></div>" * 20_000, "<a x='" * 100_000]


@pytest.mark.parametrize("page", BIG, ids=range(len(BIG)))
def test_broken_pages_take_no_longer_than_their_length(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 5


BLOCK = r"</?(?:p|h1|h2|h3|ul|ol|li|div|table|tr|td|th|blockquote|pre|article|section)\b[^>]*>"


def plain(page):
    """The text of the first article by patterns alone: good for the made-up pages, whose articles nest nothing."""
    m = re.search(r"<article\b[^>]*>(.*?)(?:</article>|<footer|$)", page, re.S)
    if not m:
        return ""
    body = re.sub(r"<!--.*?-->|<(script|style|form|aside)\b.*?</\1>", "", m[1], flags=re.S)
    blocks = re.split(BLOCK, re.sub(r"<br\s*/?>", " ", body))
    texts = [" ".join(html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_whole_table(spark):
    pages = dict(duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall())
    got = {r.page_id: r for r in registry.QUERIES["op7_html_extraction"](spark, SF).collect()}
    assert got.keys() == pages.keys()
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert {d: r.text for d, r in got.items()} == {d: plain(p or "") for d, p in pages.items()}


def weights_of(pages):
    rows = np.array([html_text.features(b) for p in pages for b in html_text.sampled(html_text.blocks_of(p), 60)])
    labels = [html_text.mark_up_says(tuple(x)) for x in rows.tolist()]
    known = np.array([y is not None for y in labels])
    rows, y = rows[known], np.array([y for y in labels if y is not None], float)
    bare = rows.copy()
    bare[:, html_text.MARKUP] = 0.0
    return html_text.fit(np.concatenate([rows, bare]), np.concatenate([y, y]))


def test_the_cut_decides_where_mark_up_says_little():
    """Pages without class names, semantic tags and paragraphs: the cut changes labels of the classifier, and mostly for the better."""
    pages = [h for (h,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' where html is not null order by page_id").fetchall()]
    weights = weights_of(pages[:100])
    n = changed = by_cut = alone_right = 0
    for p in pages[100:]:
        bare = re.sub(r"<(/?)(article|main|nav|footer|header|aside|form|section)\b", r"<\1div", p)
        bare = re.sub(r"<(/?)(p|h1|h2|h3|li|ul)\b(?=[^>]*>)", r"<\1dd", bare)
        bare = re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", bare)
        blocks, stripped = html_text.blocks_of(p), html_text.blocks_of(bare)
        if len(blocks) != len(stripped) or not blocks:
            continue
        truth = html_text.label(blocks, weights)[1]
        cut, alone = html_text.label(stripped, weights)
        n += len(blocks)
        changed += sum(a != b for a, b in zip(cut, alone))
        by_cut += sum(a == b for a, b in zip(cut, truth))
        alone_right += sum(a == b for a, b in zip(alone, truth))
    assert changed > 0.05 * n and by_cut > alone_right + 0.05 * n


def test_fit_without_a_sample_is_the_prior(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert np.allclose(html_text.fitted(empty), list(html_text.PRIOR.values()))
    same = spark.createDataFrame([(None, None, "<p>only a few words</p>")] * 5, "page_id long, url string, html string")
    assert np.isfinite(html_text.fitted(same, sample=2)).all()
