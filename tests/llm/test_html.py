"""Extraction from pages made by hand: blocks that belong to the article begin with Kept."""

import time

import numpy as np
import pytest
from held_out_pages import PAGES as HELD_OUT

from pulsegrid.llm import html_extraction as he

LONG = "and then a sentence goes on for a while, with commas, until it is long enough to be a paragraph of its own. "
PAGES = {
    "blog of divs": f"""<html><head><title>t</title></head><body><div id="top-nav"><ul><li><a href=a>Home</a><li><a href=b>Archive</a></ul></div><div id="wrapper">
      <div class="entry-content"><h2>Kept title</h2><p>Kept one {LONG}</p><p>Kept: short.</p><blockquote>Kept quote {LONG}</blockquote><p><a href=x>Kept link alone in the text</a></p><p>Kept end {LONG}</p></div>
      <div class="sidebar"><h3>About</h3><p>I write {LONG}</p><ul><li><a href=1>One old post</a><li><a href=2>Another</a></ul></div>
      <div id="comments"><h3>3 replies</h3><div class="comment-body"><p>I agree {LONG}</p></div><div class="comment-body"><p>So do I {LONG}</p></div></div></div>
      <div id="footer">Powered by something nice.</div></body></html>""",
    "semantic": f"""<body><header><h1>The Site</h1><p>News that matters to all of us.</p></header><nav><a href=a>World</a> <a href=b>Sports</a></nav><main><article><header><h1>Kept headline</h1>
      <p>Kept byline, by a writer</p></header><p>Kept {LONG}</p><aside><p>Read also {LONG}</p></aside><figure><img src=x><figcaption>Kept caption.</figcaption></figure><p>Kept too {LONG}</p>
      <div class="newsletter-signup"><p>Get our letter {LONG}</p><form><input><button>Go</button></form></div><p>Kept last.</p></article></main><footer><p>&copy; The Site, all rights reserved.</p></footer>""",
    "wrapper with a name": f'<div class="layout sidebar-right"><article><p>Kept {LONG}</p><p>Kept {LONG}</p></article><div class="sidebar"><p>Our picks {LONG}</p></div></div>',
    "related wrapper": f'<div class="page related-left"><div class="story"><p>Kept {LONG}</p><p>Kept {LONG}</p></div><div class="related"><ul><li><a href=a>This one</a><li><a href=b>That one</a></ul></div></div>',
    "form around the page": f"""<body><form id="aspnetForm" method=post><div class="breadcrumb"><a href=a>Start</a> &gt; <a href=b>Here</a></div><div class="content"><h1>Kept</h1><p>Kept {LONG}</p>
      <p>Kept {LONG}</p></div><div class="login-box"><label>Name</label><input><p>Please log in to see more of this.</p></div></form></body>""",
    "old table": f"""<body><table><tr><td><a href=a>Home</a><br><a href=b>Links</a><br><a href=c>Mail</a><td><p>Kept {LONG}<p>Kept {LONG}<p>Kept {LONG}</td></tr></table>""",
    "comments longer than the text": f"""<article class="post"><h1>Kept</h1><p>Kept {LONG}</p></article><section class="comments"><h2>Comments</h2>{''.join(f'<article class="comment"><p>Number {i} {LONG}</p></article>' for i in range(12))}</section>""",
    "notices": f"""<body class="has-modal"><div class="cookie-banner" role="dialog"><p>We use cookies {LONG}</p></div><div id="main"><div class="share-bar"><a href=t>Tweet</a></div><h1>Kept</h1><p>Kept {LONG}</p>
      <div class="ad-slot"><p>Buy the best {LONG}</p></div><p>Kept {LONG}</p><p style="display: none">Hidden {LONG}</p><ul><li>Kept item one</li><li>Kept item two</li></ul></div>""",
    "no names": f"""<body><div><ul><li><a href=a>Home</a></li><li><a href=b>Shop</a></li><li><a href=c>Help</a></li></ul></div><div><h1>Kept name of it</h1><p>Kept {LONG}</p><p>Kept {LONG}</p><p>Kept it.</p></div>
      <div><ul><li><a href=d>Terms</a></li><li><a href=e>Privacy</a></li><li><a href=f>Jobs</a></li></ul><div>&copy; 2020 Us</div></div>""",
    "code": f"""<body><div role="navigation"><ul><li><a href=a>Install</a></ul></div><div class="document"><h1>Kept</h1><p>Kept {LONG}</p><pre>Kept x = 1
      y = 2</pre><p>Kept {LONG}</p><table><tr><th>Kept name<th>Kept value<tr><td>Kept a<td>Kept 1</table></div><div class="pagination"><a href=n>Next page</a></div>""",
    "head without an end": f"<html><head><meta charset=utf-8><title>t</title><link rel=x href=y><body><p>Kept {LONG}<p>Kept {LONG}<div class=ads>Win now!</div>",
    "icons and notes in lines": f"""<div class="post"><h1><span class="icon" aria-hidden="true">*</span>Kept</h1><p><i class="share-icon">&gt;</i> Kept {LONG}</p><p>Kept <span hidden>not seen</span>{LONG}</p>
      <p><span class="ad-label">Advert:</span></p><p>Kept {LONG}</p></div>""",
    "links in the text": f"<article><h1>Kept</h1><p>Kept {LONG}</p><p><a href=s>Kept source of it all</a></p><p>Kept {LONG}</p><ul><li><a href=1>Tag</a><li><a href=2>Other tag</a><li><a href=3>Third tag</a><li><a href=4>Last tag</a></ul></article>",
}


def measured(labels) -> float:
    right = wrong = lost = 0
    for page in PAGES.values():
        found = he.blocks(page)
        for b, keep in zip(found, labels(found), strict=True):
            want = "Kept" in b.text
            right += keep and want
            wrong += keep and not want
            lost += want and not keep
    return 2 * right / (2 * right + wrong + lost)


def cut(found):
    return he.min_cut(*he.graph(found, he.log_odds(found)))[: len(found)]


def test_the_cut_is_better_than_the_classifier_alone():
    alone = measured(lambda found: [x > 0 for x in he.log_odds(found)])
    with_cut = measured(cut)
    print(f"F1 of blocks: classifier alone {alone:.3f}, cut {with_cut:.3f}")
    assert with_cut >= 0.97 and with_cut > alone + 0.05  # the classifier knows names as well


def test_pages_that_nothing_was_chosen_by():
    right = wrong = lost = from_rule = from_nothing = 0
    for page in HELD_OUT:
        found = he.blocks(page)
        own, labels = he.log_odds(found), cut(found)
        rule = [b.element.evidence > 0 if b.element.evidence else x > 0 for b, x in zip(found, own, strict=True)]
        nothing = he.min_cut(*he.graph(found, [0.0] * len(found)))[: len(found)]
        from_rule += sum(a != b for a, b in zip(labels, rule, strict=True))
        from_nothing += sum(a != b for a, b in zip(labels, nothing, strict=True))
        for b, keep in zip(found, labels, strict=True):
            want = b.text.startswith("Kept")
            right, wrong, lost = right + (keep and want), wrong + (keep and not want), lost + (want and not keep)
    assert len(HELD_OUT) >= 30 and from_rule > 0 and from_nothing > 50
    assert 2 * right / (2 * right + wrong + lost) > 0.97


def test_names_count_within_a_bound():
    page = f'<div><div class="promo"><p>{LONG}</p></div></div>'
    (b,) = he.blocks(page)
    assert b.element.named == -1 and not b.element.evidence
    weights = he.PRIOR.copy()
    weights[10] = -1000
    assert he.log_odds([b], weights)[0] >= -he.CERTAIN - he.NAMED
    weights[10] = 0.0  # a name that means nothing: the text decides
    assert he.main_text(page, weights) == LONG.strip() and he.main_text(page) == ""


@pytest.mark.parametrize("name", list(PAGES))
def test_page(name):
    page = PAGES[name]
    kept = [b.text for b in he.blocks(page) if "Kept" in b.text]
    assert he.main_text(page).split("\n") == kept


def test_words_that_nobody_sees_are_left_out():
    text = he.main_text(PAGES["icons and notes in lines"])
    assert "*" not in text and "not seen" not in text and "Advert" not in text and "> Kept" in text


def test_a_wrapper_with_a_boilerplate_name_keeps_its_article():
    a = '<div class="layout sidebar-right"><article><p>(long paragraph)</p></article></div>'
    b = '<div class="page related-left"><div class="story"><p>Some words.</p><p>More words.</p></div></div>'
    assert he.main_text(a) == "(long paragraph)" and he.main_text(b) == "Some words.\nMore words."


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "<p>Kept text.</p>", "<blockquote><ul><li>" * 7_000 + "Kept text.", "<b class=x>" * 20_000 + "<p>Kept text.", "<article>" + "<p>Kept text.</p>" * 20_000])
def test_depth_and_width_cost_what_their_tags_cost(page):
    start = time.process_time()
    text = he.main_text(page)
    assert time.process_time() - start < 2 and set(text.split("\n")) == {"Kept text."}


def test_classifier_is_fitted_on_the_pages(spark):
    menu = "".join(f"<li><a href={i}>Go to {i}</a>" for i in range(4))
    pages = [f"<nav><ul>{menu}</ul></nav><article><p>Words {i} {LONG}</p><p>Short.</p></article><footer>Made by us {i}.</footer>" for i in range(60)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate([*pages, None, ""])], "page_id long, html string")
    w = he.fit(df)
    assert not np.allclose(w, he.PRIOR) and w[2] < -3 and np.array_equal(w, he.fit(df.repartition(5)))
    assert np.array_equal(he.fit(df.limit(0)), he.PRIOR)
    # a plain gradient descent ends at the same weights
    x = np.concatenate([he.features(f)[[b.element.clear != 0 for b in f]] for f in map(he.blocks, pages)])
    y = np.concatenate([[float(b.element.clear > 0) for b in f if b.element.clear] for f in map(he.blocks, pages)])
    share, plain = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()), he.PRIOR.copy()
    for _ in range(40_000):
        plain -= 0.5 * (x.T @ (share * (1 / (1 + np.exp(-x @ plain)) - y)) + he.PRIOR_STRENGTH * (plain - he.PRIOR))
    assert np.allclose(plain, w, atol=1e-6)
    rows = {r.page_id: r.text for r in he.extract(df, weights=w).collect()}
    assert rows[3] == f"Words 3 {LONG}".strip() + "\nShort." and rows[60] == rows[61] == ""


def test_rows_that_repeat_null_ids_and_clashing_names(spark):
    rows = [(None, PAGES["code"], "a"), (None, PAGES["code"], "a"), (1, None, "b"), (1, "<p>A text without any more.", "c")]
    got = he.extract(spark.createDataFrame(rows, "page_id long, html string, N_CHARS string")).collect()
    assert len(got) == 4 and len({r.text for r in got if r.page_id is None}) == 1
    assert all(r.n_chars == len(r.text) for r in got)
