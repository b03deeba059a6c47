import html
import os
import random
import re
import time

import numpy as np
import pytest

from termloom.llm import catalog, html_samples, html_text

TREE = html_text.train()


def text_of(page):
    blocks = html_text.read_blocks(page)
    main = TREE.predict(np.array(html_text.features(blocks))) if blocks else []
    return "\n".join(b.text for b, m in zip(blocks, main) if m)


def test_flat_blocks():
    page = """x <p>one<b>two</b> <i>three</i>&nbsp;&amp;amp; &eacute;&#x41;&#66; 1 < 2<br>four<p>five <a href=q>six seven</a></div></p>
    <!-- <p>no --><script>var t = "</p><p>no";</script><style>p{}</style><td title="a>b" data-x='>'>eight<title>no</title>
    <svg><text>no</text></svg><TEXTAREA>no</textarea><ul><li>nine<li>ten</ul>tail<!bogus><?x y?></ >"""
    got = [(b.text, b.words, b.linked) for b in html_text.read_blocks(page)]
    assert got == [
        ("x", 1, 0),
        ("onetwo three &amp; éAB 1 < 2 four", 8, 0),
        ("five six seven", 3, 2),
        ("eight", 1, 0),
        ("nine", 1, 0),
        ("ten", 1, 0),
        ("tail", 1, 0),
    ]


@pytest.mark.parametrize("page", ["", "  ", "<", "<p", "</p>", "<p a='", "<!--", "<script>x", "<a href=\"x>y", "a<b", "<!-->x"])
def test_broken_pages(page):
    assert [b.text for b in html_text.read_blocks(page)] == {"<": ["<"], "a<b": ["a"], "<!-->x": ["x"], '<a href="x>y': ["y"]}.get(page, [])


@pytest.mark.parametrize("part", ["<div>", "<b>", "<p><b>", "<li>", "<a href='", "<!--", "x &amp; ", "<td><tr>", "</p>", "<p class=ad>w", "<script>", "= ' \"<"])
def test_long_pages_take_time_in_proportion(part):
    begin = time.time()
    html_text.read_blocks(part * 100_000)
    assert time.time() - begin < 15


def test_any_markup_is_read():
    rnd = random.Random(5)
    parts = ["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<table>", "<td>", "<tr>", "</table>", "<a href=x>", "</a>", "< ", ">", "<div class='ad'>", "</div>", "<article>", "</article>", "word ", "<br/>"]
    for _ in range(2000):
        page = "".join(rnd.choices(parts, k=30))
        words = " ".join(b.text for b in html_text.read_blocks(page))
        assert words.count("word") == len(re.findall(r"word", re.sub(r"<[^\s<>][^<>]*>", "", page)))


def test_article_without_the_rest():
    page = """<html><head><title>T</title></head><body class="has-sidebar"><header class=top><h1>Site</h1><nav><a href=/>Home</a></nav></header>
    <div class="cookie-banner">We store things on your device, and you agree to it by reading on here.</div>
    <article><header><h1>Of hinges &amp; bars</h1></header><p>The gate   hung\n on two hinges, and neither held.</p><p>Rust.</p>
    <div class="ad">Buy a new gate today, while the old one still hangs on the last of its hinges.</div>
    <p>We oiled <a href=x>the upper one</a> first.</p><ul><li>oil</li><li>sand</li></ul>
    <section id="comments"><h3>Comments</h3><p>I liked the part about the gate, it was very good indeed.</p></section></article>
    <aside><h2>More about the gates and bars of this yard</h2><p>More about gates can be read in the other pages of this yard.</p></aside><form><p>Your name please</p></form>
    <footer>&copy; yard &middot; All of the text on this page may be read aloud.</footer></body></html>"""
    want = "Of hinges & bars\nThe gate hung on two hinges, and neither held.\nRust.\nWe oiled the upper one first.\noil\nsand"
    assert text_of(page) == want


def test_words_and_links_decide_where_nothing_is_named():
    filler = "It takes one morning to raise a bed, and one more to fill it with sand from the shore. " * 3
    page = f"<div><a href=a>Home</a> <a href=b>Yard</a></div><h1>Raised beds in a yard</h1><p>{filler}</p><p>{filler}</p><div><a href=c>Next page of the yard</a></div>"
    assert text_of(page) == "\n".join(["Raised beds in a yard", filler.strip(), filler.strip()])


def test_held_out_pages_of_the_table():
    pages = html_samples.labelled_pages()
    wrong = blocks = 0
    for i, page in enumerate(pages):
        tree = html_text.train(pages[:i] + pages[i + 1 :])
        read = html_text.read_blocks(page)
        wrong += sum(b.marked != m for b, m in zip(read, tree.predict(np.array(html_text.features(read)))))
        blocks += len(read)
    assert wrong / blocks < 0.12


def test_tree():
    rows = np.array([[0, 5], [0, 6], [1, 5], [1, 6], [0, 5], [1, 6.0]])
    labels = np.array([0, 1, 0, 0, 0, 0], bool)
    tree = html_text.grow(np.repeat(rows, 4, 0), np.repeat(labels, 4))
    assert tree.predict(rows).tolist() == labels.tolist()
    assert not html_text.train([]).predict(np.zeros((2, 16))).any()
    assert html_text.train(["<p data-main>a b", "<p>c"]).predict(np.zeros((1, 16))).shape == (1,)


def test_query(spark, tmp_path):
    article = "<article><h1>Head</h1><p>One  two.</p></article><footer>f</footer>"
    rows = [(1, "u", article), (1, "u", article), (2, None, None), (3, "v", ""), (None, "w", "<nav><a href=x>no</a></nav>"), (4, "x", "<article><p>" + "long word " * 200_000)]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in catalog.op12_html_text(spark, str(tmp_path)).collect()}
    assert got == {
        (1, "u"): ("Head\nOne two.", 13),
        (2, None): ("", 0),
        (3, "v"): ("", 0),
        (None, "w"): ("", 0),
        (4, "x"): (("long word " * 200_000).strip(), 1_999_999),
    }
    assert catalog.op12_html_text(spark, str(tmp_path)).count() == 6
    assert html_text.extract(pages.limit(0), TREE).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="tables not present")
def test_given_pages(spark):
    """Their articles, cut out by hand, are what is extracted."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in catalog.op12_html_text(spark, "/root/testdata/sf0.01").collect()}
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ").replace("<b>", "").replace("</b>", "")
        parts = [" ".join(html.unescape(p).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)
