"""Main texts of pages against a plain reading of the article, all runs, and odd markup."""

import html
import random
import re

import pytest

from messlab.llm import regions
from messlab.llm.workers import importable


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


def article(source):
    inner = re.sub("</?b>", "", re.search("<article>(.*?)</article>", source, re.S)[1])
    return " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())


def test_pages(spark, pages):
    found = {r.page_id: r for r in regions.main_texts(pages).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for r in rows:
        assert (found[r.page_id].url, found[r.page_id].text) == (r.url, article(r.html))
        assert found[r.page_id].n_chars == len(found[r.page_id].text)


def test_weights_come_from_labelled_pages(spark, pages):
    """Pages without a label, of which only the words outside the labelled ones tell what to leave out."""
    rows = [(k, None, f"<body><div class=zone9>{'buy ' * 50}</div><article><p>own text {k}</p></article></body>") for k in range(60)]
    rows.append((99, None, f"<body><div class=zone9>{'buy ' * 50}</div><div><p>wanted words here</p></div></body>"))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in regions.main_texts(table).collect()}
    assert found[99] == "wanted words here" and found[7] == "own text 7"
    weights = regions.learn(table)
    assert weights.words[".zone"] < 0 < weights.words["article"] and weights.tags["article"] < weights.tags["p"] < 0
    assert regions.learn(table, sample=20).words[".zone"] < 0


@pytest.mark.parametrize("seed", range(30))
def test_best_run(seed):
    draw = random.Random(seed)
    scores = [draw.choice([-2.0, -1.0, -0.5, 0.0, 1.0, 1.5]) for _ in range(draw.randrange(25))]
    start, stop = regions.best_run(scores)
    sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
    best = max([0.0, *sums.values()])
    assert sum(scores[start:stop]) == best
    if best:
        assert stop == min(b for (a, b), v in sums.items() if v == best)  # the first, then the shortest
        assert start == max(a for (a, b), v in sums.items() if v == best and b == stop)


ODD = [
    (None, ""), ("", ""), ("   ", ""), ("just words", "just words"), ("<p>one<p>two", "one two"),
    ("<article><p>a<b>b</b>c<br>d</p><ul><li>e<li>f</ul></article>", "abc d e f"),
    ("<article>x &lt;p&gt; &amp;amp; &eacute;&#233;&#x1F600; &nbsp; y</article>", "x <p> &amp; éé😀 y"),
    ("<article>a<script>var t='</p></article>';</script>b<style>p{}</style> c<!-- <p>no</p> -->d</article>", "ab cd"),
    ("<body><nav>menu words here</nav><main><h1>Title</h1><p>text</p><aside>side</aside><p>more</p></main>"
     "<footer>foot</footer>", "Title text more"),
    ("<article><p>text here</p><section id='comments'><article class='comment'><p>nice nice nice nice</p></article>"
     "</section></article>", "text here"),
    ("<body class='has-sidebar comments-open'><div class='wrap with-menu'><h1>T</h1><p>words</p></div></body>", "T words"),
    ("<article>text<form><label>name</label><input value='x > y'>send</form></article>", "text"),
    ("<article>a < b and c <3 d", "a < b and c <3 d"), ("<article>open <!-- never closed", "open"),
    ("<article>open <script>never closed", "open"), ("<nav>only menu</nav>", ""),
    ("<a title=\"it's > that\">linked</a> words", "linked words"), ("<ARTICLE><P>UPPER</P></ARTICLE>", "UPPER"),
]


@pytest.mark.parametrize("source, wanted", ODD)
def test_odd_pages(source, wanted):
    assert regions.main_text(source, regions.Weights()) == wanted


def test_long_pages():
    words = " ".join(f"w{k}" for k in range(300_000))
    assert regions.main_text(f"<nav>x</nav><article><p>{words}</p></article>", regions.Weights()) == words
    for source in ("<b>" * 50_000, "<" * 50_000, '<a "' * 50_000, "<!--" * 50_000, "</b>" * 50_000):
        regions.main_text(source, regions.Weights())


def test_awkward_table(spark):
    rows = [(None, None, None, 1), (1, "u", "<article>a</article>", 2), (1, "u", "<article>a</article>", 2)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = regions.main_texts(table).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in found) == [(0, "", "", 0), (1, "u", "a", 1), (1, "u", "a", 1)]
    assert regions.main_texts(table.limit(0)).count() == 0
