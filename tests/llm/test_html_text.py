import html as entities
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import html_text, queries
from skein.llm.dom import Forest, attribute_words
from skein.llm.html_text import INSIDE, OUTSIDE, extract, extract_pages, graph_of, labels_of, train_extractor
from skein.llm.layouts import labelled_pages


@pytest.fixture(scope="module")
def model():
    return train_extractor()


def blocks(page: str) -> list[str]:
    """What lies between the article's tags, by patterns that hold for the given table alone."""
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = (re.sub("<[^>]+>", "", p.replace("<br>", " ")) for p in re.split("</?(?:p|h1)>", inside))
    return [x for x in (" ".join(entities.unescape(p).split()) for p in parts) if x]


def test_all_pages_of_the_table(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op13_html_text(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text.split("\n") == blocks(pages[r.page_id].html)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


def test_held_out_layouts(model):
    held = labelled_pages(300, seed=424_242)
    kept = wrong = missed = 0
    for (_, want), got in zip(held, extract([h for h, _ in held], model)):
        a, b = got.split("\n") if got else [], want.split("\n") if want else []
        kept += sum(x in b for x in a)
        wrong += sum(x not in b for x in a)
        missed += sum(x not in a for x in b)
    assert wrong < 0.05 * kept and missed < 0.05 * kept, (kept, wrong, missed)


PAGES = {
    "named parts": (
        "<html><body><header><h1>My Site</h1><nav><a href=/>Home</a> <a href=/b>Blog</a></nav></header><div id='cookie-banner'>We use cookies. <button>Accept</button></div><main><article><h2>Title</h2>"
        "<p>First paragraph of the story, with <b>bold</b> words.</p><p>Short.</p><div class='ad'>Buy this now</div><p>Last one &amp; d&ouml;ne&nbsp; &lt;b&gt;.</p></article><section class='comments'><h3>Comments</h3>"
        "<div class='comment'><p>Nice article, I really liked it a lot, thanks for writing all of this.</p></div></section></main><aside class='sidebar'><ul><li><a href=/1>One</a></ul></aside><footer>Copyright</footer></body></html>",
        "Title\nFirst paragraph of the story, with bold words.\nShort.\nLast one & döne <b>.",
    ),
    "divs": (
        "<body><div class=topbar><a href=/>x</a></div><div class='post-body'><h1>T</h1><p>A b c.<p>D e f,\n g\t h i.<ul><li>one<li>two</ul><form><label>Email</label><input></form></div>"
        "<div id=comments><p>comment text is here and it is long, longer than the post.</p></div><div class='footer-links'>About us</div>",
        "T\nA b c.\nD e f, g h i.\none\ntwo",
    ),
    "no names": (
        "<body><div><a href=/>Home</a> | <a href=/x>About</a></div><div><h1>The title of it</h1><p>A long paragraph with a lot of words in it, so that it looks like prose. It goes on for a while, and on.</p>"
        "<p>And then a second one follows, which is also rather long, with commas, and full stops. Really.</p></div><div>Copyright 2020 all rights</div>",
        "The title of it\nA long paragraph with a lot of words in it, so that it looks like prose. It goes on for a while, and on.\nAnd then a second one follows, which is also rather long, with commas, and full stops. Really.",
    ),
    "nested": (
        "<body><div id=wrapper><div id=header>Logo</div><div id=menu><ul><li><a href=/>a</a></ul></div><div id=content><div class=entry><h1>X y z</h1><p>hello<br>world<p>para two<table><tr><td>cell 1<td>cell 2</table>"
        "<blockquote>quoted text</blockquote></div><div class='share-buttons'><a>Tweet</a></div><div class='related-posts'><h4>More</h4><a href=/r>other story</a></div></div><div id=sidebar>Sidebar text</div><div id=footer>foot</div></div>",
        "X y z\nhello world\npara two\ncell 1\ncell 2\nquoted text",
    ),
    "parts inside the article": (
        "<body><div class='notice'>This page is archived.</div><article class='story'><h1>H</h1><p>One.</p><div class='newsletter-signup'><h3>Subscribe</h3><form><input><button>go</button></form></div><p>Two.</p><aside>Pull aside</aside>"
        "<noscript>enable js</noscript><script>x='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --></article><div role='complementary'>promo things</div><div class='gdpr-consent' role='dialog'>Consent text</div>",
        "H\nOne.\nTwo.",
    ),
    "comments inside the article": (
        "<article><header><p>head</p></header><h1>T t</h1><p>Body text.</p><section id='user-comments'><article class='comment'><p>I disagree with this.</p></article></section><footer>Filed under x</footer></article>",
        "T t\nBody text.",
    ),
    "roles": ("<body><div role='banner'>Site</div><div role='navigation'><a href=/>n</a></div><div role='main'><h1>A</h1><p>B c d.</p></div><div role='contentinfo'>c 2020</div>", "A\nB c d."),
    "no article": ("<body><header>Site</header><form id=login><label>User</label><input><p>Please log in to continue.</p></form><footer>c</footer>", ""),
    "alone": ("<article><h1>T t</h1><p>Body text.</p></article>", "T t\nBody text."),
}


@pytest.mark.parametrize("name", PAGES)
def test_written_pages(model, name):
    page, text = PAGES[name]
    assert extract([page], model) == [text]


def runs(page: str) -> list[str]:
    forest = Forest()
    forest.add(page)
    return [t for t in forest.text if t is not None]


def test_markup_that_is_written_carelessly():
    assert runs("a<b>b</b>c <i>d<p>e</i>f<br>g<hr>h") == ["abc d", "ef g", "h"]
    assert runs("<p>1<div>2</p>3</div>4") == ["1", "2", "3", "4"]
    assert runs("<ul><li>1<ul><li>2<li>3</ul><li>4</ul>") == ["1", "2", "3", "4"]
    assert runs("<script>var a = '<p>x</p>';</script>y<style>z</style><!-- q --><title>t</title>w<textarea>v</textarea>") == ["y", "w"]
    assert runs("a < b &amp; c &lt;p&gt; 1<2 &#x41; &nosuch; &copy") == ["a < b & c <p> 1<2 A &nosuch; ©"]
    assert runs("x<script>never closed <p>no") == ["x"] and runs("x<!-- never closed <p>no") == ["x"]
    assert runs("<a title='a > b'>x</a><img alt=\"<p>\">y<p title=don't>z</p>") == ["xy", "z"]
    assert runs("<table><tr><td><p>1<td>2</table>3") == ["1", "2", "3"]
    assert runs("<div>a</span></b></section>b</div></div></div>c") == ["ab", "c"]
    assert runs("a   b\r\n\x0bc") == ["a b c"] and runs("") == [] and runs("<") == ["<"] and runs("</") == ["</"]
    assert runs("<head><title>t</title><body>x") == ["x"] and runs("<template><p>x</p></template>y") == ["y"]
    assert attribute_words("class='postBody main-content x1' id=\"Foo\" style='display: none'")[:6] == ["post", "body", "main", "content", "x", "1"]
    assert "#hidden" in attribute_words("style='display: none'")


def test_long_and_deep_pages(model):
    started = time.time()
    assert runs("<div>" * 30_000 + "x") == ["x"]
    assert extract(["<div>" * 3_000 + "<p>x</p>"], model)[0] in ("", "x")
    for piece in ("<p>word, word. ", "<", "</", "<a b=\"", "<!--", "<p><b>", "</div>", "<div></p>", "&", "<li>", "<td>"):
        page = "<body><article><h1>t</h1><p>" + piece * 40_000
        assert isinstance(extract([page], model)[0], str)
    assert time.time() - started < 120


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<b>", "</b>", "<a href=x>", "</a>", "<table>", "<tr>", "<td>", "</table>", "<script>", "</script>", "<!--", "-->", "x ", "y", "\n", "&amp;", "<br>", "<form>", "</form>", "<", "é"]), max_size=40).map("".join))
def test_any_markup_gives_a_tree(page):
    forest = Forest()
    forest.add(page)
    assert all(p < i for i, p in enumerate(forest.parent)) and all(forest.text[p] is None for p in forest.parent if p >= 0)
    assert all(d == forest.depth[p] + 1 for d, p in zip(forest.depth[1:], forest.parent[1:]))
    graph_of(forest)


def test_messages_give_the_marginals_of_enumeration(model):
    for page in ("<div>a<p>b</p></div>", "<body><nav>x</nav><article><p>y<p>z</article>", "q", "<ul><li>1<li>2</ul>"):
        forest = Forest()
        forest.add(page)
        g = graph_of(forest)
        unary = model.unary(g)
        own, joint = model.marginals(g, edges=True)
        want, pairs, total = np.zeros_like(own), np.zeros_like(joint), 0.0
        for states in itertools.product(range(3), repeat=len(g.parent)):
            score = sum(unary[i, s] for i, s in enumerate(states)) + sum(model.pairs[g.kind[i], states[p], states[i]] for i, p in enumerate(g.parent) if p >= 0)
            weight = np.exp(score)
            total += weight
            for i, s in enumerate(states):
                want[i, s] += weight
                if g.parent[i] >= 0:
                    pairs[i, states[g.parent[i]], s] += weight
        assert np.allclose(own, want / total, atol=1e-6) and np.allclose(joint, pairs / total, atol=1e-6)


def test_the_slope_of_the_likelihood():
    """Observed less expected counts are the derivative of the log-likelihood."""
    rows = labelled_pages(4, 3)
    forest = Forest()
    for page, _ in rows:
        forest.add(page)
    g = graph_of(forest)
    state = labels_of(g, [t.split("\n") for _, t in rows])
    rng = np.random.default_rng(1)
    model = html_text.TreeModel(rng.normal(size=(1 << html_text.BITS, 3)) * 0.1, rng.normal(size=(html_text.KINDS, 3, 3)))

    def likelihood() -> float:
        unary, up = model.unary(g), model.unary(g)
        score = unary[np.arange(len(state)), state].sum()
        child = np.flatnonzero(g.parent >= 0)
        score += model.pairs[g.kind[child], state[g.parent[child]], state[child]].sum()
        for level in reversed(g.levels[1:]):
            np.add.at(up, g.parent[level], np.log(np.exp(up[level][:, None, :] + model.pairs[g.kind[level]]).sum(axis=2)))
        return score - np.log(np.exp(up[g.levels[0]]).sum(axis=1)).sum()

    own, _ = model.marginals(g)
    column = int(np.bincount(g.column).argmax())
    mine = g.row[g.column == column]
    for s in range(3):
        slope = ((state[mine] == s) - own[mine, s]).sum()
        step = 1e-5
        model.weights[column, s] += step
        high = likelihood()
        model.weights[column, s] -= 2 * step
        assert abs((high - likelihood()) / (2 * step) - slope) < 1e-3 * max(1, abs(slope))
        model.weights[column, s] += step


def test_labels_from_texts():
    forest = Forest()
    forest.add("<body><nav>m</nav><div><p>a</p><p>ad</p><p>b</p></div></body>")
    g = graph_of(forest)
    state = labels_of(g, [["a", "b"]])
    told = {t: int(s) for t, s in zip(g.text, state) if t}
    assert told == {"m": OUTSIDE, "a": INSIDE, "ad": OUTSIDE, "b": INSIDE}
    assert sorted(state.tolist()) == sorted([1, 1, 0, 0, 2, 2, 2, 0, 0, 2, 2])


def test_odd_tables_and_given_labels(spark, model):
    rows = [(1, "u", PAGES["divs"][0], "x"), (1, "u", PAGES["divs"][0], "x"), (None, None, None, None), (3, "u", "", "x"), (4, "u", "  \n", "x"), (5, "u", "<article><h1>Long</h1>" + "<p>word, word and more of it.</p>" * 50_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, page string").repartition(3)
    got = extract_pages(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == {1: PAGES["divs"][1], 5: "Long" + "\nword, word and more of it." * 50_000}.get(r.page.page_id, "") and r.n_chars == len(r.text)
    assert extract_pages(df.limit(0), model).count() == 0
    made = [(h, t, k) for k, (h, t) in enumerate(labelled_pages(300, 5))] + [(None, "x", 0), ("<p>x", None, 1), ("", "", 2)]
    own = train_extractor(spark.createDataFrame(made, "html string, text string, n int"))
    assert extract([PAGES["named parts"][0]], own) == [PAGES["named parts"][1]]
    none = train_extractor(spark.createDataFrame([], "html string, text string"))
    assert extract(["<p>x"], none)[0] in ("", "x")
