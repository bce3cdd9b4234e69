"""The page reader and the page model."""

import pytest

from ranklake.llm import dom, html_extract

LAYOUTS = [
    ("<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a>"
     "</li></ul></nav><!-- ad --><div class=ad>Buy this now.</div><article><h1>A title</h1><p><b>First   par.<br><p>Second &amp; last\n par.</p></article>"
     "<footer>&copy; me &middot; Some words.</footer></body></html>", "A title\nFirst par.\nSecond & last par."),
    ("<body><header><h1>Site</h1></header><main><p>Only this is the text of the page, and it is long enough.</p><p>More of it.</p></main>"
     "<aside><h3>Related</h3><ul><li><a href=x>x</a></li></ul></aside><section class='comments'><div class=comment><p>I like this very much.</p></div></section>"
     "<div class='cookie-notice'><p>We use cookies.</p></div></body>", "Only this is the text of the page, and it is long enough.\nMore of it."),
    ("<div id=content><p>One &lt;tag&gt; and a caf&eacute;.</p><ul><li>point a</li><li>point b</li></ul></div>"
     "<form><label>Name</label><input><textarea>x</textarea><button>Send</button></form>", "One <tag> and a caf\u00e9.\npoint a\npoint b"),
]


@pytest.fixture(scope="module")
def model():
    return html_extract.train(html_extract.labelled_pages())


@pytest.mark.parametrize("page,text", LAYOUTS)
def test_layouts(model, page, text):
    assert model.extract(page) == text


REST = "<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav>{}<aside><h3>Related</h3><p>Other things to read.</p></aside><footer>&copy; me</footer>"
PARTS = [
    ("<div>A sentence stands in a plain block.</div>", "A sentence stands in a plain block."),
    ("<p><a href=/x>A paragraph that is one link.</a></p>", "A paragraph that is one link."),
    ("<table><tr><th>Name</th><td>12</td></tr><tr><td>b</td><td>c d</td></tr></table>", "Name\n12\nb\nc d"),
    ("<figure><img src=i><figcaption>A caption</figcaption></figure>", "A caption"),
    ("<section id=archive><h2>The archive</h2><p>What is kept there is old.</p></section>", "The archive\nWhat is kept there is old."),
    ("<h3>A small heading</h3><p>And what it is about.</p>", "A small heading\nAnd what it is about."),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>", "So x=2 holds."),
    ("<p>Drawn: <canvas>a plot</canvas></p>", "Drawn: a plot"),
    ("<noscript><div>Turn it on.</div></noscript><p>The text goes on here.</p>", "The text goes on here."),
]


@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<div class=content>", "</div>"), ("<main>", "</main>")])
@pytest.mark.parametrize("part,text", PARTS)
def test_parts_of_articles(model, open_, close, part, text):
    first, last = "<p>The first paragraph of the text is here.</p>", "<p>And this is how the whole story ends.</p>"
    page = REST.format(f"{open_}{first}{part}{last}{close}")
    assert model.extract(page) == f"The first paragraph of the text is here.\n{text}\nAnd this is how the whole story ends."


def test_elements_that_are_never_closed(model):
    body = "<article><p>The only paragraph of this page is this one.</p></article>"
    for page in ("<html><head><title>t</title><meta charset=x>" + body, "<head><link rel=x>" + REST.format(body),
                 "<noscript><img src=p>" + body, REST.format("<noscript>" + body), "<html><head><noscript><style>p{}</style></noscript>" + body):
        assert model.extract(page) == "The only paragraph of this page is this one."


def test_other_labelled_pages(model):
    """Accuracy on pages that were not trained on."""
    right = total = 0
    for html in html_extract.labelled_pages(seed=99):
        page = html_extract.understand(dom.read(html, "y"))
        for t, c, y in zip(page.texts, model.marginals(page), page.labels, strict=True):
            if t:
                total += len(t)
                right += len(t) * ((c >= 0.5) == bool(y))
    assert right / total > 0.95


def test_marginals_equal_enumeration(model):
    """Sum-product against the sum over all labellings."""
    import itertools
    import math
    page = html_extract.understand(dom.read(LAYOUTS[1][0]))
    n = 9  # a prefix of nodes is a tree, since parents come first
    part = html_extract.Page(page.parents[:n], page.features[:n], page.texts[:n], page.labels[:n])
    own = [model.own(f) for f in part.features]
    mass, on = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        p = math.exp(sum(o for o, v in zip(own, y) if v) + sum(model.edge[y[part.parents[i]]][y[i]] for i in range(1, n)))
        mass += p
        for i in range(n):
            on[i] += p * y[i]
    assert model.marginals(part) == pytest.approx([x / mass for x in on], rel=1e-9)


def test_odd_pages(model):
    for page in (None, "", "   ", "<", "<p", "plain words", "<a title=don't>x</a>", "<p>a<p>b" * 2000, "<div>" * 3000 + "deep", "</p></div>",
                 "<script>never closed", "<select><option>a", "<p class='x>broken quote</p>", "&#0;&#x110000;&bogus;", "<!-- open"):
        assert isinstance(model.extract(page), str)
    assert model.extract(None) == model.extract("") == model.extract("<script>x</script>") == ""


def test_query(spark, model):
    rows = [(1, "u", LAYOUTS[0][0], "x"), (1, "u", LAYOUTS[0][0], "x"), (2, None, None, "x"), (None, "v", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_extract.extract(pages, model).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in out), key=str) == sorted(
        [(1, "u", LAYOUTS[0][1], len(LAYOUTS[0][1]))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html_extract.extract(pages.limit(0), model).count() == 0
