"""Main text of pages: against a parser of its own on whole tables, on pages without hints, and on single constructs."""

from html.parser import HTMLParser

import numpy as np
import pytest

from flowguard.llm import maintext as M


@pytest.fixture(scope="module")
def tree():
    return M.grow_tree(*M.lessons())


class Article(HTMLParser):
    """The text of <article> by paragraphs and headings, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.parts.append("") if tag in ("p", "h1", "article") else None
        if tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.parts.append("") if tag in ("p", "h1") else None

    def handle_data(self, data):
        if self.inside:
            self.parts[-1] += data

    @classmethod
    def of(cls, html):
        parser = cls()
        parser.feed(html)
        parser.close()
        return "\n".join(x for x in (" ".join(p.split()) for p in parser.parts) if x)


def test_pages_equal_their_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = M.extract(pages).collect()
    assert len(got) == len(html)
    for r in got:
        assert r.text == Article.of(html[r.page_id])
        assert r.n_chars == len(r.text)


def test_pages_without_hints(spark, sf_dir, tree):
    """With the elements that tell the article from the rest replaced, 99 % of its text is found and no more than 3 % besides."""
    html = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    bare = [h.replace("<article>", "<div>").replace("</article>", "</div>").replace("nav>", "div>").replace("footer>", "div>").replace(' class="ad"', "") for h in html]
    lost = extra = whole = 0
    for got, page in zip(M.main_texts(bare, tree), html):
        got, want = set(got.split("\n")), set(Article.of(page).split("\n"))
        lost, extra, whole = lost + sum(map(len, want - got)), extra + sum(map(len, got - want)), whole + sum(map(len, want))
    assert lost < 0.01 * whole
    assert extra < 0.03 * whole


def test_tree_on_pages_it_has_not_seen(tree):
    x, y = M.lessons(300, seed=77)
    assert ((M.tree_values(tree, x) > 0.5) == y).mean() > 0.97


def test_tree_by_brute_force():
    """Every split is the best of all features and limits, and leaves hold the mean of their rows."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (120, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 2] > 3)).astype(int)
    tree = M.grow_tree(x, y, depth=6, least=1)
    assert ((M.tree_values(tree, x) > 0.5) == y).all()

    def loss(rows):
        return len(rows) * y[rows].mean() * (1 - y[rows].mean()) if len(rows) else 0.0

    best = min(loss(np.flatnonzero(x[:, f] <= v)) + loss(np.flatnonzero(x[:, f] > v)) for f in range(3) for v in np.unique(x[:, f])[:-1])
    f, v = int(tree[0, 0]), tree[0, 1]
    assert loss(np.flatnonzero(x[:, f] <= v)) + loss(np.flatnonzero(x[:, f] > v)) == pytest.approx(best)


LONG = "Here a paragraph goes on for a good many words, as the text of an article does, so that nobody takes it for a menu or the like."


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ('<div class="cookie-notice"><p>' + LONG + "</p></div>", ""),
        ("<nav><ul><li><a href=/>Home</a><li><a href=/news>News</a></ul></nav>", "<footer>&copy; 2024 Somebody</footer>"),
        ('<div id="sideBar"><h3>Popular</h3><p>' + LONG + "</p></div>", '<section class="comments"><p>' + LONG + "</p></section>"),
        ("<header><h1>The Site</h1></header>", '<form action="/x"><label>Mail</label><input name="m"><button>Send</button>Subscribe to our letter</form>'),
        ("<script>if (a < b) { document.write('<p>" + LONG + "</p>') }</script><style>p { color: red }</style>", "<!-- <p>" + LONG + "</p> -->"),
        ('<div class="ad">Buy one, get two, but only today.</div>', "<aside><p>" + LONG + "</p></aside>"),
        ('<div style="display:none"><p>' + LONG + "</p></div>", "<noscript><p>" + LONG + "</p></noscript>"),
        ("", "<textarea>" + LONG),
    ],
)
def test_what_is_beside_an_article(tree, before, after):
    page = f"<html><head><title>T</title></head><body>{before}<article><h1>A title of words</h1><p>{LONG}<p>Short.<ul><li>one item</ul><p>{LONG}</p></article>{after}"
    assert M.main_texts([page], tree) == [f"A title of words\n{LONG}\nShort.\none item\n{LONG}"]


def test_text_of_blocks():
    page = "<p>a&amp;b &lt;i&gt; &#233;&eacute;&nbsp;x\n\t y<b>bold</b>er<br>next <!-- no --> a < b</p><p title='a > b'>two<td>three<p>   <p>&am"
    assert [b[0] for b in M.blocks(page)] == ["a&b <i> éé x ybolder next a < b", "two", "three", "&am"]
    assert [b[1:3] for b in M.blocks('<p>one <a href="x">two three</a> four</p>')] == [(4, 2)]
    assert M.blocks("<p>漢字漢字")[0][1] == 3


def test_edge_rows(spark, tree):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<p></p>"), (None, None, f"<p>{LONG}"), (4, "u", f"<p>{LONG}" * 20_000), (5, "u", "<" * 50_000), (6, "u", '<a href="' * 3_000), (7, "u", "<div>" * 5_000)]
    pages = spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = {(r.page_id, r.url): r for r in M.extract(pages).collect()}
    assert got[1, None].text == got[2, "u"].text == got[3, "u"].text == ""
    assert got[None, None].text == LONG
    assert got[4, "u"].n_chars == 20_000 * (len(LONG) + 1) - 1
    assert M.extract(pages).columns == ["page_id", "url", "text", "n_chars"]
    assert M.extract(pages.limit(0)).count() == 0
    assert M.extract(pages).count() == len(rows)
