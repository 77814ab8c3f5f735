import re
import time
from html import unescape

import numpy as np
import pytest

from loomgrain.llm import html as H


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    page = H.parse("<div class=ad><p>one, two</p><ul><li><a href=x>three</a></li></ul></div><article>four. <b>five</b></article>")
    f = H.forest([page])
    node, edge = rng.normal(size=f.x.shape[1]), rng.normal(size=(H._EDGES, 2, 2))
    n = len(f.parent)
    total = np.zeros(n)
    z = 0.0
    for code in range(1 << n):
        s = [(code >> i) & 1 for i in range(n)]
        w = np.exp(H.ROOT * s[0] + sum(f.x[i] @ node * s[i] for i in range(n)) + sum(edge[f.edge[i], s[f.parent[i]], s[i]] for i in range(1, n)))
        z += w
        total += w * np.array(s)
    assert np.allclose(H.marginals(f, node, edge)[0], total / z)


def test_held_out_pages():
    f, y = H.labelled(120, seed=99)
    p, _ = H.marginals(f, *H.trained())
    own = f.x[:, -1] > 0
    assert np.mean((p > 0.5)[own] == y[own]) > 0.97


CASES = [
    ("", ""),
    ("plain words without any element", None),
    ("<article><h1>Ti &amp; tle</h1><p>a\n  b&nbsp;c<br>d <b>e</b>f</p></article>", "Ti & tle\na b c d ef"),
    ("<html><head><title>x</title><script>var a='</p>'</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>"
     "<article><p><b>Long opening line of this text.<br><p>Second one, with a stray &lt;tag&gt;.</article><footer>&copy; x</footer>",
     "Long opening line of this text.\nSecond one, with a stray <tag>."),
    ("<article><h1>T</h1><p>Body text of it, quite long enough.</p><aside>Aside words here.</aside><div class='ad'>Buy this now.</div>"
     "<form><label>Mail</label><button>Go</button></form><p>Last.</p><section class='comments'><p>Reader says this and that.</p></section></article>",
     "T\nBody text of it, quite long enough.\nLast."),
    ("<div class='cookie-notice'>We use cookies.</div><main><p>Kept, as it is the main text.</p></main><script>never closed", "Kept, as it is the main text."),
    ("<article><p>1 < 2 and <p>x</article><!-- never closed", "1 < 2 and\nx"),
    ("<article><p>First of the two paragraphs.</><p>Second of the two paragraphs.</p></article>", "First of the two paragraphs.\nSecond of the two paragraphs."),
    ("<article><p>Price <é and more of this text.</p></article>", "Price <é and more of this text."),
    ("<article><p>One </ p> goes on here, as it should.</p></article>", "One goes on here, as it should."),
    ("<div class=menu><svg><path d='x'></div><article><p>Kept, though a drawing is open.</p></article>", "Kept, though a drawing is open."),
    ("<article><p>Start of the text,</p><select><option>a</select><template><p>no</p></template><p>and its end.</p></article>", "Start of the text,\nand its end."),
    ("<article><p>Words before it,</p><object data=x><p>words behind it.</p></article><svg><text>no</text></svg>", "Words before it,\nwords behind it."),
    ("<head><title>T</title><meta charset=x><article><h1>Title here</h1><p>The body of a page without an end of head.</p></article>",
     "Title here\nThe body of a page without an end of head."),
    ("<noscript>Please enable scripts.</noscript><article><p>An article below it, of some length.</p></article>", "An article below it, of some length."),
    ("<article><p>Whole text, every word</p></article><scr", "Whole text, every word"),
    ("<article><title>Open <p>Then some text follows it here.</p></article>", None),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_pages(page, want):
    got = H.texts_of([page], *H.trained())[0]
    assert want is None or got == want


def test_deep_nesting():
    deep = "<article>" + "<div>" * 3000 + "<p>Words at the bottom, a few of them.</p>"
    assert H.texts_of([deep], *H.trained())[0] == "Words at the bottom, a few of them."


def test_time_grows_with_the_page_only():
    """Many stray end tags, unclosed skipped elements and items inside deep pages."""
    deep = "<article>" + "<p><i>" * 20_000 + "</x></svg><svg><select><li>" * 20_000 + "<p>Words at the bottom, a few of them.</p>"
    began = time.perf_counter()
    assert len(H.parse(deep).parent) == 40_004
    assert time.perf_counter() - began < 5


def plain_article(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", body)
    return "\n".join(x for x in (" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks) if x)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = H.extract(pages).collect()
    assert len(out) == pages.count()
    for r in out:
        assert r.text == plain_article(r.html) and r.n_chars == len(r.text)


def test_defined_cases(spark):
    rows = spark.createDataFrame([(1, None, 5), (1, "", 5), (2, "<article><p>" + "wörd, " * 90_000 + "</p></article>", 5)], "page_id long, html string, text int")
    out = H.extract(rows).collect()
    assert sorted((r.page_id, r.n_chars) for r in out) == [(1, 0), (1, 0), (2, 6 * 90_000 - 1)]
    assert H.extract(rows.limit(0)).collect() == []
