import html
import re

import numpy as np
import pytest

from treeline.llm import htmltext


@pytest.fixture(scope="module")
def model():
    return htmltext.trained()


def template_text(source):
    """The article of the test tables' one template, by string operations."""
    x = source[source.find("<article>") + 9 :]
    x = x[: x.find("</article>")] if "</article>" in x else x
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p.replace("<b>", "").replace("</b>", ""))).split()) for p in re.split(r"</?(?:p|h1)>", x)]
    return "\n\n".join(p for p in parts if p)


def test_query_on_the_tables(spark):
    from treeline.llm.queries import op10_main_text

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    out = op10_main_text(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == len(pages) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in out)
    assert np.mean([r.text == template_text(pages[r.page_id].html) for r in out]) >= 0.995


def test_held_out_made_pages(model):
    kept = right = wrong = 0
    for seed in range(70_000, 70_150):
        page, labels = htmltext.made_page(seed)
        got = htmltext.decode(page.parent, model.log_odds(htmltext.node_features(page)))
        for node, text, _ in page.runs:
            kept += labels[node] * len(text)
            right += (labels[node] and got[node]) * len(text)
            wrong += (got[node] and not labels[node]) * len(text)
    assert right / kept > 0.97 and wrong / (right + wrong) < 0.02


def slow_decode(parent, odds):
    n, best = len(parent), (-1e18, None)
    for bits in range(1 << (n - 1)):
        kept = [True, *(bool(bits >> k & 1) for k in range(n - 1))]
        if all(kept[parent[k]] or not kept[k] for k in range(1, n)):
            score = sum(-np.logaddexp(0, -o if k else o) for o, k in zip(odds[1:], kept[1:], strict=True))
            if score > best[0]:
                best = score, kept
    return best[1]


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 10))
        parent = [-1, *(int(rng.integers(0, k)) for k in range(1, n))]
        odds = rng.normal(size=n) * 2
        assert htmltext.decode(parent, odds) == slow_decode(parent, odds)


def test_a_whole_page(model):
    source = """<html><head><title>T</title><script>if (a < b) document.write("</p><p>no</p>")</script></head><body>
    <header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
    <div class="cookie-notice">We use cookies. <button>OK</button></div>
    <article><h1>A title &amp; more</h1><p>First&nbsp;paragraph   with
    a <a href="/x">link</a> inside it.<p>Second one, longer than the first, with some commas, and words.<!-- hidden -->
    <div class="ad">Buy now, cheap.</div><p>Third paragraph ends the text.</article>
    <section class="comments"><div class="comment"><p>Great read, thanks!</p></div></section>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">Other</a></ul></aside>
    <form><label>Search</label><input></form><footer>&copy; 2020 Site. All rights reserved.</footer></body></html>"""
    want = "A title & more\n\nFirst paragraph with a link inside it.\n\nSecond one, longer than the first, with some commas, and words.\n\nThird paragraph ends the text."
    assert htmltext.extract([source], model) == [want]


def test_edge_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain &lt;text&gt;"), (4, "u", "<p>a<p>b <br> c"), (4, "u", "<p>a<p>b <br> c"), (None, "u", "<!-- open"), (5, "u", "<script>x"), (6, "u", "a < b"), (7, "u", "<p>" + "word " * 100_000), (8, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, n_chars int, Text string")
    got = {r.page_id: r.text for r in htmltext.main_text(df).collect()}
    assert (got[1], got[2], got[3], got[None], got[5]) == ("", "", "plain <text>", "", "") and got[6] == "a < b" and len(got[7]) == 499_999
    assert htmltext.main_text(df).count() == len(rows) and htmltext.main_text(df.limit(0)).collect() == []


def test_an_unclosed_element_loses_no_later_text():
    for tag in ("button", "object", "select", "noscript", "svg", "audio", "video", "canvas"):
        page = htmltext.read_page(f"<p>before</p><{tag} x=1><p>after <{tag}>it</p>")
        assert [r[1] for r in page.runs] == ["before", "after it"]
    assert [r[1] for r in htmltext.read_page("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>").runs] == ["let x=1 be"]
    for tag in ("script", "style", "title", "textarea", "iframe"):
        assert [r[1] for r in htmltext.read_page(f"<p>before</p><{tag}><p>code</p>").runs] == ["before"]

#: Pages written by hand, apart from the generator, and their articles.
HAND = [
    ('<html><body><ul class="menu"><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul><h1>The river rises</h1><p>The river rose two metres over night, and the town woke to water.</p><p>Nobody was hurt, the mayor said, but the bridge is closed.</p></body></html>', 'The river rises\n\nThe river rose two metres over night, and the town woke to water.\n\nNobody was hurt, the mayor said, but the bridge is closed.'),
    ('<html><body><table width="100%"><tr><td><a href="/">Home</a><br><a href="/a">About</a><br><a href="/n">News</a></td><td><h2>The river rises</h2><p>The river rose two metres over night, and the town woke to water.</p><p>Nobody was hurt, the mayor said, but the bridge is closed.</p></td></tr></table></body></html>', 'The river rises\n\nThe river rose two metres over night, and the town woke to water.\n\nNobody was hurt, the mayor said, but the bridge is closed.'),
    ('<html><body><article><h1>Short</h1><p>It rained.</p></article><footer>c 2020 Site</footer></body></html>', 'Short\n\nIt rained.'),
    ('<html><body><div id="main"><h1>The river rises</h1><p>The river rose two metres over night, and the town woke to water.</p></div><div id="sidebar"><h3>About us</h3><p>We are a small paper, founded long ago, with many readers.</p></div></body></html>', 'The river rises\n\nThe river rose two metres over night, and the town woke to water.'),
    ('<html><body><article><h1>Sums</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be the start.</p><p>Then all is clear, as we shall see.</p></article></body></html>', 'Sums\n\nLet x=1 be the start.\n\nThen all is clear, as we shall see.'),
    ('<h1>Only text</h1><p>First of all, a paragraph without any page around it.</p><p>And a second one, as plain as that.</p>', 'Only text\n\nFirst of all, a paragraph without any page around it.\n\nAnd a second one, as plain as that.'),
    ('<html><body><nav><a href="/">Home</a></nav><div class="content"><h1>A tale</h1><p>Once there was a king, and he had three sons.</p><p>The first went out, and did not come back.</p></div><div id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b> <p>Lovely tale, thank you so much!</p></div><div class="comment"><b>Bob</b> <p>I did not like it.</p></div></div></body></html>', 'A tale\n\nOnce there was a king, and he had three sons.\n\nThe first went out, and did not come back.'),
]


@pytest.mark.parametrize("source, want", HAND)
def test_hand_written_pages(model, source, want):
    assert htmltext.extract([source], model) == [want]


def test_elements_that_hold_text():
    assert [r[1] for r in htmltext.read_page("<p>see <object data=x>a <b>plan</b></object> of <canvas>it</canvas></p>").runs] == ["see a plan of it"]
    assert [r[1] for r in htmltext.read_page("<p>one</p><noscript><p>two</p></noscript><p>three <button>no</button>four").runs] == ["one", "two", "three four"]


def test_deep_nesting_with_unmatched_tags_is_linear():
    import time

    begin = time.process_time()
    page = htmltext.read_page("<div>" * 20_000 + "</p></td></nosuch>" * 20_000 + "end")
    assert len(page.tag) == 20_001 and page.runs[-1][1] == "end" and time.process_time() - begin < 2


def test_the_fitted_trees_are_those_of_a_new_fit(model):
    new = htmltext.fit()
    x = np.concatenate([htmltext.node_features(htmltext.made_page(seed)[0]) for seed in range(80_000, 80_060)])
    a, b = model.log_odds(x), new.log_odds(x)
    assert np.mean((a > 0) == (b > 0)) > 0.999 and np.median(np.abs(a - b)) < 1e-3


def slow_numbers(page, node):
    """A few numbers of a node by plain walks over the page."""
    below = [k for k in range(len(page.tag)) if k == node or node in above(page, k)]
    total = sum(len(t) for _, t, _ in page.runs)
    own = [(t, l) for n, t, l in page.runs if n == node]
    inner = [(t, l) for n, t, l in page.runs if n in below]
    size = sum(len(t) for t, _ in inner)
    siblings = [k for k in range(len(page.tag)) if k and page.parent[k] == page.parent[node]] if node else []
    return {
        "depth": len(above(page, node)), "own_text": np.log1p(sum(len(t) for t, _ in own)), "all_text": np.log1p(size), "text_share": size / max(total, 1), "link_share": sum(l for _, l in inner) / max(size, 1),
        "children": sum(p == node for p in page.parent), "nodes_below": len(below) - 1, "place": siblings.index(node) if node else 0, "paragraphs_below": np.log1p(sum(page.tag[k] == "p" for k in below if k != node)),
        "marks_per_char": sum(t.count(",") + t.count(".") for t, _ in inner) / max(size, 1), "run_count": np.log1p(len(inner)), "in_article": float(any(page.tag[k] == "article" for k in above(page, node))),
    }


def above(page, node):
    out = []
    while page.parent[node] >= 0:
        node = page.parent[node]
        out.append(node)
    return out


def test_features_and_trees_by_plain_loops(model):
    for source in (HAND[1][0], HAND[6][0], "<article><p>a, b. <a href=x>c d</a></p><div><p>e</p>f</div></article>tail"):
        page = htmltext.read_page(source)
        x = htmltext.node_features(page)
        for node in range(len(page.tag)):
            for name, want in slow_numbers(page, node).items():
                assert abs(x[node, htmltext.NAMES.index(name)] - want) < 1e-5, (source, node, name)
        odds = model.log_odds(x)
        for node in range(len(page.tag)):
            score = model.bias
            for which, cut, value in model.trees:
                at = 0
                while at < len(which):
                    edges = model.edges[which[at]]
                    at = 2 * at + 1 + int(sum(e < x[node, which[at]] for e in edges) > cut[at])
                score += value[at - len(which)]
            assert abs(score - odds[node]) < 1e-6
