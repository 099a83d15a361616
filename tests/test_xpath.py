import pytest

from treeline.functions import xpath as fx
from treeline.plans.xpath import XPath, XPathError, parse, rewrite
from treeline.sources import markup

BOOK = """<?xml version="1.0"?>
<book lang="en" year="1999"><head><title>Trees &amp; tables</title></head>
<chapter id="c1"><title>One</title><p>first</p><image href="a.gif"/><p>second</p></chapter>
<chapter id="c2" xml:lang="de-AT"><title>Two</title><p>third</p></chapter>
<chapter id="c3"><title>Three</title><p>fourth</p><!-- note --><?go now?></chapter>
</book>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return markup.xml_nodes(spark.createDataFrame([(1, BOOK), (2, "<book><p>5</p><p>x</p></book>")], "doc_id long, text string")).cache()


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("//p[1]", ["first", "third", "fourth", "5"]), ("(//p)[1]", ["first", "5"]), ("//chapter[true()][position() mod 2 = 1][true()][2]/title", ["Three"]), ("//chapter[2]/preceding::p", ["first", "second"]),
        ("//image/following::p", ["second", "third", "fourth"]), ("//chapter[last()]/title", ["Three"]), ("//p[0 div 0]", []), ("id('c2 c1')/title", ["One", "Two"]), ("//chapter[@id='c2']/title | //head/title", ["Trees & tables", "Two"]),
        ("//chapter[count(p) = 2]/@id", ["c1"]), ("//p/ancestor::chapter[1]/@id", ["c1", "c2", "c3"]), ("//title[../p = 'third']", ["Two"]), ("//p[. != 'x'][. > 4]", ["5"]), ("//comment()", [" note "]), ("//processing-instruction('go')", ["now"]),
        ("//chapter[not(image)]/title", ["Two", "Three"]), ("//title/text()", ["Trees & tables", "One", "Two", "Three"]), ("//@href/..", [""]), ("//p[preceding-sibling::p]", ["second", "x"]), ("//p[following-sibling::*[1][self::image]]", ["first"]),
        ("//chapter[p < 'a']", []), ("/book/chapter[position() > 1][1]/title", ["Two"]), ("//p[contains(., 'r') and string-length() = 5]", ["first", "third"]),
    ],
)
def test_paths(nodes, expression, want):
    got = [r.value for r in XPath(nodes).select(expression).orderBy("doc_id", "pre").collect()]
    assert got == want


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("string(12345678901234567890)", "1.23456789012346e+19"), ("true()='test'", "true"), ("'test'!=true()", "false"), ("'a'=0.0", "false"), ("'a'!=0.0", "true"), ("round(-0.5)", "0"), ("floor(-0)", "0"), ("floor(-0.1)", "-1"),
        ("1 div 0", "Infinity"), ("-1 div 0", "-Infinity"), ("0 div 0", "NaN"), ("-5 mod 2", "-1"), ("5 mod -2", "1"), ("substring('12345', 1.5, 2.6)", "234"), ("substring('12345', 0 div 0, 3)", ""), ("substring('12345', -42, 1 div 0)", "12345"),
        ("0.000001", "1e-06"), ("0.1 + 0.2", "0.3"), ("123456789.123", "123456789.123"), ("2147483648", "2.147483648e+09"), ("number('1e3')", "1000"), ("number('+1')", "NaN"), ("translate('bar', 'abc', 'AB')", "BAr"), ("normalize-space('  a  b ')", "a b"),
        ("substring-before('1999/04/01', '/')", "1999"), ("substring-after('1999/04/01', '/')", "04/01"), ("concat('a', 1, true())", "a1true"), ("'a' < 'b'", "false"), ("2 <= 2", "true"), ("string(-0)", "0"), ("- - 3", "3"), ("$n + 1", "4"),
    ],
)
def test_values(nodes, expression, want):
    one = nodes.where("doc_id = 1")
    assert XPath(one, variables={"n": 3}).value(expression).first().result == want


def test_language_is_inherited(nodes):
    x = XPath(nodes.where("doc_id = 1"))
    assert [r.value for r in x.select("//title[lang('de')]").collect()] == ["Two"]


@pytest.mark.parametrize("bad", ["//p[", "foo()", "//n:p", "$nothing", "1 +", "//p)", "count(1)", "count()", "contains('a')", "substring('a')", "sum(1)", "sum('a', 'b')", "concat('a')", "true(1)", "name('a')", "position(1)", "translate('a', 'b')", "string(1, 2)", "count($n)", "not()", "lang()"])
def test_errors_are_found_when_compiling(nodes, bad):
    with pytest.raises(XPathError):
        XPath(nodes, variables={"n": 3}).value(bad)


def test_descendant_rewrite():
    assert len(rewrite(parse("//p/b").steps)) == 2 and len(rewrite(parse("//p[1]").steps)) == 2
    assert rewrite(parse("//p[@a]").steps)[0].axis == "descendant"


def test_union_counts(nodes):
    x = XPath(nodes.where("doc_id = 1"))
    n = lambda e: int(x.value(f"count({e})", "number").first().result)
    assert n("//p | //title") == n("//p") + n("//title") and n("//p | //p[1]") == n("//p")


def test_chunks_do_not_change_trees(spark, nodes):
    df = spark.createDataFrame([(1, BOOK)], "doc_id long, text string")
    want = [tuple(r) for r in nodes.where("doc_id = 1").orderBy("pre").collect()]
    for chunk in (1, 5, 64):
        assert [tuple(r) for r in markup.xml_nodes(df, chunk=chunk).orderBy("pre").collect()] == want


def test_same_tree_as_the_standard_parser(spark, nodes):
    from xml.etree import ElementTree

    tags = [e.tag for e in ElementTree.fromstring(BOOK).iter() if isinstance(e.tag, str)]
    assert [r.name for r in nodes.where("doc_id = 1 and kind = 'element'").orderBy("pre").collect()] == tags


def test_plan_has_no_cartesian_product(nodes):
    plan = XPath(nodes).select("//chapter[p/following::title]/p[2]")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "PythonUDF" not in plan


def test_html_repairs(spark):
    soup = "<p>a<p>b<ul><li>x<li>y</ul><td>z"
    n = markup.html_nodes(spark.createDataFrame([(1, soup)], "page_id long, html string"))
    got = [(r.level, r.name) for r in n.where("kind = 'element'").orderBy("pre").collect()]
    assert got == [(1, "html"), (2, "body"), (3, "p"), (3, "p"), (3, "ul"), (4, "li"), (4, "li"), (3, "td")]


def test_broken_xml_keeps_what_came_before(spark):
    df = spark.createDataFrame([(1, "<a><b>x</b><c"), (2, "<a/>"), (3, None)], "doc_id long, text string")
    assert {r.doc_id for r in markup.errors(df).collect()} == {1, 3}
    assert [r.name for r in markup.xml_nodes(df).where("doc_id = 1 and kind = 'element'").orderBy("pre").collect()] == ["a", "b"]


def test_translate_is_exported():
    assert callable(fx.translate)


SCOPES = "<a xmlns='urn:1' xmlns:p='urn:p' xml:lang='fr' lang='xx'><b xmlns='' xmlns:q='urn:q'><c/></b><d p:x='1' xml:lang='de-CH'><e lang='en'/></d></a>"


@pytest.fixture(scope="module")
def scopes(spark):
    return markup.xml_nodes(spark.createDataFrame([(1, SCOPES)], "doc_id long, text string")).cache()


@pytest.mark.parametrize(("expression", "want"), [
    ("//*[local-name() = 'c']/namespace::*", ["urn:p", "urn:q"]), ("/*/namespace::*", ["urn:1", "urn:p"]), ("//*[local-name() = 'e']/namespace::p", ["urn:p"]), ("//*[local-name() = 'b']/namespace::*[. = 'urn:q']", ["urn:q"]),
])
def test_namespaces_in_scope(scopes, expression, want):
    assert sorted(r.value for r in XPath(scopes).select(expression).collect()) == want


@pytest.mark.parametrize(("expression", "want"), [("lang('de')", ["d", "e"]), ("lang('FR')", ["a", "b", "c"]), ("lang('de-ch')", ["d", "e"]), ("lang('xx')", []), ("lang(string(@lang))", []), ("lang('en')", [])])
def test_lang_looks_at_xml_lang_alone(scopes, expression, want):
    assert sorted(r.name for r in XPath(scopes).select(f"//*[{expression}]").collect()) == want


def test_node_sets_as_variables(nodes):
    x = XPath(nodes)
    held = XPath(nodes, variables={"titles": x.select("//title"), "one": x.select("//chapter[2]")})
    assert [r.value for r in held.select("//chapter[title = $titles]/@id").orderBy("pre").collect()] == ["c1", "c2", "c3"]
    assert [r.value for r in held.select("$one/title | $one/p").orderBy("pre").collect()] == ["Two", "third"]
    assert held.value("count($titles)", "number").orderBy("doc_id").first().result == 4


@pytest.mark.parametrize(("expression", "want"), [
    ("//p[translate(., ../title, 'xyz') = 'third']", ["third"]), ("//p[translate(., string(../@id), 'F') = 'Fourth']", []), ("//title[translate('Two', ., '') = '']", ["Two"]),
    ("//chapter[p = ../chapter/p]/@id", ["c1", "c2", "c3"]), ("//chapter[p != p]/@id", ["c1"]), ("//chapter[p != 'third']/@id", ["c1", "c3"]), ("//chapter[p = substring-after('a third', ' ')]/@id", ["c2"]), ("//chapter[@id = concat('c', position())]/@id", ["c1", "c2", "c3"]),
    ("//image/ancestor::*/@id", ["c1"]), ("//p/ancestor-or-self::*/@id", ["c1", "c2", "c3"]), ("//chapter/descendant::p", ["first", "second", "third", "fourth"]), ("//chapter/descendant-or-self::*[@id]/@id", ["c1", "c2", "c3"]), ("/book/descendant::chapter/descendant::title", ["One", "Two", "Three"]),
    ("//@id/descendant-or-self::node()", ["c1", "c2", "c3"]), ("//@id/ancestor::chapter/title", ["One", "Two", "Three"]), ("//@id/following::title", ["One", "Two", "Three"]), ("//p/preceding::title", ["Trees & tables", "One", "Two", "Three"]), ("//chapter/following::p[. = 'third']", ["third"]),
])
def test_more_paths(nodes, expression, want):
    assert [r.value for r in XPath(nodes.where("doc_id = 1")).select(expression).orderBy("pre").collect()] == want


def test_no_context_meets_every_node(nodes):
    """Following, preceding, below and above: no join of intervals with nodes."""
    import re

    for path in ("//chapter/following::p", "//chapter/preceding::p", "//chapter/descendant::p", "//p/ancestor::*"):
        plan = XPath(nodes).select(path)._jdf.queryExecution().optimizedPlan().toString()
        for line in (x for x in plan.split("\n") if "Join" in x):
            assert not re.search(r"c_pre|c_end", line), line


def test_random_trees_against_a_standard_parser(spark):
    """Axes without positions against a walk over the tree."""
    import random
    from xml.etree import ElementTree

    rng, texts = random.Random(8), []
    for _ in range(6):
        def grow(depth):
            name = rng.choice("abc")
            return f"<{name}>" + "".join(grow(depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)) + f"</{name}>"
        texts.append("<r>" + grow(4) + grow(3) + "</r>")
    nodes = markup.xml_nodes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    for axis in ("descendant", "descendant-or-self", "ancestor", "ancestor-or-self", "following", "preceding"):
        want = set()
        for d, t in enumerate(texts):
            order, up, last = [], {}, {}

            def walk(e, above):
                at = len(order)
                order.append(e.tag)
                up[at] = above
                for child in e:
                    walk(child, [*above, at])
                last[at] = len(order) - 1

            walk(ElementTree.fromstring(t), [])
            for c in (k for k, n in enumerate(order) if n == "a"):
                for k in range(len(order)):
                    ok = {"descendant": c < k <= last[c], "descendant-or-self": c <= k <= last[c], "ancestor": k in up[c], "ancestor-or-self": k in up[c] or k == c, "following": k > last[c], "preceding": last[k] < c}[axis]
                    if ok:
                        want.add((d, k + 1))  # the document is node 0
        got = {(r.doc_id, r.pre) for r in XPath(nodes).select(f"//a/{axis}::*").collect()}
        assert got == want, axis
