"""Automata against regular expressions, events over many ranges, the writer's states, limits, extension functions."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from treeline.nodetable import order_tree
from treeline.operators import automaton as a
from treeline.operators import writer
from treeline.plans.xpath import Function, Limits, XPath, XPathError
from treeline.sources import markup

PATTERNS = [
    (a.sequence("x", a.times("y", 2, 3), a.optional("z")), "xy{2,3}z?"), (a.times(a.either("x", a.sequence("y", "z"))), "(x|yz)*"), (a.times(a.times("x", 0, 2), 2, 2), "(x{0,2}){2}"),
    (a.all_of("x", "y", a.optional("z")), "xy|yx|xyz|xzy|yxz|yzx|zxy|zyx"), (a.sequence(a.times(a.either("x", "y")), "x", a.times("y", 3, 3)), "(x|y)*xy{3}"), (a.all_of(a.times("x", 1, 2), "y"), "x{1,2}y|yx{1,2}"),
    (a.times(a.sequence("x", a.optional("y")), 1, 2), "(xy?){1,2}"), (a.times("x", 0, 0), ""), (a.either(), "(?!)"), (a.times(a.all_of("x", "y"), 2, 2), "(xy|yx){2}"),
]


@pytest.mark.parametrize("k", range(len(PATTERNS)))
def test_automata_are_their_expressions(k):
    pattern, expression = PATTERNS[k]
    m = a.compile(pattern)
    words = ["".join(w) for n in range(7) for w in itertools.product("xyz", repeat=n)]
    good = {w for w in words if re.fullmatch(expression, w)}
    for w in words[:400]:
        state = 0
        for c in w:
            state = m.moves[state][m.tokens.index(c)] if state >= 0 and c in m.tokens else -1
        assert (state >= 0 and m.final[state]) == (w in good), w
        if state >= 0:
            assert set(m.next(state)) >= {v[len(w)] for v in good if v.startswith(w) and len(v) > len(w)}


def test_too_many_states():
    with pytest.raises(a.PatternError):
        a.compile(a.all_of(*map(str, range(20))))


def test_one_key_over_many_ranges(spark):
    """A key that holds most events is composed from several maps; null and unknown tokens and ties have their rules."""
    m = a.compile(a.times(a.sequence("x", a.times("y", 1, 3))))
    rng, rows = random.Random(3), []
    for key, n in (("hot", 3000), ("late", 2000), ("b", 5), ("c", 1)):
        word = (["x"] + ["y"] * rng.randint(1, 3)) if key == "c" else list(itertools.islice(itertools.chain.from_iterable(["x"] + ["y"] * rng.randint(1, 3) for _ in range(n)), n))
        if key == "late":
            word[1700] = "q"
        rows += [(key, k, t) for k, t in enumerate(word)]
    rows += [("nil", 0, None), (None, 0, "x"), ("tie", 5, "y"), ("tie", 5, "x")]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.key: r for r in a.run(spark.createDataFrame(rows, "key string, at long, token string").repartition(7), "key", F.col("at"), "token", m).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got["hot"].failed_at is None and got["hot"].n == 3000 and got["late"].failed_at == 1700 and not got["late"].accepted and got["late"].next is None
    assert got["c"].accepted and got["nil"].failed_at == 0 and got[None].next == ["y"] and not got[None].accepted and got["tie"].accepted
    assert a.run(spark.createDataFrame([], "key string, at long, token string"), "key", F.col("at"), "token", m).collect() == []


@pytest.mark.parametrize(("events", "want"), [
    ([("start", "a", None), ("attr", "k", 'x<"&\n'), ("text", None, "t<&>"), ("start", "b", None), ("end", "b", None), ("end", None, None)], '<a k="x&lt;&quot;&amp;&#10;">t&lt;&amp;&gt;<b/></a>'),
    ([("comment", None, "c"), ("pi", "p", "d"), ("start", "a", None), ("cdata", None, "x]]>y")], "<!--c--><?p d?><a><![CDATA[x]]]]><![CDATA[>y]]></a>"),
    ([("start", "a", None), ("end", "a", None), ("comment", None, None), ("text", None, " ")], "<a/><!---->"),
    ([("start", "1a", None)], WRONG := "no name: 1a"), ([("text", None, "t")], "text outside the document element"), ([("start", "a", None), ("end", "a", None), ("end", "a", None)], "end of nothing"),
    ([("start", "a", None), ("pi", "XML", None)], "no instruction: XML"), ([("comment", None, "x")], "no document element"), ([("start", "a", None), ("what", None, None)], "unknown event what"), ([("start", "a", None), ("text", None, ""), ("attr", "k", "")], "attribute k outside a start tag"),
])
def test_writer(spark, events, want):
    df = spark.createDataFrame([(1, k, *e) for k, e in enumerate(events)], "doc_id long, seq long, event string, name string, text string").repartition(3)
    (r,) = writer.write(df).collect()
    assert (r.xml or r.error) == want and (r.xml is None) == (r.error is not None)


def test_indented(spark):
    df = spark.createDataFrame([(1, "<a><b><c/></b><d>t<e/></d></a>")], "doc_id long, text string")
    (r,) = writer.write(writer.events_of(markup.xml_nodes(df)), indent="  ").collect()
    assert r.xml == "<a>\n  <b>\n    <c/>\n  </b>\n  <d>t<e/></d>\n</a>"


def test_what_is_written_is_read_again(spark):
    texts = ["<a/>", "<a k='1' xmlns:p='urn:p'><p:b p:x='&lt;'>t</p:b><!-- c --><?p d?>u<![CDATA[<]]></a>", "<a>" * 40 + "x" + "</a>" * 40, "<a xmlns='urn:d'><b xmlns=''/></a>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = markup.xml_nodes(docs)
    again = writer.write(writer.events_of(nodes)).select("doc_id", F.col("xml").alias("text"))
    plain = lambda df: sorted((r.doc_id, r.pre, r.end, r.kind, r.ns or "", r.prefix or "", r.name or "", r.value) for r in df.collect())
    assert plain(markup.xml_nodes(again)) == plain(nodes)


def test_limits_stop_documents_alone(spark):
    docs = spark.createDataFrame([(1, "<a>" * 300 + "</a>" * 300), (2, "<a>t</a>"), (3, "<a"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.domain, r.message) for r in markup.errors(docs, limits=markup.Limits()).collect()}
    assert got == {1: ("limits", "depth above 256"), 3: ("parser", "unclosed token"), 4: ("parser", "no element found")}
    counts = {r.doc_id: r["count"] for r in markup.xml_nodes(docs, limits=markup.Limits()).groupBy("doc_id").count().collect()}
    assert counts[1] == 257 and counts[2] == 3 and markup.xml_nodes(docs).where("doc_id = 1").count() == 301


@pytest.mark.parametrize(("expression", "error"), [
    ("x:none(1)", "unknown function"), ("q:rank(1)", "undefined prefix"), ("x:rank()", "0 arguments"), ("x:rank(1, 2)", "2 arguments"), ("x:size('a')", "node-set"), ("(" * 70 + "1" + ")" * 70, "nested"), ("+".join("1" * 400), "inside each other"), ("|".join(["//a"] * 2000), "operations"),
])
def test_extension_functions_are_checked(spark, small, expression, error):
    functions = {("urn:x", "rank"): Function(lambda s: s, ("string",), "number"), ("urn:x", "size"): Function(F.size, ("set",), "number")}
    with pytest.raises(XPathError, match=error):
        XPath(order_tree(spark, small), namespaces={"x": "urn:x"}, functions=functions).value(expression)


def test_extension_functions_in_predicates_count_positions(spark):
    nodes = markup.xml_nodes(spark.createDataFrame([(1, "<r><a n='2'/><a n='2'/><a n='1'/></r>")], "doc_id long, text string"))
    functions = {"own": lambda *s: F.concat_ws("-", *s), ("urn:x", "num"): Function(lambda s: s.try_cast("double"), ("string",), "number"), ("urn:x", "size"): Function(F.size, ("set",), "number")}
    x = XPath(nodes, namespaces={"x": "urn:x"}, functions=functions)
    assert [r.pre for r in x.select("//a[x:num(@n)]").orderBy("pre").collect()] == [4]
    assert x.value("own('a', 'b', x:size(//a), x:size(//none))").first().result == "a-b-3-0"
    with pytest.raises(XPathError):
        XPath(nodes, limits=Limits(operations=5)).select("//a[@n = 1]")
