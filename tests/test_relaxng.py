"""RelaxNG: patterns against small documents, restrictions, pieces of any size, node tables."""

import itertools
import random

import pytest

from treeline.operators import relaxng
from treeline.plans.grammars import HEAD, LIBRARY, SCHEMAS
from treeline.sources import markup


def ok(schema, *texts):
    v = relaxng.Validator(relaxng.Schema(schema if schema.startswith("<grammar") else f"<element name='r' {HEAD}>{schema}</element>", LIBRARY))
    out = []
    for t in texts:
        errors = {relaxng.validate_text(v, t, k) for k in (None, 1, 7)}
        assert len(errors) == 1
        out.append(errors.pop() is None)
    return out


@pytest.mark.parametrize(("schema", "good", "bad"), [
    ("<empty/>", ["<r/>", "<r> \n </r>", "<r><!-- c --></r>"], ["<r>t</r>", "<r a=''/>", "<r><r/></r>", "<s/>", "<r xmlns='u'/>"]),
    ("<text/>", ["<r/>", "<r>t<![CDATA[<]]></r>"], ["<r><a/></r>"]),
    ("<optional><element name='a'><empty/></element></optional><oneOrMore><element name='b'><text/></element></oneOrMore>", ["<r><a/><b/></r>", "<r><b/><b>x</b></r>"], ["<r><a/></r>", "<r><b/><a/></r>", "<r><a/>t<b/></r>"]),
    ("<element><anyName><except><name>a</name></except></anyName><empty/></element>", ["<r><b/></r>", "<r><x:a xmlns:x='u'/></r>"], ["<r><a/></r>", "<r/>"]),
    ("<element><nsName ns='u'><except><name ns='u'>z</name></except></nsName><empty/></element>", ["<r><b xmlns='u'/></r>"], ["<r><b/></r>", "<r><z xmlns='u'/></r>"]),
    ("<element><choice><name>a</name><name ns='u'>b</name></choice><empty/></element>", ["<r><a/></r>", "<r><b xmlns='u'/></r>"], ["<r><b/></r>"]),
    ("<attribute name='k'><value>x y</value></attribute>", ["<r k='  x  y '/>"], ["<r k='xy'/>", "<r/>"]),
    ("<attribute name='k'><value type='string' datatypeLibrary=''>x y</value></attribute>", ["<r k='x y'/>"], ["<r k=' x y'/>"]),
    ("<attribute name='k'><value type='integer'>7</value></attribute>", ["<r k='007'/>"], ["<r k='8'/>"]),
    ("<list><data type='int'/><zeroOrMore><value>x</value></zeroOrMore></list>", ["<r> 1 </r>", "<r>2 x x</r>"], ["<r/>", "<r>x</r>", "<r>1 1</r>"]),
    ("<data type='int'><except><value>3</value></except></data>", ["<r>2</r>"], ["<r>3</r>", "<r>x</r>"]),
    ("<data type='token'><param name='pattern'>[a-c]+</param><param name='maxLength'>3</param></data>", ["<r>abc</r>"], ["<r>abca</r>", "<r>d</r>"]),
    ("<choice><attribute name='a'/><element name='a'><empty/></element></choice>", ["<r a=''/>", "<r><a/></r>"], ["<r/>", "<r a=''><a/></r>"]),
    ("<zeroOrMore><attribute><nsName ns='u'/></attribute></zeroOrMore>", ["<r/>", "<r xmlns:x='u' x:a='' x:b=''/>"], ["<r a=''/>"]),
    ("<mixed><element name='a'><empty/></element></mixed>", ["<r>x<a/>y</r>", "<r><a/></r>"], ["<r>x</r>", "<r><a/><a/></r>"]),
    ("<externalRef href='due.rng'/>", ["<r><due>2024-02-29</due></r>"], ["<r><due>2023-02-29</due></r>"]),
])
def test_patterns(schema, good, bad):
    assert ok(schema, *good, *bad) == [True] * len(good) + [False] * len(bad)


def test_interleaving_takes_every_order_and_no_other_set():
    schema = "<interleave><element name='a'><empty/></element><group><element name='b'><empty/></element><element name='c'><empty/></element></group><optional><element name='d'><empty/></element></optional></interleave>"
    for names in itertools.chain.from_iterable(itertools.permutations("abcd", n) for n in range(5)):
        want = {"a", "b", "c"} <= set(names) and names.index("b") < names.index("c")
        assert ok(schema, "<r>" + "".join(f"<{x}/>" for x in names) + "</r>") == [want]


def test_groups_with_repeats_agree_with_a_regular_expression():
    import re

    schema = "<zeroOrMore><choice><group><element name='a'><empty/></element><optional><element name='b'><empty/></element></optional></group><oneOrMore><element name='c'><empty/></element></oneOrMore></choice></zeroOrMore><element name='a'><empty/></element>"
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choices("abc", k=rng.randint(0, 7)))
        assert ok(schema, "<r>" + "".join(f"<{x}/>" for x in word) + "</r>") == [re.fullmatch("(ab?|c+)*a", word) is not None]


def test_grammars_recurse_combine_and_nest():
    schema = f"<grammar {HEAD}><start><ref name='list'/></start><define name='list'><element name='l'><ref name='item'/></element></define><define name='item' combine='choice'><zeroOrMore><ref name='list'/></zeroOrMore></define><define name='item' combine='choice'><data type='int'/></define></grammar>"
    assert ok(schema, "<l/>", "<l>7</l>", "<l><l/><l><l>8</l></l></l>", "<l>7<l/></l>", "<l>x</l>") == [True, True, True, False, False]
    outer = f"<grammar {HEAD}><start><element name='r'><grammar><start><choice><ref name='x'/><parentRef name='x'/></choice></start><define name='x'><element name='in'><empty/></element></define></grammar></element></start><define name='x'><element name='out'><empty/></element></define></grammar>"
    assert ok(outer, "<r><in/></r>", "<r><out/></r>", "<r/>") == [True, True, False]


@pytest.mark.parametrize("k", range(len(SCHEMAS)))
def test_restrictions(k):
    text, elements, error = SCHEMAS[k]
    if error is None:
        assert len(relaxng.Schema(text, LIBRARY).contents) == elements
    else:
        with pytest.raises(relaxng.GrammarError, match=error.replace("(", ".")):
            relaxng.Schema(text, LIBRARY)


@pytest.mark.parametrize("text", ["", "<a/>", f"<start {HEAD}/>", f"<element {HEAD}/>", f"<element name='x:a' {HEAD}><empty/></element>", f"<include {HEAD}/>", f"<choice {HEAD}/>", f"<grammar {HEAD}><b/></grammar>"])
def test_no_schemas(text):
    with pytest.raises(relaxng.GrammarError):
        relaxng.Schema(text)


def test_deep_documents_and_a_small_memory(monkeypatch):
    monkeypatch.setattr(relaxng, "MEMO", 50)
    schema = f"<grammar {HEAD}><start><ref name='a'/></start><define name='a'><element name='a'><optional><ref name='a'/></optional></element></define></grammar>"
    v = relaxng.Validator(relaxng.Schema(schema))
    for n in (1, 200, 3, 200):
        assert relaxng.validate_text(v, "<a>" * n + "</a>" * n) is None
        assert relaxng.validate_text(v, "<a>" * n + "<b/>" + "</a>" * n) == "element b is not allowed in a"


def test_node_tables_and_texts_agree(spark):
    schema = f"<grammar {HEAD}><start><ref name='a'/></start><define name='a'><element name='a'><optional><attribute name='k'><data type='int'/></attribute></optional><mixed><zeroOrMore><ref name='a'/></zeroOrMore></mixed></element></define></grammar>"
    rng = random.Random(8)

    def made(depth):
        inner = "".join(rng.choice(["t", "", made(depth - 1) if depth else "", "<!-- c -->", "<b/>" if rng.random() < 0.1 else ""]) for _ in range(3))
        return f"<a{rng.choice(['', ' k=`1`', ' k=`x`' if rng.random() < 0.1 else ''])}>{inner}</a>".replace("`", '"')

    docs = spark.createDataFrame([(k, made(3)) for k in range(80)], "doc_id long, text string")
    texts = sorted(map(tuple, relaxng.validate(docs, schema).collect()))
    assert sorted(map(tuple, relaxng.validate_nodes(markup.xml_nodes(docs), schema).collect())) == texts
    assert 10 < sum(v for _, v, _ in texts) < 75


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "<r>"), (4, "<r/>"), (4, "<r/>"), (None, "<s/>")], "doc_id long, text string")
    got = sorted(map(tuple, relaxng.validate(docs, f"<element name='r' {HEAD}><empty/></element>").collect()), key=str)
    assert got == sorted([(1, False, "not well-formed"), (2, False, "not well-formed"), (3, False, "not well-formed"), (4, True, None), (4, True, None), (None, False, "element s is not allowed")], key=str)
