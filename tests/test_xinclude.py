"""XInclude over a table: against a recursive expansion, loops, fallbacks, pointers, bases, namespaces."""

import random
from xml.etree import ElementTree

import pytest

from treeline.operators import xinclude

NS = 'xmlns:xi="http://www.w3.org/2001/XInclude"'


def inc(href, more="", inner=""):
    return f'<xi:include {NS} href="{href}" {more}>{inner}</xi:include>'


def expanded(spark, library, names=None):
    df = spark.createDataFrame(list(library.items()), "name string, text string")
    roots = None if names is None else spark.createDataFrame([(n,) for n in names], "name string")
    return {r.name: (r.text, r.error) for r in xinclude.expand(df, roots).collect()}


def test_small_documents(spark):
    fall = "<xi:fallback>none<f/></xi:fallback>"
    library = {
        "a": f"<?xml version='1.0'?><!-- top --><r>1{inc('x')}2{inc('t', 'parse=\"text\"')}3</r>", "x": "<x k='>'>in</x>", "t": "a < b & c",
        "gone": f"<r>{inc('nothing')}</r>", "fallen": f"<r>{inc('nothing', '', fall)}</r>", "outer": f"<r>{inc('gone', '', fall)}</r>", "bad": "<r>", "broken": f"<r>{inc('bad', '', fall)}{inc('bad')}</r>",
        "loop1": f"<r>{inc('loop2', '', fall)}</r>", "loop2": f"<r>{inc('loop1')}</r>", "above": f"<r>{inc('loop1')}</r>", "unused": f"<r>{inc('x', '', '<xi:fallback>' + inc('unused') + '</xi:fallback>')}</r>",
        "nested": f"<r>{inc('no', '', '<xi:fallback>' + inc('no', '', '<xi:fallback>' + inc('x') + '!</xi:fallback>') + '</xi:fallback>')}</r>", "twice": f"<r>{inc('a')}{inc('a')}</r>", "nil": None, "nils": f"<r>{inc('nil')}</r>",
    }
    got = expanded(spark, library)
    x, a = "<x xml:base=\"x\" k='>'>in</x>", "a &lt; b &amp; c"
    assert got["a"] == (f"<?xml version='1.0'?><!-- top --><r>1{x}2{a}3</r>", None)
    assert got["gone"] == (None, "nothing is missing") and got["outer"] == (None, "nothing is missing") and got["broken"] == (None, "bad is not well-formed")
    assert got["fallen"] == ("<r>none<f/></r>", None) and got["nested"] == (f"<r>{x}!</r>", None) and got["unused"] == (f"<r>{x}</r>", None)
    assert [got[n][1] for n in ("loop1", "loop2", "above")] == [f"{n} includes a loop" for n in ("loop1", "loop2", "above")]
    inner = f'<r xml:base="a">1{x}2{a}3</r>'
    assert got["twice"] == (f"<r>{inner}{inner}</r>", None)
    assert got["bad"] == (None, "bad is not well-formed") and got["nil"] == (None, "nil is missing") and got["nils"] == (None, "nil is missing")


@pytest.mark.parametrize(("pointer", "want"), [
    ("element(/1/2)", "<b>2</b>"), ("element(q/1)", "<c/>"), ("q", '<d id="q"><c/></d>'), ("xpointer(/r/b[2])", "<b>2</b>"), ("xpointer(//b)", "<b>1</b><b>2</b>"), ("xpointer(//none)element(/1/1)", "<b>1</b>"),
    ("xmlns(p=urn:p)xpointer(//p:e)", "<e/>"), ("element(/1/9)", None), ("xpointer(//[)", None), ("element(/2)", None),
])
def test_pointers(spark, pointer, want):
    library = {"t": '<r><b>1</b><b>2</b><d id="q"><c/></d><p:e xmlns:p="urn:p"/></r>', "a": f"<a>{inc('t', f'xpointer=\"{pointer}\"')}</a>"}
    text, error = expanded(spark, library, ["a"])["a"]
    if want is None:
        assert error == f"{pointer} is not in t"
    else:
        plain = text.replace(' xml:base="t"', "").replace(' xmlns:p="urn:p"', "").replace("p:", "")
        assert plain == f"<a>{want}</a>"


def test_bases_and_namespaces(spark):
    library = {
        "d/a.xml": f"<a>{inc('../e/b.xml')}</a>", "e/b.xml": f"<b xml:base='sub/'>{inc('c.xml', 'xpointer=\"element(/1/1)\"')}</b>", "e/c.xml": "<p:r xmlns:p='urn:p' xmlns='urn:d' xmlns:q='urn:q'><p:x xmlns:q='urn:own' q:k='1'><y/></p:x></p:r>",
    }
    text, _ = expanded(spark, library, ["d/a.xml"])["d/a.xml"]
    root = ElementTree.fromstring(text)
    base = "{http://www.w3.org/XML/1998/namespace}base"
    assert root[0].get(base) == "e/sub/" and root[0][0].get(base) == "e/c.xml"
    assert root[0][0].tag == "{urn:p}x" and root[0][0].get("{urn:own}k") == "1" and root[0][0][0].tag == "{urn:d}y"


def test_random_libraries_agree_with_recursion(spark):
    rng = random.Random(6)
    names = [f"n{k}" for k in range(60)]
    library = {}
    for k, n in enumerate(names):
        body = ""
        for _ in range(rng.randint(0, 3)):
            later = names[min(59, k + rng.randint(1, 25))] if rng.random() < 0.95 else names[rng.randint(0, k)]
            target = later if rng.random() < 0.8 else "gone"
            body += f"t{k}" + inc(target, "", f"<xi:fallback>f{inc(names[min(59, k + 9)]) if rng.random() < 0.3 else ''}</xi:fallback>" if rng.random() < 0.7 else "")
        library[n] = f"<r>{body}</r>"

    def one(name, path):
        """Text and whether an error is final; None for a loop."""
        if name in path:
            raise RecursionError
        if name not in library:
            return None
        out, at = "", 0
        pieces = xinclude.cut(name, "document", "", library[name])
        for *_, text, target, _, _, fallback, _ in pieces:
            if target is None:
                out += text
                continue
            got = one(target, (*path, name))
            if got is None:
                if fallback is None:
                    raise LookupError
                got = fold(name, fallback, (*path, name))
            else:
                got = got.replace("<r>", f'<r xml:base="{target}">', 1) if not got.startswith('<r xml:base') else got
            out += got
            at += 1
        return out

    def fold(name, fallback, path):
        out = ""
        for *_, text, target, _, _, inner, _ in xinclude.cut(name, "fallback", fallback, library[name]):
            got = text if target is None else one(target, path)
            if got is None:
                raise LookupError
            out += got if target is None else got.replace("<r>", f'<r xml:base="{target}">', 1)
        return out

    got = expanded(spark, library)
    kinds = set()
    for n in names:
        try:
            want = one(n, ()), None
        except (RecursionError, LookupError) as e:
            want = None, type(e).__name__
        kinds.add(want[1])
        if want[1] is None:
            assert got[n] == want, n
        else:
            assert got[n][0] is None and got[n][1]
    assert len(kinds) > 1


def test_no_documents(spark):
    df = spark.createDataFrame([], "name string, text string")
    assert xinclude.expand(df).collect() == []
