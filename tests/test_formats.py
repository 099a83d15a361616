"""DTDs, rules, catalogs, canonical form, edits and output by hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from treeline.operators import c14n, catalog, dtd, edits, nodes, output, schematron
from treeline.plans.xpath import XPath, XPathError
from treeline.sources import markup

LETTERS = "<!ELEMENT r (a,(b|c)*,d?)><!ELEMENT a EMPTY><!ELEMENT b (#PCDATA)><!ELEMENT c (#PCDATA|a)*><!ELEMENT d ANY>"


@pytest.mark.parametrize(("text", "errors"), [
    ("<r><a/></r>", 0), ("<r><a/><b>x</b><c>y<a/>z</c><d><r><a/></r></d></r>", 0), ("<r/>", 1), ("<r><b/><a/></r>", 1), ("<r><a/>text</r>", 1), ("<r><a>x</a></r>", 1), ("<r> <a/>\n </r>", 0), ("<r><a/><d/><b/></r>", 1), ("<r><a/><e/></r>", 2), ("<r><a/>", 1), ("", 1), ("<a/>", 0),
])
@pytest.mark.parametrize("chunk", [None, 1, 3])
def test_content_models(text, errors, chunk):
    assert len(dtd.validate_text(dtd.parse(LETTERS), text, chunk=chunk).errors) == errors


@pytest.mark.parametrize(("model", "good", "bad"), [
    ("(a,b)", ["ab"], ["", "a", "ba", "abb"]), ("(a|b)+", ["a", "ab", "bba"], ["", "c"]), ("(a?,b*)", ["", "a", "bb", "abb"], ["aa", "ba"]), ("((a,b)|c)*", ["", "ab", "cab", "abab"], ["a", "ba", "abb"]), ("(a,(b,c)?,d)", ["ad", "abcd"], ["abd", "acd", "abcbcd"]), ("((a*,b)+)", ["b", "aab", "bb", "abaab"], ["", "a", "ba"]),
])
def test_models_accept_their_language(model, good, bad):
    import re

    m, held = dtd.content_model(model), re.compile(model.replace(",", ""))
    for word in {*good, *bad, *("".join(random.Random(k).choices("abcd", k=k % 6)) for k in range(200))}:
        state: frozenset | None = None
        for c in word:
            state = m.step(state, c)
            if not state:
                break
        ok = (state is None and m.nullable) or bool(state) and m.complete(state)
        assert ok == (held.fullmatch(word) is not None), word
    assert all(held.fullmatch(w) for w in good) and not any(held.fullmatch(w) for w in bad)


def test_determinism_and_what_may_follow():
    assert dtd.content_model("(a,(b|c))").deterministic() and not dtd.content_model("((a,b)|(a,c))").deterministic() and not dtd.content_model("(a*,a)").deterministic()
    m = dtd.content_model("(a,(b|c)*,d?)")
    assert m.potential() == ["a"] and m.potential(m.step(None, "a")) == ["b", "c", "d"] and m.potential(m.step(m.step(None, "a"), "d")) == []


ATTRS = '<!ELEMENT r (i*)><!ELEMENT i EMPTY><!ATTLIST i id ID #IMPLIED to IDREFS #IMPLIED t NMTOKEN #IMPLIED k (x|y) "x" f CDATA #FIXED "1"><!ATTLIST i id CDATA #REQUIRED>'


@pytest.mark.parametrize(("text", "errors"), [
    ('<i id="a"/><i to="a"/>', []), ('<i to="b a"/><i id="a"/>', ["IDREF b has no ID"]), ('<i id="a"/><i id="a"/>', ["ID a is there twice"]), ('<i id="1a"/>', ["value of attribute id of i is no ID"]), ('<i t="a b"/>', ["value of attribute t of i is no NMTOKEN"]),
    ('<i k="z"/>', ["value of attribute k of i is no ENUMERATION"]), ('<i f="2"/>', ["attribute f of i is not 1"]), ('<i q="2"/>', ["no declaration for attribute q of i"]),
])
def test_attributes(text, errors):
    assert dtd.validate_text(dtd.parse(ATTRS), f"<r>{text}</r>").errors == errors


def test_parameter_entities_and_faults():
    d = dtd.parse('<!ENTITY % ext SYSTEM "more.dtd"> %ext; <!ENTITY % m "(x|y)"><!ELEMENT a %m;><!ENTITY co "Company"><!ENTITY co "Other"><!NOTATION n SYSTEM "v">', {"more.dtd": "<!ELEMENT x EMPTY><!-- c --><?p i?>"})
    assert d.elements["a"].names == ["x", "y"] and d.elements["x"].kind == "empty" and d.entities == {"co": "Company"} and d.notations == {"n"}
    for bad in ("<!ELEMENT a (b,c|d)>", "<!ELEMENT a (b>", "<!ELEMENT a (#PCDATA|b)>", "%none;", "<!ENTITY % a '%b;'><!ENTITY % b '%a;'>%a;", "text", "<!ATTLIST a b>", "<!ELEMENT a %none;>"):
        with pytest.raises(dtd.DtdError):
            dtd.parse(bad)


def test_rows_of_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "<r>"), (4, "<r><a/></r>"), (4, "<r><a/></r>")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.valid) for r in dtd.validate(df, LETTERS).collect()) == [(1, False), (2, False), (3, False), (4, True), (4, True)]
    assert sorted((r.doc_id, r.canonical is None) for r in c14n.canonicalize(df).collect()) == [(1, True), (2, True), (3, True), (4, False), (4, False)]


@pytest.mark.parametrize(("text", "plain", "exclusive"), [
    ("<a  b='1'  a=\"2\" />", '<a a="2" b="1"></a>', None), ("<a>&lt;&#xD;&amp;&gt;\"</a>", '<a>&lt;&#xD;&amp;&gt;"</a>', None), ("<a x='&#9;&quot;&#10;&lt;>'/>", '<a x="&#x9;&quot;&#xA;&lt;>"></a>', None), ("<a><![CDATA[<b>]]></a>", "<a>&lt;b&gt;</a>", None),
    ('<n1:a xmlns:n1="u:1" xmlns:n2="u:2"><n2:b xmlns:n1="u:1"/></n1:a>', '<n1:a xmlns:n1="u:1" xmlns:n2="u:2"><n2:b></n2:b></n1:a>', '<n1:a xmlns:n1="u:1"><n2:b xmlns:n2="u:2"></n2:b></n1:a>'),
    ('<a xmlns="u:1"><b xmlns=""><c xmlns=""/></b></a>', '<a xmlns="u:1"><b xmlns=""><c></c></b></a>', None), ('<?p  i?><a/><!-- c -->', "<?p i?>\n<a></a>", None), ('<a xmlns:x="u:1" x:b="1" c="2"/>', '<a xmlns:x="u:1" c="2" x:b="1"></a>', None),
])
def test_canonical_form(spark, text, plain, exclusive):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert c14n.canonicalize(df).first().canonical == plain
    assert c14n.canonicalize(df, exclusive=True).first().canonical == (exclusive or plain)
    n = markup.xml_nodes(df)
    assert c14n.canonicalize_nodes(n, n).first().canonical == plain


def same(a, b):
    pick = ["doc_id", "pre", "end", "level", "parent", "kind", "name"]
    return sorted(map(str, a.select(*pick).collect())) == sorted(map(str, b.select(*pick).collect()))


SOURCE = '<r><a k="1"><b>x</b>y</a><c/><a><d><b/></d></a></r>'


@pytest.mark.parametrize(("edit", "want"), [
    (lambda n: edits.unlink(n, n.where("name = 'a'")), "<r><c/></r>"), (lambda n: edits.unlink(n, n.where("name in ('d', 'b')")), '<r><a k="1">y</a><c/><a/></r>'), (lambda n: edits.unlink(n, n.where("name = 'nosuch'")), SOURCE), (lambda n: edits.unlink(n, n.where("kind = 'attr'")), SOURCE.replace(' k="1"', "")),
    (lambda n: edits.inserted(n, n.where("name = 'a'"), "before", "element", "n"), SOURCE.replace("<a", "<n/><a")), (lambda n: edits.inserted(n, n.where("name = 'a'"), "after", "element", "n", F.lit("t")), SOURCE.replace("</a>", "</a><n>t</n>")),
    (lambda n: edits.inserted(n, n.where("name = 'b'"), "after", "element", "n"), '<r><a k="1"><b>x</b><n/>y</a><c/><a><d><b/><n/></d></a></r>'), (lambda n: edits.inserted(n, n.where("name in ('r', 'a', 'd')"), "last", "element", "n"), '<r><a k="1"><b>x</b>y<n/></a><c/><a><d><b/><n/></d><n/></a><n/></r>'),
    (lambda n: edits.inserted(n, n.where("kind = 'element'"), "first", "element", "n", F.col("name")), '<r><n>r</n><a k="1"><n>a</n><b><n>b</n>x</b>y</a><c><n>c</n></c><a><n>a</n><d><n>d</n><b><n>b</n></b></d></a></r>'), (lambda n: edits.replaced(n, n.where("name in ('a', 'b')"), "element", "z", F.lit("w")), "<r><z>w</z><c/><z>w</z></r>"),
    (lambda n: edits.with_attribute(n, n.where("name = 'a'"), "k", F.lit("2")), SOURCE.replace('k="1"', 'k="2"').replace("<a><d>", '<a k="2"><d>')), (lambda n: edits.renamed(n, n.where("name = 'a'"), "A"), SOURCE.replace("<a", "<A").replace("</a>", "</A>")),
])
def test_edits_equal_a_new_reading(spark, edit, want):
    n = markup.xml_nodes(spark.createDataFrame([(1, SOURCE), (2, "<r/>")], "doc_id long, text string"))
    got = edit(n).where("doc_id = 1")
    assert same(got, markup.xml_nodes(spark.createDataFrame([(1, want)], "doc_id long, text string")))
    assert nodes.serialize(got, F.col("name") == "r").first().xml == want


def test_values_after_an_edit(spark):
    n = markup.xml_nodes(spark.createDataFrame([(1, SOURCE)], "doc_id long, text string"))
    got = edits.with_values(edits.inserted(n, n.where("name = 'c'"), "first", "text", None, F.lit("new")))
    assert [r.value for r in got.where("name in ('r', 'c')").orderBy("pre").collect()] == ["xynew", "new"]


RULES = """<s:schema xmlns:s="http://purl.oclc.org/dsdl/schematron" defaultPhase="one"><s:ns prefix="p" uri="urn:p"/>
<s:phase id="one"><s:active pattern="A"/></s:phase><s:diagnostics><s:diagnostic id="d">of <s:value-of select="@id"/></s:diagnostic></s:diagnostics>
<s:pattern id="A"><s:rule abstract="true" id="base"><s:assert test="@id">no id</s:assert></s:rule>
<s:rule context="item[@skip] | /none"/><s:rule context="item"><s:extends rule="base"/><s:report test="p:x" diagnostics="d">has <s:name path="p:x"/></s:report></s:rule></s:pattern>
<s:pattern id="B"><s:rule context="item"><s:assert test="false()">never</s:assert></s:rule></s:pattern></s:schema>"""


def test_rules(spark):
    text = '<r xmlns:q="urn:p"><item/><item skip="1"/><item id="7"><q:x/></item><item id="8"/></r>'
    n = markup.xml_nodes(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    schema = schematron.read(RULES)
    assert [(r.pattern, r.kind, r.message) for r in schematron.report(n, schema).orderBy("pre").collect()] == [("A", "assert", "no id"), ("A", "report", "has q:x of 7")]
    assert schematron.report(n, schema, "#ALL").where("pattern = 'B'").count() == 4
    with pytest.raises(schematron.SchemaError):
        schematron.report(n, schema, "nosuch")
    for bad in ("<a/>", "<schema", "<schema><pattern><rule><assert test='1'/></rule></pattern></schema>", "<schema><pattern><rule context='a'><assert/></rule></pattern></schema>", "<schema><pattern><rule context='a'><extends rule='x'/></rule></pattern></schema>"):
        with pytest.raises(schematron.SchemaError):
            schematron.read(bad)
    nested = schematron.read("<schema><pattern><rule context='item'><let name='v' value='@id'/><assert test='../item[@id = $v]'>x</assert></rule></pattern></schema>")
    with pytest.raises(XPathError):
        schematron.report(n, nested)


def test_catalogs():
    ns = catalog.NS[1:-1]
    library = {
        "c.xml": f'<catalog xmlns="{ns}"><public publicId="-//A//B  C//EN" uri="abc"/><system systemId="s1" uri="one"/><group prefer="system"><public publicId="low" uri="low.dtd"/></group><rewriteSystem systemIdStartString="http://x/" rewritePrefix="/x/"/><rewriteSystem systemIdStartString="http://x/y/" rewritePrefix="/y/"/>'
        '<systemSuffix systemIdSuffix="z.dtd" uri="zed"/><delegatePublic publicIdStartString="-//D" catalog="d.xml"/><nextCatalog catalog="n.xml"/></catalog>',
        "d.xml": f'<catalog xmlns="{ns}"><public publicId="-//D//E" uri="de"/></catalog>',
        "n.xml": f'<catalog xmlns="{ns}"><public publicId="-//D//N" uri="never"/><system systemId="s2" uri="two"/><nextCatalog catalog="c.xml"/></catalog>',
    }
    c = catalog.Catalog.load(library, "c.xml")
    cases = [
        (("-//A//B C//EN", None), "abc"), ((None, "s1"), "one"), (("-//A//B C//EN", "s1"), "one"), (("low", None), "low.dtd"), (("low", "other"), None), ((None, "http://x/a"), "/x/a"), ((None, "http://x/y/a"), "/y/a"), ((None, "any/z.dtd"), "zed"),
        (("-//D//E", None), "de"), (("-//D//N", None), None), ((None, "s2"), "two"), ((None, "s3"), None), (("urn:publicid:-:A:B+C:EN", None), "abc"), ((None, "urn:publicid:-:A:B+C:EN"), "abc"), ((None, None), None),
    ]
    for (public, system), want in cases:
        assert c.resolve(public, system) == want, (public, system)
    assert c.add("system", "s3", "three") and not c.add("system", "s3", "three") and c.resolve(None, "s3") == "three" and c.remove("three") == 1 and c.resolve(None, "s3") is None
    assert catalog.Catalog.load({"x": "<broken"}, "x").resolve("a", "b") is None and catalog.Catalog.load({}, "gone").uri("a") is None


@pytest.mark.parametrize(("text", "value", "error"), [
    ("1 + 2 * 3", 7, None), ("-(2 ** 3) // 3", -3, None), ("7 % 4 / 2", 1.5, None), ("1 / 0", None, "division by zero"), ("2 ** 1000", None, "exponent too large"), ("a + 1", None, "not arithmetic"), ("(1", None, "not arithmetic"), (None, None, "no expression"), ("1 if 2 else 3", None, "not arithmetic"), ("9" * 2000, None, "too long"), ("True + 1", None, "not arithmetic"), ("", None, "not arithmetic"),
])
def test_calculator(text, value, error):
    assert output.calculate(text) == (value, error)


def test_prompts_that_include_each_other(spark):
    library = spark.createDataFrame([("a", "A {{include: b}}"), ("b", "B {{include: a}}"), ("c", "C")], "name string, text string")
    prompts = spark.createDataFrame([("x", "{{include: a}}"), ("y", "1 {{include: c}} 2 {{ include: c }} {{include:c}}"), ("z", "plain"), ("n", None)], "name string, text string")
    got = {r.name: (r.text, r.error) for r in output.expanded(prompts, library).collect()}
    file = '<file name="c">\nC\n</file>'
    assert got == {"x": (None, "includes itself"), "y": (f"1 {file} 2 {{{{ include: c }}}} {file}", None), "z": ("plain", None), "n": (None, None)}


def test_yaml_reads_back(spark):
    texts = ["plain text", "yes", "a: b", '"q"', "back\\slash", "two\nlines", "", "1", " lead", "trail ", "- dash", None]
    rows = [r.y for r in spark.createDataFrame([(t,) for t in texts], "t string").select(output.yaml_text(F.col("t")).alias("y")).collect()]
    import json

    for t, y in zip(texts, rows, strict=True):
        assert (json.loads(y) if y.startswith('"') else None if y == "null" else y) == t


def test_streaming_patterns_equal_paths(spark):
    text = "<a><b><c k='1'/><b><c/></b></b><c><a><c/></a></c></a>"
    df = spark.createDataFrame([(1, text), (2, "<a><b>"), (3, None)], "doc_id long, text string")
    n = markup.xml_nodes(df.where("doc_id = 1"))
    order = {r.pre: k for k, r in enumerate(n.where("kind = 'element'").orderBy("pre").collect())}
    for pattern, path in (("c", "//c"), ("b/c", "//b/c"), ("/a//c", "/a//c"), ("a//c", "//a//c"), ("/c", "/c"), ("/a/c", "/a/c"), ("b//c | a/c", "//b//c | //a/c"), ("*", "//*"), ("b/*", "//b/*")):
        want = sorted(order[r.pre] for r in XPath(n).select(path).collect())
        for chunk in (1, 4096):
            assert sorted(r.element for r in markup.stream_matches(df, pattern, chunk).where("doc_id = 1").collect()) == want, pattern
    assert [(r.doc_id, r.name) for r in markup.stream_matches(df, "c/@k | b").where("doc_id < 3").orderBy("doc_id", "element", "name").collect()] == [(1, "b"), (1, "@k"), (1, "b"), (2, "b")]


XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:t" xmlns="urn:t" elementFormDefault="qualified">
<xs:simpleType name="code"><xs:restriction base="xs:string"><xs:pattern value="[a-z-[aeiou]]{2}"/><xs:pattern value="\\i\\c*X"/><xs:minLength value="2"/></xs:restriction></xs:simpleType>
<xs:simpleType name="few"><xs:restriction><xs:simpleType><xs:list itemType="xs:short"/></xs:simpleType><xs:maxLength value="2"/></xs:restriction></xs:simpleType>
<xs:simpleType name="either"><xs:union memberTypes="xs:boolean xs:date"/></xs:simpleType>
<xs:complexType name="base"><xs:sequence><xs:element name="a" type="xs:int"/></xs:sequence><xs:attribute name="x" type="xs:int" fixed="7"/></xs:complexType>
<xs:complexType name="more"><xs:complexContent><xs:extension base="base"><xs:sequence><xs:element name="b" minOccurs="0" maxOccurs="unbounded" type="code"/></xs:sequence><xs:attribute name="y" use="required" type="few"/></xs:extension></xs:complexContent></xs:complexType>
<xs:element name="r" type="more"/><xs:element name="e" type="either" nillable="true"/><xs:element name="m"><xs:complexType mixed="true"><xs:choice minOccurs="0" maxOccurs="unbounded"><xs:element ref="r"/><xs:element name="i" fixed="k" type="xs:token"/></xs:choice></xs:complexType></xs:element>
<xs:element name="all"><xs:complexType><xs:all><xs:element name="p"/><xs:element name="q" minOccurs="0"/></xs:all></xs:complexType></xs:element>
<xs:element name="pairs"><xs:complexType><xs:sequence maxOccurs="unbounded"><xs:element name="p"/><xs:element name="q" minOccurs="0"/><xs:any minOccurs="0"/></xs:sequence></xs:complexType></xs:element></xs:schema>"""


@pytest.mark.parametrize(("text", "errors"), [
    ('<r y="1 2"><a>3</a><b>bc</b><b>aX</b></r>', []), ('<r y="1 2 3"><a>3</a></r>', ["value of attribute y of r breaks maxLength"]), ("<r><a>3</a></r>", ["r lacks attribute y"]), ('<r y="" x="8"><a>x</a></r>', ["attribute x of r is not 7", "value of a breaks int"]), ('<r y=""><b>bc</b></r>', ["content of r does not fit"]), ('<r y="" z=""><a>1</a><b>ab</b></r>', ["r has attribute z", "value of b breaks pattern"]),
    ('<r y="70000"><a>1</a>t</r>', ["value of attribute y of r breaks short", "r has text"]), ("<e>true</e>", []), ("<e>2024-02-29</e>", []), ("<e>2023-02-29</e>", ["value of e breaks union"]), ('<e xmlns:i="http://www.w3.org/2001/XMLSchema-instance" i:nil="true"/>', []), ('<m>t<r y=""><a> 1 </a></r>u<i> k </i></m>', []), ("<m><i>l</i></m>", ["i is not k"]),
    ("<all><q/><p/></all>", []), ("<all><q/></all>", ["content of all does not fit"]), ("<all><p/><p/></all>", ["content of all does not fit"]), ("<pairs><p/><q/><p/><p/></pairs>", []), ("<pairs><q/></pairs>", ["content of pairs does not fit"]), ("<pairs><p/><e>x</e></pairs>", ["value of e breaks union"]), ("<none/>", ["no declaration for element none"]), ("<r>", ["not well-formed"]), (None, ["not well-formed"]),
])
def test_schemas(text, errors):
    from treeline.operators import schema

    held = schema.Schema(XSD)
    if text and text.startswith("<") and text != "<r>":
        head, _, rest = text.partition(">") if not text.endswith("/>") or ">" in text[:-1] else (text[:-2], "", "")
        text = f'{head.rstrip("/")} xmlns="urn:t"{"/" if head.endswith("/") or not rest else ""}>{rest}'
    assert held.errors(text) == errors


@pytest.mark.parametrize("bad", ["<a/>", "<broken", '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:import/></xs:schema>', '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="a"><xs:simpleType><xs:restriction base="xs:string"><xs:pattern value="\\p{L}"/></xs:restriction></xs:simpleType></xs:element></xs:schema>'])
def test_faulty_schemas(bad):
    from treeline.operators import schema

    with pytest.raises(schema.SchemaError):
        held = schema.Schema(bad)
        held.errors("<a/>")


def test_the_command_line(spark, small, capsys, tmp_path):
    from treeline.__main__ import main

    assert main(["--list"]) == 0 and "f01_stacked_predicates" in capsys.readouterr().out
    assert main(["a09_pass_fail", "--sql"]) == 0 and "SELECT" in capsys.readouterr().out
    assert main(["nosuch", small]) == 2 and main(["a09_pass_fail"]) == 2
    assert main(["a09_pass_fail", small, "--rows", "2"]) == 0 and "rate" in capsys.readouterr().out
    assert main(["a09_pass_fail", small, "--out", str(tmp_path / "out")]) == 0 and spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_a_sink_that_fails_leaves_nothing(spark, tmp_path):
    from treeline.sources import files

    w = files.LinesWriter({"folder": f"file://{tmp_path}/x"}, 0)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part").write_text("a")
    w.abort([files.Written("part", 1), None])
    assert list((tmp_path / "x").iterdir()) == []


def test_a_policy_and_a_server(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from treeline.sources import network

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response({"/gone": 404, "/away": 302}.get(self.path, 200))
            if self.path == "/away":
                self.send_header("Location", "http://localhost:1/other")
            self.end_headers()
            self.wfile.write(b"x" * (100 if self.path == "/long" else 3))

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        policy = network.Policy((base,), seconds=5, most=50)
        urls = [f"{base}/a", f"{base}/gone", f"{base}/long", f"{base}/away", f"{base}1/a", "file:///etc/passwd", f"{base}/../x", f"http://u@127.0.0.1:{server.server_port}/a", None]
        rows = spark.createDataFrame(list(enumerate(urls)), "k int, url string").select("k", network.fetched(F.col("url"), policy).alias("x")).orderBy("k").collect()
    finally:
        server.shutdown()
    got = [(r.x.status, r.x.body and bytes(r.x.body), r.x.error) for r in rows]
    assert got[:4] == [(200, b"xxx", None), (404, None, "status 404"), (200, None, "too large"), (None, None, "redirected to where it is not allowed")]
    assert [g[2] for g in got[4:8]] == ["not allowed"] * 4 and got[8] == (None, None, None)


def test_shell(spark):
    from treeline.operators.shell import Shell

    n = markup.xml_nodes(spark.createDataFrame([(1, "<a><b k='1'>x</b><b>y<!-- c --></b><c/></a>"), (2, "<z/>")], "doc_id long, text string"))
    s = Shell(n, 1)
    said = [s.run(x) for x in ("ls", "cd a", "ls", "cat b", "cat b/@k", "xpath b = 'y'", "grep y", "cd b", "cd b[2]", "pwd", "ls", "cd ..", "cd /", "cd", "pwd", "xpath ///", "du")]
    assert said == ["a", "", "b\nb\nc", '<b k="1">x</b>\n<b>y<!-- c --></b>', "1", "true", "y", "b is several nodes", "", "/a/b", "#text\n#comment", "", "", "", "/", said[15], "a 1\n  b 2\n  c 1"] and said[15].startswith("error")


def test_node_sets_are_told_where_documents_are_parsed(spark):
    """As by a path over the node table, texts are dealt out but no row of theirs is shuffled, joined or written down."""
    import pytest

    from treeline.operators import c14n
    from treeline.plans.xpath import XPath
    from treeline.sources import markup

    texts = [
        '<o xmlns:u="urn:u" xmlns="urn:d" a="1" xml:lang="en"><c xmlns="" y="2" x="1">p&#13;<!-- d --><u:f k="1"/><c x="3"><d x="4"><![CDATA[q]]></d></c></c><u:f>r</u:f><?i t?></o>',
        "<c/>", "<a><b/></a>", '<c xmlns="urn:d"><c xmlns="" x="1"/></c>', "<u><c>t<u/></c></u>",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = markup.xml_nodes(df)
    for path in ("//c | //c//node() | //c/@x | //u:f", "/c", "//u:f", "//node()", "//c/text()", "//d | //c/@y"):
        got = c14n.canonicalize(df, path=path, namespaces={"u": "urn:u"})
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in text and text.count("Exchange") == 1
        want = c14n.canonicalize_nodes(n, XPath(n, namespaces={"u": "urn:u"}).select(path))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), path
    for path in ("//c[1]", "//c/..", "c", "//*"):
        with pytest.raises(ValueError):
            c14n.canonicalize(df, path=path)
    bad = spark.createDataFrame([(1, "<c>"), (2, None)], "doc_id long, text string")
    assert {r.canonical for r in c14n.canonicalize(bad, path="//c").collect()} == {None}
