"""Queries over whole documents, files and tools."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from treeline.nodetable import ORDER_TREE_SQL, order_tree, whole_order_tree
from treeline.operators import c14n, documents, graph, toolbox
from treeline.operators import nodes as ops
from treeline.plans.xpath import XPath
from treeline.registry import registry
from treeline.session import table
from treeline.sources import markup
from treeline.sources.files import LinesSource

WITH = f"WITH {ORDER_TREE_SQL}"


@registry.add("k06_canonical", "SELECT o_orderkey AS doc_id, '<o a=\"' || o_orderstatus || '\" b=\"' || o_orderkey || '\"><e></e>' || o_orderpriority || '</o>' AS canonical FROM orders")
def k06_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical XML: sorted attributes, no comments, no empty-element tags."""
    o = table(spark, sf_dir, "orders")
    text = F.format_string("<?xml version='1.0'?><o  b='%s' a='%s'><!-- c --><e/>%s</o>", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return c14n.canonicalize(o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))


@registry.add("j11_xinclude", "SELECT * FROM (VALUES ('plain', '<r>a<x>in</x>b</r>'), ('text', '<r>some text</r>'), ('fallback', '<r>none<f /></r>'), ('loop', 'loop.xml includes itself'), ('missing', 'gone is missing')) v(name, result)")
def j11_xinclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusion with text, fallbacks, loops and missing targets."""
    ns = 'xmlns:xi="http://www.w3.org/2001/XInclude"'
    library = {
        "x.xml": "<x>in</x>", "t.txt": "some text", "plain": f'<r {ns}>a<xi:include href="x.xml"/>b</r>', "text": f'<r {ns}><xi:include href="t.txt" parse="text"/></r>',
        "fallback": f'<r {ns}><xi:include href="gone"><xi:fallback>none<f/></xi:fallback></xi:include></r>', "loop": f'<r {ns}><xi:include href="loop.xml"/></r>', "loop.xml": f'<r {ns}><xi:include href="loop.xml"/></r>', "missing": f'<r {ns}><xi:include href="gone"/></r>',
    }
    from xml.etree import ElementTree

    def one(name: str) -> str:
        try:
            return ElementTree.tostring(documents.include(name, library), encoding="unicode")
        except documents.IncludeError as e:
            return str(e)

    @pandas_udf("string")
    def expand(names: pd.Series) -> pd.Series:
        return names.map(one)

    return spark.createDataFrame([("plain",), ("text",), ("fallback",), ("loop",), ("missing",)], "name string").withColumn("result", expand("name"))


GRAMMAR = documents.Grammar(
    ("element", "order", ("group", ("attribute", "status", ("choice", ("value", "F"), ("value", "O"))), ("group", ("optional", ("attribute", "priority", ("text",))), ("many", ("ref", "line"))))),
    {"line": ("element", "lineitem", ("group", ("attribute", "flag", ("data", "[AN]")), ("group", ("attribute", "part", ("data", "[0-9]+")), ("data", "[0-9]+"))))},
)


@registry.add("v06_grammar", "SELECT (o_orderkey + 1) * 1024 AS doc_id, o_orderstatus IN ('F', 'O') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS valid FROM orders")
def v06_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serialised orders against a grammar of elements, attributes, choices and references that some orders break."""
    xml = ops.serialize(whole_order_tree(spark, sf_dir), F.col("name") == "order")
    return documents.validate(xml.select(F.col("pre").alias("doc_id"), F.col("xml").alias("text")), GRAMMAR)


@registry.add("v05_grammar_cases", "SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, true), (5, false), (6, true), (7, false)) v(doc_id, valid)")
def v05_grammar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaving, options, missing attributes, wrong data."""
    g = documents.Grammar(("element", "a", ("interleave", ("element", "x", ("empty",)), ("group", ("element", "y", ("data", "[0-9]+")), ("optional", ("element", "z", ("text",)))))))
    cases = ["<a><x/><y>1</y></a>", "<a><y>1</y></a>", "<a><x/><y>no</y></a>", "<a><y>2</y><x/><z>t</z></a>", "<a><x/><z/><y>1</y></a>", "<a><y>1</y><z/><x/></a>", "<a><x/><y>1</y>text</a>"]
    return documents.validate(spark.createDataFrame(list(enumerate(cases, start=1)), "doc_id long, text string"), g).select(F.col("doc_id").cast("int").alias("doc_id"), "valid")


@registry.add("f11_determinism", "SELECT * FROM (VALUES ('ab|ac', false), ('a(b|c)', true), ('a*b', true), ('empty step', false)) v(name, deterministic)")
def f11_determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether automata know at each token where to go."""
    cases = {"ab|ac": [(0, "a", 1), (0, "a", 2), (1, "b", 3), (2, "c", 3)], "a(b|c)": [(0, "a", 1), (1, "b", 2), (1, "c", 2)], "a*b": [(0, "a", 0), (0, "b", 1)], "empty step": [(0, None, 1), (0, "a", 2), (1, "a", 3)]}
    return spark.createDataFrame([(k, documents.deterministic(v, 0)) for k, v in cases.items()], "name string, deterministic boolean")


@registry.add("s05_fragment", "SELECT * FROM (VALUES ('b', 'x'), ('c', '')) v(name, value)")
def s05_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A balanced fragment parsed below a node: its own root is taken off."""
    n = markup.xml_nodes(spark.createDataFrame([(1, "<wrap><b>x</b>tail<c/></wrap>")], "doc_id long, text string"))
    return n.where("kind = 'element' and level = 2").select("name", "value")


@registry.add("s17_plug_in_source", "SELECT * FROM (VALUES (0, 1, 'a'), (0, 2, 'b'), (1, 1, 'c')) v(doc, line, text)")
def s17_plug_in_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data source of our own (also K07, S18: nothing else is opened)."""
    spark.dataSource.register(LinesSource)
    return spark.read.format("lines").option("texts", '["a\\nb", "c"]').load()


@registry.add("s07_dtd", "SELECT * FROM (VALUES ('element', 'a', '(b,c*)'), ('element', 'b', '(#PCDATA)'), ('attlist', 'a', 'id ID #REQUIRED'), ('entity', 'co', 'Company')) v(kind, name, content)")
def s07_dtd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of a DTD."""
    dtd = "<!ELEMENT a (b,c*)><!-- note --><!ELEMENT b (#PCDATA)>\n<!ATTLIST a id ID #REQUIRED><!ENTITY co \"Company\">"
    rows = spark.createDataFrame([(dtd,)], "text string")
    found = F.explode(F.regexp_extract_all(F.regexp_replace("text", r"(?s)<!--.*?-->", ""), F.lit(r"<!((?:ELEMENT|ATTLIST|ENTITY)[^>]*)>"), F.lit(1))).alias("d")
    part = lambda k: F.regexp_extract("d", r'^(\w+)\s+(\S+)\s+"?(.*?)"?$', k)
    return rows.select(found).select(F.lower(part(1)).alias("kind"), part(2).alias("name"), part(3).alias("content"))


@registry.add("n16_xpointer", "SELECT * FROM (VALUES ('/1/2', 'second'), ('element(c1/1)', 'first'), ('xpointer(//p[2])', 'second'), ('xpath1(//none)xpointer(//p[1])', 'first')) v(pointer, value)")
def n16_xpointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointer schemes, left to right; the first that finds something counts."""
    n = markup.xml_nodes(spark.createDataFrame([(1, "<r id='c1'><p>first</p><p>second</p></r>")], "doc_id long, text string"))
    out = None
    for pointer, parts in (("/1/2", ["/*[1]/*[2]"]), ("element(c1/1)", ["id('c1')/*[1]"]), ("xpointer(//p[2])", ["//p[2]"]), ("xpath1(//none)xpointer(//p[1])", ["//none", "//p[1]"])):
        ranked = None
        for k, p in enumerate(parts):
            one = XPath(n).select(p).select("value", F.lit(k).alias("k"))
            ranked = one if ranked is None else ranked.unionByName(one)
        row = ranked.agg(F.min_by("value", "k").alias("value")).select(F.lit(pointer).alias("pointer"), "value")
        out = row if out is None else out.unionByName(row)
    return out


@registry.add("x15_lang", "SELECT doc_id FROM documents WHERE lower(lang) = 'en' OR lower(lang) LIKE 'en-%'")
def x15_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``//p[lang('EN')]``: the language of the documents, said on their root."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('<d lang="en" xml:lang="'), ops.escape_attribute(F.coalesce("lang", F.lit(""))), F.lit('"><q><p/></q></d>')).alias("text"))
    return XPath(markup.xml_nodes(d)).select("//p[lang('EN')]").select("doc_id")


@registry.add("n11_namespaces", "SELECT * FROM (VALUES ('a', 'urn:1'), ('b', 'urn:1'), ('c', 'urn:2')) v(name, ns)")
def n11_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with the namespace in scope, and a prefix bound when compiling."""
    n = markup.xml_nodes(spark.createDataFrame([(1, "<a xmlns='urn:1'><b/><x:c xmlns:x='urn:2'/></a>")], "doc_id long, text string"))
    x = XPath(n, namespaces={"p": "urn:1", "q": "urn:2"})
    return x.select("//p:* | //q:c").select("name", "ns")


@registry.add("m03_text_merge", "SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY g) AS runs FROM (SELECT l_orderkey, l_returnflag, min(rn) AS g FROM (SELECT *, rn - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY rn) AS island FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS rn FROM lineitem)) GROUP BY l_orderkey, l_returnflag, island) GROUP BY ALL")
def m03_text_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent equal pieces merged, as adjacent text nodes are."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    l = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w)).withColumn("old", F.lag("l_returnflag").over(w))  # noqa: E741
    firsts = l.where(~F.col("l_returnflag").eqNullSafe(F.col("old")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rn", "l_returnflag"))), lambda x: x["l_returnflag"])
    return firsts.groupBy("l_orderkey").agg(F.array_join(ordered, "").alias("runs"))


@registry.add("e01_tools", """SELECT * FROM (VALUES ('add', '{"a": 1, "b": 2}', '{"result": 3}'), ('add', '{"a": 1}', '{"details": ["missing argument b"], "error": "invalid arguments"}'), ('add', 'no json', NULL), ('half', '{"n": 0}', '{"details": ["ValueError"], "error": "n is zero"}'), ('none', '{}', '{"details": ["add", "half"], "error": "unknown tool none"}')) v(tool, args, result)""")
def e01_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools called by name with JSON; errors are values."""
    box = toolbox.Toolbox()

    @box.register
    def add(a: int, b: int) -> int:
        """The sum."""
        return a + b

    @box.register
    def half(n: int) -> int:
        """One over n."""
        if n == 0:
            raise ValueError("n is zero")
        return 1 // n

    rows = spark.createDataFrame([("add", '{"a": 1, "b": 2}'), ("add", '{"a": 1}'), ("add", "no json"), ("half", '{"n": 0}'), ("none", "{}")], "tool string, args string")
    result = box.column(F.col("tool"), F.col("args"))
    return rows.select("tool", "args", F.when(F.col("args") != "no json", result).alias("result"))


@registry.add("e06_variables", "SELECT doc_id, pre FROM (WITH " + ORDER_TREE_SQL + " SELECT t.doc_id, t.pre FROM tree t WHERE t.name = 'order' AND t.kind = 'element' AND (t.doc_id, t.pre) IN (SELECT doc_id, parent FROM tree WHERE name = 'status' AND value = 'P'))")
def e06_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression with a variable."""
    return XPath(order_tree(spark, sf_dir), variables={"wanted": "P"}).select("//order[@status = $wanted]").select("doc_id", "pre")


@registry.add("e12_tool_called", "SELECT * FROM (VALUES (1, true), (2, false)) v(id, called)")
def e12_tool_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, [("add", "{}"), ("half", "{}")]), (2, [])], "id int, calls array<struct<name string, args string>>")
    return rows.select("id", toolbox.tool_called(F.col("calls"), "half").alias("called"))


@registry.add("f21_blank_nodes", f"{WITH} SELECT kind, count_if(trim(value) = '') AS blank, count(*) AS n FROM tree GROUP BY ALL")
def f21_blank_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_tree(spark, sf_dir).groupBy("kind").agg(F.count_if(F.trim("value") == "").alias("blank"), F.count(F.lit(1)).alias("n"))


@registry.add("o05_sub_order", "SELECT * FROM (VALUES ('d', 0), ('b', 1), ('c', 1), ('a', 2)) v(node, depth)")
def o05_sub_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of what one symbol needs."""
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("z", "a")], "src string, dst string")
    needed = graph.closure(edges).where("src = 'a'").select(F.col("dst").alias("node")).unionByName(spark.createDataFrame([("a",)], "node string"))
    inner = edges.join(needed.withColumnRenamed("node", "src"), "src", "left_semi")
    return graph.layers(needed, inner)


@registry.add("k08_csv", "SELECT s_suppkey::VARCHAR || ',' || replace(s_name, ',', ';') || ',' || s_nationkey AS line FROM supplier")
def k08_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as CSV lines."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.to_csv(F.struct(F.col("s_suppkey"), F.replace("s_name", F.lit(","), F.lit(";")).alias("s_name"), F.col("s_nationkey"))).alias("line"))


@registry.add("k11_json_lines", "SELECT conv_id, turn, json_extract_string(j, '$.role') AS role, json_extract_string(j, '$.text') AS text FROM (SELECT conv_id, turn, to_json({role: role, text: text}) AS j FROM conversations)")
def k11_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as JSON lines, read back."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("j"))
    return c.select("conv_id", "turn", F.get_json_object("j", "$.role").alias("role"), F.get_json_object("j", "$.text").alias("text"))


@registry.add("k13_explain", "SELECT true AS windowed, false AS cartesian, false AS python")
def k13_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the plan of ``//order[2]/following::lineitem`` is made of."""
    plan = XPath(order_tree(spark, sf_dir)).select("//order[2]/following::lineitem")._jdf.queryExecution().executedPlan().toString()
    return spark.createDataFrame([("Window" in plan, "CartesianProduct" in plan, "Python" in plan)], "windowed boolean, cartesian boolean, python boolean")
