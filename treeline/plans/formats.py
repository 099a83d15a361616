"""Queries over documents of many forms: DTDs, rules, catalogs, canonical form, HTML, edits, cursors, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.nodetable import ORDER, ORDER_TREE_SQL, order_tree
from treeline.operators import c14n, catalog, codec, documents, dtd, edits, output, schematron, shell
from treeline.operators import schema as xsd
from treeline.operators import nodes as ops
from treeline.plans.work import LINES_SQL, lines, orders_xml
from treeline.plans.xpath import XPath
from treeline.registry import registry
from treeline.session import table, written
from treeline.sources import files, markup, network
from treeline.streaming import streams

WITH = f"WITH {ORDER_TREE_SQL}"


def made(spark: SparkSession, sf_dir: str, form: str, *columns: str | Column) -> DataFrame:
    """``doc_id, text``: a text made of each order's columns."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.format_string(form, *columns).alias("text"))


# ---- DTDs ---------------------------------------------------------------------------------------------------------

ORDER_DTD = """
<!-- an order, its customer and its total -->
<!ENTITY % flags "(F|O)"> <!ENTITY % inline "#PCDATA | cust">
<!ELEMENT order (cust, total, note?)>
<!ATTLIST order id ID #REQUIRED status %flags; #REQUIRED kind CDATA "web">
<!ELEMENT cust EMPTY> <!ATTLIST cust ref IDREF #REQUIRED>
<!ELEMENT total (#PCDATA)> <!ELEMENT note (%inline;)*>
"""


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: every seventh has two totals, every eleventh a customer that isn't there, every thirteenth a note."""
    k = F.col("o_orderkey")
    return made(
        spark, sf_dir, '<order id="o%s" status="%s"><cust ref="%s"/><total>1</total>%s%s</order>', "o_orderkey", "o_orderstatus",
        F.when(k % 11 == 0, "x").otherwise(F.concat(F.lit("o"), k.cast("string"))), F.when(k % 7 == 0, "<total>2</total>").otherwise(""), F.when(k % 13 == 0, F.concat(F.lit('<note>see <cust ref="o'), k.cast("string"), F.lit('"/></note>'))).otherwise(""),
    )


BROKEN_SQL = """concat_ws('; ', CASE WHEN o_orderstatus = 'P' THEN 'value of attribute status of order is no ENUMERATION' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'content of order does not follow (cust,total,note?)' END, CASE WHEN o_orderkey % 11 = 0 THEN 'IDREF x has no ID' END)"""


@registry.add("v01_dtd", f"SELECT o_orderkey AS doc_id, {BROKEN_SQL} = '' AS valid, {BROKEN_SQL} AS errors, 1 AS n_added FROM orders")
def v01_dtd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a DTD: content, enumerations, identifiers, references, defaults."""
    got = dtd.validate(ordered(spark, sf_dir), ORDER_DTD, root="order")
    return got.select("doc_id", "valid", F.array_join("errors", "; ").alias("errors"), "n_added")


@registry.add("v03_stream_dtd", f"SELECT o_orderkey AS doc_id, {BROKEN_SQL} AS errors FROM orders")
def v03_stream_dtd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with documents fed five characters at a time; only open elements are held."""
    return dtd.validate(ordered(spark, sf_dir), ORDER_DTD, root="order", chunk=5).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@registry.add("v04_potential", "SELECT l_orderkey AS doc_id, CASE max(l_linestatus) WHEN 'O' THEN 'b,c' ELSE 'a' END AS next FROM lineitem GROUP BY ALL")
def v04_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may come next in ``(a, (b|c)*)`` before and after an ``a``: one lookup a state, joined to the rows by state."""
    model = dtd.content_model("(a, (b|c)*)")
    after = model.step(None, "a")
    states = spark.createDataFrame([("F", ",".join(model.potential())), ("O", ",".join(model.potential(after)))], "state string, next string")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_linestatus").alias("state"))
    return rows.join(F.broadcast(states), "state").select("doc_id", "next")


@registry.add("s07_declarations", "SELECT n_nationkey AS k, 'n' || n_nationkey AS name, CASE n_regionkey WHEN 0 THEN 'empty' WHEN 1 THEN 'any' WHEN 2 THEN 'mixed' ELSE 'children' END AS kind, n_regionkey <> 4 AS deterministic FROM nation")
def s07_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations made of rows and read back: kinds of content, and whether each name has one way to go."""
    body = F.element_at(F.array(*map(F.lit, ("EMPTY", "ANY", "(#PCDATA|x)*", "(x,(y|z)+)", "((x,y)|(x,z))"))), F.col("n_regionkey") + 1)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.format_string("<!-- %s --><!ELEMENT n%s %s>", "n_name", "n_nationkey", body).alias("text"))

    @F.pandas_udf("name string, kind string, deterministic boolean")
    def read(texts):
        import pandas as pd

        out = [next(iter(dtd.parse(t).elements.items())) for t in texts]
        return pd.DataFrame({"name": [n for n, _ in out], "kind": [m.kind for _, m in out], "deterministic": [m.deterministic() for _, m in out]})

    return rows.select(F.col("n_nationkey").alias("k"), read("text").alias("x")).select("k", "x.name", "x.kind", "x.deterministic")


# ---- rules --------------------------------------------------------------------------------------------------------

RULES = """<schema xmlns="http://purl.oclc.org/dsdl/schematron"><let name="least" value="40"/>
<phase id="quick"><active pattern="orders"/></phase>
<pattern id="orders">
  <rule context="order[@status = 'P']"><report test="true()">pending <value-of select="@priority"/></report></rule>
  <rule context="order"><let name="n" value="count(lineitem)"/><assert test="$n &lt; 6">too many: <value-of select="$n"/></assert>
    <report test="lineitem &gt; $least and @priority = '1-URGENT'">heavy</report></rule>
</pattern>
<pattern id="items"><rule context="lineitem"><assert test="@flag != 'R'"><name/> returned</assert></rule></pattern></schema>"""
FIRED_SQL = f"""o AS (SELECT o_custkey AS doc_id, (o_orderkey + 1) * {ORDER} AS pre, o_orderstatus AS s, o_orderpriority AS p, count(l_orderkey) AS n, max(l_quantity::INT) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
fired AS (
  SELECT doc_id, pre, 'orders' AS pattern, 'report' AS kind, 'pending ' || p AS message FROM o WHERE s = 'P'
  UNION ALL SELECT doc_id, pre, 'orders', 'assert', 'too many: ' || n FROM o WHERE s <> 'P' AND n >= 6
  UNION ALL SELECT doc_id, pre, 'orders', 'report', 'heavy' FROM o WHERE s <> 'P' AND q > 40 AND p = '1-URGENT')"""


@registry.add("v10_schematron", f"{WITH}, {FIRED_SQL} SELECT * FROM fired UNION ALL SELECT doc_id, parent, 'items', 'assert', 'lineitem returned' FROM tree WHERE kind = 'attr' AND name = 'flag' AND value = 'R'")
def v10_schematron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules read from a schema document, with variables and messages that hold values."""
    return schematron.report(order_tree(spark, sf_dir), schematron.read(RULES)).select("doc_id", "pre", "pattern", "kind", "message")


@registry.add("v09_phase", f"WITH {FIRED_SQL} SELECT * FROM fired")
def v09_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same schema in a phase that has one pattern only."""
    return schematron.report(order_tree(spark, sf_dir), schematron.read(RULES), "quick").select("doc_id", "pre", "pattern", "kind", "message")


# ---- catalogs -----------------------------------------------------------------------------------------------------

XMLNS = 'xmlns="urn:oasis:names:tc:entity:xmlns:xml:catalog"'
LIBRARY = {
    "main.xml": f'<catalog {XMLNS}><group xml:base="file:///web/"><rewriteURI uriStartString="http://" rewritePrefix=""/></group><rewriteURI uriStartString="http://www." rewritePrefix="file:///www/"/>'
    '<delegateURI uriStartString="https://m." catalog="mobile.xml"/><nextCatalog catalog="main.xml"/><nextCatalog catalog="next.xml"/></catalog>',
    "mobile.xml": f'<catalog {XMLNS}><uriSuffix uriSuffix="1" uri="file:///one"/><uriSuffix uriSuffix="11" uri="file:///eleven"/></catalog>',
    "next.xml": f'<catalog {XMLNS}><rewriteURI uriStartString="https://" rewritePrefix="file:///secure/"/></catalog>',
    "text.cat": 'OVERRIDE YES\nPUBLIC "-//X//1-URGENT//EN" "urgent.dtd" -- a note --\nDELEGATE "-//X//2" "two.cat"\nSYSTEM "sys:O" "open.dtd"\nOVERRIDE NO\nPUBLIC "-//X//5-LOW//EN" "low.dtd"',
    "two.cat": 'BASE "file:///two/"\nPUBLIC "-//X//2-HIGH//EN" "high.dtd"',
}


@registry.add("j10_catalog_files", """SELECT page_id, CASE WHEN starts_with(url, 'http://www.') THEN 'file:///www/' || substr(url, 12) WHEN starts_with(url, 'http://') THEN 'file:///web/' || substr(url, 8)
WHEN starts_with(url, 'https://m.') THEN CASE WHEN ends_with(url, '11') THEN 'file:///eleven' WHEN ends_with(url, '1') THEN 'file:///one' END WHEN starts_with(url, 'https://') THEN 'file:///secure/' || substr(url, 9) END AS resolved FROM pages""")
def j10_catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URIs by catalogs: longest prefix, longest suffix, delegates that are asked alone, next catalogs, a catalog that names itself."""
    return table(spark, sf_dir, "pages").select("page_id", catalog.resolved_uri(LIBRARY, "main.xml", F.col("url")).alias("resolved"))


@registry.add("s27_text_catalog", """SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'O' THEN 'open.dtd' WHEN o_orderpriority = '1-URGENT' THEN 'urgent.dtd' WHEN o_orderpriority = '2-HIGH' THEN 'file:///two/high.dtd'
WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'low.dtd' END AS resolved FROM orders""")
def s27_text_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public and system identifiers by a catalog in the older text form; entries under OVERRIDE NO hold only without a system identifier."""
    public = F.concat(F.lit("-//X//"), "o_orderpriority", F.lit("//EN  "))
    system = F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("sys:"), "o_orderstatus"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), catalog.resolved(LIBRARY, "text.cat", public, system).alias("resolved"))


@registry.add("m06_catalog_edits", "SELECT n_name AS key, CASE WHEN n_regionkey = 1 THEN 'file:///again/' ELSE 'file:///' END || n_nationkey AS value FROM nation WHERE n_regionkey <> 2")
def m06_catalog_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries added, changed and removed by value; the nations are the entries."""
    n = table(spark, sf_dir, "nation").select(F.lit("uri").alias("kind"), F.col("n_name").alias("key"), F.concat(F.lit("file:///"), F.col("n_nationkey").cast("string")).alias("value"), "n_regionkey", "n_nationkey")
    again = n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("seq"), F.lit("add").alias("op"), "kind", "key", F.concat(F.lit("file:///again/"), F.col("n_nationkey").cast("string")).alias("value"))
    gone = n.where("n_regionkey = 2").select(F.col("n_nationkey").alias("seq"), F.lit("remove").alias("op"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("key"), "value")
    return catalog.edited(n.select("kind", "key", "value"), again.unionByName(gone)).select("key", "value")


@registry.add("m06_edits_of_orders", """WITH e AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY ALL)
SELECT 'c' || e.o_custkey AS key, 'v' || k % 50 AS value FROM e WHERE NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_orderkey % 7 = 0 AND r.o_orderkey > e.k AND r.o_orderkey % 50 = e.k % 50) AND NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_orderkey % 77 = 0 AND r.o_orderkey > e.k AND r.o_custkey = e.o_custkey)""")
def m06_edits_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order edits a catalog: its customer's entry is set, or all entries of a value or of the customer go."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    key, value = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("v"), (k % 50).cast("string"))
    added = o.where(k % 7 != 0).select(k.alias("seq"), F.lit("add").alias("op"), F.lit("uri").alias("kind"), key.alias("key"), value.alias("value"))
    none = F.lit(None).cast("string")
    gone = lambda rows, what: rows.select(k.alias("seq"), F.lit("remove").alias("op"), none.alias("kind"), none.alias("key"), what.alias("value"))
    edits = added.unionByName(gone(o.where(k % 7 == 0), value)).unionByName(gone(o.where(k % 77 == 0), key))
    return catalog.edited(added.limit(0).select("kind", "key", "value"), edits).select("key", "value")


# ---- canonical form -----------------------------------------------------------------------------------------------

NAMESPACED = '<?xml version="1.0"?><!-- c --><o  xmlns:u="urn:u" xmlns:b="urn:b" xmlns="urn:d" z="1" b:a="%s" xml:lang="en"><b:e xmlns:b="urn:b"/><c xmlns="" y="2" x="1">%s&#13;<!-- d --><u:f/></c></o><?end it?>'


def namespaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, NAMESPACED, "o_orderstatus", "o_orderpriority")


@registry.add("k06_inclusive", """SELECT o_orderkey AS doc_id, '<!-- c -->' || chr(10) || '<o xmlns="urn:d" xmlns:b="urn:b" xmlns:u="urn:u" z="1" xml:lang="en" b:a="' || o_orderstatus || '"><b:e></b:e><c xmlns="" x="1" y="2">' || o_orderpriority || '&#xD;<!-- d --><u:f></u:f></c></o>' || chr(10) || '<?end it?>' AS canonical FROM orders""")
def k06_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical XML 1.0 with comments: namespaces once where they begin, sorted attributes, character references."""
    return c14n.canonicalize(namespaced(spark, sf_dir), comments=True)


@registry.add("k06_exclusive", """SELECT o_orderkey AS doc_id, '<o xmlns="urn:d" xmlns:b="urn:b" z="1" xml:lang="en" b:a="' || o_orderstatus || '"><b:e></b:e><c xmlns="" x="1" y="2">' || o_orderpriority || '&#xD;<u:f xmlns:u="urn:u"></u:f></c></o>' || chr(10) || '<?end it?>' AS canonical FROM orders""")
def k06_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive form: namespaces where they are used."""
    return c14n.canonicalize(namespaced(spark, sf_dir), exclusive=True)


@registry.add("k06_node_set", """SELECT o_orderkey AS doc_id, '<c xmlns:b="urn:b" xmlns:u="urn:u" x="1" xml:lang="en">' || o_orderpriority || '&#xD;<u:f></u:f></c>' AS canonical FROM orders""")
def k06_node_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node-set: the subtree of c without the attribute y; what is in scope above it is said on it."""
    return c14n.canonicalize(namespaced(spark, sf_dir), path="//c | //c//node() | //c/@x | //u:f", namespaces={"u": "urn:u"})


# ---- HTML, outlines, inner text -----------------------------------------------------------------------------------

HTML = '<div id="p%s" class="a &quot;b&quot;"><br><input disabled="" value="%s &amp; co"><p>%s &lt; <b>x</b></p><script>if (a < b && c) go("%s")</script><a href="x y">z</a></div>'


@registry.add("k02_html", "SELECT p_partkey AS doc_id, printf('<div id=\"p%s\" class=\"a &quot;b&quot;\"><br><input disabled value=\"%s &amp; co\"><p>%s &lt; <b>x</b></p><script>if (a < b && c) go(\"%s\")</script><a href=\"x%%20y\">z</a></div>', p_partkey::VARCHAR, p_brand, p_name, p_type) AS html FROM part")
def k02_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML text: elements without content, attributes without value, scripts as they are, escaped links."""
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.format_string(HTML, "p_partkey", "p_brand", "p_name", "p_type").alias("html"))
    return output.serialize_html(markup.html_nodes(pages), F.col("name") == "div", whole=True).select("doc_id", "html")


@registry.add("k12_dump", f"""SELECT o_custkey AS doc_id, 'Object is a Node Set :' || chr(10) || 'Set contains ' || count(*) || ' nodes:' || chr(10) || string_agg(line, '' ORDER BY o_orderkey) AS dump FROM (
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) || '  ELEMENT order' || chr(10) || '    ATTRIBUTE status' || chr(10) || '      TEXT' || chr(10) || '        content=' || o_orderstatus || chr(10)
  || '    ATTRIBUTE priority' || chr(10) || '      TEXT' || chr(10) || '        content=' || o_orderpriority || chr(10) AS line FROM orders) GROUP BY ALL""")
def k12_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders in the outline that path tests print."""
    t = order_tree(spark, sf_dir)
    return output.dump(XPath(t).select("//order"), t)


@registry.add("n21_inner_xml", """SELECT o_orderkey AS doc_id, '<p>' || o_orderpriority || ' &amp; co</p><!-- c --><t>' AS head FROM orders""")
def n21_inner_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies inside each order's element."""
    xml = ops.serialize(markup.xml_nodes(orders_xml(spark, sf_dir)), F.col("name") == "o", whole=True)
    return xml.select("doc_id", F.regexp_extract(output.inner_xml(F.col("xml")), r"\A(.*<t>)[^<]*</t>\z", 1).alias("head"))


@registry.add("n22_namespaces", "SELECT o_orderkey AS doc_id, name, n FROM orders, (VALUES ('o', 'b,d,u'), ('e', 'b,d,u'), ('c', 'b,u'), ('f', 'b,u')) v(name, n)")
def n22_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces in scope of each element, by the axis: inherited, undone, said again."""
    n = written(markup.xml_nodes(namespaced(spark, sf_dir)))
    x, out = XPath(n), None
    for name in ("o", "e", "c", "f"):
        held = x.select(f"//*[local-name() = '{name}']/namespace::*").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.substring("value", -1, 1))), ",").alias("n"))
        row = held.select("doc_id", F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@registry.add("n25_lines", "SELECT o_orderkey AS doc_id, name, line + (o_orderkey % 5) * times AS line FROM orders, (VALUES ('o', 1, 0), ('p', 2, 1), ('q', 2, 2)) v(name, line, times)")
def n25_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line on which each element begins."""
    gap = F.repeat(F.lit("\n"), (F.col("o_orderkey") % 5).cast("int"))
    n = markup.xml_nodes(made(spark, sf_dir, "<o>\n%s<p>%s%s</p><q/></o>", gap, "o_orderpriority", gap))
    return n.where("kind = 'element'").select("doc_id", "name", F.col("line").cast("long").alias("line"))


# ---- cursors and streaming patterns -------------------------------------------------------------------------------


@registry.add("s19_cursor", "SELECT o_orderkey AS doc_id, seq, type, depth, name, attributes FROM orders, (VALUES (0, 1, 0, 'o', 2), (1, 1, 1, 'p', 0), (2, 3, 2, '#text', 0), (3, 15, 1, 'p', 0), (4, 8, 1, '#comment', 0), (5, 1, 1, 't', 0), (6, 3, 2, '#text', 0), (7, 15, 1, 't', 0), (8, 15, 0, 'o', 2)) v(seq, type, depth, name, attributes)")
def s19_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stops of a pull reader over each document."""
    return markup.cursor(orders_xml(spark, sf_dir)).select("doc_id", "seq", "type", "depth", "name", "attributes")


@registry.add("f06_stream_pattern", "SELECT o_orderkey AS doc_id, element, name FROM orders, (VALUES (0, '@id'), (1, 'p'), (2, 't')) v(element, name)")
def f06_stream_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns matched as documents go by in pieces; only the names of open elements are held."""
    return markup.stream_matches(orders_xml(spark, sf_dir), "o/@id | /o/p | //t | t/p | /p", chunk=7)


# ---- edits --------------------------------------------------------------------------------------------------------


@registry.add("m01_edits", "SELECT o_orderkey AS doc_id, '<o s=\"' || o_orderstatus || '\" id=\"n' || o_orderkey || '\"><first/><q>' || lower(o_orderpriority) || '</q><new>' || o_orderpriority || '</new><t k=\"v\"/><!-- end --></o>' AS xml FROM orders")
def m01_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes unlinked, replaced, put before, behind, first and last, attributes set and added."""
    n = markup.xml_nodes(made(spark, sf_dir, '<o s="%s" id="%s"><p>%s</p><!-- c --><t><u>x</u></t></o>', "o_orderstatus", "o_orderkey", "o_orderpriority"))
    name = F.col("name")
    n = edits.unlink(n, (F.col("kind") == "comment") | (name == "u"))
    n = edits.inserted(n, name == "p", "after", "element", "new", F.col("value"))
    n = edits.replaced(n, name == "p", "element", "q", F.lower("value"))
    n = edits.inserted(n, name == "o", "first", "element", "first")
    n = edits.inserted(n, name == "o", "last", "comment", None, F.lit(" end "))
    n = edits.with_attribute(n, name == "t", "k", F.lit("v"))
    ids = F.max(F.when((F.col("kind") == "attr") & (name == "id"), F.col("value"))).over(Window.partitionBy("doc_id"))
    n = edits.with_attribute(n.withColumn("ids", ids), (name == "o") & F.col("ids").isNotNull(), "id", F.concat(F.lit("n"), "ids"))
    return ops.serialize(n, F.col("name") == "o").select("doc_id", "xml")


@registry.add("m02_unlink_orders", f"{WITH} SELECT doc_id, count(*) AS nodes, max(level) AS depth FROM tree t WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = doc_id AND o_orderstatus = 'F' AND pre BETWEEN (o_orderkey + 1) * {ORDER} AND (o_orderkey + 1) * {ORDER} + {ORDER - 1}) GROUP BY ALL")
def m02_unlink_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders unlinked from their customers; what is left is numbered without gaps, as its count shows."""
    t = order_tree(spark, sf_dir)
    left = edits.unlink(t, XPath(t).select("//order[@status = 'F']"), keep=False)
    return left.groupBy("doc_id").agg((F.max("pre") + 1).alias("nodes"), F.max("level").alias("depth"))


# ---- files, text, arithmetic --------------------------------------------------------------------------------------


@registry.add("a10_file_statistics", r"SELECT source, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(len(regexp_extract_all(text, '[^ \t\r\n]+')))::BIGINT AS words, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def a10_file_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, words and bytes by source."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.sum(F.regexp_count("text", F.lit(r"[^ \t\r\n]+"))).alias("words"), F.sum(F.octet_length("text")).alias("bytes"))


@registry.add("s26_config", "SELECT '/s/' || n_regionkey || '/' || n_nationkey AS folder, CASE WHEN n_nationkey % 3 = 0 THEN '/s/' || n_regionkey || '/' || n_nationkey || '/tool.yaml' WHEN n_regionkey % 2 = 0 THEN '/s/' || n_regionkey || '/tool.yaml' ELSE '/tool.yaml' END AS config FROM nation")
def s26_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest configuration file of each folder, upward."""
    n = table(spark, sf_dir, "nation")
    folder = F.format_string("/s/%s/%s", "n_regionkey", "n_nationkey")
    held = n.where("n_nationkey % 3 = 0").select(F.concat(folder, F.lit("/tool.yaml")).alias("path")).unionByName(n.where("n_regionkey % 2 = 0").select(F.format_string("/s/%s/tool.yaml", "n_regionkey").alias("path")).distinct())
    held = held.unionByName(spark.createDataFrame([("/tool.yaml",), ("/s/1/other.yaml",)], "path string"))
    return output.nearest_config(n.select(folder.alias("folder")), held, "tool.yaml")


@registry.add("s28_prompt", "SELECT n_name AS name, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE 'about <file name=\"region ' || n_regionkey || '\">' || chr(10) || 'in ' || r_name || CASE WHEN n_regionkey = 1 THEN ' <file name=\"end\">' || chr(10) || 'END' || chr(10) || '</file>' ELSE '' END || chr(10) || '</file>.' END AS text, CASE WHEN n_nationkey % 6 = 5 THEN 'nowhere is missing' END AS error FROM nation JOIN region ON r_regionkey = n_regionkey")
def s28_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with includes, some of which include others, some of which are missing."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    prompts = n.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 6 == 5, F.lit("{{include: nowhere}}")).otherwise(F.format_string("about {{include: region %s}}.", "n_regionkey")).alias("text"))
    library = r.select(F.format_string("region %s", "r_regionkey").alias("name"), F.concat(F.lit("in "), "r_name", F.when(F.col("r_regionkey") == 1, " {{include: end}}").otherwise("")).alias("text"))
    return output.expanded(prompts, library.unionByName(spark.createDataFrame([("end", "END")], "name string, text string")))


@registry.add("f24_containment", "SELECT p_partkey, p_size % 4 <> 3 AND p_size % 5 <> 4 AS inside FROM part")
def f24_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a path stays below a folder, whatever its dots say."""
    size = F.col("p_size")
    name = F.regexp_replace("p_name", " ", "/")
    path = F.when(size % 5 == 4, F.concat(F.lit("/srv/data-"), name)).when(size % 4 == 3, F.concat(F.lit("a/../../"), name)).when(size % 4 == 1, F.concat(F.lit("/srv/data/./x/../"), name)).otherwise(F.concat(F.lit("./b/../"), name))
    return table(spark, sf_dir, "part").select("p_partkey", output.within(F.lit("/srv/data/"), path).alias("inside"))


@registry.add("k10_yaml", "SELECT n_regionkey AS region, 'name: \"' || r_name || ': all\"' || chr(10) || 'kind: ' || CASE WHEN n_regionkey = 0 THEN '\"yes\"' ELSE 'region' END || chr(10) || 'members:' || chr(10) || string_agg('- ' || n_name || chr(10), '' ORDER BY n_name) AS yaml FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey, r_name")
def k10_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region with its nations as a YAML document."""
    r = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    g = r.groupBy(F.col("n_regionkey").alias("region"), "r_name").agg(F.array_sort(F.collect_list("n_name")).alias("members"))
    kind = F.when(F.col("region") == 0, "yes").otherwise("region")
    return g.select("region", output.yaml_block({"name": F.concat("r_name", F.lit(": all")), "kind": kind}, {"members": F.col("members")}).alias("yaml"))


@registry.add("t21_expressions", "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size % 7 = 0 THEN NULL ELSE (p_size + 2)::DOUBLE * 3 - p_size // 4 + 2 ** (p_size % 5) END AS value, CASE WHEN p_size % 10 = 0 THEN 'division by zero' WHEN p_size % 7 = 0 THEN 'not arithmetic' END AS error FROM part")
def t21_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic read from text; what is no arithmetic is an error, never run."""
    size = F.col("p_size")
    text = F.when(size % 10 == 0, F.format_string("1 / (%s - %s)", size, size)).when(size % 7 == 0, F.format_string("__import__('os').getpid() + %s", size)).otherwise(F.format_string("(%s + 2) * 3 - %s // 4 + 2 ** (%s %% 5)", size, size, size))
    return table(spark, sf_dir, "part").select("p_partkey", output.calculated(text).alias("x")).select("p_partkey", "x.value", "x.error")


@registry.add("c03_cheapest", f"WITH {LINES_SQL} SELECT doc_id, md5(s) AS restored, true AS no_dearer FROM lines")
def c03_cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parse of least cost, found by turns: what it expands to, and that it is no dearer than the greedy one."""
    from treeline.operators import lz

    return lz.parse(lines(spark, sf_dir)).select("doc_id", F.col("digest").alias("restored"), ((F.col("best_bits") <= F.col("bits")) & (F.col("split_bits") <= F.col("bits"))).alias("no_dearer"))


# ---- schemas, type libraries, output and encodings ----------------------------------------------------------------

ORDER_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
<xs:simpleType name="state"><xs:restriction base="xs:token"><xs:enumeration value="F"/><xs:enumeration value="O"/></xs:restriction></xs:simpleType>
<xs:complexType name="line"><xs:simpleContent><xs:extension base="xs:positiveInteger"><xs:attribute name="n" type="xs:byte" use="required"/></xs:extension></xs:simpleContent></xs:complexType>
<xs:element name="order"><xs:complexType>
  <xs:sequence><xs:element name="total"><xs:simpleType><xs:restriction base="xs:decimal"><xs:maxInclusive value="300000"/><xs:fractionDigits value="2"/></xs:restriction></xs:simpleType></xs:element>
    <xs:choice><xs:element name="due" type="xs:date"/><xs:element name="never"/></xs:choice><xs:element name="line" type="line" minOccurs="0" maxOccurs="2"/></xs:sequence>
  <xs:attribute name="status" type="state" use="required"/><xs:attribute name="id" type="xs:int"/></xs:complexType></xs:element></xs:schema>"""


@registry.add("v11_schema", """SELECT o_orderkey AS doc_id, concat_ws('; ', CASE WHEN o_orderstatus = 'P' THEN 'value of attribute status of order breaks enumeration' END, CASE WHEN o_orderkey % 4 = 3 THEN 'content of order does not fit' END,
CASE WHEN o_orderkey % 4 <> 3 AND o_totalprice > 300000 THEN 'value of total breaks maxInclusive' END, CASE WHEN o_orderkey % 4 <> 3 AND o_orderkey % 9 = 0 THEN 'value of due breaks date' END) AS errors FROM orders""")
def v11_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against an XML Schema: facets, dates, choices, occurrences, attributes."""
    k = F.col("o_orderkey")
    due = F.when(k % 9 == 0, "<due>2024-02-30</due>").when(k % 9 == 1, "<never/>").otherwise(F.concat(F.lit("<due>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</due>")))
    docs = made(spark, sf_dir, '<order status="%s" id="%s"><total>%s</total>%s%s</order>', "o_orderstatus", "o_orderkey", F.col("o_totalprice").cast("decimal(12,2)"), due, F.repeat(F.lit('<line n="1"> 7 </line>'), (k % 4).cast("int")))
    return xsd.validate(docs, ORDER_XSD).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@registry.add("v08_type_library", "SELECT o_orderkey AS doc_id, o_orderkey < 128 AND o_orderkey % 9 <> 0 AS valid FROM orders")
def v08_type_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grammar whose data are built-in types."""
    grammar = documents.Grammar(("element", "o", ("group", ("attribute", "k", ("type", "byte")), ("element", "d", ("type", "date")))))
    day = F.when(F.col("o_orderkey") % 9 == 0, "2023-02-29").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return documents.validate(made(spark, sf_dir, '<o k="%s"><d> %s </d></o>', "o_orderkey", day), grammar)


@registry.add("k07_output", "SELECT p_name AS line, count(*) AS n FROM part GROUP BY ALL")
def k07_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written by a data sink of our own, compressed, and read again."""
    spark.dataSource.register(files.LinesSource)
    folder = streams.shared_folder(spark, "lines")
    rows = table(spark, sf_dir, "part").select(F.lit(0).alias("doc"), F.lit(0).alias("line"), F.col("p_name").alias("text"))
    rows.write.format("lines").option("folder", folder).option("codec", "gzip").mode("append").save()
    return spark.read.option("pathGlobFilter", "*.gz").text(folder).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@registry.add("e10_encodings", "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_name END AS text, CASE p_partkey % 4 WHEN 2 THEN 'unknown encoding x-none' WHEN 3 THEN 'not utf-8' END AS error FROM part")
def e10_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes by the names of their encodings: one that Python knows, one that is registered, one that nobody knows, and one that doesn't hold."""
    k = F.col("p_partkey") % 4
    data = F.when(k == 0, F.encode("p_name", "UTF-16")).when(k == 1, F.encode(F.reverse("p_name"), "UTF-8")).when(k == 2, F.encode("p_name", "UTF-8")).otherwise(F.unhex(F.lit("C328")))
    name = F.element_at(F.array(*map(F.lit, ("utf-16", "X-Reversed", "x-none", "utf-8"))), (k + 1).cast("int"))
    got = files.decoded(data, name, {"x-reversed": lambda b: b.decode()[::-1]})
    return table(spark, sf_dir, "part").select("p_partkey", got.alias("x")).select("p_partkey", "x.text", "x.error")


# ---- policies, shells, interruption -------------------------------------------------------------------------------


@registry.add("s18_policy", "SELECT page_id, 'not allowed' AS error, false AS has_body FROM pages WHERE url IS NOT NULL")
def s18_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses under a policy that allows none: nothing is fetched, each says why."""
    got = table(spark, sf_dir, "pages").where("url is not null").select("page_id", network.fetched(F.col("url"), network.Policy()).alias("x"))
    return got.select("page_id", "x.error", F.col("x.body").isNotNull().alias("has_body"))


SCRIPT = ["pwd", "cd customer", "pwd", "xpath count(order)", "xpath order[1]/@status", "cd nosuch", "du order[1]", "nonsense"]


@registry.add("k14_shell", """WITH c AS (SELECT min(o_custkey) AS doc FROM orders), o AS (SELECT * FROM orders, c WHERE o_custkey = doc), f AS (SELECT * FROM o ORDER BY o_orderkey LIMIT 1), n AS (SELECT count(*) AS n FROM lineitem WHERE l_orderkey = (SELECT o_orderkey FROM f))
SELECT 0 AS step, '/' AS said UNION ALL SELECT 1, '' UNION ALL SELECT 2, '/customer' UNION ALL SELECT 3, (SELECT count(*)::VARCHAR FROM o) UNION ALL SELECT 4, (SELECT o_orderstatus FROM f) UNION ALL SELECT 5, 'nosuch is no node'
UNION ALL SELECT 6, '  order 1' || CASE WHEN n > 0 THEN chr(10) || '    lineitem ' || n ELSE '' END FROM n UNION ALL SELECT 7, 'unknown command nonsense'""")
def k14_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script of commands that walk the first customer's document."""
    doc = table(spark, sf_dir, "orders").agg(F.min("o_custkey")).first()[0]
    walk = shell.Shell(order_tree(spark, sf_dir), doc)
    return spark.createDataFrame([(k, walk.run(line)) for k, line in enumerate(SCRIPT)], "step int, said string")


@registry.add("r09_interrupt", "SELECT 'finished' AS work, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'stopped', NULL")
def r09_interrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that is asked again and again whether to stop: once it isn't, once it is."""
    orders = table(spark, sf_dir, "orders")
    rows = [("finished", shell.interruptible(spark, orders.count, lambda: False))]

    def slowly(batches):
        import time

        for b in batches:
            time.sleep(20)
            yield b

    try:
        rows.append(("not stopped", shell.interruptible(spark, orders.select("o_orderkey").mapInArrow(slowly, "o_orderkey long").count, lambda: True, 0.1)))
    except shell.Interrupted as e:
        rows.append((str(e), None))
    return spark.createDataFrame(rows, "work string, n long")


@registry.add("c07_smoothed", """SELECT p_partkey, CASE WHEN p_size >= 4 THEN array_to_string([p_size + 2, p_size + 2, p_size + 2, p_size + 2, 0, 0, 0, 900], ',')
ELSE array_to_string(list_concat(list_transform(range(7), lambda x: (4 * p_size + 9) // 7), [900]), ',') END AS smoothed FROM part""")
def c07_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts made alike where they nearly are: four that rise by one, three zeros, one far off."""
    size = F.col("p_size").cast("long")
    counts = F.array(size, size + 1, size + 2, size + 3, *[F.lit(n).cast("long") for n in (0, 0, 0, 900)])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(codec.smoothed(counts).cast("array<string>"), ",").alias("smoothed"))
