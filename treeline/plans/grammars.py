"""Queries of RelaxNG grammars: schemas read and simplified, documents validated by derivatives, in pieces and from node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.nodetable import ORDER_TREE_SQL, order_tree, whole_order_tree
from treeline.operators import identity, relaxng
from treeline.registry import registry
from treeline.session import table

HEAD = f'xmlns="http://relaxng.org/ns/structure/1.0" datatypeLibrary="{relaxng.TYPES}"'

#: An order: attributes from two definitions, parts in any order, lines from another grammar whose flags are narrowed, a date from a third file, mixed notes.
ORDER_RNG = f"""<grammar {HEAD}>
  <include href="lines.rng"><define name="flag"><choice><value>A</value><value>N</value></choice></define></include>
  <start><element name="order"><ref name="attributes"/>
    <interleave><element name="total"><data type="decimal"><param name="maxInclusive">300000</param></data></element>
      <optional><externalRef href="due.rng"/></optional><zeroOrMore><ref name="line"/></zeroOrMore></interleave>
    <optional><ref name="note"/></optional></element></start>
  <define name="attributes" combine="interleave"><attribute name="status"><choice><value>F</value><value>O</value></choice></attribute></define>
  <define name="attributes" combine="interleave"><optional><attribute name="id"><data type="int"/></attribute></optional></define>
  <define name="note"><element name="note"><mixed><zeroOrMore><element name="b"><text/></element></zeroOrMore></mixed></element></define>
</grammar>"""
LIBRARY = {
    "lines.rng": f'<grammar {HEAD}><define name="flag"><text/></define><div><define name="line"><element name="line"><attribute name="flag"><ref name="flag"/></attribute><list><oneOrMore><data type="byte"/></oneOrMore></list></element></define></div></grammar>',
    "due.rng": f'<element name="due" {HEAD}><data type="date"/></element>',
    "loop.rng": f'<externalRef href="loop.rng" {HEAD}/>',
}


def some(condition: Column, text: str | Column) -> Column:
    return F.when(condition, F.lit(text) if isinstance(text, str) else text).otherwise("")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts: parts in two orders, some twice, missing or out of bounds."""
    k = F.col("o_orderkey")
    total = some(k % 11 != 0, F.concat(F.lit("<total>"), F.col("o_totalprice").cast("decimal(12,2)").cast("string"), F.lit("</total>\n")))
    day = F.concat(F.lit("<due>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</due>"))
    due = F.concat(some(k % 3 == 1, day), some(k % 9 == 4, " <due>2024-01-01</due>"))
    line = F.concat(F.repeat(F.lit('<line flag="A"> 7 -8 </line>'), (k % 4).cast("int")), some(k % 7 == 0, '<line flag="R">1</line>'))
    body = F.when(k % 2 == 0, F.concat(total, due, line)).otherwise(F.concat(line, due, total))
    note = some(k % 5 == 0, "<note>see <b>this</b> now</note>")
    text = F.concat(F.lit('<order id="'), k.cast("string"), F.lit('" status="'), F.col("o_orderstatus"), F.lit('">'), body, note, F.lit("</order>"))
    return table(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text"))


PARTS = {
    "total": "WHEN o_orderkey % 11 <> 0 AND round(o_totalprice, 2) > 300000 THEN 'text of total is not allowed'",
    "due": "WHEN o_orderkey % 9 = 4 THEN 'element due is not allowed in order'",
    "line": "WHEN o_orderkey % 7 = 0 THEN 'attribute flag of line is not allowed'",
}
ERROR_SQL = f"""CASE WHEN o_orderstatus = 'P' THEN 'attribute status of order is not allowed'
  WHEN o_orderkey % 2 = 0 THEN CASE {PARTS['total']} {PARTS['due']} {PARTS['line']} WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'element note is not allowed in order' ELSE 'content of order is incomplete' END END
  ELSE CASE {PARTS['line']} {PARTS['due']} {PARTS['total']} WHEN o_orderkey % 11 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'element note is not allowed in order' ELSE 'content of order is incomplete' END END END"""
ORDERS_SQL = f"SELECT o_orderkey AS doc_id, {ERROR_SQL} IS NULL AS valid, {ERROR_SQL} AS error FROM orders"


@registry.add("v05_relaxng", ORDERS_SQL)
def v05_relaxng(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a grammar read from its XML form: inclusion with an override, combined definitions, interleaving, lists, mixed content."""
    return relaxng.validate(orders(spark, sf_dir), ORDER_RNG, LIBRARY)


@registry.add("v07_stream", ORDERS_SQL)
def v07_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with texts fed five characters at a time: only a pattern and the open elements are held."""
    return relaxng.validate(orders(spark, sf_dir), ORDER_RNG, LIBRARY, chunk=5)


TREE_RNG = f"""<element name="customer" {HEAD}><attribute name="segment"/><attribute name="nation"><data type="unsignedByte"/></attribute>
  <zeroOrMore><element name="order"><attribute name="status"><choice><value>F</value><value>O</value></choice></attribute>
    <attribute name="priority"><data type="token"><param name="pattern">[1-5]-.*</param></data></attribute>
    <zeroOrMore><element name="lineitem"><attribute name="flag"><data type="token"><except><value>R</value></except></data></attribute>
      <oneOrMore><attribute><anyName><except><name>flag</name></except></anyName></attribute></oneOrMore>
      <data type="positiveInteger"/></element></zeroOrMore></element></zeroOrMore></element>"""


@registry.add("v07_nodes", f"""WITH {ORDER_TREE_SQL}, bad AS (
  SELECT doc_id, pre, 'attribute status of order is not allowed' AS error FROM tree WHERE kind = 'attr' AND name = 'status' AND value = 'P'
  UNION ALL SELECT doc_id, pre, 'attribute flag of lineitem is not allowed' FROM tree WHERE kind = 'attr' AND name = 'flag' AND value = 'R')
SELECT c_custkey AS doc_id, error IS NULL AS valid, error FROM customer LEFT JOIN (SELECT doc_id, arg_min(error, pre) AS error FROM bad GROUP BY doc_id) ON doc_id = c_custkey""")
def v07_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' trees validated row by row from the node table, without texts."""
    return relaxng.validate_nodes(whole_order_tree(spark, sf_dir), TREE_RNG)


def schema(body: str) -> str:
    return f"<grammar {HEAD}>{body}</grammar>"


#: Schemas by what is wrong with them.
SCHEMAS = [
    (schema('<start><ref name="a"/></start><define name="a"><element name="a"><optional><ref name="a"/></optional></element></define>'), 1, None),
    (schema('<start><ref name="a"/></start><define name="a"><choice><ref name="b"/><empty/></choice></define><define name="b"><ref name="a"/></define>'), None, "a refers to itself"),
    (schema('<start><ref name="gone"/></start>'), None, "gone is not defined"),
    (schema('<start><element name="a"><empty/></element></start><start><element name="b"><empty/></element></start>'), None, "start is defined twice"),
    (schema('<start combine="choice"><element name="a"><empty/></element></start><start combine="choice"><element name="b"><text/></element></start>'), 2, None),
    ('<element name="a" ' + HEAD + '><attribute name="x"/><attribute name="x"/></element>', None, "an attribute twice"),
    ('<element name="a" ' + HEAD + '><data type="int"/><element name="b"><empty/></element></element>', None, "data beside data, text or elements"),
    ('<element name="a" ' + HEAD + '><interleave><text/><mixed><element name="b"><empty/></element></mixed></interleave></element>', None, "interleaved patterns that are not told apart"),
    ('<element name="a" ' + HEAD + '><attribute><anyName/></attribute></element>', None, "a class of attributes that is not repeated"),
    ('<externalRef href="loop.rng" ' + HEAD + "/>", None, "loop.rng includes itself"),
    ('<element name="a" ' + HEAD + '><list><element name="b"><empty/></element></list></element>', None, "element in a list"),
    (schema('<start><element name="a"><grammar><start><parentRef name="b"/></start></grammar></element></start><define name="b"><element name="b"><data type="date"/></element></define>'), 2, None),
    ('<element name="a" ' + HEAD + '><data type="nothing"/></element>', None, f"no type nothing in library {relaxng.TYPES}"),
    ('<element name="a" ' + HEAD + '><oneOrMore><group><attribute name="x"/><text/></group></oneOrMore></element>', None, "a repeated group with an attribute"),
    (schema('<include href="lines.rng"><define name="other"><text/></define></include>'), None, "lines.rng does not define other"),
    ("<text " + HEAD + "/>", None, "text at the start"),
]


@registry.add("v05_schemas", "SELECT p_partkey AS doc_id, n_elements, error FROM part JOIN (VALUES " + ", ".join(f"({k}, {n if n is not None else 'NULL'}, {repr(e) if e else 'NULL'})" for k, (_, n, e) in enumerate(SCHEMAS)) + f") v(k, n_elements, error) ON k = p_partkey % {len(SCHEMAS)}")
def v05_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas read and simplified, a text for each part: the number of element patterns, or the restriction that is broken."""
    text = F.element_at(F.array(*[F.lit(s) for s, _, _ in SCHEMAS]), (F.col("p_partkey") % len(SCHEMAS) + 1).cast("int"))
    got = relaxng.simplified(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")), LIBRARY)
    return got.groupBy("doc_id").agg((F.max("number") + 1).alias("n_elements"), F.max("error").alias("error"))


# ---- identity constraints -----------------------------------------------------------------------------------------

KEYS_XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="customer"><xs:complexType><xs:sequence>
  <xs:element name="order" maxOccurs="unbounded"><xs:complexType><xs:attribute name="id" type="xs:integer"/><xs:attribute name="after" type="xs:integer"/></xs:complexType>
    <xs:unique name="lines"><xs:selector xpath="lineitem"/><xs:field xpath="@part"/><xs:field xpath="@flag"/></xs:unique></xs:element></xs:sequence></xs:complexType>
  <xs:key name="orders"><xs:selector xpath="./order"/><xs:field xpath="@id"/></xs:key>
  <xs:keyref name="former" refer="orders"><xs:selector xpath=".//order"/><xs:field xpath="@after"/></xs:keyref></xs:element></xs:schema>"""

KEYS_SQL = """WITH o AS (SELECT o_custkey AS doc_id, (o_orderkey + 1) * 1024 AS pre, o_orderkey AS k, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_orderkey // 3 END AS id, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey // 6 END AS aft FROM orders),
l AS (SELECT l_orderkey, l_partkey, l_returnflag, (l_orderkey + 1) * 1024 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) * 16 AS pre FROM lineitem),
n AS (SELECT l.*, count(*) OVER (PARTITION BY l_orderkey, l_partkey % 5, l_returnflag) AS n FROM l)
SELECT doc_id, pre, 'orders' AS "constraint", 'field missing' AS fault FROM o WHERE id IS NULL
UNION ALL SELECT doc_id, pre, 'orders', 'duplicate' FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, id) AS n FROM o WHERE id IS NOT NULL) WHERE n > 1
UNION ALL SELECT doc_id, pre, 'former', 'no such key' FROM o WHERE aft IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o x WHERE x.doc_id = o.doc_id AND x.id = o.aft)
UNION ALL SELECT o_custkey, pre, 'lines', 'duplicate' FROM n JOIN orders ON l_orderkey = o_orderkey WHERE n > 1"""


@registry.add("v11_keys", KEYS_SQL)
def v11_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, references and uniqueness in customers' trees: orders with equal, missing and differently written numbers, references to orders of other customers, line items that repeat a part and flag."""
    tree = order_tree(spark, sf_dir)
    k = F.floor(F.col("pre") / 1024) - 1
    order = tree.where("kind = 'element' AND name = 'order'")
    attr = lambda place, name, value: order.withColumns({"parent": F.col("pre"), "pre": F.col("pre") + place, "end": F.col("pre") + place, "level": F.col("level") + 1, "kind": F.lit("attr"), "name": F.lit(name), "value": value})
    ids = attr(3, "id", F.concat(F.when(k % 2 == 0, "00").otherwise("+"), F.floor(k / 3).cast("string"))).where(F.floor(F.col("pre") / 1024) % 10 != 4)
    after = attr(4, "after", F.floor(k / 6).cast("string")).where(F.floor(F.col("pre") / 1024) % 4 == 2)
    parts = tree.withColumn("value", F.when((F.col("kind") == "attr") & (F.col("name") == "part"), (F.col("value").cast("long") % 5).cast("string")).otherwise(F.col("value")))
    return identity.violations(parts.unionByName(ids).unionByName(after), KEYS_XSD)
