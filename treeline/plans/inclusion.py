"""Queries of inclusion, pointers, fragments and consistency of trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.nodetable import ORDER_TREE_SQL, whole_order_tree
from treeline.operators import consistency, xinclude, xpointer
from treeline.registry import registry
from treeline.session import table

XI = f'xmlns:xi="{xinclude.XI}"'


def include(href: Column, more: str = "/>") -> Column:
    return F.concat(F.lit(f'<xi:include {XI} href="'), href, F.lit(f'"{more}'))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, text``: nations as text, customers that include them, orders that include customers."""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    nations = n.select(F.format_string("nation/%s.txt", "n_nationkey").alias("name"), F.concat("n_name", F.lit(" & co")).alias("text"))
    inner = include(F.format_string("../nation/%s.txt", "c_nationkey"), ' parse="text"/>')
    customers = c.select(F.format_string("customer/%s.xml", "c_custkey").alias("name"), F.concat(F.format_string('<customer id="c%s"><name>%s</name>', "c_custkey", "c_name"), inner, F.lit("</customer>")).alias("text"))
    k, customer = F.col("o_orderkey"), F.format_string("../customer/%s.xml", "o_custkey")
    what = (
        F.when(k % 13 == 0, include(F.format_string("%s.xml", "o_orderkey"))).when(k % 11 == 0, include(F.lit("../customer/none.xml")))
        .when(k % 7 == 0, include(F.lit("../customer/none.xml"), "><xi:fallback>no <b/></xi:fallback></xi:include>"))
        .when(k % 5 == 0, F.concat(F.lit("<!-- twice -->"), include(customer, ' xpointer="element(/1/1)"/>'), include(F.lit(""), ' xpointer="total"/>'))).otherwise(include(customer))
    )
    orders = o.select(F.format_string("order/%s.xml", "o_orderkey").alias("name"), F.concat(F.lit("<order><n id='total'>"), F.col("o_orderstatus"), F.lit("</n>"), what, F.lit("</order>")).alias("text"))
    return nations.unionByName(customers).unionByName(orders)


@registry.add("j11_included", """
SELECT 'order/' || o_orderkey || '.xml' AS name,
  CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 THEN '<order><n id=''total''>' || o_orderstatus || '</n>' || CASE WHEN o_orderkey % 7 = 0 THEN 'no <b/>'
    WHEN o_orderkey % 5 = 0 THEN '<!-- twice --><name xml:base="customer/' || c_custkey || '.xml">' || c_name || '</name><n xml:base="order/' || o_orderkey || '.xml" id=''total''>' || o_orderstatus || '</n>'
    ELSE '<customer xml:base="customer/' || c_custkey || '.xml" id="c' || c_custkey || '"><name>' || c_name || '</name>' || n_name || ' &amp; co</customer>' END || '</order>' END AS text,
  CASE WHEN o_orderkey % 13 = 0 THEN 'order/' || o_orderkey || '.xml includes a loop' WHEN o_orderkey % 11 = 0 THEN 'customer/none.xml is missing' END AS error
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def j11_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers and these with their nations included, by joins: text, pointers, fallbacks, bases, loops, missing documents."""
    docs = library(spark, sf_dir)
    return xinclude.expand(docs, docs.where("startswith(name, 'order/')"))


POINTERS = ["/1/2", "element(o1/1)", "o1", "xpointer(//b)", "xmlns(p=urn:p)xpointer(/r/p:c)", "xpath1(//none)element(/1/1)", "element(/1/9)", "gone", "other(x)xpointer(//b[2])", "xpointer(//p:c)"]


@registry.add("n16_pointers", """SELECT o_orderkey AS doc_id, CASE o_orderkey % 10 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 8 THEN 1 WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 9 THEN NULL ELSE 0 END AS part,
CASE o_orderkey % 10 WHEN 3 THEN 2 WHEN 6 THEN 0 WHEN 7 THEN 0 WHEN 9 THEN 0 ELSE 1 END AS n_found,
CASE o_orderkey % 10 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_custkey::VARCHAR WHEN 2 THEN o_custkey || ' & 2' WHEN 3 THEN o_custkey::VARCHAR WHEN 4 THEN o_orderstatus WHEN 5 THEN o_custkey || ' & 2' WHEN 8 THEN '2' END AS value,
CASE WHEN o_orderkey % 10 IN (6, 7, 9) THEN 'nothing found' END AS error FROM orders""")
def n16_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pointer into each order, of every scheme: found, not found, found by the second part, with and without its prefix."""
    k = F.col("o_orderkey")
    text = F.format_string('<r xmlns:p="urn:p"><a id="o1"><b>%s</b> &amp; <b>2</b></a><p:c>%s</p:c></r>', "o_custkey", "o_orderstatus")
    pointer = F.element_at(F.array(*map(F.lit, POINTERS)), (k % len(POINTERS) + 1).cast("int"))
    return xpointer.resolve(table(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text"), pointer.alias("pointer")))


@registry.add("s05_in_context", """
SELECT o_orderkey AS doc_id, v.* FROM orders, (VALUES (0, 0, NULL, 'element', 'urn:q', 'x'), (1, 1, 0, 'attr', NULL, 'k'), (2, 1, 0, 'text', NULL, NULL), (3, 0, NULL, 'text', NULL, NULL), (4, 0, NULL, 'element', 'urn:d', 'y')) v(pre, level, parent, kind, ns, name) WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, CASE o_orderkey % 3 WHEN 1 THEN 'fragment: unbound prefix' ELSE 'fragment: mismatched tag' END, NULL, NULL FROM orders WHERE o_orderkey % 3 > 0""")
def s05_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments parsed below an element of each order, with the namespaces in its scope; prefixes bound elsewhere aren't."""
    k = F.col("o_orderkey")
    text = F.lit('<r xmlns:p="urn:p"><a xmlns:p="urn:q" xmlns="urn:d"/><b xmlns:z="urn:z"/></r>')
    fragment = F.when(k % 3 == 0, F.concat(F.lit('<p:x k="1">'), k.cast("string"), F.lit("</p:x>tail<y/>"))).when(k % 3 == 1, "<z:x/>").otherwise("<p:x></y>")
    rows = xpointer.fragments(table(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text"), F.lit("/1/1").alias("pointer"), fragment.alias("fragment")))
    return rows.select("doc_id", F.col("pre").cast("int").alias("pre"), "level", F.col("parent").cast("int").alias("parent"), F.coalesce("kind", "error").alias("kind"), "ns", "name")


@registry.add("v12_consistency", f"""WITH {ORDER_TREE_SQL}, o AS (SELECT pre, doc_id, pre // 1024 - 1 AS k FROM tree WHERE kind = 'element' AND name = 'order')
SELECT 'broken' AS tree, 'wrong level' AS fault, count(*) AS n FROM o WHERE k % 5 = 1 HAVING count(*) > 0
UNION ALL SELECT 'broken', 'without a name', count(*) FROM o WHERE k % 5 = 2 HAVING count(*) > 0
UNION ALL SELECT 'broken', 'no parent', count(*) FROM o WHERE k % 5 = 3 HAVING count(*) > 0
UNION ALL SELECT 'broken', 'overlaps its sibling', count(*) FROM o WHERE k % 5 = 4 HAVING count(*) > 0
UNION ALL SELECT 'broken', 'number twice', 2 * count(*) FROM o WHERE k % 5 = 4 HAVING count(*) > 0""")
def v12_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the order tree by kind, as it is (none) and with faults planted in its orders."""
    clean = whole_order_tree(spark, sf_dir)
    k, order = F.floor(F.col("pre") / 1024) - 1, (F.col("name") == "order") & (F.col("kind") == "element")
    flag = (F.col("kind") == "attr") & (F.col("name") == "status") & (k % 5 == 4)
    changed = {
        "level": F.when(order & (k % 5 == 1), F.col("level") + 7).when((F.col("level") >= 3) & (k % 5 == 1), F.col("level") + 7).otherwise(F.col("level")),
        "parent": F.when(order & (k % 5 == 3), F.lit(-5)).otherwise(F.col("parent")),
        "name": F.when(order & (k % 5 == 2), F.lit(None)).otherwise(F.col("name")),
    }
    names = F.when(flag, F.array(F.col("name"), F.lit("other"))).otherwise(F.array(F.col("name")))
    broken = clean.withColumns(changed).withColumn("name", F.explode(names))
    both = None
    for name, tree in (("clean", clean), ("broken", broken)):
        found = consistency.faults(tree).groupBy("fault").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tree"), "fault", "n")
        both = found if both is None else both.unionByName(found)
    return both
