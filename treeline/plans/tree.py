"""Queries over ordered trees: axes, predicates, positions, set operations, structural joins, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.functions import xpath as fx
from treeline.nodetable import LINE, LINE_KEYS, ORDER, ORDER_TREE_SQL, by_document, order_tree, whole_order_tree
from treeline.operators import nodes as ops
from treeline.plans.xpath import XPath
from treeline.registry import registry
from treeline.session import table

WITH = f"WITH {ORDER_TREE_SQL}"


def finds(name: str, expression: str, sql: str) -> None:
    """Register a location path over the order tree; ``sql`` selects from ``tree``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return XPath(order_tree(spark, sf_dir)).select(expression).select("doc_id", "pre", "value")

    run.__doc__ = f"``{expression}`` over the order tree."
    registry.add(name, f"{WITH} SELECT DISTINCT doc_id, pre, value FROM ({sql})")(run)


def gives(name: str, expression: str, kind: str, sql: str, context: str | None = None) -> None:
    """Register an expression's value for each document, or for each node of ``context``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = XPath(order_tree(spark, sf_dir))
        got = x.value(expression, kind, x.select(context) if context else None)
        return got.withColumn("result", F.round("result", 6)) if kind == "number" else got

    run.__doc__ = f"``{expression}`` for each node of ``{context or '/'}``."
    registry.add(name, f"{WITH} {sql}")(run)


ELEMENT = "SELECT * FROM tree WHERE kind = 'element' AND name = "
NUMBERED = "SELECT *, row_number() OVER (PARTITION BY doc_id, parent ORDER BY pre) AS rn, count(*) OVER (PARTITION BY doc_id, parent) AS n FROM tree WHERE kind = 'element' AND name = "
AXIS = "SELECT t.* FROM tree t JOIN ({c}) c ON t.doc_id = c.doc_id AND {on} WHERE {where}"


def axis(context: str, on: str, where: str) -> str:
    return AXIS.format(c=context, on=on, where=where)


finds("n01_self", "//order/self::order", ELEMENT + "'order'")
finds("n02_child", "/customer/order/lineitem", axis(ELEMENT + "'order'", "t.parent = c.pre", "t.kind = 'element' AND t.name = 'lineitem'"))
finds("n03_parent", "//lineitem[@flag='R']/..", axis(f"{ELEMENT}'lineitem' AND (doc_id, pre) IN (SELECT doc_id, parent FROM tree WHERE kind = 'attr' AND name = 'flag' AND value = 'R')", "t.pre = c.parent", "true"))
finds("n04_descendant", "/customer/descendant::lineitem", axis(ELEMENT + "'customer'", 't.pre > c.pre AND t.pre <= c."end"', "t.kind = 'element' AND t.name = 'lineitem'"))
finds("n04_descendant_or_self", "//order/descendant-or-self::*", axis(ELEMENT + "'order'", 't.pre >= c.pre AND t.pre <= c."end"', "t.kind = 'element'"))
finds("n05_ancestor", "//lineitem[@flag='R']/ancestor::*[1]", axis(f"{ELEMENT}'lineitem' AND (doc_id, pre) IN (SELECT doc_id, parent FROM tree WHERE kind = 'attr' AND name = 'flag' AND value = 'R')", "t.pre = c.parent", "t.kind = 'element'"))
finds("n05_ancestor_or_self", "//order[1]/ancestor-or-self::*", axis(f"SELECT * FROM ({NUMBERED}'order') WHERE rn = 1", 't.pre <= c.pre AND t."end" >= c."end"', "t.kind = 'element'"))
finds("n06_following_sibling", "//order[1]/following-sibling::order", axis(f"SELECT * FROM ({NUMBERED}'order') WHERE rn = 1", "t.parent = c.parent AND t.pre > c.pre", "t.kind = 'element' AND t.name = 'order'"))
finds("n07_preceding_sibling", "//order[3]/preceding-sibling::order[1]", f"SELECT * FROM ({NUMBERED}'order') WHERE rn = 2 AND n >= 3")
finds("n08_following", "//order[2]/following::lineitem", axis(f"SELECT * FROM ({NUMBERED}'order') WHERE rn = 2", 't.pre > c."end"', "t.kind = 'element' AND t.name = 'lineitem'"))
finds("n09_preceding", "//order[3]/preceding::lineitem", axis(f"SELECT * FROM ({NUMBERED}'order') WHERE rn = 3", 't."end" < c.pre', "t.kind = 'element' AND t.name = 'lineitem'"))
finds("n10_attribute", "//order/@status", axis(ELEMENT + "'order'", "t.parent = c.pre", "t.kind = 'attr' AND t.name = 'status'"))
finds("n12_root", "/", "SELECT * FROM tree WHERE kind = 'document'")
finds("n13_node_tests", "//lineitem/text() | //order/@* | /customer/node()", "SELECT t.* FROM tree t JOIN tree p ON t.doc_id = p.doc_id AND t.parent = p.pre WHERE (t.kind = 'text') OR (t.kind = 'attr' AND p.name = 'order') OR (p.name = 'customer' AND t.kind <> 'attr')")
finds("n14_location_path", "//lineitem[@flag='A']/../@priority", "SELECT t.* FROM tree t WHERE t.kind = 'attr' AND t.name = 'priority' AND (t.doc_id, t.parent) IN (SELECT l.doc_id, l.parent FROM tree l JOIN tree a ON a.doc_id = l.doc_id AND a.parent = l.pre AND a.kind = 'attr' AND a.name = 'flag' AND a.value = 'A' WHERE l.name = 'lineitem')")
finds("n15_child_sequence", "/*[1]/*[2]/*[3]", f"SELECT l.* FROM ({NUMBERED}'lineitem') l JOIN ({NUMBERED}'order') o ON l.doc_id = o.doc_id AND l.parent = o.pre WHERE l.rn = 3 AND o.rn = 2")
finds("f01_stacked_predicates", "//lineitem[@flag='R'][2]", "SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY l.doc_id, l.parent ORDER BY l.pre) AS rn FROM tree l JOIN tree a ON a.doc_id = l.doc_id AND a.parent = l.pre AND a.name = 'flag' AND a.kind = 'attr' AND a.value = 'R' WHERE l.name = 'lineitem') WHERE rn = 2")
finds("f02_predicate_truth", "//order[lineitem][last() - 1]", "SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY doc_id ORDER BY pre DESC) AS rn FROM tree o WHERE name = 'order' AND kind = 'element' AND (doc_id, pre) IN (SELECT doc_id, parent FROM tree WHERE name = 'lineitem')) WHERE rn = 2")
finds("f03_positional", "//order[3]", f"SELECT * FROM ({NUMBERED}'order') WHERE rn = 3")
finds("f04_and_or", "//order[@status='F' and lineitem or @priority='1-URGENT']", "SELECT o.* FROM tree o WHERE o.name = 'order' AND o.kind = 'element' AND (((o.doc_id, o.pre) IN (SELECT doc_id, parent FROM tree WHERE name = 'status' AND value = 'F') AND (o.doc_id, o.pre) IN (SELECT doc_id, parent FROM tree WHERE name = 'lineitem')) OR (o.doc_id, o.pre) IN (SELECT doc_id, parent FROM tree WHERE name = 'priority' AND value = '1-URGENT'))")
finds("w01_position", "//order[position() mod 2 = 1]", f"SELECT * FROM ({NUMBERED}'order') WHERE rn % 2 = 1")
finds("w02_last", "//order[last()]", f"SELECT * FROM ({NUMBERED}'order') WHERE rn = n")
finds("w03_global_first", "(//lineitem)[1]", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS rn FROM tree WHERE name = 'lineitem') WHERE rn = 1")
finds("w03_first_each", "//lineitem[1]", f"SELECT * FROM ({NUMBERED}'lineitem') WHERE rn = 1")
finds("u01_union", "//order[1] | //order[2] | //order[1]", f"SELECT * FROM ({NUMBERED}'order') WHERE rn <= 2")
finds("x11_boolean_not", "//order[not(lineitem)]", "SELECT o.* FROM tree o WHERE o.name = 'order' AND o.kind = 'element' AND (o.doc_id, o.pre) NOT IN (SELECT doc_id, parent FROM tree WHERE name = 'lineitem' AND parent IS NOT NULL)")
finds("j03_existential_equal", "//order[lineitem/@part = ../order[1]/lineitem/@part]", f"SELECT DISTINCT o.* FROM tree o JOIN tree l ON l.doc_id = o.doc_id AND l.parent = o.pre AND l.name = 'lineitem' JOIN tree p ON p.doc_id = l.doc_id AND p.parent = l.pre AND p.name = 'part' WHERE (p.doc_id, p.value) IN (SELECT q.doc_id, q.value FROM ({NUMBERED}'order') f JOIN tree m ON m.doc_id = f.doc_id AND m.parent = f.pre AND m.name = 'lineitem' JOIN tree q ON q.doc_id = m.doc_id AND q.parent = m.pre AND q.name = 'part' WHERE f.rn = 1)")
finds("j04_existential_unequal", "//order[lineitem/@flag != lineitem/@flag]", "SELECT o.* FROM tree o JOIN (SELECT l.doc_id, l.parent FROM tree l JOIN tree a ON a.doc_id = l.doc_id AND a.parent = l.pre AND a.name = 'flag' GROUP BY ALL HAVING count(DISTINCT a.value) > 1) x ON x.doc_id = o.doc_id AND x.parent = o.pre")
finds("j05_existential_less", "//order[lineitem < ../order[1]/lineitem]", f"SELECT o.* FROM tree o JOIN (SELECT doc_id, parent, min(value::INT) AS least FROM tree WHERE name = 'lineitem' GROUP BY ALL) x ON x.doc_id = o.doc_id AND x.parent = o.pre JOIN (SELECT l.doc_id, max(l.value::INT) AS most FROM tree l JOIN ({NUMBERED}'order') f ON f.doc_id = l.doc_id AND f.pre = l.parent AND f.rn = 1 WHERE l.name = 'lineitem' GROUP BY ALL) y ON y.doc_id = o.doc_id WHERE least < most")
finds("j06_set_scalar", "//order[lineitem > 45][lineitem = '7']", "SELECT o.* FROM tree o JOIN (SELECT doc_id, parent FROM tree WHERE name = 'lineitem' GROUP BY ALL HAVING max(value::INT) > 45 AND bool_or(value = '7')) x ON x.doc_id = o.doc_id AND x.parent = o.pre")

gives("a01_count", "count(lineitem)", "number", "SELECT o.doc_id, o.pre, count(l.pre)::DOUBLE AS result FROM tree o LEFT JOIN tree l ON l.doc_id = o.doc_id AND l.parent = o.pre AND l.name = 'lineitem' WHERE o.name = 'order' AND o.kind = 'element' GROUP BY ALL", "//order")
gives("a02_sum", "sum(//lineitem)", "number", "SELECT d.doc_id, 0 AS pre, coalesce(sum(l.value::INT), 0)::DOUBLE AS result FROM tree d LEFT JOIN tree l ON l.doc_id = d.doc_id AND l.name = 'lineitem' WHERE d.kind = 'document' GROUP BY ALL")
gives("a02_sum_nan", "sum(@status)", "number", "SELECT doc_id, pre, 'NaN'::DOUBLE AS result FROM tree WHERE name = 'order' AND kind = 'element'", "//order")
gives("a03_first_value", "string(//lineitem)", "string", "SELECT d.doc_id, 0 AS pre, coalesce(first.value, '') AS result FROM tree d LEFT JOIN (SELECT doc_id, arg_min(value, pre) AS value FROM tree WHERE name = 'lineitem' GROUP BY ALL) first ON first.doc_id = d.doc_id WHERE d.kind = 'document'")
gives("x16_name_count", "concat(name(), '|', count(@*))", "string", "SELECT o.doc_id, o.pre, 'order|2' AS result FROM tree o WHERE o.name = 'order' AND o.kind = 'element'", "//order")
gives("x16_name", "concat(name(..), '/', local-name(), namespace-uri())", "string", "SELECT doc_id, pre, 'customer/order' AS result FROM tree WHERE name = 'order' AND kind = 'element'", "//order")


@registry.add("j07_id", f"""{WITH}
SELECT DISTINCT e.doc_id, e.pre, e.value FROM tree e JOIN tree a ON a.doc_id = e.doc_id AND a.parent = e.pre AND a.kind = 'attr' AND a.name = 'part'
WHERE (a.doc_id, a.value) IN (SELECT p.doc_id, p.value FROM ({NUMBERED}'lineitem') l JOIN tree p ON p.doc_id = l.doc_id AND p.parent = l.pre AND p.name = 'part' WHERE l.rn = 1)""")
def j07_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id()`` with part as the id attribute: line items of the parts that orders begin with."""
    x = XPath(order_tree(spark, sf_dir), id_attribute="part")
    return x.select("id(//lineitem[1]/@part)").select("doc_id", "pre", "value")


# ---- operators on the node table --------------------------------------------------------------------------------


@registry.add("n17_node_path", f"""WITH o AS (
  SELECT o_custkey AS doc_id, o_orderkey AS k, '/customer/order' || CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN '[' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) || ']' ELSE '' END AS path FROM orders
), l AS (
  SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_KEYS)}) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
)
SELECT c_custkey AS doc_id, 1 AS pre, '/customer' AS path FROM customer
UNION ALL SELECT doc_id, (k + 1) * {ORDER}, path FROM o
UNION ALL SELECT doc_id, (k + 1) * {ORDER} + rn * {LINE}, path || '/lineitem' || CASE WHEN n > 1 THEN '[' || rn || ']' ELSE '' END FROM l JOIN o USING (k)""")
def n17_node_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element's path, with places only where siblings share the name."""
    elements = order_tree(spark, sf_dir).where("kind = 'element'").select("doc_id", "pre", "parent", "kind", "name", "level")
    return ops.node_paths(by_document(spark, sf_dir, elements), levels=3)


@registry.add("n18_element_children", f"""{WITH}
SELECT doc_id, parent AS pre, min(pre) AS first_child, max(pre) AS last_child, count(*) AS n_children FROM tree WHERE kind = 'element' AND parent > 0 GROUP BY ALL""")
def n18_element_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last element child and their number."""
    return ops.element_children(order_tree(spark, sf_dir)).where("pre > 0")


@registry.add("n19_attribute_map", f"""{WITH}
SELECT doc_id, parent AS pre, max(value) FILTER (name = 'status') AS status, max(value) FILTER (name = 'missing') AS missing, count(*) AS n_attrs FROM tree WHERE kind = 'attr' AND name IN ('status', 'priority') GROUP BY ALL""")
def n19_attribute_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes as a map per element, read by name and counted."""
    maps = ops.attribute_maps(order_tree(spark, sf_dir)).where(F.map_contains_key("attrs", F.lit("status")))
    return maps.select("doc_id", "pre", F.try_element_at("attrs", F.lit("status")).alias("status"), F.try_element_at("attrs", F.lit("missing")).alias("missing"), F.size("attrs").cast("long").alias("n_attrs"))


@registry.add("n20_string_value", f"""{WITH}
SELECT o.doc_id, o.pre, coalesce(string_agg(t.value, '' ORDER BY t.pre), '') AS string_value FROM tree o LEFT JOIN tree t ON t.doc_id = o.doc_id AND t.kind = 'text' AND t.pre > o.pre AND t.pre <= o."end" WHERE o.name = 'order' AND o.kind = 'element' GROUP BY ALL""")
def n20_string_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text below each order, in document order."""
    return ops.string_values(order_tree(spark, sf_dir), F.col("name") == "order")


@registry.add("n21_outer_xml", f"""{WITH},
i AS (SELECT l.doc_id, l.parent, l.pre, '<lineitem flag="' || f.value || '" part="' || p.value || '">' || l.value || '</lineitem>' AS x FROM tree l JOIN tree f ON f.doc_id = l.doc_id AND f.parent = l.pre AND f.name = 'flag' JOIN tree p ON p.doc_id = l.doc_id AND p.parent = l.pre AND p.name = 'part' WHERE l.name = 'lineitem')
SELECT o.doc_id, o.pre, '<order status="' || s.value || '" priority="' || p.value || '"' || CASE WHEN count(i.x) = 0 THEN '/>' ELSE '>' || string_agg(i.x, '' ORDER BY i.pre) || '</order>' END AS xml
FROM tree o JOIN tree s ON s.doc_id = o.doc_id AND s.parent = o.pre AND s.name = 'status' JOIN tree p ON p.doc_id = o.doc_id AND p.parent = o.pre AND p.name = 'priority' LEFT JOIN i ON i.doc_id = o.doc_id AND i.parent = o.pre WHERE o.name = 'order' AND o.kind = 'element' GROUP BY o.doc_id, o.pre, s.value, p.value""")
def n21_outer_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's subtree as XML."""
    return ops.serialize(whole_order_tree(spark, sf_dir), F.col("name") == "order")


@registry.add("n23_inherited", f"""{WITH}
SELECT l.doc_id, l.pre, arg_max(a.value, a.level) AS inherited FROM tree l JOIN tree e ON e.doc_id = l.doc_id AND e.pre <= l.pre AND e."end" >= l."end" AND e.kind = 'element' JOIN tree a ON a.doc_id = e.doc_id AND a.parent = e.pre AND a.name IN ('segment', 'status') AND a.kind = 'attr' WHERE l.name = 'lineitem' GROUP BY ALL""")
def n23_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest ancestor's attribute, as xml:lang and xml:base are inherited."""
    return ops.inherited(order_tree(spark, sf_dir), F.col("name") == "lineitem", ["segment", "status"])


@registry.add("n24_metadata", f"""{WITH}
SELECT kind, level, count(*) AS n, count(name) AS named, count_if("end" = pre) AS leaves, count_if(value = '') AS empty FROM tree GROUP BY ALL""")
def n24_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node kinds, depths and whether nodes are named, empty or leaves."""
    t = order_tree(spark, sf_dir)
    return t.groupBy("kind", "level").agg(F.count(F.lit(1)).alias("n"), F.count("name").alias("named"), F.count_if(F.col("end") == F.col("pre")).alias("leaves"), F.count_if(F.col("value") == "").alias("empty"))


@registry.add("f05_pattern", f"{WITH} SELECT doc_id, pre FROM tree l WHERE name = 'lineitem' UNION SELECT doc_id, pre FROM tree WHERE kind = 'attr' AND name = 'status'")
def f05_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that match the pattern ``customer//lineitem | order/@status``."""
    return ops.matching(order_tree(spark, sf_dir), "customer//lineitem | order/@status").select("doc_id", "pre")


@registry.add("f07_pattern_depth", "SELECT * FROM (VALUES ('/a/b', 2, 2, true), ('a//b', 2, -1, false), ('//x', 1, -1, false), ('/a/b/@c', 3, 3, true)) v(pattern, min_depth, max_depth, from_root)")
def f07_pattern_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth bounds of patterns, by which nodes can be pruned; -1 is unbounded."""
    rows = [(p, *ops.pattern_depth(p)) for p in ("/a/b", "a//b", "//x", "/a/b/@c")]
    return spark.createDataFrame(rows, "pattern string, min_depth int, max_depth int, from_root boolean")


@registry.add("f08_preserve", f"""{WITH}
SELECT t.doc_id, t.pre FROM tree t WHERE EXISTS (SELECT 1 FROM tree k WHERE k.doc_id = t.doc_id AND k.name = 'order' AND k.kind = 'element' AND t.pre BETWEEN k.pre AND k."end" AND (k.doc_id, k.pre) IN (SELECT doc_id, parent FROM tree WHERE name = 'status' AND value = 'F'))""")
def f08_preserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole subtrees of matching nodes, by a semi-join on intervals."""
    t = order_tree(spark, sf_dir)
    return ops.preserve(t, XPath(t).select("//order[@status='F']")).select("doc_id", "pre")


@registry.add("j01_structural", f"{WITH} SELECT p.name AS parent_name, c.name AS child_name, count(*) AS n FROM tree c JOIN tree p ON p.doc_id = c.doc_id AND p.pre = c.parent WHERE c.kind = 'element' AND p.kind = 'element' GROUP BY ALL")
def j01_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent-child join of elements."""
    t = order_tree(spark, sf_dir).where("kind = 'element'").select("doc_id", "pre", "parent", "name")
    p = t.select("doc_id", F.col("pre").alias("parent"), F.col("name").alias("parent_name"))
    return t.join(p, ["doc_id", "parent"]).groupBy("parent_name", F.col("name").alias("child_name")).agg(F.count(F.lit(1)).alias("n"))


@registry.add("j02_containment", f"""{WITH} SELECT a.name AS above, d.name AS below, count(*) AS n FROM tree a JOIN tree d ON d.doc_id = a.doc_id AND d.pre > a.pre AND d.pre <= a."end" WHERE a.kind = 'element' AND d.kind = 'element' GROUP BY ALL""")
def j02_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: every element with every element below it."""
    t = order_tree(spark, sf_dir).where("kind = 'element'").select("doc_id", "pre", "end", "name")
    a = t.select("doc_id", F.col("pre").alias("a_pre"), F.col("end").alias("a_end"), F.col("name").alias("above"))
    return t.join(a, (a.doc_id == t.doc_id) & (t.pre > F.col("a_pre")) & (t.pre <= F.col("a_end"))).groupBy("above", F.col("name").alias("below")).agg(F.count(F.lit(1)).alias("n"))


@registry.add("j08_idref_anti", "SELECT o_orderkey AS ref FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j08_idref_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a target: orders that no line item names."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    return o.join(l, o.o_orderkey == l.l_orderkey, "left_anti").select(F.col("o_orderkey").alias("ref"))


@registry.add("j18_semi", "SELECT c_custkey AS node FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j18_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership: customers with an urgent order."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("node"))


@registry.add("a04_distinct_first", f"{WITH} SELECT doc_id, value, min(pre) AS pre FROM tree WHERE kind = 'attr' AND name = 'flag' GROUP BY ALL")
def a04_distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct by value, the first in document order stays."""
    t = order_tree(spark, sf_dir).where("kind = 'attr' and name = 'flag'")
    return ops.distinct_values(t).select("doc_id", "value", "pre")


SET_1 = "SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_returnflag = 'R'"
SET_2 = "SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_linestatus = 'O'"


def two_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    pick = lambda cond: l.where(cond).select(F.col("l_orderkey").alias("node")).distinct()
    return pick("l_returnflag = 'R'"), pick("l_linestatus = 'O'")


@registry.add("u02_concatenation", f"SELECT node FROM ({SET_1}) UNION ALL SELECT node FROM ({SET_2})")
def u02_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    return a.unionByName(b)


@registry.add("u03_difference", f"SELECT node FROM ({SET_1}) EXCEPT SELECT node FROM ({SET_2})")
def u03_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.difference(*two_sets(spark, sf_dir), ["node"])


@registry.add("u04_intersection", f"SELECT node FROM ({SET_1}) INTERSECT SELECT node FROM ({SET_2})")
def u04_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.intersection(*two_sets(spark, sf_dir), ["node"])


@registry.add("u06_has_same_nodes", f"SELECT count(*) > 0 AS same FROM (SELECT node FROM ({SET_1}) INTERSECT SELECT node FROM ({SET_2}))")
def u06_has_same_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.intersection(*two_sets(spark, sf_dir), ["node"]).agg((F.count(F.lit(1)) > 0).alias("same"))


@registry.add("u07_add_remove", f"SELECT node FROM (SELECT node FROM ({SET_1}) UNION SELECT node FROM ({SET_2})) WHERE node % 7 <> 0")
def u07_add_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    both = a.unionByName(b).dropDuplicates(["node"])
    return ops.difference(both, both.where("node % 7 = 0"), ["node"])


@registry.add("u08_set_algebra", "SELECT l_suppkey AS supp, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') > 0 AND count(DISTINCT l_partkey) FILTER (l_returnflag = 'A') > 0 AND bool_or(shared) AS overlap FROM (SELECT *, l_partkey IN (SELECT x.l_partkey FROM lineitem x WHERE x.l_suppkey = lineitem.l_suppkey AND x.l_returnflag = 'A') AND l_returnflag = 'R' AS shared FROM lineitem) GROUP BY ALL")
def u08_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency sets as arrays: union's size, and whether two sets overlap."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    of = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_partkey")))
    sets = l.groupBy(F.col("l_suppkey").alias("supp")).agg(of("R").alias("r"), of("A").alias("a"), of("N").alias("n"))
    return sets.select("supp", F.size(F.array_union(F.array_union("r", "a"), "n")).cast("long").alias("n_parts"), F.arrays_overlap("r", "a").alias("overlap"))


@registry.add("w07_leading", f"""{WITH}, o AS ({NUMBERED}'order')
SELECT doc_id, pre, CASE WHEN rn < 3 THEN 'leading' ELSE 'trailing' END AS side FROM o WHERE n >= 3 AND rn <> 3
UNION ALL SELECT doc_id, pre, unnest(['leading', 'trailing']) FROM o WHERE n < 3""")
def w07_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes before and after a pivot that the set holds: the third order."""
    x = XPath(order_tree(spark, sf_dir))
    orders, pivot = x.select("//order"), x.select("//order[3]")
    return ops.leading(orders, pivot).select("doc_id", "pre", F.lit("leading").alias("side")).unionByName(ops.trailing(orders, pivot).select("doc_id", "pre", F.lit("trailing").alias("side")))


@registry.add("w08_siblings", f"{WITH} SELECT doc_id, pre, lag(pre) OVER w AS before, lead(pre) OVER w AS after FROM tree WHERE kind = 'element' AND name = 'lineitem' WINDOW w AS (PARTITION BY doc_id, parent ORDER BY pre)")
def w08_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element siblings before and after."""
    w = Window.partitionBy("doc_id", "parent").orderBy("pre")
    t = order_tree(spark, sf_dir).where("kind = 'element' and name = 'lineitem'")
    return t.select("doc_id", "pre", F.lag("pre").over(w).alias("before"), F.lead("pre").over(w).alias("after"))


@registry.add("o01_document_order", f"{WITH} SELECT doc_id, pre, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS place FROM tree WHERE kind = 'element'")
def o01_document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each element's place in document order."""
    t = order_tree(spark, sf_dir).where("kind = 'element'")
    return t.select("doc_id", "pre", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).alias("place"))


@registry.add("o02_first_last", f"{WITH} SELECT doc_id, arg_min(value, pre) AS first, arg_max(value, pre) AS last FROM tree WHERE name = 'lineitem' GROUP BY ALL")
def o02_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last in document order without a sort."""
    t = order_tree(spark, sf_dir).where("name = 'lineitem'")
    return t.groupBy("doc_id").agg(F.min_by("value", "pre").alias("first"), F.max_by("value", "pre").alias("last"))


@registry.add("x01_number_casts", "SELECT o_orderkey AS id, CASE WHEN o_totalprice = round(o_totalprice) THEN round(o_totalprice)::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.8f', o_totalprice), '0'), '.') END AS text FROM orders")
def x01_number_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """string(number) of order totals."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fx.number_to_string(F.col("o_totalprice")).alias("text"))
