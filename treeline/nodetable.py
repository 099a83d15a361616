"""The node table: ordered trees as rows.

``doc_id, pre, end, level, parent, kind, ns, prefix, name, value, ord, line``:
``pre`` orders the nodes of a document; the subtree of n is ``n.pre < pre <= n.end``;
attributes have their element as ``parent`` and lie between it and its first
child; ``value`` is the string-value. Kinds: document, element, attr, ns, text,
cdata, comment, pi.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import table

SCHEMA = "doc_id long, pre long, end long, level int, parent long, kind string, ns string, prefix string, name string, value string, ord int, line int"
COLUMNS = [c.strip().split()[0] for c in SCHEMA.split(",")]

#: Places that an order and a line item take in the numbering: attributes and children fit between.
ORDER, LINE = 1024, 16
#: Line items of one part of the whole tree: their nodes are many times larger than what is shuffled, and are sorted in memory.
PART = 100_000
#: Line items are numbered within their order; line numbers may repeat.
LINE_KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def nodes(df: DataFrame, doc: Column, pre: Column, end: Column, level: int, parent: Column, kind: str, name: str, value: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        doc.cast("long").alias("doc_id"), pre.cast("long").alias("pre"), end.cast("long").alias("end"), F.lit(level).alias("level"), parent.cast("long").alias("parent"),
        F.lit(kind).alias("kind"), none.alias("ns"), none.alias("prefix"), F.lit(name if kind in ("element", "attr") else None).cast("string").alias("name"),
        value.cast("string").alias("value"), F.lit(0).alias("ord"), F.lit(None).cast("int").alias("line"),
    )


def order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents: customer / order / lineitem with attributes.

    ``pre`` comes from the keys themselves, so nothing numbers a whole document:
    an order is at ``orderkey * ORDER``, its line items at steps of ``LINE``
    behind it, attributes right behind their element.
    """
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    within = Window.partitionBy("l_orderkey").orderBy(*LINE_KEYS)
    l = table(spark, sf_dir, "lineitem").withColumn("l_ord", F.row_number().over(within))  # noqa: E741
    l = l.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    doc, top = F.col("c_custkey"), F.lit((1 << 62) - 1)
    at_o = (F.col("o_orderkey") + 1) * ORDER
    at_l = (F.col("l_orderkey") + 1) * ORDER + F.col("l_ord") * LINE
    oc, ol = F.col("o_custkey"), F.col("o_custkey")
    parts = [
        nodes(c, doc, F.lit(0), top, 0, F.lit(None), "document", "", F.col("c_name")),
        nodes(c, doc, F.lit(1), top, 1, F.lit(0), "element", "customer", F.col("c_name")),
        nodes(c, doc, F.lit(2), F.lit(2), 2, F.lit(1), "attr", "segment", F.col("c_mktsegment")),
        nodes(c, doc, F.lit(3), F.lit(3), 2, F.lit(1), "attr", "nation", F.col("c_nationkey")),
        nodes(o, oc, at_o, at_o + ORDER - 1, 2, F.lit(1), "element", "order", F.col("o_orderkey")),
        nodes(o, oc, at_o + 1, at_o + 1, 3, at_o, "attr", "status", F.col("o_orderstatus")),
        nodes(o, oc, at_o + 2, at_o + 2, 3, at_o, "attr", "priority", F.col("o_orderpriority")),
        nodes(l, ol, at_l, at_l + LINE - 1, 3, (F.col("l_orderkey") + 1) * ORDER, "element", "lineitem", F.col("l_quantity").cast("int")),
        nodes(l, ol, at_l + 1, at_l + 1, 4, at_l, "attr", "flag", F.col("l_returnflag")),
        nodes(l, ol, at_l + 2, at_l + 2, 4, at_l, "attr", "part", F.col("l_partkey")),
        nodes(l, ol, at_l + 4, at_l + 4, 4, at_l, "text", "", F.col("l_quantity").cast("int")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_document(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Rows of the order tree dealt out by document, in parts that grow with the line items, so that a part is sorted in memory."""
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // PART)), "doc_id")


def whole_order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of :func:`order_tree` for readers of nearly all of them: each table is read once.

    Customers, orders and line items are dealt out by document first and told as
    nodes there, so whatever goes by document needs no other shuffle. A path that
    asks for few kinds of nodes is better off with :func:`order_tree`, which reads only their tables.
    """
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    l = table(spark, sf_dir, "lineitem").withColumn("l_ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_KEYS)))  # noqa: E741
    l = l.join(o.select("o_orderkey", "o_custkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))  # noqa: E741
    at_o, top, none = (F.col("o_orderkey") + 1) * ORDER, F.lit((1 << 62) - 1), F.lit(None).cast("string")
    at_l = (F.col("l_orderkey") + 1) * ORDER + F.col("l_ord") * LINE

    def rows(df: DataFrame, doc: str, what: str, at: Column, up: Column, *values: Column) -> DataFrame:
        return df.select(F.col(doc).cast("long").alias("doc_id"), F.lit(what).alias("what"), at.cast("long").alias("at"), up.cast("long").alias("up"), *[v.cast("string").alias(f"v{k}") for k, v in enumerate(values)])

    told = rows(c, "c_custkey", "c", F.lit(0), F.lit(None), F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey"))
    told = told.unionByName(rows(o, "o_custkey", "o", at_o, F.lit(1), F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")))
    told = told.unionByName(rows(l, "o_custkey", "l", at_l, (F.col("l_orderkey") + 1) * ORDER, F.col("l_quantity").cast("int"), F.col("l_returnflag"), F.col("l_partkey")))
    told = by_document(spark, sf_dir, told)
    at, up = F.col("at"), F.col("up")

    def node(pre: Column, end: Column, level: int, parent: Column, kind: str, name: str | None, value: str) -> Column:
        return F.struct(
            pre.cast("long").alias("pre"), end.cast("long").alias("end"), F.lit(level).alias("level"), parent.cast("long").alias("parent"), F.lit(kind).alias("kind"), none.alias("ns"), none.alias("prefix"),
            F.lit(name).cast("string").alias("name"), F.col(value).alias("value"), F.lit(0).alias("ord"), F.lit(None).cast("int").alias("line"),
        )

    one = F.lit(1)
    customer = [node(F.lit(0), top, 0, F.lit(None), "document", None, "v0"), node(one, top, 1, F.lit(0), "element", "customer", "v0"), node(F.lit(2), F.lit(2), 2, one, "attr", "segment", "v1"), node(F.lit(3), F.lit(3), 2, one, "attr", "nation", "v2")]
    order = [node(at, at + ORDER - 1, 2, up, "element", "order", "v0"), node(at + 1, at + 1, 3, at, "attr", "status", "v1"), node(at + 2, at + 2, 3, at, "attr", "priority", "v2")]
    item = [node(at, at + LINE - 1, 3, up, "element", "lineitem", "v0"), node(at + 1, at + 1, 4, at, "attr", "flag", "v1"), node(at + 2, at + 2, 4, at, "attr", "part", "v2"), node(at + 4, at + 4, 4, at, "text", None, "v0")]
    nodes_ = F.when(F.col("what") == "c", F.array(*customer)).when(F.col("what") == "o", F.array(*order)).otherwise(F.array(*item))
    return told.select("doc_id", F.explode(nodes_).alias("node")).select("doc_id", "node.*")


#: The same relation in SQL, for oracles.
ORDER_TREE_SQL = f"""
l AS (SELECT lineitem.*, o_custkey, (l_orderkey + 1) * {ORDER} + row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_KEYS)}) * {LINE} AS spot FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tree AS (
  SELECT c_custkey AS doc_id, 0::BIGINT AS pre, {(1 << 62) - 1}::BIGINT AS "end", 0 AS level, NULL::BIGINT AS parent, 'document' AS kind, NULL AS name, c_name AS value FROM customer
  UNION ALL SELECT c_custkey, 1, {(1 << 62) - 1}, 1, 0, 'element', 'customer', c_name FROM customer
  UNION ALL SELECT c_custkey, 2, 2, 2, 1, 'attr', 'segment', c_mktsegment FROM customer
  UNION ALL SELECT c_custkey, 3, 3, 2, 1, 'attr', 'nation', c_nationkey::VARCHAR FROM customer
  UNION ALL SELECT o_custkey, (o_orderkey + 1) * {ORDER}, (o_orderkey + 1) * {ORDER} + {ORDER - 1}, 2, 1, 'element', 'order', o_orderkey::VARCHAR FROM orders
  UNION ALL SELECT o_custkey, (o_orderkey + 1) * {ORDER} + 1, (o_orderkey + 1) * {ORDER} + 1, 3, (o_orderkey + 1) * {ORDER}, 'attr', 'status', o_orderstatus FROM orders
  UNION ALL SELECT o_custkey, (o_orderkey + 1) * {ORDER} + 2, (o_orderkey + 1) * {ORDER} + 2, 3, (o_orderkey + 1) * {ORDER}, 'attr', 'priority', o_orderpriority FROM orders
  UNION ALL SELECT o_custkey, spot, spot + {LINE - 1}, 3, (l_orderkey + 1) * {ORDER}, 'element', 'lineitem', l_quantity::INT::VARCHAR FROM l
  UNION ALL SELECT o_custkey, spot + 1, spot + 1, 4, spot, 'attr', 'flag', l_returnflag FROM l
  UNION ALL SELECT o_custkey, spot + 2, spot + 2, 4, spot, 'attr', 'part', l_partkey::VARCHAR FROM l
  UNION ALL SELECT o_custkey, spot + 4, spot + 4, 4, spot, 'text', NULL, l_quantity::INT::VARCHAR FROM l
)"""
