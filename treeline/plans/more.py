"""Queries for the remaining small operators: files, orders, guards, code text, callbacks."""

from __future__ import annotations

import bz2
import gzip
import lzma

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.nodetable import ORDER_TREE_SQL, order_tree
from treeline.operators import codemap, documents
from treeline.operators import nodes as ops
from treeline.plans.xpath import XPath
from treeline.registry import registry
from treeline.session import table
from treeline.sources import files, markup
from treeline.streaming import streams

WITH = f"WITH {ORDER_TREE_SQL}"


@registry.add("s16_decompress", "SELECT * FROM (VALUES ('a.xz', 'packed a'), ('b.txt', 'plain b')) v(path, text)")
def s16_decompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """xz expanded in Python, other codecs by Spark's own readers."""
    assert gzip.decompress(gzip.compress(b"x")) == bz2.decompress(bz2.compress(b"x"))
    rows = spark.createDataFrame([("a.xz", bytearray(lzma.compress(b"packed a"))), ("b.txt", bytearray(b"plain b"))], "path string, content binary")
    return rows.select("path", F.decode(files.expand_compressed(F.col("content"), F.col("path")), "UTF-8").alias("text"))


@registry.add("s22_listing", "SELECT * FROM (VALUES ('nation-0.txt', 25), ('region-0.txt', 5)) v(name, lines)")
def s22_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder, written and listed, sorted, with their number of lines."""
    folder = streams.shared_folder(spark, "listing")
    for name, column in (("nation", "n_name"), ("region", "r_name")):
        table(spark, sf_dir, name).select(column).coalesce(1).write.text(f"{folder}/{name}-0.txt")
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    named = text.select(F.regexp_extract(F.input_file_name(), r"/([a-z]+-0\.txt)/", 1).alias("name"), F.col("value"))
    return named.select("name", (F.size(F.split(F.regexp_replace("value", r"\n+$", ""), "\n"))).cast("int").alias("lines"))


@registry.add("f19_typedefs", "SELECT * FROM (VALUES ('Count', true), ('Node', false), ('Handler', true), ('NodePtr', true)) v(name, simple)")
def f19_typedefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typedefs that only rename or point: those without a body."""
    rows = spark.createDataFrame([("Count", "typedef unsigned long Count;"), ("Node", "typedef struct { int x; } Node;"), ("Handler", "typedef int (*Handler)(void *);"), ("NodePtr", "typedef struct _Node *NodePtr;")], "name string, text string")
    return rows.select("name", codemap.simple_typedef(F.col("text")).alias("simple"))


@registry.add("f23_discovery", "SELECT p_brand AS marker, p_name AS name FROM part WHERE (p_name LIKE 'a%' OR p_name LIKE '%e %') AND p_brand NOT LIKE '%3' AND p_type <> ''")
def f23_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases found by marker and by name: shell patterns that take in, and others that leave out."""
    return files.discover(table(spark, sf_dir, "part"), F.col("p_name"), F.col("p_brand"), names=["a*", "*e *"], without_markers=["*3"]).where("p_type <> ''").select(F.col("p_brand").alias("marker"), F.col("p_name").alias("name"))


@registry.add("o10_processing_order", "SELECT n_name, row_number() OVER (ORDER BY n_regionkey DESC, n_name) - 1 AS place FROM nation")
def o10_processing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in an order given as a list, by its places (the table is a fixed 25 rows)."""
    n = table(spark, sf_dir, "nation")
    listed = n.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n_regionkey")).alias("r"), "n_name"))), lambda x: x["n_name"]).alias("names"))
    places = listed.select(F.posexplode("names").alias("place", "n_name"))
    return n.select("n_name").join(places, "n_name").select("n_name", F.col("place").cast("long").alias("place"))


@registry.add("o11_guards", "SELECT doc_id, length(text) > 5000 AS too_long FROM documents")
def o11_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits as columns: what exceeds one is marked, not cut."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 5000).alias("too_long"))


@registry.add("x17_aggregates", f"""{WITH},
o AS (SELECT doc_id, pre, row_number() OVER (PARTITION BY doc_id ORDER BY pre) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM tree WHERE kind = 'element' AND name = 'order'),
li AS (SELECT doc_id, parent, count(*) AS c, sum(value::INT) AS s FROM tree WHERE name = 'lineitem' GROUP BY ALL)
SELECT o.doc_id, o.pre FROM o LEFT JOIN li ON li.doc_id = o.doc_id AND li.parent = o.pre WHERE coalesce(s, 0) > 20 * coalesce(c, 0) AND rn < n""")
def x17_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count, sum, position and last in one predicate."""
    return XPath(order_tree(spark, sf_dir)).select("//order[sum(lineitem) > 20 * count(lineitem) and position() < last()]").select("doc_id", "pre")


@registry.add("t19_code_text", "SELECT n_regionkey AS region, 'enum Region' || n_regionkey || ' { ' || string_agg(replace(n_name, ' ', '_') || ' = ' || n_nationkey, ', ' ORDER BY n_nationkey) || ' }' AS code FROM nation GROUP BY n_regionkey")
def t19_code_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enum text made from rows."""
    item = F.struct("n_nationkey", F.concat(F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(" = "), F.col("n_nationkey").cast("string")).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ", ")
    grouped = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(body.alias("body"))
    return grouped.select("region", F.concat(F.lit("enum Region"), F.col("region").cast("string"), F.lit(" { "), "body", F.lit(" }")).alias("code"))


@registry.add("r04_streaming_validation", "SELECT o_orderkey AS doc_id, o_orderstatus <> 'F' AS valid FROM orders")
def r04_streaming_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a stream against a grammar, batch by batch."""
    grammar = documents.Grammar(("element", "o", ("attribute", "s", ("data", "[OP]"))))
    stream = streams.events(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.format_string('<o s="%s"/>', "o_orderstatus").alias("text"))
    return streams.drain(documents.validate(stream, grammar), streams.shared_folder(spark, "validated"))


@registry.add("r10_fan_out", r"SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') OR contains(text, chr(65534)) OR contains(text, chr(65535)) THEN 'not well-formed' END AS error FROM documents")
def r10_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work in parallel whose failures stay rows: every text as XML, each fifth document left open."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<a>"), ops.escape_text(F.coalesce("text", F.lit(""))), F.when(F.col("doc_id") % 5 == 0, "").otherwise("</a>")).alias("text"))
    failed = markup.errors(d).select("doc_id", F.lit("not well-formed").alias("error"))
    return d.select("doc_id").join(failed, "doc_id", "left")


@registry.add("e09_callbacks", "SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda x: lower(x) || length(x)), '|') AS called FROM part")
def e09_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A callback for each item of a container."""
    each = F.transform(F.split("p_type", " "), lambda x: F.concat(F.lower(x), F.length(x).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(each, "|").alias("called"))


@registry.add("e11_visibility", "SELECT o_orderkey AS doc_id, '<o><t>' || o_orderpriority || '</t></o>' AS xml FROM orders")
def e11_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only visible nodes are serialised; visibility is a column."""
    o = table(spark, sf_dir, "orders")
    df = o.select(F.col("o_orderkey").alias("doc_id"), F.format_string('<o s="%s"><!-- c --><t>%s</t></o>', "o_orderstatus", "o_orderpriority").alias("text"))
    visible = F.col("kind").isin("document", "element", "text")
    return ops.serialize(markup.xml_nodes(df).where(visible), F.col("name") == "o", whole=True).select("doc_id", "xml")
