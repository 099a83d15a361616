"""Queries over whole tables of small operators: pieces of HTML, tags that close others, policies, dumps, depths of patterns, merged texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from treeline.nodetable import ORDER_TREE_SQL, order_tree
from treeline.operators import edits
from treeline.operators import nodes as ops
from treeline.plans import xpath
from treeline.registry import registry
from treeline.session import table
from treeline.sources import markup, network


@registry.add("s09_html_push", "SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links, len(regexp_extract_all(html, '<li>')) AS items FROM pages")
def s09_html_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and list items of pages that are fed nine characters at a time."""
    n = markup.html_nodes(table(spark, sf_dir, "pages"), chunk=9)
    return n.groupBy(F.col("doc_id").alias("page_id")).agg(F.count_if((F.col("kind") == "attr") & (F.col("name") == "href")).alias("links"), F.count_if((F.col("kind") == "element") & (F.col("name") == "li")).alias("items"))


@registry.add("s11_auto_close", "SELECT p_partkey, 'ul>li' AS path, 1 + p_size % 4 AS n FROM part UNION ALL SELECT p_partkey, 'li>p', 2 FROM part UNION ALL SELECT p_partkey, 'table>tr', 2 + p_size % 3 FROM part UNION ALL SELECT p_partkey, 'tr>td', 2 * (2 + p_size % 3) FROM part UNION ALL SELECT p_partkey, 'select>option', 2 FROM part")
def s11_auto_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start tags that close what is open: items, paragraphs, rows, cells, options, by parent and child."""
    p = table(spark, sf_dir, "part")
    html = F.concat(
        F.lit("<ul>"), F.repeat(F.lit("<li>x"), (1 + F.col("p_size") % 4).cast("int")), F.lit("<p>a<p>b</ul><table>"),
        F.repeat(F.lit("<tr><td>1<td>2"), (2 + F.col("p_size") % 3).cast("int")), F.lit("</table><select><option>1<option>2</select>"),
    )
    n = markup.html_nodes(p.select(F.col("p_partkey").alias("page_id"), html.alias("html"))).where("kind = 'element'")
    # An element is its own row's child and its children's parent: both meet in one grouping, so the pages are parsed once.
    sides = n.select("doc_id", F.explode(F.array(F.struct(F.col("pre").alias("at"), F.col("name").alias("outer"), F.lit(None).cast("string").alias("name")), F.struct(F.col("parent").alias("at"), F.lit(None).cast("string").alias("outer"), "name"))).alias("x")).select("doc_id", "x.*")
    counted = sides.groupBy("doc_id", "at", "outer", "name").agg(F.count(F.lit(1)).alias("n"))
    pairs = counted.withColumn("outer", F.max("outer").over(Window.partitionBy("doc_id", "at"))).where(F.col("name").isin("li", "p", "tr", "td", "option") & F.col("outer").isNotNull())
    return pairs.groupBy(F.col("doc_id").alias("p_partkey"), F.concat("outer", F.lit(">"), "name").alias("path")).agg(F.sum("n").cast("int").alias("n"))


@registry.add("s18_permitted", "SELECT page_id, starts_with(url, 'https://m.tionsh.example.net/en/') OR starts_with(url, 'https://thther.example.com/') AS allowed FROM pages")
def s18_permitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses a policy of two prefixes lets be fetched; none is."""
    policy = network.Policy(allowed=("https://m.tionsh.example.net/en", "https://thther.example.com"))
    return table(spark, sf_dir, "pages").select("page_id", network.permitted(F.col("url"), policy).alias("allowed"))


@registry.add("k13_dump", """SELECT p_partkey, 'PATH ROOT' || chr(10) || '  STEP child name part' || chr(10) || '    PREDICATE' || chr(10) || '      =' || chr(10) || '        PATH CONTEXT' || chr(10) || '          STEP attribute name brand' || chr(10) || '        STRING ' || p_brand
|| chr(10) || '    PREDICATE' || chr(10) || '      NUMBER ' || p_size || chr(10) || '  STEP descendant-or-self node' || chr(10) || '  STEP child text' AS dump FROM part""")
def k13_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expression for each part, parsed and shown as its operations."""

    @pandas_udf("string")
    def shown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda e: xpath.dump(xpath.parse(e)))

    return table(spark, sf_dir, "part").select("p_partkey", shown(F.format_string("/part[@brand = '%s'][%s]//text()", "p_brand", "p_size")).alias("dump"))


@registry.add("f07_patterns_of_parts", "SELECT p_partkey, 2 + p_size % 3 AS min_depth, CASE WHEN p_size % 4 = 0 THEN 2 + p_size % 3 ELSE -1 END AS max_depth, p_size % 4 = 0 OR p_size % 4 = 2 AS from_root FROM part")
def f07_patterns_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth bounds of a pattern for each part: from the root or not, with and without steps of any depth."""

    @pandas_udf("min_depth int, max_depth int, from_root boolean")
    def bounds(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([ops.pattern_depth(p) for p in s], columns=["min_depth", "max_depth", "from_root"])

    k = F.col("p_size") % 4
    middle = F.repeat(F.lit("/m"), (F.col("p_size") % 3).cast("int"))
    pattern = F.concat(F.when(k.isin(0, 2), "/a").otherwise("a"), middle, F.when(k.isin(0, 1), "/z").otherwise("//z"))
    return table(spark, sf_dir, "part").select("p_partkey", bounds(pattern).alias("x")).select("p_partkey", "x.*")


@registry.add("m03_merged_nodes", f"""WITH {ORDER_TREE_SQL}, t AS (SELECT x.doc_id, x.pre, x.value, f.value AS flag FROM tree x JOIN tree f ON f.doc_id = x.doc_id AND f.parent = x.parent AND f.name = 'flag' WHERE x.kind = 'text')
SELECT doc_id, pre, CASE flag WHEN 'R' THEN value || 'r' || flag ELSE value END AS value FROM t UNION ALL SELECT doc_id, pre + 3, 'after' FROM t WHERE flag = 'A'""")
def m03_merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes set beside others become one, unless a comment lies between."""
    tree = order_tree(spark, sf_dir)
    flags = tree.where("kind = 'attr' AND name = 'flag'").select("doc_id", "parent", F.col("value").alias("flag"))
    texts = tree.where("kind = 'text'").join(flags, ["doc_id", "parent"])
    more = lambda rows, by, kind, value: rows.withColumns({"pre": F.col("pre") + by, "end": F.col("pre") + by, "kind": F.lit(kind), "value": value}).select(*tree.columns)
    r, a = texts.where("flag = 'R'"), texts.where("flag = 'A'")
    planted = more(r, 1, "text", F.lit("r")).unionByName(more(r, 4, "text", F.col("flag"))).unionByName(more(a, 1, "comment", F.lit("c"))).unionByName(more(a, 3, "text", F.lit("after")))
    return edits.merged_text(tree.unionByName(planted)).where("kind = 'text'").select("doc_id", "pre", "value")
