"""Queries over graphs, source text, logs, rules, markup, compression and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.functions import text as ft
from treeline.operators import codec, graph, logs, sourcecode, textsearch
from treeline.operators import nodes as ops
from treeline.plans.xpath import XPath
from treeline.registry import registry
from treeline.session import table
from treeline.sources import markup

# ---- graphs -----------------------------------------------------------------------------------------------------

#: A supplier depends on the supplier of the next lower key that shares a part with it, so there is no cycle.
DAG_SQL = "dag AS (SELECT DISTINCT a.l_suppkey AS src, max(b.l_suppkey) AS dst FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b ON a.l_partkey = b.l_partkey AND b.l_suppkey < a.l_suppkey GROUP BY a.l_suppkey, a.l_partkey)"


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of suppliers; one is named by each of its parts, as what is made of them takes it once."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").where("l_partkey is not null")
    # The next lower supplier of the same part; of rows of one supplier only the first has it.
    before = F.lag("l_suppkey").over(Window.partitionBy("l_partkey").orderBy("l_suppkey"))
    return pairs.select(F.col("l_suppkey").alias("src"), before.alias("dst")).where("dst < src")


@registry.add("g03_closure", f"WITH RECURSIVE {DAG_SQL}, r AS (SELECT src, dst FROM dag UNION SELECT r.src, d.dst FROM r JOIN dag d ON d.src = r.dst) SELECT src, dst FROM r")
def g03_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transitive dependencies."""
    return graph.closure(dag(spark, sf_dir))


@registry.add("g04_layers", f"WITH RECURSIVE {DAG_SQL}, n AS (SELECT s_suppkey AS node FROM supplier), r AS (SELECT node, 0 AS depth FROM n UNION SELECT d.src, r.depth + 1 FROM r JOIN dag d ON d.dst = r.node) SELECT node, max(depth) AS depth FROM r GROUP BY ALL")
def g04_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topological layers (also O05, O06): one above the deepest dependency."""
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    return graph.layers(nodes, dag(spark, sf_dir))


#: Each supplier refers to two others, which its line items name: a graph with cycles.
TWO_SQL = """n AS (SELECT count(*) AS n FROM supplier),
two AS (SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, unnest([max(l_orderkey * 31 + l_partkey) % any_value(n) + 1, min(l_orderkey * 17 + l_partkey) % any_value(n) + 1]) AS dst FROM lineitem, n GROUP BY l_suppkey)),
reach AS (SELECT src, dst FROM two UNION SELECT r.src, t.dst FROM reach r JOIN two t ON t.src = r.dst),
nodes AS (SELECT src AS node FROM two UNION SELECT dst FROM two),
named AS (SELECT node, coalesce(least(node, (SELECT min(a.dst) FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src WHERE a.src = node)), node) AS component FROM nodes)"""


def two(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "supplier").count()
    named = F.array((F.max(F.col("l_orderkey") * 31 + F.col("l_partkey")) % n + 1), (F.min(F.col("l_orderkey") * 17 + F.col("l_partkey")) % n + 1))
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src")).agg(named.alias("to"))
    return edges.select("src", F.explode("to").alias("dst")).distinct()


@registry.add("g01_components", f"WITH RECURSIVE {TWO_SQL} SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM named")
def g01_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of the suppliers' references."""
    return graph.strong_components(two(spark, sf_dir))


@registry.add("g02_cycles", f"WITH RECURSIVE {TWO_SQL} SELECT node, count(*) OVER (PARTITION BY component) > 1 AS is_cycle FROM named")
def g02_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on a cycle with others."""
    return g01_components(spark, sf_dir).select("node", (F.col("size") > 1).alias("is_cycle"))


@registry.add("g07_failures", f"WITH RECURSIVE {DAG_SQL}, r AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 0 UNION SELECT d.src FROM r JOIN dag d ON d.dst = r.node) SELECT node FROM r")
def g07_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fails if suppliers in debt do."""
    roots = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    return graph.reachable(dag(spark, sf_dir), roots)


# ---- search, patches, source text ---------------------------------------------------------------------------------


@registry.add("f09_search", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
SELECT p AS pattern, doc_id::VARCHAR AS file, i AS line, array_to_string(lines[greatest(i - 2, 1) : least(i + 2, len(lines))], chr(10)) AS context
FROM l, unnest(range(1, len(lines) + 1)) AS u(i), (VALUES ('License'), ('[0-9]{16}')) AS v(p) WHERE regexp_matches(lines[i], p)""")
def f09_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match a pattern, two lines of context."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return textsearch.search(files, ["License", "[0-9]{16}"], context=2).withColumn("line", F.col("line").cast("long"))


@registry.add("a17_grouped_hits", """
SELECT p AS pattern, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), (VALUES ('License'), ('[0-9]{16}')) AS v(p) WHERE regexp_matches(line, p) GROUP BY ALL""")
def a17_grouped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f09_search(spark, sf_dir).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@registry.add("w05_line_windows", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, i AS at, array_to_string(lines[i : i + 2], chr(10)) AS win FROM l, unnest(range(1, len(lines) - 1)) AS u(i)""")
def w05_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of three lines."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines")).where(F.size("lines") >= 3)
    return rows.select("doc_id", "lines", F.explode(F.sequence(F.lit(1), F.size("lines") - 2)).alias("i")).select("doc_id", F.col("i").cast("long").alias("at"), F.array_join(F.slice("lines", F.col("i"), F.lit(3)), "\n").alias("win"))


@registry.add("m04_patch", "SELECT * FROM (VALUES ('exact', 'a\nX\nc', NULL), ('spaces', 'X\nz', NULL), ('fuzzy', 'int X;\nend', NULL), ('absent', 'nothing alike', 'search text not found')) v(file, text, error)")
def m04_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-and-replace patches: exact, by squeezed white space, by similarity."""
    block = lambda a, b: f"<<<<<<< SEARCH\n{a}\n=======\n{b}\n>>>>>>> REPLACE"
    rows = [("exact", "a\nb\nc", block("b", "X")), ("spaces", "if  (x)\nz", block("if (x)", "X")), ("fuzzy", "int value_one = 1;\nend", block("int value_one  = 2;", "int X;")), ("absent", "nothing alike", block("qqqqqqqqqqqq", "X"))]
    return textsearch.patch_files(spark.createDataFrame(rows, "file string, text string, patch string"))


C_SOURCE = """#ifndef GEO_H
#define GEO_H
#define MAX_POINTS 64
#define SQUARE(x) ((x) * (x))
typedef struct _Point { double x; double y; } Point;
typedef unsigned long Count;
double distance(const Point *a, const Point *b);
#endif
/* calls distance() in a comment only */
static double length(const Point *p) {
  return sqrt(SQUARE(p->x)); // not a call: foo()
}
double distance(const Point *a,
                const Point *b) {
  double d = length(a);
  return d + length(b);
}
"""
RUST_SOURCE = "pub struct Point { x: f64 }\npub fn distance(a: &Point) -> f64 {\n    length(a)\n}\nfn length(p: &Point) -> f64 { p.x }\n"


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("geo.c", C_SOURCE), ("geo.rs", RUST_SOURCE)], "file string, text string")


@registry.add("n27_symbols", "SELECT * FROM (VALUES ('geo.c', 'distance', 'function', false, false, 7), ('geo.c', 'length', 'function', true, true, 10), ('geo.c', 'distance', 'function', false, true, 13), ('geo.c', 'Point', 'struct', false, true, 5), ('geo.c', 'Count', 'typedef', false, true, 6), ('geo.c', 'GEO_H', 'define', false, false, 2), ('geo.c', 'MAX_POINTS', 'define', false, true, 3), ('geo.c', 'SQUARE', 'macro', false, true, 4), ('geo.rs', 'Point', 'struct', false, true, 1), ('geo.rs', 'distance', 'function', false, true, 2), ('geo.rs', 'length', 'function', true, true, 5)) v(file, name, kind, is_static, is_definition, line)")
def n27_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of C and Rust sources."""
    return sourcecode.extract(sources(spark)).select("file", "name", "kind", "is_static", "is_definition", "line")


@registry.add("n26_signatures", "SELECT * FROM (VALUES ('geo.c', 10, 'static double length(const Point *p)'), ('geo.c', 13, 'double distance(const Point *a,\nconst Point *b)'), ('geo.c', 7, 'double distance(const Point *a, const Point *b)'), ('geo.rs', 2, 'pub fn distance(a: &Point) -> f64'), ('geo.rs', 5, 'fn length(p: &Point) -> f64')) v(file, line, signature)")
def n26_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sourcecode.extract(sources(spark)).where("kind = 'function'").select("file", "line", "signature")


@registry.add("n29_calls", "SELECT * FROM (VALUES ('distance', 'length'), ('length', 'SQUARE')) v(src, dst)")
def n29_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of known symbols; comments and literals hold none."""
    return sourcecode.call_edges(sourcecode.extract(sources(spark)))


@registry.add("j13_merge", "SELECT * FROM (VALUES ('distance', 'c', 'geo.c', 'geo.c', 2), ('length', 'c', NULL, 'geo.c', 1), ('distance', 'rust', NULL, 'geo.rs', 1), ('length', 'rust', NULL, 'geo.rs', 1)) v(name, language, declaration_file, definition_file, n)")
def j13_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations and definitions in one row."""
    merged = sourcecode.merge(sourcecode.extract(sources(spark)).where("kind = 'function'"))
    return merged.select("name", "language", "declaration_file", "definition_file", F.col("n").cast("int").alias("n"))


@registry.add("n30_locations", "SELECT * FROM (VALUES ('distance', 'geo.c', 'geo.rs', 'c'), ('length', 'geo.c', 'geo.rs', 'c')) v(name, c_file, rust_file, preferred)")
def n30_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All locations of a name in one row; C goes first."""
    s = sourcecode.extract(sources(spark)).where("kind = 'function' and is_definition")
    of = lambda lang: F.max(F.when(F.col("language") == lang, F.col("file")))
    return s.groupBy("name").agg(of("c").alias("c_file"), of("rust").alias("rust_file"), F.min("language").alias("preferred"))


@registry.add("j12_unify", "SELECT * FROM (VALUES ('_Node', 'Node'), ('Tree', 'Tree'), ('leaf', 'Leaf')) v(struct, typedef)")
def j12_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs with the typedefs that name them."""
    structs = spark.createDataFrame([("_Node",), ("Tree",), ("leaf",), ("lone",)], "name string")
    typedefs = spark.createDataFrame([("Node", "struct _Node"), ("Tree", "struct Tree"), ("Leaf", "struct leaf"), ("Count", "unsigned")], "name string, body string")
    return sourcecode.unify(structs, typedefs)


@registry.add("f16_noise", "SELECT p_partkey, length(split_part(p_name, ' ', 1)) <= 1 OR split_part(p_name, ' ', 1) IN ('if', 'int', 'char') AS skip FROM part")
def f16_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", sourcecode.noise(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("skip"))


@registry.add("f17_kept", "SELECT * FROM (VALUES ('header', true), ('long', true), ('static_long', false), ('short', false)) v(name, kept)")
def f17_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("header", True, True, 1), ("long", False, False, 11), ("static_long", False, True, 20), ("short", False, False, 10)], "name string, h boolean, s boolean, n int")
    return rows.select("name", sourcecode.kept(F.col("h"), F.col("s"), F.col("n")).alias("kept"))


@registry.add("f18_guards", "SELECT * FROM (VALUES ('GEO_H', true), ('MAX', false), ('EMPTY', true)) v(name, guard)")
def f18_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("GEO_H", "1"), ("MAX", "64"), ("EMPTY", " ")], "name string, body string")
    return rows.select("name", sourcecode.guard(F.col("name"), F.col("body")).alias("guard"))


@registry.add("k09_repomap", "SELECT * FROM (VALUES ('geo.c', 'function', 'distance,length'), ('geo.rs', 'function', 'distance,length')) v(file, kind, names)")
def k09_repomap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by file and kind, sorted."""
    s = sourcecode.extract(sources(spark)).where("kind = 'function' and is_definition")
    return s.groupBy("file", "kind").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@registry.add("s24_collect_files", "SELECT doc_id, CASE WHEN length(text) > 50000 THEN left(text, 50000) || chr(10) || chr(10) || '... [File truncated for analysis] ...' ELSE text END AS content FROM documents WHERE ends_with(source, '1')")
def s24_collect_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a suffix, those over 50,000 characters cut with a mark (the cut is the feature)."""
    d = table(spark, sf_dir, "documents").where(F.endswith("source", F.lit("1")))
    return d.select("doc_id", F.when(F.length("text") > 50_000, F.concat(F.substring("text", 1, 50_000), F.lit("\n\n... [File truncated for analysis] ..."))).otherwise(F.col("text")).alias("content"))


# ---- logs ---------------------------------------------------------------------------------------------------------

LOGS_SQL = """ops AS (SELECT conv_id, coalesce(arg_max(op, turn) FILTER (op IS NOT NULL), 'unknown') AS operation FROM (SELECT conv_id, turn, CASE WHEN contains(lower(text), 'fuzz') THEN 'fuzz' WHEN contains(lower(text), 'stub') THEN 'stub' WHEN contains(lower(text), 'implement') THEN 'implement' WHEN contains(lower(text), 'que ') THEN 'query' WHEN contains(lower(text), 'the ') THEN 'plain' END AS op FROM conversations) GROUP BY ALL),
tok AS (SELECT conv_id, floor(coalesce(sum(length(text)) FILTER (role <> 'assistant'), 0) / 4)::BIGINT AS prompt_tokens, greatest(floor(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) / 4)::BIGINT, 1) AS completion_tokens FROM conversations GROUP BY ALL),
costs AS (SELECT *, round(prompt_tokens * 0.000001 + completion_tokens * 0.000004, 8) AS cost FROM ops JOIN tok USING (conv_id))"""


@registry.add("a07_token_estimate", f"WITH {LOGS_SQL} SELECT conv_id, prompt_tokens, completion_tokens FROM tok")
def a07_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.token_estimate(table(spark, sf_dir, "conversations"))


@registry.add("a08_operations", f"WITH {LOGS_SQL} SELECT conv_id, operation FROM ops")
def a08_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.classify(table(spark, sf_dir, "conversations"))


@registry.add("a06_costs", f"WITH {LOGS_SQL} SELECT operation, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt, sum(completion_tokens)::BIGINT AS completion, round(sum(cost), 4) AS cost, round(100 * sum(cost) / (SELECT sum(cost) FROM costs), 4) AS share, round(sum(cost) / count(*), 6) AS mean_cost FROM costs GROUP BY ALL")
def a06_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost by operation with shares."""
    return logs.rollup(logs.costs(table(spark, sf_dir, "conversations"), 1e-6, 4e-6), "operation")


@registry.add("a06_grouping_sets", "SELECT role, conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY GROUPING SETS ((role), (conv_id), ())")
def a06_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupingSets([["role"], ["conv_id"], []], "role", "conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


@registry.add("a09_pass_fail", "SELECT lang, count(*) AS total, count_if(quality = 1) AS passed, round(count_if(quality = 1) / count(*), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def a09_pass_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and success rates."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    passed = F.count_if(F.col("quality") == 1)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("total"), passed.alias("passed"), F.round(F.try_divide(passed, F.count(F.lit(1))), 6).alias("rate"))


@registry.add("a18_interned", "SELECT count(DISTINCT event_type) AS strings, (SELECT sum(strlen(e)) FROM (SELECT DISTINCT event_type AS e FROM events))::BIGINT AS bytes FROM events")
def a18_interned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct strings and their bytes."""
    return table(spark, sf_dir, "events").select("event_type").distinct().agg(F.count(F.lit(1)).alias("strings"), F.sum(F.octet_length("event_type")).alias("bytes"))


@registry.add("r07_stop_turns", "SELECT conv_id, min(turn) FILTER (role = 'assistant' AND NOT contains(text, '?') AND turn < 10) AS stop_turn, least(count_if(role = 'assistant'), 5) AS rounds FROM conversations GROUP BY ALL")
def r07_stop_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.stop_turns(table(spark, sf_dir, "conversations"))


@registry.add("r06_deltas", "SELECT conv_id, role, string_agg(text, '' ORDER BY turn) AS content FROM conversations GROUP BY ALL")
def r06_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of a response joined in order."""
    c = table(spark, sf_dir, "conversations")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return c.groupBy("conv_id", "role").agg(F.array_join(ordered, "").alias("content"))


@registry.add("s25_json", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def s25_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON text; text that is no JSON gives null."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@registry.add("o04_top_customers", "SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY ALL ORDER BY spent DESC, o_custkey LIMIT 10")
def o04_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten that spent most; ties by key."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return s.orderBy(F.desc("spent"), "o_custkey").limit(10)


@registry.add("w09_share", "SELECT c_mktsegment, round(sum(c_acctbal) / sum(sum(c_acctbal)) OVER (), 6) AS share FROM customer GROUP BY ALL")
def w09_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    total = c.agg(F.sum("c_acctbal").alias("all"))
    return c.groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("own")).crossJoin(F.broadcast(total)).select("c_mktsegment", F.round(F.try_divide("own", "all"), 6).alias("share"))


@registry.add("o08_sorted_lists", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS parts FROM lineitem GROUP BY ALL")
def o08_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: x.cast("string")), ",").alias("parts"))


@registry.add("f12_sequences", "SELECT user_id, string_agg(event_type, ';' ORDER BY ts, event_id) AS seq, regexp_matches(string_agg(event_type, ';' ORDER BY ts, event_id), 'view;(click;)*purchase') AS bought FROM events GROUP BY ALL")
def f12_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An automaton over each user's ordered events, as a regular expression over tokens."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(ordered, ";").alias("seq"))
    return rows.withColumn("bought", F.col("seq").rlike("view;(click;)*purchase"))


# ---- rules and catalogs -------------------------------------------------------------------------------------------


@registry.add("v10_rules", """
SELECT 'positive total' AS rule, 'assert' AS kind, o_orderkey AS node FROM orders WHERE NOT o_totalprice > 1000
UNION ALL SELECT 'urgent and open', 'report', o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'""")
def v10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assert rules report where they fail, report rules where they hold."""
    rules = [("positive total", "assert", "o_totalprice > 1000"), ("urgent and open", "report", "o_orderpriority = '1-URGENT' and o_orderstatus = 'O'")]
    fired = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(test), F.lit(False)) if kind == "assert" else F.coalesce(F.expr(test), F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(kind).alias("kind"))) for name, kind, test in rules]))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.explode(fired).alias("x")).select("x.rule", "x.kind", "node")


@registry.add("v01_content_model", "SELECT l_orderkey, regexp_full_match(string_agg(l_returnflag, '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag), '(A|R)*N*') AS ok FROM lineitem GROUP BY ALL")
def v01_content_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children in order against a content model."""
    kids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))), lambda x: x["l_returnflag"])
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(kids, "").alias("kids"))
    return rows.select("l_orderkey", F.col("kids").rlike(r"\A(?:(A|R)*N*)\z").alias("ok"))


CATALOG = [("http://", "file:///web/"), ("http://www.", "file:///www/"), ("https://", "file:///secure/")]


@registry.add("j10_catalog", "SELECT page_id, CASE WHEN starts_with(url, 'http://www.') THEN 'file:///www/' || substr(url, 12) WHEN starts_with(url, 'http://') THEN 'file:///web/' || substr(url, 8) WHEN starts_with(url, 'https://') THEN 'file:///secure/' || substr(url, 9) ELSE url END AS resolved FROM pages")
def j10_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites of the longest prefix; the rules are a literal array, so pages are not joined."""
    rules = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(t).alias("to")) for p, t in CATALOG])
    found = F.filter(rules, lambda r: F.startswith(F.col("url"), r["prefix"]))
    best = F.try_element_at(F.array_sort(found, lambda a, b: F.length(b["prefix"]) - F.length(a["prefix"])), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.concat(best["to"], F.substring(F.col("url"), F.length(best["prefix"]) + 1, F.length("url"))), F.col("url")).alias("resolved"))


@registry.add("j17_left_joins", "SELECT n_nationkey, n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def j17_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each module with its summaries, none left out."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_nationkey", "n_name").agg(F.count("s_suppkey").alias("suppliers"))


@registry.add("m05_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'updated' ELSE p_brand END AS value FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT -1, 'added'")
def m05_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add, update and remove by key."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("value"))
    new = p.where("p_partkey % 10 = 0").select("p_partkey", F.lit("updated").alias("new"))
    merged = p.join(new, "p_partkey", "left").select("p_partkey", F.coalesce("new", "value").alias("value")).where("p_partkey % 7 <> 0")
    return merged.unionByName(spark.createDataFrame([(-1, "added")], "p_partkey long, value string"))


# ---- compression --------------------------------------------------------------------------------------------------


@registry.add("a12_histogram", "SELECT c AS symbol, count(*) AS n FROM (SELECT unnest(string_split(p_type, '')) AS c FROM part) GROUP BY ALL")
def a12_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", "")).alias("symbol")).where("symbol <> ''")
    return p.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@registry.add("a13_entropy", "SELECT event_type, n, round(log2(sum(n) OVER ()) - log2(n), 6) AS bits FROM (SELECT event_type, count(*) AS n FROM events GROUP BY ALL)")
def a13_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ideal code lengths of event types."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(F.greatest(F.log2("total") - F.log2("n"), F.lit(0.0)), 6).alias("bits"))


@registry.add("c05_block_size", "SELECT ceil(sum(n * (log2(t) - log2(n))) / 8)::BIGINT AS dynamic_bytes, 8 * sum(n)::BIGINT // 8 AS stored_bytes FROM (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS t FROM events GROUP BY ALL)")
def c05_block_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of a block by entropy against stored bytes."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(F.broadcast(total)).agg(F.ceil(F.sum(F.col("n") * (F.log2("t") - F.log2("n"))) / 8).alias("dynamic_bytes"), F.sum("n").alias("stored_bytes"))


@registry.add("c06_symbols", "SELECT * FROM (VALUES (3, 257, 0, 2, 0), (10, 264, 0, 6, 2), (11, 265, 1, 6, 2), (18, 268, 1, 8, 3), (19, 269, 2, 8, 3), (257, 284, 5, 16, 7), (258, 285, 0, 16, 7)) v(n, length_symbol, length_bits, dist_symbol, dist_bits)")
def c06_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEFLATE symbols and extra bits of lengths, and of the same numbers as distances."""
    rows = spark.createDataFrame([(3,), (10,), (11,), (18,), (19,), (257,), (258,)], "n int")
    n = F.col("n")
    return rows.select("n", codec.length_symbol(n).alias("length_symbol"), codec.length_extra_bits(n).alias("length_bits"), codec.distance_symbol(n).alias("dist_symbol"), codec.distance_extra_bits(n).alias("dist_bits"))


@registry.add("c08_checksums", "SELECT * FROM (VALUES ('123456789', 3421780262, 152961502), ('', 0, 1)) v(s, crc, adler)")
def c08_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("123456789",), ("",)], "s string")
    return rows.select("s", F.crc32(F.encode("s", "UTF-8")).alias("crc"), codec.adler32(F.encode("s", "UTF-8")).alias("adler"))


@registry.add("c01_round_trip", "SELECT doc_id, md5(text) AS zlib_md5, md5(text) AS gzip_md5, md5(text) AS raw_md5, octet_length(encode(text)) AS n_bytes, strlen(text) > 1000 AS halved FROM documents")
def c01_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each container gives back what went in, read as digests of what comes out; ``halved`` tells that a text of over 1,000 bytes takes at most 60 % of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("b"))
    back = codec.round_trips(d, "doc_id", "b", ["zlib", "gzip", "deflate"])
    halved = (F.col("n_bytes") > 1000) & (F.col("zlib_bytes") < 0.6 * F.col("n_bytes"))
    return back.select("doc_id", "zlib_md5", "gzip_md5", F.col("deflate_md5").alias("raw_md5"), "n_bytes", halved.alias("halved"))


@registry.add("c04_code_lengths", "SELECT * FROM (VALUES (0, 1, 0), (1, 2, 2), (2, 3, 6), (3, 3, 7)) v(symbol, length, code)")
def c04_code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-limited code lengths and canonical codes of a histogram."""
    lengths = codec.code_lengths([40, 20, 10, 5], 15)
    return spark.createDataFrame(list(zip(range(4), lengths, codec.codes(lengths), strict=True)), "symbol int, length int, code int")


# ---- markup -------------------------------------------------------------------------------------------------------


def orders_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.format_string('<?xml version="1.0"?><o id="%s" s="%s"><p>%s &amp; co</p><!-- c --><t>%s</t></o>', "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").alias("text"))


@registry.add("s01_xml_nodes", "SELECT kind, name, level, n FROM (SELECT count(*) AS c FROM orders), (VALUES ('document', NULL, 0, 1), ('element', 'o', 1, 1), ('attr', 'id', 2, 1), ('attr', 's', 2, 1), ('element', 'p', 2, 1), ('text', NULL, 3, 2), ('comment', NULL, 2, 1), ('element', 't', 2, 1)) v(kind, name, level, each), LATERAL (SELECT each * c AS n)")
def s01_xml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML documents as node rows, counted."""
    return markup.xml_nodes(orders_xml(spark, sf_dir)).groupBy("kind", "name", "level").agg(F.count(F.lit(1)).alias("n"))


@registry.add("s03_push_chunks", "SELECT o_orderkey AS doc_id, o_orderpriority || ' & co' AS p FROM orders")
def s03_push_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fed in pieces of seven characters the tree is the same."""
    return markup.xml_nodes(orders_xml(spark, sf_dir), chunk=7).where("name = 'p'").select("doc_id", F.col("value").alias("p"))


@registry.add("s04_events", "SELECT event, count(*) * 1 AS n FROM orders, (VALUES ('start'), ('start'), ('start'), ('end'), ('end'), ('end'), ('text'), ('text'), ('comment')) v(event) GROUP BY ALL")
def s04_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parser events in order, counted."""
    return markup.events(orders_xml(spark, sf_dir), "doc_id", "text").groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@registry.add("s06_recover", "SELECT o_orderkey AS doc_id, 'o' AS first_name, o_orderkey % 3 = 0 AS failed FROM orders")
def s06_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken documents (every third) keep the nodes up to the error and have an error row, the others none."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", 1, 45), F.lit("<broken"))).otherwise(F.col("text"))
    orders = orders_xml(spark, sf_dir).withColumn("text", text)
    first = markup.xml_nodes(orders).where("kind = 'element' and level = 1").select("doc_id", F.col("name").alias("first_name"))
    failed = markup.errors(orders).select("doc_id", F.lit(True).alias("failed"))
    return orders.select("doc_id").join(first, "doc_id", "left").join(failed, "doc_id", "left").select("doc_id", "first_name", F.coalesce("failed", F.lit(False)).alias("failed"))


@registry.add("s08_html_links", "SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links, len(regexp_extract_all(html, '<li>')) AS items FROM pages")
def s08_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and list items of tag soup, by node table."""
    n = markup.html_nodes(table(spark, sf_dir, "pages"))
    return n.groupBy(F.col("doc_id").alias("page_id")).agg(F.count_if((F.col("kind") == "attr") & (F.col("name") == "href")).alias("links"), F.count_if((F.col("kind") == "element") & (F.col("name") == "li")).alias("items"))


@registry.add("s10_implied", "SELECT page_id, 'html' AS root, 1 AS heads, 1 AS bodies FROM pages")
def s10_implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = markup.html_nodes(table(spark, sf_dir, "pages").withColumn("html", F.regexp_replace("html", "</?(html|body)[^>]*>", "")))
    e = n.where("kind = 'element'")
    return e.groupBy(F.col("doc_id").alias("page_id")).agg(F.min_by("name", "pre").alias("root"), F.count_if(F.col("name") == "head").cast("int").alias("heads"), F.count_if(F.col("name") == "body").cast("int").alias("bodies"))


@registry.add("s12_meta_charset", "SELECT page_id, lower(regexp_extract(html, '(?i)<meta[^>]*charset=[\"'']?([A-Za-z0-9_-]+)', 1)) AS charset FROM pages")
def s12_meta_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("html", "(?i)<meta[^>]*charset=[\"']?([A-Za-z0-9_-]+)", 1)).alias("charset"))


@registry.add("n13_html_path", "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, 1 AS n FROM pages")
def n13_html_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XPath over HTML pages: ``/html[head/title]/@lang``."""
    x = XPath(markup.html_nodes(table(spark, sf_dir, "pages")))
    return x.select("/html[head/title]/@lang").groupBy(F.col("doc_id").alias("page_id")).agg(F.max("value").alias("lang"), F.count(F.lit(1)).cast("int").alias("n"))


@registry.add("k01_round_trip", "SELECT o_orderkey AS doc_id, printf('<o id=\"%s\" s=\"%s\"><p>%s &amp; co</p><!-- c --><t>', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority) AS head FROM orders")
def k01_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed and serialised again."""
    xml = ops.serialize(markup.xml_nodes(orders_xml(spark, sf_dir)), F.col("name") == "o", whole=True)
    return xml.select("doc_id", F.regexp_extract("xml", r"^(.*<t>)", 1).alias("head"))


@registry.add("t16_entities", "SELECT * FROM (VALUES ('amp', '&'), ('copy', '©'), ('eacute', 'é'), ('nosuch', NULL)) v(name, value)")
def t16_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity names and values."""
    known = spark.createDataFrame(list(markup.ENTITY_VALUES.items()), "name string, value string")
    asked = spark.createDataFrame([("amp",), ("copy",), ("eacute",), ("nosuch",)], "name string")
    return asked.join(F.broadcast(known), "name", "left")


@registry.add("k02_html_escape", "SELECT page_id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe, regexp_extract(url, '^[a-z]+') AS scheme FROM pages")
def k02_html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ops.escape_text(F.col("url")).alias("safe"), ft.uri(F.col("url"))["scheme"].alias("scheme"))


#: Three times a line: the first is literals and matches, the others at most one match of 258 bytes each.
LINES_SQL = "lines AS (SELECT p_partkey AS doc_id, repeat(p_name || ' ' || p_type || chr(10), 3) AS s, strlen(p_name || ' ' || p_type || chr(10)) AS n FROM part)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.encode(F.repeat(F.concat("p_name", F.lit(" "), "p_type", F.lit("\n")), 3), "UTF-8").alias("data"))


@registry.add("w06_lz77", f"WITH {LINES_SQL} SELECT doc_id, md5(s) AS restored, n AS last_distance, 2 * n AS last_length FROM lines")
def w06_lz77(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LZ77 parses: the digest of what they expand to, and the last match, which spans the repeated lines."""
    from treeline.operators import lz

    return lz.parse(lines(spark, sf_dir)).select("doc_id", F.col("digest").alias("restored"), "last_distance", "last_length")
