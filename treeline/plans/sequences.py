"""Queries of automata over events, the streaming writer, limits, and extension functions of XPath."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.nodetable import ORDER_TREE_SQL, order_tree
from treeline.operators import automaton, writer
from treeline.operators.automaton import all_of, either, optional, sequence, times
from treeline.plans.xpath import Function, Limits, XPath
from treeline.registry import registry
from treeline.session import table
from treeline.sources import markup

#: Up to three views, then either a click or all of signup and error in any order, a purchase perhaps between; any number of times.
VISITS = times(sequence(times("view", 0, 3), either(times("click", 1, 4), all_of("signup", "error", optional("purchase")), "purchase")))


@registry.add("f12_counted", r"""
WITH e AS (SELECT user_id, (user_id * 1000 + dayofyear(ts))::VARCHAR AS session, event_type, row_number() OVER (PARTITION BY user_id, dayofyear(ts) ORDER BY ts, event_type) - 1 AS k FROM events),
c AS (SELECT session, k, CASE event_type WHEN 'view' THEN 'v' WHEN 'click' THEN 'c' WHEN 'signup' THEN 's' WHEN 'error' THEN 'e' ELSE 'p' END AS t FROM e),
s AS (SELECT session, k, count(*) OVER (PARTITION BY session) AS n, string_agg(t, '') OVER (PARTITION BY session ORDER BY k) AS seen FROM c),
m AS (SELECT *, regexp_full_match(seen, '(v{0,3}(c{1,4}|se|es|p|pse|pes|spe|eps|sep|esp))*(v{0,3}|v{0,3}c{1,4}|v{0,3}(s|e|p|ps|pe|sp|ep))') AS alive, regexp_full_match(seen, '(v{0,3}(c{1,4}|se|es|p|pse|pes|spe|eps|sep|esp))*') AS whole FROM s)
SELECT session, max(n) AS n, bool_or(whole AND k = n - 1) AS accepted, min(CASE WHEN NOT alive THEN k END) AS failed_at FROM m GROUP BY session""")
def f12_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's day against a pattern with counters and an all-of part: whether it fits, and where it stops fitting."""
    e = table(spark, sf_dir, "events").withColumn("session", (F.col("user_id") * 1000 + F.dayofyear("ts")).cast("string"))
    got = automaton.run(e, "session", F.col("ts"), "event_type", automaton.compile(VISITS))
    return got.select("session", "n", "accepted", "failed_at")


@registry.add("f12_next", """
WITH l AS (SELECT l_orderkey, l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS k FROM lineitem),
s AS (SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY k) AS seen, count(*) AS n FROM l GROUP BY l_orderkey)
SELECT l_orderkey::VARCHAR AS l_orderkey, n, seen IN ('AN', 'NA', 'ANR', 'ARN', 'NAR', 'NRA', 'RAN', 'RNA') AS accepted,
  CASE WHEN seen IN ('A') THEN 'N,R' WHEN seen = 'N' THEN 'A,R' WHEN seen = 'R' THEN 'A,N' WHEN seen IN ('AN', 'NA') THEN 'R' WHEN seen IN ('AR', 'RA') THEN 'N' WHEN seen IN ('NR', 'RN') THEN 'A' WHEN n = 3 AND seen IN ('ANR', 'ARN', 'NAR', 'NRA', 'RAN', 'RNA') THEN '' END AS next
FROM s""")
def f12_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may come next in each order's line items, if every flag comes once in any order and ``R`` may be left out."""
    got = automaton.run(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_linenumber"), "l_returnflag", automaton.compile(all_of("A", "N", optional("R"))))
    return got.select("l_orderkey", "n", "accepted", F.array_join("next", ",").alias("next"))


@registry.add("k03_writer", """SELECT o_orderkey AS doc_id, o_orderkey % 7 IN (0, 1) AS written, CASE o_orderkey % 7 WHEN 2 THEN 'attribute late outside a start tag' WHEN 3 THEN 'second document element o' WHEN 4 THEN 'end of x in t' WHEN 5 THEN 'comment with --' WHEN 6 THEN 'attribute s twice' END AS error,
  CASE o_orderkey % 7 WHEN 2 THEN 11 WHEN 3 THEN 11 WHEN 4 THEN 9 WHEN 5 THEN 6 WHEN 6 THEN 3 END AS error_seq, CASE WHEN o_orderkey % 7 IN (0, 1) THEN md5('<o id="' || o_orderkey || '" s="' || o_orderstatus || '"><p>' || o_orderpriority || ' &amp; co</p><!-- c --><t>7</t></o>') END AS digest FROM orders""")
def k03_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' events written back as text: as they are, without their ends, and with an event that can't come where it stands."""
    o = table(spark, sf_dir, "orders")
    text = F.format_string('<o id="%s" s="%s"><p>%s &amp; co</p><!-- c --><t>7</t></o>', "o_orderkey", "o_orderstatus", "o_orderpriority")
    events = writer.events_of(markup.xml_nodes(o.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))))
    k = F.col("doc_id") % 7
    late = lambda at, order, event, name: F.array(F.struct(F.struct(F.lit(at).cast("long").alias("at"), F.lit(order).cast("long").alias("order")).alias("seq"), F.lit(event).alias("event"), F.lit(name).alias("name"), F.lit("x").alias("text")))
    last = 1 << 62
    planted = F.when(k == 2, late(last, 0, "attr", "late")).when(k == 3, late(last, 0, "start", "o")).when(k == 6, late(3, 1, "attr", "s"))
    changed = events.where(~((k == 1) & (F.col("event") == "end") & (F.col("name") != "p"))).withColumn("text", F.when((k == 5) & (F.col("event") == "comment"), "a--b").otherwise(F.col("text")))
    changed = changed.withColumn("name", F.when((k == 4) & (F.col("event") == "end") & (F.col("name") == "t"), "x").otherwise(F.col("name")))
    # Planted beside the document element's start.
    own, top = F.array(F.struct("seq", "event", "name", "text")), (F.col("seq.at") == 1) & (F.col("seq.order") == 0)
    changed = changed.select("doc_id", F.explode(F.when(top & planted.isNotNull(), F.concat(own, planted)).otherwise(own)).alias("x")).select("doc_id", "x.*")
    got = writer.write(changed, whole=True)
    return got.select("doc_id", F.col("error").isNull().alias("written"), "error", F.col("error_seq").cast("int").alias("error_seq"), F.md5("xml").alias("digest"))


@registry.add("o11_limits", """SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN 'amplification above 5.0' WHEN 1 THEN 'depth above 40' WHEN 2 THEN 'number of nodes above 200' WHEN 3 THEN 'length of a name above 60' WHEN 4 THEN 'length of a text above 3000' END AS error FROM orders""")
def o11_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that multiply, deep nesting, many nodes, long names and texts beside good documents: an error row each, and no lost task."""
    k = F.col("o_orderkey")
    bomb = "<!DOCTYPE o [<!ENTITY a 'aaaaaaaaaa'><!ENTITY b '&a;&a;&a;&a;&a;&a;&a;&a;&a;&a;'><!ENTITY c '&b;&b;&b;&b;&b;&b;&b;&b;&b;&b;'>]><o>&c;<p/>&c;</o>"
    wide, deep = "<o>" + "<p/>" * 300 + "</o>", "<o>" * 50 + "</o>" * 50
    text = F.when(k % 6 == 0, bomb).when(k % 6 == 1, deep).when(k % 6 == 2, wide).when(k % 6 == 3, "<o><" + "p" * 70 + "/></o>").when(k % 6 == 4, "<o>" + "t" * 3500 + "</o>").otherwise(F.concat(F.lit("<o>"), k.cast("string"), F.lit("</o>")))
    docs = table(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text"))
    broken = markup.errors(docs, limits=markup.Limits(depth=40, nodes=200, name=60, text=3000, amplification=5.0, activation=900))
    return docs.select("doc_id").join(broken.select("doc_id", F.col("message").alias("error")), "doc_id", "left")


@registry.add("e05_functions", f"""WITH {ORDER_TREE_SQL}, o AS (SELECT t.doc_id, t.pre, t.value, p.value AS priority, s.value AS status FROM tree t JOIN tree p ON p.doc_id = t.doc_id AND p.parent = t.pre AND p.name = 'priority' JOIN tree s ON s.doc_id = t.doc_id AND s.parent = t.pre AND s.name = 'status' WHERE t.kind = 'element' AND t.name = 'order'),
flags AS (SELECT l.doc_id, l.parent AS pre, string_agg(f.value, '' ORDER BY l.pre) AS said FROM tree l JOIN tree f ON f.doc_id = l.doc_id AND f.parent = l.pre AND f.name = 'flag' WHERE l.kind = 'element' AND l.name = 'lineitem' GROUP BY ALL)
SELECT o.doc_id, o.pre FROM o LEFT JOIN flags USING (doc_id, pre) WHERE try_cast(left(priority, 1) AS INT) > 2 AND contains(said, 'NN') AND substr(priority, 1, 1) || status <> '3F'""")
def e05_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``//order`` by functions of our own: numbers of strings, of any number of strings, and booleans of node-sets."""
    functions = {
        ("urn:x", "rank"): Function(lambda s: F.substring(s, 1, 1), ("string",), "number"),
        ("urn:x", "runs"): Function(lambda strings, part: F.array_join(strings, "").contains(part), ("set", "string"), "boolean"),
        ("urn:x", "glue"): Function(lambda *parts: F.concat(*parts), ("string",), "string", more=True),
    }
    x = XPath(order_tree(spark, sf_dir), namespaces={"x": "urn:x"}, functions=functions, limits=Limits(depth=8, operations=60))
    return x.select("//order[x:rank(@priority) > 2][x:runs(lineitem/@flag, 'NN')][x:glue(x:rank(@priority), @status) != '3F']").select("doc_id", "pre")
