"""What keeps queries whole on larger tables: plans without broadcasts of made rows, work dealt out, results unlike no plainer way's."""

from treeline.registry import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_auto_close_parses_once_and_broadcasts_nothing(spark, small):
    p = plan(registry.queries()["s11_auto_close"](spark, small))
    assert p.count("MapInArrow") == 1 and "Broadcast" not in p


def test_parsed_rows_are_dealt_out_and_never_broadcast(spark):
    from treeline.sources import markup

    n = markup.xml_nodes(spark.createDataFrame([(k, f"<a><b>{k}</b></a>") for k in range(40)], "doc_id long, text string").coalesce(1))
    pairs = n.where("kind = 'element'").join(n.where("kind = 'text'").select("doc_id", "parent", "value").toDF("doc_id", "pre", "said"), ["doc_id", "pre"])
    assert "Broadcast" not in plan(pairs)
    assert n.rdd.getNumPartitions() >= 4
    assert sorted(r.said for r in pairs.collect()) == sorted(str(k) for k in range(40))


def test_unlinking_shuffles_the_documents_once_and_joins_nothing(spark):
    from pyspark.sql import functions as F

    from treeline.operators import edits
    from treeline.sources import markup

    n = edits.written(markup.xml_nodes(spark.createDataFrame([(1, "<a><b><c/>x</b><b k='1'/></a>"), (2, "<b/>")], "doc_id long, text string")))
    got = edits.unlink(n, n.where("name in ('b', 'c')"), keep=False)
    assert "Join" not in plan(got) and plan(got).count("Exchange hashpartitioning") == 1
    rows = sorted(tuple(r) for r in got.select("doc_id", "pre", "end", F.coalesce("parent", F.lit(-1)), "kind").collect())
    assert rows == [(1, 0, 1, -1, "document"), (1, 1, 1, 0, "element"), (2, 0, 0, -1, "document")]


def test_parses_are_dealt_out(spark):
    from treeline.operators import lz

    made = spark.createDataFrame([(k, bytearray(b"abcabc%d" % k)) for k in range(8)], "doc_id long, data binary").coalesce(1)
    assert lz.parse(made).rdd.getNumPartitions() >= 4


def test_all_parses_share_one_search():
    import random
    from unittest import mock

    from treeline.operators import codec, deflate, lz

    rng, real = random.Random(3), lz.search
    for data in (b"ab" * 300, bytes(rng.randrange(4) for _ in range(400)), b"10.2-HIGH;11.2-HIGH;" * 9, b"\0" * 50, b""):
        with mock.patch.object(lz, "search", side_effect=real) as again, mock.patch.object(deflate, "search", side_effect=real) as once:
            deflate.deflate(data)
        assert once.call_count == 1 and again.call_count == 0
        store = lz.matches(data)
        assert lz.expand(store) == data
        # What is counted from sums is what the written form takes.
        held = deflate.Stretches(store)
        for a, b in [(0, len(store)), (0, len(store) // 2), (len(store) // 3, len(store))]:
            x, y = deflate.trees(*deflate.histogram(store[a:b])[:2])
            literal, distance, extra = deflate.histogram(store[a:b])
            want = 3 + deflate.header(x, y)[0] + extra + sum(map(int.__mul__, literal, x)) + sum(map(int.__mul__, distance, y))
            assert held.dynamic(a, b) == want and held.least(a, b) == deflate.least_bits(store[a:b])
    for _ in range(300):
        counts = [rng.choice([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 400]) for _ in range(rng.randrange(20))]
        for most in (5, 7, 15):
            assert lz.code_bits(counts, most) == sum(n * b for n, b in zip(counts, codec.code_lengths(counts, most), strict=True))


def test_layers_over_blocks_take_no_round_a_layer(spark):
    from unittest import mock

    from treeline.operators import graph

    nodes = spark.range(300).toDF("node")
    edges = spark.range(1, 300).selectExpr("id AS src", "id - 1 AS dst")
    with mock.patch.object(graph, "BLOCK", 100), mock.patch.object(graph, "settle", side_effect=graph.settle) as settled:
        got = {r.node: r.depth for r in graph.layers(nodes, edges).collect()}
    assert got == {k: k for k in range(300)} and settled.call_count <= 2 + 4 * 4


def test_edited_rows_are_never_broadcast(spark):
    from treeline.operators import edits
    from treeline.sources import markup

    n = markup.xml_nodes(spark.createDataFrame([(1, "<a><b>x</b></a>"), (2, "<b/>")], "doc_id long, text string"))
    n = edits.unlink(n, n.where("kind = 'text'"))
    assert "Broadcast" not in plan(n.join(n.where("name = 'b'").select("doc_id", "pre"), ["doc_id", "pre"]))
    assert sorted((r.doc_id, r.pre, r.end) for r in n.collect()) == [(1, 0, 2), (1, 1, 2), (1, 2, 2), (2, 0, 1), (2, 1, 1)]


def test_edits_by_conditions_shuffle_once_and_equal_those_by_rows(spark):
    from pyspark.sql import functions as F

    from treeline.operators import edits
    from treeline.sources import markup

    source = '<r x="1"><a k="1"><b>x</b>y<!-- z --></a><c/><a><d><b/><a>w</a></d></a></r>'
    n = markup.xml_nodes(spark.createDataFrame([(1, source), (2, "<r/>"), (3, "<a>")], "doc_id long, text string"))
    name, lines = F.col("name"), []
    for targets in (lambda n, c: c, lambda n, c: n.where(c)):
        got = edits.unlink(n, targets(n, F.col("kind") == "comment"))
        got = edits.inserted(got, targets(got, name == "a"), "first", "element", "f", name)
        got = edits.inserted(got, targets(got, name == "b"), "after", "element", "e")
        got = edits.with_attribute(got, targets(got, name.isin("a", "b", "x")), "k", F.col("value"))
        got = edits.renamed(got, targets(got, name == "c"), "cc")
        got = edits.replaced(got, targets(got, (name == "a") & (F.col("level") > 2) | (name == "d")), "element", "q", F.upper("value"))
        got = edits.inserted(got, targets(got, F.col("level") == 1), "last", "comment", None, F.lit("end"))
        lines.append((plan(got), sorted(map(str, got.collect()))))
    assert lines[0][1] == lines[1][1] and len(lines[0][1]) > 25
    assert "Join" not in lines[0][0] and "Broadcast" not in lines[0][0]
    # Texts are dealt out to be parsed, rows to their documents.
    assert lines[0][0].count("Exchange hashpartitioning") == 2


def test_a_tree_is_written_in_one_pass(spark):
    from pyspark.sql import functions as F

    from treeline.operators import nodes, output
    from treeline.sources import markup

    source = '<r x="&lt;"><a k="1"><b>x &amp; y</b>y<!-- z --></a><c/><a><d><?p i?><a>w</a></d></a></r>'
    n = markup.xml_nodes(spark.createDataFrame([(1, source), (2, "<r/>"), (None, "<a><a/></a>")], "doc_id long, text string"))
    got = nodes.serialize(n, F.col("name").isin("r", "a"))
    assert "Join" not in plan(got) and plan(got).count("MapInArrow") == 2
    texts = sorted((r.doc_id or 0, r.pre, r.xml) for r in got.collect())
    assert texts == [(0, 1, "<a><a/></a>"), (0, 2, "<a/>"), (1, 1, source), (1, 3, '<a k="1"><b>x &amp; y</b>y<!-- z --></a>'), (1, 10, "<a><d><?p i?><a>w</a></d></a>"), (1, 13, "<a>w</a>"), (2, 1, "<r/>")]
    page = markup.html_nodes(spark.createDataFrame([(1, "<div a='<'><br><script>a < b</script><p>a &lt; b</p><input disabled></div>")], "page_id long, html string"))
    html = output.serialize_html(page, F.col("name") == "div")
    assert "Join" not in plan(html)
    assert html.first().html == '<div a="&lt;"><br><script>a < b</script><p>a &lt; b</p><input disabled></div>'


def test_closure_meets_blocks_and_writes_no_pairs(spark):
    import random
    from unittest import mock

    from treeline.operators import graph

    draw = random.Random(3)
    edges = {(draw.randrange(-50, 150) * 1_000_003, draw.randrange(-50, 150) * 1_000_003) for _ in range(260)} | {(k, k - 1) for k in range(1, 30)} | {(None, 5), (7, None), (None, None)}
    known = set(edges)
    while more := {(a, d) for a, b in known for c, d in edges if b is not None and b == c} - known:
        known |= more
    with mock.patch.object(graph, "settle", side_effect=graph.settle) as settled:
        got = [tuple(r) for r in graph.closure(spark.createDataFrame(sorted(edges, key=str), "src long, dst long")).collect()]
    assert len(got) == len(known) and set(got) == known
    # All that is written down: rows of at most 64 pairs.
    most = max(c.args[0].count() for c in settled.call_args_list[-1:])
    assert most < len(known) / 4


def test_the_whole_order_tree_reads_tables_once_and_goes_by_document(spark, small):
    from pyspark.sql import functions as F

    from treeline import nodetable
    from treeline.operators import consistency, nodes

    whole, parts = nodetable.whole_order_tree(spark, small), nodetable.order_tree(spark, small)
    assert whole.columns == parts.columns and whole.count() == parts.count()
    assert whole.exceptAll(parts).isEmpty()
    text = plan(nodes.serialize(whole, F.col("name") == "order"))
    # Line items to their orders, documents to their parts; nothing is shuffled again to be written.
    assert text.count("FileScan parquet") == 4 and text.count("Exchange hashpartitioning(doc_id") == 1
    text = plan(consistency.faults(whole))
    assert text.count("FileScan parquet") == 4 and text.count("Exchange hashpartitioning(doc_id") == 1


def test_a_shell_takes_its_document_out_once(spark, small):
    from treeline import nodetable
    from treeline.operators import shell

    tree = nodetable.order_tree(spark, small)
    walk = shell.Shell(tree, tree.first().doc_id)
    assert "lineitem.parquet" not in plan(walk.nodes) and "tables" in plan(walk.nodes)
    assert walk.run("pwd") == "/"


def test_parsed_documents_are_written_without_a_shuffle_of_their_rows(spark, small):
    from pyspark.sql import functions as F

    from treeline.operators import nodes
    from treeline.sources import markup

    for name in ("k01_round_trip", "e11_visibility", "k02_html", "n21_inner_xml"):
        p = plan(registry.queries()[name](spark, small))
        # Texts are dealt out to be parsed.
        assert p.count("Exchange") == 1 and "Sort" not in p, name
    sources = ['<r a="1"><b>x</b><!-- c --><r>&amp;<b/></r></r>', "<r/>", "<b>no root<b>y</b></b>", "<r><b>", "", '<p:r xmlns:p="urn:p"><p:b p:k="&lt;"/></p:r>']
    n = markup.xml_nodes(spark.createDataFrame([(k, t) for k, t in enumerate(sources * 7)], "doc_id long, text string"))
    want = sorted(map(tuple, nodes.serialize(n, F.col("name").isin("r", "b")).collect()))
    assert sorted(map(tuple, nodes.serialize(n, F.col("name").isin("r", "b"), whole=True).collect())) == want and len(want) == 7 * 11
    # Documents of one number stay apart.
    n = markup.xml_nodes(spark.createDataFrame([(1, "<r><b>x</b></r>"), (1, "<r><b>x</b></r>"), (1, "<r>y</r>")], "doc_id long, text string"))
    assert sorted(r.xml for r in nodes.serialize(n, F.col("name") == "r", whole=True).collect()) == ["<r><b>x</b></r>", "<r><b>x</b></r>", "<r>y</r>"]


def test_only_keys_at_the_ends_of_ranges_have_maps_of_all_states(spark):
    from unittest import mock

    from pyspark.sql import functions as F

    from treeline.operators import automaton
    from treeline.session import written

    held = []
    made = spark.createDataFrame([(k, n, "ab"[n % 2]) for k in range(200) for n in range(k % 5 + 1)] + [(None, 0, "a"), (500, 0, None)], "key long, n int, t string")
    with mock.patch.object(automaton, "written", side_effect=lambda df: held.append(written(df)) or held[-1]):
        got = {r.key: (r.n, r.accepted, r.failed_at) for r in automaton.run(made.repartition(3), "key", F.col("n"), "t", automaton.compile(automaton.sequence("a", "b", "a"))).collect()}
    want = {str(k): (k % 5 + 1, k % 5 == 2, 3 if k % 5 > 2 else None) for k in range(200)}
    assert got == want | {None: (1, False, None), "500": (1, False, 0)}
    ends = held[0].where("NOT whole").count()
    assert held[0].where("size(to) > 1").count() <= ends // 2 + 1 and ends <= 2 * held[0].select("part").distinct().count()


def test_written_events_are_parsed_once_and_not_shuffled(spark, small):
    p = plan(registry.queries()["k03_writer"](spark, small))
    assert p.count("MapInArrow") == 2 and p.count("Exchange") == 1 and p.count("FileScan") == 1


def test_paths_of_elements_are_found_without_joins(spark, small):
    from treeline.operators import nodes
    from treeline.sources import markup

    n = markup.xml_nodes(spark.createDataFrame([(1, "<a><b><c/><c><c/></c></b><d/><b><c/></b>t</a>"), (2, "<a/>")], "doc_id long, text string"))
    got = nodes.node_paths(n, 3)
    assert "Join" not in plan(got) and plan(got).count("MapInArrow") == 1
    want = [(1, "/a"), (1, "/a/b[1]"), (1, "/a/b[1]/c[1]"), (1, "/a/b[1]/c[2]"), (1, "/a/b[2]"), (1, "/a/b[2]/c"), (1, "/a/d"), (2, "/a")]
    assert sorted((r.doc_id, r.path) for r in got.collect()) == want
    # What has no parent in the table has no path, nor has what lies below it.
    cut = sorted(r.path for r in nodes.node_paths(n.where("doc_id = 1 AND NOT (name = 'b' AND ord = 3)"), 3).collect())
    assert cut == ["/a", "/a/b", "/a/b/c[1]", "/a/b/c[2]", "/a/d"]
    # Line items to their orders, elements to their parts by document.
    p = plan(registry.queries()["n17_node_path"](spark, small))
    assert p.count("Exchange hashpartitioning(doc_id") == 1


def test_constraints_find_their_nodes_once(spark, small):
    from unittest import mock

    from treeline.operators import identity
    from treeline.plans import grammars

    held = []
    with mock.patch.object(identity, "written", side_effect=lambda df: held.append(df) or df):
        grammars.v11_keys(spark, small)
    assert len(held) == 3
    # Scopes, selected nodes, fields: the table is joined with itself twice, whatever the number of fields.
    assert all(plan(df).count("FileScan parquet") <= 9 for df in held)


def test_texts_are_round_tripped_one_at_a_time(spark, small):
    import hashlib

    from treeline.operators import codec

    p = plan(registry.queries()["c01_round_trip"](spark, small))
    assert "ArrowEvalPython" not in p and p.count("MapInArrow") == 1
    rows = [(1, b""), (2, b"ab" * 900), (3, None), (None, b"\xff\0")] + [(k, bytes([k % 256]) * k) for k in range(10, 200)]
    got = {r.k: tuple(r)[1:] for r in codec.round_trips(spark.createDataFrame(rows, "k long, data binary").coalesce(1), "k", "data", ["gzip", "deflate"]).collect()}
    assert {k: (v[0], v[1], v[3]) for k, v in got.items()} == {k: (None,) * 3 if b is None else (len(b), *[hashlib.md5(b).hexdigest()] * 2) for k, b in rows}
    assert got[3] == (None,) * 5 and got[2][2] - got[2][4] == 18  # what a gzip member has around its deflated bytes


def test_a_reader_makes_few_documents_python_objects_at_a_time(spark):
    from unittest import mock

    import pyarrow as pa

    from treeline.sources import markup

    held, runs = [], []
    real = markup.values
    with mock.patch.object(markup, "values", side_effect=lambda c: held.append(len(c)) or real(c)):
        frame = mock.MagicMock()
        frame.mapInArrow.side_effect = lambda run, ddl: runs.append(run) or mock.MagicMock()
        with mock.patch.object(markup, "dealt", return_value=frame):
            markup.html_nodes(spark.range(1).selectExpr("id AS page_id", "'' AS html"))
        batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["<p>x" * 50] * 1000)], names=["page_id", "html"])
        out = list(runs[0](iter([batch])))
    assert max(held) <= 64 and sum(b.num_rows for b in out) == 1000 * (1 + 3 + 100 - 1)


def test_paths_from_the_top_need_no_dropping_of_repeats(spark, small):
    from treeline import nodetable
    from treeline.plans.xpath import XPath

    x = XPath(nodetable.order_tree(spark, small), id_attribute="part")
    # Orders alone, read and filtered; nothing is shuffled.
    assert "Exchange" not in plan(x.select("//order")) and "Aggregate" not in plan(x.select("/customer/order"))
    for path in ("//order/..", "//order/ancestor::*", "//lineitem/following::order", "//order/@status/../preceding-sibling::*", "//lineitem/../lineitem"):
        got = x.select(path)
        assert got.count() == got.select("doc_id", "pre").distinct().count() > 0
    # Only elements have ids: attributes and texts aren't joined to be found.
    found = plan(x.select("id(//lineitem[1]/@part)"))
    assert found.count("FileScan parquet") <= 12


def test_closure_takes_no_round_a_step(spark):
    from unittest import mock

    from treeline.operators import graph

    for way in (1, -1):
        edges = spark.range(1, 200).selectExpr(f"{way} * id AS src", f"{way} * (id - 1) AS dst")
        with mock.patch.object(graph, "settle", side_effect=graph.settle) as settled:
            got = {tuple(r) for r in graph.closure(edges).collect()}
        assert got == {(way * a, way * b) for a in range(200) for b in range(a)} and settled.call_count <= 2
    assert graph.closure(edges.limit(0)).collect() == []


def test_layers_read_dependencies_in_turns_and_settle_what_is_held(spark, monkeypatch):
    """Both directions along the keys, cycles, and less room than dependencies that wait."""
    import random
    from unittest import mock

    import numpy as np

    from treeline.operators import graph

    draw = random.Random(5)
    rank = list(range(120))
    draw.shuffle(rank)
    edges = [(a, b) for a in range(120) for b in draw.sample(range(120), 4) if rank[b] < rank[a]]
    below = {a: [b for x, b in edges if x == a] for a in range(120)}
    want = {}
    for a in sorted(range(120), key=rank.__getitem__):
        want[a] = max((want[b] + 1 for b in below[a]), default=0)
    ring = [*edges, (200, 201), (201, 200), (202, 201), (None, 3), (4, None), (5, 5), (6, 999)]
    nodes = spark.createDataFrame([(k,) for k in [*range(120), 200, 201, 202, None]], "node long")
    with mock.patch.object(graph, "settle", side_effect=graph.settle) as calls:
        got = {r.node: r.depth for r in graph.layers(nodes, spark.createDataFrame(ring, "src long, dst long")).collect()}
    assert got == want | {None: 0} | dict.fromkeys((200, 201, 202), max(want.values()) + 1) and calls.call_count <= 2
    monkeypatch.setattr(graph, "BLOCK", 9)
    folder = graph.by_number(spark.createDataFrame([e for e in edges], "s int, d int"), 120)
    depths = np.array([-1 if below[a] else 0 for a in range(120)], np.int32)
    graph.settled(folder, depths)
    assert depths.tolist() == [want[a] for a in range(120)]


def test_parts_without_a_key_are_no_dependency(spark, tmp_path):
    from treeline.plans import work

    spark.createDataFrame([(None, 1), (None, 2), (7, 3), (7, 3), (7, 1), (7, None), (8, 5)], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {tuple(r) for r in work.dag(spark, str(tmp_path)).collect()} == {(3, 1)}


def test_rows_that_told_their_place_are_not_sorted_among_children(spark):
    """Of a sound document each row goes on once, a number that is there twice goes on at its own place too."""
    from treeline.operators import consistency
    from treeline.sources import markup

    n = markup.xml_nodes(spark.createDataFrame([(1, "<a b='1' c='2'><d>x</d><e/></a>")], "doc_id long, text string")).localCheckpoint()
    twice = n.unionByName(n.where("name = 'e'"))
    assert consistency.faults(n).count() == 0
    assert {r.fault for r in consistency.faults(twice).collect()} == {"number twice", "overlaps its sibling"}
    lines = consistency.faults(n)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [k for k, line in enumerate(lines) if "Window [" in line]
    kept = [k for k, line in enumerate(lines) if "Filter" in line and "same#" in line and "child#" in line]
    assert kept and any(windows[0] < k < windows[-1] for k in kept)
