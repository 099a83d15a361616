from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.operators import codec, graph, nodes, textsearch
from treeline.plans.xpath import XPath
from treeline.sources import markup


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=20), st.integers(5, 9))
def test_code_lengths_are_a_prefix_code_within_the_limit(counts, most):
    lengths = codec.code_lengths(counts, most)
    assert all((n > 0) == (c > 0) for n, c in zip(lengths, counts, strict=True)) and max(lengths) <= most
    assert sum(2.0**-n for n in lengths if n) <= 1


def test_code_lengths_are_huffman_when_free():
    assert codec.code_lengths([45, 13, 12, 16, 9, 5], 15) == [1, 3, 3, 3, 4, 4]


def test_layers_with_a_cycle(spark):
    n = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")], "src string, dst string")
    assert {r.node: r.depth for r in graph.layers(n, e).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 3}


def test_closure_of_a_ring(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert graph.closure(e).count() == 9


def test_patches():
    patch = "<<<<<<< SEARCH\nb\n=======\nX\nY\n>>>>>>> REPLACE"
    assert textsearch.apply_patch("a\nb\nb", patch) == ("a\nX\nY\nb", None)
    assert textsearch.apply_patch("a", "no block")[1] == "no search block"
    assert textsearch.parse_patch(patch) == [("b", "X\nY")]


def test_serialize_gives_back_the_document(spark):
    source = '<a x="1 &lt; 2"><b/>t &amp; u<c><!-- n --><d>v</d></c><?p q?></a>'
    n = markup.xml_nodes(spark.createDataFrame([(1, source)], "doc_id long, text string"))
    assert nodes.serialize(n, n.name == "a").first().xml == source


def test_pattern_equals_path(spark):
    n = markup.xml_nodes(spark.createDataFrame([(1, "<a><b><c/><b><c k='1'/></b></b><c/></a>")], "doc_id long, text string"))
    for pattern, path in (("b/c", "//b/c"), ("/a//c", "/a//c"), ("c/@k", "//c/@k"), ("b//c | a", "//b//c | /a"), ("/c", "/c")):
        assert {r.pre for r in nodes.matching(n, pattern).collect()} == {r.pre for r in XPath(n).select(path).collect()}


def test_prompt_includes(tmp_path):
    import pytest

    from treeline.sources import files

    (tmp_path / "a.md").write_text("top {{include: b.md}} {{include: c*.txt}}")
    (tmp_path / "b.md").write_text("B")
    (tmp_path / "c1.txt").write_text("C1")
    (tmp_path / "c2.txt").write_text("C2")
    assert files.expand_prompt(str(tmp_path / "a.md")) == 'top <file name="b.md">\nB\n</file> <file name="c1.txt">\nC1\n</file>\n<file name="c2.txt">\nC2\n</file>'
    (tmp_path / "b.md").write_text("{{include: a.md}}")
    with pytest.raises(ValueError):
        files.expand_prompt(str(tmp_path / "a.md"))
    assert files.find_config(str(tmp_path), "b.md") == str(tmp_path / "b.md") and files.find_config(str(tmp_path), "no-such-file-here") is None


def test_source_tree_and_listing(spark, tmp_path):
    import lzma

    from treeline.sources import files

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.c").write_text("int x;")
    (tmp_path / "sub" / "b.h").write_text("int y;")
    (tmp_path / "png.c").write_text("skipped")
    (tmp_path / "notes.txt").write_text("no source")
    (tmp_path / "z.xz").write_bytes(lzma.compress(b"packed"))
    assert {r.text for r in files.source_files(spark, str(tmp_path)).collect()} == {"int x;", "int y;"} or "png" in str(tmp_path)
    assert [r.path for r in files.listing(spark, str(tmp_path), (".c", ".h")).collect()] == ["a.c", "png.c", "sub/b.h"]
    blob = spark.read.format("binaryFile").load(f"{tmp_path}/z.xz")
    assert bytes(blob.select(files.expand_compressed(blob.content, blob.path).alias("b")).first().b) == b"packed"


def test_toolbox_schema():
    from treeline.operators.toolbox import Toolbox

    box = Toolbox(context=5)

    @box.register
    def scaled(x: float, times: int = 2, *, ctx) -> float:
        """x times."""
        return x * times + ctx

    schema = box.tools["scaled"].schema()
    assert schema["parameters"]["required"] == ["x"] and schema["parameters"]["properties"]["times"] == {"type": "integer"} and schema["description"] == "x times."
    assert box.call("scaled", {"x": 2}) == {"result": 9} and "error" in box.call("scaled", {"x": "2"})


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=60).flatmap(lambda b: st.just(b * 3 + b[:7])))
def test_lz77_round_trip(data):
    from treeline.operators import lz

    store = lz.matches(data)
    assert lz.expand(store) == data
    at = [0, *lz.cuts(store), len(store)]
    assert sum(lz.dynamic_bits(store[a:b]) for a, b in zip(at, at[1:])) <= lz.dynamic_bits(store)


def test_block_cuts_follow_the_data():
    from treeline.operators import lz

    store = [(97 + k % 2, 0) for k in range(400)] + [(k % 200, 0) for k in range(400)]
    assert lz.cuts(store) and min(abs(c - 400) for c in lz.cuts(store)) < 25 and lz.length_code(258) == (285, 0) and lz.distance_code(32768) == (29, 13)


def test_components_of_random_graphs(spark):
    import random

    rng = random.Random(11)
    for n, m in ((8, 10), (30, 45), (12, 40)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {a: {a} for a in {x for e in edges for x in e}}
        for _ in range(n):
            for a, b in edges:
                for s in reach.values():
                    if a in s:
                        s.add(b)
        want = {}
        for a in reach:
            mine = {b for b in reach[a] if a in reach[b]}
            want[a] = (min(mine), len(mine))
        got = graph.strong_components(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()
        assert {r.node: (r.component, r.size) for r in got} == want


def test_roots_inside_roots(spark):
    n = markup.xml_nodes(spark.createDataFrame([(1, "<a><a>x<b/></a>y<a/><a><a>z</a></a></a>"), (2, "<c><a>p</a><a>q</a></c>")], "doc_id long, text string"))
    xml = {(r.doc_id, r.pre): r.xml for r in nodes.serialize(n, n.name == "a").collect()}
    text = {(r.doc_id, r.pre): r.string_value for r in nodes.string_values(n, n.name == "a").collect()}
    assert sorted(xml.values()) == sorted(["<a><a>x<b/></a>y<a/><a><a>z</a></a></a>", "<a>x<b/></a>", "<a/>", "<a><a>z</a></a>", "<a>z</a>", "<a>p</a>", "<a>q</a>"])
    assert sorted(text.values()) == sorted(["xyz", "x", "", "z", "z", "p", "q"])


def test_deltas_over_several_files(spark, tmp_path):
    from treeline.registry import registry

    rows = [(c, t, "user", f"{c}.{t};") for c in range(6) for t in range(c + 1)]
    for k in range(4):  # every conversation's turns are in several files, the later ones first
        spark.createDataFrame(rows[::-1][k::4], "conv_id long, turn long, role string, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.n, r.content) for r in registry.queries()["r06_stream_deltas"](spark, str(tmp_path)).collect()}
    assert got == {c: (c + 1, "".join(f"{c}.{t};" for t in range(c + 1))) for c in range(6)}


def test_cheapest_parse():
    from treeline.operators import lz

    for data in (b"", b"a", b"abcabcabcabcabd" * 9, bytes(range(256)) * 2, b"the cat sat on the mat, the cat sat on the hat; " * 6):
        store = lz.matches(data)
        best = lz.squeeze(data, store)
        assert lz.expand(store) == data and lz.expand(best) == data and lz.dynamic_bits(best) <= lz.dynamic_bits(store)


def test_smoothed_counts():
    assert codec.smooth([]) == [] and codec.smooth([0, 0]) == [0, 0]
    assert codec.smooth([5] * 7 + [9]) == [5] * 7 + [9]
    assert codec.smooth([10, 11, 12, 13, 0, 0]) == [12, 12, 12, 12, 0, 0]
    assert codec.smooth([1, 0, 1, 0, 50]) == [1, 1, 1, 1, 50]
    assert codec.smooth([9, 0, 0, 0, 0, 0, 9]) == [9, 0, 0, 0, 0, 0, 9]
    assert codec.smooth([40, 0, 0, 0, 40]) == [40, 0, 0, 0, 40]
