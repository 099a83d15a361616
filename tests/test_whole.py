"""Queries hold all rows of their tables, not a part chosen to be cheap."""

import base64
import hashlib
import random
import zlib

from treeline.operators import graph
from treeline.registry import registry


def written(spark, path, **tables):
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_dependencies_of_all_parts(spark, tmp_path):
    rng = random.Random(3)
    lines = [(p, rng.randrange(1, 13)) for p in range(1, 25) for _ in range(3)]
    suppliers = [(s, -1.0 if s in (3, 7) else 1.0) for s in range(1, 15)]
    d = written(spark, tmp_path, lineitem=(lines, "l_partkey long, l_suppkey long"), supplier=(suppliers, "s_suppkey long, s_acctbal double"))
    edges = set()
    for p in {p for p, _ in lines}:
        s = sorted({s for q, s in lines if q == p})
        edges |= set(zip(s[1:], s))
    below, depth = {}, {}
    for s, _ in suppliers:  # what a supplier depends on has a lower key
        near = [b for a, b in edges if a == s]
        below[s] = set(near).union(*(below[n] for n in near))
        depth[s] = 1 + max((depth[n] for n in near), default=-1)
    q = registry.queries()
    assert sorted(map(tuple, q["g03_closure"](spark, d).collect())) == sorted((s, t) for s in below for t in below[s])
    assert {r.node: r.depth for r in q["g04_layers"](spark, d).collect()} == depth
    assert sorted(r.node for r in q["g07_failures"](spark, d).collect()) == sorted(s for s in below if (below[s] | {s}) & {3, 7})


def test_layers_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 6)
    n = spark.createDataFrame([(x,) for x in "abcdefg"] + [(None,)], "node string")
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("d", "z"), ("e", "f"), ("f", "e"), ("g", "f"), ("g", "g")], "src string, dst string")
    assert {r.node: r.depth for r in graph.layers(n, e).collect()} == {"a": 0, None: 0, "b": 1, "c": 2, "d": 3, "e": 4, "f": 4, "g": 4}


def test_files_are_whole_up_to_50000_characters(spark, tmp_path):
    texts = ["a", "", None, "b" * 5_001, "c" * 50_000, "é" * 50_001]
    d = written(spark, tmp_path, documents=([(k, t, "x1") for k, t in enumerate(texts)] + [(9, "d", "x2")], "doc_id long, text string, source string"))
    want = dict(enumerate(texts)) | {5: "é" * 50_000 + "\n\n... [File truncated for analysis] ..."}
    assert {r.doc_id: r.content for r in registry.queries()["s24_collect_files"](spark, d).collect()} == want


def test_whole_texts_are_encoded(spark, tmp_path):
    texts = ["", None, "short", "é" * 51, "long text, " * 3_000]
    d = written(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    data = {k: None if t is None else t.encode() for k, t in enumerate(texts)}
    want = {k: (None, None) if b is None else (base64.b64encode(b).decode(), b.hex().upper()) for k, b in data.items()}
    assert {r.doc_id: (r.b, r.h) for r in registry.queries()["k04_base64_hex"](spark, d).collect()} == want


def test_every_order_is_parsed(spark, tmp_path):
    d = written(spark, tmp_path, orders=([(k, "O", "1-URGENT", 1.5) for k in range(1, 10)], "o_orderkey long, o_orderstatus string, o_orderpriority string, o_totalprice double"))
    assert sorted(map(tuple, registry.queries()["s06_recover"](spark, d).collect())) == [(k, "o", k % 3 == 0) for k in range(1, 10)]


def test_short_texts_are_round_tripped(spark, tmp_path):
    texts = ["", "a", "short text", "b" * 60, "word " * 100, "word " * 300]
    d = written(spark, tmp_path, documents=(list(enumerate(texts)), "doc_id long, text string"))
    digests = [hashlib.md5(t.encode()).hexdigest() for t in texts]
    want = [(k, m, m, m, len(t.encode()), len(t) > 1000) for k, (t, m) in enumerate(zip(texts, digests, strict=True))]
    assert {w[5] for w in want} == {True, False} and len(zlib.compress(texts[-1].encode())) < 600
    assert sorted(map(tuple, registry.queries()["c01_round_trip"](spark, d).collect())) == want
