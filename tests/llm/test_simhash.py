import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.llm import simhash


def slow_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, errors):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= errors:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k), ids[k]) for k in range(len(ids))]


@pytest.mark.parametrize("text", ["", " \t\n", "One", "a b c", "a b c d", "a b c d e A B c É é", "word " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 255)), max_size=40), st.integers(0, 4))
def test_trie_join_finds_all_pairs(rows, errors):
    rows = sorted({(g, s, v * 0x0101010101010101 % 2**64) for g, s, v in rows})
    groups, sides, fps = (np.array([r[k] for r in rows], t) for k, t in ((0, np.int64), (1, np.int64), (2, np.uint64)))
    got = set()
    for i, j in simhash.pairs_within(fps, groups, sides, errors):
        got |= {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    two = {g for g in set(groups.tolist()) if len({s for h, s, _ in rows if h == g}) == 2}
    want = {(a, b) for b in range(len(rows)) for a in range(b) if groups[a] == groups[b] and (sides[a] != sides[b] if groups[a] in two else True) and (int(fps[a]) ^ int(fps[b])).bit_count() <= errors}
    assert got == want


def near(rng, base, flips):
    for b in rng.choice(64, flips, replace=False):
        base ^= 1 << int(b)
    return base


def test_links_by_buckets_connect_what_brute_force_connects(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)  # many parts
    rng = np.random.default_rng(1)
    seeds = [int(x) for x in rng.integers(0, 2**63, 30)]
    fps = list(dict.fromkeys([near(rng, s, int(rng.integers(0, 5))) for s in seeds for _ in range(12)]))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    from treeline.llm.common import components

    edges = simhash.link_buckets(spark.createDataFrame([(f,) for f in signed], "fp long"), 4)
    root = {r.node: r.root for r in components(edges).collect()}
    want = slow_components(list(range(len(fps))), fps, 4)
    mine = [root.get(f, f) for f in signed]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_query_agrees_with_brute_force(spark, small):
    from treeline.llm.queries import op2_simhash

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    fps = [slow_fingerprint(t) for _, t in docs]
    want = {i: (f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, slow_components([i for i, _ in docs], fps, 4), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash(spark, small).collect()} == want


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (9, " "), (2, "One two"), (7, "one TWO"), (7, "one TWO"), (None, "one two"), (None, "alone in the world now"), (1, "x y z " * 20000)]
    docs = spark.createDataFrame([(*r, 0, "z") for r in rows], "doc_id long, text string, fp int, Component_Id string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    fps = [slow_fingerprint(t) for _, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, slow_components([i for i, _ in rows], fps, 4), strict=True)), key=str)
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_keep_one(spark):
    rows = [(5, "same words here again", "a"), (3, "same words here again", "b"), (3, "same words here again", "b"), (8, "quite another text of its own", "c"), (None, "no id at all in this one", "d"), (None, "no id at all in this one", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(3, "same words here again"), (8, "quite another text of its own"), (None, "no id at all in this one")], key=str)


def test_keep_one_of_each_group_when_ids_repeat(spark):
    near, far, other = "same words here again", "quite another text of its own", "and one that is like no other"
    rows = [(5, near), (5, far), (5, far), (7, other), (3, "Same words here AGAIN"), (9, "first of an id twice"), (9, "second text, which is unlike"), (None, "No id in this one"), (None, "no id in this ONE")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text.lower()) for r in out.collect()), key=str)
    assert got == sorted([(3, near), (5, far), (7, other), (9, rows[5][1]), (9, rows[6][1].lower()), (None, "no id in this one")], key=str)


def test_hot_groups_join_alike(spark, monkeypatch):
    rows = [(k, "the same words over and over again", "s") for k in range(60)] + [(100 + k, f"text number {k} of many others {k * 7}", "s") for k in range(40)] + [(None, "", "s"), (None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(map(str, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash.common, "HOT_ROWS", 5)
    monkeypatch.setattr(simhash.common, "HOT_KEYS", 50)
    assert sorted(map(str, simhash.near_duplicates(docs).collect())) == one
