import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from treeline.llm import runs
from treeline.llm.queries import queries


def brute(words, least=12):
    """All runs by looking at every period and stretch."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        s = 0
        while s + p < n:
            if words[s] != words[s + p]:
                s += 1
                continue
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e + p - s >= max(least, 2 * p):
                found.setdefault((s, e + p), p)
            s = e + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def rebuilt(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def expected(doc_id, text):
    words = rebuilt(doc_id, text)
    found = brute(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    collapsed = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest())


def found(lists, least=12):
    sizes = np.array([len(x) for x in lists], np.int64)
    start, end, period = runs.find_runs(np.array([w for x in lists for w in x], np.int64), sizes, least)
    ends = np.cumsum(sizes)
    whose = np.searchsorted(ends, start, "right")
    out = [[] for _ in lists]
    for d, s, e, p in zip(whose, start, end, period, strict=True):
        first = ends[d] - sizes[d]
        out[d].append((int(s - first), int(e - s), int(p)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=5), st.integers(2, 12))
def test_runs_of_few_words_are_those_of_brute_force(lists, least):
    assert found(lists, least) == [brute(x, least) for x in lists]


def test_structured_sequences():
    rng, lists = random.Random(4), []
    for _ in range(60):
        words = []
        while len(words) < 150:
            part = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
            words += part * rng.randint(1, 7)
        lists.append(words)
    fib = [0], [0, 1]
    while len(fib[1]) < 300:
        fib = fib[1], fib[1] + fib[0]
    lists += [fib[1], [5] * 400, [], [1], [7] * 11, [7] * 12, list(range(300)) * 2, list(range(300)) * 2 + [0, 1, 2]]
    assert found(lists) == [brute(x) for x in lists]


def test_small_blocks_change_nothing(monkeypatch):
    rng = random.Random(9)
    lists = [[rng.randrange(2) for _ in range(200)], [3] * 150, [rng.randrange(50) for _ in range(100)]]
    want = found(lists)
    monkeypatch.setattr(runs, "BLOCK", 7)
    assert found(lists) == want


def test_range_minima():
    rng = np.random.default_rng(1)
    for n in (1, 15, 16, 17, 500):
        values = rng.integers(0, 50, n)
        held = runs.RangeMin(values)
        low = rng.integers(0, n, 800)
        high = np.minimum(n - 1, low + rng.integers(0, n, 800))
        assert held.least(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high, strict=True)]


def test_query_agrees_with_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len((r.text or "").split()) < 3000}
    got = {r.doc_id: tuple(r) for r in queries()["op12_runs"](spark, small).collect()}
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert sum(r[1] > 0 for r in got.values()) > 10
    for i, text in docs.items():
        assert got[i] == expected(i, text)


def test_odd_rows(spark):
    texts = [None, "", " \n\t ", "a", "a " * 12, "a b " * 6, "a b " * 20, "x y z\x0b" * 50_000, "é ß " * 9 + "end", "a " * 12, "n\x00 m " * 8]
    rows = [(7 * k if k else None, t) for k, t in enumerate(texts)] + [(7, "")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, runs int, TEXT string")
    got = sorted(map(tuple, runs.summary(runs.periodic_runs(docs, rewrite=runs.repeated_tail)).collect()), key=str)
    short = [(i, t) for i, t in rows if len(t or "") < 1000]
    assert [r for r in got if r[0] != 49] == sorted((expected(i, t) for i, t in short), key=str)
    assert [r[1:6] for r in got if r[0] == 49] == [(1, 0, 150_000, 3, 50_000_000)]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    real = {r.doc_id: (r.n_words, len(r.runs), r.collapsed) for r in runs.periodic_runs(docs).collect()}
    assert real[28] == (12, 1, "a") and real[56] == (19, 1, "é ß end") and real[None] == (0, 0, "")
