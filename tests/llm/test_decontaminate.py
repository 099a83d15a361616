import hashlib
import re

import numpy as np

from treeline.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items):
    windows = []
    for item, text in items:
        w = slow_words(text)
        n = min(13, len(w))
        windows += [(item, w[k : k + n]) for k in range(len(w) - n + 1 if w else 0)]
    out = []
    for i, text in docs:
        w, hit, found = slow_words(text), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found |= {str(item)} if item is not None else set()
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


LONG = " ".join(f"w{k}" for k in range(30))
DOCS = [
    (1, None), (2, ""), (3, "nothing here"), (4, f"before, {LONG.upper()}! after"), (5, "W1-w2 short item"), (6, LONG[:60]), (7, "short ITEM. short item"), (7, "short ITEM. short item"),
    (8, "filler " * 2000 + "short item"), (9, "éa ½x ünd"), (None, LONG), (10, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 x w12"),
]
ITEMS = [(1, LONG), (2, "Short item"), (3, None), (4, "  ..  "), (5, "short item"), (2, "short item"), (None, "ünd"), (10, "éa ½x")]


def frames(spark):
    docs = spark.createDataFrame([(*d, 1, "q") for d in DOCS], "doc_id long, text string, n_hit int, Items string")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    assert rows(dc.contamination(*frames(spark))) == sorted(slow(DOCS, ITEMS), key=str)


def test_several_passes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(dc, "PASS_WORDS", 20)
    docs, items = frames(spark)
    assert dc.passes(items)[1] > 1
    assert rows(dc.contamination(docs, items)) == sorted(slow(DOCS, ITEMS), key=str)
    kept = sorted(((r.doc_id, r.text) for r in dc.decontaminate(docs, items).collect()), key=str)
    bad = {d[0] for d in slow(DOCS, ITEMS) if d[5]}
    assert kept == sorted(((i, t) for i, t in DOCS if i not in bad), key=str)


def test_removal(spark):
    docs, items = frames(spark)
    out = dc.decontaminate(docs, items)
    assert out.columns == docs.columns
    want = [d[:2] for d, s in zip(DOCS, slow(DOCS, ITEMS), strict=True) if not s[5]]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)


def test_several_passes_remove_rows_by_their_own_hits(spark, monkeypatch):
    rows_ = [*DOCS, (None, "clean without an id"), (4, "clean with the id of a contaminated row"), (None, None)]
    docs = spark.createDataFrame([(*d, 1, "q") for d in rows_], "doc_id long, text string, n_hit int, Items string")
    items = frames(spark)[1]
    want = sorted((d for d, s in zip(rows_, slow(rows_, ITEMS), strict=True) if not s[5]), key=str)
    for most in (2_000_000, 20):
        monkeypatch.setattr(dc, "PASS_WORDS", most)
        out = dc.decontaminate(docs, items)
        assert (dc.passes(items)[1] > 1) == (most == 20) and out.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want


def test_texts_stay_where_they_are_over_several_passes(spark, monkeypatch, tmp_path):
    """No exchange carries a text, for counts and for rows, and few hits are broadcast; many give the same rows."""
    import re

    monkeypatch.setattr(dc, "PASS_WORDS", 20)
    monkeypatch.setattr(dc.common, "settle", lambda df: df.sparkSession.createDataFrame(df.collect(), df.schema))
    docs, items = frames(spark)
    docs.write.parquet(f"file://{tmp_path}/d")
    docs = spark.read.parquet(f"file://{tmp_path}/d")
    for out in (dc.contamination(docs, items), dc.decontaminate(docs, items)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.split("\n") if re.search(r"(?<!Broadcast)Exchange", line)]
        assert "BroadcastExchange" in plan and not [e for e in exchanges if "hashpartitioning" in e]
    want = rows(dc.contamination(docs, items)), sorted(map(str, dc.decontaminate(docs, items).collect()))
    monkeypatch.setattr(dc, "BROADCAST", 0)
    assert (rows(dc.contamination(docs, items)), sorted(map(str, dc.decontaminate(docs, items).collect()))) == want


def test_spans_are_cut_in_any_number_of_passes(spark, monkeypatch):
    docs, items = frames(spark)
    one = {(r.doc_id, r.cleaned) for r in dc.contamination(docs, items, spans=True).collect()}
    monkeypatch.setattr(dc, "PASS_WORDS", 20)
    assert {(r.doc_id, r.cleaned) for r in dc.contamination(docs, items, spans=True).collect()} == one


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(dc, "hashed", lambda ids, starts, length, factor=None: np.zeros(len(starts), np.uint64))
    held = dc.Index([(str(i), t) for i, t in ITEMS if i is not None])
    texts = [t or "" for _, t in DOCS]
    _, hit, found = dc.scanned(texts, held)
    for k, ((_, _, n_hit, _, names, _), t) in enumerate(zip(slow(list(enumerate(texts)), [x for x in ITEMS if x[0] is not None]), texts, strict=True)):
        assert int(hit[k].sum()) == n_hit and hashlib.sha256(",".join(sorted(found.get(k, ()))).encode()).hexdigest() == names, t


def test_many_equal_items_are_one_window():
    held = dc.Index([(str(k), LONG) for k in range(2_000)])
    assert len(held.lengths) == 1 and len(held.lengths[0].hashes) == 18
    n, hit, found = dc.scanned([f"x {LONG} y"], held)
    assert (n.tolist(), int(hit[0].sum()), len(found[0])) == ([32], 30, 2_000)


def test_spans_are_cut(spark):
    docs, items = frames(spark)
    cleaned = {r.doc_id: r.cleaned for r in dc.contamination(docs, items, spans=True).collect()}
    assert cleaned[4] == "before, ! after" and cleaned[3] == "nothing here" and cleaned[5] == "W1-w2 "


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert dc.contamination(docs.limit(0), items).collect() == []
    assert not any(r.contaminated or r.n_items for r in dc.contamination(docs, items.limit(0)).collect())
