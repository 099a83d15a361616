import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeline.llm import langid


def slow_grams(text):
    from collections import Counter

    kept, last = [], " "
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or last != " ":
            kept.append(c)
        last = c
    s = " " + "".join(kept).strip() + " "
    return Counter(s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1))


def test_grams_count_every_letter_run():
    for text in ("Ab, cd!", "é", "  x  ", "日本 𝔘a", "a-b--c"):
        assert langid.grams(text).sum() == sum(slow_grams(text).values()), text
    assert langid.grams("12 .") is None and (langid.grams("AB c") == langid.grams(" ab...C")).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.97
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "zz").otherwise(F.col("lang")))
    again = {r.doc_id: r.lang_pred for r in langid.identify(changed).collect()}
    assert all(again[r.doc_id] == r.lang_pred for r in out)


def test_nearest_centroid_equals_brute_force():
    rng = np.random.default_rng(0)
    idf = rng.random(langid.BUCKETS).astype(np.float32)
    texts = ["the cat and the dog", "der hund und die katze", "le chat et le chien", "123", ""]
    c = np.stack([langid.vector(langid.grams(t), idf) for t in texts[:3]])
    langs, scores, rejected = langid.Model(idf, ["en", "de", "fr"], c, np.array([0.99] * 3)).predict(texts)
    assert langs == ["en", "de", "fr", "und", "und"] and np.allclose(scores[:3], 1, atol=1e-5) and not scores[3:].any()
    assert rejected == [False, False, False, True, True]


def test_edge_cases(spark):
    rows = [(k, w * (k % 5 + 1), l) for k, (w, l) in enumerate([("the cat and ", "en"), ("der hund und ", "de")] * 40)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "42 !", "en"), (103, "the the cat", None), (None, "der und", "de"), (104, "the cat " * 20000, "en"), (104, "the cat " * 20000, "en")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, Score string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert (got[100], got[101], got[102], got[103], got[104], got[None]) == ("und", "und", "und", "en", "en", "de")
    assert langid.identify(docs).count() == len(rows + odd)
    assert langid.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def bucket_of(gram):
    """The bucket of an n-gram, by plain numbers."""
    mask, h = (1 << 32) - 1, ord(gram[0]) * 0x9E3779B1 & 0xFFFFFFFF
    for c, (shift, times, add) in zip(gram[1:], ((15, 0x85EBCA77, 0xC2B2AE3D), (13, 0x27D4EB2F, 0x165667B1))):
        h = ((h ^ h >> shift) * times + ord(c) * add) & mask
    return h >> (33 - langid.BUCKETS.bit_length())


def slow_predictions(rows):
    """Plain dictionaries: one centroid a language, cosine against each."""
    import math
    from collections import Counter

    counts = [Counter(bucket_of(g) for g, n in slow_grams(t or "").items() for _ in range(n)) if any(c.isalpha() for c in t or "") else None for _, t, _ in rows]
    train = [k for k, (i, _, l) in enumerate(rows) if l is not None and counts[k] and (i is None or zlib.crc32(str(i).encode()) % 5)]
    df = Counter(b for k in train for b in counts[k])
    idf = {b: math.log((1 + len(train)) / (1 + n)) + 0.1 for b, n in df.items()}

    def unit(v):
        size = math.sqrt(sum(x * x for x in v.values()))
        return {b: x / size for b, x in v.items()} if size else v

    vectors = [c and unit({b: math.log1p(n) * idf.get(b, 0.0) for b, n in c.items()}) for c in counts]
    centroids = {}
    for lang in sorted({rows[k][2] for k in train}):
        once = {rows[k][1]: vectors[k] for k in train if rows[k][2] == lang}
        total = Counter()
        for v in once.values():
            total.update(v)
        centroids[lang] = unit(total)
    out = []
    for v in vectors:
        scored = [(sum(x * c.get(b, 0.0) for b, x in v.items()), lang) for lang, c in centroids.items()] if v else []
        best = max(scored, key=lambda s: s[0], default=(0.0, "und"))
        out.append((best[1], min(1.0, max(0.0, best[0])), sorted((s for s, _ in scored), reverse=True)))
    return out


def test_whole_result_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = {"aa": "ba ke lo mi nu".split(), "bb": "strong works thrill".split(), "cc": "ño ñu éa çi".split(), "dd": ["𠀀𠀁", "𠀂"]}
    rows = [(int(k), " ".join(rng.choice(words[lang], rng.integers(1, 9))), lang) for k, lang in enumerate(rng.choice(list(words), 120))]
    rows += [(500, None, "aa"), (501, "12 .", "bb"), (502, "", None), (None, "ba ke", "aa"), (503, "𠀀", None), (504, "Strong ba", None)] + [rows[0]] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs, centroids=1)
    assert model.langs == sorted(words)
    got = sorted(langid.identify(docs, model).collect(), key=lambda r: (str(r.doc_id), r.score))
    want = sorted(zip(rows, slow_predictions(rows)), key=lambda r: (str(r[0][0]), r[1][1]))
    for r, ((i, _, _), (lang, score, scored)) in zip(got, want, strict=True):
        assert abs(r.score - score) < 1e-4, (r, score)
        if not scored or len(scored) < 2 or scored[0] - scored[1] > 1e-4:
            assert r.lang_pred == lang, (r, lang)


def test_repeated_rows_and_languages_of_one_text(spark):
    rows = [(1, "the cat and the dog", "en")] * 3_000 + [(3, "der hund", "de"), (4, "𠀀𠀁", "zh")]
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [zlib.crc32(str(k).encode()) % 5 > 0 for k in (1, 3, 4)] == [True] * 3
    assert got == {(1, "en"), (3, "de"), (4, "zh")}


@pytest.mark.parametrize("broadcast", [100_000, 10])
def test_every_value_of_lang_is_learned(spark, monkeypatch, broadcast):
    monkeypatch.setattr(langid, "BROADCAST", broadcast)
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 6))) for _ in range(600)]
    rows = [(4 * k + j, f"{words[k]} {words[k][:3]}", f"l{k:04d}") for k in range(600) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5}
    assert len(learned) > 595 and set(model.langs) == learned
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows if lang in learned) > 0.99 * len(rows)
