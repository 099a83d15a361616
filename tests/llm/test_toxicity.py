import zlib

import numpy as np

from treeline.llm import toxicity


def language(texts):
    counts = np.zeros((28, 28, 28))
    for t in texts:
        s = toxicity.symbols(t)
        np.add.at(counts, (s[:-2], s[1:-1], s[2:]), 1)
    return toxicity.log_model(counts)


MODEL = language(["you are an idiot and a stupid clown, what a worthless loser, the moron is pathetic"] * 50)


def test_viterbi_restores_disguised_words():
    for said, meant in (("1d10t", "idiot"), ("st00pid", None), ("m0r0n!!!", "moron"), ("l.o.s.e.r", "loser"), ("p@thetic", "pathetic"), ("cl0wn", "clown"), ("stuuuupiiid", "stupid"), ("s t u p i d", "stupid"), ("l-o-s-e-r", "loser")):
        got = toxicity.restore(said, MODEL)
        assert meant is None or got == meant, (said, got)


def test_plain_text_stays():
    for text in ("the cat sat", "version 4.0 of 2020", "aa bb", "été où ça"):
        assert toxicity.restore(text, MODEL) == text


def test_other_scripts_articles_doubles_and_numbers():
    assert toxicity.restore("m\u043er\u043en", MODEL) == "moron" and toxicity.restore("\uff49\uff44\uff49\uff4f\uff54", MODEL) == "idiot"
    assert toxicity.restore("\u043c\u043e\u0440\u043e\u0437", MODEL) == "\u043c\u043e\u0440\u043e\u0437"
    assert "clown" in toxicity.restore("you are a c l o w n today", MODEL).split()
    reader = toxicity.Reader(MODEL, {"=stupid": 0, "=idiot": 1, "=loser": 2, "=oil": 3})
    assert reader.text("a stuupid one")[0] == {0} and reader.text("looserr")[0] == {2} and reader.text("idiot")[0] == {1}
    assert reader.text("in 2020 or 1984 of 4")[0] == set()


def test_doubles_masks_and_spaces_are_read_into_beginnings():
    reader = toxicity.Reader(MODEL, {"idiot": 0, "stup": 1, "=cow": 2, "loser": 3})
    for text, want in (("an idiiot", {0}), ("stuupidity", {1}), ("id*ot", {0}), ("l**er", {3}), ("c o w", {2}), ("*idle* b*ld", set()), ("c*w", {2}), ("los*", set())):
        assert reader.text(text)[0] == want, text


def slow_decode(token):
    """All readings of a token, scored one by one."""
    found = {}

    def go(k, a, b, last, score, said):
        if k == len(token):
            total = score + (MODEL[a][b][0] if b else 0.0)
            found[said] = max(found.get(said, -1e9), total)
            return
        c = token[k]
        reads = [(c, 0.0)] if c.isalpha() else [(x, toxicity.ALIKE) for x in toxicity.LOOKALIKES.get(c, "")]
        for x, cost in reads:
            s = toxicity.symbol(x)
            go(k + 1, b, s, x, score + cost + MODEL[a][b][s], said + x)
            if x == last:
                go(k + 1, a, b, last, score + cost + toxicity.AGAIN, said)
        if not c.isalpha():
            go(k + 1, a, b, last, score + (toxicity.STRAY if reads else toxicity.BETWEEN), said)
            go(k + 1, b, 0, "", score + toxicity.ITSELF + (MODEL[a][b][0] if b else 0.0), said + " " if b else said)

    go(0, 0, 0, "", 0.0, "")
    return max(found.items(), key=lambda x: x[1])[0]


def test_viterbi_equals_exhaustive_search():
    for token in ("1d10t", "a1b", "l.0.l", "ss5s", "m0r0n", "!!a", "(l0wn", "aab1|"):
        assert toxicity.decode(token, MODEL) == slow_decode(token)


def test_held_out_accuracy_and_inputs(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, labels, model).collect()}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in out.items())
    held = [(out[i].predicted, y) for i, y in known.items() if i in out and out[i].held_out]
    assert np.mean([p == y for p, y in held]) >= 0.93
    # What isn't an input changes nothing: held-out labels, lang, source, ids of other rows.
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("lang", F.lit("xx")), flipped).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in out.items())


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "idiot", 3), (4, "clown " * 30000, 4), (5, "1d10t", 5), (5, "1d10t", 5)], "doc_id long, text string, SCORE int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 1e-6 and not r.predicted for r in toxicity.score(docs, none).collect())
    odd = spark.createDataFrame([(1, None), (1, 1), (1, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, odd).count() == 6
    assert toxicity.score(docs.limit(0), odd).collect() == []


def test_filter_keeps_columns(spark):
    rows = [(k, "you stupid idiot number " + "abcdefghij"[k % 10] if k % 3 == 0 else "a kind word " + "abcdefghij"[k % 10], "en", "s", 9) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    out = toxicity.keep_clean(docs, labels)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {k for k in range(300) if k % 3}


def slow_decode_with(token, model):
    """All readings of a token under any model, scored one by one."""
    found = {}

    def go(k, a, b, last, score, said):
        if k == len(token):
            total = score + (model[a][b][0] if b else 0.0)
            found[said] = max(found.get(said, -1e9), total)
            return
        c = token[k]
        looks = toxicity.LOOKALIKES.get(c, "")
        reads = [(c, 0.0)] + ([(toxicity.HOMOGLYPHS[c], toxicity.ALIKE)] if c in toxicity.HOMOGLYPHS else []) if c.isalpha() else [(x, toxicity.ALIKE) for x in looks]
        for x, cost in reads:
            s = toxicity.symbol(x)
            go(k + 1, b, s, x, score + cost + model[a][b][s], said + x)
            if x == last:
                go(k + 1, a, b, last, score + cost + toxicity.AGAIN, said)
        if not c.isalpha():
            go(k + 1, a, b, last, score + (toxicity.STRAY if reads else toxicity.BETWEEN), said)
            go(k + 1, b, 0, "", score + toxicity.ITSELF + (model[a][b][0] if b else 0.0), said + " " if b else said)

    go(0, 0, 0, "", 0.0, "")
    return max(found.items(), key=lambda x: x[1])[0]


def slow_features(text, model):
    """Words and beginnings of a text's tokens, each read by exhaustive search; and how many tokens."""
    import re

    tokens = toxicity.unspaced(text.lower()).split()
    said, doubled = set(), set()
    for t in tokens:
        bare = toxicity.EDGE.sub("", toxicity.EDGE.sub("", t))
        meant = slow_decode_with(bare, model) if toxicity.disguised(bare) else bare
        words = re.findall(r"[^\W\d_]+", meant)
        for w in words:
            said |= {"=" + w} | {w[:k] for k in range(4, min(9, len(w) + 1))}
            once = re.sub(r"([^\W\d_])\1+", r"\1", w)
            doubled |= ({"=" + once} | {once[:k] for k in range(4, min(9, len(once) + 1))}) if once != w else set()
        if toxicity.SIGNS.fullmatch(t):
            doubled |= {f for w in re.findall(r"[^\W\d_]+", slow_decode_with(t, model)) for f in ("=" + w, *(w[:k] for k in range(4, min(9, len(w) + 1))))}
        if re.fullmatch("[a-z]+[*][a-z]+", bare):
            at = bare.index("*")
            for c in "abcdefghijklmnopqrstuvwxyz":
                w = bare.replace("*", c)
                doubled |= {"=" + w} | {w[:k] for k in range(4, min(9, len(w) + 1)) if k > at + 1}
    return said, doubled, len(tokens)


def test_whole_result_against_brute_force(spark):
    """Counts, chosen features, fitted weights and every score, by plain loops over a small table."""
    import math
    from collections import Counter

    rng = np.random.default_rng(4)
    plain, bad = "river stone cloud garden winter letter music window".split(), ["clown", "cl0wn", "c.l.o.w.n", "moron", "m0r0n"]
    rows, marks = [], []
    for k in range(140):
        words = list(rng.choice(plain, 6)) + [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k % 6]}x"]
        if k % 3 == 0:
            words[int(rng.integers(0, 6))] = str(rng.choice(bad))
        rows.append((k, " ".join(rng.permutation(words))))
        marks.append((k, int(k % 3 == 0)))
    rows += [(500, None), (501, ""), (502, "a cllown, c l o w n!"), (505, "cl*wn, mo*on"), (506, "m o r o n x y z"), (503, "mоron 455 2020"), (None, "moron")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    # The character model.
    counts = Counter()
    for _, t in rows:
        s = [0, *(toxicity.symbol(c) for c in (t or "").lower()), 0]
        counts.update(zip(s, s[1:], s[2:]))
    got = toxicity.count_trigrams(docs)
    assert {(a, b, c): int(got[a, b, c]) for a, b, c in zip(*np.nonzero(got))} == {k: n for k, n in counts.items() if n}
    model = toxicity.fit(docs, labels)
    language = toxicity.log_model(got)
    assert np.allclose(model.language, language)
    # The features: tallied over the training rows, then those that tell.
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    toxic = dict(marks)
    train = [(i, t) for i, t in rows if i in toxic and not held(i)]
    kept, seen = [], [set() for _ in range(toxicity.SKETCHES)]
    for i, t in sorted(train):  # of copies one
        kept.append((i, t, toxicity.sketch(t).tolist()))
    for k in range(toxicity.SKETCHES):
        seen, left = set(), []
        for row in kept:
            if row[2][k] not in seen:
                seen.add(row[2][k])
                left.append(row)
        kept = left
    said = {i: slow_features(t, language) for i, t, _ in kept}
    n, b = Counter(f for s, _, _ in said.values() for f in s), Counter(f for i, (s, _, _) in said.items() if toxic[i] for f in s)
    rate = sum(toxic[i] for i in said) / len(said)
    gains = {f: b[f] * math.log(b[f] / n[f] / rate) + ((n[f] - b[f]) * math.log((n[f] - b[f]) / n[f] / (1 - rate)) if n[f] > b[f] else 0) for f in n if b[f] >= 4}
    told = {f for f, g in gains.items() if b[f] > 1.5 * rate * n[f] and g >= toxicity.GAIN + math.log(len(n))}
    same = lambda f, g: f in told and g in told and (b[f], n[f]) == (b[g], n[g])
    chosen = {f for f in told if not (same(f, f[1:][:8]) if f[0] == "=" else any(g[:-1] == f and g[0] != "=" and same(f, g) for g in told))}
    assert set(model.numbers) == chosen and chosen
    # The weights: where the penalised loss has no slope left.
    names, w = list(model.numbers), model.weights
    z = {i: sum(w[model.numbers[f]] for f in s if f in model.numbers) + model.length * (math.log1p(m) / 4 - 1.5) + model.bias for i, (s, _, m) in said.items()}
    g = {i: (1 / (1 + math.exp(-z[i])) - toxic[i]) / len(z) for i in z}
    slopes = [sum(g[i] for i in z if f in said[i][0]) + 1e-5 * w[model.numbers[f]] for f in names]
    assert max(map(abs, [*slopes, sum(g.values())])) < 1e-3
    # Every score.
    for r in toxicity.score(docs, labels, model).collect():
        text = next((t for i, t in rows if i == r.doc_id), None) or ""
        s, doubled, m = slow_features(text, language)
        numbers = {model.numbers[f] for f in s | doubled if f in model.numbers}
        total = sum(w[k] for k in numbers) + model.length * (math.log1p(m) / 4 - 1.5) + model.bias
        want = max(1 / (1 + math.exp(-total)), max((model.shares[k] for k in numbers), default=0.0))
        assert abs(r.score - want) < 1e-9 and r.held_out == held(r.doc_id), (r, want)
