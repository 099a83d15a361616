import corpus_pipeline
from treeline.llm import bpe, decontaminate, pii, simhash, toxicity
from treeline.llm.queries import oracle_sql, queries


def test_stages_keep_columns_and_take_effect(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, bench = spark.read.parquet(f"{small}/labels.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        held = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, small).write.parquet(f"file://{tmp_path}/{k}")
        out = spark.read.parquet(f"file://{tmp_path}/{k}")
        got = {r.doc_id: r for r in out.collect()}
        if k < 4:
            assert sorted(out.columns) == sorted(docs.columns)
        if k == 0:
            assert set(got) == {r.doc_id for r in toxicity.score(docs, labels).collect() if not r.predicted}
        elif k == 1:
            near = simhash.near_duplicates(docs).collect()
            assert set(got) == {r.component_id for r in near}
        elif k == 2:
            assert set(got) == {r.doc_id for r in decontaminate.contamination(docs, bench).collect() if not r.contaminated}
        elif k == 3:
            p = pii.Permuter(pii.EXAMPLE_KEY)
            assert {i: r.text for i, r in got.items()} == {i: pii.pseudonyms(r.text, p) for i, r in held.items()}
        else:
            assert {i: r.n_tokens for i, r in got.items()} == {r.doc_id: r.n_tokens for r in bpe.encode_decode(docs, corpus_pipeline.tokenizer_path()).collect()}
        docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, small).collect()} == set(got)


def test_stages_take_odd_rows(spark, small):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "mail x@y.example.com", "en", "s", 3)]
    docs = spark.createDataFrame([(*r, "more") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_tokens string")
    kept = lambda df: sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.n_tokens) for r in df.collect()), key=str)
    everything = sorted([(*r, "more") for r in rows], key=str)
    stages = dict(corpus_pipeline.STAGES)
    assert kept(stages["toxicity"](spark, docs, small)) == everything
    assert kept(stages["decontamination"](spark, docs, small)) == everything
    # Texts without words are copies of each other, as are the two rows that are equal.
    near = kept(stages["near_duplicates"](spark, docs, small))
    assert [r for r in near if r in everything] == near and sorted((r[1] or "") for r in near) == ["", "a b c", "mail x@y.example.com"]
    private = {r.doc_id: (r.text, r.n_chars, r.n_tokens) for r in stages["pii"](spark, docs, small).collect()}
    image = pii.pseudonyms("mail x@y.example.com", pii.Permuter(pii.EXAMPLE_KEY))
    assert private == {1: (None, None, "more"), 2: ("", 0, "more"), 3: ("a b c", 5, "more"), None: (image, len(image), "more")}
    assert sorted(((r.doc_id, r.n_tokens) for r in stages["bpe"](spark, docs, small).collect()), key=str) == sorted([(1, 0), (2, 0), (3, 3), (3, 3), (None, 8)], key=str)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), small).collect() == []


def test_second_tables_may_have_clashing_names(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    labels = spark.read.parquet(f"{small}/labels.parquet")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    more = lambda df, *names: df.selectExpr("*", *[f"'x' AS {n}" for n in names])
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(toxicity.score(docs, more(labels, "text", "score", "TOXIC"))) == plain(toxicity.score(docs, labels))
    assert plain(decontaminate.contamination(docs, more(bench, "doc_id", "n_hit", "TEXT"))) == plain(decontaminate.contamination(docs, bench))
    assert plain(decontaminate.decontaminate(docs, more(bench, "doc_id", "TEXT"))) == plain(decontaminate.decontaminate(docs, bench))


def test_every_operator_has_a_query():
    names = set(queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and set(oracle_sql()) <= names
