import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from treeline.llm import unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces, fallback):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace()
    return t


@pytest.fixture(scope="module")
def pieces():
    return unigram.vocabulary(PATH)


def test_real_vocabulary_agrees(spark, small, pieces):
    ref, counter = library(pieces, True), unigram.UnigramCounter(pieces)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for t in [*texts, "", " ", "  a  b", "日本語 𝔘𝔫 😀😀ab", "<0x41> <unk> <s></s>", "\n\n\tx", "a▁b", "x" * 3000, "ﷺ ͸͹"]:
        assert counter.count(t)[0] == len(ref.encode(t).ids), t


TINY = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -3.0), ("bb", -1.5), ("▁ab", -4.0)]


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", max_size=14))
def test_ties_agree_with_the_library(text):
    assert unigram.UnigramCounter(TINY).count(text)[0] == len(library(TINY, False).encode(text).ids)


@pytest.fixture(scope="module")
def sentences():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_merges_agree_with_sentencepiece(spark, small, pieces, sentences):
    counter = unigram.MergeCounter(pieces)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for t in [*texts, "", " ", "  a  b ", "日本語 𝔘𝔫 😀😀ab", "<0x41> <unk> <s></s>", "\n\n\tx", "a▁b", "x" * 3000, "ﷺ ͸͹", *("q" + " " * k + "z" for k in range(70)), "日本" * 2000]:
        got = sentences.encode(t)
        count, score = counter.count(t)
        assert count == len(got), t
        assert abs(score - sum(sentences.get_score(i) for i in got if not sentences.is_unknown(i))) < 1e-3


def test_merges_of_random_pieces(pieces, sentences):
    rng, counter = random.Random(4), unigram.MergeCounter(pieces)
    held = [p.replace("▁", " ") for p in counter.scores]
    for k in range(4_000):
        t = "".join(rng.choice(held) if rng.random() < 0.8 else rng.choice("aeinst  \né日") for _ in range(rng.randint(1, 12)))
        assert counter.count(t)[0] == len(sentences.encode(t)), t
    for k in range(4_000):
        t = "".join(rng.choice("aestin ") for _ in range(rng.randint(1, 40)))
        assert counter.count(t)[0] == len(sentences.encode(t)), t


def test_long_parts_are_not_remembered(pieces):
    counter = unigram.MergeCounter(pieces)
    counter.count("x" * 5_000 + " word " + "語" * 5_000)
    assert max(map(len, counter.memo)) <= unigram.MEMO_CHARS


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_query_and_edge_cases(spark, pieces, sentences, kind):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "x"), (4, "word " * 40000), (5, "y" * 20_000)]
    docs = spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id long, text string, n_tokens int, Counter string")
    ref = library(pieces, True)
    size = (lambda t: len(sentences.encode(t))) if kind == "bpe" else (lambda t: len(ref.encode(t).ids))
    got = sorted(((r.doc_id, r.n_chars, r.n_tokens) for r in unigram.token_counts(docs, PATH, kind=kind).collect()), key=str)
    assert got == sorted(((i, len(t or ""), size(t or "")) for i, t in rows), key=str)
    assert unigram.token_counts(docs.limit(0), PATH, kind=kind).collect() == []
