import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from treeline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "   ", "a", "It's we'll don'T", "<|endoftext|>x<|startoftext|> <|endoftext", "ＡＢＣ ǅ İstanbul ẞ ΑΣ ΣΑΣ", "é Å 12345 ½ ٣٤", "😀👩‍👩‍👧 ok!!!\u0000 x y", "日本語テキスト",
    "a'b's'S ''ll", "ſs't ŉ", "x" * 500, "ab" * 300 + "the" * 200, "\x1f\x1e a\x85b", "ß ŒÆ 𝔘𝔫𝔦", "the the the",
]


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.Tokenizer(PATH)


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    packed, decoded = np.asarray(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_coder_agrees_with_the_library(library, tokenizer):
    words = {w for t in ODD for w in tokenizer.words(t)}
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w.encode(): tuple(tokenizer.merge(w)) for w in sorted(words)[::2]}))
    for coder in (bpe.Coder(tokenizer, None), bpe.Coder(tokenizer, lexicon)):
        for text, ids in zip(ODD, coder.encode(ODD), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, text
            assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abehinorst'!.,12 \n<|>éß", max_size=60))
def test_random_texts_agree(text):
    library, coder = Library.from_file(PATH) if not held else held[0], held[1] if held else None
    if not held:
        coder = bpe.Coder(bpe.Tokenizer(PATH), None)
        held.extend([library, coder])
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


held: list = []


def disagreeing(library, coder, texts):
    wrong = []
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        for text, ids, want in zip(part, coder.encode(part), library.encode_batch(part, add_special_tokens=False), strict=True):
            if np.frombuffer(ids, "<u4").tolist() != want.ids:
                wrong.append(text)
    return wrong


def test_every_code_point(library):
    """Each alone between letters; those that are more than plain letters of large scripts in two more contexts."""
    import unicodedata

    coder = bpe.Coder(bpe.Tokenizer(PATH), None)
    every = [chr(c) for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    # Private and never assigned planes: forty characters a text.
    far = [c for c in every if not (c < "\U00034000" or "\U000e0000" <= c < "\U000e1000")]
    near = [c for c in every if c < "\U00034000" or "\U000e0000" <= c < "\U000e1000"]
    held = bpe.alphabet()
    special = set(held.otherwise + held.apart) | set(map(chr, held.lower)) | {chr(x + d) for r in (held.letters, held.numbers, held.blanks) for ab in r for x in ab for d in (-1, 0, 1) if x + d > 0x7F and not 0xD800 <= x + d < 0xE000}
    kinds = [c for k, c in enumerate(near) if c in special or k % 16 == 0 or unicodedata.category(c) not in ("Lo", "Cn", "Co")]
    wrong = disagreeing(library, coder, [f"a{c}b{c}1" for c in near] + ["a".join(far[k : k + 40]) for k in range(0, len(far), 40)])
    for form in ("{0}'s \u0301{0}\u0315\u0300", "Z{0}{0}9!{0}"):
        wrong += disagreeing(library, coder, [form.format(c) for c in kinds])
    assert not wrong, (len(wrong), wrong[:10])


def test_texts_of_many_scripts(library):
    held = bpe.alphabet()
    rng, coder = random.Random(5), bpe.Coder(bpe.Tokenizer(PATH), None)
    odd = held.otherwise + held.apart + "".join(map(chr, held.lower)) + "".join(chr(a) + chr(b) for r in (held.letters, held.numbers, held.blanks) for a, b in r)
    texts = ["".join(rng.choice(odd) if rng.random() < 0.6 else rng.choice("aZé' 1!\u0301\u0315\u0300\u03a3") for _ in range(rng.randint(1, 20))) for _ in range(30_000)]
    for text, ids, want in zip(texts, coder.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, ascii(text)


def test_long_words_are_not_remembered(library):
    coder = bpe.Coder(bpe.Tokenizer(PATH), None)
    texts = ["x" * 5_000 + " the", "語" * 4_000, "ab" * 40 + " ab"]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, coder.memo)) <= bpe.MEMO_CHARS


def test_frequent_words_in_bounded_memory():
    seen = bpe.Frequent(50)
    for k in range(2_000):
        seen.update([f"once{k}", "often", "often", "more"])
    assert len(seen.seen) <= 50 and [w for w, _ in seen.top(2)] == ["often", "more"]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abc", max_size=6).map(str.encode), st.lists(st.integers(0, 9), max_size=4).map(tuple), max_size=30))
def test_lexicon_gives_back_its_entries_and_nothing_else(entries):
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    asked = [*entries, b"zz", b"abcabcabc"]
    got = lexicon.lookup(asked)
    for word, ids in zip(asked, got, strict=True):
        assert ids == (np.asarray(entries[word], np.int32).tobytes() if word in entries else None)


def test_lexicon_shares_suffixes():
    words = [p + s for p in (b"walk", b"talk", b"jump") for s in (b"", b"s", b"ed", b"ing")]
    lexicon = bpe.Lexicon(bpe.compile_lexicon({w: (1,) for w in words}))
    trie_states = 1 + len({w[:k] for w in words for k in range(1, len(w) + 1)})
    assert lexicon.states < trie_states / 2


def test_query_over_edge_cases(spark, library):
    texts = [*ODD, None, "the the the", "long " * 30000]
    rows = [(k, t, "x", 7) for k, t in enumerate(texts)] + [(None, "the", "x", 7), (0, "", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")
    got = sorted((tuple(r) for r in bpe.encode_decode(docs, PATH).collect()), key=str)
    want = sorted(((i, *expected(library, t or "")) for i, t, _, _ in rows), key=str)
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(docs, PATH).collect() == []


def test_ids_and_text_are_kept(spark):
    out = bpe.encode_decode(spark.createDataFrame([(1, "the cat")], "doc_id long, text string"), PATH, keep_ids=True, keep_text=True).first()
    assert out.decoded == "the</w> cat</w>" and len(out.ids) == out.n_tokens == 2
