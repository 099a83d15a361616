import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from treeline.llm import pieces
from treeline.llm.queries import queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
CODER = pieces.Coder(pieces.Model.read(PATH))
ODD = [
    "", " ", "   ", "a", " a", "a ", "a  b   c", "▁a▁ ▁b", "\x00a\x00", "\n\t\r\x0b", "a　b", "éé", "𝒳😀👩‍👩‍👧 ok", "<s>hi</s><unk><0x41>", "�﻿x", "日本語テキスト ༄",
    "x" * 700, "ab" * 300 + "the" * 200, " " * 500 + "z", "internationalization antidisestablishmentarianism", "1234567890" * 30, "aA" * 99 + "𝒳" * 40 + "b" * 77,
]


def check(text):
    ids = LIBRARY.encode(text)
    assert CODER.encode(text) == ids, text
    assert CODER.decode(ids) == LIBRARY.decode(ids), text


@pytest.mark.parametrize("k", range(len(ODD)))
def test_odd_texts_agree_with_the_library(k):
    check(ODD[k])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abehinorst'!., \n<|>éß▁0158𝒳", max_size=80))
def test_random_texts_agree(text):
    check(text)


def test_texts_of_pieces_agree():
    rng = random.Random(11)
    held = [p.replace("▁", rng.choice([" ", ""])) for p in CODER.text]
    for _ in range(3000):
        check("".join(rng.choices(held, k=rng.randint(1, 30))))
    for _ in range(300):
        check("".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x20000)])) for _ in range(30)))


def test_backtracking_takes_pieces_back():
    """Some parts need it: the greedy longest pieces alone aren't the library's."""
    rng, needed = random.Random(5), 0
    held = [p for p in CODER.text if p.isalpha() and p.isascii()]
    for _ in range(2000):
        text = "".join(rng.choices(held, k=4))
        greedy, at = [], 0
        while at < len(text):
            size = next(n for n in range(16, 0, -1) if text[at : at + n] in CODER.id)
            greedy.append(CODER.id[text[at : at + size]])
            at += size
        ids = CODER.run(text)
        needed += ids != greedy
        assert [CODER.text[i] for i in ids] == CODER.merged(text)
    assert needed > 200


def test_random_ids_decode_as_in_the_library():
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32_000), rng.choice([1, 2, 264, 28705])]) for _ in range(rng.randint(0, 12))]
        assert CODER.decode(ids) == LIBRARY.decode(ids), ids


def test_small_memories_change_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_PARTS", 2)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 3)
    coder = pieces.Coder(pieces.Model.read(PATH))
    assert [coder.encode(t) for t in ODD] == [LIBRARY.encode(t) for t in ODD]


def expected(text):
    ids = LIBRARY.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_query_agrees_with_the_library(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries()["op11_pieces"](spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(docs[r.doc_id])


def test_odd_rows(spark):
    texts = [None, *ODD, "a b", "a b"]
    docs = spark.createDataFrame([(k if k else None, t, "more", 3) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string, TEXT int")
    want = [(k if k else None, *expected(t)) for k, t in enumerate(texts)]
    assert sorted(map(tuple, pieces.round_trip(docs, PATH).collect()), key=str) == sorted(want, key=str)
    back = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert {r.doc_id: r.text for r in back} == {k if k else None: LIBRARY.decode(LIBRARY.encode(t or "")) for k, t in enumerate(texts)}
    assert pieces.round_trip(docs.limit(0), PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    held = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        held.ParseFromString(f.read())
    held.trainer_spec.model_type = 1
    (tmp_path / "m").write_bytes(held.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Model.read(str(tmp_path / "m"))
