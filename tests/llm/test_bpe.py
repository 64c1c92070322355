from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def t():
    return bpe.transducer(bpe.vocabulary())


@pytest.fixture(scope="module")
def ref():
    r = tokenizers.Tokenizer.from_file(bpe.vocabulary())
    r.encode_special_tokens = True
    return r


def ids(ref, text):
    return ref.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(t, ref, text):
    assert t.encode(text) == ids(ref, text)


def test_mixed_alphabet(t, ref):
    rng = random.Random(1)
    letters = list("aab bc'sstrellvedm  \n\t 12²½³ éàß文字🙂‍.,!?--<|endoftext|>'''\x1c\x85　")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    got, n = t.encode_texts(texts)
    at = 0
    for text, k in zip(texts, n.tolist()):
        assert got[at : at + k].tolist() == ids(ref, text)
        at += k


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 5000, " " * 3000, "'" * 50, "''s 're  'll'llama\n's", "x 's", "\r\n\r\n x", "don't we'LL"])
def test_odd(t, ref, text):
    assert t.encode(text) == ids(ref, text)


def test_states_stay_bounded_within_a_word(ref, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 40)
    small = bpe.Transducer(bpe.vocabulary())
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000))
    assert small.encode(word) == ids(ref, word) and len(small.states) <= 42


def test_null_and_empty(t):
    assert t.encode(None) == [] and t.encode("") == []
    got, n = t.encode_texts([None, "", "a", None])
    assert n.tolist() == [0, 0, 1, 0] and len(got) == 1


def test_pieces_and_small_caches(ref, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 50)
    monkeypatch.setattr(bpe, "WORDS", 20)
    fresh = bpe.Transducer(bpe.vocabulary())
    text = "The quick brown fox, jumps over\n\n the lazy dog's tail " * 40
    assert list(bpe.pieces(text, 100)) and "".join(bpe.pieces(text, 100)) == text
    joined = [x for p in bpe.pieces(text, 100) for x in fresh.encode(p)]
    assert joined == ids(ref, text)


def test_stream_decoding(t):
    text = "héllo 🙂 wörld 文字 " * 5
    out = list(t.decode_stream(t.encode(text)))
    assert "".join(out) == text and len(out) > 5
    assert "".join(t.decode_stream(t.encode("🙂")[:1])) == "�"


def test_frame(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (1, "Hello world", "x")], "doc_id bigint, text string, ids string")
    rows = df.select("doc_id", "text").mapInArrow(bpe.ids_of(bpe.vocabulary(), "doc_id", "text"), "doc_id bigint, ids array<int>").collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    none = df.where("doc_id > 9").select("doc_id", "text").mapInArrow(bpe.ids_of(bpe.vocabulary(), "doc_id", "text"), "doc_id bigint, ids array<int>")
    assert none.collect() == []


def test_p6_on_the_tables(spark, sf, ref):
    from palimpsest.llm import queries as q

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in q.p6_ids(spark, sf).collect()}
    assert set(got) == set(texts)
    for k, v in texts.items():
        assert got[k] == ids(ref, v or "")
