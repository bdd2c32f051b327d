import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gregaria.llm.tokenize import BYTE_BPE, count_tokens, encode_texts, encoder

library = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def whole():
    t = library.Tokenizer.from_file(BYTE_BPE.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


PIECES = ["'s", "'re", "'LL", "'", "don't", "  ", "\n\n", " \t", "\r\n", " ", "　", " ", "\x85", "\x1c", "é", "é", "中文", "مرحبا", "🙂", "👩‍🔧", "<|endoftext|>", "</s>", "123", "٣", "_x", "=>", "€'s", "!'t", "a", "Z", "﻿", "\x00"]


def test_pieces_in_any_order(whole):
    r, encode = random.Random(8), encoder(BYTE_BPE).encode
    for _ in range(4000):
        text = "".join(r.choices(PIECES, k=r.randint(0, 9)))
        assert encode(text).tolist() == whole(text), text


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert encoder(BYTE_BPE).encode(text).tolist() == encoder(BYTE_BPE).plain(text)


def test_fragments_are_cut_and_joined():
    e = encoder(BYTE_BPE)
    text = "one two  three\n\nfour's é中 five"
    parts = [f for block in e.fragments(text.encode()) for f in block]
    assert b"".join(parts).decode() == text and len(parts) > 4


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_blocks_of_any_size(monkeypatch, whole, size):
    import gregaria.llm.tokenize as m

    monkeypatch.setattr(m, "BLOCK_BYTES", size)
    r, encode = random.Random(size), encoder(BYTE_BPE).encode
    for _ in range(300):
        text = "".join(r.choices(PIECES, k=r.randint(0, 9)))
        assert encode(text).tolist() == whole(text), text


def test_long_texts(whole):
    encode = encoder(BYTE_BPE).encode
    for text in ("word " * 100_000, "ab" * 50_000, "x=1;\n" * 40_000):
        assert len(encode(text)) == len(whole(text))


def test_memo_is_bounded(monkeypatch):
    import gregaria.llm.tokenize as m

    monkeypatch.setattr(m, "MEMO_FRAGMENTS", 50)
    e = m.Encoder(BYTE_BPE)
    text = " ".join(f"w{i}" for i in range(500))
    assert e.encode(text).tolist() == e.plain(text) and len(e.memo) <= 50


def test_table(spark, whole):
    texts = ["", None, " ", "héllo wörld <|endoftext|>", "héllo wörld <|endoftext|>", "x" * 300_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a", "clash")], "doc_id bigint, text string, ids string")
    out = {r.doc_id: r.ids for r in encode_texts(df, "doc_id").collect()}
    assert out == {i: whole(t or "") for i, t in enumerate(texts)} | {None: whole("a")}
    counts = {r.doc_id: r.n_tokens for r in count_tokens(df, ["doc_id", "ids"]).collect()}
    assert counts == {k: len(v) for k, v in out.items()}
    assert encode_texts(df.limit(0), "doc_id").count() == 0
