import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import bpe

DATA = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
CODEC = bpe.Codec(DATA, P.PATTERN)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_tiktoken(text):
    ids = CODEC.encode(text)
    assert ids == TIK.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "aaaa", "a" * 5000, "ab" * 3000, "  \n\t x", "don't we'll I'M", "<|endoftext|>", "é" * 999, "😀 𝔘 ñ́", "0123456789" * 300, "\x1c\x1d\x85\xa0  x"])
def test_edges(text):
    assert CODEC.encode(text) == TIK.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(alphabet="abe nth", max_size=70), max_size=12))
def test_together(texts):
    codec = bpe.Codec.__new__(bpe.Codec)
    codec.__dict__ |= CODEC.__dict__ | {"pieces": bpe._Pieces(CODEC.ranks)}
    assert [ids.tolist() for ids in codec.encode_all(texts, 50)] == [TIK.encode_ordinary(t) for t in texts]


def test_cache_forgets(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    codec = bpe.Codec(DATA, P.PATTERN)
    text = " one two three four five six seven one two"
    assert codec.encode(text) == TIK.encode_ordinary(text)
    assert len(codec.pieces) <= 3


def test_frame(spark):
    rows = [(1, "hello world", 9), (2, None, 9), (3, "", 9), (3, "", 9), (4, "x " * 50_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted(map(tuple, bpe.round_trip(docs).collect()))
    want = sorted((i, len(ids := TIK.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True) for i, t, _ in rows)
    assert got == want
    both = bpe.decode(bpe.encode(docs))
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in both.collect()) == sorted((i, t or "") for i, t, _ in rows)
    assert bpe.round_trip(docs.limit(0)).collect() == []
