import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyframe.llm import alignment as L

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def known():
    with open(A, "rb") as a, open(B, "rb") as b:
        return L.Aligner(a.read(), b.read())


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), L.byte_alphabet()


def brute(libraries, text):
    """Tokens with byte ranges of both sides of the whole text, and everything by comparing all pairs of them."""
    a, b, alphabet = libraries
    if not text:
        return None
    mine = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    raw = (" " + text).encode()
    if b"".join(x for _, x in mine) != raw or b"".join(x for _, x in other) != raw:
        return None
    ranges = []
    for side in (mine, other):
        at, own = 0, []
        for i, x in side:
            own.append((i, at, at + len(x)))
            at += len(x)
        ranges.append(own)
    shared = sorted({e for *_, e in ranges[0]} & {e for *_, e in ranges[1]})
    groups = []
    for low, high in zip([0, *shared], shared, strict=False):
        groups.append([[i for i, s, e in own if s >= low and e <= high] for own in ranges])
    links = [(i, j) for i, _, e in ranges[0] for j, _, f in ranges[1] if e == f]
    overlaps = sum(s < f and t < e for _, s, e in ranges[0] for _, t, f in ranges[1])
    return {"groups": ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups), "n_a": len(mine), "n_b": len(other), "n": len(groups), "links": links, "overlaps": overlaps, "products": sum(len(x) * len(y) for x, y in groups)}


def check(known, libraries, text):
    want = brute(libraries, text)
    groups, links, n_a, n_b, overlaps, pairs = next(known.align_all([text]))
    if want is None:
        return (groups, links, n_a, n_b, overlaps, pairs) == ("", b"", 0, 0, 0, 0)
    found = known.keys[np.frombuffer(links, dtype="<u4")]
    assert [(k % len(known.bytes_a), k // len(known.bytes_a)) for k in found.tolist()] == want["links"]
    return (groups, n_a, n_b, len(links) // 4, overlaps, pairs) == tuple(want[k] for k in ("groups", "n_a", "n_b", "n", "overlaps", "products"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abÀé  \n\t.,'!1²<|>\x00\x1c\x85　ﬁ中😀▁", "<|endoftext|>", "<s>", "<unk>", "'ll", " the ", "tokenizer", "ing"]), max_size=20).map("".join))
def test_a_text_equals_brute_force(known, libraries, text):
    assert check(known, libraries, text)


def test_other_texts(known, libraries):
    for text in [None, "", " ", "  two  spaces  ", "中文字符没有空格" * 40, "a" * 3000, "word " * 500, "naïve café — déjà vu", "\n\n x"]:
        assert check(known, libraries, text)


def test_tokenizers_that_may_not_be_cut(known, libraries):
    known.cut = False
    try:
        assert all(check(known, libraries, t) for t in ("some words in a row", " x  y "))
    finally:
        known.cut = True
        known.memo.clear()


def test_intervals_and_products():
    a, b, closes = L.intervals(np.array([2, 5, 9]), np.array([3, 5, 6, 9]))
    assert list(zip(a.tolist(), b.tolist(), closes.tolist(), strict=True)) == [(0, 0, False), (1, 0, False), (1, 1, True), (2, 2, False), (2, 3, True)]
    i, j = L.products(np.array([2, 1]), np.array([1, 2]))
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (2, 2)]


@pytest.mark.parametrize("pairs", [1, 5, L.PAIRS])
def test_expanded_links(spark, libraries, monkeypatch, pairs):
    monkeypatch.setattr(L, "PAIRS", pairs)
    texts = ["tokenization of unhappiness", None, "x▁y", "ab"]
    df = L.aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    for links in L.LINKS:
        got = Counter((r.doc_id, r.a_id, r.b_id) for r in L.expand(df, links=links).collect())
        want: Counter = Counter()
        for i, t in enumerate(texts):
            if found := brute(libraries, t):
                groups = [[side.split(",") for side in g.split("|")] for g in found["groups"].split(";")]
                want.update((i, int(a), int(b)) for x, y in groups for a in (x if links == "group" else x[-1:]) for b in (y if links == "group" else y[-1:]))
        assert got == want
    with pytest.raises(ValueError):
        L.expand(df, links="other")


def test_query_equals_brute_force(spark, libraries, tmp_path):
    texts = [None, "", "the cat sat on the mat", "the cat sat on the mat", "The catnip, the tokenizer's mat", "no▁way", "中文 mat", "mat " * 3000]
    rows = [(i % 7, t, 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_a int").write.parquet(f"{tmp_path}/documents.parquet")
    found = [brute(libraries, t) for t in texts]
    n = Counter(p for f in found if f for p in f["links"])
    most: dict = {}
    for (_, b), k in n.items():
        most[b] = max(k, most.get(b, 0))
    want = []
    for (i, *_), f in zip(rows, found, strict=True):
        if f is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = f["links"]
            want.append((i, f["n_a"], f["n_b"], f["n"], len(links), sum(n[p] == most[p[1]] for p in links), sum(n[p] for p in links), hashlib.sha256(f["groups"].encode()).hexdigest()))
    assert sorted(tuple(r)[:8] for r in L.op12_alignment(spark, str(tmp_path)).collect()) == sorted(want)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert L.op12_alignment(spark, str(tmp_path)).collect() == []
