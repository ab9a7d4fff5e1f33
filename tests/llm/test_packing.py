import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyframe.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [P.END]


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return P.Encoder(f.read(), P.END)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abÀéZ \n\t.,'!1²Σσ<|>\x1c\x85　́ﬁİ中", "<|endoftext|>", "<|ENDOFTEXT|>", "h\u0331", "H\u0331", "J\u030c", "I\u0307", "'LL", "'ll", "word. ", "Don't"]), max_size=20).map("".join))
def test_ids_are_the_librarys(encoder, text):
    assert np.frombuffer(next(encoder.encode_all([text])), dtype="<u4").tolist() == ids_of(text)


def test_any_text(encoder):
    texts = ["".join(chr(random.Random(k).randrange(32, 0x3000)) for _ in range(60)) for k in range(50)] + ["x" * 50_000, "ab " * 40_000, ""]
    for text, got in zip(texts, encoder.encode_all(texts), strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() == ids_of(text)


def test_small_memory(monkeypatch):
    """Words are forgotten and learned again."""
    monkeypatch.setattr(P, "WORDS", 7)
    with open(PATH, "rb") as f:
        small = P.Encoder(f.read(), P.END)
    texts = [" ".join(random.Random(k).choices(["Ab", "ab", "cde,", "F.", "gh", "é", "##", "x1", "Yz!", "q"], k=40)) for k in range(30)]
    for text in texts:
        assert np.frombuffer(next(small.encode_all([text])), dtype="<u4").tolist() == ids_of(text)
    assert len(small.memo) <= 7 + 10


@pytest.mark.parametrize("lengths", [[], [1], [2047], [5, 5, 5], [1500] * 7, [700, 650, 2000, 30, 1, 1] * 40])
def test_dealt_rests_fill_every_sequence(lengths):
    pieces, costs = P.deal(lengths)
    held = defaultdict(list)
    for n, own in zip(lengths, pieces, strict=True):
        assert [s for s, *_ in own] == [sum(m for _, m, *_ in own[:k]) for k in range(len(own))] and sum(m for _, m, *_ in own) == n
        for _, m, k, offset in own:
            held[k].append((offset, m))
    assert len(held) == len(costs)
    for k, own in held.items():
        own.sort()
        assert [o for o, _ in own] == [sum(m for _, m in own[:j]) for j in range(len(own))]
        total = sum(m for _, m in own)
        assert total == P.SIZE or total & (total - 1) == 0 and total < P.SIZE
        assert costs[k] == pytest.approx(sum(P.cost_of(m) for _, m in own))


def test_costs_are_balanced():
    rng = random.Random(7)
    lengths = [rng.choice([40, 90, 200, 700, 1200]) for _ in range(3000)]
    pieces, costs = P.deal(lengths)
    full = costs[: sum(lengths) // P.SIZE]
    assert max(full) < 1.1 * min(full) and sum(len(p) - 1 for p in pieces) < len(costs)  # a cut fills a sequence
    in_order = np.add.reduceat([P.cost_of(n) for n in lengths], np.searchsorted(np.cumsum(lengths), np.arange(len(full)) * P.SIZE))
    assert max(full) - min(full) < 0.5 * (in_order.max() - in_order.min())


def brute_cost_order(lengths):
    """The same rule with plain lists, for inputs that need no cut."""
    rooms = [P.SIZE] * (sum(lengths) // P.SIZE) + [1 << b for b in range(12) if sum(lengths) % P.SIZE >> b & 1]
    cost, out = [0.0] * len(rooms), {}
    for n, i in sorted((-n, i) for i, n in enumerate(lengths)):
        fits = [k for k in range(len(rooms)) if rooms[k] >= -n]
        k = min(fits, key=lambda k: (cost[k], k))
        rooms[k] += n
        cost[k] += P.cost_of(-n)
        out[i] = k
    return [out[i] for i in range(len(lengths))]


def test_lowest_cost_first():
    lengths = [1024, 512, 512, 1024, 256, 256, 512, 2047, 1]
    assert [p[0][2] for p in P.deal(lengths)[0]] == brute_cost_order(lengths)


@pytest.mark.parametrize("block", [1, 5_000, P.BLOCK])
def test_pieces_hold_each_id_once(spark, block):
    texts = [None, "", "one", "some words here " * 300, "x y " * 4000, "same", "same", "é" * 3000]
    rows = [(i if i != 5 else None, t, "clash", 3) for i, t in enumerate(texts)] + [(2, "again", "clash", 3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, start string, length int").coalesce(2)
    got = P.pack(df, block=block).collect()
    wanted = sorted(map(tuple, (ids_of(t) for _, t, *_ in rows)))
    by_sequence, starts = defaultdict(list), []
    for r in got:
        assert r["length"] == len(r.ids) > 0 and r.ids_crc32 == crc32(np.array(r.ids, dtype="<u4").tobytes())
        by_sequence[r.sequence_id].append(r)
        starts += [r] if r.start == 0 else []
    found = []
    for first in starts:  # rows of one id have texts of different lengths here
        ids = list(first.ids)
        while len(ids) < first.doc_tokens:
            ids += next(r.ids for r in got if r.doc_id == first.doc_id and r.doc_tokens == first.doc_tokens and r.start == len(ids))
        found.append(tuple(ids))
    assert sorted(found) == wanted and sum(len(r.ids) for r in got) == sum(map(len, wanted))
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        total = sum(r["length"] for r in own)
        assert total <= P.SIZE and (total == P.SIZE or total & (total - 1) == 0)
    assert sorted(map(repr, got)) == sorted(map(repr, P.pack(df, block=block).collect()))


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id bigint, text string"), with_ids=False).collect() == []
