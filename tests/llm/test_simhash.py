import random

import numpy as np
import pytest
import xxhash

from tallyframe.llm import components, simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(nodes):
        for y in nodes[i + 1 :]:
            if linked(x, y):
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "a b c d e", "A B\x0bC\x85 D É e f", "x y " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def clustered(seed, n):
    r = random.Random(seed)
    codes = {0, (1 << 64) - 1}
    while len(codes) < n:
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 40])):
            codes.add(x)
            for b in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << b
    return sorted(codes)


def test_index_against_brute_force():
    codes = np.array(clustered(1, 700), dtype=np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    found = {(a, b) for x, y in simhash.GrayIndex(codes, 4).search(np.arange(len(codes)), 4) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if (int(codes[i]) ^ int(codes[j])).bit_count() <= 4}
    assert found == want
    labels = simhash.block_labels(codes, 4)
    least = brute_components(list(range(len(codes))), lambda i, j: (i, j) in want)
    assert labels.tolist() == [least[i] for i in range(len(codes))]


@pytest.mark.parametrize("most", [None, 16])
def test_links_over_blocks(spark, most):
    codes = clustered(2, 500) + [(0xABC << 50) | (1 << b) for b in range(40)]
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in codes})
    frame = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = {x: x for x in signed} | {r.node: r.root for r in components.roots(simhash.links(frame, len(signed), most=most)).collect()}
    assert got == brute_components(signed, lambda x, y: ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 4)


def test_two_equal_bands(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPARE", ((0, 2),))
    signed = [x - (1 << 64) if x >> 63 else x for x in clustered(3, 300)]
    got = {x: x for x in signed} | {r.node: r.root for r in components.roots(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), len(signed))).collect()}
    assert got == brute_components(sorted(signed), lambda x, y: ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 4)


def test_long_chain(spark):
    ids = list(range(60))
    random.Random(5).shuffle(ids)
    chain = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(7, 7)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in components.roots(chain).collect()} == {(x, 0) for x in range(1, 60)}


def test_documents(spark):
    r = random.Random(4)
    base = [" ".join(r.choice("abcdefghijklmnop") * r.randint(1, 4) for _ in range(150)) for _ in range(8)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, t + " tail") for i, t in enumerate(base)] + [(40, base[0]), (40, base[0]), (41, None), (42, ""), (43, base[3].upper())]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, component_id string")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    fps = {i: brute_fingerprint(t) for i, t in rows}
    least = brute_components(sorted(fps), lambda x, y: (fps[x] ^ fps[y]).bit_count() <= 4)
    assert got == sorted((i, f"{fps[i]:016x}", least[i]) for i, _ in rows)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_deduplicated_without_ids_and_with_one_id_for_two_texts(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(90))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3) + " y"), (7, text(3)), (7, text(4)), (8, text(4)), (9, text(5)), (9, text(6)), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (9, text(5)), (9, text(6)), (None, None)]
    assert sorted(map(str, map(tuple, simhash.deduplicated(docs).collect()))) == sorted(map(str, want))


def test_deduplicated_and_split(spark):
    from tallyframe.llm.common import split_by_ids

    text = " ".join(f"w{i}" for i in range(90))
    rows = [(1, text), (2, text), (3, text + " x"), (4, "quite another text of its own kind"), (4, "quite another text of its own kind"), (5, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, component_id string")
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 4, 5]
    many = spark.range(5000)
    ids = many.where("id % 7 = 0")
    some, none = split_by_ids(many, "id", ids)
    a, b = {r.id for r in some.collect()}, {r.id for r in none.collect()}
    assert {i for i in range(0, 5000, 7)} <= a and not a & b and len(a | b) == 5000 and len(a) < 1200
