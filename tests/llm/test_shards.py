import random

import numpy as np
import pytest

from tallyframe.llm import shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation(n):
    order = shards.Permutation(n)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert order.numbers(slots).tolist() == list(range(n))
    if n == 1000:
        assert (slots != shards.Permutation(n, "other").slots(np.arange(n))).any()
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.2


def test_files_hold_every_text(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("ab \né😀\0") for _ in range(r.randint(0, 300))), "x") for i in range(200)]
    rows += [(900, None, "x"), (901, "", "x"), (901, "", "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, slot string").repartition(5).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    layout, index = shards.write(docs, length=64, shard=100)
    got = list(shards.read(spark, layout, 0, 10**9))
    assert [s for s, _ in got] == list(range(layout.sequences)) and len(shards.shard_files(spark, layout)) == -(-layout.sequences // 100)
    assert list(shards.read(spark, layout, 57, 120)) == got[57:177]
    by_number = dict(zip(layout.permutation.numbers(np.arange(layout.sequences)).tolist(), (ids for _, ids in got), strict=True))
    found = []
    for x in index.collect():
        ids = b"".join(by_number[x.first_sequence + k] for k in range(x.n_sequences))[x.position : x.position + x.n_tokens]
        assert ids[-1] == layout.end == 0xFF and x.slot // 100 == x.shard and x.byte_offset == x.slot % 100 * layout.stride
        found.append((x.doc_id, ids[:-1].decode()))
    assert sorted(found) == sorted((i, t or "") for i, t, _ in rows)
    assert sum(len(ids) for ids in by_number.values()) == sum(len((t or "").encode()) + 1 for _, t, _ in rows)


def test_empty(spark):
    layout, index = shards.write(spark.createDataFrame([], "doc_id bigint, text string"))
    assert layout.sequences == 0 and index.collect() == [] and shards.shard_files(spark, layout) == {}


@pytest.mark.parametrize(("width", "most"), [(1, 254), (2, 65_534), (4, 2**31)])
def test_lists_of_ids(spark, tmp_path, width, most):
    r = random.Random(width)
    rows = [(i, [r.randrange(most) for _ in range(r.choice([0, 1, 5, 200]))]) for i in range(60)] + [(100, None), (None, [0, most - 1]), (None, [0, most - 1])]
    spark.createDataFrame(rows, "doc_id bigint, ids array<bigint>").repartition(3).write.parquet(str(tmp_path / "d"))
    layout, index = shards.write(spark.read.parquet(str(tmp_path / "d")), length=50, shard=16, ids_col="ids", width=width)
    by_number = dict(zip(layout.permutation.numbers(np.arange(layout.sequences)).tolist(), (layout.numbers(ids).tolist() for _, ids in shards.read(spark, layout, 0, 10**9)), strict=True))
    found = []
    for x in index.collect():
        ids = [k for j in range(x.n_sequences) for k in by_number[x.first_sequence + j]][x.position : x.position + x.n_tokens]
        assert ids[-1] == layout.end
        found.append((x.doc_id, ids[:-1]))
    assert sorted(map(str, found)) == sorted(str((i, ids or [])) for i, ids in rows)
    too_high = spark.createDataFrame([(1, [layout.padding])], "doc_id bigint, ids array<bigint>")
    with pytest.raises(Exception, match="an id outside"):
        shards.write(too_high, ids_col="ids", width=width)


def test_token_ids_of_the_encoder(spark, tmp_path):
    from tallyframe.llm import bpe

    texts = [(i, f"Some words, number {i}!\n" * (i % 7)) for i in range(40)]
    bpe.encode(spark.createDataFrame(texts, "doc_id bigint, text string")).write.parquet(str(tmp_path / "ids"))
    encoded = spark.read.parquet(str(tmp_path / "ids"))
    layout, index = shards.write(encoded, ids_col="token_ids", width=2, length=64)
    data = b"".join(ids for _, ids in sorted(zip(layout.permutation.numbers(np.arange(layout.sequences)).tolist(), (ids for _, ids in shards.read(spark, layout, 0, 10**9)), strict=True)))
    every = layout.numbers(data)
    ends = np.flatnonzero(every == layout.end)
    lists = [every[a:b].tolist() for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=True)]
    assert sorted(lists) == sorted(list(x.token_ids) for x in encoded.collect()) and index.count() == 40
