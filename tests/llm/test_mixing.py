import random

import duckdb
import pytest

from tallyframe.llm import mixing


def brute_targets(sizes, cap=3, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > cap * sizes[s]]
        if not over:
            return fixed | t
        fixed |= {s: float(cap * sizes[s]) for s in over}


def frame(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(600):
        source = r.choice(["a"] * 12 + ["b", "c", "c", "Z", "é", None, "tiny" if i % 50 == 0 else "a"])
        rows.append((i, r.choice([None, "", " "]) if r.random() < 0.03 else "w " * r.randint(1, 40), source, r.random()))
    rows.append(rows[5])
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string, size double")


@pytest.mark.parametrize("seed", [1, 2])
def test_taken(spark, seed):
    rows, docs = frame(spark, seed)
    got = mixing.taken(docs).collect()
    assert len(got) == len(rows)
    of = {r[0]: r for r in rows}
    sizes = {}
    for i, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    took = dict.fromkeys(sizes, 0)
    for r in got:
        source = of[r.doc_id][2]
        assert r.size == len((of[r.doc_id][1] or "").split()) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and 0 <= r.taken <= 3 * r.size
        took[source] += r.taken
    for s in sizes:
        assert abs(took[s] - want[s]) <= 40, s  # half of the largest document, twice as one row is repeated
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken(docs.repartition(7)).collect()))


def test_same_as_sql(spark):
    rows, docs = frame(spark, 3)
    documents = docs.toPandas().drop(columns="size").astype({"source": "object"})  # noqa: F841
    documents = documents.where(documents.notna(), None)
    want = duckdb.sql(mixing.OP10_SQL).fetchall()
    assert sorted(map(tuple, mixing.taken(docs).collect())) == sorted(want)


def test_mix_repeats_rows(spark):
    rows, docs = frame(spark, 4)
    n = {}
    for r in mixing.taken(docs).collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + r.repetitions
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: k for i, k in n.items() if k}


def test_empty(spark):
    _, docs = frame(spark, 5)
    assert mixing.taken(docs.limit(0)).collect() == [] and mixing.mix(docs.limit(0)).collect() == []
    [row] = mixing.taken(docs.where("doc_id = 5").limit(1)).collect()
    assert row.taken == row.size == row.target


def test_rows_without_ids_and_long_texts(spark):
    """Rows without an id are taken each for itself; a text of many words; equal rows share their fate."""
    rows = [(None, f"w{i} " * 20, "a") for i in range(400)] + [(None, "same text here", "a")] * 3 + [(i, "x " * 10, "b") for i in range(100)] + [(5000, "long " * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.taken(docs).collect()
    assert len(got) == len(rows)
    own = [r for r in got if r.source_size == 400 * 20 + 9]
    assert abs(sum(r.taken for r in own) - own[0].target) <= 40 and len({r.repetitions for r in own}) <= 2
    assert len({r.repetitions for r in own if r.size == 3}) == 1
    assert [r.size for r in got if r.doc_id == 5000] == [200_000]
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(r.repetitions for r in got) and mixed.columns == docs.columns


@pytest.mark.parametrize("ids", ["one", "none", "mixed"])
def test_copies_are_split_to_meet_targets(spark, ids):
    """A source of copies of one text under one id (or none) meets its target within half a document, in query, SQL and mix."""
    id_of = {"one": lambda i: 7, "none": lambda i: None, "mixed": lambda i: None if i % 2 else 7}[ids]
    rows = [(id_of(i), "w " * 10, "a") for i in range(300)] + [(id_of(i), f"v{i % 3} " * 10, "b") for i in range(100)] + [(i, "z " * 5, None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    got = mixing.taken(docs).collect()
    sums: dict = {}
    for r in got:
        sums[r.target] = sums.get(r.target, 0) + r.taken
        assert r.taken <= 3 * r.size
    assert len(sums) == 3 and all(abs(n - t) <= 5 for t, n in sums.items())
    import pandas as pd

    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    ordered = lambda found: sorted(found, key=repr)
    assert ordered(map(tuple, got)) == ordered(map(tuple, duckdb.sql(mixing.OP10_SQL).fetchall()))
    assert mixing.mix(docs).count() == sum(r.repetitions for r in got)
