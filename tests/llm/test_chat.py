import random

import duckdb
from pyspark.sql import functions as F

from tallyframe.llm import chat

ROWS = [
    (1, 0, "system", "be kind", 0), (1, 1, "ann", "hi <|end|>", 0), (1, 2, "bob", "é😀", 0), (1, 3, "ann", None, 0), (1, 3, "ann", None, 0),
    (2, 0, "system", "alone", 0), (3, None, None, "x", 0), (3, 600, "", "y", 0), (3, 2, "li\nz", "z", 0), (None, 1, "ann", "n", 0), (4, 5, "b", "2", 0), (4, 5, "a", "1", 0),
]


def frame(spark):
    return spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string, mask int")


def test_rotation(spark):
    got = {(r.conv_id, r.perspective, r.segment): r for r in chat.rotate(frame(spark)).collect()}
    assert {k for k in got if k[0] == 1} == {(1, "ann", 0), (1, "bob", 0)}
    ann = got[1, "ann", 0]
    assert ann.rendered == "<|start|>system\nbe kind<|end|>\n<|start|>assistant\nhi <\\|end|><|end|>\n<|start|>user name=bob\né😀<|end|>\n" + "<|start|>assistant\n<|end|>\n" * 2
    parts = [ann.rendered[int(a) : int(b)] for a, b in (s.split(":") for s in ann.mask.split(","))]
    assert parts == ["hi <\\|end|><|end|>", "<|end|>", "<|end|>"] and (ann.n_turns, ann.n_own) == (5, 3)
    assert not [k for k in got if k[0] == 2]
    assert got[3, "unknown", 1].n_own == 1 and got[3, "li z", 1].mask == "" and (3, "unknown", -1) in got
    assert (None, "ann", 0) in got
    assert chat.rotate(frame(spark).limit(0)).collect() == []


def test_same_as_sql(spark):
    conversations = frame(spark).toArrow()  # noqa: F841
    want = duckdb.sql(chat.OP7_SQL).fetchall()
    assert sorted(map(str, map(tuple, chat.rotate(frame(spark)).collect()))) == sorted(map(str, want))


def test_parts_and_heads_same_as_sql(spark):
    """Null and repeated turns beyond a part, system turns repeated in later segments, long texts."""
    r = random.Random(2)
    rows = [(1, None, "ann", "same", 0)] * 5000 + [(None, 7, r.choice(["a", "b", "system"]), r.choice("xyz"), 0) for _ in range(4500)]
    rows += [(2, 0, "system", "rules", 0), (2, 0, "system", "more <|end|>", 0)] + [(2, i, "ab"[i % 2], f"t{i}", 0) for i in range(1, 1600)]
    rows += [(3, 600, "system", "late", 0), (3, 1, "a", "early", 0), (3, 1200, "b", "w" * 300_000, 0), (4, None, "system", "first", 0), (4, 3, "a", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, part int").repartition(7)
    conversations = df.toArrow()  # noqa: F841
    got = chat.rotate(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duckdb.sql(chat.OP7_SQL).fetchall()))
    assert max(x.n_turns for x in got) == chat.MOST and sorted(x.n_turns for x in got if x.conv_id == 1) == [904, 2048, 2048]
    heads = {(x.conv_id, x.segment): x.rendered.startswith("<|start|>system\n") for x in got if x.perspective == "a"}
    assert heads[2, 0] and heads[2, 3] and heads[4, 0] and not heads[3, 0] and heads[3, 1] and not heads[3, 2]
    assert df.where(F.col("conv_id") == 9).transform(chat.rotate).collect() == []
