"""Byte ranges that meet, against all pairs; fields and moves of programs."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.plans import lang, overlaps

RANGES = "g string, id bigint, start bigint, length bigint"


def brute(rows):
    out = []
    for g, i, s, n in rows:
        for h, j, t, m in rows:
            if g == h and None not in (g, i, s, n, j, t, m) and i < j and max(s, t) < min(s + n, t + m) and n > 0 and m > 0:
                out.append((g, i, j, max(s, t), min(s + n, t + m) - max(s, t)))
    return sorted(out)


def met(spark, rows):
    df = overlaps.overlapping(spark.createDataFrame(rows, RANGES), ["g"])
    assert "CartesianProduct" not in df._jdf.queryExecution().toString()
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, seed):
    """Layouts of bytes, of records and of areas of a gigabyte, side by side and over each other."""
    r = random.Random(seed)
    rows = [(f"G{r.randint(0, 3)}", i, r.randint(-50, 4000), r.choice([1, 1, 2, 3, 4, 7, 8, 9, r.randint(1, 300), r.randint(1, 5000)])) for i in range(500)]
    rows += [("G0", 1000 + i, r.randint(0, 2**40), r.randint(1, 2**30)) for i in range(60)] + [("G1", 2000 + i, 64, 64) for i in range(20)]
    got = met(spark, rows)
    assert got == brute(rows) and len(got) > 500


def test_odd_ranges(spark):
    rows = [("A", 1, 0, 10), ("A", 1, 0, 10), ("A", 2, 5, 0), ("A", 3, 5, -1), ("A", 4, None, 9), ("A", 5, 3, None), (None, 6, 0, 9), ("A", None, 0, 9), ("A", 7, 10, 5), ("B", 8, 0, 10)]
    assert met(spark, rows) == []
    assert met(spark, []) == []
    assert met(spark, [("A", 1, 0, 10), ("A", 2, 9, 1)]) == [("A", 1, 2, 9, 1)]


SOURCE = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. {name}.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
       01 REC.
          05 KEY-T PIC X(4).
          05 KEY-N REDEFINES KEY-T PIC 9(4).
          05 FILLER REDEFINES KEY-T.
             10 LO PIC X(2).
             10 HI PIC S9(3) COMP-3.
          05 TAB OCCURS 3.
             10 U PIC X(2).
             10 V REDEFINES U PIC 99.
             10 W PIC X.
          05 ALL-T REDEFINES TAB PIC X(9).
       01 OTHER PIC X(4).
       LINKAGE SECTION.
       01 L PIC X(3).
       PROCEDURE DIVISION USING L.
       MAIN-P.
           MOVE KEY-T TO LO OTHER.
           MOVE KEY-N TO OTHER.
           MOVE OTHER TO L.
           GOBACK.
"""


@pytest.fixture
def tables(spark):
    bad = "       PROGRAM-ID. BAD.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       01 A PIC X.\n       01 B REDEFINES NONE PIC X.\n       PROCEDURE DIVISION.\n       P.\n           GOBACK.\n"
    rows = [("T1", SOURCE.format(name="T1")), ("T2", SOURCE.format(name="T2")), ("BAD", bad)]
    return lang.portfolio(spark, spark.createDataFrame(rows, "name string, source string"))


def test_overlays_of_programs(tables):
    got = sorted(tuple(r) for r in overlaps.overlays(tables("storage")).where("program = 'T2'").collect())
    table = "WORKING/TAB@4"
    assert got == sorted(("T2", *x) for x in [
        ("WORKING", "KEY-T", "KEY-N", 0, 4, True), ("WORKING", "KEY-T", "LO", 0, 2, False), ("WORKING", "KEY-N", "LO", 0, 2, True), ("WORKING", "KEY-T", "HI", 2, 2, True),
        ("WORKING", "KEY-N", "HI", 2, 2, False), ("WORKING", "TAB", "ALL-T", 4, 9, False), (table, "U", "V", 0, 2, True),
    ])
    assert overlaps.overlays(tables("storage")).count() == 14
    assert [r.reason for r in tables("issues").where("program = 'BAD'").collect()] == ["B redefines unknown NONE"]


def test_moves_of_shared_storage(tables):
    got = sorted((r.source, r.target, r.reason) for r in overlaps.ambiguous_moves(tables("moves"), tables("storage")).where("program = 'T1'").collect())
    assert got == [("KEY-N", "OTHER", "other kind stored"), ("KEY-T", "LO", "operands overlap"), ("KEY-T", "LO", "other kind stored"), ("KEY-T", "OTHER", "other kind stored")]


def test_few_sizes_of_buckets(spark, monkeypatch):
    """A range is looked up in the buckets of each size that occurs: of ranges up to 2,000 bytes there are six at most, and the greatest length still has one."""
    kept, real = [], overlaps.cut
    monkeypatch.setattr(overlaps, "cut", lambda df, label: kept.append(real(df, label)) or kept[-1])
    rows = spark.range(1, 2001).select(F.lit(1).alias("g"), "id", (F.col("id") * 5000).alias("start"), F.col("id").alias("length"))
    wide = spark.createDataFrame([(1, 0, -5, 2**63 - 1)], "g int, id bigint, start bigint, length bigint")
    assert overlaps.overlapping(rows, ["g"]).isEmpty()
    assert kept[0].select("level").distinct().count() <= 6
    assert overlaps.overlapping(rows.union(wide), ["g"]).count() == 2000
