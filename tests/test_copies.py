"""Copybooks put in by joins over a library table, against one program after the other."""

import random
from collections import Counter

import pytest

from tallyframe.plans import copies
from tallyframe.plans.lang import cleaned, expand_copies, parse_data

MEMBERS, SOURCES = "member string, text string", "name string, source string"


def run(spark, sources, library, **more):
    out, issues = copies.expand(spark.createDataFrame(sources, SOURCES), spark.createDataFrame(library, MEMBERS), **more)
    return {r.program: r.source for r in out.collect()}, Counter((r.program, r.member, r.reason) for r in issues.collect())


def check(spark, sources, library, depth=10):
    got, issues = run(spark, sources, library, depth=depth)
    want = {n: expand_copies(cleaned(s), dict(library), depth) for n, s in sources}
    assert got == {n: x for n, (x, _) in want.items()}
    assert issues == Counter((n, m, why) for n, (_, found) in want.items() for m, why in found)
    return issues


def text(r, names):
    """A member: fields, and COPY statements of several kinds, with names that replacements of outer members change."""
    out = []
    for _ in range(r.randint(1, 3)):
        out.append(r.choice(["       05 :T:-A PIC X.", "       05 OLD-B PIC 9(4).", "      * COPY NOTHING.", "       05 NAME-OLD PIC S9(3) COMP-3.", "       05 OLD PIC X."]))
        if r.random() < 0.8:
            clause = r.choice(["", " REPLACING ==:T:== BY ==W==", " REPLACING LEADING ==OLD== BY ==NEW==", " REPLACING TRAILING ==OLD== BY ==N== OLD BY OTHER", " REPLACING ==NEW== BY ==:T:==\n           ==M== BY ==K=="])
            out.append(f"       COPY {r.choice(names)}{clause}.")
    return "\n".join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_one_by_one(spark, seed):
    """Members that hold each other and themselves, missing ones, more depth than is allowed."""
    r = random.Random(seed)
    names = [f"M{i}" for i in range(12)]
    library = [(n, text(r, [*r.sample(names, 2), "GONE"])) for n in names]
    issues = check(spark, [(f"P{i}", text(r, names)) for i in range(40)], library, depth=4)
    assert {why for _, _, why in issues} == {"cycle", "too deep", "not found"}


def test_ten_thousand_members(spark):
    """Each member holds up to two of ten times its number, so five levels lie in each other."""
    r = random.Random(5)
    library = [(f"M{i}", f"       05 F{i} PIC X.\n" + "".join(f"       COPY M{10 * i + r.randint(0, 9)}.\n" for _ in range(2)) + f"       05 :T:-{i} PIC 9.") for i in range(1, 10_001)]
    check(spark, [(f"P{i}", f"       COPY M{i % 9 + 1} REPLACING ==:T:== BY ==P{i}==.") for i in range(100)], library)


def test_one_copybook_in_every_program(spark, monkeypatch):
    """Places of a call that very many programs make are dealt to several tasks."""
    monkeypatch.setattr(copies, "LOAD", 50)
    check(spark, [(f"P{i}", "COPY HOT. COPY B." if i % 3 else "COPY B.") for i in range(600)], [("HOT", "01 A PIC X. COPY B."), ("B", "05 B PIC X.")])


def test_libraries_names_and_odd_rows(spark):
    lib = spark.createDataFrame([("a.cpy", "MAIN", None), ("A", "OTHER", "lib1"), ("A", "ZZ", ""), (None, "X", None), ("E", None, None)], "member string, text string, library string")
    src = spark.createDataFrame([("P", "COPY A. COPY A OF LIB1. COPY 'A' IN LIB2. COPY E.", 1), ("P", "COPY A. COPY A OF LIB1. COPY 'A' IN LIB2. COPY E.", 2), ("P", "COPY GONE.", 3), (None, None, 4)], "name string, source string, member int")
    out, issues = copies.expand(src, lib, library_col="library")
    assert sorted((r.program, r.source) for r in out.collect()) == [("", ""), ("P", ""), ("P", "MAIN OTHER MAIN ")]
    assert [(r.program, r.member, r.reason, r.within) for r in issues.collect()] == [("P", "GONE", "not found", [])]
    report = copies.uses(issues).collect()
    assert [(r.member, r.reason, r.places, r.programs) for r in report] == [("GONE", "not found", 1, 1)]


def test_empty_tables(spark):
    assert run(spark, [], [("A", "X")]) == ({}, Counter())
    assert run(spark, [("P", "COPY A.")], []) == ({"P": ""}, Counter({("P", "A", "not found"): 1}))


def test_a_layout_from_expanded_text(spark):
    got, _ = run(spark, [("P", "       01 REC.\n       COPY F REPLACING ==:T:== BY ==CUST==.")], [("F", "       05 :T:-ID PIC 9(5).\n       05 :T:-NAME PIC X(20).")])
    assert [x.name for x in parse_data(got["P"])[0].children] == ["CUST-ID", "CUST-NAME"]
