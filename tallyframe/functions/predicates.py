"""Conditions: relations, 88-levels, class tests, EVALUATE."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import ebcdic


def relation(a: Column, op: str, b: Column, text: bool = False, codepage: str = "cp037") -> Column:
    """Numbers compare as numbers. Texts order as the code page does; their equality is that of trimmed texts."""
    if text:
        if op in ("=", "<>"):
            same = F.rtrim(a) == F.rtrim(b)
            return same if op == "=" else ~same
        c = ebcdic.compared(a, b, codepage)
        return {"<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op]
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def named(parent: Column, values: Sequence, text: bool = False, codepage: str = "cp037") -> Column:
    """An 88-level: any of its values; a pair is a range."""
    tests = []
    for v in values:
        if isinstance(v, tuple):
            low, high = (F.lit(x) if not isinstance(x, Column) else x for x in v)
            tests.append(relation(parent, ">=", low, text, codepage) & relation(parent, "<=", high, text, codepage))
        else:
            tests.append(relation(parent, "=", v if isinstance(v, Column) else F.lit(v), text, codepage))
    return reduce(lambda x, y: x | y, tests)


def is_class(x: Column, kind: str) -> Column:
    """NUMERIC, ALPHABETIC, ALPHABETIC-LOWER, ALPHABETIC-UPPER."""
    if kind == "NUMERIC":
        return F.regexp_replace(F.trim(x), r"[.\-+]", "").rlike(r"^\d+$")
    return F.replace(x, F.lit(" "), F.lit("")).rlike({"ALPHABETIC": "^[A-Za-z]*$", "ALPHABETIC-LOWER": "^[a-z]*$", "ALPHABETIC-UPPER": "^[A-Z]*$"}[kind])


def evaluate(whens: Sequence[tuple[Sequence[Column], Column]], other: Column) -> Column:
    """The first WHEN group (its conditions are OR-ed) that holds; null conditions don't."""
    out = None
    for conditions, value in whens:
        test = F.coalesce(reduce(lambda x, y: x | y, conditions), F.lit(False))
        out = F.when(test, value) if out is None else out.when(test, value)
    return other if out is None else out.otherwise(other)


def evaluate_also(whens: Sequence[tuple[Sequence[Column | None], Column]], other: Column) -> Column:
    """Several subjects: a WHEN holds if all its conditions do (None is ANY)."""
    return evaluate([([reduce(lambda x, y: x & y, [c for c in cs if c is not None], F.lit(True))], v) for cs, v in whens], other)


def blank(line: Column) -> Column:
    return F.trim(line) == ""
