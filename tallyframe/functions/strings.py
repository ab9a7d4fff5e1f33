"""String verbs and intrinsic functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.conf import CobolConf
from tallyframe.functions.pic import Pic
from tallyframe.functions.store import dec, truncated


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _quoted(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|\-&])", r"\\\1", text)


# Intrinsic functions ------------------------------------------------------------------------------------


def integer(x: Column) -> Column:
    """FUNCTION INTEGER, truncating toward zero."""
    return truncated(x, 0)


def length_of(x: Column, pic: Pic | None = None) -> Column:
    """The field's capacity where its picture is known."""
    return F.lit(pic.length or pic.digits) if pic else F.length(x)


def maximum(*xs: Column) -> Column:
    return F.greatest(*xs) if len(xs) > 1 else xs[0]


def minimum(*xs: Column) -> Column:
    return F.least(*xs) if len(xs) > 1 else xs[0]


def mod(a: Column, b: Column) -> Column:
    """The remainder has the dividend's sign; null for a zero divisor."""
    return a % F.nullif(b, dec(0))


def trim(x: Column) -> Column:
    return F.trim(x)


def reverse(x: Column) -> Column:
    return F.reverse(x)


def ord_(x: Column) -> Column:
    """Code point of the first character; 0 of nothing."""
    return F.ascii(x)


def current_date(conf: CobolConf) -> Column:
    """Date, time and offset, from the run's parameters: runs agree."""
    return F.lit((conf.run_date + conf.run_time + "+0000")[:21])


def accept(what: str, conf: CobolConf) -> Column:
    """ACCEPT ... FROM: DATE [YYYYMMDD], DAY [YYYYDDD], DAY-OF-WEEK, TIME."""
    import datetime

    day = datetime.date(int(conf.run_date[:4]), int(conf.run_date[4:6]), int(conf.run_date[6:8]))
    values = {
        "DATE": conf.run_date[2:], "DATE YYYYMMDD": conf.run_date, "DAY": f"{day:%y%j}", "DAY YYYYDDD": f"{day:%Y%j}", "DAY-OF-WEEK": str(day.isoweekday()), "TIME": conf.run_time,
    }
    return F.lit(values.get(what.upper().strip(), ""))


# Moves and reference modification -----------------------------------------------------------------------


def move_text(x: Column, pic: Pic) -> Column:
    """Truncated or padded to the field; right-aligned if justified."""
    if pic.justified:
        return F.when(F.length(x) >= pic.length, F.right(x, F.lit(pic.length))).otherwise(F.lpad(x, pic.length, " "))
    return F.rpad(F.substring(x, 1, pic.length), pic.length, " ")


def refmod(x: Column, start, length=None) -> Column:
    """``X(start:length)``, 1-based."""
    return F.substring(x, lit(start), lit(length) if length is not None else F.length(x))


def refmod_set(x: Column, value: Column, start, length) -> Column:
    n = lit(length)
    return F.overlay(x, F.rpad(F.substring(value, F.lit(1), n), n, F.lit(" ")), lit(start), n)


def group_text(parts: Sequence[tuple[Column, int]]) -> Column:
    """A group as text: its children at their display widths."""
    return F.concat(*(F.rpad(F.substring(c, 1, n), n, " ") for c, n in parts))


def group_slices(text: Column, widths: Sequence[int]) -> list[Column]:
    out, at = [], 1
    for n in widths:
        out.append(F.substring(text, at, n))
        at += n
    return out


# STRING and UNSTRING ------------------------------------------------------------------------------------


def string(parts: Sequence[tuple[Column, Column | str | None]], target: Column, width: int, pointer: Column | int = 1) -> tuple[Column, Column, Column]:
    """STRING parts (value, delimiter; None is SIZE, "SPACE" a space) into ``target`` from ``pointer`` on.
    Returns the target, the new pointer and whether it overflowed (then as much as fits is moved)."""
    pieces = []
    for value, by in parts:
        if by is None:
            pieces.append(value)
        else:
            pieces.append(F.split_part(value, lit(" ") if isinstance(by, str) and by.upper() in ("SPACE", "SPACES") else lit(by), F.lit(1)))
    whole = F.concat(*pieces)
    p = lit(pointer).cast("int")
    room = F.greatest(F.lit(0), F.lit(width) - p + 1)
    moved = F.substring(whole, F.lit(1), F.least(F.length(whole), room))
    bad = (p < 1) | (p > width)
    base = F.rpad(F.substring(target, 1, width), width, " ")
    out = F.when(bad | (moved == ""), base).otherwise(F.overlay(base, moved, p, F.length(moved)))
    return out, F.when(bad, p).otherwise(p + F.length(moved)), bad | (F.length(whole) > room)


def unstring(source: Column, delimiters: Sequence[tuple[str, bool]], n: int, pointer: Column | int = 1) -> list[dict[str, Column]]:
    """UNSTRING into ``n`` fields: for each ``text``, ``delimiter`` and ``count`` (characters examined); delimiters are
    ``(text, ALL)``. A field past the end of the source has a null text: it keeps its value."""
    rest = F.substring(source, lit(pointer).cast("int"), F.length(source))
    each = "|".join(f"(?:{_quoted(d)})+" if every else _quoted(d) for d, every in sorted(delimiters, key=lambda x: -len(x[0])))
    pieces = F.split(rest, each) if each else F.array(rest)
    marks = F.regexp_extract_all(rest, F.lit(f"({each})"), F.lit(1)) if each else F.array().cast("array<string>")
    first = sorted(delimiters, key=lambda x: -len(x[0]))
    out = []
    for k in range(n):
        text = F.get(pieces, F.lit(k))
        mark = F.get(marks, F.lit(k))
        for d, every in first:
            if every:
                mark = F.when(mark.startswith(d), d).otherwise(mark)
        out.append({"text": text, "delimiter": F.coalesce(mark, F.lit("")), "count": F.coalesce(F.length(text), F.lit(0))})
    return out


def unstring_tally(source: Column, delimiters: Sequence[tuple[str, bool]], n: int) -> Column:
    """Fields that received something."""
    return sum((f["text"].isNotNull().cast("int") for f in unstring(source, delimiters, n)), F.lit(0))


# INSPECT ------------------------------------------------------------------------------------------------


def _region(x: Column, before: str | None, after: str | None) -> tuple[Column, Column, Column]:
    """Text ahead of the inspected part, the part, and what follows."""
    head, part = F.lit(""), x
    if after is not None:
        at = F.instr(x, after)
        cut = F.when(at > 0, at + len(after) - 1).otherwise(F.length(x))
        head, part = F.substring(x, F.lit(1), cut), F.substring(x, cut + 1, F.length(x))
    tail = F.lit("")
    if before is not None:
        at = F.instr(part, before)
        cut = F.when(at > 0, at - 1).otherwise(F.length(part))
        part, tail = F.substring(part, F.lit(1), cut), F.substring(part, cut + 1, F.length(part))
    return head, part, tail


def tally(x: Column, what: str, find: str = "", before: str | None = None, after: str | None = None) -> Column:
    """CHARACTERS, ALL or LEADING."""
    _, part, _ = _region(x, before, after)
    if what == "CHARACTERS":
        return F.length(part)
    if what == "ALL":
        return ((F.length(part) - F.length(F.replace(part, F.lit(find), F.lit("")))) / len(find)).cast("int")
    run = F.regexp_extract(part, f"^((?:{_quoted(find)})*)", 1)
    return (F.length(run) / len(find)).cast("int")


def replacing(x: Column, what: str, find: str, by: str, before: str | None = None, after: str | None = None) -> Column:
    """CHARACTERS, ALL, FIRST or LEADING."""
    head, part, tail = _region(x, before, after)
    if what == "CHARACTERS":
        new = F.repeat(F.lit(by), F.length(part))
    elif what == "ALL":
        new = F.replace(part, F.lit(find), F.lit(by))
    elif what == "FIRST":
        at = F.instr(part, find)
        new = F.when(at > 0, F.overlay(part, F.lit(by), at, F.lit(len(find)))).otherwise(part)
    else:
        run = F.length(F.regexp_extract(part, f"^((?:{_quoted(find)})*)", 1))
        new = F.concat(F.repeat(F.lit(by), (run / len(find)).cast("int")), F.substring(part, run + 1, F.length(part)))
    return F.concat(head, new, tail)


def converting(x: Column, find: str, by: str, before: str | None = None, after: str | None = None) -> Column:
    """Character by character; of a repeated character the first mapping holds."""
    seen: dict[str, str] = {}
    for a, b in zip(find, by, strict=True):
        seen.setdefault(a, b)
    head, part, tail = _region(x, before, after)
    return F.concat(head, F.translate(part, "".join(seen), "".join(seen.values())), tail)


def display(*xs: Column) -> Column:
    return F.concat_ws(" ", *(x.cast("string") for x in xs))


def identifier(name: str) -> str:
    """A COBOL name as a column name."""
    return re.sub(r"[^a-z0-9_]", "_", name.strip().lower())
