"""Storing numbers into pictures: truncation, size errors, rounding, exact arithmetic.

Columns are decimals. Every function keeps results exact or within the
picture's own digits; a plain CAST would round, so truncation goes through
``floor``/``ceil`` at a scale, and quotients through remainders of scaled integers.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.conf import CobolConf
from tallyframe.functions.pic import Pic

DEFAULT = CobolConf()


def dec(value, precision: int | None = None, scale: int | None = None) -> Column:
    """A literal, as tight as possible unless told otherwise."""
    d = Decimal(str(value))
    exp = -min(0, d.as_tuple().exponent)
    s = exp if scale is None else scale
    p = max(s + 1, len(d.as_tuple().digits) + max(0, d.as_tuple().exponent), s + len(str(abs(int(d))))) if precision is None else precision
    return F.lit(d).cast(f"decimal({p},{s})")


def truncated(x: Column, scale: int) -> Column:
    """Toward zero at ``scale`` decimals."""
    return F.when(x < 0, F.ceil(x, F.lit(scale))).otherwise(F.floor(x, F.lit(scale)))


def rounded(x: Column, scale: int) -> Column:
    """Half away from zero."""
    return F.round(x, scale)


def kept_whole(pic: Pic, conf: CobolConf) -> bool:
    """Whether a binary field keeps what its bytes hold, not its picture's digits."""
    return conf.trunc == "OPT" or pic.usage == "COMP-5" or (pic.usage == "COMP" and conf.trunc == "BIN")


def store(x: Column, pic: Pic, conf: CobolConf = DEFAULT) -> Column:
    """What a numeric MOVE or COMPUTE leaves in the field."""
    if pic.kind == "float":
        return x.cast(pic.spark_type)
    t = truncated(x, pic.dec_digits)
    if not pic.signed:
        t = F.abs(t)
    if kept_whole(pic, conf):
        return t.cast(f"decimal({min(38, 20 + pic.dec_digits)},{pic.dec_digits})")
    t = t % dec(10**pic.int_digits)
    return t.cast(f"decimal({min(38, max(1, pic.digits))},{pic.dec_digits})")


def size_error(x: Column, pic: Pic, conf: CobolConf = DEFAULT) -> Column:
    """Whether the value doesn't fit: negative into unsigned, or too large."""
    over = F.abs(truncated(x, pic.dec_digits)) > dec(pic.largest(conf.trunc))
    return over if pic.signed else (x < 0) | over


def store_or_keep(x: Column, old: Column, pic: Pic, conf: CobolConf = DEFAULT, rounding: bool = False) -> tuple[Column, Column]:
    """With ON SIZE ERROR: the new value, or the old one where it doesn't fit or is null (a division by zero); and the flag."""
    value = rounded(x, pic.dec_digits) if rounding else x
    bad = F.coalesce(size_error(value, pic, conf), F.lit(True))
    return F.when(bad, old).otherwise(store(value, pic, conf)), bad


def integer_of(x: Column, scale: int) -> Column:
    """``x`` times ten to ``scale`` as an exact integer; ``x`` has at most ``scale`` decimals."""
    return (x * dec(10**scale)).cast("decimal(38,0)")


def decimal_of(n: Column, scale: int, digits: int | None = None) -> Column:
    """An integer of ``digits`` digits over ten to ``scale``. Where a product would lose decimals to the 38 digits of its type, the point is put into the text."""
    digits = digits or 37 - scale - 1
    kind = f"decimal({min(38, digits + scale)},{scale})"
    if digits + scale + 2 <= 38 or not scale:
        return (n.cast(f"decimal({digits},0)") * dec(Decimal(1).scaleb(-scale), scale + 1, scale)).cast(kind)
    text = F.lpad(F.abs(n).cast(f"decimal({digits},0)").cast("string"), digits + 1, "0")
    value = F.concat(F.left(text, F.lit(digits + 1 - scale)) if scale <= digits else F.lit("0"), F.lit("."), F.right(text, F.lit(scale)) if scale <= digits else F.lpad(text, scale, "0")).try_cast(kind)
    return F.when(n < 0, -value).otherwise(value).cast(kind)


def divided(a: Column, a_scale: int, b: Column, b_scale: int, scale: int) -> Column:
    """Quotient truncated toward zero at ``scale`` decimals; null for a zero divisor."""
    e = scale + b_scale - a_scale
    x, y = integer_of(a, a_scale), F.nullif(integer_of(b, b_scale), dec(0, 38, 0))
    if e > 0:
        x = (x.cast(f"decimal({38 - e - 1},0)") * dec(10**e, e + 1, 0)).cast("decimal(38,0)")
    elif e < 0:
        y = (y.cast(f"decimal({38 + e - 1},0)") * dec(10**-e, -e + 1, 0)).cast("decimal(38,0)")
    return decimal_of(((x - x % y) / y).cast("decimal(38,0)"), scale)


def remainder(a: Column, b: Column, quotient: Column) -> Column:
    """What DIVIDE ... REMAINDER leaves: a minus the stored quotient times b."""
    return a - quotient * b


def worst_case_digits(op: str, left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int] | None:
    """Integer and decimal digits that a result can need; none can be told for a quotient."""
    (i, d), (j, e) = left, right
    if op in "+-":
        return max(i, j) + 1, max(d, e)
    if op == "*":
        return i + j, d + e
    return None
