"""Numeric-edited pictures, unrolled at plan time into one expression per symbol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.pic import Pic, expanded
from tallyframe.functions.store import integer_of, truncated


def edited(x: Column, pic: Pic, currency: str = "$") -> Column:
    """A value as an edited field shows it. Leading zeros are suppressed up to the first significant digit,
    the first ``9`` or the first digit behind the point; floating signs stand just before what is shown."""
    symbols = expanded(pic.picture)
    tail = ""
    if symbols.endswith(("CR", "DB")):
        symbols, tail = symbols[:-2], symbols[-2:]
    elif len(symbols) > 1 and symbols[-1] in "+-" and symbols.count(symbols[-1]) == 1:
        symbols, tail = symbols[:-1], symbols[-1]
    floating = next((c for c in "$+-" if symbols.count(c) > 1), "")
    n = pic.digits
    scaled = integer_of(truncated(F.abs(x), pic.dec_digits), pic.dec_digits)
    d = F.right(F.lpad(scaled.cast("string"), n + 38, "0"), F.lit(n))
    zero = F.replace(d, F.lit("0"), F.lit("")) == ""
    negative = (x < 0) & ~zero
    first = F.length(d) - F.length(F.ltrim(F.translate(d, "0", " "))) + 1

    # digit number of each symbol, and the digit from which zeros are shown
    numbers, at, seen_float, point, forced = [], 0, False, False, n + 1
    for c in symbols:
        is_digit = c in "9Z*" or (c == floating and seen_float)
        seen_float |= c == floating and bool(floating)
        if is_digit:
            at += 1
            if c == "9" or point:
                forced = min(forced, at)
        point |= c in ".V"
        numbers.append(at if is_digit else 0)
    suppressible = all(c not in "9" for c in symbols) and forced <= n  # Z or floats behind the point too
    shown_from = F.least(first, F.lit(forced))
    fill = "*" if "*" in symbols else " "

    out, at = [], 0
    for c, k in zip(symbols, numbers, strict=True):
        if k:
            at = k
            out.append(F.when(shown_from <= k, F.substring(d, k, 1)).otherwise(fill))
        elif c == ",":
            out.append(F.when(shown_from <= at, ",").otherwise(fill))
        elif c == ".":
            out.append(F.lit("."))
        elif c == "B":
            out.append(F.when((shown_from <= at) | (at == 0), " ").otherwise(fill))
        elif c in "0/":
            out.append(F.when((shown_from <= at) | F.lit(at == 0), c).otherwise(fill))
        elif c == "$" and not floating == "$":
            out.append(F.lit(currency))
        elif c in "+-" and c != floating:
            out.append(F.when(negative, "-").otherwise("+" if c == "+" else " "))
        elif c == floating:
            out.append(F.lit(""))  # stands for the sign itself
    symbols = symbols.replace("V", "")
    body = F.concat(*out)
    if floating:
        sign = F.lit(currency) if floating == "$" else F.when(negative, "-").otherwise("+" if floating == "+" else "")
        body = F.lpad(F.concat(sign, F.ltrim(body)), len(symbols), " ")
    if tail in ("CR", "DB"):
        body = F.concat(body, F.when(negative, tail).otherwise("  "))
    elif tail:
        body = F.concat(body, F.when(negative, "-").otherwise("+" if tail == "+" else " "))
    width = len(symbols) + len(tail)
    if suppressible:  # nothing but the point would be left of a zero
        body = F.when(zero, F.lit("".join("." if c == "." and fill == "*" else fill for c in symbols + " " * len(tail)))).otherwise(body)
    if pic.blank_zero:
        body = F.when(zero, F.lit(" " * width)).otherwise(body)
    return body
