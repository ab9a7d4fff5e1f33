"""Numbers of any size as texts: one canonical form, exact differences, comparisons. For values that no decimal type holds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits that are added or subtracted at once.
CHUNK = 17
FORM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _part(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1)


def _tidy(text: Column) -> Column:
    """Without plus sign and needless zeros."""
    for pattern, by in ((r"^\+", ""), (r"(?<![0-9])\.", "0."), (r"(?<=\.)([0-9]*?)0+$", "$1"), (r"\.$", ""), (r"^(-?)0+(?=[0-9])", "$1"), (r"^-(?=0$)", "")):
        text = F.regexp_replace(text, pattern, by)
    return text


def _moved(text: Column) -> Column:
    """A number with an exponent, without it."""
    every = F.concat(_part(text, r"^[+-]?([0-9]*)"), _part(text, r"\.([0-9]*)"))
    point = F.length(_part(text, r"^[+-]?([0-9]*)")) + _part(text, r"[eE]([+-]?[0-9]+)$").try_cast("int")

    def placed(x: Column) -> Column:
        digits, at = x["digits"], x["at"]
        whole = F.when(at > 0, F.rpad(F.left(digits, at), at, F.lit("0"))).otherwise("")
        fraction = F.when(at < 0, F.concat(F.repeat(F.lit("0"), -at), digits)).otherwise(F.substring(digits, at + 1, F.length(digits)))
        return F.concat(_part(text, "^([+-]?)"), whole, F.lit("."), fraction)

    return _let(F.struct(every.alias("digits"), point.alias("at")), placed)


def canonical(text: Column) -> Column:
    """A number's only text: no plus sign, exponent, leading or trailing zeros, minus zero; null of what is no number."""
    t = F.trim(text)
    return F.when(t.rlike(FORM), F.when(t.rlike("[eE]"), _tidy(_moved(t))).otherwise(_tidy(t)))


def negated(number: Column) -> Column:
    """Of a canonical number."""
    return F.when(number == "0", number).when(number.startswith("-"), F.substring(number, F.lit(2), F.length(number))).otherwise(F.concat(F.lit("-"), number))


def whole_of(number: Column) -> Column:
    """Integer digits of a canonical number."""
    return _part(number, r"^-?([0-9]+)")


def fraction_of(number: Column) -> Column:
    return _part(number, r"\.([0-9]+)$")


def difference(a: Column, b: Column) -> Column:
    """|a - b| of canonical numbers, canonical. Digits are worked on in chunks from the right, with a carry."""
    places = lambda part: F.greatest(F.length(part(a)), F.length(part(b))).alias(part.__name__)

    def with_places(p: Column) -> Column:
        f = p["fraction_of"]
        n = (F.ceil((p["whole_of"] + f + 1) / CHUNK) * CHUNK).cast("int")
        digits = lambda x: F.lpad(F.concat(whole_of(x), F.rpad(fraction_of(x), f, F.lit("0"))), n, F.lit("0"))
        both = F.sort_array(F.array(digits(a), digits(b)))  # of one length: as texts as numbers
        sign = F.when(a.startswith("-") == b.startswith("-"), -1).otherwise(1).cast("bigint")
        return _let(F.struct(both.alias("both"), n.alias("n"), f.alias("f"), sign.alias("sign")), apart)

    def apart(x: Column) -> Column:
        unit = F.lit(10**CHUNK).cast("bigint")

        def step(state: Column, k: Column) -> Column:
            chunk = lambda s: F.substring(s, k * CHUNK + 1, F.lit(CHUNK)).cast("bigint")
            v = chunk(F.get(x["both"], F.lit(1))) + x["sign"] * chunk(F.get(x["both"], F.lit(0))) + state["carry"]
            carry = lambda v: F.when(v < 0, -1).when(v >= unit, 1).otherwise(0).cast("bigint")
            return _let(v, lambda v: F.struct(F.concat(F.lpad((v - carry(v) * unit).cast("string"), CHUNK, "0"), state["text"]).alias("text"), carry(v).alias("carry")))

        start = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("carry"))
        text = F.aggregate(F.sequence((x["n"] / CHUNK).cast("int") - 1, F.lit(0), F.lit(-1)), start, step, lambda s: s["text"])
        return _tidy(_let(text, lambda t: F.concat(F.left(t, x["n"] - x["f"]), F.lit("."), F.right(t, x["f"]))))

    return _let(F.struct(places(whole_of), places(fraction_of)), with_places)


def below(size: Column, limit: str) -> Column:
    """Whether a canonical number that isn't negative is less than ``limit``, a text of a number below one."""
    return (whole_of(size) == "0") & (fraction_of(size) < limit.partition(".")[2])


def above(size: Column, limit: int) -> Column:
    """Whether a canonical number that isn't negative is more than the whole number ``limit``."""
    whole, digits = whole_of(size), len(str(limit))
    return (F.length(whole) > digits) | ((F.length(whole) == digits) & ((whole > str(limit)) | ((whole == str(limit)) & (fraction_of(size) != ""))))


def cut(number: Column, ints: int, decs: int) -> Column:
    """A canonical number as a decimal of the last ``ints`` integer digits and the first ``decs`` decimals: cut, never rounded."""
    text = F.concat(F.when(number.startswith("-"), "-").otherwise(""), F.right(whole_of(number), F.lit(ints)), F.lit("."), F.left(fraction_of(number), F.lit(decs)), F.lit("0"))
    return text.try_cast(f"decimal({min(38, ints + decs)},{decs})")


# Products and quotients: digits in limbs ----------------------------------------------------------------

#: Digits of a limb; products of two limbs and sums of thousands of them fit 64 bits.
LIMB = 7
#: Digits of a divisor: a remainder and a next digit must fit the widest decimal.
DIVISOR = 37


def less(a: Column, b: Column) -> Column:
    """Whether a < b, of canonical numbers."""
    size = lambda x: F.struct(F.length(whole_of(x)), whole_of(x), fraction_of(x))
    minus = lambda x: x.startswith("-")
    return F.when(minus(a) != minus(b), minus(a)).when(minus(a), size(b) < size(a)).otherwise(size(a) < size(b))


def minus(a: Column, b: Column) -> Column:
    """a - b of canonical numbers, canonical."""
    return _let(F.struct(difference(a, b).alias("size"), less(a, b).alias("less")), lambda x: F.when(x["less"], negated(x["size"])).otherwise(x["size"]))


def plus(a: Column, b: Column) -> Column:
    return minus(a, negated(b))


def _digits(number: Column) -> Column:
    return F.concat(whole_of(number), fraction_of(number))


def _signed(negative: Column, digits: Column, decs: Column) -> Column:
    """The canonical number of ``digits`` of which the last ``decs`` are decimals."""

    def placed(d: Column) -> Column:
        padded = F.lpad(d, F.greatest(F.length(d), decs + 1), F.lit("0"))
        return _let(padded, lambda p: _tidy(F.concat(F.when(negative, "-").otherwise(""), F.left(p, F.length(p) - decs), F.lit("."), F.right(p, decs))))

    return _let(digits, placed)


def product(a: Column, b: Column) -> Column:
    """a * b of canonical numbers, canonical: the schoolbook product of limbs, then one pass of carries."""

    def limbs(number: Column) -> Column:
        def cut_up(d: Column) -> Column:
            n = F.ceil(F.length(d) / LIMB).cast("int")
            padded = F.lpad(d, n * LIMB, F.lit("0"))
            return F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda k: F.substring(padded, k * LIMB + 1, F.lit(LIMB)).cast("bigint"))

        return _let(_digits(number), cut_up)

    def multiplied(x: Column) -> Column:
        p, q = x["p"], x["q"]
        n, m = F.size(p), F.size(q)

        def column(k: Column) -> Column:
            first, last = F.greatest(F.lit(0), k - m + 1), F.least(k, n - 1)
            pairs = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda total, i: total + F.get(p, i) * F.get(q, k - i))

        unit = F.lit(10**LIMB).cast("bigint")

        def carried(state: Column, v: Column) -> Column:
            return _let(v + state["carry"], lambda s: F.struct(F.concat(F.lpad((s % unit).cast("string"), LIMB, "0"), state["text"]).alias("text"), F.floor(s / unit).cast("bigint").alias("carry")))

        start = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("carry"))
        sums = F.transform(F.sequence(F.lit(0), n + m - 1), column)  # the last one takes the last carry
        return F.aggregate(sums, start, carried, lambda s: s["text"])

    digits = _let(F.struct(limbs(a).alias("p"), limbs(b).alias("q")), multiplied)
    return _signed(a.startswith("-") != b.startswith("-"), digits, F.length(fraction_of(a)) + F.length(fraction_of(b)))


def quotient(a: Column, b: Column, scale: int) -> Column:
    """a / b of canonical numbers toward zero at ``scale`` decimals, canonical; null for a division by zero. Long division, up to six digits a step; a
    divisor of more than ``DIVISOR`` digits is an error."""

    def divided(x: Column) -> Column:
        shift = F.lit(scale) + F.length(fraction_of(b)) - F.length(fraction_of(a))
        whole = _digits(a)
        # further decimals of the dividend can't change a quotient that is cut
        digits = F.when(shift >= 0, F.concat(whole, F.repeat(F.lit("0"), shift))).otherwise(F.left(whole, F.greatest(F.lit(0), F.length(whole) + shift)))
        width = F.least(F.lit(6), F.lit(DIVISOR + 1) - F.length(x["divisor"]))
        return _let(F.struct(digits.alias("digits"), width.alias("width"), x["divisor"].cast("decimal(38,0)").alias("by")), walked)

    def walked(x: Column) -> Column:
        n = F.ceil(F.length(x["digits"]) / x["width"]).cast("int")
        padded = F.lpad(x["digits"], n * x["width"], F.lit("0"))
        zero = F.lit(0).cast("decimal(38,0)")

        def step(state: Column, k: Column) -> Column:
            value = F.concat(state["rest"].cast("string"), F.substring(padded, k * x["width"] + 1, x["width"])).cast("decimal(38,0)")
            return _let(value, lambda v: F.struct(F.concat(state["text"], F.lpad(((v - v % x["by"]) / x["by"]).cast("bigint").cast("string"), x["width"], F.lit("0"))).alias("text"), (v % x["by"]).cast("decimal(38,0)").alias("rest")))

        start = F.struct(F.lit("").alias("text"), zero.alias("rest"))
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), start, step, lambda s: s["text"])).otherwise("0")

    divisor = F.regexp_replace(_digits(b), "^0+(?=.)", "")
    text = _let(F.struct(divisor.alias("divisor")), divided)
    told = F.when(F.length(divisor) > DIVISOR, F.raise_error(F.lit(f"a divisor of more than {DIVISOR} digits"))).otherwise(text)
    return F.when(b != "0", _signed(a.startswith("-") != b.startswith("-"), told, F.lit(scale)))


def narrowed(number: Column, ints: int, decs: int) -> Column:
    """A canonical number as a decimal for a field of ``ints`` integer digits: its first ``decs`` decimals and last ``ints`` integer digits, with a one before them where
    it has more, so it overflows as the number does."""
    whole = whole_of(number)
    low = F.when(F.length(whole) > ints, F.concat(F.lit("1"), F.right(whole, F.lit(ints)))).otherwise(whole)
    text = F.concat(F.when(number.startswith("-"), "-").otherwise(""), low, F.lit("."), F.rpad(F.left(fraction_of(number), F.lit(decs)), max(decs, 1), "0"))
    return text.cast(f"decimal({min(38, ints + 1 + decs)},{decs})")


# Numbers whose greatest sizes are known: limbs in columns -----------------------------------------------

#: Digits of such a limb; products of two limbs and sums of hundreds of them fit 64 bits.
FIXED = 8
UNIT = 10**FIXED
#: Steps of a long division that stand side by side; a longer one loops over texts.
STEPS = 24

_div = lambda a, b: F.call_function("div", a, b)  # noqa: E731  the whole part of a quotient, toward zero
_long = lambda n: F.lit(n).cast("bigint")
#: Names columns (a projection), so that each is computed once, and returns them.
Keep = Callable[..., list[Column]]


class Wide:
    """A number as signed limbs from the lowest, of which ``decs`` digits are decimals: 64-bit columns, which compile to machine arithmetic. Each is below ``UNIT`` in size, the
    highest may reach it."""

    def __init__(self, limbs: list[Column], decs: int):
        self.limbs, self.decs = limbs, decs


def fixed(number: Column, digits: int, decs: int, keep: Keep) -> Wide:
    """Of a decimal column of ``digits`` digits, ``decs`` of them decimals."""
    number, n = number.cast(f"decimal({digits},{decs})"), -(-digits // FIXED)
    bare = lambda x: F.translate(x.cast("string"), "-.", "")  # noqa: E731  F.abs would round negative numbers to 34 digits
    if decs > 37:
        text = F.rpad(fraction_of(canonical(number.cast("string"))), decs, F.lit("0"))
    elif decs:  # texts of small numbers may have exponents, so they are moved away from zero
        small = f"decimal({decs + 1},{decs})"
        moved = (number.cast(small) + F.when(number < 0, -1).otherwise(1)).cast(small)
        text = F.when((number > -1) & (number < 1), F.overlay(bare(moved), F.lit("0"), F.lit(1))).otherwise(bare(number))
    else:
        text = bare(number)
    negative, text = keep(number < 0, F.lpad(F.right(text, F.lit(digits)), n * FIXED, "0"))
    limb = lambda k: F.substring(text, (n - 1 - k) * FIXED + 1, FIXED).cast("bigint")
    return Wide(keep(*(F.when(negative, -limb(k)).otherwise(limb(k)) for k in range(n))), decs)


def _carried(sums: list[Column], keep: Keep) -> list[Column]:
    carry, out = None, []
    for k, s in enumerate(keep(*sums)):
        s = s if carry is None else s + carry
        out.append(s % UNIT if k < len(sums) - 1 else s)
        carry = _div(s, _long(UNIT))
    return keep(*out)


def wide_product(a: Wide, b: Wide, keep: Keep) -> Wide:
    n, m = len(a.limbs), len(b.limbs)
    pairs = [[a.limbs[i] * b.limbs[k - i] for i in range(max(0, k - m + 1), min(k, n - 1) + 1)] for k in range(n + m)]
    return Wide(_carried([reduce(add, x) if x else _long(0) for x in pairs], keep), a.decs + b.decs)


def wide_sum(a: Wide, b: Wide, keep: Keep) -> Wide:
    decs = max(a.decs, b.decs)

    def shifted(x: Wide) -> list[Column]:
        limbs, rest = divmod(decs - x.decs, FIXED)
        # what is shifted has a limb more
        return [_long(0)] * limbs + (_carried([v * _long(10**rest) for v in x.limbs] + [_long(0)], keep) if rest else x.limbs)

    p, q = shifted(a), shifted(b)
    n = max(len(p), len(q)) + 1
    p, q = (x + [_long(0)] * (n - len(x)) for x in (p, q))
    return Wide(_carried([x + y for x, y in zip(p, q, strict=True)], keep), decs)


def wide_negated(a: Wide) -> Wide:
    return Wide([-x for x in a.limbs], a.decs)


class Digits:
    """A number as its sign and the text of exactly ``length`` digits, of which the last ``decs`` are decimals."""

    def __init__(self, negative: Column, text: Column, length: int, decs: int):
        self.negative, self.text, self.length, self.decs = negative, text, length, decs

    @property
    def number(self) -> Column:
        return _signed(self.negative, self.text, F.lit(self.decs))


def wide_digits(a: Wide, keep: Keep) -> Digits:
    sign = F.lit(False)
    for x in a.limbs:  # the highest limb that isn't zero tells the sign: those below it are less than its unit
        sign = F.when(x == 0, sign).otherwise(x < 0)
    [negative] = keep(sign)
    sizes, carry, out = keep(*(F.when(negative, -x).otherwise(x) for x in a.limbs)), None, []
    for k, s in enumerate(sizes):
        s = s if carry is None else s + carry
        out.append(F.pmod(s, _long(UNIT)) if k < len(sizes) - 1 else s)
        carry = _div(s + _long(2 * UNIT), _long(UNIT)) - 2  # downward
    top = FIXED + 2
    length, decs = len(out) * FIXED + 2, a.decs
    text = F.concat(F.lpad(out[-1].cast("string"), top, "0"), *(F.lpad(x.cast("string"), FIXED, "0") for x in reversed(out[:-1])))
    if length <= decs:
        text, length = F.lpad(text, decs + 1, "0"), decs + 1
    return Digits(negative, *keep(text), length, decs)


def wide_quotient(a: Wide, b: Wide, digits: int, scale: int, keep: Keep) -> Digits | None:
    """a / b toward zero at ``scale`` decimals, null for a division by zero; ``b`` has at most ``digits`` digits (``DIVISOR`` at most). None if the division would take too many steps."""
    p, q = wide_digits(a, keep), wide_digits(b, keep)
    shift = scale + b.decs - a.decs
    length, width = p.length + shift, min(18, 38 - digits)
    if length <= 0:
        return Digits(F.lit(False), F.when(q.number != "0", F.lit("0" * (scale + 1))), scale + 1, scale)
    steps = -(-length // width)
    if steps > STEPS:
        return None
    # further decimals of the dividend can't change a quotient that is cut
    [text] = keep(F.lpad(F.rpad(p.text, length, "0"), steps * width, "0"))
    by, rest, out = keep(F.nullif(F.right(q.text, F.lit(digits)).cast(f"decimal({digits},0)"), F.lit(0).cast(f"decimal({digits},0)")))[0], None, []
    for k in range(steps):
        value = F.substring(text, k * width + 1, width).cast("decimal(38,0)")
        if rest is not None:
            value = ((rest * F.lit(10**width).cast(f"decimal({width + 1},0)")).cast("decimal(38,0)") + value).cast("decimal(38,0)")
        [value] = keep(value)
        part, rest = keep(_div(value, by), (value % by).cast(f"decimal({digits},0)"))
        out.append(F.lpad(part.cast("string"), width, "0"))
    length = max(steps * width, scale + 1)
    return Digits(p.negative != q.negative, *keep(F.lpad(F.concat(*out), length, "0")), length, scale)


def digits_narrowed(x: Digits, ints: int, decs: int) -> Column:
    """As ``narrowed``."""
    whole = x.length - x.decs
    part = lambda at, n: F.substring(x.text, at + 1, n)
    low = part(max(0, whole - ints), min(ints, whole))
    if whole > ints:
        low = F.concat(F.when(part(0, whole - ints) != "0" * (whole - ints), "1").otherwise("0"), low)
    fraction = F.rpad(part(whole, min(decs, x.decs)), max(decs, 1), "0") if decs and x.decs else F.lit("0" * max(decs, 1))
    return F.concat(F.when(x.negative, "-").otherwise(""), low, F.lit("."), fraction).cast(f"decimal({min(38, ints + 1 + decs)},{decs})")
