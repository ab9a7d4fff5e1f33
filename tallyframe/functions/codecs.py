"""Field codecs: packed, zoned, display, binary and float forms as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import ebcdic
from tallyframe.functions.pic import Pic
from tallyframe.functions.store import dec, decimal_of, integer_of, truncated

#: Last characters of zoned numbers, for 0 to 9.
POSITIVE, NEGATIVE = "{ABCDEFGHI", "}JKLMNOPQR"
ABEND = "S0C7"


def _digits(x: Column, pic: Pic) -> Column:
    """The picture's digits of a value, zero-padded; high digits that don't fit are lost."""
    n = integer_of(truncated(F.abs(x), pic.dec_digits), pic.dec_digits)
    return F.right(F.lpad(n.cast("string"), max(pic.digits, 1) + 38, "0"), F.lit(max(pic.digits, 1)))


def comp3_decode(raw: Column, scale: int = 0, numproc: str = "NOPFD") -> Column:
    """Packed decimal: B and D are negative, other signs positive; null where a digit isn't one and, with NUMPROC(PFD), where the sign isn't C, D or F."""
    h = F.hex(raw)
    body = F.substring(h, F.lit(1), F.length(h) - 1)
    value = decimal_of(F.when(h.rlike("^[0-9]+[CDF]$" if numproc == "PFD" else "^[0-9]+[A-F]$"), body).cast("decimal(31,0)"), scale, 31)
    return F.when(F.right(h, F.lit(1)).isin("B", "D"), -value).otherwise(value)


def comp3_encode(x: Column, pic: Pic) -> Column:
    sign = F.when(x < 0, "D").otherwise("C") if pic.signed else F.lit("F")
    pad = "" if pic.digits % 2 else "0"
    return F.unhex(F.concat(F.lit(pad), _digits(x, pic), sign))


def zoned_decode(text: Column, scale: int = 0) -> Column:
    """Overpunched last digit; plain digits are positive; null if malformed."""
    last = F.right(text, F.lit(1))
    body = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.translate(last, POSITIVE + NEGATIVE, "0123456789" * 2))
    value = decimal_of(F.when(body.rlike("^[0-9]{1,31}$"), body).cast("decimal(31,0)"), scale, 31)
    return F.when(last.rlike("^[}J-R]$"), -value).otherwise(value)


def zoned_encode(x: Column, pic: Pic) -> Column:
    d = _digits(x, pic)
    last, body = F.right(d, F.lit(1)), F.substring(d, 1, pic.digits - 1)
    if not pic.signed:
        return d
    negative = (x < 0) & (F.regexp_replace(d, "0", "") != "")  # no minus zero
    return F.concat(body, F.when(negative, F.translate(last, "0123456789", NEGATIVE)).otherwise(F.translate(last, "0123456789", POSITIVE)))


def display_encode(x: Column, pic: Pic, codepage: str = "cp037") -> Column:
    return ebcdic.encode(_digits(x, pic), codepage)


def display_decode(raw: Column, scale: int = 0, codepage: str = "cp037") -> Column:
    t = ebcdic.decode(raw, codepage)
    return decimal_of(F.when(t.rlike("^[0-9]{1,31}$"), t).cast("decimal(31,0)"), scale, 31)


def binary_decode(raw: Column, n_bytes: int, scale: int = 0, signed: bool = True) -> Column:
    """Big-endian two's complement."""
    n = F.conv(F.hex(raw), 16, 10).cast("decimal(20,0)")
    if signed:
        n = F.when(n >= dec(2 ** (8 * n_bytes - 1), 20, 0), n - dec(2 ** (8 * n_bytes), 20, 0)).otherwise(n)
    return decimal_of(n.cast("decimal(20,0)"), scale, 20)


def binary_encode(x: Column, pic: Pic) -> Column:
    n = integer_of(truncated(x, pic.dec_digits), pic.dec_digits).cast("bigint")
    return F.unhex(F.right(F.lpad(F.hex(n), 16, "0"), F.lit(2 * pic.storage_bytes)))


@F.pandas_udf(T.DoubleType())
def float_decode(raw: pd.Series) -> pd.Series:
    """IEEE big-endian, 4 or 8 bytes (no native expression reads float bits); null of other lengths."""
    out, sizes = np.full(len(raw), np.nan), raw.str.len().to_numpy()
    null = np.ones(len(raw), dtype=bool)
    for n in (4, 8):
        rows = np.flatnonzero(sizes == n)
        out[rows] = np.frombuffer(b"".join(raw.iloc[rows]), dtype=f">f{n}")
        null[rows] = False
    return pd.Series(out, dtype=object).mask(null, None)


def _bits(x: pd.Series, n: int) -> pd.Series:
    """Big-endian bytes of each number; null of null and of what is no number."""
    values = x.to_numpy(dtype=np.float64, na_value=np.nan)
    raw = values.astype(f">f{n}").tobytes()
    return pd.Series([None if none else raw[n * i : n * i + n] for i, none in enumerate(np.isnan(values).tolist())], dtype=object)


@F.pandas_udf(T.BinaryType())
def float_encode(x: pd.Series) -> pd.Series:
    return _bits(x, 8)


@F.pandas_udf(T.BinaryType())
def single_encode(x: pd.Series) -> pd.Series:
    return _bits(x, 4)


def validated(text: Column, pic: Pic, scale: int = 10) -> Column:
    """Struct ``value`` (of ``scale`` decimals), ``abend``: a numeric field as read. Blank is 0, zero bytes are zeros, all x'FF' is the largest value,
    overpunches decode (scaled), other numbers are taken as written; anything else is an S0C7, and so is what ``scale`` decimals and 38 digits can't hold."""
    t = F.trim(F.replace(text, F.lit(ebcdic.NUL), F.lit("0")))
    t = F.replace(t, F.lit("\0"), F.lit("0"))
    wide = f"decimal(38,{scale})"
    all_high = (F.length(t) > 0) & (F.replace(t, F.lit("ÿ"), F.lit("")) == "")
    plain = t.rlike(rf"^[+-]?\d+(\.\d{{0,{scale}}}0*)?$") if scale else t.rlike(r"^[+-]?\d+(\.0*)?$")
    zoned = t.rlike(r"^\d*[{}A-R]$")
    value = F.when(t == "", dec(0).cast(wide)).when(all_high, dec(pic.largest()).cast(wide)).when(plain, t.try_cast(wide)).when(zoned, zoned_decode(t, pic.dec_digits).cast(wide))
    return F.struct(value.alias("value"), F.when(value.isNull() & text.isNotNull(), ABEND).alias("abend"))


def text_decode(text: Column, length: int) -> Column:
    return F.rtrim(F.substring(text, 1, length))


def text_encode(text: Column, length: int, codepage: str = "cp037") -> Column:
    return ebcdic.encode(F.rpad(F.substring(F.coalesce(text, F.lit("")), 1, length), length, " "), codepage)


def to_display(x: Column, pic: Pic) -> Column:
    """Digits as DISPLAY shows them, with a sign byte where the field has one, spaces for a blank-when-zero 0."""
    d = _digits(x, pic)
    if pic.signed:
        sign = F.when(x < 0, "-").otherwise("+" if pic.sign_separate else "")
        d = F.concat(sign, d) if pic.sign_leading or not pic.sign_separate else F.concat(d, sign)
    return F.when(x == 0, F.lit(" " * (pic.digits + (pic.signed and pic.sign_separate)))).otherwise(d) if pic.blank_zero else d


def float_store(x: Column, single: bool) -> Column:
    return x.cast("float" if single else "double")


def edited_number(text: Column) -> Column:
    """The text of the number in an edited text; a minus sign, CR or DB make it negative. Without digits it is none."""
    return F.concat(F.when(text.rlike("-|CR|DB"), "-").otherwise(""), F.regexp_replace(text, "[^0-9.]", ""))


def numeric_of_edited(text: Column, scale: int = 10) -> Column:
    """The number in an edited text; null without digits."""
    value = edited_number(text)
    return F.when(value.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), value).try_cast(f"decimal(38,{scale})")
