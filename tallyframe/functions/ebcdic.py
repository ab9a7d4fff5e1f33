"""EBCDIC text and collation as native ``translate`` expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN1 = bytes(range(256)).decode("latin-1")
#: Code points where code page 1047 has what 037 has at the other one.
SWAPPED_1047 = ((0xAD, 0xBA), (0xBD, 0xBB), (0x5F, 0xB0))
NUL = "␀"  # what a zero byte decodes to: translate() drops real NULs


@lru_cache
def page(codepage: str = "cp037") -> str:
    """The 256 characters of a code page, by byte."""
    name = codepage.lower()
    if name == "cp1047":
        chars = list(bytes(range(256)).decode("cp037"))
        for a, b in SWAPPED_1047:
            chars[a], chars[b] = chars[b], chars[a]
        return "".join(chars)
    return bytes(range(256)).decode(name)


def decode(raw: Column, codepage: str = "cp037") -> Column:
    """Text of EBCDIC bytes; slice the bytes first."""
    return F.translate(F.decode(raw, "ISO-8859-1"), LATIN1, NUL + page(codepage)[1:])


def encode(text: Column, codepage: str = "cp037") -> Column:
    """EBCDIC bytes of text; what the code page doesn't have becomes its question mark."""
    own = page(codepage)
    known = F.regexp_replace(text, f"[^{''.join(chr(92) + c if c in chr(92) + ']^-[&' else c for c in own[1:])}]", "?")
    return F.encode(F.translate(known, own[1:], LATIN1[1:]), "ISO-8859-1")


def sort_key(text: Column, codepage: str = "cp037") -> Column:
    """Sorts as the code page's bytes do."""
    return F.translate(text, page(codepage)[1:], LATIN1[1:])


def compared(a: Column, b: Column, codepage: str = "cp037") -> Column:
    """-1, 0 or 1 in EBCDIC order, the shorter one padded with spaces."""
    n = F.greatest(F.length(a), F.length(b))
    x, y = sort_key(F.rpad(a, n, F.lit(" ")), codepage), sort_key(F.rpad(b, n, F.lit(" ")), codepage)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)
