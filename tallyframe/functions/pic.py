"""Picture clauses: what a field can hold, how many bytes it takes, its Spark type."""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import types as T

#: Usages by their spelling.
USAGES = {
    "COMP-3": "COMP-3", "COMPUTATIONAL-3": "COMP-3", "PACKED-DECIMAL": "COMP-3", "COMP": "COMP", "COMPUTATIONAL": "COMP", "COMP-4": "COMP", "COMPUTATIONAL-4": "COMP",
    "BINARY": "COMP", "COMP-5": "COMP-5", "COMPUTATIONAL-5": "COMP-5", "COMP-1": "COMP-1", "COMPUTATIONAL-1": "COMP-1", "COMP-2": "COMP-2", "COMPUTATIONAL-2": "COMP-2",
    "DISPLAY": "DISPLAY", "INDEX": "COMP",
}


class PictureError(ValueError):
    pass


def expanded(picture: str) -> str:
    """``S9(3)V99`` as ``S999V99``."""
    out = re.sub(r"(CR|DB|.)\((\d+)\)", lambda m: m[1] * int(m[2]), picture.upper().strip().rstrip("."))
    if len(out) > 100_000:
        raise PictureError(f"picture too long: {picture}")
    return out


@dataclass(frozen=True)
class Pic:
    picture: str
    kind: str  # number | text | edited | float
    int_digits: int = 0
    dec_digits: int = 0
    signed: bool = False
    usage: str = "DISPLAY"
    scale_p: int = 0  # stored value times 10 ** scale_p
    length: int = 0  # characters of a text or edited field
    sign_leading: bool = False
    sign_separate: bool = False
    blank_zero: bool = False
    justified: bool = False

    @property
    def digits(self) -> int:
        return self.int_digits + self.dec_digits

    @property
    def is_number(self) -> bool:
        return self.kind == "number"

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == "float":
            return T.FloatType() if self.usage == "COMP-1" else T.DoubleType()
        if self.kind != "number":
            return T.StringType()
        digits = self.digits
        if self.usage in ("COMP", "COMP-5"):
            digits = max(digits, {2: 5, 4: 10, 8: 20}[self.storage_bytes])
        return T.DecimalType(min(38, max(1, digits)), self.dec_digits)

    @property
    def storage_bytes(self) -> int:
        """Bytes in a record of the machine's own form."""
        if self.kind == "float":
            return 4 if self.usage == "COMP-1" else 8
        if self.kind != "number":
            return self.length
        if self.usage == "COMP-3":
            return self.digits // 2 + 1
        if self.usage in ("COMP", "COMP-5"):
            return 2 if self.digits <= 4 else 4 if self.digits <= 9 else 8
        return self.digits + (self.signed and self.sign_separate)

    @property
    def display_bytes(self) -> int:
        """Characters in a text rendering: digits, a sign, a point."""
        if self.kind != "number":
            return self.length
        return self.digits + self.signed + (self.dec_digits > 0)

    def largest(self, trunc: str = "STD") -> Decimal:
        """The largest value a store can leave."""
        if self.usage == "COMP-5" or (self.usage == "COMP" and trunc == "BIN"):
            bits = 8 * self.storage_bytes - 1
            return Decimal(2 ** (bits) - 1).scaleb(-self.dec_digits) if self.dec_digits else Decimal(2**bits - 1)
        return Decimal(10**self.digits - 1).scaleb(-self.dec_digits)


def parse(picture: str, usage: str = "DISPLAY", sign: str = "", blank_zero: bool = False, justified: bool = False) -> Pic:
    """A picture with its clauses; ``sign`` is like ``LEADING SEPARATE``."""
    usage = USAGES.get(usage.upper().rstrip("."), None) or "DISPLAY"
    if usage in ("COMP-1", "COMP-2"):
        return Pic("", "float", usage=usage, signed=True, length=0)
    text = expanded(picture)
    if not text:
        raise PictureError("empty picture")
    if re.fullmatch(r"[XA9BN0/]*[XAN][XA9BN0/]*", text):
        return Pic(picture, "text", length=len(text), justified=justified)
    m = re.fullmatch(r"(S?)(P*)(9*)(V?)(P*)(9*)(P*)", text)
    if m and (m[3] or m[6]):
        before, ip, v, p_left, dp, p_right = m[2], m[3], m[4], m[5], m[6], m[7]
        scale_p = 0
        int_digits, dec_digits = len(ip), len(dp)
        if before or (v and p_left):  # VPP99 or PP99: all digits behind more zeros
            zeros = len(before) + len(p_left)
            int_digits, dec_digits, scale_p = len(ip) if not before else 0, len(dp) + (len(ip) if before else 0), -zeros
        elif p_left or p_right:  # 99PP
            scale_p = len(p_left) + len(p_right)
        return Pic(picture, "number", int_digits, dec_digits, bool(m[1]), usage, scale_p, 0, sign.upper().startswith("LEADING"), "SEPARATE" in sign.upper(), blank_zero)
    if not re.fullmatch(r"(?:CR|DB|[9ZVP*$+\-,.B0/€£¥])+", text):
        raise PictureError(f"not a picture: {picture}")
    before, _, after = text.replace("V", ".", 1).partition(".")
    floating = max("$+-", key=before.count)
    n_int = sum(before.count(c) for c in "9Z*") + (before.count(floating) - 1 if before.count(floating) > 1 else 0)
    n_dec = sum(after.count(c) for c in "9Z*") + (after.count(floating) if before.count(floating) > 1 and len(after) > 1 else 0)
    signed = any(c in text for c in ("+", "-", "CR", "DB"))
    return Pic(picture, "edited", n_int, n_dec, signed, "DISPLAY", 0, len(text) - text.count("V"), blank_zero=blank_zero)
