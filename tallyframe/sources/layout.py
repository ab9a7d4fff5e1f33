"""Record layouts: fields of fixed places, from JSON, from a copybook, or in code."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import codecs, ebcdic
from tallyframe.functions.pic import Pic

TYPES = ("string", "integer", "decimal", "comp3", "comp", "binary", "comp1", "comp2")


class LayoutError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    start: int
    length: int
    type: str = "string"
    decimals: int = 0
    signed: bool = False
    signed_display: bool = False
    implied: bool = False  # plain digits are scaled by ``decimals`` too
    edited: bool = False

    @property
    def scale(self) -> int:
        """Decimals of the column: the declared ones, or up to 10 while 38 digits hold the field."""
        return min(37, max(self.decimals, min(10, 38 - (2 * self.length - 1 if self.type == "comp3" else self.length)), 0))

    @property
    def pic(self) -> Pic:
        digits = 2 * self.length - 1 if self.type == "comp3" else self.length
        return Pic("", "number", max(0, min(31, digits) - self.decimals), self.decimals, self.signed or self.signed_display)


@dataclass(frozen=True)
class Layout:
    name: str
    fields: tuple[Field, ...]
    record_length: int = 0
    codepage: str | None = None  # None: ASCII text
    constants: dict = field(default_factory=dict, hash=False)
    input_mapping: dict = field(default_factory=dict, hash=False)
    output_fields: tuple[str, ...] = ()
    numproc: str = "NOPFD"  # PFD: packed signs other than C, D and F are an abend

    @classmethod
    def of_json(cls, text: str | dict) -> Layout:
        d = json.loads(text) if isinstance(text, str) else text
        fields = tuple(
            Field(f["name"], int(f["start"]), int(f["length"]), str(f.get("type", "string")).lower(), int(f.get("decimals") or 0), bool(f.get("signed")), bool(f.get("signed_display")), bool(f.get("implied")), bool(f.get("is_edited")))
            for f in d["fields"]
        )
        for f in fields:
            if f.type not in TYPES:
                raise LayoutError(f"field {f.name}: unknown type {f.type}")
        return cls(d.get("name", "layout"), fields, int(d.get("record_length") or 0), d.get("codepage"), d.get("constants") or {}, d.get("input_mapping") or {}, tuple(d.get("output_fields") or ()), str(d.get("numproc") or "NOPFD").upper())

    @property
    def schema(self) -> T.StructType:
        def kind(f: Field) -> T.DataType:
            if f.type == "string" or f.edited:
                return T.StringType()
            return T.DoubleType() if f.type in ("comp1", "comp2") else T.DecimalType(38, f.scale)

        return T.StructType([T.StructField(f.name, kind(f), True, {"start": f.start, "length": f.length, "type": f.type, "decimals": f.decimals}) for f in self.fields])


def _value(f: Field, raw: Column, codepage: str | None, numproc: str = "NOPFD") -> tuple[Column, Column | None]:
    """A field's value and its abend, from its bytes."""
    text = ebcdic.decode(raw, codepage) if codepage and codepage != "ascii" else F.decode(raw, "ISO-8859-1")
    if f.type == "string" or f.edited:
        return F.rtrim(text), None
    wide = f"decimal(38,{f.scale})"
    if f.type == "comp3":
        value = codecs.comp3_decode(raw, f.decimals, numproc).cast(wide)
        return value, F.when(value.isNull() & (F.octet_length(raw) == f.length), codecs.ABEND)
    if f.type in ("comp", "binary"):
        return codecs.binary_decode(raw, f.length, f.decimals).cast(wide), None
    if f.type in ("comp1", "comp2"):
        return codecs.float_decode(raw), None
    if f.implied:
        plain = F.trim(text)
        text = F.when(plain.rlike(r"^\d+$"), F.concat(F.left(plain, F.length(plain) - 1), F.translate(F.right(plain, F.lit(1)), "0123456789", codecs.POSITIVE))).otherwise(text)
    found = codecs.validated(text, f.pic, f.scale)
    return found["value"], found["abend"]


def decoded(records: DataFrame, layout: Layout, raw: str = "raw", number: str = "_rec", keep: Sequence[str] = ()) -> DataFrame:
    """Rows of ``number`` and ``raw`` (bytes) as the layout's fields, after the columns to ``keep``, with ``_abends`` (structs of field, message, invalid value) and
    ``_warnings`` for records that end inside a field."""
    columns, abends, warnings = [], [], []
    for f in layout.fields:
        part = F.substring(F.col(raw), f.start + 1, f.length)
        value, abend = _value(f, part, layout.codepage, layout.numproc)
        columns.append(value.alias(f.name))
        if abend is not None:
            abends.append(F.when(abend.isNotNull(), F.struct(F.lit(f.name).alias("field"), abend.alias("message"), F.decode(part, "ISO-8859-1").alias("invalid_value"))))
        warnings.append(F.when(F.octet_length(raw) < f.start + f.length, F.lit(f"{f.name}: record is truncated")))
    none = F.array().cast("array<struct<field:string,message:string,invalid_value:string>>")
    return records.select(*keep, number, *columns, (F.array_compact(F.array(*abends)) if abends else none).alias("_abends"), F.array_compact(F.array(*warnings)).alias("_warnings"))


def encoded(df: DataFrame, layout: Layout, number: str = "_rec") -> DataFrame:
    """The inverse: ``number`` and ``raw``, records of ``record_length`` bytes."""
    parts, at = [], 0
    text_of = lambda s, n: ebcdic.encode(s, layout.codepage) if layout.codepage and layout.codepage != "ascii" else F.encode(s, "ISO-8859-1")
    for f in sorted(layout.fields, key=lambda f: f.start):
        if f.start > at:
            parts.append(text_of(F.lit(" " * (f.start - at)), f.start - at))
        c = F.col(f.name)
        if f.type == "comp3":
            parts.append(codecs.comp3_encode(c, Pic("", "number", 2 * f.length - 1 - f.decimals, f.decimals, True, "COMP-3")))
        elif f.type in ("comp", "binary"):
            n = {2: 4, 4: 9, 8: 18}[f.length]
            parts.append(codecs.binary_encode(c, Pic("", "number", n - f.decimals, f.decimals, True, "COMP")))
        elif f.type in ("comp1", "comp2"):
            parts.append(codecs.single_encode(c) if f.type == "comp1" else codecs.float_encode(c))
        elif f.type == "string" or f.edited:
            parts.append(text_of(F.rpad(F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, f.length), f.length, " "), f.length))
        elif f.signed_display:
            parts.append(text_of(codecs.zoned_encode(c, f.pic), f.length))
        else:
            plain = F.regexp_replace(c.cast(f"decimal(38,{f.decimals})").cast("string"), "^(-?)0+(?=[0-9])", "$1")
            parts.append(text_of(F.lpad(plain, f.length, " "), f.length))
        at = f.start + f.length
    if layout.record_length > at:
        parts.append(text_of(F.lit(" " * (layout.record_length - at)), layout.record_length - at))
    return df.select(number, F.concat(*parts).alias("raw"))


def detect_codepage(sample: bytes, fields: tuple[Field, ...], default: str | None = None) -> str | None:
    """cp037 if over 30 % of the string fields' bytes are above x'7F', else the default."""
    own = b"".join(sample[f.start : f.start + f.length] for f in fields if f.type == "string")
    return "cp037" if own and sum(b > 0x7F for b in own) > 0.3 * len(own) else default


@dataclass
class Item:
    """A data description entry."""

    level: int
    name: str
    pic: Pic | None = None
    occurs: int = 1
    depending: str | None = None
    redefines: str | None = None
    values: list = field(default_factory=list)
    children: list = field(default_factory=list)
    conditions: dict = field(default_factory=dict)
    renames: tuple | None = None
    offset: int = 0
    length: int = 0
    indexed: tuple[str, ...] = ()
    parent: object = None

    def leaves(self):
        if not self.children:
            yield self
        for c in self.children:
            yield from c.leaves()


def place(items: list[Item], at: int = 0) -> int:
    """Offsets and lengths, from the leaves only; a redefining item shares its subject's offset. Returns the end."""
    by_name: dict[str, Item] = {}
    for item in items:
        start = at
        if item.redefines:
            if item.redefines not in by_name:
                raise LayoutError(f"{item.name} redefines unknown {item.redefines}")
            start = by_name[item.redefines].offset
        item.offset = start
        each = place(item.children, start) - start if item.children else item.pic.storage_bytes if item.pic else 0
        item.length = each * item.occurs
        by_name[item.name] = item
        at = max(at, start + item.length)
    return at


def overlays(items: list[Item]) -> list[tuple[str, str, int, int, str]]:
    """``(name, redefined, offset, length, note)`` of every redefining item; FILLERs are numbered."""
    out, n = [], 0
    for item in items:
        for x in _walk(item):
            if x.redefines:
                n += x.name == "FILLER"
                base = next((y for y in _walk_all(items) if y.name == x.redefines), None)
                note = "" if base is None or base.length == x.length else f"{x.length} bytes over {base.length}"
                out.append((x.name if x.name != "FILLER" else f"FILLER-{n}", x.redefines, x.offset, x.length, note))
    return out


def _walk(item: Item):
    yield item
    for c in item.children:
        yield from _walk(c)


def _walk_all(items: list[Item]):
    for i in items:
        yield from _walk(i)


def view(raw: Column, item: Item, codepage: str | None = None) -> Column:
    """One field of a binary region, through its codec: overlapping fields are slices of one column."""
    part = F.substring(raw, item.offset + 1, item.length)
    text = ebcdic.decode(part, codepage) if codepage else F.decode(part, "ISO-8859-1")
    if not item.pic or not item.pic.is_number:
        return F.rtrim(text)
    if item.pic.usage == "COMP-3":
        return codecs.comp3_decode(part, item.pic.dec_digits)
    if item.pic.usage in ("COMP", "COMP-5"):
        return codecs.binary_decode(part, item.length, item.pic.dec_digits)
    return codecs.zoned_decode(text, item.pic.dec_digits)


def put(raw: Column, item: Item, value: Column, codepage: str | None = None) -> Column:
    """The region with one field stored."""
    if item.pic and item.pic.is_number:
        if item.pic.usage == "COMP-3":
            new = codecs.comp3_encode(value, item.pic)
        elif item.pic.usage in ("COMP", "COMP-5"):
            new = codecs.binary_encode(value, item.pic)
        else:
            text = codecs.zoned_encode(value, item.pic)
            new = ebcdic.encode(text, codepage) if codepage else F.encode(text, "ISO-8859-1")
    else:
        text = F.rpad(F.substring(value, 1, item.length), item.length, " ")
        new = ebcdic.encode(text, codepage) if codepage else F.encode(text, "ISO-8859-1")
    return F.concat(F.substring(raw, 1, item.offset), new, F.substring(raw, F.lit(item.offset + item.length + 1), F.octet_length(raw)))


def of_items(items: list[Item], name: str = "record", text: bool = False) -> Layout:
    """A layout of the leaves; ``text``: each numeric in the characters of its display form. Overlays are left out."""
    out, at = [], 0
    for top in items:
        for x in top.leaves():
            owner = x
            while owner is not None and not owner.redefines:
                owner = owner.parent
            if owner is not None or x.pic is None or x.name == "FILLER":
                at += 0 if owner is not None or x.pic is None else x.pic.display_bytes
                continue
            p = x.pic
            kind = "string" if not p.is_number else {"COMP-3": "comp3", "COMP": "comp", "COMP-5": "comp"}.get(p.usage, "decimal" if p.dec_digits else "integer")
            if p.kind == "float":
                kind = "comp1" if p.usage == "COMP-1" else "comp2"
            if text:
                kind = kind if kind == "string" else "decimal" if p.dec_digits else "integer"
                out.append(Field(x.name, at, p.display_bytes, kind, p.dec_digits, p.signed))
                at += p.display_bytes
            else:
                out.append(Field(x.name, x.offset, x.length, kind, p.dec_digits, p.signed, p.signed and p.usage == "DISPLAY", implied=p.usage == "DISPLAY" and p.is_number, edited=p.kind == "edited"))
    length = at if text else max((f.start + f.length for f in out), default=0)
    return Layout(name, tuple(out), length)


def parse_copybook(text: str) -> list[Item]:
    """Items of a copybook, placed."""
    from tallyframe.plans.lang import parse_data

    items = parse_data(text)
    place(items)
    return items


def sanitized(name: str) -> str:
    return re.sub(r"[^A-Z0-9-]", "", name.upper())
