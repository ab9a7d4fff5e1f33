"""Single operators: pictures, codecs, editing, strings, collation."""

from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.conf import CobolConf, detect
from tallyframe.functions import codecs, ebcdic, edited, predicates, store, strings
from tallyframe.functions.pic import PictureError, parse
from tallyframe.plans import interp


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("picture", "want"), [("S9(5)V99", (5, 2, True)), ("9(3)", (3, 0, False)), ("V9(4)", (0, 4, False)), ("S999V9(2)", (3, 2, True)), ("9", (1, 0, False))])
def test_numbers(picture, want):
    p = parse(picture)
    assert (p.int_digits, p.dec_digits, p.signed) == want


@pytest.mark.parametrize(("picture", "usage", "sign", "n"), [("S9(5)V99", "COMP-3", "", 4), ("9(4)", "COMP", "", 2), ("S9(9)", "COMP", "", 4), ("S9(10)", "BINARY", "", 8), ("S9(3)", "DISPLAY", "", 3), ("S9(3)", "DISPLAY", "TRAILING SEPARATE", 4), ("X(7)", "DISPLAY", "", 7), ("", "COMP-2", "", 8), ("ZZ9.99", "DISPLAY", "", 6)])
def test_bytes(picture, usage, sign, n):
    assert parse(picture, usage, sign).storage_bytes == n


@pytest.mark.parametrize("bad", ["", "Q9", "9(", "S"])
def test_bad_pictures(bad):
    with pytest.raises((PictureError, ValueError)):
        parse(bad)


@pytest.mark.parametrize(("raw", "scale", "want"), [("12345C", 0, 12345), ("12345D", 2, Decimal("-123.45")), ("00012F", 0, 12), ("1A", 0, 1), ("1B", 0, -1), ("1E", 0, 1), ("1F1C", 0, None), ("0C", 2, 0)])
def test_packed(spark, raw, scale, want):
    [got] = one(spark, codecs.comp3_decode(F.unhex(F.lit(raw)), scale))
    assert got == want


@pytest.mark.parametrize(("text", "scale", "want"), [("12C", 0, 123), ("12L", 0, -123), ("12C", 2, Decimal("1.23")), ("00{", 0, 0), ("1X2", 0, None)])
def test_zoned(spark, text, scale, want):
    assert one(spark, codecs.zoned_decode(F.lit(text), scale))[0] == want


@pytest.mark.parametrize(("text", "value", "abend"), [("", 0, None), ("   ", 0, None), ("12.5", Decimal("12.5"), None), ("012345", 12345, None), ("1 2", None, "S0C7"), ("ABC", None, "S0C7"), ("ÿÿÿÿ", Decimal("99.99"), None), ("ÿ12", None, "S0C7"), ("12L", Decimal("-1.23"), None), ("1e3", None, "S0C7")])
def test_validated(spark, text, value, abend):
    v = codecs.validated(F.lit(text), parse("S99V99"))
    assert one(spark, v["value"], v["abend"]) == (value, abend)


@pytest.mark.parametrize(("picture", "value", "want"), [
    ("ZZ9.99", "5", "  5.00"), ("ZZZ.ZZ", "0", "      "), ("$$,$$9.99", "1234.5", "$1,234.50"), ("$$,$$9.99", "12", "   $12.00"), ("***9.99", "7", "***7.00"), ("-(4)9", "-42", "  -42"), ("+++9", "5", "  +5"), ("9(3)-", "-7", "007-"), ("ZZ9CR", "-7", "  7CR"),
    ("ZZ9DB", "7", "  7  "), ("99/99/99", "123456", "12/34/56"), ("9B9", "12", "1 2"), ("Z,ZZ9", "999", "  999"), ("$9,999", "1234", "$1,234"),
])
def test_edited_both_ways(spark, picture, value, want):
    p = parse(picture)
    assert interp.edited_text(Decimal(value), p) == want
    assert one(spark, edited.edited(F.lit(Decimal(value)).cast("decimal(15,4)"), p))[0] == want


@given(st.decimals(-10**6, 10**6, places=4), st.sampled_from(["S9(4)V99", "9(3)V9", "S9(2)", "S9(6)V9(4)"]))
def test_interpreted_store_keeps_its_digits(value, picture):
    p, conf = parse(picture), CobolConf()
    out = interp.store(value, p, conf)
    assert abs(out) <= p.largest() and (p.signed or out >= 0)
    if interp.fits(value, p, conf):
        assert abs(abs(value) - abs(out)) < Decimal(1).scaleb(-p.dec_digits)


def test_store_is_the_same_in_columns(spark):
    rows = [(Decimal(f"{i * 7919 % 20000003 - 10**7}.{i * 31 % 10000:04d}"),) for i in range(500)]
    df = spark.createDataFrame(rows, "x decimal(18,4)")
    for picture, usage in (("S9(4)V99", "DISPLAY"), ("9(3)V9", "COMP-3"), ("S9(4)", "COMP"), ("S9(4)", "COMP-5")):
        for conf in (CobolConf(), CobolConf(trunc="BIN")):
            p = parse(picture, usage)
            got = [tuple(r) for r in df.select("x", store.store(F.col("x"), p, conf), store.size_error(F.col("x"), p, conf)).collect()]
            assert all(y == interp.store(x, p, conf) and bad == (not interp.fits(x, p, conf)) for x, y, bad in got)


def test_exact_quotients(spark):
    rows = [(Decimal(a), Decimal(b)) for a in (-1000, -7, 0, 7, 12345678901) for b in (-9, 3, 7, 365)] + [(Decimal(5), Decimal(0))]
    got = spark.createDataFrame(rows, "a decimal(12,0), b decimal(4,0)").select("a", "b", store.divided(F.col("a"), 0, F.col("b"), 0, 4)).collect()
    for a, b, q in got:
        assert q == (None if b == 0 else interp.store(a / b if (a * 10**4) % b == 0 else Decimal(int(a * 10**4 / b)) / 10**4, parse("S9(20)V9(4)"), CobolConf()))


def test_ebcdic(spark):
    assert [ebcdic.page("cp1047")[b] for b in (0xAD, 0xBD, 0x5F)] == ["[", "]", "^"]
    words = ["apple", "Apple", "1st", " x", "zebra", "Z", "", "a1"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.w for r in df.orderBy(ebcdic.sort_key(F.col("w"))).collect()]
    assert got == sorted(words, key=lambda s: s.encode("cp037"))
    assert one(spark, ebcdic.compared(F.lit("a"), F.lit("A")), ebcdic.compared(F.lit("AB"), F.lit("AB  ")), ebcdic.compared(F.lit("1"), F.lit("Z"))) == (-1, 0, 1)
    assert one(spark, F.hex(ebcdic.encode(F.lit("A1 ☃"))), ebcdic.decode(F.unhex(F.lit("C1F10040")))) == ("C1F1406F", "A1␀ ")


def test_strings(spark):
    text, at, over = strings.string([(F.lit("AB CD"), "SPACE"), (F.lit("XYZ"), None)], F.lit("------"), 6, 4)
    assert one(spark, text, at, over) == ("---ABX", 7, True)
    f = strings.unstring(F.lit("A--B,C"), [("-", True), (",", False)], 4)
    assert one(spark, *(x["text"] for x in f), f[0]["delimiter"], f[1]["delimiter"]) == ("A", "B", "C", None, "-", ",")
    assert one(spark, strings.tally(F.lit("aabaa"), "LEADING", "a"), strings.tally(F.lit("a.b.c"), "ALL", ".", after=".")) == (2, 1)
    assert one(spark, strings.replacing(F.lit("aabaa"), "LEADING", "a", "x"), strings.replacing(F.lit("a.b"), "CHARACTERS", "", "*", before=".")) == ("xxbaa", "*.b")
    assert one(spark, strings.accept("DAY-OF-WEEK", CobolConf(run_date="20240229")), strings.accept("DAY YYYYDDD", CobolConf(run_date="20240229"))) == ("4", "2024060")
    assert one(spark, strings.mod(F.lit(Decimal(-7)), F.lit(Decimal(3))), strings.integer(F.lit(Decimal("-7.9"))), strings.ord_(F.lit("A"))) == (-1, -7, 65)


def test_conditions(spark):
    assert one(spark, predicates.named(F.lit("C"), ["A", ("B", "D")], True), predicates.relation(F.lit("a "), "=", F.lit("a"), True), predicates.is_class(F.lit(" 1.5"), "NUMERIC"), predicates.is_class(F.lit("Ab "), "ALPHABETIC-UPPER")) == (True, True, True, False)


def test_options():
    c = detect("       CBL TRUNC(BIN),ARITH(EXTEND),NUMPROC(PFD)\n       DECIMAL-POINT IS COMMA.\n")
    assert (c.trunc, c.arith, c.numproc, c.decimal_point, c.precision) == ("BIN", "EXTEND", "PFD", ",", 31)
