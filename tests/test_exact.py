"""Numbers beyond any decimal type: canonical texts, differences, verification."""

import random
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import codecs, exact, store
from tallyframe.functions.pic import parse
from tallyframe.plans import compile as compiler
from tallyframe.plans import diff
from tallyframe.plans.lang import parse_program
from tallyframe.sources import layout as L

getcontext().prec = 200


def plain(d):
    sign, digits = "-" if d < 0 else "", format(abs(d), "f")
    whole, _, fraction = digits.partition(".")
    body = (whole.lstrip("0") or "0") + ("." + fraction.rstrip("0") if fraction.rstrip("0") else "")
    return sign + body if body != "0" else body


def test_against_unlimited_decimals(spark):
    r = random.Random(2)

    def number():
        whole = "".join(r.choice("0123456789") for _ in range(r.choice([0, 1, 2, 16, 17, 18, 31, 38])))
        fraction = "".join(r.choice("0123456789") for _ in range(r.choice([0, 1, 3, 12, 17, 34])))
        text = whole + ("." + fraction if fraction or (whole and r.random() < 0.2) else "")
        return r.choice(["", "-", "+"]) + (text or "0") + r.choice(["", "", f"E{r.randint(-40, 40)}", "e+5"])

    pairs = [(a, r.choice([number(), a + "0" if "." in a and "e" not in a.lower() else a])) for a in (number() for _ in range(600))] + [("9" * 40, "-" + "9" * 40), ("1", "0." + "9" * 30)]
    x, y, d = (F.col(c) for c in "xyd")
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("x", exact.canonical(F.col("a"))).withColumn("y", exact.canonical(F.col("b"))).withColumn("d", exact.difference(x, y))
    for got in df.select("*", exact.negated(x).alias("n"), exact.below(d, "0.015").alias("low"), exact.above(d, 100).alias("high"), exact.cut(x, 9, 4).alias("cut")).collect():
        a, b = Decimal(got.a), Decimal(got.b)
        size = abs(a - b)
        assert (got.x, got.y, got.d, got.n) == (plain(a), plain(b), plain(size), plain(-a))
        assert (got.low, got.high) == (size < Decimal("0.015"), size > 100)
        assert got.cut == (Decimal(int(abs(a) * 10**4) % 10**13) / 10**4).copy_sign(a)
    none = spark.createDataFrame([("x",), ("",), ("1.2.3",), ("-",), (None,)], "a string").select(exact.canonical(F.col("a")).alias("c"))
    assert {r.c for r in none.collect()} == {None}


def test_wide_records(spark):
    wide = "12345678901234567890123456789012"
    p = [(0, "0.000000000001", "1"), (1, wide, "1"), (2, "1" + "0" * 30, "$1,000.00CR"), (3, "9" * 38, "12.5-"), (4, "-0.0", ""), (5, "1e3", "x")]
    e = [(0, "0.000000000002", "1"), (1, wide + ".0", "1.00"), (2, "-1" + "0" * 30, "-1000"), (3, "9" * 37 + "8", "-12.50"), (4, "0", "0"), (5, "1000", "y")]
    frame = lambda rows: spark.createDataFrame(rows, "_rec bigint, A string, E string")
    found = diff.diagnose(diff.compare(frame(p), frame(e), ["A", "E"], ["E"]))
    got = {(x.record, x.field): (x.difference, x.magnitude, x.likely_cause) for x in found.collect()}
    assert got == {
        (0, "A"): ("0.000000000001",) * 2 + ("Rounding divergence below a cent",), (2, "A"): ("2" + "0" * 30,) * 2 + ("Sign reversal",), (3, "A"): ("1", "1", "Whole-number divergence"),
    }


def test_packed_and_layout_scales(spark):
    lay = L.Layout("w", (L.Field("P", 0, 16, "comp3", 12, True), L.Field("D", 16, 20, "decimal", 12), L.Field("I", 36, 31, "integer"), L.Field("S", 67, 9, "comp3", 8, True)), 76)
    digits = "1234567890123456789" + "123456789012"
    raw = bytes.fromhex(digits + "D") + b"     12.000000000001" + b"9" * 31 + bytes.fromhex("12345678901234567C")
    [row] = L.decoded(spark.createDataFrame([(0, raw)], "_rec bigint, raw binary"), lay).collect()
    assert row.P == Decimal("-1234567890123456789.123456789012") and row.D == Decimal("12.000000000001") and row.I == Decimal("9" * 31) and row.S == Decimal("123456789.01234567")
    assert row._abends == [] and [f.dataType.scale for f in lay.schema] == [12, 12, 7, 10]
    text = spark.createDataFrame([("1.25", 2), ("1.2500", 2), ("1.251", 2), (" 7", 0)], "t string, s int")
    two, none = codecs.validated(F.col("t"), parse("9(5)V99"), 2), codecs.validated(F.col("t"), parse("9(5)"), 0)
    assert [r[0] for r in text.select(F.when(F.col("s") == 2, two["abend"]).otherwise(none["abend"])).collect()] == [None, None, "S0C7", None]
    n = spark.createDataFrame([(5,), (-123,), (10**18,)], "n bigint").select(store.decimal_of(F.col("n"), 30, 31).alias("a"), store.decimal_of(F.col("n"), 2, 31).alias("b"))
    assert [(format(r.a, "f"), str(r.b)) for r in n.collect()][1] == ("-0." + "0" * 27 + "123", "-1.23")


def test_inputs_are_cut_and_checked(spark):
    source = "       PROGRAM-ID. X1.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       01 A PIC S9(3)V99.\n       01 T PIC X(3) VALUE 'abc'.\n       PROCEDURE DIVISION.\n       P1.\n           ADD 0 TO A.\n"
    df = spark.createDataFrame([(0, "1.239999999999999", "x"), (1, "-7.995", None), (2, "oops", "y"), (3, "1E1", ""), (4, None, "z"), (5, " ", "w")], "_rec bigint, a string, t string")
    for route in ("native", "columns", "arrow"):
        got = {r._rec: (r.a and Decimal(r.a), r.t, bool(r._error)) for r in compiler.execute(parse_program(source), df, {"a": "A", "t": "T"}, {"a": "A", "t": "T"}, route)[0].collect()}
        assert got == {0: (Decimal("1.23"), "x", False), 1: (Decimal("-7.99"), "abc", False), 2: (None, None, True), 3: (Decimal(10), "", False), 4: (0, "z", False), 5: (0, "w", False)}, route


@pytest.mark.parametrize("text", ["1.5", "$1,234.50CR", "12-", "abc"])
def test_edited_numbers(spark, text):
    [row] = spark.createDataFrame([(text,)], "t string").select(codecs.numeric_of_edited(F.col("t"), 2).alias("n"), exact.canonical(codecs.edited_number(F.col("t"))).alias("c")).collect()
    assert (row.n, row.c) == {"1.5": (Decimal("1.50"), "1.5"), "$1,234.50CR": (Decimal("-1234.50"), "-1234.5"), "12-": (Decimal(-12), "-12"), "abc": (None, None)}[text]


def test_products_sums_and_quotients_of_any_size(spark):
    from decimal import ROUND_DOWN, Context

    r = random.Random(11)

    def number():
        digits, decs = r.choice([1, 3, 7, 8, 18, 31, 37]), r.choice([0, 0, 2, 9])
        x = Decimal(r.randrange(10**digits)).scaleb(-min(decs, digits), Context(prec=99))
        return -x if r.random() < 0.4 and x else x

    rows = [(i, number(), number()) for i in range(300)] + [(300, Decimal(0), Decimal(5)), (301, Decimal(5), Decimal(0)), (302, Decimal("0.001"), Decimal(10**36)), (303, Decimal(10**37 - 1), Decimal(10**37 - 1))]
    df = spark.createDataFrame([(i, format(a, "f"), format(b, "f")) for i, a, b in rows], "id int, a string, b string")
    a, b = (exact.canonical(F.col(c)) for c in "ab")
    got = {x.id: x for x in df.select("id", exact.product(a, b).alias("p"), exact.plus(a, b).alias("s"), exact.minus(a, b).alias("d"), exact.less(a, b).alias("l"), exact.quotient(a, b, 4).alias("q"), exact.quotient(a, b, 0).alias("w")).collect()}
    wide = Context(prec=200)

    def plain(x):
        text = format(x, "f")
        text = text.rstrip("0").rstrip(".") if "." in text else text
        return "0" if text in ("-0", "") else text

    def cut(x, y, scale):
        return plain(wide.divide(x, y).quantize(Decimal(1).scaleb(-scale), ROUND_DOWN, wide)) if y else None

    for i, x, y in rows:
        g = got[i]
        assert (g.p, g.s, g.d, g.l) == (plain(wide.multiply(x, y)), plain(wide.add(x, y)), plain(wide.subtract(x, y)), x < y), (x, y)
        assert (g.q, g.w) == (cut(x, y, 4), cut(x, y, 0)), (x, y)


def test_narrowed(spark):
    df = spark.createDataFrame([("12345.678",), ("-99.999",), ("7",), ("-0.004",)], "n string")
    got = [str(r[0]) for r in df.select(exact.narrowed(F.col("n"), 2, 2)).collect()]
    assert got == ["145.67", "-99.99", "7.00", "0.00"]


def test_wide_results_are_the_same_on_every_route(spark):
    """Products, sums, quotients, rounding and size errors beyond 38 digits: columns against the record interpreter."""
    r = random.Random(5)
    program = parse_program(
        "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. WIDE.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       01 A PIC S9(20)V9(5).\n       01 B PIC S9(18)V9(3).\n       01 P PIC S9(9)V99.\n       01 Q PIC S9(9)V9(3).\n"
        "       01 R PIC 9(31).\n       01 F PIC X VALUE 'N'.\n       PROCEDURE DIVISION.\n       MAIN-P.\n           COMPUTE P ROUNDED = A * B - B.\n           COMPUTE R = A * A ON SIZE ERROR MOVE 'Y' TO F END-COMPUTE.\n"
        "           DIVIDE A BY B GIVING Q.\n           STOP RUN.\n"
    )
    number = lambda digits, decs: Decimal(r.choice([0, 1, 5, r.randrange(10**digits), r.randrange(10 ** (digits // 2))])).scaleb(-decs) * r.choice([1, -1])
    rows = [(i, number(25, 5), number(21, 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "_rec bigint, a decimal(25,5), b decimal(21,3)")
    ins, outs = {"a": "A", "b": "B"}, {"p": "P", "q": "Q", "r": "R", "f": "F"}
    known = []
    for route in ("native", "arrow"):
        out, *_ = compiler.execute(program, df, ins, outs, route)
        known.append(sorted((x["_rec"], *(Decimal(x[c]) for c in "pqr"), x["f"]) for x in out.collect()))
    assert known[0] == known[1]


def test_numbers_of_known_size(spark):
    """Signed limbs in columns against unlimited integers: mixed signs, carries, shifts by decimals, small numbers with exponents, long and short divisions."""
    from decimal import ROUND_DOWN, Context

    r = random.Random(7)
    wide = Context(prec=300)

    def number(digits, decs):
        n = r.choice([0, 1, 10**digits - 1, 10 ** (digits - 1), r.randrange(10**digits), r.randrange(10 ** (digits // 2)), 10 ** (digits // 2) - 1])
        return Decimal(n * r.choice([1, -1])).scaleb(-decs, wide)

    shapes = {"a": (31, 0), "b": (12, 2), "c": (31, 15), "d": (38, 19), "e": (20, 20)}
    rows = [(i, *(number(*x) for x in shapes.values())) for i in range(150)]
    texts = spark.createDataFrame([(i, *(format(v, "f") for v in x)) for i, *x in rows], "id int, a string, b string, c string, d string, e string")
    df = texts.select("id", *(F.col(c).cast(f"decimal({n},{s})").alias(c) for c, (n, s) in shapes.items()))

    def keep(*values):
        nonlocal df
        names = [f"w{len(df.columns) + i}" for i in range(len(values))]
        df = df.select("*", *(v.alias(n) for v, n in zip(values, names, strict=True)))
        return [F.col(n) for n in names]

    a, b, c, d, e = (exact.fixed(F.col(x), *shape, keep) for x, shape in shapes.items())
    cube = exact.wide_product(exact.wide_product(c, d, keep), a, keep)
    mixed = exact.wide_sum(exact.wide_product(c, b, keep), exact.wide_negated(exact.wide_product(d, e, keep)), keep)
    forms = {"cube": exact.wide_digits(cube, keep), "mixed": exact.wide_digits(mixed, keep), "same": exact.wide_digits(exact.wide_sum(c, exact.wide_negated(c), keep), keep)}
    forms |= {"short": exact.wide_quotient(a, b, 12, 4, keep), "long": exact.wide_quotient(mixed, e, 20, 9, keep), "none": exact.wide_quotient(e, c, 31, 0, keep), "tiny": exact.wide_quotient(e, b, 12, 0, keep)}
    assert exact.wide_quotient(cube, d, 37, 0, keep) is None
    low = exact.digits_narrowed(forms["cube"], 9, 2)
    got = {x.id: x for x in df.select("id", low.alias("low"), *(x.number.alias(n) for n, x in forms.items())).collect()}
    cut = lambda x, y, scale: plain(wide.divide(x, y).quantize(Decimal(1).scaleb(-scale), ROUND_DOWN, wide)) if y else None
    for i, a, b, c, d, e in rows:
        g, cube, mixed = got[i], wide.multiply(wide.multiply(c, d), a), wide.subtract(wide.multiply(c, b), wide.multiply(d, e))
        assert (g.cube, g.mixed, g.same) == (plain(cube), plain(mixed), "0")
        assert (g.short, g.long, g.none, g.tiny) == (cut(a, b, 4), cut(mixed, e, 9), cut(e, c, 0), cut(e, b, 0)), (a, b, c, e)
        size = int(abs(cube).scaleb(2, wide))
        assert abs(g.low) * 100 == size % 10**11 + (10**11 if size >= 10**11 else 0)


def test_wide_programs_are_plain_arithmetic(spark):
    """No function that Spark interprets for each row (no lambdas, no regular expressions) is left in a program of 31-digit fields."""
    from tallyframe.plans.catalog_wide import WIDE

    df = spark.createDataFrame([(0, Decimal(7), Decimal(3), Decimal("1.5"))], "_rec bigint, a decimal(31,0), b decimal(12,0), c decimal(31,15)")
    out, route = compiler.execute(parse_program(WIDE), df, {"a": "A", "b": "B", "c": "C"}, {"low": "LOW", "q": "Q", "f": "F"}, "native")
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert route == "native" and "lambda" not in plan and "regexp" not in plan
    [row] = out.collect()
    assert (Decimal(row.low), Decimal(row.q), row.f) == (21, Decimal("2.3333"), "N")
