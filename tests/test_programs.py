"""Row programs: expectations by case, through the interpreter and, where it compiles, through columns."""

import random
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.conf import CobolConf
from tallyframe.plans import columns, interp, lang, scratch
from tallyframe.plans import compile as compiler
from tallyframe.plans.lang import SourceError, parse_program


def program(data, code, more=""):
    indent = "\n".join("       " + x for x in data.strip().splitlines())
    body = "\n".join("           " + x for x in code.strip().splitlines())
    return f"       IDENTIFICATION DIVISION.\n       PROGRAM-ID. CASE1.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n{indent}\n       PROCEDURE DIVISION.\n       MAIN-PART.\n{body}\n           STOP RUN.\n" + "\n".join("       " + x for x in more.strip().splitlines())


# data, code, inputs, expected outputs, [more paragraphs], [conf]
CASES = {
    "negative quotient truncates": ("01 A PIC S9(3).\n01 B PIC 9(3).\n01 R PIC S9(3)V99.", "DIVIDE A BY B GIVING R.", {"A": "-10", "B": "3"}, {"R": "-3.33"}),
    "half rounds away": ("01 R PIC S9(3)V9.", "COMPUTE R ROUNDED = -1.25.", {}, {"R": "-1.3"}),
    "add overflow keeps": ("01 ACC PIC 9(2).\n01 INC PIC 9(2).\n01 F PIC X VALUE 'N'.", "ADD INC TO ACC\n ON SIZE ERROR MOVE 'Y' TO F\n END-ADD.", {"ACC": "95", "INC": "10"}, {"ACC": "95", "F": "Y"}),
    "overflow without clause truncates": ("01 ACC PIC 9(2).", "ADD 10 TO ACC.", {"ACC": "95"}, {"ACC": "5"}),
    "negative into unsigned": ("01 S PIC S9(3)V99.\n01 U PIC 9(3)V99.", "MOVE S TO U.", {"S": "-123.45"}, {"U": "123.45"}),
    "divide by zero keeps": ("01 A PIC 9(3) VALUE 7.\n01 Z PIC 9 VALUE 0.", "DIVIDE Z INTO A.", {}, {"A": "7"}),
    "divide by zero handler": ("01 A PIC 9(3) VALUE 7.\n01 Z PIC 9 VALUE 0.\n01 F PIC X.", "COMPUTE A = A / Z ON SIZE ERROR MOVE 'E' TO F\n NOT ON SIZE ERROR MOVE 'K' TO F END-COMPUTE.", {}, {"A": "7", "F": "E"}),
    "remainder": ("01 A PIC 9(3) VALUE 17.\n01 Q PIC 9(3).\n01 M PIC 9(3).", "DIVIDE 5 INTO A GIVING Q REMAINDER M.", {}, {"Q": "3", "M": "2"}),
    "multiply giving two": ("01 A PIC 9(3)V9 VALUE 2.5.\n01 X PIC 9(3).\n01 Y PIC 9(3)V99.", "MULTIPLY A BY 3 GIVING X ROUNDED Y.", {}, {"X": "8", "Y": "7.50"}),
    "subtract many": ("01 A PIC S9(3) VALUE 10.\n01 B PIC S9(3).", "SUBTRACT 3 4 FROM A GIVING B.", {}, {"B": "3", "A": "10"}),
    "ebcdic order": ("01 A PIC X.\n01 B PIC X.\n01 R PIC X(7).", "IF A < B MOVE 'LESS' TO R ELSE MOVE 'GREATER' TO R END-IF.", {"A": "a", "B": "A"}, {"R": "LESS"}),
    "letters before digits": ("01 A PIC X.\n01 B PIC X.\n01 R PIC X(7).", "IF A < B MOVE 'LESS' TO R ELSE MOVE 'GREATER' TO R END-IF.", {"A": "Z", "B": "1"}, {"R": "LESS"}),
    "unstring": ("01 I PIC X(20).\n01 F PIC X(10).\n01 G PIC X(10).", "UNSTRING I DELIMITED BY ',' INTO F G END-UNSTRING.", {"I": "HELLO,WORLD"}, {"F": "HELLO", "G": "WORLD"}),
    "unstring counts": ("01 I PIC X(12) VALUE 'A--BCD'.\n01 F PIC X(4).\n01 G PIC X(6).\n01 D PIC X.\n01 N PIC 99.\n01 T PIC 99 VALUE 0.", "UNSTRING I DELIMITED BY ALL '-' INTO F\n DELIMITER IN D COUNT IN N G TALLYING IN T.", {}, {"F": "A", "G": "BCD", "D": "-", "N": "1", "T": "2"}),
    "string": ("01 A PIC X(5) VALUE 'AB CD'.\n01 T PIC X(10) VALUE ALL '-'.", "STRING A DELIMITED BY SPACE 'XY' DELIMITED BY SIZE INTO T.", {}, {"T": "ABXY------"}),
    "string pointer": ("01 T PIC X(6) VALUE SPACES.\n01 P PIC 99 VALUE 3.\n01 O PIC X VALUE 'N'.", "STRING 'ABCDE' DELIMITED BY SIZE INTO T POINTER P\n ON OVERFLOW MOVE 'Y' TO O END-STRING.", {}, {"T": "  ABCD", "P": "7", "O": "Y"}),
    "inspect": ("01 A PIC X(8) VALUE 'ABABCA'.\n01 N PIC 99.\n01 L PIC 99.", "INSPECT A TALLYING N FOR ALL 'AB'.\nINSPECT A TALLYING L FOR LEADING 'A'.\nINSPECT A REPLACING FIRST 'B' BY 'X' AFTER 'C'\n ALL 'A' BY 'Z'.", {}, {"N": "2", "L": "1", "A": "ZBZBCZ"}),
    "inspect converting": ("01 A PIC X(6) VALUE 'ABCABC'.", "INSPECT A CONVERTING 'AB' TO 'xy' BEFORE 'C'.", {}, {"A": "xyCABC"}),
    "88 levels": ("01 S PIC 9(2).\n   88 OK VALUE 0.\n   88 MID VALUE 3 THRU 9.\n   88 EOF VALUE 10.\n01 R PIC X(5).", "EVALUATE TRUE\n WHEN OK MOVE 'GO' TO R\n WHEN MID MOVE 'MID' TO R\n WHEN EOF MOVE 'STOP' TO R\n WHEN OTHER MOVE 'ERR' TO R\nEND-EVALUATE.", {"S": "10"}, {"R": "STOP"}),
    "evaluate also": ("01 A PIC 9.\n01 B PIC X.\n01 R PIC X(3).", "EVALUATE A ALSO B\n WHEN 1 ALSO ANY MOVE 'ONE' TO R\n WHEN 2 THRU 4 ALSO 'Y' MOVE 'MID' TO R\n WHEN OTHER MOVE 'OTH' TO R\nEND-EVALUATE.", {"A": "3", "B": "Y"}, {"R": "MID"}),
    "evaluate not": ("01 X PIC 9(3).\n01 R PIC X(4).", "EVALUATE TRUE WHEN NOT X = 1 MOVE 'NOT1' TO R\n WHEN OTHER MOVE 'IS1' TO R END-EVALUATE.", {"X": "5"}, {"R": "NOT1"}),
    "abbreviated": ("01 A PIC 9.\n01 R PIC X VALUE 'N'.", "IF A = 1 OR 3 OR > 7 MOVE 'Y' TO R END-IF.", {"A": "8"}, {"R": "Y"}),
    "class": ("01 A PIC X(4).\n01 R PIC X VALUE 'N'.", "IF A IS NUMERIC MOVE 'Y' TO R END-IF.", {"A": "12"}, {"R": "Y"}),
    "set true": ("01 A PIC X VALUE 'Q'.\n   88 YES VALUE 'Y'.\n01 R PIC 9.", "SET YES TO TRUE. IF YES MOVE 1 TO R.", {}, {"A": "Y", "R": "1"}),
    "perform times": ("01 A PIC 9(3) VALUE 0.", "PERFORM ADD-ONE 5 TIMES.", {}, {"A": "5"}, "ADD-ONE.\n    ADD 1 TO A."),
    "perform varying": ("01 I PIC 99.\n01 A PIC 9(4) VALUE 0.", "PERFORM VARYING I FROM 1 BY 1 UNTIL I > 10\n ADD I TO A\nEND-PERFORM.", {}, {"A": "55", "I": "11"}),
    "perform after": ("01 I PIC 9.\n01 J PIC 9.\n01 A PIC 9(3) VALUE 0.", "PERFORM P2 VARYING I FROM 1 BY 1 UNTIL I > 3\n AFTER J FROM 1 BY 1 UNTIL J > 2.", {}, {"A": "6"}, "P2.\n    ADD 1 TO A."),
    "test after": ("01 A PIC 9 VALUE 5.", "PERFORM WITH TEST AFTER UNTIL A > 4 ADD 1 TO A END-PERFORM.", {}, {"A": "6"}),
    "thru and go to": ("01 A PIC 99 VALUE 0.", "PERFORM P1 THRU P3.", {}, {"A": "11"}, "P1.\n    ADD 1 TO A.\n    GO TO P3.\nP2.\n    ADD 50 TO A.\nP3.\n    ADD 10 TO A."),
    "go to depending": ("01 K PIC 9.\n01 R PIC X.", "GO TO PA PB DEPENDING ON K.", {"K": "2"}, {"R": "B"}, "PA.\n    MOVE 'A' TO R.\n    STOP RUN.\nPB.\n    MOVE 'B' TO R."),
    "next sentence": ("01 A PIC 9 VALUE 1.", "IF A = 1 NEXT SENTENCE ELSE MOVE 5 TO A.\nADD 1 TO A.", {}, {"A": "2"}),
    "table and search": ("01 T.\n   05 E PIC 99 OCCURS 4 TIMES INDEXED BY IX.\n01 R PIC 99.", "MOVE 11 TO E(1). MOVE 22 TO E(2). MOVE 33 TO E(3).\nSET IX TO 1.\nSEARCH E AT END MOVE 99 TO R\n WHEN E(IX) = 33 SET R TO IX END-SEARCH.", {}, {"R": "3"}),
    "sort table": ("01 T.\n   05 E PIC 9 OCCURS 3 TIMES.", "MOVE 3 TO E(1). MOVE 1 TO E(2). MOVE 2 TO E(3).\nSORT E DESCENDING KEY E.", {}, {"E(1)": "3", "E(2)": "2", "E(3)": "1"}),
    "redefines": ("01 G.\n   05 D PIC 9(4).\n   05 X REDEFINES D.\n      10 HI PIC 99.\n      10 LO PIC 99.", "MOVE 1234 TO D. MOVE 77 TO LO.", {}, {"D": "1277", "HI": "12"}),
    "group move": ("01 A.\n   05 A1 PIC X(2) VALUE 'AB'.\n   05 A2 PIC 9(3) VALUE 42.\n01 B.\n   05 B1 PIC X(3).\n   05 B2 PIC X(2).", "MOVE A TO B.", {}, {"B1": "AB0", "B2": "42"}),
    "reference modification": ("01 A PIC X(6) VALUE 'ABCDEF'.\n01 B PIC X(3).", "MOVE A(2:3) TO B. MOVE 'ZZ' TO A(5:2).", {}, {"B": "BCD", "A": "ABCDZZ"}),
    "corresponding": ("01 G1.\n   05 X PIC 9(3) VALUE 5.\n   05 Y PIC 9(3) VALUE 7.\n01 G2.\n   05 X PIC 9(3) VALUE 100.\n   05 Z PIC 9(3) VALUE 1.", "ADD CORRESPONDING G1 TO G2.", {}, {"G2.X": "105", "Z": "1", "X": "5"}),
    "edited": ("01 A PIC S9(5)V99.\n01 E PIC $$,$$9.99CR.\n01 Z PIC ZZZ,ZZ9.\n01 S PIC ***9.99.", "MOVE A TO E. MOVE A TO Z. MOVE A TO S.", {"A": "-1234.5"}, {"E": "$1,234.50CR", "Z": "  1,234", "S": "1234.50"}),
    "justified": ("01 A PIC X(5) JUSTIFIED RIGHT.", "MOVE 'AB' TO A.", {}, {"A": "   AB"}),
    "figurative": ("01 A PIC X(3).\n01 N PIC 9(3) VALUE 5.\n01 R PIC X VALUE 'N'.", "MOVE ALL 'XY' TO A. MOVE ZEROS TO N.\nIF N = ZERO MOVE 'Y' TO R.", {}, {"A": "XYX", "N": "0", "R": "Y"}),
    "intrinsics": ("01 A PIC S9(3)V99 VALUE -7.89.\n01 I PIC S9(3).\n01 M PIC S9(3).\n01 X PIC 9(3).\n01 U PIC X(3).", "COMPUTE I = FUNCTION INTEGER(A).\nCOMPUTE M = FUNCTION MOD(-7, 3).\nCOMPUTE X = FUNCTION MAX(3, 9, 4) + FUNCTION LENGTH(U).\nMOVE FUNCTION UPPER-CASE('abc') TO U.", {}, {"I": "-7", "M": "-1", "X": "12", "U": "ABC"}),
    "power": ("01 R PIC 9(5).", "COMPUTE R = 2 ** 10 + 3 ** 2.", {}, {"R": "1033"}),
    "comp binary keeps": ("01 B PIC S9(4) COMP.", "MOVE 12345 TO B.", {}, {"B": "12345"}, "", CobolConf(trunc="BIN")),
    "comp standard truncates": ("01 B PIC S9(4) COMP.", "MOVE 12345 TO B.", {}, {"B": "2345"}),
    "comp-5": ("01 B PIC S9(4) COMP-5.", "MOVE 12345 TO B.", {}, {"B": "12345"}),
    "scaling": ("01 P PIC 9(3)PP.", "MOVE 12345 TO P.", {}, {"P": "12300"}),
    "initialize": ("01 G.\n   05 N PIC 9(3) VALUE 7.\n   05 X PIC X(3) VALUE 'ABC'.", "INITIALIZE G.", {}, {"N": "0", "X": ""}),
    "accept": ("01 D PIC 9(8).", "ACCEPT D FROM DATE YYYYMMDD.", {}, {"D": "20240229"}, "", CobolConf(run_date="20240229")),
    "long chain": ("01 A PIC S9(9)V9(9).\n01 R PIC S9(9)V9(4).", "COMPUTE R = ((A * 1.5) - 2) / 3 + 10.", {"A": "100.123456789"}, {"R": "59.3950"}),
    "float": ("01 F COMP-2.\n01 R PIC 9(3)V99.", "COMPUTE F = 1 / 4. COMPUTE R = F * 10.", {}, {"R": "2.50"}),
    "nested if": ("01 A PIC 9.\n01 R PIC X(2).", "IF A > 2\n  IF A > 5 MOVE 'HI' TO R\n  ELSE MOVE 'MD' TO R END-IF\nELSE MOVE 'LO' TO R.", {"A": "4"}, {"R": "MD"}),
    "sections": ("01 A PIC 99 VALUE 0.", "PERFORM S1.", {}, {"A": "3"}, "S1 SECTION.\nQ1.\n    ADD 1 TO A.\nQ2.\n    ADD 2 TO A.\nS2 SECTION.\nQ3.\n    ADD 50 TO A."),
}


@pytest.mark.parametrize("name", CASES)
def test_interpreted(name):
    data, code, inputs, expected, *rest = CASES[name]
    p = parse_program(program(data, code, rest[0] if rest else ""), conf=rest[1] if len(rest) > 1 else None)
    m = interp.Machine(p)
    interp.run_record(m, inputs)
    assert {k: m.output(k) for k in expected} == expected


NATIVE = [n for n in CASES if not any(x in n for x in ("varying", "perform after", "test after", "thru", "depending", "sentence", "table", "redefines", "group move", "modification", "corresponding", "justified", "power", "scaling", "accept", "long chain", "float", "sections", "counts", "pointer", "intrinsics"))]


@pytest.mark.parametrize("name", NATIVE)
def test_compiled(spark, name):
    data, code, inputs, expected, *rest = CASES[name]
    p = parse_program(program(data, code, rest[0] if rest else ""), conf=rest[1] if len(rest) > 1 else None)
    df = spark.createDataFrame([(1, *inputs.values())], "_rec bigint" + "".join(f", in{i} string" for i in range(len(inputs))))
    ins, outs = {f"in{i}": v for i, v in enumerate(inputs)}, {f"out{i}": v for i, v in enumerate(expected)}
    got = compiler.execute(p, df, ins, outs, "native")[0].first()
    assert {v: got[c] for c, v in outs.items()} == expected


def by_columns(p, inputs, outputs):
    """Rows of inputs (a list of values for each variable) through whole columns: texts by output, and errors."""
    ins, outs = {f"in{i}": v for i, v in enumerate(inputs)}, {f"out{i}": v for i, v in enumerate(outputs)}
    machine = columns.Columns(p)
    scales = machine.check(ins, outs)
    n = len(next(iter(inputs.values()))) if inputs else 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), *map(pa.array, inputs.values())], names=["_rec", *ins])
    got = machine.run(batch, ins, outs, scales)
    text = lambda x, s: x if x is None or s is None else format(Decimal(x).scaleb(-s), "f")
    return {v: [text(x, scales[c]) for x in a.to_pylist()] for (c, v), a in zip(outs.items(), got[1:-1], strict=True)}, got[-1].to_pylist()


NO_COLUMNS = ("unstring", "string", "inspect", "search", "sort table", "redefines", "group move", "modification", "corresponding", "figurative", "intrinsics", "scaling", "accept", "float")


@pytest.mark.parametrize("name", CASES)
def test_columns(name):
    data, code, inputs, expected, *rest = CASES[name]
    p = parse_program(program(data, code, rest[0] if rest else ""), conf=rest[1] if len(rest) > 1 else None)
    if any(x in name for x in NO_COLUMNS):
        with pytest.raises(columns.NotColumns):
            by_columns(p, {k: [v] for k, v in inputs.items()}, expected)
        return
    got, errors = by_columns(p, {k: [v] for k, v in inputs.items()}, expected)
    assert errors == [None] and {k: v[0] for k, v in got.items()} == expected


LOOPS = {
    "countdown with exits": ("01 A PIC S9(5).\n01 B PIC 9(3).\n01 S PIC S9(7)V99 VALUE 0.\n01 T PIC X(3).", """PERFORM UNTIL A < 3
  SUBTRACT B FROM A
  IF B = 4 EXIT PERFORM END-IF
  IF A > 50 EXIT PERFORM CYCLE END-IF
  COMPUTE S = S + A / 3
  ADD 1 TO B ON SIZE ERROR MOVE 'BIG' TO T END-ADD
END-PERFORM.""", ("A", "B"), ("S", "A", "B", "T"), ""),
    "nested varying with tables": ("01 A PIC 9(3).\n01 B PIC 9(2).\n01 I PIC 99.\n01 J PIC 99.\n01 TAB.\n   05 ROW OCCURS 5 TIMES.\n      10 CELL PIC S9(4)V9 OCCURS 4 TIMES.\n01 S PIC S9(6)V9 VALUE 0.", """PERFORM VARYING I FROM 1 BY 1 UNTIL I > 5
     AFTER J FROM 1 BY 1 UNTIL J > 4
  COMPUTE CELL(I, J) = A * I - B * J / 7
END-PERFORM.
PERFORM TOTAL VARYING I FROM B BY 1 UNTIL I > 5.""", ("A", "B"), ("S", "CELL(2,3)"), "TOTAL.\n    ADD CELL(I, 1) CELL(I, 4) TO S."),
    "go to and times": ("01 A PIC S9(4).\n01 B PIC 9(2).\n01 N PIC 9(5) VALUE 0.\n01 R PIC X(4) VALUE 'NONE'.\n   88 ODD VALUE 'ODD'.", """PERFORM P1 THRU P3 B TIMES.
IF ODD ADD 1000 TO N.
GO TO PZ.""", ("A", "B"), ("N", "R", "A"), """P1.
    ADD 1 TO N.
    IF A > 20 GO TO P3.
    IF A < -5 NEXT SENTENCE ELSE ADD 7 TO A.
    ADD 2 TO N.
P2.
    EVALUATE TRUE
      WHEN A = 0 MOVE 'ZERO' TO R
      WHEN FUNCTION MOD(A, 2) = 1 SET ODD TO TRUE
      WHEN OTHER MOVE 'EVEN' TO R
    END-EVALUATE.
P3.
    ADD 3 TO A.
PZ.
    MULTIPLY 2 BY N."""),
    "powers and quotients": ("01 A PIC S9(9)V9(6).\n01 B PIC S9(4).\n01 Q PIC S9(7)V99.\n01 R PIC S9(5).\n01 W PIC S9(11)V9(4) VALUE 1.\n01 K PIC 9(2) VALUE 0.", """PERFORM WITH TEST AFTER UNTIL K >= 3
  ADD 1 TO K
  COMPUTE W ROUNDED = W * A * A ON SIZE ERROR COMPUTE W = 0.5 - A END-COMPUTE
  DIVIDE A BY B GIVING Q REMAINDER R
END-PERFORM.""", ("A", "B"), ("W", "Q", "R", "K"), ""),
}


@pytest.mark.parametrize("name", LOOPS)
def test_columns_against_records(name):
    """Random rows, through whole columns and record by record."""
    data, code, ins, outs, more = LOOPS[name]
    p, r = parse_program(program(data, code, more)), random.Random(3)
    rows = [{"A": r.choice([f"{r.randint(-99, 999)}", f"{r.randint(0, 30)}", f"-{r.randint(0, 10**8)}.{r.randint(0, 10**6):06d}", None, "0", "x1"]), "B": r.choice([f"{r.randint(0, 9)}", "4", "0", "12"])} for _ in range(200)]
    got, errors = by_columns(p, {v: [x[v] for x in rows] for v in ins}, outs)
    machine = interp.Machine(p)
    for i, row in enumerate(rows):
        try:
            interp.run_record(machine, row)
        except (interp.RunError, ArithmeticError, ValueError) as e:
            assert errors[i] is not None and errors[i].partition(":")[0] == type(e).__name__, (row, e)
            continue
        assert errors[i] is None, (row, errors[i])
        for v in outs:
            want = machine.output(v)
            assert got[v][i] == want or Decimal(got[v][i]) == Decimal(want), (row, v)
    assert any(errors) and not all(errors)


@pytest.mark.parametrize("loop", ["PERFORM UNTIL A > 9 ADD 1 TO B END-PERFORM.", "PERFORM WITH TEST AFTER UNTIL A > 9\n  ADD 1 TO B END-PERFORM.", "PERFORM VARYING B FROM 1 BY 1 UNTIL A > 9\n  CONTINUE END-PERFORM.", "GO TO MAIN-PART."])
def test_endless_loops_are_error_rows(loop, monkeypatch):
    monkeypatch.setattr(interp, "STEPS", 2000)
    p = parse_program(program("01 A PIC 99.\n01 B PIC 9(4).", loop))
    got, errors = by_columns(p, {"A": ["5", "50", "7"]}, ["A"])
    ended = [None if "GO TO" not in loop else "x"] * 3
    assert [bool(e) for e in errors] == [True, bool(ended[1]), True] and "loop" in errors[0]
    machine = interp.Machine(p)
    with pytest.raises(interp.RunError, match="loop"):
        interp.run_record(machine, {"A": "5"})


def test_routes_agree(spark):
    data = "01 A PIC S9(5)V99.\n01 B PIC S9(3)V9(4).\n01 Q PIC S9(5)V9(3).\n01 T PIC X(4).\n01 N PIC 9(3) VALUE 0."
    code = "IF A > 100 AND B NOT = 0\n DIVIDE A BY B GIVING Q ROUNDED\n  ON SIZE ERROR MOVE 'BIG' TO T\n  NOT ON SIZE ERROR MOVE 'FINE' TO T\n END-DIVIDE\nELSE\n COMPUTE Q = A * B - 1.005\nEND-IF.\nPERFORM BUMP 3 TIMES.\nDISPLAY T N."
    p = parse_program(program(data, code, "BUMP.\n    ADD 7 TO N.\n    IF T = 'BIG' SUBTRACT 2 FROM N."))
    rows = [(i, Decimal(f"{i * 37 % 20001 - 9000}.{i % 100:02d}"), Decimal(f"{i % 7 - 3}.{i % 9999:04d}")) for i in range(300)]
    df = spark.createDataFrame(rows, "_rec bigint, a decimal(7,2), b decimal(7,4)")
    outs = {"q": "Q", "t": "T", "n": "N"}
    native, route = compiler.execute(p, df, {"a": "A", "b": "B"}, outs)
    arrow, other = compiler.execute(p, df, {"a": "A", "b": "B"}, outs, "arrow")
    assert route == "native" and other.startswith("arrow")
    assert sorted(map(tuple, native.collect())) == sorted(map(tuple, arrow.collect()))


def test_errors_and_fallback(spark):
    p = parse_program(program("01 A PIC 9(3).", "PERFORM UNTIL A > 5 ADD 1 TO A END-PERFORM."))
    df = spark.createDataFrame([(1, "2"), (2, "900"), (3, "x")], "_rec bigint, a string")
    out, route = compiler.execute(p, df, {"a": "A"}, {"a": "A"})
    got = {r._rec: (r.a, r._error) for r in out.collect()}
    assert route.startswith("arrow") and got[1] == ("6", None) and got[2] == ("900", None) and got[3][1]
    endless = parse_program(program("01 A PIC 9.", "PERFORM UNTIL A > 9 ADD 1 TO A END-PERFORM."))
    assert "loop" in compiler.execute(endless, df.limit(1), {"a": "A"}, {"a": "A"})[0].first()._error
    with pytest.raises(ValueError):
        compiler.execute(parse_program(program("01 A PIC 9.", "ALTER X1 TO PROCEED TO X2.")), df, {}, {"a": "A"})


@pytest.mark.parametrize("bad", ["", "IDENTIFICATION", "PROCEDURE DIVISION. X. FOO BAR.", program("01 A PIC Q.", "MOVE 1 TO A."), program("01 A PIC 9.", "IF"), program("01 A", "COMPUTE = 1."), program("01 A PIC 9.", "MOVE TO A.")])
def test_malformed(bad):
    try:
        parse_program(bad)
    except (SourceError, ValueError):
        pass


def test_file_program(spark):
    source = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. COPYALL.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT IN-F ASSIGN TO INF FILE STATUS IS ST.
           SELECT OUT-F ASSIGN TO OUTF.
       DATA DIVISION.
       FILE SECTION.
       FD IN-F.
       01 IN-R.
          05 K PIC X(3).
          05 AMT PIC 9(5).
       FD OUT-F.
       01 OUT-R.
          05 OK PIC X(3).
          05 RUN-TOTAL PIC 9(7).
       WORKING-STORAGE SECTION.
       01 ST PIC XX.
       01 EOF PIC X VALUE 'N'.
       01 T PIC 9(7) VALUE 0.
       PROCEDURE DIVISION.
       MAIN-P.
           OPEN INPUT IN-F OUTPUT OUT-F.
           READ IN-F AT END MOVE 'Y' TO EOF END-READ.
           PERFORM UNTIL EOF = 'Y'
              ADD AMT TO T
              MOVE K TO OK
              MOVE T TO RUN-TOTAL
              WRITE OUT-R
              READ IN-F AT END MOVE 'Y' TO EOF END-READ
           END-PERFORM.
           CLOSE IN-F OUT-F.
           STOP RUN.
"""
    p = parse_program(source)
    rows = spark.createDataFrame([(1, "aaa", "10"), (0, "bbb", "5"), (2, "ccc", "1")], "_rec bigint, K string, AMT string")
    out = compiler.execute_io(p, {"IN-F": rows}, "OUT-F", "`OK` string, `RUN-TOTAL` string")
    assert [tuple(r) for r in out.collect()] == [("bbb", "5"), ("aaa", "15"), ("ccc", "16")]


def test_file_longer_than_step_limit(spark, monkeypatch):
    """Each record that is read gives a file program its steps anew; a loop that reads nothing still ends."""
    from tallyframe.plans import catalog_programs

    monkeypatch.setattr(interp, "STEPS", 100)
    text = catalog_programs.FILE_PROGRAM
    run = lambda source: interp.Machine(parse_program(source))
    m = run(text)
    m.files = {"STOCK-F": [{"KEY-N": str(k), "SIZ": "2"} for k in range(500)]}
    m.run()
    made = m.written["SUM-F"]
    assert len(made) == 501 and made[499]["TOTAL"] == 1000 and made[500]["STAT"] == "10"
    m = run(text.replace("MOVE ST TO STAT\n", "PERFORM UNTIL T < 0\n MOVE 1 TO SIZ\n END-PERFORM\n", 1))
    m.files = {"STOCK-F": [{"KEY-N": "1", "SIZ": "2"}] * 3}
    with pytest.raises(interp.RunError, match="too many steps"):
        m.run()


def test_portfolio_is_spread(spark, monkeypatch):
    """Sources of one partition are parsed in as many tasks as their number asks for."""
    monkeypatch.setattr(scratch, "EACH", 5)
    text = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. X{}.\n       PROCEDURE DIVISION.\n       MAIN-P.\n           STOP RUN.\n"
    sources = spark.createDataFrame([(f"X{k}", text.format(k)) for k in range(20)], "name string, source string").coalesce(1)
    found = lang.portfolio(spark, sources)("programs").groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("program").alias("x")).collect()
    assert len(found) == 4 and sorted(x for r in found for x in r.x) == sorted(f"X{k}" for k in range(20))


@pytest.mark.parametrize("way", ["arrow", "traced"])
def test_records_are_spread(spark, monkeypatch, way):
    """Records of one partition that are run one by one go to as many tasks as their number asks for."""
    monkeypatch.setattr(compiler, "RECORDS", 5)
    p = parse_program(program("01 A PIC 9(3).", "ADD 1 TO A."))
    rows = spark.range(0, 20, numPartitions=1).select(F.col("id").alias("_rec"), F.col("id").cast("string").alias("a"))
    out = compiler.traced(p, rows, {"a": "A"}) if way == "traced" else compiler.execute(p, rows, {"a": "A"}, {"x": "A"}, "arrow")[0]
    found = out.groupBy(F.spark_partition_id().alias("p")).agg(F.collect_set("_rec").alias("x")).collect()
    assert len(found) == 4 and sorted(x for r in found for x in r.x) == list(range(20))
