"""More registered queries: row programs of one group of verbs each, record files, stores, and a portfolio of a program for every supplier."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import api
from tallyframe.conf import CobolConf
from tallyframe.functions import codecs
from tallyframe.functions.pic import parse
from tallyframe.plans import compile as compiler
from tallyframe.plans import fixtures, lang, portfolio, vault
from tallyframe.plans.catalog import BAL, LAYOUT, C, balances, money, query, scaled, t
from tallyframe.plans.scratch import cut, folder
from tallyframe.sources import layout as layouts
from tallyframe.sources import records

# Row programs ------------------------------------------------------------------------------------------

PART_SQL = f"SELECT p_partkey AS record, CAST(p_size AS BIGINT) AS n, {C.format('p_retailprice')} AS p, p_name, p_brand FROM part"


def parts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("_rec"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").cast("decimal(3,0)").alias("n"), money("p_retailprice", 7).alias("price"))


def source(data: str, code: str, name: str = "CASE-X", before: str = "") -> str:
    """A program of these declarations and statements."""
    lines = lambda s, n: "\n".join(" " * n + x for x in s.strip().splitlines())
    return f"{before}       IDENTIFICATION DIVISION.\n       PROGRAM-ID. {name}.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n{lines(data, 7)}\n       PROCEDURE DIVISION.\n       MAIN-P.\n{lines(code, 11)}\n"


def run(rows: DataFrame, program: str, ins: Mapping[str, str], outs: Mapping[str, str], route: str = "auto", library: Mapping[str, str] | None = None, conf: CobolConf | None = None) -> DataFrame:
    return compiler.execute(lang.parse_program(program, library, conf), rows, ins, outs, route)[0].withColumnRenamed("_rec", "record")


def whole(c: str, decimals: int = 0):
    return scaled(F.col(c).cast(f"decimal(30,{decimals})"), decimals).alias(c)


@query(f"SELECT record, n * 3 AS tripled, (n * p + 50) // 100 % 10000000 AS x, n * p // 10 % 1000000 AS y, CASE WHEN n * 7 > 99 THEN n ELSE n * 7 END AS b, CASE WHEN n * 7 > 99 THEN 'Y' ELSE 'N' END AS flag FROM ({PART_SQL})")
def multiply_forms(spark, d):
    """MULTIPLY BY, GIVING several targets, ROUNDED, ON SIZE ERROR."""
    p = source(
        "01 N PIC 9(3).\n01 PRICE PIC S9(5)V99.\n01 A PIC 9(5).\n01 X PIC 9(7).\n01 Y PIC 9(5)V9.\n01 B PIC 9(2).\n01 F PIC X VALUE 'N'.",
        "MOVE N TO A. MOVE N TO B.\nMULTIPLY 3 BY A.\nMULTIPLY N BY PRICE GIVING X ROUNDED Y.\nMULTIPLY 7 BY B ON SIZE ERROR MOVE 'Y' TO F END-MULTIPLY.\nSTOP RUN.",
    )
    out = run(parts(spark, d), p, {"n": "N", "price": "PRICE"}, {"tripled": "A", "x": "X", "y": "Y", "b": "B", "flag": "F"}, "native")
    return out.select("record", whole("tripled"), whole("x"), whole("y", 1), whole("b"), "flag")


@query(f"SELECT record, p // 100 AS kept, p // 100 % 100 AS cut FROM ({PART_SQL})")
def trunc_opt(spark, d):
    """TRUNC(OPT) keeps a binary field's whole value, STD its digits."""
    code = source("01 PRICE PIC S9(5)V99.\n01 B PIC S9(2) COMP.", "MOVE PRICE TO B.\nSTOP RUN.")
    kept = run(parts(spark, d), "       CBL TRUNC(OPT)\n" + code, {"price": "PRICE"}, {"kept": "B"}, "columns")
    cut = run(parts(spark, d), code, {"price": "PRICE"}, {"cut": "B"}, "native")
    return kept.join(cut, "record").select("record", whole("kept"), whole("cut"))


@query(f"SELECT record, CASE WHEN n IN (1, 3) OR n > 40 THEN 'Y' ELSE 'N' END AS a, CASE WHEN n > 5 AND n < 20 AND n <> 7 THEN 'Y' ELSE 'N' END AS b, CASE WHEN NOT (n = 2 OR n >= 30) AND (n < 10 OR n = 25) THEN 'Y' ELSE 'N' END AS c FROM ({PART_SQL})")
def abbreviated_conditions(spark, d):
    p = source(
        "01 N PIC 9(3).\n01 A PIC X VALUE 'N'.\n01 B PIC X VALUE 'N'.\n01 C PIC X VALUE 'N'.",
        "IF N = 1 OR 3 OR > 40 MOVE 'Y' TO A END-IF.\nIF N > 5 AND < 20 AND NOT = 7 MOVE 'Y' TO B END-IF.\nIF NOT (N = 2 OR N NOT < 30) AND (N < 10 OR N = 25)\n  MOVE 'Y' TO C END-IF.\nSTOP RUN.",
    )
    return run(parts(spark, d), p, {"n": "N"}, {"a": "A", "b": "B", "c": "C"}, "native").select("record", "a", "b", "c")


@query(f"SELECT record, n * 25 // 10 + 12 AS x, CAST((n * 150 + 25) AS BIGINT) AS y FROM ({PART_SQL})")
def comma_copy_constants(spark, d):
    """DECIMAL-POINT IS COMMA, a copybook with REPLACING, level 78 constants."""
    p = source("COPY FIELDS REPLACING ==:P:== BY ==WS==.\n78 STEP-UP VALUE 12.", "COMPUTE WS-X = WS-N * 2,5 + STEP-UP.\nCOMPUTE WS-Y = WS-N * 1,50 + 0,25.\nSTOP RUN.")
    p = p.replace("       DATA DIVISION", "       ENVIRONMENT DIVISION.\n       CONFIGURATION SECTION.\n       SPECIAL-NAMES.\n           DECIMAL-POINT IS COMMA.\n       DATA DIVISION")
    library = {"FIELDS": "       01 :P:-N PIC 9(3).\n       01 :P:-X PIC 9(5).\n       01 :P:-Y PIC 9(5)V99.\n"}
    return run(parts(spark, d), p, {"n": "WS-N"}, {"x": "WS-X", "y": "WS-Y"}, "native", library).select("record", whole("x"), whole("y", 2))


@query(f"SELECT record, 30 * n + 24 * (n % 7) AS total, 3 * n + (n % 7) * 2 AS cell, CASE WHEN n < 3 THEN 0 ELSE least(n - 2, 5) END AS found FROM ({PART_SQL})")
def table_loops(spark, d):
    """OCCURS tables filled and read in nested PERFORM VARYING, with bounds from the data, over whole columns."""
    p = source(
        "01 N PIC 9(3).\n01 M PIC 9(3).\n01 Q PIC 9(3).\n01 I PIC 99.\n01 J PIC 99.\n01 TAB.\n   05 ROW OCCURS 5 TIMES.\n      10 CELL PIC 9(5) OCCURS 4 TIMES.\n01 S PIC 9(7) VALUE 0.\n01 K PIC 99 VALUE 0.\n01 LOW PIC 9(3).",
        """DIVIDE N BY 7 GIVING Q REMAINDER M.
PERFORM VARYING I FROM 1 BY 1 UNTIL I > 5
  PERFORM VARYING J FROM 1 BY 1 UNTIL J > 4
    COMPUTE CELL(I, J) = I * N + J * M
  END-PERFORM
END-PERFORM.
PERFORM VARYING I FROM 1 BY 1 UNTIL I > 4
  ADD CELL(I, 1) CELL(I, 2) CELL(I, 3) TO S
END-PERFORM.
MOVE N TO LOW.
PERFORM UNTIL LOW < 3 OR K = 5
  SUBTRACT 1 FROM LOW
  ADD 1 TO K
END-PERFORM.
STOP RUN.""",
    )
    out = run(parts(spark, d), p, {"n": "N"}, {"total": "S", "cell": "CELL(3,2)", "found": "K"}, "columns")
    return out.select("record", whole("total"), whole("cell"), whole("found"))


@query(f"SELECT record, 2 * (CASE WHEN n > 20 THEN 1 WHEN n = 5 THEN 1 + 10 ELSE 1 + 7 + 10 END + CASE n % 3 WHEN 1 THEN 100 WHEN 2 THEN 200 ELSE 0 END) AS total FROM ({PART_SQL})")
def go_to_paragraphs(spark, d):
    """PERFORM THRU, GO TO, GO TO DEPENDING ON, NEXT SENTENCE."""
    p = source("01 N PIC 9(3).\n01 M PIC 9(3).\n01 Q PIC 9(3).\n01 T PIC 9(5) VALUE 0.", "DIVIDE N BY 3 GIVING Q REMAINDER M.\nPERFORM P1 THRU P3.\nGO TO A1 A2 DEPENDING ON M.\nGO TO PZ.")
    p += """       P1.
           ADD 1 TO T.
           IF N > 20 GO TO P3.
           IF N = 5 NEXT SENTENCE ELSE ADD 7 TO T.
       P2.
           ADD 10 TO T.
       P3.
           EXIT.
       A1.
           ADD 100 TO T.
           GO TO PZ.
       A2.
           ADD 200 TO T.
       PZ.
           MULTIPLY 2 BY T.
           STOP RUN.
"""
    return run(parts(spark, d), p, {"n": "N"}, {"total": "T"}, "columns").select("record", whole("total"))


@query("SELECT n_nationkey AS record, '20240229' AS ymd, '240229' AS short, 24060 AS yday, 4 AS dow, '2024022911223344+0000' AS stamp FROM nation")
def dates_of_a_run(spark, d):
    """ACCEPT FROM DATE, DAY, DAY-OF-WEEK and FUNCTION CURRENT-DATE come from the run's parameters."""
    p = source(
        "01 A PIC X(8).\n01 B PIC X(6).\n01 C PIC 9(5).\n01 D PIC 9.\n01 E PIC X(21).",
        "ACCEPT A FROM DATE YYYYMMDD.\nACCEPT B FROM DATE.\nACCEPT C FROM DAY.\nACCEPT D FROM DAY-OF-WEEK.\nMOVE FUNCTION CURRENT-DATE TO E.\nSTOP RUN.",
    )
    rows = t(spark, d, "nation").select(F.col("n_nationkey").alias("_rec"))
    out = run(rows, p, {}, {"ymd": "A", "short": "B", "yday": "C", "dow": "D", "stamp": "E"}, conf=CobolConf(run_date="20240229", run_time="11223344"))
    return out.select("record", "ymd", "short", F.col("yday").cast("int"), F.col("dow").cast("int"), "stamp")


@query(f"SELECT record, substr(upper(trim(p_name)) || '', 1, 40) AS up, CAST(40 AS BIGINT) AS size, 'PART ' || lpad(CAST(n AS VARCHAR), 3, '0') || CASE WHEN n > 25 THEN ' | LARGE' ELSE '' END AS shown FROM ({PART_SQL})")
def text_functions(spark, d):
    """FUNCTION TRIM, UPPER-CASE and LENGTH; DISPLAY lines of each record."""
    p = source("01 NAME PIC X(40).\n01 N PIC 9(3).\n01 U PIC X(40).\n01 L PIC 9(3).", "MOVE FUNCTION UPPER-CASE(FUNCTION TRIM(NAME)) TO U.\nCOMPUTE L = FUNCTION LENGTH(NAME).\nDISPLAY 'PART ' N.\nIF N > 25 DISPLAY ' | LARGE'.\nSTOP RUN.")
    out = run(parts(spark, d), p, {"name": "NAME", "n": "N"}, {"up": "U", "size": "L"})
    return out.select("record", "up", whole("size"), F.array_join("_display", "").alias("shown"))


@query(f"SELECT record, CAST(floor(sqrt(p)) AS BIGINT) AS root, CAST(1 AS BIGINT) AS one FROM ({PART_SQL})")
def square_roots(spark, d):
    """FUNCTION SQRT and EXP."""
    p = source("01 PRICE PIC 9(5)V99.\n01 R PIC 9(5).\n01 E PIC 9(3).", "COMPUTE R = FUNCTION SQRT(PRICE * 100).\nCOMPUTE E = FUNCTION EXP(0).\nSTOP RUN.")
    return run(parts(spark, d), p, {"price": "PRICE"}, {"root": "R", "one": "E"}).select("record", whole("root"), whole("one"))


FILE_PROGRAM = """
       IDENTIFICATION DIVISION.
       PROGRAM-ID. SUMUP.
       ENVIRONMENT DIVISION.
       INPUT-OUTPUT SECTION.
       FILE-CONTROL.
           SELECT STOCK-F ASSIGN TO STOCKF FILE STATUS IS ST.
           SELECT SUM-F ASSIGN TO SUMF.
       DATA DIVISION.
       FILE SECTION.
       FD STOCK-F.
       01 STOCK-R.
          05 KEY-N PIC 9(9).
          05 SIZ   PIC 9(3).
       FD SUM-F.
       01 SUM-R.
          05 KEY-O PIC 9(9).
          05 TOTAL PIC 9(9).
          05 STAT  PIC XX.
       WORKING-STORAGE SECTION.
       01 ST  PIC XX.
       01 EOF PIC X VALUE 'N'.
       01 T   PIC 9(9) VALUE 0.
       PROCEDURE DIVISION.
       MAIN-P.
           OPEN INPUT STOCK-F OUTPUT SUM-F.
           READ STOCK-F AT END MOVE 'Y' TO EOF END-READ.
           PERFORM UNTIL EOF = 'Y'
              ADD SIZ TO T
              MOVE KEY-N TO KEY-O
              MOVE T TO TOTAL
              MOVE ST TO STAT
              WRITE SUM-R
              READ STOCK-F AT END MOVE 'Y' TO EOF END-READ
           END-PERFORM.
           MOVE 999999999 TO KEY-O.
           MOVE ST TO STAT.
           WRITE SUM-R.
           CLOSE STOCK-F SUM-F.
           STOP RUN.
"""


@query("SELECT * FROM (SELECT p_partkey AS key_o, CAST(sum(p_size) OVER (ORDER BY p_partkey) AS BIGINT) AS total, '00' AS stat FROM part UNION ALL SELECT 999999999, (SELECT CAST(sum(p_size) AS BIGINT) FROM part), '10')")
def file_program(spark, d):
    """OPEN, READ AT END, WRITE, CLOSE and file status of a program whose storage lives across records: one ordered task."""
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("_rec"), F.col("p_partkey").cast("string").alias("KEY-N"), F.col("p_size").cast("string").alias("SIZ"))
    out = compiler.execute_io(lang.parse_program(FILE_PROGRAM), {"STOCK-F": rows}, "SUM-F", "`KEY-O` string, `TOTAL` string, `STAT` string")
    return out.select(F.col("`KEY-O`").cast("bigint").alias("key_o"), F.col("TOTAL").cast("bigint").alias("total"), F.col("STAT").alias("stat"))


@query("WITH a AS (SELECT p_partkey AS record, CAST(p_size AS BIGINT) AS q, p_size // 7 AS k FROM part) SELECT record, 2 + 3 * k AS events, (k * (k + 1) // 2 * 3 + q % 7) AS last_value FROM a")
def trace_events(spark, d):
    """Trace mode: every record's state changes as rows."""
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("_rec"), F.col("p_size").cast("decimal(5,0)").alias("q"))
    out = compiler.traced(lang.parse_program(fixtures.TIERS), rows, {"q": "QTY"})
    return out.groupBy(F.col("_rec").alias("record")).agg(F.count("*").alias("events"), F.max_by("new_value", "idx").cast("bigint").alias("last_value"))


# Record files ------------------------------------------------------------------------------------------


@query(f"SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS record, c_custkey AS id, c_name AS name, {C.format('c_acctbal')} AS bal, {C.format('c_acctbal')} AS zon, {C.format('c_acctbal')} AS bin FROM customer")
def fixed_file_scan(spark, d):
    """EBCDIC records with packed and binary fields through the ``fixedwidth`` source: written in order, read in parts and numbered."""
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("_rec"), F.col("c_custkey").cast("decimal(10,0)").alias("id"), F.col("c_name").alias("name"), money("c_acctbal").alias("bal"), money("c_acctbal").alias("zon"), money("c_acctbal").alias("bin"))
    path = folder(spark, "customers")
    records.write_fixed(layouts.encoded(rows, LAYOUT), path)
    out = records.scan(spark, path, LAYOUT)
    return out.select(F.col("_rec").alias("record"), F.col("id").cast("bigint"), "name", *(scaled(F.col(c).cast("decimal(20,2)"), 2).alias(c) for c in ("bal", "zon", "bin")))


LINES = layouts.Layout("lines", (layouts.Field("KEY", 0, 8, "integer"), layouts.Field("NAME", 8, 20), layouts.Field("SIZ", 28, 4, "integer")))


@query("""WITH p AS (SELECT p_partkey AS k, rpad(substr(p_name, 1, 20), 20, ' ') AS name, p_size AS n FROM part WHERE p_partkey % 10 > 0)
SELECT row_number() OVER (ORDER BY k) - 1 AS record, k AS key, CASE WHEN k % 7 = 0 THEN rtrim(substr(name, 1, 6)) ELSE rtrim(name) END AS name, CASE WHEN k % 7 = 0 THEN 0 ELSE n END AS siz, CAST(CASE WHEN k % 7 = 0 THEN 2 ELSE 0 END AS INTEGER) AS warnings FROM p""")
def line_file_scan(spark, d):
    """Line records of several files: blank ones skipped, short ones with warnings, numbered by file and place."""
    key = F.col("p_partkey")
    full = F.concat(F.lpad(key.cast("string"), 8, "0"), F.rpad(F.substring("p_name", 1, 20), 20, " "), F.lpad(F.col("p_size").cast("string"), 4, " "))
    line = F.when(key % 10 == 0, "").when(key % 7 == 0, F.substring(full, 1, 14)).otherwise(full)
    path = folder(spark, "lines")
    t(spark, d, "part").select("p_partkey", line.alias("value")).repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").select("value").write.text(path)
    out = records.scan(spark, path, LINES)
    return out.select(F.col("_rec").alias("record"), F.col("KEY").cast("bigint").alias("key"), F.col("NAME").alias("name"), F.coalesce(F.col("SIZ").cast("int"), F.lit(0)).alias("siz"), F.size("_warnings").alias("warnings"))


@query("SELECT n_nationkey, sha256(n_name) AS sha256, length(n_name) AS length, length(n_name) <= 8 AS accepted FROM nation")
def upload_hashes(spark, d):
    """SHA-256 and size cap of uploaded files; half of them through the path for large files."""
    path = folder(spark, "uploads")
    t(spark, d, "nation").select("n_name", "n_nationkey").repartition(5, "n_nationkey").write.partitionBy("n_nationkey").option("lineSep", "\0").text(path)
    # the text writer ends each line; hash what precedes
    out = records.upload_digest(spark, f"{path}/*/part-*", most=9, one_value=8)
    key = F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int")
    names = t(spark, d, "nation").select("n_nationkey", F.sha2(F.concat("n_name", F.lit("\0")), 256).alias("own"), F.sha2("n_name", 256).alias("bare"))
    return out.withColumn("n_nationkey", key).join(names, "n_nationkey").where("sha256 = own").select("n_nationkey", F.col("bare").alias("sha256"), (F.col("length") - 1).alias("length"), "accepted")


@query("SELECT c_custkey, hex(CAST(CAST(CAST(c_acctbal AS FLOAT) AS BIT) AS BLOB)) AS single, hex(CAST(CAST(c_acctbal AS BIT) AS BLOB)) AS double, CAST(round(CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE) * 1000) AS BIGINT) AS mills FROM customer")
def float_bytes(spark, d):
    """COMP-1 and COMP-2 forms."""
    one = codecs.single_encode(F.col("c_acctbal"))
    return t(spark, d, "customer").select("c_custkey", F.hex(one).alias("single"), F.hex(codecs.float_encode(F.col("c_acctbal"))).alias("double"), F.round(codecs.float_decode(one) * 1000).cast("bigint").alias("mills"))


@query(f"SELECT c_custkey, regexp_replace(lpad(CAST(abs(b) AS VARCHAR), 9, '0'), '(.)', 'F\\1', 'g') AS encoded, abs(b) AS decoded FROM ({BAL})")
def display_codec(spark, d):
    """DISPLAY digits in code page 037."""
    e = codecs.display_encode(F.abs(F.col("bal")), parse("9(7)V99"))
    return balances(spark, d).select("c_custkey", F.hex(e).alias("encoded"), scaled(codecs.display_decode(e, 2).cast("decimal(20,2)"), 2).alias("decoded"))


# Stores ------------------------------------------------------------------------------------------------


@query("SELECT s_nationkey, s_suppkey AS id, 'report of ' || s_name AS report FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS r FROM supplier) WHERE r <= 2")
def report_list(spark, d):
    """Reports are saved (in two appends) and the newest of each user listed."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("username"), F.concat(F.lit("report of "), "s_name").alias("report"))
    path = folder(spark, "reports")
    vault.save_reports(s.where("id % 2 = 0"), path)
    vault.save_reports(s.where("id % 2 = 1"), path)
    return vault.newest(vault.saved_reports(spark, path), 2).select(F.col("username").cast("int").alias("s_nationkey"), "id", "report")


@query("SELECT s_suppkey AS id, s_name AS text, TRUE AS ok, FALSE AS forged FROM supplier")
def signed_records(spark, d):
    """Keyed signatures of records, and what a changed record's is worth."""
    key = F.lit("0123456789abcdef0123456789abcdef")
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("text"))
    mac = vault.signature(F.col("text"), key)
    return s.select("id", "text", vault.signed(F.col("text"), mac, key).alias("ok"), vault.signed(F.concat("text", F.lit("!")), mac, key).alias("forged"))


# A portfolio -------------------------------------------------------------------------------------------

SUP = "WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS k, 'S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS program, s_nationkey AS n FROM supplier)"


def generated(spark: SparkSession, d: str) -> DataFrame:
    """A program for every supplier ``k``: it calls that of ``k / 2``, some call libraries that don't exist, some hold SQL, and which paragraphs are reached or on
    a cycle depends on ``k``."""
    k = F.col("s_suppkey").cast("bigint")
    name = lambda c: F.concat(F.lit("S"), F.lpad(c.cast("string"), 6, "0"))
    when = lambda test, text, other="": F.when(test, text if not isinstance(text, str) else F.lit(text)).otherwise(other)
    text = F.concat(
        when(k % 4 == 1, "       CBL TRUNC(BIN)\n"), F.lit("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. "), name(k), F.lit(".\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n"),
        F.lit("       01 W-AMT PIC S9(5)V99 COMP-3.\n       01 W-RATE PIC S9(3)V9(4) COMP-3.\n       01 W-NET PIC S9(7)V99 COMP-3.\n       01 W-CNT PIC 9(4) COMP.\n"),
        F.lit("       LINKAGE SECTION.\n       01 L-AMT PIC S9(5)V99 COMP-3.\n       PROCEDURE DIVISION USING L-AMT.\n       MAIN-P.\n"),
        when(k % 2 == 0, "           PERFORM STEP-A.\n", "           PERFORM STEP-A THRU STEP-B.\n"),
        when(k > 1, F.concat(F.lit("           CALL '"), name(F.floor(k / 2)), F.lit("' USING W-AMT W-NET.\n"))),
        when(k % 5 == 0, F.concat(F.lit("           CALL 'LIB-N"), F.col("s_nationkey").cast("string"), F.lit("'.\n"))),
        when(k % 4 == 1, "           EXEC SQL SELECT BAL INTO :W-AMT FROM ACCTS\n              WHERE ID = :W-CNT END-EXEC.\n"), F.lit("           GOBACK.\n"),
        F.lit("       STEP-A.\n           COMPUTE W-NET = W-AMT + W-RATE.\n           COMPUTE W-CNT = W-AMT / W-RATE.\n       STEP-B.\n"),
        when(k % 3 == 0, "           PERFORM STEP-C.\n", "           ADD 1 TO W-CNT.\n"), F.lit("       STEP-C.\n"), when(k % 6 == 0, "           PERFORM STEP-B.\n", "           MULTIPLY 2 BY W-CNT.\n"),
        F.lit("       OLD-P.\n           MOVE 0 TO W-CNT.\n"),
    )
    return t(spark, d, "supplier").select(name(k).alias("name"), text.alias("source"))


def tables(spark: SparkSession, d: str):
    return lang.portfolio(spark, generated(spark, d))


REACHED = f"{SUP}, q AS (SELECT program, x.name, CASE x.name WHEN 'STEP-B' THEN k % 2 = 1 WHEN 'STEP-C' THEN k % 6 = 3 WHEN 'OLD-P' THEN FALSE ELSE TRUE END AS reachable FROM s, (VALUES ('MAIN-P'), ('STEP-A'), ('STEP-B'), ('STEP-C'), ('OLD-P')) x(name))"


@query(f"{REACHED} SELECT * FROM q")
def dead_code_suppliers(spark, d):
    tb = tables(spark, d)
    return portfolio.dead_code(tb("paragraphs"), tb("edges")).select("program", "name", "reachable")


@query(f"{REACHED} SELECT program, count(*) AS total_paragraphs, count(*) FILTER (WHERE reachable) AS reachable_paragraphs, CAST(round(count(*) FILTER (WHERE NOT reachable) * 1000.0 / count(*)) AS BIGINT) AS dead_permille FROM q GROUP BY program")
def dead_code_summary_suppliers(spark, d):
    tb = tables(spark, d)
    out = portfolio.dead_summary(portfolio.dead_code(tb("paragraphs"), tb("edges")))
    return out.select("program", "total_paragraphs", "reachable_paragraphs", F.round(F.col("dead_percentage") * 10).cast("bigint").alias("dead_permille"))


@query(f"{SUP} SELECT program, x.name FROM s, (VALUES ('STEP-B'), ('STEP-C')) x(name) WHERE k % 6 = 0")
def perform_cycles_suppliers(spark, d):
    return portfolio.perform_cycles(tables(spark, d)("edges"))


@query(f"""{SUP} SELECT a.program, coalesce((SELECT string_agg(b.program, ',' ORDER BY b.program) FROM s b WHERE b.k > 1 AND b.k // 2 = a.k), '') AS called_by, NOT EXISTS (SELECT 1 FROM s b WHERE b.k > 1 AND b.k // 2 = a.k) AS root,
  CASE WHEN k % 5 = 0 THEN 'LIB-N' || n ELSE '' END AS unresolved FROM s a""")
def call_graph_suppliers(spark, d):
    p = tables(spark, d)("programs").select("program", "source")
    c = cut(portfolio.calls(p), "calls")  # read three times
    roots = portfolio.call_roots(c, p).withColumn("root", F.lit(True))
    missing = portfolio.unresolved(c, p).groupBy("program").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("unresolved"))
    out = p.join(portfolio.called_by(c), "program", "left").join(roots, "program", "left").join(missing, "program", "left")
    return out.select("program", F.coalesce(F.array_join("called_by", ","), F.lit("")).alias("called_by"), F.coalesce("root", F.lit(False)).alias("root"), F.coalesce("unresolved", F.lit("")).alias("unresolved"))


@query(f"{SUP}, l AS (SELECT program, CAST(CASE WHEN k > 0 THEN floor(log2(k)) ELSE 0 END AS INTEGER) AS depth FROM s) SELECT program, depth, CAST(row_number() OVER (ORDER BY depth, program) AS INTEGER) AS position FROM l")
def topo_order_suppliers(spark, d):
    p = tables(spark, d)("programs").select("program", "source")
    return portfolio.topological(portfolio.calls(p), p)


@query("WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS k FROM supplier) SELECT 'P' || a.k AS program FROM s a WHERE a.k % 10 < 3 AND 3 = (SELECT count(*) FROM s b WHERE b.k // 10 = a.k // 10 AND b.k % 10 < 3)")
def call_cycles_suppliers(spark, d):
    """Of each ten programs three call each other in a ring, the others call the next one."""
    k = F.col("s_suppkey").cast("bigint")
    to = F.when(k % 10 == 2, k - 2).when(k % 10 == 9, F.lit(None)).otherwise(k + 1)
    name = lambda c: F.concat(F.lit("P"), c.cast("string"))
    known = t(spark, d, "supplier").select(k.alias("to"))
    calls = t(spark, d, "supplier").select(name(k).alias("program"), to.alias("to")).join(known, "to", "left_semi").select("program", name(F.col("to")).alias("target"), F.lit("STATIC").alias("kind"))
    return portfolio.call_cycles(calls)


@query(f"{SUP} SELECT program, 'S' || lpad(CAST(k // 2 AS VARCHAR), 6, '0') AS target, x.position, x.argument, x.parameter, x.status FROM s, (VALUES (0, 'W-AMT', 'L-AMT', 'MATCHED'), (1, 'W-NET', NULL, 'UNMATCHED')) x(position, argument, parameter, status) WHERE k > 1")
def call_parameters_suppliers(spark, d):
    tb = tables(spark, d)
    return portfolio.parameters(portfolio.calls(tb("programs")), tb("linkage"))


@query(f"{SUP} SELECT program, x.* FROM s, (VALUES ('tainted', 'W-AMT', 'EXEC SQL SELECT'), ('used', 'W-CNT', 'EXEC SQL SELECT')) x(class, var, source) WHERE k % 4 = 1")
def taint_suppliers(spark, d):
    tb = tables(spark, d)
    return portfolio.taint(portfolio.host_variables(tb("blocks")), tb("variables"))


@query(f"{SUP} SELECT program, x.* FROM s, (VALUES ('W-NET', '+', 6, 4, 'WARN'), ('W-CNT', '/', NULL, NULL, 'CRITICAL')) x(target, op, result_int, result_dec, status)")
def arith_risk_suppliers(spark, d):
    tb = tables(spark, d)
    out = portfolio.arithmetic_risk(tb("computes"), tb("variables").select("program", "name", "int_digits", "dec_digits"))
    return out.select("program", "target", "op", "result_int", "result_dec", "status")


@query(f"{SUP} SELECT program, CAST(1 + CAST(k % 3 = 0 AS INT) + CAST(k % 6 = 0 AS INT) AS INTEGER) AS performs, 2 AS computes, 0 AS ifs, 1 AS moves, CAST(CAST(k > 1 AS INT) + CAST(k % 5 = 0 AS INT) AS INTEGER) AS calls, 0 AS gotos FROM s")
def statement_counts_suppliers(spark, d):
    out = portfolio.statement_counts(tables(spark, d)("statements"))
    n = lambda c: F.col(f"`{c}`").cast("int")
    return out.select("program", n("PERFORM").alias("performs"), n("COMPUTE").alias("computes"), n("IF").alias("ifs"), n("MOVE").alias("moves"), n("CALL").alias("calls"), n("GO TO").alias("gotos"))


@query(f"""{SUP} SELECT program, 4 AS comp3, 1 AS comp, CAST(k % 6 <> 0 AS INTEGER) AS mul_div, CASE WHEN k % 4 <> 1 THEN 'TRUNC not specified: default STD; ' ELSE '' END || 'ARITH not specified: default COMPAT; NUMPROC not specified: default NOPFD' AS warnings,
  CASE WHEN k % 4 = 1 THEN 'Defaulting: ARITH=COMPAT, NUMPROC=NOPFD. Confirm.' ELSE 'No options found: defaults apply; confirm them.' END AS recommendation FROM s""")
def compiler_matrix_suppliers(spark, d):
    tb = tables(spark, d)
    out = portfolio.compiler_matrix(tb("programs").drop("source", "lines"), tb("variables"), tb("statements"))
    return out.select("program", F.col("comp3").cast("int").alias("comp3"), F.col("comp").cast("int").alias("comp"), F.col("mul_div").cast("int").alias("mul_div"), F.array_join("warnings", "; ").alias("warnings"), "recommendation")


@query(f"{SUP} SELECT 'application' AS type, program AS name FROM s UNION SELECT 'library', 'S' || lpad(CAST(k // 2 AS VARCHAR), 6, '0') FROM s WHERE k > 1 UNION SELECT 'library', 'LIB-N' || n FROM s WHERE k % 5 = 0 UNION SELECT 'data', 'ACCTS' FROM s WHERE k % 4 = 1")
def sbom_suppliers(spark, d):
    """The components of the documents, read back from their JSON."""
    tb = tables(spark, d)
    bom = portfolio.sbom(tb("programs"), portfolio.calls(tb("programs")), tb("copies"), portfolio.db2_tables(tb("blocks")))
    parts_ = F.from_json("sbom", "components array<struct<type:string,name:string>>")["components"]
    return bom.select(F.inline(parts_))


@query(f"{SUP} SELECT count(*) AS programs, count(*) FILTER (WHERE k % 4 <> 1 AND k <= 1 AND k % 5 <> 0) AS clean, count(*) FILTER (WHERE k % 4 = 1) AS red FROM s")
def batch_analysis_suppliers(spark, d):
    """One batch run over all programs: verdicts and colours."""
    out = api.analyze_batch(spark, generated(spark, d))
    flags = out["issues"].select("program").distinct()
    clean = out["programs"].join(flags, "program", "left_anti").agg(F.count("*").alias("clean"))
    heat = out["heatmap"].agg(F.count("*").alias("programs"), F.count_if(F.col("status") == "red").alias("red"))
    return heat.crossJoin(clean).select("programs", "clean", "red")  # one row each
