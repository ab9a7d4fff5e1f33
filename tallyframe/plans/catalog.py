"""The registered queries and the SQL that each is held against.

Inputs are the benchmark tables; money is whole cents in both engines. Results are integers, texts
and booleans, so values compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.conf import CobolConf
from tallyframe.functions import codecs, ebcdic, edited, predicates, store, strings
from tallyframe.functions.pic import parse
from tallyframe.functions.store import dec
from tallyframe.operators import files, sorting
from tallyframe.plans import compile as compiler
from tallyframe.plans import diff, fixtures, jobs, lang, portfolio, vault
from tallyframe.sources import layout as layouts
from tallyframe.sources import pills

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cents(c: str, digits: int = 15):
    return F.round(F.col(c) * 100).cast("bigint")


def money(c: str, digits: int = 13):
    """A table's double as an exact decimal of cents."""
    return (cents(c).cast(f"decimal({digits},0)") * dec("0.01")).cast(f"decimal({digits},2)")


def scaled(c, n: int):
    return (c * dec(10**n)).cast("bigint")


C = "CAST(round({} * 100) AS BIGINT)"

# Row programs and verification -------------------------------------------------------------------------


def shipments(spark: SparkSession, d: str) -> DataFrame:
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    rows = o.select("o_orderkey", "o_custkey", "o_totalprice").join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    service = F.when(F.col("c_mktsegment") == "BUILDING", "EX").when(F.col("c_mktsegment") == "MACHINERY", "UR").otherwise("ST")
    return rows.select(F.col("o_orderkey").alias("_rec"), money("o_totalprice", 10).alias("value"), (F.col("o_custkey") * 37 % 20000).cast("decimal(5,0)").alias("weight"), (F.col("o_orderkey") % 20).cast("decimal(2,0)").alias("zone"), service.alias("service"))


FREIGHT_IN = {"value": "CARGO-VALUE", "weight": "WEIGHT-KG", "zone": "ZONE-NO", "service": "SERVICE"}
FREIGHT_OUT = {"kilo_cost": "KILO-COST", "freight": "FREIGHT", "pallets": "PALLETS", "premium": "PREMIUM", "extra": "EXTRA", "total": "TOTAL-DUE"}


def bills(spark: SparkSession, d: str, source: str = fixtures.FREIGHT, route: str = "native") -> DataFrame:
    return compiler.execute(lang.parse_program(source), shipments(spark, d), FREIGHT_IN, FREIGHT_OUT, route)[0]


def freight_sql(premium: str) -> str:
    """The bills in whole cents; ``premium`` from ``v``, the rounded one."""
    return f"""
WITH s AS (
  SELECT o_orderkey AS rec, CAST({C.format("o_totalprice")} AS HUGEINT) AS p, o_custkey * 37 % 20000 AS w, o_orderkey % 20 AS z, c_mktsegment IN ('BUILDING', 'MACHINERY') AS hurried FROM orders JOIN customer ON o_custkey = c_custkey
), r AS (SELECT *, CASE WHEN z < 3 THEN 4175 WHEN z < 9 THEN 5820 ELSE 6000 + z * 135 END * 1000 // 7 AS k5, w // 450 + 1 AS pallets, (p * 35 + 5000) // 10000 AS v FROM s
), c AS (SELECT *, CAST(w AS HUGEINT) * k5 // 1000 AS f2, {premium} AS i2 FROM r
), x AS (SELECT *, CASE WHEN hurried THEN least((f2 * 185 + pallets * 425000) // 1000, 95000) ELSE 0 END AS e2 FROM c
), f AS (SELECT *, f2 + i2 + e2 - CASE WHEN p > 2000000 AND NOT hurried THEN 1250 ELSE 0 END AS t2 FROM x)"""


FREIGHT_SQL = freight_sql("least(v, 18000)")
BILL = "SELECT rec AS record, CAST(k5 AS BIGINT) AS kilo_cost, CAST(f2 AS BIGINT) AS freight, CAST(pallets AS BIGINT) AS pallets, CAST(i2 AS BIGINT) AS premium, CAST(e2 AS BIGINT) AS extra, CAST(t2 AS BIGINT) AS total FROM f"


def bill_columns(out: DataFrame) -> DataFrame:
    n = lambda c, k: scaled(F.col(c).cast("decimal(20,5)"), k).alias(c)
    return out.select(F.col("_rec").alias("record"), n("kilo_cost", 5), n("freight", 2), n("pallets", 0), n("premium", 2), n("extra", 2), n("total", 2))


@query(f"{FREIGHT_SQL} {BILL}")
def freight_program(spark, d):
    """The flagship row program, compiled to columns."""
    return bill_columns(bills(spark, d))


@query(f"{freight_sql('CASE WHEN v > 99999 THEN 50000 ELSE v END')} {BILL}")
def freight_program_sized(spark, d):
    """The variant with a size error handler."""
    return bill_columns(bills(spark, d, fixtures.FREIGHT_SIZED))


@query(f"{FREIGHT_SQL} {BILL}")
def freight_program_columns(spark, d):
    """The flagship over whole Arrow columns."""
    return bill_columns(bills(spark, d, route="columns"))


@query("""WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS rec, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
SELECT rec AS record, q // 7 AS steps, (q // 7) * (q // 7 + 1) // 2 * 3 + q % 7 AS score FROM a""")
def loop_program_arrow(spark, d):
    """A loop on data has no column form: the tree runs in Arrow batches."""
    rows = t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_rec"), F.col("l_quantity").cast("decimal(5,0)").alias("q"))
    out, _ = compiler.execute(lang.parse_program(fixtures.TIERS), rows, {"q": "QTY"}, {"steps": "STEP-N", "score": "SCORE"})
    return out.select(F.col("_rec").alias("record"), F.col("steps").cast("bigint"), F.col("score").cast("bigint"))


VERBS_SQL = f"""WITH a AS (SELECT p_partkey, p_name, p_size AS n, {C.format("p_retailprice")} AS p FROM part), b AS (SELECT *, (p * 625 + 500) // 1000 AS v FROM a)
SELECT p_partkey AS record, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS BIGINT) AS num_e, substr(split_part(p_name, ' ', 1) || '/' || lpad(CAST(n AS VARCHAR), 3, '0'), 1, 12) AS label, CASE WHEN n > 40 THEN 'BIG' WHEN n > 10 THEN 'MID' ELSE 'SMALL' END AS band,
  CAST(n // 7 AS BIGINT) AS quot, CAST(n % 7 AS BIGINT) AS rest, CAST(CASE WHEN v > 99999 THEN 0 ELSE v END AS BIGINT) AS netp, CASE WHEN v > 99999 THEN 'Y' ELSE 'N' END AS flag,
  lpad(CASE WHEN p >= 100000 THEN (p // 100000) || ',' || lpad(CAST(p // 100 % 1000 AS VARCHAR), 3, '0') ELSE CAST(p // 100 AS VARCHAR) END, 5, ' ') || '.' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') AS shown FROM b"""


def verbs(spark, d, route: str) -> DataFrame:
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("_rec"), F.col("p_name").alias("name"), F.col("p_size").cast("decimal(3,0)").alias("size"), money("p_retailprice", 7).alias("price"))
    outs = {"num_e": "NUM-E", "label": "LABEL", "band": "BAND", "quot": "QUOT", "rest": "REST", "netp": "NETP", "flag": "FLAG", "shown": "SHOWN"}
    out, _ = compiler.execute(lang.parse_program(fixtures.VERBS), rows, {"name": "PNAME", "size": "SIZ", "price": "PRICE"}, outs, route)
    return out.select(F.col("_rec").alias("record"), *(F.col(c).cast("bigint").alias(c) for c in ("num_e", "quot", "rest")), "label", "band", scaled(F.col("netp").cast("decimal(9,1)"), 1).alias("netp"), "flag", "shown")


@query(VERBS_SQL)
def verbs_program(spark, d):
    """INITIALIZE, INSPECT, STRING, EVALUATE, SET, DIVIDE REMAINDER, ROUNDED, SIZE ERROR and editing as columns."""
    return verbs(spark, d, "native")


@query(VERBS_SQL)
def verbs_program_arrow(spark, d):
    """The same program, record by record."""
    return verbs(spark, d, "arrow")


def drifted(spark, d) -> tuple[DataFrame, DataFrame]:
    produced = bills(spark, d).select("_rec", "total", "freight")
    total = F.col("total").cast("decimal(12,2)")
    moved = F.when(F.col("_rec") % 97 == 3, total + dec("0.01")).when(F.col("_rec") % 101 == 5, total + dec("250.00")).when(F.col("_rec") % 103 == 7, total + dec("10.00")).otherwise(total)
    expected = produced.where(F.col("_rec") % 997 != 11).select("_rec", moved.cast("string").alias("total"), F.when(F.col("_rec") % 211 == 9, "N/K").otherwise(F.col("freight")).alias("freight"))
    return produced, expected


DRIFT_SQL = f"""{FREIGHT_SQL}, m AS (SELECT rec, CAST(t2 AS BIGINT) AS i, CAST(f2 AS BIGINT) AS g, CASE WHEN rec % 97 = 3 THEN 1 WHEN rec % 101 = 5 THEN 25000 WHEN rec % 103 = 7 THEN 1000 ELSE 0 END AS add, rec % 211 = 9 AS bad, rec % 997 = 11 AS gone FROM f
), v AS (SELECT *, (i // 100) || '.' || lpad(CAST(i % 100 AS VARCHAR), 2, '0') AS s, ((i + add) // 100) || '.' || lpad(CAST((i + add) % 100 AS VARCHAR), 2, '0') AS s2, (g // 100) || '.' || lpad(CAST(g % 100 AS VARCHAR), 2, '0') AS h FROM m
), y AS (
  SELECT rec AS record, '_record' AS field, 'present' AS produced_value, 'missing' AS expected_value, 'Record missing from expected' AS difference, 0 AS mag FROM v WHERE gone
  UNION ALL SELECT rec, 'total', s, s2, CASE add WHEN 1 THEN '0.01' WHEN 25000 THEN '250' ELSE '10' END, add FROM v WHERE NOT gone AND add > 0
  UNION ALL SELECT rec, 'freight', h, 'N/K', 'STRING_MISMATCH', 0 FROM v WHERE NOT gone AND bad)"""


@query(f"{DRIFT_SQL} SELECT record, field, produced_value, expected_value, difference FROM y")
def shadow_diff_details(spark, d):
    return diff.compare(*drifted(spark, d), ["total", "freight"])


@query(f"""{DRIFT_SQL} SELECT (SELECT count(*) FROM v) AS total_records, (SELECT count(*) FROM v) - count(DISTINCT record) AS matches, count(DISTINCT record) AS mismatches, CAST(0 AS BIGINT) AS s0c7_abends,
  (SELECT count(*) FROM v) <> (SELECT count(*) FROM v WHERE NOT gone) AS record_count_mismatch, count(*) > 10000 AS details_capped, 'DRIFT DETECTED: ' || count(DISTINCT record) || ' RECORDS' AS verdict FROM y""")
def shadow_diff_totals(spark, d):
    return diff.totals(diff.outcomes(*drifted(spark, d), ["total", "freight"]))


@query(f"""{DRIFT_SQL} SELECT CASE WHEN field = '_record' THEN 'Unknown divergence' WHEN field = 'freight' THEN 'Collation or encoding difference' WHEN mag = 1 THEN 'Rounding divergence below a cent' WHEN mag = 25000 THEN 'Picture overflow' ELSE 'Truncation at a power of ten' END AS likely_cause, field, count(*) AS n
FROM y GROUP BY 1, 2""")
def shadow_diff_diagnosis(spark, d):
    found = diff.diagnose(diff.compare(*drifted(spark, d), ["total", "freight"]), {"total": "decimal"})
    return found.groupBy("likely_cause", "field").agg(F.count("*").alias("n"))


@query(f"""{DRIFT_SQL}, k AS (SELECT record, CASE WHEN max(CASE WHEN field = '_record' THEN 1 ELSE 0 END) = 1 THEN 'length_mismatch' ELSE 'drift' END AS event FROM y GROUP BY record), e AS (SELECT v.rec, coalesce(k.event, 'match') AS event FROM v LEFT JOIN k ON v.rec = k.record)
SELECT event, count(*) AS n FROM e GROUP BY event UNION ALL SELECT 'complete', 1""")
def verification_events(spark, d):
    return diff.events(diff.outcomes(*drifted(spark, d), ["total", "freight"])).groupBy("event").agg(F.count("*").alias("n"))


WIDE_SQL = """
WITH o AS (SELECT o_orderkey AS rec, lpad(CAST(o_orderkey AS VARCHAR), 13, '0') AS k, o_orderkey % 7 AS m FROM orders
), w AS (SELECT *, '7' || k || '3' || k || '000' AS big FROM o)
SELECT rec AS record, CASE m WHEN 0 THEN '0.000000000005' WHEN 1 THEN CAST(CAST(big AS HUGEINT) * 2 AS VARCHAR) WHEN 2 THEN '1' ELSE '0.1' END AS difference,
  CASE m WHEN 0 THEN 'Rounding divergence below a cent' WHEN 1 THEN 'Sign reversal' WHEN 2 THEN 'Whole-number divergence' ELSE 'Numeric value divergence' END AS likely_cause FROM w WHERE m < 4
"""


@query(WIDE_SQL)
def shadow_diff_wide(spark, d):
    """Numbers of 31 to 43 digits and 12 decimals on both sides: any digit counts, forms don't."""
    k, m = F.lpad(F.col("o_orderkey").cast("string"), 13, "0"), F.col("o_orderkey") % 7
    big = F.concat(F.lit("7"), k, F.lit("3"), k, F.lit("000"))
    tail = lambda x: F.concat(big, F.lit(x))
    ours = F.when(m == 0, tail(".120000000005")).when(m == 1, F.concat(F.lit("-"), big)).when(m == 2, F.concat(big, F.lit("000000000001"))).when(m == 3, tail("999999.1")).when(m == 4, tail(".50")).when(m == 5, F.concat(F.lit("+000"), big)).otherwise(big)
    theirs = F.when(m == 0, tail(".12")).when(m == 1, big).when(m == 2, F.concat(big, F.lit("000000000002"))).when(m == 3, tail("999999.2")).when(m == 4, tail(".5")).when(m == 5, tail(".000")).otherwise(F.concat(F.lit("0.00"), F.lit("E1")))
    side = lambda x: t(spark, d, "orders").select(F.col("o_orderkey").alias("_rec"), F.when(m == 6, F.lit("0")).otherwise(x).alias("n"))
    last = lambda df: df.withColumn("n", F.when(F.col("_rec") % 7 == 6, F.lit("-0.0")).otherwise(F.col("n")))
    return diff.diagnose(diff.compare(side(ours), last(side(theirs)), ["n"])).select("record", "difference", "likely_cause")


# Picture arithmetic ------------------------------------------------------------------------------------


def priced(spark, d) -> DataFrame:
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", money("l_extendedprice").alias("price"), (F.round(F.col("l_discount") * 100).cast("decimal(5,0)") * dec("0.01")).cast("decimal(5,2)").alias("disc"), F.col("l_quantity").cast("decimal(5,0)").alias("qty"))


PRICED = f"SELECT l_orderkey, l_linenumber, {C.format('l_extendedprice')} AS p, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(l_quantity AS BIGINT) AS q FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN disc >= 5 THEN (p * (disc - 5) // 1000) % 100000 ELSE -((p * (5 - disc) // 1000) % 100000) END AS signed_v, CASE WHEN disc >= 5 THEN (p * (disc - 5) // 1000) % 100000 ELSE (p * (5 - disc) // 1000) % 100000 END AS unsigned_v FROM ({PRICED})")
def pic_store_std(spark, d):
    """TRUNC(STD): decimals truncate toward zero, high digits are lost, unsigned fields drop the sign."""
    x = (F.col("price") * (F.col("disc") - dec("0.05"))).cast("decimal(19,4)")
    return priced(spark, d).select("l_orderkey", "l_linenumber", scaled(store.store(x, parse("S9(4)V9")), 1).alias("signed_v"), scaled(store.store(x, parse("9(4)V9")), 1).alias("unsigned_v"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN disc >= 5 THEN p * (disc - 5) // 10000 ELSE -(p * (5 - disc) // 10000) END AS bin_v, CASE WHEN disc >= 5 THEN (p * (disc - 5) // 10000) % 100 ELSE -((p * (5 - disc) // 10000) % 100) END AS std_v FROM ({PRICED})")
def pic_store_bin(spark, d):
    """TRUNC(BIN) keeps a binary field's full range; STD doesn't."""
    x = (F.col("price") * (F.col("disc") - dec("0.05"))).cast("decimal(19,4)")
    pic = parse("S9(2)", "COMP")
    return priced(spark, d).select("l_orderkey", "l_linenumber", store.store(x, pic, CobolConf(trunc="BIN")).cast("bigint").alias("bin_v"), store.store(x, pic).cast("bigint").alias("std_v"))


@query(f"SELECT l_orderkey, l_linenumber, p * q > 99999999 AS overflow, CASE WHEN p * q > 99999999 THEN p ELSE p * q END AS kept FROM ({PRICED})")
def size_error(spark, d):
    """ON SIZE ERROR keeps the old value."""
    new, bad = store.store_or_keep((F.col("price") * F.col("qty")).cast("decimal(19,2)"), F.col("price"), parse("S9(6)V99"))
    return priced(spark, d).select("l_orderkey", "l_linenumber", bad.alias("overflow"), scaled(new, 2).alias("kept"))


@query(f"SELECT l_orderkey, l_linenumber, (p * disc + 50) // 100 AS rounded_v, p * disc // 100 AS truncated_v FROM ({PRICED})")
def rounded(spark, d):
    x = (F.col("price") * F.col("disc")).cast("decimal(19,4)")
    pic = parse("S9(9)V99")
    return priced(spark, d).select("l_orderkey", "l_linenumber", scaled(store.store(store.rounded(x, 2), pic), 2).alias("rounded_v"), scaled(store.store(x, pic), 2).alias("truncated_v"))


@query(f"SELECT l_orderkey, l_linenumber, p * 10 // (q * 1) AS quotient, p * 10 - (p * 10 // q) * q AS remainder, CASE WHEN q % 5 = 0 THEN NULL ELSE p // (q % 5) END AS guarded FROM ({PRICED})")
def divide_remainder(spark, d):
    """DIVIDE GIVING REMAINDER; a zero divisor gives null (the target keeps its value)."""
    q = store.divided(F.col("price"), 2, F.col("qty"), 0, 3)
    rest = store.remainder(F.col("price").cast("decimal(20,3)"), F.col("qty"), q.cast("decimal(17,3)"))
    guarded = store.divided(F.col("price"), 2, (F.col("qty") % 5).cast("decimal(5,0)"), 0, 2)
    return priced(spark, d).select("l_orderkey", "l_linenumber", scaled(q.cast("decimal(20,3)"), 3).alias("quotient"), scaled(rest.cast("decimal(20,3)"), 3).alias("remainder"), scaled(guarded.cast("decimal(20,2)"), 2).alias("guarded"))


# Codecs ------------------------------------------------------------------------------------------------


def balances(spark, d) -> DataFrame:
    return t(spark, d, "customer").select("c_custkey", money("c_acctbal").alias("bal"))


BAL = f"SELECT c_custkey, {C.format('c_acctbal')} AS b FROM customer"
S9 = "S9(7)V99"


@query(f"SELECT c_custkey, CASE WHEN b < 0 THEN substr(z, 1, 8) || translate(substr(z, 9, 1), '0123456789', '}}JKLMNOPQR') ELSE substr(z, 1, 8) || translate(substr(z, 9, 1), '0123456789', '{{ABCDEFGHI') END AS encoded, b AS decoded FROM (SELECT c_custkey, b, lpad(CAST(abs(b) AS VARCHAR), 9, '0') AS z FROM ({BAL}))")
def zoned_roundtrip(spark, d):
    e = codecs.zoned_encode(F.col("bal"), parse(S9))
    return balances(spark, d).select("c_custkey", e.alias("encoded"), scaled(codecs.zoned_decode(e, 2).cast("decimal(20,2)"), 2).alias("decoded"))


@query(f"SELECT c_custkey, lpad(CAST(abs(b) AS VARCHAR), 9, '0') || CASE WHEN b < 0 THEN 'D' ELSE 'C' END AS encoded, b AS decoded FROM ({BAL})")
def comp3_roundtrip(spark, d):
    e = codecs.comp3_encode(F.col("bal"), parse(S9, "COMP-3"))
    return balances(spark, d).select("c_custkey", F.hex(e).alias("encoded"), scaled(codecs.comp3_decode(e, 2).cast("decimal(20,2)"), 2).alias("decoded"))


@query(f"SELECT c_custkey, lpad(upper(to_hex(CASE WHEN b < 0 THEN b + 4294967296 ELSE b END)), 8, '0') AS encoded, b AS decoded FROM ({BAL})")
def binary_roundtrip(spark, d):
    e = codecs.binary_encode(F.col("bal"), parse(S9, "COMP"))
    return balances(spark, d).select("c_custkey", F.hex(e).alias("encoded"), scaled(codecs.binary_decode(e, 4, 2).cast("decimal(20,2)"), 2).alias("decoded"))


@query("SELECT c_custkey, hex(CAST(CAST(c_acctbal AS BIT) AS BLOB)) AS encoded, TRUE AS same FROM customer")
def float_roundtrip(spark, d):
    """COMP-2 bytes and back."""
    e = codecs.float_encode(F.col("c_acctbal"))
    return t(spark, d, "customer").select("c_custkey", F.hex(e).alias("encoded"), (codecs.float_decode(e) == F.col("c_acctbal")).alias("same"))


@query(f"SELECT c_custkey, lpad(CAST(abs(b) AS VARCHAR), 9, '0') || CASE WHEN b < 0 THEN '-' ELSE '+' END AS trailing, CASE WHEN b < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(b) AS VARCHAR), 9, '0') AS leading, b % 10 = 0 AND abs(b) % 1000 // 10 = 0 AS blank FROM ({BAL})")
def display_numeric(spark, d):
    """DISPLAY forms: separate signs, blank when zero."""
    three = (F.abs(F.col("bal")) % dec(10)).cast("decimal(3,2)")
    blank = F.trim(codecs.to_display(three, parse("9(1)V99", blank_zero=True))) == ""
    return balances(spark, d).select("c_custkey", codecs.to_display(F.col("bal"), parse(S9, sign="TRAILING SEPARATE")).alias("trailing"), codecs.to_display(F.col("bal"), parse(S9, sign="LEADING SEPARATE")).alias("leading"), blank.alias("blank"))


@query(f"""WITH a AS (SELECT c_custkey, b, abs(b) // 100 AS w, lpad(CAST(abs(b) % 100 AS VARCHAR), 2, '0') AS f FROM ({BAL})), g AS (SELECT *, CASE WHEN w >= 1000 THEN (w // 1000) || ',' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') ELSE CAST(w AS VARCHAR) END AS n FROM a)
SELECT c_custkey, lpad(n, 9, ' ') || '.' || f || CASE WHEN b < 0 THEN '-' ELSE ' ' END AS suppressed, lpad('$' || n, 10, ' ') || '.' || f || CASE WHEN b < 0 THEN 'CR' ELSE '  ' END AS floating, lpad(CAST(w AS VARCHAR), 7, '*') || '.' || f AS starred FROM g""")
def edited_display(spark, d):
    """Zero suppression, a floating currency sign, check protection."""
    e = lambda p: edited.edited(F.col("bal"), parse(p))
    return balances(spark, d).select("c_custkey", e("Z,ZZZ,ZZ9.99-").alias("suppressed"), e("$$,$$$,$$9.99CR").alias("floating"), e("******9.99").alias("starred"))


@query(f"SELECT c_custkey, b AS value FROM ({BAL})")
def edited_extract(spark, d):
    """The number in an edited text."""
    e = edited.edited(F.col("bal"), parse("$$,$$$,$$9.99CR"))
    return balances(spark, d).select("c_custkey", scaled(codecs.numeric_of_edited(e, 2), 2).alias("value"))


LAYOUT = layouts.Layout("customers", (layouts.Field("id", 0, 10, "integer"), layouts.Field("name", 10, 20), layouts.Field("bal", 30, 6, "comp3", 2, True), layouts.Field("zon", 36, 9, "decimal", 2, True, True), layouts.Field("bin", 45, 4, "comp", 2)), 49, "cp037")


@query(f"SELECT c_custkey AS record, c_custkey AS id, c_name AS name, {C.format('c_acctbal')} AS bal, {C.format('c_acctbal')} AS zon, {C.format('c_acctbal')} AS bin, CAST(0 AS BIGINT) AS abends FROM customer")
def fixed_width_scan(spark, d):
    """EBCDIC records with packed, zoned and binary fields, written and decoded by one layout."""
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("_rec"), F.col("c_custkey").cast("decimal(10,0)").alias("id"), F.col("c_name").alias("name"), money("c_acctbal").alias("bal"), money("c_acctbal").alias("zon"), money("c_acctbal").alias("bin"))
    out = layouts.decoded(layouts.encoded(rows, LAYOUT), LAYOUT)
    return out.select(F.col("_rec").alias("record"), F.col("id").cast("bigint"), "name", *(scaled(F.col(c).cast("decimal(20,2)"), 2).alias(c) for c in ("bal", "zon", "bin")), F.size("_abends").cast("bigint").alias("abends"))


@query("""SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN event_id * 100 WHEN 1 THEN 0 WHEN 2 THEN 99999 WHEN 3 THEN NULL WHEN 4 THEN -(event_id % 1000) ELSE 100 * 70 END AS value, event_id % 6 = 3 AS abend FROM events""")
def validate_numeric(spark, d):
    """Numeric fields as read: plain, blank, all x'FF', letters, overpunched, with zero bytes."""
    i = F.col("event_id")
    k = i % 6
    zoned = codecs.zoned_encode((-(i % 1000)).cast("decimal(5,0)") * dec("0.01"), parse("S999V99"))
    text = F.when(k == 0, i.cast("string")).when(k == 1, F.lit("     ")).when(k == 2, F.lit("ÿÿÿÿÿ")).when(k == 3, F.concat(F.lit("1X"), i.cast("string"))).when(k == 4, zoned).otherwise(F.lit("␀␀07␀"))
    v = codecs.validated(text, parse("S999V99"))
    return t(spark, d, "events").select("event_id", scaled(v["value"].cast("decimal(20,2)"), 2).alias("value"), (v["abend"] == "S0C7").eqNullSafe(True).alias("abend"))


# EBCDIC and sorting ------------------------------------------------------------------------------------

ASCII = "".join(chr(c) for c in range(32, 127))
#: Characters in code page order, each by a letter-free key for SQL: its rank as two characters.
RANKED = "".join(sorted(ASCII, key=lambda c: c.encode("cp037")))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ebc(x: str) -> str:
    """SQL that orders as code page 037 does."""
    return f"translate({x}, {_sql_text(RANKED)}, {_sql_text(''.join(chr(0x100 + k) for k in range(len(RANKED))))})"


@query(f"SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY {ebc('p_name')} DESC, p_partkey) AS rank FROM part")
def ebcdic_sort(spark, d):
    rows = t(spark, d, "part").withColumn("_rec", F.col("p_partkey"))
    return sorting.ranked(rows, [("p_name", False)], ["p_size"]).select("p_partkey", F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT p_partkey, CAST(CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS INTEGER) AS cmp FROM (SELECT p_partkey, {ebc('rpad(p_brand, 30, chr(32))')} AS a, {ebc('rpad(lower(p_type), 30, chr(32))')} AS b FROM part)")
def ebcdic_compare(spark, d):
    return t(spark, d, "part").select("p_partkey", ebcdic.compared(F.col("p_brand"), F.lower("p_type")).alias("cmp"))


@query("SELECT n_nationkey, n_name AS decoded, n_name = n_name AS cp500_same, n_name AS cp1047 FROM nation")
def ebcdic_decode(spark, d):
    n = F.col("n_name")
    return t(spark, d, "nation").select("n_nationkey", ebcdic.decode(ebcdic.encode(n)).alias("decoded"), (ebcdic.decode(ebcdic.encode(n, "cp500"), "cp500") == n).alias("cp500_same"), ebcdic.decode(ebcdic.encode(n, "cp1047"), "cp1047").alias("cp1047"))


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY substr(o_orderpriority, 1, 1), {C.format('o_totalprice')} DESC, o_orderkey) AS rank FROM orders")
def sort_multi_key(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("pri"), cents("o_totalprice").alias("price"), F.col("o_orderkey").alias("_rec"))
    return sorting.ranked(rows, [("pri", True), ("price", False)], ["o_custkey"]).select("o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("""WITH u AS (SELECT 0 AS f, s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT 1, c_custkey, c_name FROM customer)
SELECT f, k, name, row_number() OVER (ORDER BY k DESC, f, k) AS rank FROM u""")
def merge_files(spark, d):
    """MERGE of two files; the range-partitioned order is numbered without one task holding it all."""
    a = t(spark, d, "supplier").select(F.lit(0).alias("f"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("_rec"))
    b = t(spark, d, "customer").select(F.lit(1).alias("f"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_custkey").alias("_rec"))
    return dense(sorting.merge([a, b], [("k", False)])).select("f", "k", "name", "rank")


def dense(ordered: DataFrame) -> DataFrame:
    """``rank``: the position of each row of a sorted frame, by counts of its partitions."""
    from tallyframe.sources.records import positions

    return positions(ordered, "rank", 1)


@query(f"SELECT o_orderkey, p + 100 AS price, row_number() OVER (ORDER BY p + 100, o_orderkey) AS rank FROM (SELECT o_orderkey, {C.format('o_totalprice')} AS p FROM orders WHERE o_orderstatus = 'F')")
def release_return(spark, d):
    """SORT with an INPUT PROCEDURE that filters and changes, and an OUTPUT PROCEDURE that numbers."""
    rows = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", cents("o_totalprice").alias("price"), F.col("o_orderkey").alias("_rec"))
    out = sorting.sort(rows, [("price", True)], input_procedure=lambda x: x.where("o_orderstatus = 'F'").withColumn("price", F.col("price") + 100), output_procedure=dense)
    return out.select("o_orderkey", "price", "rank")


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, {C.format('l_extendedprice')} AS p, CAST(l_quantity AS BIGINT) AS q FROM lineitem), s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, l_linenumber) AS r FROM a)
SELECT l_orderkey, string_agg(CAST(p AS VARCHAR), ',' ORDER BY r) AS prices, string_agg(CAST(q AS VARCHAR), ',' ORDER BY r) AS quantities FROM s GROUP BY l_orderkey""")
def table_sort(spark, d):
    """SORT of an OCCURS table permutes its sibling arrays."""
    a = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", cents("l_extendedprice").alias("p"), F.col("l_quantity").cast("bigint").alias("q")))).alias("x"))
    s = a.withColumn("s", sorting.sort_table([F.transform("x", lambda e: e["p"]), F.transform("x", lambda e: e["q"])], False))
    text = lambda k: F.array_join(F.transform("s", lambda e: e[k].cast("string")), ",")
    return s.select("l_orderkey", text("t0").alias("prices"), text("t1").alias("quantities"))


@query("""WITH a AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i FROM lineitem)
SELECT l_orderkey, CAST(coalesce(min(i) FILTER (WHERE q > 30), 0) AS INTEGER) AS first_large, CAST(coalesce(min(i) FILTER (WHERE q = 7), 0) AS INTEGER) AS first_seven FROM a GROUP BY l_orderkey""")
def table_search(spark, d):
    a = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("bigint").alias("q")))).alias("x"))
    q = F.transform("x", lambda e: e["q"])
    return a.select("l_orderkey", sorting.search(q, lambda e: e > 30).alias("first_large"), sorting.search_all(q, F.lit(7).cast("bigint")).alias("first_seven"))


# Predicates --------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS is_known, substr(o_orderpriority, 1, 1) BETWEEN '1' AND '2' AS is_urgent, NOT (o_orderstatus = 'P') AS not_pending FROM orders")
def condition_names(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t(spark, d, "orders").select("o_orderkey", predicates.named(s, ["F", "O"], True).alias("is_known"), predicates.named(F.substring(p, 1, 1), [("1", "2")], True).alias("is_urgent"), (~predicates.named(s, ["P"], True)).alias("not_pending"))


@query(f"SELECT o_orderkey, CASE WHEN p < 5000000 OR o_orderstatus = 'P' THEN 'LOW' WHEN p BETWEEN 5000000 AND 20000000 THEN 'MID' ELSE 'HIGH' END AS band FROM (SELECT *, {C.format('o_totalprice')} AS p FROM orders)")
def evaluate_true(spark, d):
    p = cents("o_totalprice")
    band = predicates.evaluate([([p < 5000000, predicates.named(F.col("o_orderstatus"), ["P"], True)], F.lit("LOW")), ([predicates.named(p, [(5000000, 20000000)])], F.lit("MID"))], F.lit("HIGH"))
    return t(spark, d, "orders").select("o_orderkey", band.alias("band"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'C' WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'V0' WHEN event_id % 3 = 1 THEN 'ANY1' ELSE '-' END AS code FROM events")
def evaluate_also(spark, d):
    e, i = F.col("event_type"), F.col("event_id")
    code = predicates.evaluate_also([([e == "click", None], F.lit("C")), ([e == "view", i % 2 == 0], F.lit("V0")), ([None, i % 3 == 1], F.lit("ANY1"))], F.lit("-"))
    return t(spark, d, "events").select("event_id", code.alias("code"))


@query("SELECT p_partkey, regexp_full_match(replace(p_name, ' ', ''), '[A-Za-z]*') AS alphabetic, regexp_full_match(replace(p_name, ' ', ''), '[a-z]*') AS lower_case, regexp_full_match(replace(upper(p_name), ' ', ''), '[A-Z]*') AS upper_case, TRUE AS numeric_key FROM part")
def class_tests(spark, d):
    n = F.col("p_name")
    return t(spark, d, "part").select("p_partkey", predicates.is_class(n, "ALPHABETIC").alias("alphabetic"), predicates.is_class(n, "ALPHABETIC-LOWER").alias("lower_case"), predicates.is_class(F.upper(n), "ALPHABETIC-UPPER").alias("upper_case"), predicates.is_class(F.col("p_partkey").cast("string"), "NUMERIC").alias("numeric_key"))


# Strings -----------------------------------------------------------------------------------------------


@query("SELECT p_partkey, substr(p_name, 3, 4) AS part_of, substr(rpad(p_name, 20, ' '), 1, 4) || 'XY ' || substr(rpad(p_name, 20, ' '), 8) AS changed FROM part")
def refmod(spark, d):
    n = F.col("p_name")
    return t(spark, d, "part").select("p_partkey", strings.refmod(n, 3, 4).alias("part_of"), strings.refmod_set(F.rpad(n, 20, " "), F.lit("XY"), 5, 3).alias("changed"))


@query("SELECT p_partkey, rpad(substr(split_part(p_name, ' ', 1) || '/' || p_brand, 1, 24), 24, '-') AS target, CAST(1 + least(length(split_part(p_name, ' ', 1) || '/' || p_brand), 24) AS INTEGER) AS pointer, length(split_part(p_name, ' ', 1) || '/' || p_brand) > 24 AS overflow FROM part")
def string_concat(spark, d):
    out, at, over = strings.string([(F.col("p_name"), "SPACE"), (F.lit("/"), None), (F.col("p_brand"), None)], F.lit("-" * 24), 24)
    return t(spark, d, "part").select("p_partkey", out.alias("target"), at.cast("int").alias("pointer"), over.alias("overflow"))


@query("""WITH s AS (SELECT p_partkey, regexp_split_to_array(p_type || '#' || p_brand, ' +|#') AS a FROM part)
SELECT p_partkey, a[1] AS f1, a[2] AS f2, a[3] AS f3, CAST(least(len(a), 3) AS INTEGER) AS filled, CAST(length(a[1]) AS INTEGER) AS c1 FROM s""")
def unstring(spark, d):
    source, by = F.concat("p_type", F.lit("#"), "p_brand"), [(" ", True), ("#", False)]
    f = strings.unstring(source, by, 3)
    return t(spark, d, "part").select("p_partkey", *(f[k]["text"].alias(f"f{k + 1}") for k in range(3)), strings.unstring_tally(source, by, 3).cast("int").alias("filled"), f[0]["count"].cast("int").alias("c1"))


@query("""SELECT doc_id, CAST(length(text) - length(replace(text, 'th', '')) AS INTEGER) // 2 AS all_th, CAST(length(CASE WHEN strpos(text, '.') > 0 THEN substr(text, 1, strpos(text, '.') - 1) ELSE text END) AS INTEGER) AS before_point FROM documents""")
def inspect_tally(spark, d):
    x = F.col("text")
    return t(spark, d, "documents").select("doc_id", strings.tally(x, "ALL", "th").alias("all_th"), strings.tally(x, "CHARACTERS", before=".").cast("int").alias("before_point"))


@query("""SELECT p_partkey, replace(p_name, 'e', '3') AS all_e, CASE WHEN strpos(p_name, 'a') > 0 THEN substr(p_name, 1, strpos(p_name, 'a') - 1) || 'A' || substr(p_name, strpos(p_name, 'a') + 1) ELSE p_name END AS first_a, repeat('0', length(lpad(CAST(p_size AS VARCHAR), 4, '0')) - length(ltrim(lpad(CAST(p_size AS VARCHAR), 4, '0'), '0'))) || 'x' AS zeros FROM part""")
def inspect_replace(spark, d):
    n = F.col("p_name")
    z = F.lpad(F.col("p_size").cast("string"), 4, "0")
    run = strings.replacing(z, "LEADING", "0", "*")
    return t(spark, d, "part").select("p_partkey", strings.replacing(n, "ALL", "e", "3").alias("all_e"), strings.replacing(n, "FIRST", "a", "A").alias("first_a"), F.concat(F.translate(F.regexp_extract(run, r"^(\**)", 1), "*", "0"), F.lit("x")).alias("zeros"))


@query("SELECT n_nationkey, translate(n_name, 'AEIOU', '12345') AS vowels, CASE WHEN strpos(n_name, ' ') > 0 THEN translate(substr(n_name, 1, strpos(n_name, ' ') - 1), 'AB', 'xy') || substr(n_name, strpos(n_name, ' ')) ELSE translate(n_name, 'AB', 'xy') END AS first_word FROM nation")
def inspect_convert(spark, d):
    n = F.col("n_name")
    return t(spark, d, "nation").select("n_nationkey", strings.converting(n, "AEIOU", "12345").alias("vowels"), strings.converting(n, "AB", "xy", before=" ").alias("first_word"))


@query(f"SELECT c_custkey, CASE WHEN b < 0 THEN -(-b // 100) ELSE b // 100 END AS int_part, abs(b) AS absolute, b % 700 AS modulo, greatest(b, 0, 12345) AS most, least(b, 0) AS least_v, reverse(c_name) AS reversed, ascii(c_name) AS code, upper(c_name) AS up FROM (SELECT *, {C.format('c_acctbal')} AS b FROM customer)")
def intrinsics(spark, d):
    x, n = money("c_acctbal"), F.col("c_name")
    k = lambda c: scaled(c.cast("decimal(20,2)"), 2)
    return t(spark, d, "customer").select("c_custkey", strings.integer(x).cast("bigint").alias("int_part"), k(F.abs(x)).alias("absolute"), k(strings.mod(x, dec(7))).alias("modulo"), k(strings.maximum(x, dec("0.00").cast("decimal(13,2)"), dec("123.45").cast("decimal(13,2)"))).alias("most"), k(strings.minimum(x, dec("0.00").cast("decimal(13,2)"))).alias("least_v"), strings.reverse(n).alias("reversed"), strings.ord_(n).alias("code"), F.upper(n).alias("up"))


# Files -------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name AS name, CASE WHEN c_custkey IS NULL THEN '23' ELSE '00' END AS status FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey")
def read_by_key(spark, d):
    file = t(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_custkey").alias("_rec"))
    return files.read_by_key(t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), file, "k").select("o_orderkey", "name", "status")


@query("""WITH f AS (SELECT p_partkey AS rec, p_brand FROM part), s AS (SELECT min(rec) AS pos FROM f WHERE p_brand >= 'Brand#3')
SELECT rec, p_brand, CASE WHEN rec = (SELECT max(rec) FROM f) THEN '10' ELSE '00' END AS next_status FROM f, s WHERE rec >= pos""")
def start_read_next(spark, d):
    file = t(spark, d, "part").select(F.col("p_partkey").alias("_rec"), "p_brand")
    return files.read_next(file, files.start(file, F.col("p_brand") >= "Brand#3")).select(F.col("_rec").alias("rec"), "p_brand", "next_status")


@query("""WITH f AS (SELECT c_custkey AS slot, c_name AS old FROM customer WHERE c_custkey % 4 > 0), r AS (SELECT c_custkey AS slot, c_mktsegment AS new, CASE c_custkey % 3 WHEN 0 THEN 'WRITE' WHEN 1 THEN 'REWRITE' ELSE 'DELETE' END AS verb FROM customer WHERE c_custkey % 5 < 3)
SELECT coalesce(f.slot, r.slot) AS slot, verb, CASE WHEN verb = 'WRITE' AND f.slot IS NULL THEN new WHEN verb = 'REWRITE' AND f.slot IS NOT NULL THEN new WHEN verb = 'DELETE' AND f.slot IS NOT NULL THEN NULL ELSE old END AS data,
  CASE WHEN verb IS NULL THEN NULL WHEN verb = 'WRITE' AND f.slot IS NOT NULL THEN '22' WHEN verb <> 'WRITE' AND f.slot IS NULL THEN '23' ELSE '00' END AS status FROM f FULL JOIN r ON f.slot = r.slot""")
def relative_merge(spark, d):
    c = t(spark, d, "customer")
    file = c.where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("slot"), F.col("c_name").alias("data"))
    verb = F.when(F.col("c_custkey") % 3 == 0, "WRITE").when(F.col("c_custkey") % 3 == 1, "REWRITE").otherwise("DELETE")
    return files.relative(file, c.where("c_custkey % 5 < 3").select(F.col("c_custkey").alias("slot"), verb.alias("verb"), F.col("c_mktsegment").alias("data")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'REWRITTEN' ELSE c_mktsegment END AS seg FROM customer")
def rewrite(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    return files.rewrite(c, c.where("c_custkey % 7 = 0").select("c_custkey", F.lit("REWRITTEN").alias("seg")), "c_custkey")


@query("SELECT p_partkey AS rec, p_name FROM part WHERE NOT (p_size > 40)")
def delete_current(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("_rec"), "p_name", "p_size")
    return files.delete(p, p.where("p_size > 40")).select(F.col("_rec").alias("rec"), "p_name")


@query("SELECT p_partkey AS rec, rpad(substr(p_name, 1, 12), 12, ' ') || rpad(CAST(p_size AS VARCHAR), 4, ' ') AS line, chr(10) || rpad(substr(p_name, 1, 12), 12, ' ') || rpad(CAST(p_size AS VARCHAR), 4, ' ') AS advanced FROM part")
def write_records(spark, d):
    out = files.write_records(t(spark, d, "part").withColumn("_rec", F.col("p_partkey")), [("p_name", 12), ("p_size", 4)])
    return out.select(F.col("_rec").alias("rec"), "line", files.advancing(F.col("line"), 1).alias("advanced"))


@query("""WITH g AS (SELECT o_orderkey, rpad(o_orderstatus, 2, ' ') || rpad(o_orderpriority, 15, ' ') || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS x FROM orders)
SELECT o_orderkey, x AS group_text, substr(x, 1, 5) AS b1, substr(x, 6, 12) AS b2, CAST(substr(x, 18, 8) AS BIGINT) AS b3 FROM g""")
def group_move(spark, d):
    x = strings.group_text([(F.col("o_orderstatus"), 2), (F.col("o_orderpriority"), 15), (F.lpad(F.col("o_custkey").cast("string"), 8, "0"), 8)])
    b = strings.group_slices(x, [5, 12, 8])
    return t(spark, d, "orders").select("o_orderkey", x.alias("group_text"), b[0].alias("b1"), b[1].alias("b2"), b[2].cast("bigint").alias("b3"))


OVERLAY = """
       01 REC.
          05 KEY-N    PIC 9(8).
          05 PARTS REDEFINES KEY-N.
             10 HIGH-N PIC 9(4).
             10 LOW-N  PIC 9(4).
          05 AMT      PIC S9(7)V99 COMP-3.
"""


@query(f"""WITH a AS (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS k, {C.format('o_totalprice')} AS p FROM orders)
SELECT o_orderkey, CAST(substr(k, 1, 4) AS BIGINT) AS high_n, CAST(substr(k, 5, 4) AS BIGINT) AS low_n, p AS amt, CAST(substr(k, 1, 4) || '0042' AS BIGINT) AS changed, CAST(13 AS INTEGER) AS bytes FROM a""")
def redefines_view(spark, d):
    """Overlapping fields are slices of one binary region; a store into one shows in the other."""
    [rec] = layouts.parse_copybook(OVERLAY)
    key, parts, amt = rec.children
    region = F.concat(F.encode(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), "ISO-8859-1"), codecs.comp3_encode(money("o_totalprice"), amt.pic))
    x = t(spark, d, "orders").select("o_orderkey", region.alias("r"))
    n = lambda item, r="r": layouts.view(F.col(r), item).cast("bigint")
    x = x.withColumn("r2", layouts.put(F.col("r"), parts.children[1], dec(42).cast("decimal(4,0)")))
    return x.select("o_orderkey", n(parts.children[0]).alias("high_n"), n(parts.children[1]).alias("low_n"), scaled(layouts.view(F.col("r"), amt).cast("decimal(20,2)"), 2).alias("amt"), n(key, "r2").alias("changed"), F.octet_length("r2").alias("bytes"))


@query(f"SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS moved_q, 7 AS moved_z, CAST(l_quantity AS BIGINT) + 100 AS added_q FROM lineitem")
def corresponding(spark, d):
    """MOVE and ADD CORRESPONDING between groups of some common names."""
    q = F.col("l_quantity").cast("bigint")
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct(q.alias("q"), F.lit(1).alias("only_a")).alias("a"), F.struct(F.lit(100).cast("bigint").alias("q"), F.lit(7).alias("z")).alias("b"))
    return _corresponding(x)


def _corresponding(x: DataFrame) -> DataFrame:
    moved = sorting.move_corresponding(x, "a", "b").select("l_orderkey", "l_linenumber", "a", F.col("b").alias("m"), F.struct(F.lit(100).cast("bigint").alias("q"), F.lit(7).alias("z")).alias("b"))
    both = sorting.add_corresponding(moved, "a", "b")
    return both.select("l_orderkey", "l_linenumber", F.col("m.q").alias("moved_q"), F.col("m.z").alias("moved_z"), F.col("b.q").alias("added_q"))


@query(f"SELECT o_custkey, o_orderkey, CAST(sum({C.format('o_totalprice')}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS running FROM orders")
def running_total(spark, d):
    """An accumulator across records that never truncates is a window."""
    return t(spark, d, "orders").select("o_custkey", "o_orderkey", F.sum(cents("o_totalprice")).over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("running"))


@query("SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) % 100 AS truncated_total FROM lineitem GROUP BY l_orderkey")
def accumulate_truncating(spark, d):
    """ADD in a loop over an OCCURS table, each sum stored into two digits."""
    a = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("bigint").alias("q")))).alias("x"))
    return a.select("l_orderkey", F.aggregate("x", F.lit(0).cast("bigint"), lambda s, e: (s + e["q"]) % 100).alias("truncated_total"))


# Portfolio ---------------------------------------------------------------------------------------------


def sources(spark) -> DataFrame:
    return spark.createDataFrame(list(fixtures.PORTFOLIO.items()), "name string, source string")


def tables(spark):
    return lang.portfolio(spark, sources(spark))


DEAD = """WITH RECURSIVE p(program, name, idx) AS (VALUES ('MAINPAY','M-START',0),('MAINPAY','M-CALC',1),('MAINPAY','M-CALC-MID',2),('MAINPAY','M-CALC-END',3),('MAINPAY','M-OLD',4),('MAINPAY','M-END',5),
 ('TAXLIB','T-MAIN',0),('TAXLIB','T-A',1),('TAXLIB','T-B',2),('TAXLIB','T-DEAD',3),('AUDITLG','A-MAIN',0),('ROUNDER','R-MAIN',0),('ROUNDER','R-LOOP',1)),
e(program, src, dst) AS (VALUES ('MAINPAY','M-START','M-CALC'),('MAINPAY','M-START','M-END'),('MAINPAY','M-CALC','M-CALC-MID'),('MAINPAY','M-CALC-MID','M-CALC-END'),('MAINPAY','M-OLD','M-END'),
 ('TAXLIB','T-MAIN','T-A'),('TAXLIB','T-MAIN','T-B'),('ROUNDER','R-MAIN','R-LOOP'),('ROUNDER','R-LOOP','R-LOOP')),
r(program, name) AS (SELECT program, name FROM p WHERE idx = 0 UNION SELECT e.program, e.dst FROM r JOIN e ON e.program = r.program AND e.src = r.name)"""


@query(f"{DEAD} SELECT program, name, EXISTS (SELECT 1 FROM r WHERE r.program = p.program AND r.name = p.name) AS reachable FROM p")
def dead_code(spark, d):
    tb = tables(spark)
    return portfolio.dead_code(tb("paragraphs"), tb("edges")).select("program", "name", "reachable")


@query(f"{DEAD}, q AS (SELECT p.program, r.name IS NOT NULL AS ok FROM p LEFT JOIN r ON r.program = p.program AND r.name = p.name) SELECT program, count(*) AS total_paragraphs, count(*) FILTER (WHERE ok) AS reachable_paragraphs, CAST(round(count(*) FILTER (WHERE NOT ok) * 1000.0 / count(*)) AS BIGINT) AS dead_permille FROM q GROUP BY program")
def dead_code_summary(spark, d):
    tb = tables(spark)
    out = portfolio.dead_summary(portfolio.dead_code(tb("paragraphs"), tb("edges")))
    return out.select("program", "total_paragraphs", "reachable_paragraphs", F.round(F.col("dead_percentage") * 10).cast("bigint").alias("dead_permille"))


@query("SELECT 'ROUNDER' AS program, 'R-LOOP' AS name")
def perform_cycles(spark, d):
    return portfolio.perform_cycles(tables(spark)("edges"))


CALLS = "WITH c(program, target) AS (VALUES ('MAINPAY','TAXLIB'),('MAINPAY','AUDITLG'),('TAXLIB','ROUNDER'),('AUDITLG','MISSING1')), p(program) AS (VALUES ('MAINPAY'),('TAXLIB'),('AUDITLG'),('ROUNDER'))"


@query(f"{CALLS} SELECT p.program, coalesce((SELECT string_agg(c.program, ',' ORDER BY c.program) FROM c WHERE c.target = p.program), '') AS called_by, NOT EXISTS (SELECT 1 FROM c WHERE c.target = p.program) AS root, coalesce((SELECT string_agg(target, ',' ORDER BY target) FROM c WHERE c.program = p.program AND target NOT IN (SELECT program FROM p)), '') AS unresolved FROM p")
def call_graph(spark, d):
    p = tables(spark)("programs").select("program", "source").cache()
    c = portfolio.calls(p)
    roots = portfolio.call_roots(c, p).withColumn("root", F.lit(True))
    missing = portfolio.unresolved(c, p).groupBy("program").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("unresolved"))
    out = p.join(portfolio.called_by(c), "program", "left").join(roots, "program", "left").join(missing, "program", "left")
    return out.select("program", F.coalesce(F.array_join("called_by", ","), F.lit("")).alias("called_by"), F.coalesce("root", F.lit(False)).alias("root"), F.coalesce("unresolved", F.lit("")).alias("unresolved"))


@query("SELECT * FROM (VALUES ('AUDITLG', 0, 1), ('ROUNDER', 0, 2), ('TAXLIB', 1, 3), ('MAINPAY', 2, 4)) v(program, depth, position)")
def topo_order(spark, d):
    p = tables(spark)("programs").select("program", "source").cache()
    return portfolio.topological(portfolio.calls(p), p)


@query("SELECT * FROM (VALUES ('MAINPAY','TAXLIB',0,'AMT','L-AMT','MATCHED'),('MAINPAY','TAXLIB',1,'NET',NULL,'UNMATCHED'),('MAINPAY','AUDITLG',0,'NET',NULL,'UNMATCHED'),('TAXLIB','ROUNDER',0,'T',NULL,'UNMATCHED')) v(program, target, position, argument, parameter, status)")
def call_parameters(spark, d):
    tb = tables(spark)
    return portfolio.parameters(portfolio.calls(tb("programs")), tb("linkage"))


@query("SELECT * FROM (VALUES ('MAINPAY','tainted','AMT','EXEC SQL SELECT'),('MAINPAY','used','CNT','EXEC SQL SELECT'),('MAINPAY','used','NET','EXEC SQL UPDATE'),('MAINPAY','control','WS-SQLCODE','DECLARED')) v(program, class, var, source)")
def taint(spark, d):
    tb = tables(spark)
    return portfolio.taint(portfolio.host_variables(tb("blocks")), tb("variables"))


@query("""WITH c AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'SQLCODE NOT = 0' WHEN 1 THEN 'WS-SQLCODE = 100' WHEN 2 THEN 'SQLCODE < 0' WHEN 3 THEN 'SQLCODE = 0' WHEN 4 THEN 'SQLCODE > 0' WHEN 5 THEN 'SQLSTATE = X' ELSE 'A = 0' END AS c FROM events)
SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'not_found' WHEN 2 THEN 'severe' WHEN 3 THEN 'success' WHEN 4 THEN 'warning' WHEN 5 THEN 'unknown' END AS branch FROM c""")
def sqlcode_branches(spark, d):
    k = (F.col("event_id") % 7).cast("int") + 1
    c = F.element_at(F.array(*map(F.lit, ["SQLCODE NOT = 0", "WS-SQLCODE = 100", "SQLCODE < 0", "SQLCODE = 0", "SQLCODE > 0", "SQLSTATE = X", "A = 0"])), k)
    return t(spark, d, "events").select("event_id", portfolio.sqlcode_branch(c)["branch"].alias("branch"))


@query("SELECT * FROM (VALUES ('MAINPAY', 3, 3, 1, 'ARITH not specified: default COMPAT; NUMPROC not specified: default NOPFD', 'Defaulting: ARITH=COMPAT, NUMPROC=NOPFD. Confirm.')) v(program, comp3, comp, mul_div, warnings, recommendation)")
def compiler_matrix(spark, d):
    tb = tables(spark)
    out = portfolio.compiler_matrix(tb("programs").where("program = 'MAINPAY'").drop("source", "lines"), tb("variables"), tb("statements"))
    return out.select("program", F.col("comp3").cast("int").alias("comp3"), F.col("comp").cast("int").alias("comp"), F.col("mul_div").cast("int").alias("mul_div"), F.array_join("warnings", "; ").alias("warnings"), "recommendation")


@query("""WITH s AS (SELECT p_partkey AS k, p_size AS n FROM part), x AS (SELECT 'P' || k AS program, n * 12 AS lines, CAST(k % 29 = 0 AS INT) AS alters, CASE WHEN k % 11 = 0 THEN n % 5 ELSE 0 END AS exec_sql, k % 3 AS copy_issues, n % 14 AS gotos, n % 13 AS categories, n % 4 AS redefines, n AS comp3, n % 30 AS performs FROM s)
SELECT program, CASE WHEN alters + exec_sql > 0 THEN 'red' WHEN copy_issues > 0 OR gotos > 10 OR lines > 500 THEN 'yellow' ELSE 'green' END AS status,
 CAST(round_even(least(20, CAST(lines AS DECIMAL(10,4)) / 25) + least(15, categories * 1.5) + least(10, copy_issues * 2) + least(20, exec_sql * 5) + least(10, gotos * 2) + least(10, redefines * 3) + least(10, comp3) + least(5, performs / 4), 0) AS INTEGER) AS complexity,
 concat_ws('; ', CASE WHEN alters > 0 THEN 'ALTER (1)' END, CASE WHEN exec_sql > 0 THEN 'EXEC SQL (' || exec_sql || ' blocks)' END, CASE WHEN copy_issues > 0 THEN 'Unresolved copybooks (' || copy_issues || ')' END, CASE WHEN gotos > 10 THEN 'GO TO count (' || gotos || ')' END, CASE WHEN lines > 500 THEN 'Large program (' || lines || ' lines)' END) AS risk_factors FROM x""")
def risk_heatmap(spark, d):
    return portfolio.heatmap(heat_input(spark, d)).select("program", "status", "complexity", "risk_factors")


def heat_input(spark, d) -> DataFrame:
    k, n, zero = F.col("p_partkey"), F.col("p_size"), F.lit(0)
    return t(spark, d, "part").select(
        F.concat(F.lit("P"), k.cast("string")).alias("program"), (n * 12).alias("lines"), (k % 29 == 0).cast("int").alias("alters"), F.when(k % 11 == 0, n % 5).otherwise(0).alias("exec_sql"), zero.alias("exec_cics"), zero.alias("odo"), zero.alias("large_occurs"),
        (k % 3).cast("int").alias("copy_issues"), (n % 14).alias("gotos"), (n % 13).alias("categories"), (n % 4).alias("redefines"), n.alias("comp3"), (n % 30).alias("performs"),
    )


@query("""WITH x AS (SELECT CASE WHEN p_partkey % 29 = 0 OR (p_partkey % 11 = 0 AND p_size % 5 > 0) THEN 'red' WHEN p_partkey % 3 > 0 OR p_size % 14 > 10 OR p_size * 12 > 500 THEN 'yellow' ELSE 'green' END AS s FROM part), c AS (SELECT count(*) AS total, count(*) FILTER (WHERE s = 'green') AS green, count(*) FILTER (WHERE s = 'yellow') AS yellow, count(*) FILTER (WHERE s = 'red') AS red FROM x)
SELECT *, CASE WHEN green * 100.0 / total >= 90 THEN CAST(floor(green * 100.0 / total - 5) AS BIGINT) || '-' || CAST(floor(green * 100.0 / total) AS BIGINT) WHEN green * 100.0 / total >= 70 THEN CAST(floor(green * 100.0 / total - 10) AS BIGINT) || '-' || CAST(floor(green * 100.0 / total - 5) AS BIGINT) ELSE CAST(floor(green * 100.0 / total - 15) AS BIGINT) || '-' || CAST(floor(green * 100.0 / total - 10) AS BIGINT) END || '%' AS predicted FROM c""")
def risk_heatmap_summary(spark, d):
    return portfolio.heatmap_summary(portfolio.heatmap(heat_input(spark, d)))


@query("SELECT * FROM (VALUES ('MAINPAY','NET','+',6,4,'WARN'),('MAINPAY','BIGGER','*',8,6,'SAFE'),('MAINPAY','CNT','/',NULL,NULL,'CRITICAL'),('TAXLIB','T','=',5,2,'SAFE')) v(program, target, op, result_int, result_dec, status)")
def arith_risk(spark, d):
    tb = tables(spark)
    out = portfolio.arithmetic_risk(tb("computes"), tb("variables").select("program", "name", "int_digits", "dec_digits"))
    return out.select("program", "target", "op", "result_int", "result_dec", "status")


@query("SELECT * FROM (VALUES ('MAINPAY', 3, 1, 1, 1), ('TAXLIB', 1, 1, 0, 0)) v(program, total, safe, warn, critical)")
def arith_risk_counts(spark, d):
    tb = tables(spark)
    out = portfolio.risk_counts(portfolio.arithmetic_risk(tb("computes"), tb("variables").select("program", "name", "int_digits", "dec_digits")))
    return out.select("program", *(F.col(c).cast("int").alias(c) for c in ("total", "safe", "warn", "critical")))


@query("SELECT * FROM (VALUES ('MAINPAY',1,3,0,1,2,1),('TAXLIB',2,1,1,2,1,0),('AUDITLG',0,0,0,0,1,0),('ROUNDER',2,0,1,0,0,0)) v(program, performs, computes, ifs, moves, calls, gotos)")
def statement_counts(spark, d):
    out = portfolio.statement_counts(tables(spark)("statements"))
    n = lambda c: F.col(f"`{c}`").cast("int")
    return out.select("program", n("PERFORM").alias("performs"), n("COMPUTE").alias("computes"), n("IF").alias("ifs"), n("MOVE").alias("moves"), n("CALL").alias("calls"), n("GO TO").alias("gotos"))


JOB_FLOW = "SELECT * FROM (VALUES ('NIGHTLY','EXTRACT','SORTIT','sequential'),('NIGHTLY','SORTIT','REPORT','sequential'),('NIGHTLY','EXTRACT','REPORT','dataset')) v(job, src, dst, kind)"


@query(JOB_FLOW)
def jcl_flow(spark, d):
    return jobs.dependencies(*jobs.tables(spark, spark.createDataFrame([("n", fixtures.JOB)], "name string, text string")))


@query("SELECT * FROM (VALUES ('NIGHTLY','PROD.EXTRACT','EXTRACT,SORTIT,REPORT'),('NIGHTLY','PROD.SORTED','SORTIT,REPORT')) v(job, dsn, steps)")
def jcl_datasets(spark, d):
    _, dds = jobs.tables(spark, spark.createDataFrame([("n", fixtures.JOB)], "name string, text string"))
    return jobs.datasets(dds).select("job", "dsn", F.array_join("steps", ",").alias("steps"))


@query("""WITH e AS (SELECT user_id AS trace, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, CAST(round(value * 100) AS BIGINT) AS v FROM events), x AS (SELECT trace, idx, v, CASE WHEN event_id % 37 = 0 THEN v + 20000 WHEN event_id % 41 = 0 THEN v + 300 ELSE v END AS w FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY idx) AS k FROM x WHERE v <> w)
SELECT trace, CAST(idx AS INTEGER) AS divergence_index, CASE WHEN w - v = 20000 THEN 'Picture overflow' ELSE 'Decimal truncation' END AS diagnosis FROM f WHERE k = 1""")
def trace_divergence(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("trace"), "event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("idx"), F.lit(1).alias("line"), F.lit("ADD").alias("verb"), F.lit("V").alias("variable"), cents("value").alias("v"))
    text = lambda c: (c.cast("decimal(18,0)") * dec("0.01")).cast("decimal(18,2)").cast("string").alias("new_value")
    b = e.withColumn("v", F.when(F.col("event_id") % 37 == 0, F.col("v") + 20000).when(F.col("event_id") % 41 == 0, F.col("v") + 300).otherwise(F.col("v")))
    pick = lambda x: x.select("trace", "idx", "line", "verb", "variable", text(F.col("v")))
    return portfolio.trace_divergence(pick(e), pick(b)).select("trace", "divergence_index", "diagnosis")


PILL = layouts.Layout("p", (layouts.Field("ID", 0, 4), layouts.Field("AMT", 4, 7, "decimal", 2, True), layouts.Field("N", 11, 3, "integer")))


@query("""SELECT * FROM (VALUES ('ID','all_spaces','    0000000000'),('ID','high_value','ÿÿÿÿ0000000000'),('AMT','max','    0999.99000'),('AMT','zero','    0000000000'),('AMT','negative_max','    -999.99000'),('AMT','overflow','    0001000000'),('AMT','half_cent','    000.005000'),
('N','max','    0000000999'),('N','zero','    0000000000'),('N','overflow','    0000000000')) v(field, pill, record)""")
def poison_pills(spark, d):
    return pills.records(pills.field_table(spark, PILL))


@query("""WITH o AS (SELECT o_custkey AS u, o_orderkey AS id, o_orderstatus AS s FROM orders), h AS (SELECT *, sha256(CAST(id AS VARCHAR)) AS c FROM o), p AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY u ORDER BY id), repeat('0', 64)) AS good FROM h), q AS (SELECT *, CASE WHEN id % 53 = 1 THEN sha256('x') ELSE good END AS prev FROM p)
SELECT count(*) AS total_records, count(*) FILTER (WHERE prev <> good) AS chain_breaks, count(*) FILTER (WHERE id % 59 = 2) AS tampered, count(*) FILTER (WHERE prev <> good) + count(*) FILTER (WHERE id % 59 = 2) = 0 AS chain_intact FROM q""")
def hash_chain_verify(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("username"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    o = o.withColumn("chain_hash", F.sha2(F.col("id").cast("string"), 256))
    good = F.coalesce(F.lag("chain_hash").over(Window.partitionBy("username").orderBy("id")), F.lit(vault.GENESIS))
    o = o.withColumn("good", good).withColumn("prev_hash", F.when(F.col("id") % 53 == 1, F.sha2(F.lit("x"), 256)).otherwise(F.col("good"))).drop("good")
    hashed = ["id", "status", "prev_hash", "chain_hash"]
    log = o.withColumn("record_hash", vault.record_hash(hashed)).withColumn("status", F.when(F.col("id") % 59 == 2, F.concat("status", F.lit("!"))).otherwise(F.col("status")))
    return vault.summary(vault.verify(log, hashed))


@query("""SELECT o_orderkey, sha256(sha256(CAST(o_orderkey AS VARCHAR)) || sha256(o_orderstatus) || sha256(o_orderpriority) || repeat('0', 64)) AS chain FROM orders""")
def chain_hash(spark, d):
    return t(spark, d, "orders").select("o_orderkey", vault.chain_hash(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit(vault.GENESIS)).alias("chain"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_latest(spark, d):
    """The log's newest entries: a top-k report."""
    return vault.audit(t(spark, d, "events").select("event_id", "ts", "event_type")).select("event_id", "event_type")


@query()
def sbom(spark, d):
    tb = tables(spark)
    p = tb("programs").cache()
    return portfolio.sbom(p, portfolio.calls(p), tb("copies"), portfolio.db2_tables(tb("blocks")))


@query("SELECT CAST(0 AS BIGINT) AS problems")
def sbom_validation(spark, d):
    return portfolio.sbom_problems(sbom(spark, d)).agg(F.count("*").alias("problems"))


@query("SELECT doc_id, CAST((CASE WHEN n <= 0 THEN 100 WHEN n < 50 THEN 200 WHEN n < 200 THEN 400 WHEN n < 500 THEN 600 ELSE 800 END) + least(b, 20) * 5 + least(k, 10) * 10 AS BIGINT) AS score FROM (SELECT doc_id, n_chars // 10 AS n, n_chars % 31 AS b, n_chars % 13 AS k FROM documents)")
def simple_complexity(spark, d):
    n = F.col("n_chars")
    score = portfolio.simple_complexity((n / 10).cast("bigint"), n % 31, n % 13)
    return t(spark, d, "documents").select("doc_id", scaled(score, 2).alias("score"))


@query("SELECT s_nationkey, CAST(CASE WHEN count(*) = 0 THEN 100 ELSE (count(*) - count(*) FILTER (WHERE s_suppkey % 4 = 0)) * 100 // count(*) END AS INTEGER) AS confidence FROM supplier GROUP BY s_nationkey")
def conversion_confidence(spark, d):
    s = t(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("s_suppkey") % 4 == 0).alias("f"))
    return s.select("s_nationkey", portfolio.confidence(F.col("n"), F.col("f")).alias("confidence"))


@query("SELECT count(*) AS tested, count(*) FILTER (WHERE p_size > 5) AS clean, CAST(round(count(*) FILTER (WHERE p_size > 5) * 1000.0 / count(*)) AS BIGINT) AS permille FROM part")
def viability_rate(spark, d):
    out = portfolio.viability(t(spark, d, "part").select(F.col("p_name").alias("program"), (F.col("p_size") > 5).alias("clean")))
    return out.select("tested", "clean", F.round(F.col("rate") * 10).cast("bigint").alias("permille"))


@query("SELECT p_type AS failure, count(*) AS n FROM part WHERE NOT (p_size > 5) GROUP BY p_type")
def failure_categories(spark, d):
    rows = t(spark, d, "part").select(F.col("p_type").alias("failure"), (F.col("p_size") > 5).alias("clean"))
    return portfolio.failure_categories(rows).select("failure", F.col("count").alias("n"))


@query("SELECT count(*) AS programs, count(*) FILTER (WHERE s_suppkey % 9 > 0) AS verified, CAST(sum(s_nationkey) AS BIGINT) AS flags, CASE WHEN bool_and(s_suppkey % 9 > 0) THEN 'VERIFIED' ELSE 'REQUIRES_MANUAL_REVIEW' END AS verdict FROM supplier")
def batch_verdict(spark, d):
    return portfolio.batch_verdict(t(spark, d, "supplier").select(F.col("s_name").alias("program"), (F.col("s_suppkey") % 9 > 0).alias("verified"), F.col("s_nationkey").cast("bigint").alias("flags")))


@query("SELECT 'S' || lpad(CAST(i AS VARCHAR), 7, '0') AS ship_no, i * 7919 % 9999991 AS cents, i * 389 % 20000 AS weight, i * 13 % 20 AS zone, CASE i % 5 WHEN 1 THEN 'EX' WHEN 2 THEN 'UR' ELSE 'ST' END AS service FROM range(100) t(i)")
def demo_shipments(spark, d):
    n = lambda c: F.col(f"`{c}`").cast("bigint")
    return pills.demo_shipments(spark).select(F.col("`SHIP-NO`").alias("ship_no"), scaled(F.col("`CARGO-VALUE`").cast("decimal(20,2)"), 2).alias("cents"), n("WEIGHT-KG").alias("weight"), n("ZONE-NO").alias("zone"), F.col("SERVICE").alias("service"))
