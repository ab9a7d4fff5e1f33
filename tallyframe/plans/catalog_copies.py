"""Registered queries over copybooks and storage: a member for every part and a program for every customer; byte ranges and overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.plans import copies, lang, overlaps
from tallyframe.plans.catalog import query, t

#: Four of five members hold another one (of every twenty one isn't there), by a clause whose LEADING word the outer clause may have replaced: on every second level it has.
COPIES_SQL = """
WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), m AS (SELECT CAST(p_partkey AS BIGINT) AS k, CASE WHEN p_partkey % 5 <> 0 THEN CAST((p_partkey * 7 + p_size) % (n + n // 20) + 1 AS BIGINT) END AS child FROM part, n),
w(c, depth, k, tag, around) AS (
  SELECT CAST(c_custkey AS BIGINT), 1, CAST(c_custkey % n + 1 AS BIGINT), 'S' || c_custkey || 'X', CAST([] AS BIGINT[]) FROM customer, n
  UNION ALL SELECT c, depth + 1, child, CASE WHEN depth % 2 = 1 THEN 'TAG' ELSE 'L' || w.k || 'X' END, list_append(around, w.k) FROM w JOIN m ON w.k = m.k WHERE child IS NOT NULL AND NOT list_contains(around, w.k) AND depth <= 10
), r AS (SELECT w.*, CASE WHEN list_contains(around, k) THEN 'cycle' WHEN depth > 10 THEN 'too deep' WHEN k NOT IN (SELECT k FROM m) THEN 'not found' END AS reason FROM w)
"""


def library_and_programs(spark, d) -> tuple[DataFrame, DataFrame]:
    parts, k = t(spark, d, "part"), F.col("p_partkey").cast("bigint")
    n = parts.count()
    name, child = k.cast("string"), ((k * 7 + F.col("p_size")) % (n + n // 20) + 1).cast("string")
    held = F.when(k % 5 != 0, F.concat(F.lit("       COPY P"), child, F.lit(" REPLACING LEADING ==TAG== BY ==L"), name, F.lit("X==.\n"))).otherwise("")
    text = F.concat(F.lit("       05 TAG-NAME-"), name, F.lit(" PIC X.\n"), held, F.lit("       05 END-"), name, F.lit(" PIC 9.\n"))
    c = F.col("c_custkey").cast("bigint")
    source = F.concat(F.lit("       01 REC.\n       COPY P"), (c % n + 1).cast("string"), F.lit(" REPLACING LEADING ==TAG== BY ==S"), c.cast("string"), F.lit("X==.\n"))
    return parts.select(F.concat(F.lit("P"), name).alias("member"), text.alias("text")), t(spark, d, "customer").select(F.concat(F.lit("C"), c.cast("string")).alias("name"), source.alias("source"))


@query(COPIES_SQL + """SELECT 'C' || c AS program, '01 REC.' || chr(10) || string_agg(CASE WHEN reason IS NULL THEN '05 ' || tag || '-NAME-' || k || ' PIC X.' ELSE '' END, chr(10) ORDER BY depth)
  || coalesce(string_agg(CASE WHEN reason IS NULL THEN chr(10) || '05 END-' || k || ' PIC 9.' END, '' ORDER BY depth DESC), '') AS source FROM r GROUP BY c""")
def copybooks_customers(spark, d):
    """Every customer's program with its members put in."""
    library, programs = library_and_programs(spark, d)
    return copies.expand(programs, library)[0].select("program", "source")


@query(COPIES_SQL + "SELECT 'P' || k AS member, reason, count(*) AS places, count(DISTINCT c) AS programs FROM r WHERE reason IS NOT NULL GROUP BY k, reason")
def copy_issues_customers(spark, d):
    """Members that could not be put in: in a cycle, too deep or not there."""
    library, programs = library_and_programs(spark, d)
    return copies.uses(copies.expand(programs, library)[1])


RANGES_SQL = "WITH r AS (SELECT l_suppkey AS g, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS s, CAST(l_quantity AS BIGINT) * CASE WHEN l_linenumber = 1 THEN 40 ELSE 1 END AS n FROM lineitem)"


@query(RANGES_SQL + " SELECT a.g AS supplier, a.id AS first, b.id AS second, greatest(a.s, b.s) AS start, least(a.s + a.n, b.s + b.n) - greatest(a.s, b.s) AS length FROM r a JOIN r b ON a.g = b.g AND a.id < b.id AND a.s < b.s + b.n AND b.s < a.s + a.n")
def range_overlaps(spark, d):
    """Ranges of all sizes that meet: each supplier's line items, from the order's number on."""
    n = F.col("l_quantity").cast("bigint") * F.when(F.col("l_linenumber") == 1, 40).otherwise(1)
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("id"), F.col("l_orderkey").alias("start"), n.alias("length"))
    return overlaps.overlapping(rows, ["supplier"])


VIEWS_SQL = "WITH s AS (SELECT 'C' || c_custkey AS program, c_custkey AS k, c_custkey % 5 + 2 AS a, c_custkey % 7 + 1 AS b FROM customer)"


def views(spark, d):
    """A program for every customer whose record has one or two overlays, as long as their subject or not."""
    k = F.col("c_custkey")
    number = lambda c: c.cast("string")
    text = F.concat(
        F.lit("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. C"), number(k), F.lit(".\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       01 REC.\n          05 A PIC X("), number(k % 5 + 2),
        F.lit(").\n          05 B REDEFINES A PIC 9("), number(k % 7 + 1), F.lit(").\n          05 C PIC 9(3).\n"), F.when(k % 3 == 0, F.lit("          05 D REDEFINES C PIC X(4).\n")).otherwise(""),
        F.lit("       PROCEDURE DIVISION.\n       MAIN-P.\n           MOVE A TO B.\n           MOVE C TO A.\n           GOBACK.\n"),
    )
    return lang.portfolio(spark, t(spark, d, "customer").select(F.concat(F.lit("C"), number(k)).alias("name"), text.alias("source")))


@query(VIEWS_SQL + " SELECT program, 'A' AS first, 'B' AS second, CAST(0 AS BIGINT) AS start, CAST(least(a, b) AS BIGINT) AS length, TRUE AS ambiguous FROM s UNION ALL SELECT program, 'C', 'D', greatest(a, b), 3, TRUE FROM s WHERE k % 3 = 0")
def storage_overlays_customers(spark, d):
    """Fields that share bytes."""
    return overlaps.overlays(views(spark, d)("storage")).drop("region")


@query(VIEWS_SQL + " SELECT program, source, target, reason FROM s, (VALUES ('A', 'B', 'operands overlap'), ('A', 'B', 'other kind stored'), ('C', 'A', 'other kind stored')) v(source, target, reason) WHERE source = 'A' OR k % 3 = 0")
def ambiguous_moves_customers(spark, d):
    """MOVE statements that shared bytes make doubtful."""
    tb = views(spark, d)
    return overlaps.ambiguous_moves(tb("moves"), tb("storage")).select("program", "source", "target", "reason")
