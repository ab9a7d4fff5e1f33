"""A registered query whose intermediate results no decimal type holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.plans.catalog import query, t
from tallyframe.plans.catalog_programs import run, source

WIDE = source(
    "01 A PIC 9(31).\n01 B PIC 9(12).\n01 C PIC S9(16)V9(15).\n01 LOW PIC 9(18).\n01 Q PIC 9(20)V9(4).\n01 M PIC S9(9)V99.\n01 F PIC X VALUE 'N'.",
    "COMPUTE LOW = A * B.\nDIVIDE A BY B GIVING Q.\nCOMPUTE M ROUNDED = C * C * B - A * 3\n  ON SIZE ERROR MOVE 'Y' TO F END-COMPUTE.\nSTOP RUN.",
)


@query("""WITH o AS (SELECT o_orderkey AS k, CAST(lpad(CAST(o_orderkey AS VARCHAR), 9, '7') || lpad(CAST(o_custkey AS VARCHAR), 12, '3') || '0123456789' AS HUGEINT) AS a, CAST(o_custkey * 999983 + 1 AS HUGEINT) AS b FROM orders)
SELECT k AS record, CAST((a % 1000000000000000000 * b) % 1000000000000000000 AS BIGINT) AS low, CAST((a * 10000 // b) % 1000000000000000000000000 AS VARCHAR) AS q, 'Y' AS over FROM o""")
def wide_arithmetic(spark, d):
    """Products and quotients of 31-digit fields as columns."""
    text = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 9, "7"), F.lpad(F.col("o_custkey").cast("string"), 12, "3"), F.lit("0123456789"))
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("_rec"), text.cast("decimal(31,0)").alias("a"), (F.col("o_custkey") * 999983 + 1).cast("decimal(12,0)").alias("b"))
    out = run(rows.withColumn("c", F.lit("1.000000000000001").cast("decimal(31,15)")), WIDE, {"a": "A", "b": "B", "c": "C"}, {"low": "LOW", "q": "Q", "over": "F"}, "native")
    q = F.regexp_replace(F.replace(F.col("q").cast("decimal(24,4)").cast("string"), F.lit("."), F.lit("")), "^0+(?=.)", "")
    return out.select("record", F.col("low").cast("bigint").alias("low"), q.alias("q"), "over")
