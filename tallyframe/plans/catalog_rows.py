"""Registered queries of operators that no other query shows: pictures, code pages, roles and layouts of a portfolio, views of a store, capped reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tallyframe.functions import ebcdic
from tallyframe.functions.pic import parse
from tallyframe.plans import analysis, diff, vault
from tallyframe.plans.catalog import C, cents, query, t
from tallyframe.plans.catalog_programs import SUP, generated
from tallyframe.sources import layout as layouts


@query("""WITH p AS (SELECT p_partkey AS k, p_size % 9 + 1 AS i, p_partkey % 5 AS d, p_partkey % 3 AS u FROM part)
SELECT k AS part, CASE u WHEN 0 THEN i + d WHEN 1 THEN (i + d) // 2 + 1 ELSE CASE WHEN i + d <= 4 THEN 2 WHEN i + d <= 9 THEN 4 ELSE 8 END END AS storage_bytes,
  i + d + 1 + CASE WHEN d > 0 THEN 1 ELSE 0 END AS display_bytes, CAST(10 ** (i + d) AS BIGINT) - 1 AS largest FROM p""")
def picture_sizes(spark, d):
    """Bytes in a record, characters of a text and the largest value of a picture for each part."""
    k, i, n = F.col("p_partkey"), F.col("p_size") % 9 + 1, F.col("p_partkey") % 5
    picture = F.concat(F.lit("S9("), i.cast("string"), F.lit(")"), F.when(n > 0, F.concat(F.lit("V9("), n.cast("string"), F.lit(")"))).otherwise(""))
    usage = F.element_at(F.array(F.lit("DISPLAY"), F.lit("COMP-3"), F.lit("COMP")), (k % 3 + 1).cast("int"))

    @F.pandas_udf("storage_bytes int, display_bytes int, largest bigint")
    def sizes(pictures: pd.Series, usages: pd.Series) -> pd.DataFrame:
        known = {x: parse(*x) for x in set(zip(pictures, usages, strict=True))}
        own = [known[x] for x in zip(pictures, usages, strict=True)]
        return pd.DataFrame({"storage_bytes": [p.storage_bytes for p in own], "display_bytes": [p.display_bytes for p in own], "largest": [int(p.largest().scaleb(p.dec_digits)) for p in own]})

    return t(spark, d, "part").select(k.alias("part"), sizes(picture, usage).alias("s")).select("part", "s.*")


NAME = (layouts.Field("KEY", 0, 8, "integer"), layouts.Field("NAME", 8, 25))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'cp037' ELSE 'ascii' END AS codepage FROM customer")
def codepage_detect(spark, d):
    """The code page of each customer's record, by the bytes of its text fields."""
    text = F.concat(F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.rpad("c_name", 25, " "))
    raw = F.when(F.col("c_custkey") % 2 == 0, ebcdic.encode(text)).otherwise(F.encode(text, "ISO-8859-1"))

    @F.pandas_udf("string")
    def page(records: pd.Series) -> pd.Series:
        return records.map(lambda r: layouts.detect_codepage(bytes(r), NAME, "ascii"))

    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), page(raw).alias("codepage"))


@query(f"""{SUP} SELECT program, v.variable, CASE v.variable WHEN 'L-AMT' THEN 'dead' WHEN 'W-RATE' THEN 'input' WHEN 'W-CNT' THEN 'output'
  WHEN 'W-AMT' THEN CASE WHEN k > 1 THEN 'input output' ELSE 'input' END ELSE CASE WHEN k > 1 THEN 'input output' ELSE 'output' END END AS role
FROM s, (VALUES ('L-AMT'), ('W-RATE'), ('W-CNT'), ('W-AMT'), ('W-NET')) v(variable)""")
def variable_roles_suppliers(spark, d):
    """What each supplier's program uses its variables for."""
    return analysis.over_portfolio(generated(spark, d))[0]


@query(f"""{SUP}, f(field, digits, decimals, sort, given, made) AS (VALUES ('W-AMT', 9, 2, 1, 0, 2), ('W-RATE', 9, 4, 2, 0, 9), ('W-NET', 11, 2, 3, 2, 0), ('W-CNT', 4, 0, 4, 9, 0)),
x AS (SELECT program, 'input' AS side, field, digits AS length, decimals, sort FROM s, f WHERE given = 0 OR (given = 2 AND k > 1)
  UNION ALL SELECT program, 'output', field, 40, decimals, sort FROM s, f WHERE made = 0 OR (made = 2 AND k > 1))
SELECT program, side, field, CAST(coalesce(sum(length) OVER (PARTITION BY program, side ORDER BY sort ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start, length,
  CASE WHEN decimals > 0 THEN 'decimal' ELSE 'integer' END AS type, decimals FROM x""")
def layouts_suppliers(spark, d):
    """Input and output layouts of each supplier's program."""
    return analysis.over_portfolio(generated(spark, d))[1]


def customers(spark, d):
    """Customers as a store: a nation is a user."""
    return t(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_nationkey").cast("string").alias("username"), F.col("c_name").alias("report"))


@query("SELECT c_custkey AS id, c_name AS report FROM customer WHERE c_nationkey = 5 ORDER BY c_custkey DESC LIMIT 10")
def vault_listing(spark, d):
    """A user's ten newest records."""
    return vault.listing(customers(spark, d), "5", 10).select("id", "report")


@query("""SELECT '{"id":' || c_custkey || ',"username":"' || c_nationkey || '","report":"' || c_name || '"}' AS value FROM customer WHERE c_nationkey = 5 AND c_custkey <> (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 5)""")
def vault_export(spark, d):
    """A user's records as JSON lines, once the oldest is deleted."""
    log = customers(spark, d)
    first = log.where("username = '5'").agg(F.min("id")).first()[0]
    return vault.export(vault.without(log, "5", -1 if first is None else first), "5")


@query(f"SELECT o_orderkey AS record, 'total' AS field, CAST({C.format('o_totalprice')} + 1 AS VARCHAR) AS produced_value FROM orders WHERE o_orderkey % 3 = 0 ORDER BY o_orderkey LIMIT 500")
def capped_details(spark, d):
    """The first 500 differences in record order: a report's log."""
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("_rec"), cents("o_totalprice").alias("total"))
    made = orders.withColumn("total", F.when(F.col("_rec") % 3 == 0, F.col("total") + 1).otherwise(F.col("total")))
    return diff.details(diff.compare(made, orders, ["total"]), 500).select("record", "field", "produced_value")
