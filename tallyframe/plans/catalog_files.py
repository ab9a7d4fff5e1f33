"""Registered queries over streams and record files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import ebcdic
from tallyframe.plans.catalog import cents, query, t
from tallyframe.plans.scratch import folder
from tallyframe.sources import layout as layouts
from tallyframe.sources import records
from tallyframe.streaming import feed


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders)
SELECT k AS record, CASE WHEN k % 11 = 0 THEN 'length_mismatch' WHEN k % 13 = 0 THEN 'drift' ELSE 'match' END AS event, CASE WHEN k % 11 = 0 THEN 'expected' END AS side,
  CASE WHEN k % 11 = 0 THEN '_record' WHEN k % 13 = 0 THEN 'total' ELSE '' END AS message FROM o
UNION ALL SELECT -k - 1, 'length_mismatch', 'produced', '_record' FROM o WHERE k % 19 = 0""")
def two_sided_feed(spark, d):
    """Two folders of order files as streams against each other: some orders are not produced, some differ, some come twice, some were never expected."""
    key, out, fields = F.col("_rec"), folder(spark, "feed"), ["status", "total"]
    orders = t(spark, d, "orders").select(F.col("o_orderkey").cast("bigint").alias("_rec"), F.col("o_orderstatus").alias("status"), cents("o_totalprice").alias("total"))
    here = F.when(key % 11 == 0, F.array().cast("array<bigint>")).when(key % 17 == 0, F.array(key, key)).otherwise(F.array(key))
    made = orders.withColumn("total", F.when(key % 13 == 0, F.col("total") + 1).otherwise(F.col("total"))).withColumn("_rec", F.explode(F.when(key % 19 == 0, F.concat(here, F.array(-key - 1))).otherwise(here)))
    for side, rows in (("expected", orders), ("produced", made)):
        rows.write.parquet(f"{out}/{side}")
    streams = [spark.readStream.schema(orders.schema).parquet(f"{out}/{side}") for side in ("produced", "expected")]
    feed.until_settled(feed.verify_stream(*streams, fields, f"{out}/events", f"{out}/checkpoint", wait=1, every="0 seconds", tick=1))
    return feed.settled(spark, f"{out}/events", fields).select("record", "event", "side", "message")


UNEVEN = layouts.Layout("uneven", (layouts.Field("KEY", 0, 8, "integer"), layouts.Field("NAME", 8, 12)), 20)


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS record, p_partkey AS key, rtrim(substr(p_name, 1, 12)) AS name FROM part")
def varying_file_scan(spark, d):
    """Fixed-length records with no, one or two separator bytes behind each, in files that are split all the same."""
    key = F.col("p_partkey")
    behind = F.element_at(F.array(F.lit(""), F.lit("\n"), F.lit("\r\n"), F.lit("\r")), (key % 4 + 1).cast("int"))
    raw = F.concat(F.lpad(key.cast("string"), 8, "0"), F.rpad(F.substring("p_name", 1, 12), 12, " "), behind)
    path = folder(spark, "uneven")
    records.write_fixed(t(spark, d, "part").select(key.alias("_rec"), F.encode(raw, "US-ASCII").alias("raw")), path)
    return records.scan(spark, path, UNEVEN, "varying").select(F.col("_rec").alias("record"), F.col("KEY").cast("bigint").alias("key"), F.rtrim("NAME").alias("name"))


PAGES = layouts.Layout("pages", (layouts.Field("KEY", 0, 8, "integer"), layouts.Field("NAME", 8, 30)), 38, codepage="auto")


@query("SELECT row_number() OVER (ORDER BY c_custkey % 3, c_custkey) - 1 AS record, c_custkey AS key, '[' || c_name || ']' AS name FROM customer")
def codepage_scan(spark, d):
    """Files of three code pages in one scan: ASCII, cp037 and cp1047, told apart by their bytes."""
    path, key = folder(spark, "pages"), F.col("c_custkey")
    text = F.concat(F.lpad(key.cast("string"), 8, "0"), F.rpad(F.concat(F.lit("["), "c_name", F.lit("]")), 30, " "))
    rows = t(spark, d, "customer").withColumn("text", text)
    for k, raw in enumerate((F.encode("text", "ISO-8859-1"), ebcdic.encode(F.col("text"), "cp037"), ebcdic.encode(F.col("text"), "cp1047"))):
        records.write_fixed(rows.where(key % 3 == k).select(key.alias("_rec"), raw.alias("raw")), f"{path}/{k}")
    out = records.scan(spark, f"{path}/*", PAGES)
    return out.select(F.col("_rec").alias("record"), F.col("KEY").cast("bigint").alias("key"), F.rtrim("NAME").alias("name"))
