"""Registered queries over chains and signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import rsa
from tallyframe.plans import vault
from tallyframe.plans.catalog import query, t
from tallyframe.plans.scratch import folder, spread


@query("""WITH RECURSIVE o AS (
  SELECT o_custkey AS customer, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
    sha256(CAST(o_orderkey AS VARCHAR)) || sha256(o_orderstatus) || sha256(o_orderpriority) AS own FROM orders
), c(customer, id, n, prev_hash, chain_hash) AS (
  SELECT customer, id, n, repeat('0', 64), sha256(own || repeat('0', 64)) FROM o WHERE n = 1
  UNION ALL SELECT o.customer, o.id, o.n, c.chain_hash, sha256(o.own || c.chain_hash) FROM c JOIN o ON o.customer = c.customer AND o.n = c.n + 1
)
SELECT customer, id, prev_hash, chain_hash FROM c""")
def batched_chain(spark, d):
    """A chain of its orders for each customer, appended in two batches."""
    key = F.col("o_orderkey")
    rows = t(spark, d, "orders").select(key.cast("bigint").alias("id"), F.col("o_custkey").cast("string").alias("username"), key.cast("string").alias("source"), F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("report"))
    path, half = folder(spark, "chains"), rows.agg(F.max("id")).first()[0] // 2
    vault.append_many(rows.where(F.col("id") <= half), path)
    vault.append_many(rows.where(F.col("id") > half), path)
    return spark.read.parquet(path).select(F.col("username").cast("bigint").alias("customer"), "id", "prev_hash", "chain_hash")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'unsigned' WHEN s_suppkey % 7 = 0 THEN 'invalid' ELSE 'valid' END AS state, sha256(s_name) AS record_hash FROM supplier")
def signature_states(spark, d):
    """RSA-PSS signatures of suppliers' records by a new key: some aren't signed, some are of another text."""
    key, id_ = rsa.generate(1024), F.col("s_suppkey")
    hashed = t(spark, d, "supplier").select(id_.alias("id"), F.sha2("s_name", 256).alias("record_hash"), F.lit(None).cast("string").alias("chain_hash"))
    text = F.when(F.col("id") % 5 != 0, F.concat("record_hash", F.when(F.col("id") % 7 == 0, "!").otherwise("")))
    return vault.signatures(spread(hashed).withColumn("signature", rsa.signature(text, key)), key.public).select("id", F.col("signature_state").alias("state"), "record_hash")
