"""Registered queries over graphs that the tables give: who calls whom among suppliers' programs, and parts' chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.plans import graphs
from tallyframe.plans.catalog import query, t

#: Each supplier leads to one by its own number and nation; every third also to that of its nation's number.
EDGES_SQL = """
WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), c AS (SELECT count(*) AS n FROM s), e(src, dst) AS (
  SELECT k, (k * 5 + s.n) % c.n + 1 FROM s, c UNION SELECT k, s.n + 1 FROM s, c WHERE k % 3 = 0 AND s.n < c.n
), nodes AS (SELECT k AS node FROM s), reach(src, dst) AS (
  SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src
)
"""


def edges(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = t(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"), F.col("s_nationkey").cast("bigint").alias("n"))
    all_ = rows.count()
    one = rows.select(F.col("k").alias("src"), ((F.col("k") * 5 + F.col("n")) % all_ + 1).alias("dst"))
    return one.union(rows.where((F.col("k") % 3 == 0) & (F.col("n") < all_)).select("k", F.col("n") + 1)), rows.select(F.col("k").alias("node"))


@query(EDGES_SQL + """SELECT a.src AS node, least(a.src, min(CASE WHEN a.src <> a.dst THEN a.dst ELSE a.src END)) AS component
FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""")
def cycles_suppliers(spark, d):
    """Strongly connected components of suppliers' calls."""
    return graphs.components(edges(spark, d)[0])


@query(EDGES_SQL + """, bad AS (SELECT DISTINCT node FROM nodes WHERE node IN (SELECT src FROM reach WHERE src = dst) OR node IN (SELECT b.dst FROM reach a JOIN reach b ON a.src = a.dst AND b.src = a.src)),
walk(node, len) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, w.len + 1 FROM walk w JOIN e ON e.src = w.node WHERE e.dst NOT IN (SELECT node FROM bad)),
ranks AS (SELECT node, CAST(max(len) AS INTEGER) AS rank FROM walk WHERE node NOT IN (SELECT node FROM bad) GROUP BY node), every AS (SELECT nodes.node, rank FROM nodes LEFT JOIN ranks ON nodes.node = ranks.node)
SELECT node, coalesce(rank, -1) AS rank, row_number() OVER (ORDER BY rank IS NOT NULL, rank DESC, node) AS position FROM every""")
def call_order_suppliers(spark, d):
    """Suppliers so that all that one calls come before it; those on cycles or below them first."""
    return graphs.callees_first(*edges(spark, d)).withColumn("rank", F.coalesce("rank", F.lit(-1)))
