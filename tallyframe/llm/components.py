"""Connected components of a table of links, by contraction.

Each round hooks every node with a smaller neighbour to its smallest one, jumps
pointers until all point to roots, renames the links' ends by their roots and
drops those inside one component. All steps are minimum aggregates and equi-joins
with written tables between them; nothing but row counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def roots(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for nodes of ``links`` (``a``,
    ``b`` bigint) that aren't their component's root. Self-links and repeats don't matter."""
    ordered = lambda a, b: (F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    edges = written(links.select(*ordered(F.col("a"), F.col("b"))).where("hi <> lo").distinct(), "links")
    found = links.sparkSession.createDataFrame([], "node bigint, root bigint")
    while not edges.isEmpty():
        hooks = written(edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"), F.lit(True).alias("moved")), "hooks")
        while not hooks.where("moved").isEmpty():
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = written(hooks.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "jumps")
            drop(hooks)
            hooks = jumped
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
        grown = written(found.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")).union(hooks.select("node", "root")), "roots")
        of = lambda end: hooks.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))  # noqa: B023, E731
        renamed = edges.join(of("hi"), "hi", "left").join(of("lo"), "lo", "left")
        fewer = written(renamed.select(*ordered(F.coalesce("hi_root", "hi"), F.coalesce("lo_root", "lo"))).where("hi <> lo").distinct(), "links")
        drop(hooks, found, edges)
        found, edges = grown, fewer
    drop(edges)
    return found
