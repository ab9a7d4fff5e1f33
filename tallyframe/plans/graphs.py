"""Graphs too large for a closure: strongly connected components, levels, and a dense order, over written edge tables.

A round reads the tables of the round before, so a lost executor costs one round; nothing but counts comes to the driver. Rounds of levels are as many as the longest path; those of
components grow with the logarithm of paths of nodes that have one edge in or out, and with the longest of the shortest paths among the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.scratch import cut, folder
from tallyframe.sources.records import prefix_sums

#: Times that ends of paths are trimmed before colours are spread; colours find what is left.
TRIMS = 3
#: Of the nodes with one edge out (or in) one in so many stays in a round, and those that reach it in less than two to ``DOUBLED`` steps are taken out.
KEEP, DOUBLED = 4, 3


class Pile:
    """Rows that rounds add, one table in the end."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.schema, self.path = df.sparkSession, df.schema, folder(df.sparkSession, label)
        self.add(df)

    def add(self, df: DataFrame) -> None:
        df.select(*self.schema.names).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def _within(edges: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """Edges both ends of which are (``left_semi``), or neither of which is (``left_anti``), among ``nodes``."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, how)
    return edges.select("src", "dst")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of the nodes on cycles of ``src``, ``dst``: of strongly connected components of two or more nodes, and of nodes with an edge to themselves.

    Paths are shortened first, as long as there are nodes with one edge out or one edge in. Then rounds of forward and backward colouring: nodes without an edge in or out are
    trimmed; each node takes the smallest node that leads to it as its colour; of those that have a colour, the ones from which its node can be reached are its component, and leave
    the graph. What was shortened takes the components of its ends, the last shortened first."""
    every = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    own = every.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    left, n, bypassed = _shortened(every.where("src <> dst"))
    found = Pile(own.limit(0), "components")
    while n:
        colours = cut(_colours(left), "colours")
        members = _backward(left, colours)
        found.add(members.select("node", F.col("colour").alias("component")))
        left, n = _trimmed(_within(left, members, "left_anti"))
    for through in reversed(bypassed):
        known = found.read()
        end = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))  # noqa: E731, B023
        both = through.join(end("src"), "src", "left").join(end("dst"), "dst", "left").select("node", *(F.coalesce(f"{c}_component", c).alias(c) for c in ("src", "dst"))).where("src = dst")
        found.add(cut(both.groupBy("node").agg(F.min("dst").alias("component")), "restored"))
    # a cycle that shrank to one node has that node's name; it isn't in the table yet, nor is a name the smallest node
    labels = found.read()
    labels = labels.unionByName(labels.select(F.col("component").alias("node"), "component")).distinct()
    least = labels.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1").select("component", "least")
    several = cut(labels.join(least, "component").select("node", F.col("least").alias("component")), "components")
    return several.unionByName(own.join(several.select("node"), "node", "left_anti"))


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """A written table of the edges without those of nodes without an edge in or out (``TRIMS`` times), and their number."""
    edges = cut(edges, "edges")
    n = edges.count()
    for _ in range(TRIMS):
        through = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
        edges, before = cut(_within(edges, through, "left_semi"), "edges"), n
        n = edges.count()
        if n == before:
            break
    return edges, n


def _shortened(edges: DataFrame) -> tuple[DataFrame, int, list[DataFrame]]:
    """The edges (none from a node to itself) without nodes on paths, their number, and what was taken out, a table a step: ``node`` between ``src`` and ``dst``. ``node`` is in the component of its
    ``dst`` if one of its ``src`` is; else it is on no cycle.

    A node with one edge out is left out, and those before it lead to where it leads; of the nodes with one edge in likewise. A hash, another one each round, lets every ``KEEP``th
    such node stay, and those before it, up to two to ``DOUBLED`` steps away, are taken out at once, so a path or ring shrinks to a part in each round, and rounds grow with the logarithm of its length."""
    left, n = _trimmed(edges)
    bypassed: list[DataFrame] = []
    turn = quiet = 0
    while n and quiet < 2:
        back = turn % 2 == 1
        e = left.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if back else left
        stays = F.pmod(F.xxhash64("src", F.lit(turn)), F.lit(KEEP)) == 0
        step = cut(e.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")).where((F.col("n") == 1) & ~stays).select(F.col("src").alias("node"), F.array("src").alias("path"), "to"), "steps")
        turn += 1
        if step.isEmpty():
            # none may be left, or the hash kept the last ones
            quiet += 1
            continue
        for _ in range(DOUBLED):
            on = step.select(F.col("node").alias("to"), F.col("path").alias("more"), F.col("to").alias("then"))
            step = cut(step.join(on, "to", "left").select("node", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"), F.coalesce("then", "to").alias("to")), "steps")
        # what leads to one that is still a step is too far away, or on a ring of steps
        out = cut(step.join(step.select(F.col("node").alias("to")), "to", "left_anti").select("node", "path", "to"), "steps")
        if out.isEmpty():
            quiet += 1
            continue
        quiet = 0
        stay = e.join(out.select(F.col("node").alias("src")), "src", "left_anti").join(out.select(F.col("node").alias("dst"), "path", "to"), "dst", "left")
        stay = cut(stay.select("src", "dst", "path", "to"), "edges")
        bypassed.append(stay.where("to IS NOT NULL").select("src", F.explode("path").alias("node"), F.col("to").alias("dst")))
        e = stay.select("src", F.coalesce("to", "dst").alias("dst")).where("src <> dst").distinct()
        left, n = _trimmed(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if back else e)
    return left, n, bypassed


def _colours(edges: DataFrame) -> DataFrame:
    """``node`` and ``colour``: the smallest node that leads to it (or itself)."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colours = cut(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")), "colours")
    while not colours.where("new").isEmpty():
        told = edges.join(colours.where("new").select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("other"))
        better = F.coalesce(F.col("other") < F.col("colour"), F.lit(False))
        colours = cut(colours.join(told, "node", "left").select("node", F.when(better, F.col("other")).otherwise(F.col("colour")).alias("colour"), better.alias("new")), "colours")
    return colours.select("node", "colour")


def _backward(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """``node`` and ``colour`` of the nodes from which the node of their colour can be reached inside the colour."""
    source, target = (colours.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")) for end in ("src", "dst"))
    inside = cut(edges.join(source, "src").join(target, "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")), "inside")
    front = cut(colours.where("node = colour"), "front")
    reached = Pile(front, "reached")
    while not front.isEmpty():
        front = cut(inside.join(front.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), "colour").distinct().join(reached.read().select("node"), "node", "left_anti"), "front")
        reached.add(front)
    return reached.read()


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``level`` of all ``nodes``: 0 for those without edges out, else one more than the highest level that theirs lead to; -1 on a cycle
    (an edge to itself is one) or above one. Edges to or from other nodes don't count."""
    e = cut(edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst").distinct(), "edges")
    left, level = cut(nodes.select("node").distinct(), "left"), 0
    out = Pile(left.select("node", F.lit(0).alias("level")).limit(0), "levels")
    while True:
        ready = cut(left.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti"), "ready")
        if ready.isEmpty():
            break
        out.add(ready.select("node", F.lit(level).alias("level")))
        left = cut(left.join(ready, "node", "left_anti"), "left")
        e = cut(e.join(ready.select(F.col("node").alias("dst")), "dst", "left_anti"), "edges")
        level += 1
    out.add(left.select("node", F.lit(-1).alias("level")))
    return out.read()


def callees_first(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node``, ``rank`` and ``position`` (from 1): every node after all that it leads to. Nodes are peeled from the roots, which nothing leads to, so those on a
    cycle or below one are never free (``rank`` null); they come first, by name, then the others from the last peeled to the roots."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ranked = cut(levels(back, nodes).select("node", F.when(F.col("level") >= 0, F.col("level")).alias("rank"), F.when(F.col("level") >= 0, -F.col("level")).otherwise(-(2**31)).cast("bigint").alias("turn"), F.lit(1).cast("bigint").alias("one")), "ranked")
    return prefix_sums(ranked, ["turn", "node"], "one", "before").select("node", "rank", (F.col("before") + 1).alias("position"))
