"""Storage that several fields share: an interval join over byte ranges, and what MOVE statements make of it.

Ranges are of any length, so each has buckets of its own size: a range of ``n`` bytes lies in at most two buckets of the power of four that holds ``n``. A range
meets the ones that are as long as it or longer in their buckets, so it is looked up once or twice a size that occurs (32 at most). Both lie in the bucket in which
their common bytes begin, and nowhere else is the pair reported, so there is nothing to make distinct and no cross join within a program.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.scratch import cut


def _buckets(level: Column) -> Column:
    return F.explode(F.sequence(F.call_function("shiftright", F.col("start"), level), F.call_function("shiftright", F.col("end") - 1, level)))


def overlapping(ranges: DataFrame, group_cols: list[str], id_col: str = "id", start_col: str = "start", length_col: str = "length") -> DataFrame:
    """``group_cols``, ``first``, ``second`` (ids in order), ``start`` and ``length`` of the bytes of all pairs of a group's ranges that share some.

    Ids are unique within a group: ranges of one id don't meet. Empty ranges and those with a null anywhere share nothing; starts may be negative. Many ranges over the
    same bytes give as many pairs as there are."""
    wanted = [F.col(c).alias(f"g{i}") for i, c in enumerate(group_cols)]
    rows = ranges.select(*wanted, F.col(id_col).alias("id"), F.col(start_col).cast("bigint").alias("start"), F.col(length_col).cast("bigint").alias("n")).where("n > 0").dropna()
    bits = F.length(F.bin(F.col("n") - 1))
    level = F.least(bits + bits % 2, F.lit(63))  # every second size: half the lookups for some more pairs that don't meet
    rows = cut(rows.select("*", (F.col("start") + F.col("n")).alias("end"), level.alias("level")), "ranges")
    groups = [f"g{i}" for i in range(len(group_cols))]
    sizes = sorted(r.level for r in rows.select("level").distinct().collect())  # 32 at most
    if not sizes:
        sizes = [1]
    long = rows.select(*groups, "level", _buckets(F.col("level")).alias("bucket"), F.col("id").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    probes = rows.withColumn("own", F.col("level")).withColumn("level", F.explode(F.array(*map(F.lit, sizes)))).where("level >= own")
    probes = probes.select(*groups, "level", _buckets(F.col("level")).alias("bucket"), F.col("id").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), "own")
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    met = probes.join(long, [*groups, "level", "bucket"]).where((start < end) & (F.call_function("shiftright", start, F.col("level")) == F.col("bucket")))
    met = met.where((F.col("own") < F.col("level")) & (F.col("a_id") != F.col("b_id")) | (F.col("own") == F.col("level")) & (F.col("a_id") < F.col("b_id")))
    return met.select(*(F.col(g).alias(c) for g, c in zip(groups, group_cols, strict=True)), F.least("a_id", "b_id").alias("first"), F.greatest("a_id", "b_id").alias("second"), start.alias("start"), (end - start).alias("length"))


def overlays(storage: DataFrame) -> DataFrame:
    """``program``, ``region``, ``first``, ``second``, ``start``, ``length``, ``ambiguous``: fields (and tables of groups) that share bytes, over all programs; ``ambiguous`` where one holds
    text and the other a number. ``storage`` is the portfolio's table; ``first`` comes before ``second`` in its program."""
    leaves = storage.where("leaf").select("program", "region", F.struct("seq", "name", "kind").alias("id"), "offset", "length")
    met = overlapping(leaves, ["program", "region"], start_col="offset")
    kinds = F.array_sort(F.array("first.kind", "second.kind"))
    return met.select("program", "region", F.col("first.name").alias("first"), F.col("second.name").alias("second"), "start", "length", (kinds == F.array(F.lit("number"), F.lit("text"))).alias("ambiguous"))


def ambiguous_moves(moves: DataFrame, storage: DataFrame) -> DataFrame:
    """``program``, ``seq``, ``line``, ``source``, ``target``, ``reason`` of MOVE statements whose result hangs on shared storage: ``operands overlap`` (both are in the same bytes, which leaves the
    result undefined), or ``other kind stored`` (the source is a view of bytes whose other view is of another kind: what a picture of one kind stored is read by the other).

    Names that several items of a program have, and operands with subscripts or reference modification, are left out of ``operands overlap``: which bytes they are isn't known."""
    named = storage.where("name <> 'FILLER'").groupBy("program", "name").agg(F.count("*").alias("n"), F.min(F.struct("region", "offset", "length")).alias("at")).where("n = 1").drop("n")
    side = lambda c: named.select("program", F.col("name").alias(c), F.col("at").alias(f"{c}_at"))
    same = moves.where("whole AND source <> target").join(side("source"), ["program", "source"]).join(side("target"), ["program", "target"])
    a, b = F.col("source_at"), F.col("target_at")
    same = same.where((a["region"] == b["region"]) & (a["offset"] < b["offset"] + b["length"]) & (b["offset"] < a["offset"] + a["length"]))
    mixed = overlays(storage).where("ambiguous")
    views = mixed.select("program", F.col("first").alias("source")).union(mixed.select("program", F.col("second"))).distinct()
    out = ["program", "seq", "line", "source", "target"]
    return same.select(*out, F.lit("operands overlap").alias("reason")).union(moves.join(views, ["program", "source"], "left_semi").select(*out, F.lit("other kind stored")))
