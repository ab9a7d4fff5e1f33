"""Mixing sources to target weights by capped water-filling, all in native expressions.

Targets: with sizes S and weights w, source i gets min(cap * S_i, level * w_i), where the
level makes the targets add up to the whole. Sources sorted by cap * S / w are clamped
from the front until the level of the rest is at most the next one's ratio; that is one pass of
sums over the sources.

Repetitions: target / S = e epochs give each document floor(e) whole repetitions; the rest
of the target is filled with the documents that come first in the order of a seeded hash of id and text.
Where that order reaches the rest is found by narrowing the hash, digits at a time:
sums by (source, prefix), the prefix that crosses the rest, then only its rows. No step
needs a source's rows in one task, so one source may hold most of the corpus. Rows of one hash are one text under one id, however
many: as many of them are taken as come nearest to the rest, in the order of a hash of where they lie in the table that was written
once. So a source's taken words differ from its target by half a document's at most.

Results for odd input: a null source is a source, the last in order; null texts have size 0; a
source of size 0 has target 0; rows of one id with other texts, and rows without an id, are chosen each; of equal rows
a number is chosen, and which doesn't show; an empty table gives an empty one; other columns pass through ``mix`` and are neither
read nor returned by ``taken``; names beginning with ``__mix_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.sources.records import prefix_sums

from .common import WORD, table, word_count, written

CAP, WEIGHTS, SEED = 3, (1, 2, 3), "mix-1"
#: Hex digits by which each step narrows a hash: up to 4096 sums for each source.
DIGITS = 3
#: Sources up to which their table is sent to all executors; beyond, it is joined by a shuffle.
SMALL = 10_000


def hash_of(id_: Column, text: Column, seed: str = SEED) -> Column:
    """32 hex digits of id and text: rows of one hash are copies."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def targets(sizes: DataFrame, cap: int = CAP, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from ``source``, ``source_size`` (one row each, a written table).
    Weights repeat over the sources in order of code points, null last. Ranks and running sums are prefix sums, so sources may be many."""
    named = sizes.withColumn("__none", F.col("source").isNull()).withColumn("__one", F.lit(1).cast("bigint"))
    w = F.get(F.array(*map(F.lit, weights)), F.pmod(F.col("__rank"), F.lit(len(weights))).cast("int")).cast("long")
    weighed = written(prefix_sums(named, ["__none", "source"], "__one", "__rank").withColumn("weight", w).select("source", "source_size", "weight", "__none"), "weights")
    ratio = (F.lit(cap) * F.col("source_size") / F.col("weight")).cast("double")
    ordered = weighed.withColumn("ratio", ratio)
    first = ["ratio", "__none", "source"]
    ordered = prefix_sums(prefix_sums(ordered, first, "source_size", "__size"), first, "weight", "__weight")
    size, weight = sizes.agg(F.sum("source_size")).first()[0] or 0, weighed.agg(F.sum("weight")).first()[0] or 0
    level = (F.lit(size) - cap * F.col("__size")).cast("double") / (F.lit(weight) - F.col("__weight")).cast("double")
    # the first source that isn't clamped sets the level of all that follow; with none, all are clamped
    open_ = ordered.withColumn("level", level).where("ratio >= level").agg(F.min(F.struct(*first, "level"))["level"]).first()[0]
    most = (F.lit(cap) * F.col("source_size")).cast("double")
    return weighed.select("source", "source_size", "weight", (most if open_ is None else F.least(most, F.lit(open_) * F.col("weight"))).alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def crossing(rows: DataFrame, at: DataFrame) -> DataFrame:
    """A written table of ``s``, ``key``, ``rest``, ``n``, ``m``: for each source ``s`` of ``at`` the key of ``rows`` (``source``, ``size`` above 0, ``key`` of hex digits) at which the sum of sizes
    in the order of keys reaches ``rest`` (above 0, at most all), what of ``rest`` is left for that key, its rows' size and their number."""
    open_ = written(at.select(F.col("source").alias("s"), "rest", F.lit("").alias("prefix")), "open")
    for step in range(3):
        length = DIGITS * (step + 1)
        inside = rows.join(_small(open_), _same(F.col("source"), F.col("s")) & F.col("key").startswith(F.col("prefix")))
        key = F.substring("key", 1, length) if step < 2 else F.col("key")
        sums = inside.groupBy("s", "rest", key.alias("p")).agg(F.sum("size").alias("n"), F.count("*").alias("m"))
        upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("p")))
        # sums of doubles and whole numbers may miss the last key by a rounding
        cross = upto.groupBy("s").agg(F.min_by(F.struct("p", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest"), "n", "m"), F.struct(F.col("upto") < F.col("rest"), F.when(F.col("upto") >= F.col("rest"), F.col("p")), F.col("rest") - F.col("upto"))).alias("c"))
        open_ = written(cross.select("s", F.col("c.p").alias("prefix"), "c.rest", "c.n", "c.m"), "open")
    return open_.withColumnRenamed("prefix", "key")


def plan(docs: DataFrame, cap: int = CAP, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """A written table, a row for each source: ``source``, ``source_size``, ``weight``, ``target``, ``whole`` (repetitions of each
    document), ``cut``: documents whose hash is below this are taken once more (null: none), and of the ``m`` documents that have it ``k``.
    ``docs`` is a written table of ``source``, ``size`` and ``hash``."""
    sizes = written(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    whole = F.least(F.lit(cap), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).cast("int")
    known = written(targets(sizes, cap, weights).withColumn("whole", whole), "targets")
    rest = known.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).where("rest > 0").select("source", "rest")
    found = crossing(docs.where("size > 0").select("source", "size", F.col("hash").alias("key")), rest)
    # the number of copies that comes nearest (ties: the smaller)
    k = F.least(F.col("m"), F.greatest(F.lit(0), F.ceil(F.col("rest") / (F.col("n") / F.col("m")) - 0.5))).cast("bigint")
    found = found.select("s", F.col("key").alias("cut"), k.alias("k"), "m")
    return written(known.join(_small(found), _same(F.col("source"), F.col("s")), "left").select("source", "source_size", "weight", "target", "whole", "cut", "k", "m"), "mix")


def chosen(copies: DataFrame, by_source: DataFrame) -> DataFrame:
    """``s`` and ``last``: of ``copies`` (a written table of ``source`` and ``place``, rows of sources whose cut takes only some of its documents) those whose hashed place is at most ``last`` are taken."""
    some = by_source.where("k > 0 AND k < m").select("source", F.col("k").cast("double").alias("rest"))
    rows = copies.select("source", F.lit(1).cast("bigint").alias("size"), _place("place").alias("key"))
    return crossing(rows, some).select("s", F.col("key").alias("last"))


def _place(name: str) -> Column:
    return F.md5(F.col(name).cast("string"))


def _small(sources: DataFrame) -> DataFrame:
    """A table of sources, sent to all executors if it is small enough."""
    return F.broadcast(sources) if sources.limit(SMALL + 1).count() <= SMALL else sources


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """A written table of ``id``, ``source``, ``size``, ``hash`` and ``place``: the texts are read once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), hash_of(F.col(id_col), F.col(text_col), seed).alias("hash"))
    return written(rows.withColumn("place", F.monotonically_increasing_id()), "sizes")


def _once_more(has_words: Column, hash_: Column) -> Column:
    """Whether a document is taken beyond the whole repetitions: null where that hangs on its place among copies. Documents without words are not."""
    cut, k = F.col("__mix_cut"), F.col("__mix_k")
    at_cut = F.when(k == F.col("__mix_m"), True).when(k == 0, False)
    return F.when(~has_words | cut.isNull() | (hash_ > cut), False).when(hash_ < cut, True).otherwise(at_cut)


def _planned(rows: DataFrame, by_source: DataFrame, source: Column) -> DataFrame:
    small = by_source.select(*(F.col(c).alias(f"__mix_{c}") for c in ("source", "source_size", "target", "whole", "cut", "k", "m")))
    return rows.join(_small(small), _same(source, F.col("__mix_source")))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, weights: Sequence[int] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """For every row ``id_col``, ``size``, ``source_size``, ``target``, ``taken`` (words) and ``repetitions``."""
    known = sized(docs, id_col, text_col, source_col, seed)
    by_source = plan(known, cap, weights)
    out = _planned(known, by_source, known["source"]).withColumn("__mix_more", _once_more(F.col("size") > 0, F.col("hash")))
    if not by_source.where("k > 0 AND k < m").isEmpty():
        last = chosen(out.where("__mix_more IS NULL").select("source", "place"), by_source)
        out = out.join(_small(last), _same(F.col("source"), F.col("s")), "left").withColumn("__mix_more", F.coalesce("__mix_more", _place("place") <= F.col("last")))
    n = F.col("__mix_whole") + F.col("__mix_more").cast("int")
    return out.select(F.col("id").alias(id_col), "size", F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (n * F.col("size")).cast("long").alias("taken"), n.alias("repetitions"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, weights: Sequence[int] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """``docs``, each row as often as the mix takes it."""
    by_source = plan(sized(docs, id_col, text_col, source_col, seed), cap, weights)
    hashed = _planned(docs, by_source, docs[source_col].cast("string")).withColumn("__mix_more", _once_more(F.coalesce(docs[text_col].rlike(WORD), F.lit(False)), hash_of(docs[id_col], docs[text_col], seed)))
    names = docs.columns
    if not by_source.where("k > 0 AND k < m").isEmpty():
        # copies of which some are taken are written with their places; no other text is
        copies = written(hashed.where("__mix_more IS NULL").withColumn("__mix_place", F.monotonically_increasing_id()), "copies")
        last = chosen(copies.select(F.col("__mix_source").alias("source"), F.col("__mix_place").alias("place")), by_source)
        told = copies.join(_small(last), _same(F.col("__mix_source"), F.col("s")), "left").withColumn("__mix_more", _place("__mix_place") <= F.col("last"))
        hashed = hashed.where("__mix_more IS NOT NULL").select(*names, "__mix_whole", "__mix_more").unionByName(told.select(*names, "__mix_whole", "__mix_more"))
    out = hashed.withColumn("__mix_n", F.col("__mix_whole") + F.col("__mix_more").cast("int")).where("__mix_n > 0")
    return out.select(*names, F.explode(F.sequence(F.lit(1), F.col("__mix_n"))).alias("__mix_rep")).drop("__mix_rep")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: what the mix takes of every document."""
    return taken(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS hash
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
), r AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM s
), l AS (
  SELECT *, CAST((SELECT sum(source_size) FROM s) - 3 * coalesce(sum(source_size) OVER w, 0) AS DOUBLE) / CAST((SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS DOUBLE) AS lv
  FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), coalesce((SELECT lv FROM l WHERE ratio >= lv ORDER BY ratio, source NULLS LAST LIMIT 1) * weight, CAST(3 * source_size AS DOUBLE))) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.source, d.hash, CAST(sum(d.size) AS BIGINT) AS n, count(*) AS m, CAST(sum(sum(d.size)) OVER (PARTITION BY d.source ORDER BY d.hash) AS BIGINT) AS upto, any_value(e.target - e.whole * e.source_size) AS rest
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source WHERE d.size > 0 GROUP BY d.source, d.hash
), best AS (
  SELECT source, hash AS cut, least(m, greatest(0, ceil((rest - (upto - n)) / (n / m) - 0.5))) AS k FROM c WHERE rest > 0 AND upto >= rest
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY hash) = 1
), o AS (
  SELECT *, row_number() OVER (PARTITION BY source, hash) AS copy FROM d
), p AS (
  SELECT o.doc_id, o.size, e.source_size, e.target, e.whole + CASE WHEN o.size > 0 AND (o.hash < b.cut OR o.hash = b.cut AND o.copy <= b.k) THEN 1 ELSE 0 END AS reps
  FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source LEFT JOIN best b ON o.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, CAST(size * reps AS BIGINT) AS taken, CAST(reps AS INTEGER) AS repetitions FROM p
"""
