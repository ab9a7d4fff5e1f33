"""Chat formatting: multi-party perspective rotation, in native expressions only.

Every participant of a conversation gets a rendering in which the own turns are the
assistant's, all others' are those of named users, and system turns stay. Its mask is the list of
spans (code points, end exclusive) of the own turns' texts and end marks, the part a loss counts.

A rendering is cut into segments of ``SEGMENT`` turn numbers (ordinary conversations have one), and a segment of more than ``MOST`` turns (repeated or
null numbers) into parts of ``MOST`` in their order, so a row is bounded whatever a conversation holds. Parts are
numbered without one task seeing a whole segment: a range-partitioned sort, in which equal turns may be dealt anywhere, and counts of its partitions. Each
later segment or part begins with the system turns of the conversation's first one; they count in no mask and not in ``n_turns``. The participants are those of the
whole conversation, also in segments where they are silent.

Results for odd input: a null text is empty, a null or empty role is the speaker ``unknown``, a null turn
comes first (segment -1), null conversation ids are one conversation; repeated rows are
rendered each, in the order of turn, speaker, text; control marks inside texts and names are
escaped; a conversation with system turns only has no participant and gives no row; an empty
table gives an empty one; other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Turn numbers of a segment; turns of a part; the role that is no participant.
SEGMENT, MOST, SYSTEM = 512, 2048, "system"
#: Marks of the template.
START, END = "<|start|>", "<|end|>"


def _escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    """Equal keys, null ones too."""
    out = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        out = out & a[k].eqNullSafe(b[k])
    return out


def with_parts(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (``c``, ``segment``, ``t``) with ``part``: which ``most`` turns of its segment, in order, a row is among."""
    long = written(rows.groupBy("c", "segment").agg(F.count("*").alias("n")).where(F.col("n") > most).select("c", "segment"), "long")
    if long.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long"))
    same = _same(rows, long, "c", "segment")
    order = [F.col("c"), F.col("segment"), F.col("t.turn"), F.col("t.speaker"), F.col("t.text"), F.col("salt")]  # equal turns may go to any place
    hot = rows.join(long, same, "left_semi").withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = hot.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("c", "segment", "t", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"))
    placed = written(placed, "placed")
    counts = placed.groupBy("c", "segment", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c", "segment").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.withColumn("before", before), "placecounts")
    known = placed.join(counts.select("c", "segment", "task", "first", "before"), _same(placed, counts, "c", "segment", "task"))
    numbered = known.select(placed["c"], placed["segment"], placed["t"], F.floor((F.col("before") + F.col("at") - F.col("first")) / most).cast("long").alias("part"))
    return numbered.unionByName(rows.join(long, same, "left_anti").withColumn("part", F.lit(0).cast("long")))


def with_heads(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """``parts`` with ``head``: the system turns of the conversation's first part, in all later ones (else empty)."""
    none = F.array().cast(parts.schema["turns"].dataType)
    place = F.struct("segment", "part")
    spans = written(rows.groupBy("c").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("c", "first.*"), "spans")
    if spans.isEmpty():
        return parts.withColumn("head", none)
    system = rows.where(F.col("t.speaker") == SYSTEM)
    heads = system.join(spans, _same(system, spans, "c", "segment", "part"), "left_semi").groupBy("c").agg(F.array_sort(F.collect_list("t")).alias("own_head"), F.max(place).alias("of"))
    heads = heads.withColumnRenamed("c", "hc")
    later = F.col("c").eqNullSafe(F.col("hc")) & (place > F.col("of"))
    return parts.join(heads, later, "left").select(*parts.columns, F.coalesce("own_head", none).alias("head"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT, most: int = MOST) -> DataFrame:
    """``conv``, ``perspective``, ``segment``, ``part``, ``n_turns``, ``n_own``, ``rendered``, ``mask``."""
    speaker = F.coalesce(F.when(F.col(role) != "", _escaped(F.replace(F.replace(F.col(role), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" ")))), F.lit("unknown"))
    rows = turns.select(
        F.col(conv).alias("c"), F.coalesce(F.floor(F.col(turn) / segment), F.lit(-1)).cast("long").alias("segment"),
        F.struct(F.col(turn).cast("long").alias("turn"), speaker.alias("speaker"), _escaped(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("t"),
    )
    people = rows.where(F.col("t.speaker") != SYSTEM).select(F.col("c").alias("pc"), F.col("t.speaker").alias("perspective")).distinct()
    rows = with_parts(rows, most)
    parts = with_heads(rows.groupBy("c", "segment", "part").agg(F.array_sort(F.collect_list("t")).alias("turns")), rows)
    both = parts.join(people, F.col("c").eqNullSafe(F.col("pc")))

    def header(t: Column) -> Column:
        name = F.when(t["speaker"] == F.col("perspective"), F.lit("assistant")).when(t["speaker"] == SYSTEM, F.lit("system")).otherwise(F.concat(F.lit("user name="), t["speaker"]))
        return F.concat(F.lit(START), name, F.lit("\n"))

    pieces = F.transform(F.concat("head", "turns"), lambda t: F.struct(header(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["speaker"] == F.col("perspective")).alias("own")))
    both = both.withColumn("pieces", pieces)

    def step(state: Column, p: Column) -> Column:
        a = state["at"] + F.length(p["head"])
        b = a + F.length(p["body"])
        span = F.concat_ws(":", a.cast("string"), b.cast("string"))
        return F.struct((b + 1).alias("at"), F.when(p["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    mask = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")), step, lambda s: F.array_join(s["spans"], ","))
    return both.select(
        F.col("c").alias(conv), "perspective", "segment", "part", F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"), mask.alias("mask"),
    )


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every conversation from each participant's perspective."""
    return rotate(table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(CAST(floor(turn / 512.0) AS BIGINT), -1) AS segment, turn,
    CASE WHEN role <> '' THEN replace(replace(replace(role, chr(10), ' '), chr(13), ' '), '<|', '<\\|') ELSE 'unknown' END AS speaker,
    replace(coalesce(text, ''), '<|', '<\\|') AS text
  FROM conversations
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn NULLS FIRST, speaker, text) - 1) // 2048 AS part FROM t
), s AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY segment, part) = 1 AS is_first FROM (SELECT DISTINCT conv_id, segment, part FROM r)
), u AS (
  SELECT conv_id, segment, part, 1 AS own_row, turn, speaker, text FROM r
  UNION ALL SELECT l.conv_id, l.segment, l.part, 0, r.turn, r.speaker, r.text
  FROM s l JOIN s a ON a.conv_id IS NOT DISTINCT FROM l.conv_id AND a.is_first JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.segment = a.segment AND r.part = a.part
  WHERE NOT l.is_first AND r.speaker = 'system'
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), b AS (
  SELECT u.*, p.perspective, u.speaker = p.perspective AS own,
    '<|start|>' || CASE WHEN u.speaker = p.perspective THEN 'assistant' WHEN u.speaker = 'system' THEN 'system' ELSE 'user name=' || u.speaker END || chr(10) AS head,
    u.text || '<|end|>' AS body
  FROM u JOIN p ON u.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, perspective, segment, part ORDER BY own_row, turn NULLS FIRST, speaker, text) AS k FROM b
), a AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, segment, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos FROM o
)
SELECT conv_id, perspective, segment, CAST(part AS BIGINT) AS part, CAST(count(*) FILTER (WHERE own_row = 1) AS BIGINT) AS n_turns, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_own,
  string_agg(head || body || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg(CAST(pos AS BIGINT) || ':' || CAST(pos + length(body) AS BIGINT), ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM a GROUP BY conv_id, perspective, segment, part
"""
