"""Live verification: record files are compared as they arrive.

``compare_stream`` holds one stream of produced files against a table. ``verify_stream`` takes two streams: records wait in keyed state until
their other side arrives, in any order and however far apart, or until they have waited long enough and are reported as missing from the other side.

State is kept for blocks of neighbouring records, so a task pairs an Arrow batch at a time and the state store has an entry a block, not a record. Comparing is
stateless and the same expressions as in a batch (``diff.judged``).

* A record that comes again as it was counts once, whether its other side has come or not; it is remembered as long as a record waits.
* An unlike record of the same number is surplus: its own ``length_mismatch``. Of several the first to come is paired.
* A record that comes after its other side was given up is reported, too; ``settled`` pairs the two reports and compares them, so
  nothing that ever arrived is judged missing.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.plans import diff
from tallyframe.sources import records
from tallyframe.sources.layout import Layout, decoded

#: Records (or bytes, where numbers are offsets) of a block of state.
BLOCK = 4_096
#: Seconds after which a block that waits is looked at again.
TICK = 60
FEED = "_file string, record bigint, event string, side string, message string, held string"
_PAIRED = "_file string, _rec bigint, p string, e string"
_STATE = "rec array<bigint>, p array<string>, e array<string>, at array<bigint>, done array<boolean>"


def arriving(spark: SparkSession, path: str, layout: Layout, separator: str = "auto") -> DataFrame:
    """A stream of a folder's record files, decoded; ``_rec`` is the byte offset in ``_file``, a file's name."""
    raw = records.arriving(spark, path, layout.record_length, separator)
    named = raw.withColumn("_file", F.regexp_extract("file", "([^/]+)$", 1)).withColumnRenamed("offset", "_rec")
    return decoded(named, layout, number="_rec", keep=("_file",))


def compare_stream(stream: DataFrame, expected: DataFrame, fields: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch against the expected records of its files, so a file's records that did not come are missing at its end (files arrive whole; what
    never arrives at all: ``missing_files``). Where ``expected`` has no ``_file``, against those of its numbers: only ``verify_stream`` finds what is missing then.
    The events of a batch are appended to ``out`` as Parquet under the batch's id, so a repeated batch replaces its own rows."""
    named = "_file" in expected.columns
    keys = ("_file", "_rec") if named else ("_rec",)

    def batch(df: DataFrame, number: int) -> None:
        here = df.select("_file").distinct() if named else df.select("_rec")
        wanted = expected.join(here, here.columns, "left_semi")
        diff.events(diff.outcomes(df, wanted, fields, keys=keys)).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """Counts of the feed's events so far."""
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").where("event <> 'complete'").groupBy("event").count()


def missing_files(expected: DataFrame, arrived: DataFrame) -> DataFrame:
    """``_file`` and ``records`` of expected files of which nothing has come."""
    return expected.groupBy("_file").agg(F.count("*").alias("records")).join(arrived.select("_file").distinct(), "_file", "left_anti")


def _digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def _pairing(wait_ms: int, tick_ms: int):
    """What a group of a block's records does with its state."""

    def pair(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        # number to [produced, expected, when last seen, whether both were seen: then their digests only]
        held = {r: [p, e, at, done] for r, p, e, at, done in zip(*state.get, strict=True)} if state.exists else {}
        out: list[tuple] = []
        if not state.hasTimedOut:
            for frame in frames:
                for rec, side, text in zip(frame["_rec"].tolist(), frame["_side"].tolist(), frame["_text"].tolist(), strict=True):
                    mine = held.setdefault(rec, [None, None, now, False])
                    mine[2] = now
                    if mine[3]:
                        if mine[side] != _digest(text):
                            out.append((rec, text if side == 0 else None, text if side == 1 else None))
                    elif mine[side] is None:
                        mine[side] = text
                        if mine[1 - side] is not None:
                            out.append((rec, mine[0], mine[1]))
                            mine[0], mine[1], mine[3] = _digest(mine[0]), _digest(mine[1]), True
                    elif mine[side] != text:
                        out.append((rec, text if side == 0 else None, text if side == 1 else None))
        for rec in [r for r, mine in held.items() if mine[2] + wait_ms <= now]:
            p, e, _, done = held.pop(rec)
            if not done:
                out.append((rec, p, e))
        if held:
            state.update((list(held), *([mine[k] for mine in held.values()] for k in range(4))))
            state.setTimeoutDuration(min(tick_ms, max(1, min(mine[2] for mine in held.values()) + wait_ms - now)))
        else:
            state.remove()
        if out:
            yield pd.DataFrame({"_file": key[0], "_rec": [x[0] for x in out], "p": [x[1] for x in out], "e": [x[2] for x in out]})

    return pair


def paired(produced: DataFrame, expected: DataFrame, fields: Sequence[str], wait_ms: int, block: int = BLOCK, tick_ms: int = TICK * 1000) -> DataFrame:
    """Two streams (with ``_rec`` and, for several files, ``_file``) as one of ``_file``, ``_rec``, ``p`` and ``e``, the sides' records as texts (null: it didn't come)."""

    def side(df: DataFrame, k: int) -> DataFrame:
        file = F.col("_file") if "_file" in df.columns else F.lit("")
        return df.select(file.alias("_file"), F.col("_rec").cast("bigint").alias("_rec"), F.lit(k).alias("_side"), F.to_json(diff.sided(df, fields), {"ignoreNullFields": "false"}).alias("_text"))

    both = side(produced, 0).unionByName(side(expected, 1)).withColumn("_block", F.floor(F.col("_rec") / block))
    return both.groupBy("_file", "_block").applyInPandasWithState(_pairing(wait_ms, tick_ms), _PAIRED, _STATE, "append", "ProcessingTimeTimeout")


def _texts(fields: Sequence[str]) -> str:
    values = ", ".join(f"v{k}: string" for k in range(len(fields)))
    return f"struct<values: struct<{values}>, abends: array<struct<field: string, value: string>>, error: string>"


def _feed(pairs: DataFrame, fields: Sequence[str], edited: Sequence[str]) -> DataFrame:
    """The events of paired texts; ``held`` keeps the text of a record whose other side is missing."""
    kept = ("_file", "_rec", "_held")
    read = pairs.select("_file", "_rec", F.when(F.col("p").isNull() | F.col("e").isNull(), F.coalesce("p", "e")).alias("_held"), *(F.from_json(n, _texts(fields)).alias(n) for n in "pe"))
    found = diff.judged(read, fields, edited, kept)
    side = F.when(~F.col("e_here"), "produced").when(~F.col("p_here"), "expected")
    return found.select("_file", "record", diff.event_of().alias("event"), side.alias("side"), diff.message_of().alias("message"), F.col("_held").alias("held"))


def verify_stream(produced: DataFrame, expected: DataFrame, fields: Sequence[str], out: str, checkpoint: str, wait: float = 3600, edited: Sequence[str] = (), block: int = BLOCK, every: str = "10 seconds", tick: float = TICK) -> StreamingQuery:
    """Run two streams against each other; the feed (``FEED``) is appended to ``out``, each event once, also over restarts from ``checkpoint``.
    A record whose other side has not come ``wait`` seconds after it is a ``length_mismatch`` with its ``side``, and leaves the state. Blocks that wait are looked at every ``tick`` seconds at least, so another ``wait`` after a restart holds for them, too. After a restart
    Spark makes its first batch, and so looks at timers, when something new arrives."""
    feed = _feed(paired(produced, expected, fields, max(1, int(wait * 1000)), block, max(1, int(tick * 1000))), fields, edited)
    return feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def until_settled(query: StreamingQuery, most: float = 600) -> None:
    """Wait until all that has arrived is read and no state is left, then stop the query."""
    end, last, idle = time.time() + most, -1, 0  # the first batch of a restart may be an old, empty one
    try:
        while True:
            p = query.lastProgress
            if p and p["batchId"] != last:
                last = p["batchId"]
                idle = idle + 1 if p["numInputRows"] == 0 and all(s["numRowsTotal"] == 0 for s in p["stateOperators"]) else 0
                if idle == 2:
                    return
            if not query.isActive:
                raise query.exception() or RuntimeError("the query was stopped")
            if time.time() > end:
                raise TimeoutError(f"records still wait after {most} s")
            time.sleep(0.2)
    finally:
        query.stop()


def settled(spark: SparkSession, out: str, fields: Sequence[str], edited: Sequence[str] = ()) -> DataFrame:
    """The feed so far, with late records judged: where both sides of a number were reported missing from the other, at different times, they are compared after all.
    Of several reports of one number the k-th of one side meets the k-th of the other, by their texts."""
    feed = spark.read.schema(FEED).parquet(out)
    alone = feed.where("event = 'length_mismatch'")
    sides = [alone.where(F.col("side") == s).select("_file", F.col("record").alias("_rec"), F.col("held").alias(n)) for s, n in (("produced", "p"), ("expected", "e"))]
    # numbers reported from both sides are few: only those are ranked
    twice = sides[0].select("_file", "_rec").join(sides[1].select("_file", "_rec"), ["_file", "_rec"], "left_semi").distinct()
    ranked = [s.join(twice, ["_file", "_rec"]).withColumn("k", F.row_number().over(Window.partitionBy("_file", "_rec").orderBy(n))) for s, n in zip(sides, "pe", strict=True)]
    late = _feed(ranked[0].join(ranked[1], ["_file", "_rec", "k"], "full_outer").drop("k"), fields, edited)
    once = alone.join(twice.withColumnRenamed("_rec", "record"), ["_file", "record"], "left_anti").select(feed.columns)
    return feed.where("event <> 'length_mismatch'").unionByName(once).unionByName(late)


def summary(feed: DataFrame) -> DataFrame:
    """One row of a feed: ``total``, ``matches``, ``mismatches`` (records), ``missing`` (from produced) and ``surplus`` (not expected)."""
    n = lambda test: F.count_if(F.expr(test))
    return feed.select(F.count("*").alias("total"), n("event = 'match'").alias("matches"), n("event <> 'match'").alias("mismatches"), n("side = 'expected'").alias("missing"), n("side = 'produced'").alias("surplus"))
