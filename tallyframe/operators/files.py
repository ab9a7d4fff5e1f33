"""File access verbs as relational operations over rows with a record number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: File status codes.
OK, AT_END, DUPLICATE, NOT_FOUND, NO_FILE = "00", "10", "22", "23", "35"


def read_by_key(requests: DataFrame, file: DataFrame, key: str) -> DataFrame:
    """READ KEY IS: each request with the file's record of its key (the first in file order) and ``status``. Spark broadcasts the
    file only if it is small."""
    first = file.groupBy(key).agg(F.min_by(F.struct(*[c for c in file.columns if c != key]), "_rec").alias("_found"))
    out = requests.join(first, key, "left")
    return out.select(*requests.columns, F.col("_found.*"), F.when(F.col("_found").isNull(), NOT_FOUND).otherwise(OK).alias("status")) if len(file.columns) > 1 else out


def start(file: DataFrame, test: Column) -> DataFrame:
    """START: one row, the number of the first record in file order that satisfies the test, and ``status``."""
    return file.where(test).agg(F.min("_rec").alias("position")).select("position", F.when(F.col("position").isNull(), NOT_FOUND).otherwise(OK).alias("status"))


def read_next(file: DataFrame, position: DataFrame) -> DataFrame:
    """READ NEXT from a position on: the remaining records in order; the last one has the status that the next READ gets."""
    rest = file.join(F.broadcast(position.select("position")), F.col("_rec") >= F.col("position")).drop("position")  # one row
    last = rest.agg(F.max("_rec").alias("_last"))
    return rest.join(F.broadcast(last)).select(*file.columns, F.when(F.col("_rec") == F.col("_last"), AT_END).otherwise(OK).alias("next_status"))


def next_record(file: DataFrame, partition: str, value: str) -> DataFrame:
    """The following record's value within a partition."""
    return file.withColumn("next_value", F.lead(value).over(Window.partitionBy(partition).orderBy("_rec")))


def delete(file: DataFrame, deleted: DataFrame) -> DataFrame:
    return file.join(deleted.select("_rec").distinct(), "_rec", "left_anti")


def rewrite(file: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """REWRITE: rows of ``changes`` (at most one for each key) replace the values of the file's rows with their key."""
    others = [c for c in changes.columns if c != key]
    new = changes.select(key, F.struct(*others).alias("_new"))
    out = file.join(new, key, "left")
    return out.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in others else F.col(c) for c in file.columns))


def relative(file: DataFrame, requests: DataFrame) -> DataFrame:
    """Relative files by 1-based ``slot``: requests (``slot``, ``verb`` WRITE, REWRITE, DELETE or READ, ``data``; one for each slot)
    merged with the file (``slot``, ``data``): the new ``data`` (null: free), and ``status``."""
    a, b = file.select("slot", F.col("data").alias("old"), F.lit(True).alias("used")), requests.select("slot", "verb", F.col("data").alias("new"))
    out = a.join(b, "slot", "full_outer")
    used, verb = F.coalesce("used", F.lit(False)), F.col("verb")
    status = F.when(verb.isNull(), None).when((verb == "WRITE") & used, DUPLICATE).when((verb != "WRITE") & ~used, NOT_FOUND).otherwise(OK)
    data = F.when((verb == "WRITE") & ~used, F.col("new")).when((verb == "REWRITE") & used, F.col("new")).when((verb == "DELETE") & used, None).otherwise(F.col("old"))
    return out.select("slot", verb.alias("verb"), data.alias("data"), status.alias("status"))


def advancing(line: Column, lines: int | str = 1, before: bool = False) -> Column:
    """WRITE ... ADVANCING: line feeds (or a form feed for PAGE) after (BEFORE) or ahead of (AFTER) the line."""
    feed = F.lit("\f" if lines == "PAGE" else "\n" * int(lines))
    return F.concat(line, feed) if before else F.concat(feed, line)


def write_records(rows: DataFrame, fields: list[tuple[str, int]]) -> DataFrame:
    """WRITE: rows as fixed-width text records."""
    return rows.select("_rec", F.concat(*(F.rpad(F.substring(F.col(c).cast("string"), 1, n), n, " ") for c, n in fields)).alias("line"))
