"""Shared helpers: scratch tables in the cluster's shared folder, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[^\x20\x09-\x0D]+`` words: what separates them, for Spark's and Python's regular expressions.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local run (tests) gets a new one; on a cluster
    there is none to guess, and that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Scratch tables made inside ``scratch`` blocks, innermost last.
_made: list[list[str]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: cuts the
    lineage, survives the loss of an executor, and is computed once however often it is read. It stays until the ``scratch`` block around
    it ends, or ``drop``."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    if _made:
        _made[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["scratch"] = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` inside go when the block ends: what is made from them must be written by then."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            remove(spark, path)


def drop(*tables: DataFrame) -> None:
    """Delete ``written`` tables that nothing reads any more."""
    for t in tables:
        if path := t.__dict__.pop("scratch", None):
            remove(t.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through the file system that holds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Keys at most whose rows are looked up where they are.
HOT = 10_000


def join_known(left: DataFrame, right: DataFrame, key: str, n: str = "n", how: str = "inner") -> DataFrame:
    """The join (``how``: inner or left) of ``left`` (read twice) with ``right``, a written table of one row for each key and ``n``, the rows of ``left`` that have it. Keys of at
    least one in ``HOT`` rows, so at most ``HOT`` keys, are sent to all executors; the others' rows are shuffled. So no key's rows meet in one task."""
    total = right.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) * HOT >= total
    values = [c for c in right.columns if c not in (key, n)]
    some = left.join(F.broadcast(right.where(often).select(key, *values, F.lit(True).alias("__often"))), key, "left")
    seldom = some.where(F.col("__often").isNull()).select(*left.columns).join(right.where(~often).select(key, *values), key, how)
    return some.where(F.col("__often")).select(key, *(c for c in left.columns if c != key), *values).unionByName(seldom)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that are Python values at once.
SLICE = 2 << 20


def slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``size`` bytes."""
    step = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a schema in words (needs a session: not in tasks)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def arrow_map(df: DataFrame, schema, rows: Callable[[dict], dict | Iterable[dict]]) -> DataFrame:
    """``mapInArrow`` over slices of batches as Python columns: ``rows`` takes a dict of lists and
    returns a dict of lists with the names of ``schema`` (of any common length)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = arrow_schema(schema) if isinstance(schema, str) else to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = rows({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


_held: dict = {}


def remembered(key, make: Callable):
    """What ``make`` returned for this key in this worker process. One thing is held at a time: a worker that
    goes on with another operator gives up the former one's tables."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def first_rows(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row of each of ``keys``, with the ``text`` of the smallest hash, then smallest: tasks keep one row a key before anything is shuffled, so a key may
    have any number of rows."""
    return rows.groupBy(*keys).agg(F.min_by(text, F.struct(F.xxhash64(text), F.col(text))).alias(text))


def held_out(id_col) -> F.Column:
    """Rows of the third on which models are measured and that they are never fitted on; rows without an id aren't in it."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def word_count(text) -> F.Column:
    """Number of words of ``text`` as a native expression (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def version(id_: F.Column, text: F.Column) -> F.Column:
    """A key that is never null, the same for rows of equal id (null is one, too) and equal text only (128 bits of hashes)."""
    return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("null")), F.xxhash64(text).cast("string"), F.xxhash64(F.lit("again"), text).cast("string"))


#: Bits of one bitmap of Spark's bitmap functions, and the most bitmaps that are sent to all executors (8 MB).
BITMAP, BITMAPS = 32_768, 2_048


def split_by_ids(docs: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two parts: rows that may have one of ``ids`` (one column, a written table), and rows that certainly
    have none. A join with the first part alone spares the others' texts a shuffle.

    The test is a bitmap of hashed ids, 16 bits for each id up to 8 MB in all; it has false hits, never
    misses, so a larger set of ids only makes the first part larger."""
    name = ids.columns[0]
    n = ids.count()
    buckets = 1
    while buckets < BITMAPS and buckets * BITMAP < 16 * n:
        buckets *= 2
    place = lambda c: F.pmod(F.xxhash64(c, F.lit("ids")), F.lit(buckets * BITMAP))
    maps = ids.select(place(F.col(name)).alias("h")).groupBy(F.expr(f"h div {BITMAP}").alias("__bucket")).agg(F.expr(f"bitmap_construct_agg(h % {BITMAP})").alias("__bits"))
    maps = written(maps, "bitmaps")  # at most BITMAPS rows of 4 kB
    h = place(docs[id_col])
    flagged = docs.withColumn("__h", h).withColumn("__bucket", F.expr(f"__h div {BITMAP}")).join(F.broadcast(maps), "__bucket", "left")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.expr(f"__h % {BITMAP} div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(__byte, cast(__h % 8 as int))").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    flagged = flagged.withColumn("__byte", byte).withColumn("__hit", hit).select(*docs.columns, "__hit")
    return flagged.where("__hit").drop("__hit"), flagged.where("NOT __hit").drop("__hit")
