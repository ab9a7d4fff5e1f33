"""Token-ID output in training order: fixed-stride binary shards.

Sequences of ``length`` ids are packed in the order of the input's partitions; only the last one of a partition is padded. Ids are a
column of lists (a tokenizer's, in 1, 2 or 4 bytes each, little-endian) or, without one, a text's own UTF-8 bytes. The two highest values of
the width are marks (END ends a text, PADDING fills up); valid UTF-8 has neither byte, and a list with an id as high fails the run. A keyed Feistel network
over the next even power of two, walked until it lands below the number of sequences,
permutes them: every sequence has a global slot, known from its number alone and back. A
slot's shard is ``slot // shard``; each shard is written by one task, in slot order, as
records of one stride (slot, number of ids, ids, a line feed), so a reader seeks to any
slot and goes on from there. Shards grow with the corpus, so that there are never more than ``SHARDS``.

The shuffle carries compressed records and is dealt by shard number; the slots are dense, so all shards
but the last are equally large whatever the texts are. The input must give the same partitions each time it is read (a
file scan does); a checksum of every partition's ids and lengths fails the run otherwise.

Results for odd input: a null or empty text or list is one end mark; repeated rows, and rows without an id, each have their
place; an empty table makes no shard and an empty index; other columns are neither read nor
returned.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table, written

LENGTH, KEY = 2048, "order-1"
#: Slots of a shard at least, and shards at most: a reduce task each, of a size that a scheduler holds for any number of map tasks.
SHARD, SHARDS = 16_384, 20_000
HEAD, HEAD_SIZE = "<qi", 12
ROUNDS = 6


class Permutation:
    """Keyed bijection of 0 .. n-1."""

    def __init__(self, n: int, key: str = KEY):
        self.n, self.half = n, max(1, -(-max(1, n - 1).bit_length() // 2))
        digest = hashlib.sha512(key.encode()).digest()
        self.keys = [np.uint64(int.from_bytes(digest[8 * i : 8 * i + 8], "little")) for i in range(ROUNDS)]

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & np.uint64((1 << self.half) - 1)
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ self._mixed(left, key), left
            else:
                left, right = right, left ^ self._mixed(right, key)
        return (left << half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = self._once(np.asarray(x, dtype=np.uint64), back)
            while len(far := np.flatnonzero(out >= np.uint64(self.n))):
                out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


@dataclass(frozen=True)
class Layout:
    """Where the shards are and how they are cut."""

    path: str
    sequences: int
    length: int
    shard: int
    key: str
    width: int = 1

    @property
    def stride(self) -> int:
        return HEAD_SIZE + self.length * self.width + 1

    @property
    def end(self) -> int:
        """The id that ends a text."""
        return (1 << 8 * self.width) - 1

    @property
    def padding(self) -> int:
        return self.end - 1

    def numbers(self, ids: bytes) -> np.ndarray:
        """A record's ids as integers."""
        return np.frombuffer(ids, dtype=f"<u{self.width}").astype(np.int64)

    @property
    def permutation(self) -> Permutation:
        return Permutation(self.sequences, self.key)


def _placed(docs: DataFrame, id_col: str, n_ids: F.Column) -> DataFrame:
    """A written table of ``id``, ``part``, ``start`` (the text's first id in its partition), ``n`` (ids with the end mark)
    and ``check`` (of the partition up to here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, check = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
            checks = []
            for x in n.tolist():
                check = zlib.crc32(b"%d," % x, check)
                checks.append(check)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part)), pa.array(starts), pa.array(n), pa.array(checks, pa.int64())], names=["id", "part", "start", "n", "check"])

    lengths = docs.select(F.col(id_col).alias("id"), (F.coalesce(n_ids, F.lit(0)) + 1).cast("long").alias("n"))
    kind = docs.schema[id_col].dataType.simpleString()
    return written(lengths.mapInArrow(run, f"id {kind}, part bigint, start bigint, n bigint, check bigint"), "places")


def _raw(column: pa.Array, layout: Layout) -> Iterator[bytes]:
    """Each row's ids as bytes."""
    if not pa.types.is_list(column.type):
        for x in column:
            yield x.as_py() or b""
        return
    for x in column:
        ids = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0)
        if len(ids) and not (0 <= ids.min() and ids.max() < layout.padding):  # a null is no number either
            raise ValueError(f"an id outside 0 to {layout.padding - 1}")
        yield ids.astype(f"<u{layout.width}").tobytes()


def write(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, length: int = LENGTH, shard: int | None = None, key: str = KEY, ids_col: str | None = None, width: int = 1
) -> tuple[Layout, DataFrame]:
    """Write the shards (of the lists of ``ids_col`` in ``width`` bytes an id, or the bytes of ``text_col``) and return their layout and the index: for every row ``id_col``, ``n_tokens``, ``first_sequence``,
    ``n_sequences``, ``slot``, ``shard``, ``byte_offset`` and ``position`` (of the text's first id: its record, where it begins in the shard, and
    the id's place in the record)."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    if width not in (1, 2, 4) or (width > 1 and not ids_col):
        raise ValueError("ids have 1, 2 or 4 bytes, those of texts 1")
    n_ids = F.size(F.when(F.col(ids_col).isNotNull(), F.col(ids_col))) if ids_col else F.octet_length(text_col)
    places = _placed(docs, id_col, F.when(n_ids >= 0, n_ids))
    # One row for each partition of the input, the unit of the scheduler's own tables.
    ends = sorted(map(tuple, places.groupBy("part").agg(F.max_by(F.struct("start", "n", "check"), "start").alias("e")).select("part", F.col("e.start") + F.col("e.n"), "e.check").collect()))
    base, total = {}, 0
    for part, n, check in ends:
        base[part] = (total, n, check)
        total += -(-n // length)
    shard = shard or max(SHARD, -(-total // SHARDS))
    layout = Layout(path, total, length, shard, key, width)
    bases = spark.sparkContext.broadcast(base)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n, expected = bases.value.get(TaskContext.get().partitionId(), (0, 0, 0))
        order, press = layout.permutation, zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        held, check, seen = bytearray(), 0, 0
        size, end, fill = length * width, layout.end.to_bytes(width, "little"), layout.padding.to_bytes(width, "little") * length

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal number, held
            k = -(-len(held) // size) if last else len(held) // size
            slots = order.slots(np.arange(number, number + k))
            packed = []
            for i, slot in enumerate(slots.tolist()):
                ids = bytes(held[i * size : (i + 1) * size])
                packed.append(press(struct.pack(HEAD, slot, len(ids) // width) + ids + fill[len(ids) :]))
            del held[: k * size]
            number += k
            return pa.RecordBatch.from_arrays([pa.array(slots), pa.array((slots // shard).astype(np.int32)), pa.array(packed, pa.binary())], names=["slot", "shard", "record"])

        for batch in batches:
            for raw in _raw(batch.column(0), layout):
                check = zlib.crc32(b"%d," % (len(raw) // width + 1), check)
                seen += len(raw) // width + 1
                held += raw
                held += end
                if len(held) >= 4_000_000:
                    yield cut(False)
        if (seen, check) != (n, expected):
            raise RuntimeError("the input's partitions changed between two reads: write it as a table first")
        if held:
            yield cut(True)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                yield pa.RecordBatch.from_arrays([pa.array([expand(x.as_py()) for x in batch.column(0).slice(a, 1024)], pa.binary())], names=["record"])

    if total:
        column = F.col(ids_col).cast("array<bigint>") if ids_col else F.col(text_col).cast("binary")
        cut_up = docs.select(column).mapInArrow(records, "slot bigint, shard int, record binary")
        dealt = cut_up.repartitionById(-(-total // shard), F.col("shard")).sortWithinPartitions("slot").select("record")
        dealt.mapInArrow(opened, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").text(path)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = layout.permutation
        for batch in batches:
            part, start, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
            first = np.array([bases.value[p][0] for p in part.tolist()], dtype=np.int64) + start // length
            slot = order.slots(first)
            cols = [batch.column(0), n, first, (start + n - 1) // length - start // length + 1, slot, slot // shard, slot % shard * layout.stride, start % length]
            yield pa.RecordBatch.from_arrays([c if i == 0 else pa.array(c) for i, c in enumerate(cols)], names=[id_col, "n_tokens", "first_sequence", "n_sequences", "slot", "shard", "byte_offset", "position"])

    kind = docs.schema[id_col].dataType.simpleString()
    return layout, places.select("id", "part", "start", "n").mapInArrow(index, f"`{id_col}` {kind}, n_tokens bigint, first_sequence bigint, n_sequences bigint, slot bigint, shard bigint, byte_offset bigint, position bigint")


def shard_files(spark: SparkSession, layout: Layout) -> dict[int, str]:
    """Shard number to file, after a check that each has its full size."""
    if not layout.sequences:
        return {}
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(layout.path).select("path", "length").collect()
    found = {int(f.path.rpartition("/part-")[2][:5]): (f.path, f.length) for f in files if f.length}
    for k in range(-(-layout.sequences // layout.shard)):
        want = layout.stride * min(layout.shard, layout.sequences - k * layout.shard)
        if k not in found or found[k][1] != want:
            raise RuntimeError(f"shard {k} is incomplete")
    return {k: path for k, (path, _) in found.items()}


def read(spark: SparkSession, layout: Layout, slot: int, n: int) -> Iterator[tuple[int, bytes]]:
    """``(slot, ids)`` (as bytes) of ``n`` slots from ``slot`` on: a seek in each shard, then a sequential read."""
    files, jvm = shard_files(spark, layout), spark.sparkContext._jvm
    end = min(slot + n, layout.sequences)
    while slot < end:
        k, first = divmod(slot, layout.shard)
        count = min(end, (k + 1) * layout.shard) - slot
        where = jvm.org.apache.hadoop.fs.Path(files[k])
        stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        try:
            stream.seek(first * layout.stride)
            for _ in range(0, count, 512):
                some = min(512, count)
                data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, some * layout.stride))
                for i in range(some):
                    own, size = struct.unpack_from(HEAD, data, i * layout.stride)
                    at = i * layout.stride + HEAD_SIZE
                    yield own, data[at : at + size * layout.width]
                count -= some
                slot += some
        finally:
            stream.close()


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: shards of every document's whole text; where each document begins in them."""
    layout, index = write(table(spark, sf_dir, "documents"))
    shard_files(spark, layout)
    return index
