"""Record files: fixed-length records, text lines, arriving files, and dense record numbers.

Fixed-length records may have a separator (line feed, carriage return, or both) behind each. Whether they do is a property of a file: all
of up to ``PROBES`` places between records, spread over it, must have one and the size must fit; else there are none if the size fits without, and
a data byte that looks like a line end stays data. The option ``separator`` (none, lf, crlf, varying) decides where the data leave doubts. Files are listed by Spark and probed by executors.

Where separators vary, a record's place depends on all before it. Such a file is cut into chunks all the same: each chunk finds, for every place at which its first
record may begin, where the next chunk's first record begins; these maps are composed along the file, a run of chunks at a time, which gives every
chunk the place where it begins; then all are read at once (``entries``).

Numbers are prefix sums over the counts of splits, a table that is never collected (``prefix_sums``)."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tallyframe.plans.scratch import cut
from tallyframe.sources.layout import Layout, decoded

SPLIT, PIECE = 32 << 20, 4 << 20
PROBES = 1000
#: Splits at most, besides one a file: beyond, splits grow with the data, so a table of them stays small.
SPLITS = 100_000
#: Entries of chunk maps that are composed in one task, and of counts that are summed in one.
FAN, LEAF = 2_000_000, 100_000
#: Bytes of a chunk whose records are followed at once, and records of one jump there (as a power of two).
STRIP, JUMPS = 1 << 20, 4
#: Bytes of separators by their option.
SEPARATORS = {"none": 0, "lf": 1, "crlf": 2}
#: Files up to this size are hashed as one value; larger ones are read in pieces.
ONE_VALUE = 512 << 20
SCHEMA = "file string, offset bigint, raw binary"


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int
    stride: int


@dataclass
class Written(WriterCommitMessage):
    path: str


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")


def _files(path: str) -> list[str]:
    path = _local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith((".", "_")))
    return [path]


def stride_of(path: str, length: int, separator: str = "auto") -> int:
    """Bytes from one record to the next; 0 if separators vary."""
    if separator != "auto":
        return length + SEPARATORS[separator] if separator in SEPARATORS else 0
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        for marks in ((b"\r\n",), (b"\n", b"\r")):
            stride = length + len(marks[0])
            if size % stride not in (0, length) or size <= length:
                continue
            n = size // stride
            for k in np.unique(np.linspace(0, n - 1, min(n, PROBES)).astype(np.int64)).tolist():
                f.seek(k * stride + length)
                if f.read(len(marks[0])) not in marks:
                    break
            else:
                return stride
    return length if size % length == 0 else 0


def spans_of(path: str, length: int, separator: str = "auto") -> list[Span]:
    """A file in parts of whole records; one part if separators vary."""
    size, stride = os.path.getsize(path), stride_of(path, length, separator)
    step = max(1, SPLIT // stride) * stride if stride else size
    return [Span(path, a, min(size, a + step), stride) for a in range(0, size, max(1, step))]


def read_span(span: Span, length: int) -> Iterator[pa.RecordBatch]:
    """The records that begin in it, a piece of the file at a time."""
    with open(span.path, "rb") as f:
        f.seek(span.start)
        at, rest, ended = span.start, b"", False
        while (at < span.end or rest) and not ended:
            data = f.read(PIECE // span.stride * span.stride or span.stride if span.stride else max(PIECE, length + 2))
            begun, ended = at - len(rest), not data
            at += len(data)
            data = rest + data
            if span.stride:
                rows, rest = [(begun + k, data[k : k + length]) for k in range(0, min(len(data), span.end - begun), span.stride)], b""
                ended = at >= span.end
            else:
                rows, used = [], 0
                while used < len(data) and begun + used < span.end and (used + length + 2 <= len(data) or ended):
                    rows.append((begun + used, data[used : used + length]))
                    used += length
                    used += 2 if data[used : used + 2] == b"\r\n" else data[used : used + 1] in (b"\n", b"\r")
                rest, ended = data[used:], ended or begun + used >= span.end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([span.path] * len(rows)), pa.array([o for o, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.binary())], names=["file", "offset", "raw"])


def exits(data: bytes, length: int, n: int) -> np.ndarray:
    """Where the records lead that begin at 0 to ``length`` + 1 of ``data``: the place of the first record at or after ``n``, less ``n``. ``data`` has ``length`` + 2
    bytes beyond ``n`` (or ends with the file)."""
    at = np.arange(length + 2)
    for begin in range(0, n, STRIP):  # records are followed through a strip at a time
        size = min(STRIP, n - begin)
        raw = np.frombuffer(data, dtype=np.uint8, count=min(size + length + 2, len(data) - begin), offset=begin)
        raw = np.concatenate([raw, np.zeros(size + length + 3 - len(raw), dtype=np.uint8)])
        mark, follow = raw[length : length + size], raw[length + 1 : length + 1 + size]
        gap = np.where((mark == 13) & (follow == 10), 2, (mark == 10) | (mark == 13))
        after = np.arange(size + length + 2, dtype=np.int32)  # places beyond the strip lead to themselves
        after[:size] += (length + gap).astype(np.int32)
        jump = after
        for _ in range(JUMPS):
            jump = jump[jump]
        here = at - begin
        while (here < size).any():
            here = jump[here]
        at = here + begin
    return (at - n).astype(np.int32)


def entries(maps: DataFrame, length: int) -> DataFrame:
    """``path``, ``k`` and ``entry`` (place in the chunk where its first record begins) of all chunks, from ``path``, ``k`` (0, 1, ...) and ``exits``. Runs
    of chunks are composed into maps of runs, until a file is one run; then each run tells its chunks."""
    fan = max(2, FAN // (length + 2))
    identity = F.sequence(F.lit(0), F.lit(length + 1))
    runs = maps.withColumn("run", F.expr(f"k div {fan}"))
    in_order = F.array_sort(F.collect_list(F.struct("k", "exits")))
    whole = runs.groupBy("path", "run").agg(in_order.alias("m")).select("path", F.col("run").alias("k"), F.aggregate("m", identity, lambda acc, m: F.transform(acc, lambda x: F.get(m["exits"], x))).alias("exits"))
    most = maps.agg(F.max("k")).first()[0] or 0
    if most < fan:
        begin = maps.select("path").distinct().select("path", F.lit(0).cast("bigint").alias("run"), F.lit(0).alias("first"))
    else:
        begin = entries(cut(whole, "runs"), length).select("path", F.col("k").alias("run"), F.col("entry").alias("first"))
    told = runs.groupBy("path", "run").agg(in_order.alias("m")).join(begin, ["path", "run"])
    start = F.struct(F.array().cast("array<int>").alias("seen"), F.col("first").alias("at"))
    walked = F.aggregate("m", start, lambda acc, m: F.struct(F.concat(acc["seen"], F.array(acc["at"])).alias("seen"), F.get(m["exits"], acc["at"]).alias("at")), lambda acc: acc["seen"])
    return told.select("path", F.explode(F.arrays_zip(F.transform("m", lambda x: x["k"]).alias("k"), walked.alias("entry"))).alias("x")).select("path", F.col("x.k").alias("k"), F.col("x.entry").alias("entry"))


def plan_splits(spark: SparkSession, path: str, length: int, separator: str = "auto") -> DataFrame:
    """A written table of ``path``, ``start``, ``end``, ``stride``: the splits of all files of ``path``; a split's records are those that begin in it, the first at ``start``."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [stride_of(_local(p), length, separator) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=["path", "size", "stride"])

    listed = spark.read.format("binaryFile").load(_local(path) if path.startswith("file:") else path).select("path", F.col("length").alias("size")).where("size > 0")
    files = cut(listed.repartition("path").mapInArrow(probe, "path string, size bigint, stride bigint"), "files")
    step = max(SPLIT, -(-(files.agg(F.sum("size")).first()[0] or 0) // SPLITS))
    begun = files.withColumn("step", F.when(F.col("stride") > 0, F.greatest(F.lit(1), F.expr(f"{step} div stride")) * F.col("stride")).otherwise(F.greatest(F.lit(step), F.lit(length + 2))))
    chunks = begun.select("path", "size", "stride", "step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(size - 1) div step"))).alias("k"))
    chunks = chunks.withColumn("start", F.col("k") * F.col("step")).withColumn("end", F.least("size", F.col("start") + F.col("step")))
    if files.where("stride = 0").isEmpty():
        return cut(chunks.select("path", "start", "end", "stride"), "splits")
    varying = cut(chunks.where("stride = 0"), "chunks")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                with open(_local(x["path"]), "rb") as f:
                    f.seek(x["start"])
                    data = f.read(x["end"] - x["start"] + length + 2)
                yield pa.RecordBatch.from_arrays([pa.array([x["path"]]), pa.array([x["k"]], pa.int64()), pa.array([exits(data, length, x["end"] - x["start"])], pa.list_(pa.int32()))], names=["path", "k", "exits"])

    maps = cut(_dealt(varying.select("path", "k", "start", "end"), ["path", "k"]).mapInArrow(follow, "path string, k bigint, exits array<int>"), "maps")
    known = varying.join(entries(maps, length), ["path", "k"]).withColumn("start", F.col("start") + F.col("entry"))
    return cut(chunks.where("stride > 0").select("path", "start", "end", "stride").unionByName(known.select("path", "start", "end", "stride")), "splits")


def _dealt(splits: DataFrame, order: list[str]) -> DataFrame:
    """A written table of splits, as many partitions as rows (``SPLITS`` at most), dealt evenly."""
    n = max(1, min(SPLITS, splits.count()))
    numbered = prefix_sums(splits.withColumn("one", F.lit(1).cast("bigint")), order, "one", "at")
    return numbered.repartitionById(n, F.pmod("at", F.lit(n)).cast("int")).drop("at", "one")


def prefix_sums(counts: DataFrame, order: list[str], n: str, name: str) -> DataFrame:
    """``counts`` with ``name``, the sum of ``n`` over all rows before in ``order`` (which tells rows apart). Beyond ``LEAF`` rows range partitions are
    summed on their own and their totals, a table of its own, in the same way: no task has all rows, and the driver none."""
    before = lambda by, w: F.coalesce(F.sum(by).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    rows = counts.count()
    if rows <= LEAF:
        return counts.withColumn(name, before(n, Window.partitionBy(F.lit(0)).orderBy(*order)))
    part, total, base = f"__part_{name}", f"__n_{name}", f"__base_{name}"
    parted = cut(counts.repartitionByRange(-(-2 * rows // LEAF), *order).withColumn(part, F.spark_partition_id().cast("bigint")), "counts")
    totals = prefix_sums(parted.groupBy(part).agg(F.sum(n).alias(total)), [part], total, base)
    within = parted.withColumn("__before", before(n, Window.partitionBy(part).orderBy(*order)))
    return within.join(F.broadcast(totals.select(part, base)), part).withColumn(name, F.col(base) + F.col("__before")).select(*counts.columns, name)  # fewer than rows / 50,000 totals


class FixedReader(DataSourceReader):
    """Splits are planned by size alone; a task finds its file's separator, and its first record. A file whose separators vary is read by its first split here (``read_fixed`` splits it)."""

    def __init__(self, options: dict):
        self.path, self.length, self.separator = options["path"], int(options["recordLength"]), options.get("separator", "auto")

    def partitions(self) -> list[Span]:
        sizes = {path: os.path.getsize(path) for path in _files(self.path)}
        step = max(SPLIT, -(-sum(sizes.values()) // SPLITS))
        return [Span(path, a, min(size, a + step), -1) for path, size in sizes.items() for a in range(0, size, step)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        stride = stride_of(span.path, self.length, self.separator)
        if stride:
            yield from read_span(replace(span, start=-(-span.start // stride) * stride, stride=stride), self.length)
        elif span.start == 0:
            yield from read_span(replace(span, end=os.path.getsize(span.path), stride=0), self.length)


class FixedWriter(DataSourceWriter):
    """A file for each partition, named when the job commits, so a repeated task leaves no half file; what an overwrite replaces goes then, too."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = _local(options["path"]), overwrite
        self.separator = options.get("separator", "").encode().decode("unicode_escape").encode("latin-1")
        os.makedirs(self.path, exist_ok=True)

    def write(self, rows: Iterator) -> Written:
        context = TaskContext.get()
        path = os.path.join(self.path, f".part-{context.partitionId():05d}-{context.taskAttemptId()}")
        with open(path, "wb") as f:
            for r in rows:
                f.write(bytes(r["raw"]) + self.separator)
        return Written(path)

    def commit(self, messages: list) -> None:
        for f in _files(self.path) if self.overwrite else []:
            os.remove(f)
        for m in messages:
            if m:
                folder, name = os.path.split(m.path)
                os.rename(m.path, os.path.join(folder, name[1:].rpartition("-")[0]))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class FixedWidth(DataSource):
    """``spark.read.format("fixedwidth").option("recordLength", n).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "fixedwidth"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FixedReader:
        return FixedReader(self.options)

    def writer(self, schema, overwrite: bool) -> FixedWriter:
        return FixedWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FixedWidth)


def read_fixed(spark: SparkSession, path: str, record_length: int, separator: str = "auto") -> DataFrame:
    """``file``, ``offset``, ``raw`` and ``block`` (where the record's split begins); a split's rows come in order, one task reads it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                for part in read_span(Span(_local(x["path"]), x["start"], x["end"], x["stride"]), record_length):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x["start"]] * part.num_rows, pa.int64())], names=[*part.schema.names, "block"])

    return _dealt(plan_splits(spark, path, record_length, separator), ["path", "start"]).mapInArrow(read, f"{SCHEMA}, block bigint")


def arriving(spark: SparkSession, path: str, record_length: int, separator: str = "auto") -> DataFrame:
    """A stream of ``file``, ``offset`` and ``raw`` of the files that come into a folder. Spark's file source remembers which it has seen, whatever their names;
    only their names cross the driver, executors read them in parts."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path).select("path")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [x for p in b.column(0).to_pylist() for x in spans_of(_local(p), record_length, separator)]
            yield pa.RecordBatch.from_arrays([pa.array([x.path for x in spans], pa.string()), *(pa.array([getattr(x, n) for x in spans], pa.int64()) for n in ("start", "end", "stride"))], names=["path", "start", "end", "stride"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                yield from read_span(Span(**x), record_length)

    return files.mapInArrow(cut, "path string, start bigint, end bigint, stride bigint").repartition("path", "start").mapInArrow(read, SCHEMA)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Line records: ``file``, ``block`` (where its split begins) and ``raw``; a split's rows come in order."""
    at = F.col("_metadata")
    return spark.read.text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.encode(F.rtrim("value", F.lit("\r\n")), "ISO-8859-1").alias("raw"))


def without_blanks(records: DataFrame, codepage: str | None = None) -> DataFrame:
    space = "\x40" if codepage and codepage != "ascii" else " "
    return records.where(F.trim(F.replace(F.decode("raw", "ISO-8859-1"), F.lit(space), F.lit(" "))) != "")


def positions(rows: DataFrame, name: str, first: int = 0) -> DataFrame:
    """``rows`` with the dense position of each, in the order of their partitions: partitions are counted and summed up,
    then each row's number is its partition's base and its place there. No global sort, no single-partition window. The placed rows are a written table: a sort's bounds come
    from a sample that another run draws anew, so rows counted in one run and numbered in another needn't lie in the same partitions."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, n = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, p, dtype=np.int64)), pa.array(np.arange(n, n + b.num_rows))], names=[*b.schema.names, "__part", "__place"])
            n += b.num_rows

    placed = rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("__part", T.LongType()), T.StructField("__place", T.LongType())]))
    return _based(cut(placed, "placed"), ["__part"], "__place", name, first).drop("__part", "__place")


def _based(placed: DataFrame, split: list[str], place: str, name: str, first: int = 0) -> DataFrame:
    """Numbers of rows that know their place in their split: the sums of the splits before, in the order of ``split``, are joined to them. Splits are few (a row a task);
    beyond twice ``SPLITS`` (very many small files) they are joined by a shuffle. A split that isn't the same when it is read again fails the job."""
    counts = cut(placed.groupBy(*split).agg(F.count("*").alias("__n")), "counts")
    bases = prefix_sums(counts, split, "__n", "__base")
    small = F.broadcast(bases) if counts.count() <= 2 * SPLITS else bases
    changed = F.raise_error(F.lit("the input changed between two reads")).cast("bigint")
    n = F.when(F.col(place) < F.col("__n"), F.col("__base") + F.col(place) + F.lit(first)).otherwise(changed)
    return placed.join(small, split, "left").withColumn(name, n).drop("__n", "__base")


def numbered(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``raw``, its dense number ``_rec`` and ``keep``, in the order of files' names and of places in a file. Records know their split (``file`` and ``block``)
    and come in order within it; splits are counted and summed up."""
    given = records.select("file", "block", "raw", *keep)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            out = np.empty(b.num_rows, dtype=np.int64)
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                out[i] = k = seen.get(key, 0)
                seen[key] = k + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "__place"])

    placed = given.mapInArrow(place, T.StructType([*given.schema.fields, T.StructField("__place", T.LongType())]))
    return _based(placed, ["file", "block"], "__place", "_rec").select("raw", "_rec", *keep)


def codepages(records: DataFrame, layout: Layout) -> DataFrame:
    """``file`` and ``codepage`` (null: ASCII) of each file, by all its bytes in text fields, counted by class where the records are: EBCDIC if over 30 % are above x'7F';
    then cp1047 if its square brackets (xAD, xBD) are more than those of cp037 (xBA, xBB)."""
    own = F.decode(F.concat(F.lit(b""), *(F.substring("raw", f.start + 1, f.length) for f in layout.fields if f.type == "string")), "ISO-8859-1")
    n = lambda chars: F.sum(F.length(F.regexp_replace("own", f"[^{chars}]", "")))
    sums = records.select("file", own.alias("own")).groupBy("file").agg(F.sum(F.length("own")).alias("bytes"), n(r"\x80-\xFF").alias("high"), n(r"\xAD\xBD").alias("later"), n(r"\xBA\xBB").alias("earlier"))
    page = F.when(F.col("high") > 0.3 * F.col("bytes"), F.when(F.col("later") > F.col("earlier"), "cp1047").otherwise("cp037"))
    return sums.select("file", page.alias("codepage"))


def scan(spark: SparkSession, path: str, layout: Layout, separator: str = "auto") -> DataFrame:
    """A record file as the layout's columns: fixed-length if it has a record length, else lines. With the code page ``auto`` each file has its own (``codepages``)."""
    records = read_fixed(spark, path, layout.record_length, separator) if layout.record_length else read_lines(spark, path)
    if layout.codepage != "auto":
        return decoded(numbered(without_blanks(records, layout.codepage)), layout)
    pages = cut(codepages(records, layout), "pages")
    if pages.count() > 2 * SPLITS:
        raise ValueError(f"more than {2 * SPLITS} files: name their code page, or scan them in parts")
    space = F.when(F.col("codepage").isNull(), " ").otherwise("\x40")
    kept = records.join(F.broadcast(pages), "file").where(F.trim(F.replace(F.decode("raw", "ISO-8859-1"), space, F.lit(" "))) != "")
    known, out = numbered(kept, ("codepage",)), None
    for (page,) in pages.select("codepage").distinct().collect() or [(None,)]:  # three at most
        part = decoded(known.where(F.col("codepage").eqNullSafe(F.lit(page))).select("raw", "_rec"), replace(layout, codepage=page))
        out = part if out is None else out.unionByName(part)
    return out


def write_fixed(records: DataFrame, path: str, separator: str = "") -> None:
    """Write ``raw`` in ``_rec`` order: range partitions become files in order."""
    register(records.sparkSession)
    ordered = records.select("_rec", "raw").orderBy("_rec").select(F.lit("").alias("file"), F.col("_rec").alias("offset"), "raw")
    ordered.write.format("fixedwidth").option("separator", separator).mode("append").save(path)


def upload_digest(spark: SparkSession, path: str, most: int = 50 << 30, one_value: int = ONE_VALUE) -> DataFrame:
    """``path``, ``length``, ``sha256`` and ``accepted`` (not over the size cap) of uploaded files. Files above ``one_value`` bytes are read in pieces, where they lie."""
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= one_value).select("path", "length", F.sha2("content", 256).alias("sha256"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for p in b.column(0).to_pylist():
                h = hashlib.sha256()
                with open(_local(p), "rb") as f:
                    while data := f.read(PIECE):
                        h.update(data)
                found.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string())], names=["path", "length", "sha256"])

    large = files.where(F.col("length") > one_value).select("path", "length").mapInArrow(digest, "path string, length bigint, sha256 string")
    return small.unionByName(large).withColumn("accepted", F.col("length") <= most)
