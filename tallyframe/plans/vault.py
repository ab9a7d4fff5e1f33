"""The append-only result store: hash-chained verification rows."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import rsa
from tallyframe.plans.scratch import cut

GENESIS = "0" * 64
#: Columns that a record's hash covers, in order.
HASHED = (
    "id", "timestamp", "filename", "file_hash", "verification_status", "paragraphs_count", "variables_count", "comp3_count", "python_chars", "arithmetic_safe", "arithmetic_warn", "arithmetic_critical",
    "human_review_flags", "checklist_pass", "checklist_total", "executive_summary", "generated_python", "full_report_json", "prev_hash", "verification_chain",
)


def chain_hash(source: Column, code: Column, report: Column, prev: Column) -> Column:
    """SHA-256 of the three texts' hashes and the previous chain hash."""
    return F.sha2(F.concat(F.sha2(source, 256), F.sha2(code, 256), F.sha2(report, 256), prev), 256)


def record_hash(columns: Sequence[str] = HASHED) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def append(spark: SparkSession, path: str, row: dict) -> str:
    """Append one verification (``id``, ``username``, ``source``, ``code``, ``report``, and any other text columns); returns its chain hash."""
    names = sorted(row)
    rows = spark.createDataFrame([[row[n] for n in names]], ", ".join(f"{n} {'bigint' if n == 'id' else 'string'}" for n in names))
    append_many(rows, path)
    return spark.read.parquet(path).where((F.col("username") == row["username"]) & (F.col("id") == row["id"])).select("chain_hash").first().chain_hash


def chained(rows: DataFrame, heads: DataFrame | None = None, renumber: bool = False) -> DataFrame:
    """``rows`` (of ``id``, ``username``, ``source``, ``code``, ``report`` and others) with ``prev_hash``, ``chain_hash`` and ``record_hash``: the rows of a user in the order of ids, the first
    on top of its ``heads`` row (``username``, ``head``, ``last``, its id). A chain is an ordered fold: rows are dealt by user, sorted, and a task carries one hash, whatever a user's number of
    rows. Ids must grow from the head's on; ``renumber`` gives the rows the next ones in their order."""
    text = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")), 256)
    given = rows.withColumn("__own", F.concat(text("source"), text("code"), text("report")))
    given = given.join(heads, "username", "left") if heads is not None else given.withColumn("head", F.lit(None).cast("string")).withColumn("last", F.lit(None).cast("bigint"))
    fields = [f for f in given.schema.fields if f.name not in ("head", "last", "__own")]
    schema = T.StructType([*fields, T.StructField("prev_hash", T.StringType()), T.StructField("chain_hash", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, hash_, number = None, GENESIS, 0
        for b in batches:
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            prev, own, ids = [], [], []
            for name, id_, head, last, text in zip(*(columns[n].to_pylist() for n in ("username", "id", "head", "last", "__own")), strict=True):
                if name != user:
                    user, hash_, number = name, head or GENESIS, -1 if last is None and renumber else last
                if not renumber and number is not None and id_ <= number:
                    raise ValueError(f"id {id_} of {user!r} isn't above {number}")
                number = number + 1 if renumber else id_
                ids.append(number)
                prev.append(hash_)
                hash_ = hashlib.sha256((text + hash_).encode()).hexdigest()
                own.append(hash_)
            columns["id"] = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([*(columns[f.name] for f in fields), pa.array(prev, pa.string()), pa.array(own, pa.string())], names=schema.names)

    linked = given.repartition("username").sortWithinPartitions("username", "id").mapInArrow(fold, schema)
    return linked.withColumn("record_hash", record_hash(sorted(schema.names)))


def append_many(rows: DataFrame, path: str, renumber: bool = False, tries: int = 20) -> int:
    """Append ``rows`` to the chains of their users (see ``chained``); returns the number of the batch. Writers may race: a batch is written aside on top of the newest hashes that its writer has
    seen, then claims the next number, which one writer can; the others build theirs anew on what that one has added. A claimed batch whose writer died is moved in by the next."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *names]))
    listed = lambda p: sorted(x.getPath().getName() for x in fs.listStatus(p))
    fs.mkdirs(at("_claims"))

    def settle() -> int:
        """Move in what was claimed last; the number of claims."""
        claims = [name for name in listed(at("_claims")) if name.isdigit()]
        for name in claims[-1:]:
            aside = at("_aside", spark.read.text(at("_claims", name).toString()).first()[0])
            for file in listed(aside) if fs.exists(aside) else []:
                if not file.startswith(("_", ".")):
                    fs.rename(jvm.org.apache.hadoop.fs.Path(aside, file), at(f"{name}-{file}"))
        return len(claims)

    kept = cut(rows, "rows")
    for _ in range(tries):
        number, name = settle(), uuid.uuid4().hex
        heads = None
        if any(file.endswith(".parquet") for file in listed(root)):
            newest = F.max_by(F.struct(F.col("chain_hash").alias("head"), F.col("id").alias("last")), "id").alias("newest")
            heads = spark.read.parquet(path).groupBy("username").agg(newest).join(kept.select("username").distinct(), "username", "left_semi").select("username", "newest.*")
        chained(kept, heads, renumber).write.parquet(at("_aside", name).toString())
        if _claimed(fs, at("_claims", f".{name}"), at("_claims", f"{number:010d}"), name):
            settle()
            return number
        fs.delete(at("_aside", name), True)
        time.sleep(0.2)
    raise RuntimeError(f"{tries} other batches came first")


def _claimed(fs, own, claim, text: str) -> bool:
    """Make the file ``claim`` with ``text``, whole or not at all; false if another writer has made it. File systems of clusters don't rename onto a file that is there; Hadoop's local one
    does, so there a link decides."""
    out = fs.create(own, False)
    out.write(text.encode())
    out.close()
    if fs.getUri().getScheme() != "file":
        return fs.rename(own, claim)
    try:
        os.link(own.toUri().getPath(), claim.toUri().getPath())
    except FileExistsError:
        return False
    finally:
        fs.delete(own, False)
    return True


def signatures(verified: DataFrame, key: rsa.PublicKey) -> DataFrame:
    """With ``signature_state``: ``valid``, ``invalid`` or ``unsigned``; a ``signature`` is of the record's hash, of older records without one of the chain hash."""
    ok = rsa.verified(F.coalesce("record_hash", "chain_hash"), F.when(F.col("signature") != "", F.col("signature")), key)
    return verified.withColumn("__ok", ok).withColumn("signature_state", F.when(F.col("__ok").isNull(), "unsigned").when(F.col("__ok"), "valid").otherwise("invalid")).drop("__ok")


def verify(log: DataFrame, hashed: Sequence[str], partition: Sequence[str] = ("username",)) -> DataFrame:
    """With ``chain_break`` (prev_hash isn't the previous row's chain hash; a null one is a legacy start) and ``tampered``
    (the record hash doesn't match)."""
    w = Window.partitionBy(*partition).orderBy("id")
    expected = F.coalesce(F.lag("chain_hash").over(w), F.lit(GENESIS))
    return log.withColumn("chain_break", F.col("prev_hash").isNotNull() & (F.col("prev_hash") != expected)).withColumn("tampered", F.col("record_hash").isNotNull() & (F.col("record_hash") != record_hash(hashed)))


def summary(verified: DataFrame) -> DataFrame:
    """One row of a verified log; with ``signatures`` also their counts and ``signatures_valid`` (none is invalid)."""
    counts = [F.count("*").alias("total_records"), F.count_if("chain_break").alias("chain_breaks"), F.count_if("tampered").alias("tampered")]
    if "signature_state" in verified.columns:
        counts += [F.count_if(F.col("signature_state") == s).alias(n) for s, n in (("valid", "valid_signatures"), ("invalid", "invalid_signatures"), ("unsigned", "unsigned_records"))]
    out = verified.agg(*counts).withColumn("chain_intact", (F.col("chain_breaks") == 0) & (F.col("tampered") == 0))
    return out.withColumn("signatures_valid", F.col("invalid_signatures") == 0) if "signature_state" in verified.columns else out


def listing(log: DataFrame, user: str, n: int = 100) -> DataFrame:
    """A user's newest records."""
    return log.where(F.col("username") == user).orderBy(F.col("id").desc()).limit(n)


def record(log: DataFrame, user: str, number: int) -> DataFrame:
    return log.where((F.col("username") == user) & (F.col("id") == number))


def without(log: DataFrame, user: str, number: int) -> DataFrame:
    return log.where(~((F.col("username") == user) & (F.col("id") == number)))


def save_reports(reports: DataFrame, path: str) -> None:
    """Append reports (``id``, ``username``, ``report`` and any other columns)."""
    reports.write.mode("append").parquet(path)


def saved_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def newest(log: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` records of each user. Spark keeps the first ``n`` of a window on the map side already (a limit on the rank), so no
    user's log is gathered whole."""
    rank = F.row_number().over(Window.partitionBy("username").orderBy(F.col("id").desc()))
    return log.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def export(log: DataFrame, user: str) -> DataFrame:
    """A user's records as JSON lines, oldest first."""
    return log.where(F.col("username") == user).orderBy("id").select(F.to_json(F.struct(*log.columns)).alias("value"))


def signature(text: Column, key: Column) -> Column:
    """A keyed signature (HMAC-SHA-256) of a text, in hex; the key is a text of at most 64 bytes."""
    return F.sha2(F.concat(_padded(key, 0x5C), F.unhex(F.sha2(F.concat(_padded(key, 0x36), F.encode(text, "UTF-8")), 256))), 256)


def _padded(key: Column, byte: int) -> Column:
    """The key's block with every byte combined with ``byte`` by exclusive or."""
    digits = "0123456789ABCDEF"
    swap = lambda half: "".join(f"{int(c, 16) ^ half:X}" for c in digits)
    block = F.rpad(F.hex(key), 128, "0")
    high, low = F.regexp_replace(block, "(.).", "$1"), F.regexp_replace(block, ".(.)", "$1")
    high, low = F.translate(high, digits, swap(byte >> 4)), F.translate(low, digits, swap(byte & 15))
    pairs = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.concat(F.substring(high, i, F.lit(1)), F.substring(low, i, F.lit(1))))
    return F.unhex(F.array_join(pairs, ""))


def signed(text: Column, mac: Column, key: Column) -> Column:
    """Whether a signature is this text's."""
    return signature(text, key) == mac


def encrypted(text: Column, key: Column, iv: Column | None = None) -> Column:
    """AES-GCM; a fixed iv is for tests only."""
    return F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"), iv) if iv is not None else F.aes_encrypt(text, key, F.lit("GCM"))


def decrypted(raw: Column, key: Column) -> Column:
    return F.aes_decrypt(raw, key, F.lit("GCM")).cast("string")


def log_events(events: DataFrame, path: str) -> None:
    """Append audit events (``username``, ``action`` and, if there, ``details``, ``ip_address``, ``request_id``, ``ts``): what a row lacks is filled in. Files are only ever added."""
    none = F.lit(None).cast("string")
    given = lambda c, other: F.coalesce(F.col(c).cast("string"), other) if c in events.columns else other
    ts = F.coalesce("ts", F.current_timestamp()) if "ts" in events.columns else F.current_timestamp()
    own = F.substring(F.replace(F.expr("uuid()"), F.lit("-")), 1, 12)
    rows = events.select(ts.alias("ts"), "username", "action", given("details", none).alias("details"), given("ip_address", F.lit("local")).alias("ip_address"), given("request_id", own).alias("request_id"))
    rows.withColumn("event_id", F.expr("uuid()")).write.mode("append").parquet(path)


def audit(log: DataFrame, n: int = 100) -> DataFrame:
    """The latest audit events."""
    return log.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)
