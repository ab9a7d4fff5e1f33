"""Chains appended in batches, racing writers, RSA-PSS signatures, audit events."""

import base64
import hashlib
import random
import threading

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import rsa
from tallyframe.plans import vault

#: A public key of another implementation, and its signature of "known text".
PEM = """-----BEGIN PUBLIC KEY-----
MIGfMA0GCSqGSIb3DQEBAQUAA4GNADCBiQKBgQCsHYn5UtMZTgS5SWxju5Pah3k9
G1tRgKQBIyi0mGtnsJaBOKfWogtvmUv+fJrroglRMb1LVPDkNXQyaVdvBHaTsHAF
cnQnsQHfGYc/zIIU8/u0vzHBtugmrhgV5suBLH+feYN9Xeey+K9XQo8BYmwPN50O
tBqJcaxpEKrFuUL8iwIDAQAB
-----END PUBLIC KEY-----
"""
SIGNED = "RXcUmNkYSa0auN4clePwSUTxDYWBouHHRMQTqy+wwQ1fzB9O8wUjVFLhYZcv46g0butCpc5/QXF30eCfOB5HHbEi6YyD8Ybcex2TnJVddNln5Bs3yS40BZiHVq50NeySGsSvfwnAiwLF5Xfk4cUTGSTeKNVsGcWWGt40ZzN23aY="


@pytest.fixture(scope="module")
def key():
    return rsa.generate(640)


def test_a_known_signature():
    key, raw = rsa.read_public(PEM), base64.b64decode(SIGNED)
    assert key.pem() == PEM and key.fingerprint() == "sha256:0770110cdced1305d1e340ce33d91a56177e71ff28b4284060eece5e2b5b2be4"
    assert rsa.verify(b"known text", raw, key) and not rsa.verify(b"known texT", raw, key)
    for at in (0, 60, 127):
        assert not rsa.verify(b"known text", raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :], key)
    assert not rsa.verify(b"known text", raw[1:], key) and not rsa.verify(b"", b"", key)


@pytest.mark.parametrize("bits", [640, 641, 647, 1024])
def test_keys_of_any_length(bits):
    own = rsa.generate(bits)
    for salt in (None, b"", b"\0\0x", b"\1" * 8):
        assert rsa.verify(b"text", rsa.sign(b"text", own, salt), own.public)
    with pytest.raises(ValueError):
        rsa.sign(b"text", own, bytes(200))


def test_signatures_of_columns(spark, key):
    df = spark.createDataFrame([(i, None if i == 4 else f"t{i}é") for i in range(6)], "id int, t string")
    signed = df.withColumn("s", rsa.signature(F.col("t"), key)).cache()
    changed = signed.withColumn("t", F.when(F.col("id") == 1, "other").otherwise(F.col("t"))).withColumn("s", F.when(F.col("id") == 2, "no base64!").when(F.col("id") == 3, F.lit(None)).otherwise(F.col("s")))
    got = {r.id: r.ok for r in changed.select("id", rsa.verified(F.col("t"), F.col("s"), key.public).alias("ok")).collect()}
    assert got == {0: True, 1: False, 2: False, 3: None, 4: None, 5: True}


def serial(rows, heads=None):
    """Chains one row after the other."""
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    last, out = dict(heads or {}), {}
    for i, user, source, code, report in sorted(rows):
        prev = last.get(user, vault.GENESIS)
        last[user] = digest(digest(source) + digest(code) + digest(report) + prev)
        out[i] = (prev, last[user])
    return out


SCHEMA = "id bigint, username string, source string, code string, report string"


def test_many_rows_equal_the_serial_chain(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, f"u{r.randrange(1000)}" if i % 3 else "hot", f"s{i}", "c", f"r{i % 7}") for i in range(100_000)]
    path = str(tmp_path / "log")
    for part in (rows[:40_000], rows[40_000:]):
        vault.append_many(spark.createDataFrame(part, SCHEMA).repartition(3), path)
    log = spark.read.parquet(path)
    assert {x.id: (x.prev_hash, x.chain_hash) for x in log.select("id", "prev_hash", "chain_hash").collect()} == serial(rows)
    hashed = [c for c in sorted(log.columns) if c != "record_hash"]
    assert tuple(vault.summary(vault.verify(log, hashed)).first()) == (100_000, 0, 0, True)


def test_racing_writers_do_not_fork(spark, tmp_path):
    path, failed = str(tmp_path / "log"), []

    def write(k):
        try:
            vault.append_many(spark.createDataFrame([(100 * k + i, "u", f"s{k}", "c", "r") for i in range(3)], SCHEMA), path, renumber=True)
        except Exception as e:  # told to the test
            failed.append(e)

    writers = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    log = spark.read.parquet(path)
    assert not failed and log.count() == 9
    prev = [r.prev_hash for r in log.collect()]
    assert len(set(prev)) == 9 and vault.GENESIS in prev  # one chain: no hash has two successors
    hashed = [c for c in sorted(log.columns) if c != "record_hash"]
    assert sorted(r.id for r in log.collect()) == list(range(9)) and vault.summary(vault.verify(log, hashed)).first().chain_intact
    with pytest.raises(Exception, match="isn't above"):
        vault.append_many(spark.createDataFrame([(8, "u", "s", "c", "r")], SCHEMA), path)


def test_a_writer_that_died_after_its_claim(spark, tmp_path):
    path = str(tmp_path / "log")
    vault.append_many(spark.createDataFrame([(1, "u", "a", "c", "r")], SCHEMA), path)
    vault.chained(spark.createDataFrame([(2, "u", "b", "c", "r")], SCHEMA), spark.read.parquet(path).select("username", F.col("chain_hash").alias("head"), F.col("id").alias("last"))).write.parquet(f"{path}/_aside/dead")
    (tmp_path / "log" / "_claims" / "0000000001").write_text("dead")
    vault.append_many(spark.createDataFrame([(3, "u", "c", "c", "r")], SCHEMA), path)
    got = {x.id: (x.prev_hash, x.chain_hash) for x in spark.read.parquet(path).collect()}
    assert got == serial([(1, "u", "a", "c", "r"), (2, "u", "b", "c", "r"), (3, "u", "c", "c", "r")])


def test_a_signed_log(spark, tmp_path, key):
    path = str(tmp_path / "log")
    vault.append_many(spark.createDataFrame([(i, "u", f"s{i}", "c", "r") for i in range(5)], SCHEMA), path)
    log = spark.read.parquet(path)
    hashed = [c for c in sorted(log.columns) if c != "record_hash"]
    signed = log.withColumn("signature", F.when(F.col("id") != 3, rsa.signature(F.col("record_hash"), key))).cache()
    clean = vault.summary(vault.signatures(vault.verify(signed, hashed), key.public)).first()
    assert (clean.chain_intact, clean.valid_signatures, clean.invalid_signatures, clean.unsigned_records, clean.signatures_valid) == (True, 4, 0, 1, True)
    forged = signed.withColumn("record_hash", F.when(F.col("id") == 2, F.sha2(F.lit("x"), 256)).otherwise(F.col("record_hash")))
    bad = vault.summary(vault.signatures(vault.verify(forged, hashed), key.public)).first()
    assert (bad.tampered, bad.valid_signatures, bad.invalid_signatures, bad.signatures_valid) == (1, 3, 1, False)


def test_audit_events(spark, tmp_path):
    path = str(tmp_path / "audit")
    vault.log_events(spark.createDataFrame([("u", "login")], "username string, action string"), path)
    vault.log_events(spark.createDataFrame([("v", "delete", "{}", "rq")], "username string, action string, details string, request_id string"), path)
    got = [(r.username, r.action, r.details, r.ip_address) for r in vault.audit(spark.read.parquet(path)).collect()]
    assert got == [("v", "delete", "{}", "local"), ("u", "login", None, "local")]


def test_signing_is_spread(spark, monkeypatch):
    """A signature takes milliseconds: records of one small file are signed in as many tasks as their number asks for."""
    from tallyframe.plans import catalog_vault, scratch

    monkeypatch.setattr(scratch, "EACH", 5)
    out = catalog_vault.signature_states(spark, "/root/testdata/sf0.001")
    found = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(found) > 1 and sum(r.n for r in found) == spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()
