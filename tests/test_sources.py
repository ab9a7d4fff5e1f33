"""Record files, layouts, copybooks, pills, streams."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.plans import diff
from tallyframe.plans.lang import cleaned, expand_copies
from tallyframe.sources import layout as L
from tallyframe.sources import pills, records
from tallyframe.streaming import feed

TEXT = L.Layout("t", (L.Field("ID", 0, 4, "integer"), L.Field("NAME", 4, 6), L.Field("AMT", 10, 8, "decimal", 2)), 18)


@pytest.mark.parametrize("sep", ["", "\n", "\r\n"])
def test_fixed_records(spark, tmp_path, sep):
    lines = [f"{i:04d}{'n' + str(i):<6}{i / 4:>8.2f}" for i in range(50)]
    lines.insert(7, " " * 18)
    (tmp_path / "f.dat").write_bytes(sep.join(lines).encode())
    out = records.scan(spark, str(tmp_path / "f.dat"), TEXT).orderBy("_rec").collect()
    assert [(r._rec, int(r.ID), r.NAME, r.AMT) for r in out] == [(i, i, f"n{i}", Decimal(f"{i / 4:.2f}")) for i in range(50)]


def test_uneven_separators_and_lines(spark, tmp_path):
    body = "".join(f"{i:04d}abcdef{i:>8}" + ("\n" if i % 3 else "") for i in range(20))
    (tmp_path / "g.dat").write_text(body)
    assert [int(r.ID) for r in records.scan(spark, str(tmp_path / "g.dat"), TEXT).orderBy("_rec").collect()] == list(range(20))
    (tmp_path / "h.txt").write_text("\n".join(["0001abc", "", "0002defghi    1.50"]))
    got = records.scan(spark, str(tmp_path / "h.txt"), L.Layout("t", TEXT.fields)).orderBy("_rec").collect()
    assert [(r._rec, r.NAME, len(r._warnings)) for r in got] == [(0, "abc", 2), (1, "defghi", 0)]


def test_writer_and_several_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "SPLIT", 256)
    rows = spark.range(300).select(F.col("id").alias("_rec"), F.col("id").cast("decimal(10,0)").alias("ID"), F.lit("x").alias("NAME"), (F.col("id") / 4).cast("decimal(10,2)").alias("AMT"))
    records.write_fixed(L.encoded(rows.orderBy(F.rand(1)), TEXT), str(tmp_path / "out"), "\\n")
    got = records.scan(spark, str(tmp_path / "out"), TEXT)
    assert got.select("_rec", F.col("ID").cast("bigint")).where("_rec <> ID").isEmpty() and got.count() == 300


def test_dirty_fields(spark):
    lay = L.Layout("p", (L.Field("P", 0, 3, "comp3", 2, True), L.Field("N", 3, 4, "integer"), L.Field("F", 7, 8, "comp2")), 15)
    raw = [(0, bytes.fromhex("12345D") + b"0012" + b"\x3f\xd0" + b"\0" * 6), (1, bytes.fromhex("1A345C") + b"1 2 " + b"\0" * 8)]
    a, b = L.decoded(spark.createDataFrame(raw, "_rec bigint, raw binary"), lay).orderBy("_rec").collect()
    assert (a.P, a.N, a.F, a._abends) == (Decimal("-123.45"), 12, 0.25, [])
    assert [x.field for x in b._abends] == ["P", "N"] and b.P is None


def test_codepage():
    fields = (L.Field("A", 0, 4),)
    assert L.detect_codepage("ABCD".encode("cp037"), fields) == "cp037" and L.detect_codepage(b"ABCD", fields) is None
    with pytest.raises(L.LayoutError):
        L.Layout.of_json({"fields": [{"name": "A", "start": 0, "length": 1, "type": "odd"}]})


def test_copybook():
    [rec] = L.parse_copybook("""
       01 CUST.
          05 ID        PIC X(10).
          05 KIND      PIC X(3).
          05 BAL       PIC S9(9)V99 COMP-3.
          05 RAW REDEFINES BAL PIC X(6).
          05 DAYS      PIC 9(8).
          05 TAB OCCURS 3 TIMES.
             10 QTY    PIC S9(4) COMP.
    """)
    assert [(x.name, x.offset, x.length) for x in rec.children] == [("ID", 0, 10), ("KIND", 10, 3), ("BAL", 13, 6), ("RAW", 13, 6), ("DAYS", 19, 8), ("TAB", 27, 6)]
    assert rec.length == 33 and L.overlays([rec]) == [("RAW", "BAL", 13, 6, "")]
    lay = L.of_items([rec])
    assert [(f.name, f.start, f.type) for f in lay.fields][:3] == [("ID", 0, "string"), ("KIND", 10, "string"), ("BAL", 13, "comp3")]
    assert [f.length for f in L.of_items([rec], text=True).fields][:3] == [10, 3, 13]


def test_copy_replacing():
    lib = {"A": "       05 :P:-X PIC 9.\n       COPY B.", "B": "       05 OLD-Y PIC 9.\n       COPY A."}
    text, issues = expand_copies("       COPY A REPLACING ==:P:== BY ==NEW==.\n       COPY C.", lib)
    assert "NEW-X" in text and "OLD-Y" in text and sorted(issues) == [("A", "cycle"), ("C", "not found")]
    text, _ = expand_copies("COPY B REPLACING LEADING ==OLD== BY ==NEW==.", {"B": "05 OLD-Y PIC 9."})
    assert "NEW-Y" in text
    assert "HIDDEN" not in cleaned("      * HIDDEN\n       SHOWN.")


def test_pills(spark):
    lay = L.Layout("p", (L.Field("WSN", 0, 3, "integer"), L.Field("T", 3, 2)))
    got = {(r.field, r.pill): r.record for r in pills.records(pills.field_table(spark, lay)).collect()}
    assert got[("WSN", "max")] == "999  " and got[("T", "high_value")] == "000ÿÿ" and len(got) == 5
    named = pills.joined_pictures(pills.field_table(spark, lay), spark.createDataFrame([("WS-T", "X(2)")], "name string, picture string"))
    assert {r.name: r.picture for r in named.collect()} == {"WSN": None, "T": "X(2)"}


def test_compare_rules(spark):
    schema = "_rec bigint, A string, E string, _error string"
    p = spark.createDataFrame([(0, "1.50", "$1,000.00", None), (1, "x", None, None), (2, "5", "1", "boom"), (3, None, None, None), (4, "1", "1", None)], schema)
    e = spark.createDataFrame([(0, "1.5", "1000", None), (1, "y", "2", None), (2, "5", "1", None), (3, None, None, None), (5, "1", "1", None)], schema).drop("_error")
    got = {(r.record, r.field): r.difference for r in diff.compare(p, e, ["A", "E"], ["E"]).collect()}
    assert got == {(1, "A"): "STRING_MISMATCH", (1, "E"): "MISSING_VALUE", (2, "_execution_error"): "EXECUTION_ERROR", (4, "_record"): "Record missing from expected", (5, "_record"): "Record missing from produced"}
    both = diff.outcomes(p, e, ["A", "E"], ["E"])
    assert "DRIFT DETECTED: 4 RECORDS" in diff.report(diff.totals(both), diff.differences(both))


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    r = random.Random(1)
    values = [r.randint(0, 999) for _ in range(40)]
    data = "".join(f"{v:04d}abcdef{'1.00':>8}" for v in values)
    (src / "a.dat").write_text(data[: 18 * 25])
    expected = spark.createDataFrame([(18 * i, str(v + (i == 3))) for i, v in enumerate(values[:25])], "_rec bigint, ID string")
    stream = feed.arriving(spark, str(src), TEXT)
    feed.compare_stream(stream, expected, ["ID"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {x.event: x["count"] for x in feed.totals(spark, str(tmp_path / "out")).collect()} == {"match": 24, "drift": 1}


def test_data_bytes_that_look_like_line_ends(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(b"ABCDEFGH\nJKLMNOP")
    (tmp_path / "b.dat").write_bytes(b"1234\n\n567\n\r890\n")
    got = [bytes(r.raw) for r in records.read_fixed(spark, str(tmp_path / "a.dat"), 4).orderBy("offset").collect()]
    assert got == [b"ABCD", b"EFGH", b"\nJKL", b"MNOP"]
    assert [bytes(r.raw) for r in records.read_fixed(spark, str(tmp_path / "b.dat"), 4).orderBy("offset").collect()] == [b"1234", b"\n567", b"\r890"]
    (tmp_path / "c.dat").write_bytes(b"AB\nCD\nEF\n")
    assert [bytes(r.raw) for r in records.read_fixed(spark, str(tmp_path / "c.dat"), 3, "none").orderBy("offset").collect()] == [b"AB\n", b"CD\n", b"EF\n"]
    assert [records.stride_of(str(tmp_path / "c.dat"), n) for n in (2, 3, 9, 4)] == [3, 3, 9, 0]


@pytest.mark.parametrize("seed", range(5))
def test_packed_records_of_any_bytes(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(records, "SPLIT", 128)
    monkeypatch.setattr(records, "PIECE", 50)
    r = random.Random(seed)
    rows = [bytes(r.choice(b"\n\r\x00\x40\xf1Z") for _ in range(7)) for _ in range(r.randint(30, 90))]
    for name, separator in (("n.dat", b""), ("l.dat", b"\n"), ("w.dat", b"\r\n")):
        (tmp_path / name).write_bytes(separator.join(rows) + separator)
        assert [bytes(x.raw) for x in records.numbered(records.read_fixed(spark, str(tmp_path / name), 7)).orderBy("_rec").collect()] == rows
    varying = b"".join(x.replace(b"\n", b"!").replace(b"\r", b"?") + r.choice([b"", b"\n", b"\r\n"]) for x in rows)
    (tmp_path / "v.dat").write_bytes(varying + b"end")
    assert [bytes(x.raw) for x in records.read_fixed(spark, str(tmp_path / "v.dat"), 7).orderBy("offset").collect()] == [*(x.replace(b"\n", b"!").replace(b"\r", b"?") for x in rows), b"end"]


def test_line_files_are_numbered_by_name_and_place(spark, tmp_path):
    a, b = [f"a{i:05d}" for i in range(10)], [f"b{i:05d}" for i in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(a))
    (tmp_path / "b.txt").write_text("\n".join([*b[:40], "", *b[40:]]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    try:
        got = records.scan(spark, str(tmp_path), L.Layout("t", (L.Field("X", 0, 6),))).orderBy("_rec").collect()
        assert [(r._rec, r.X) for r in got] == list(enumerate(a + b))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_stream_sees_late_names(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda i: f"{i:04d}abcdef{'1.00':>8}"
    expected = spark.createDataFrame([(f"{f}.dat", 18 * i, str(10 * k + i)) for k, f in enumerate("abc") for i in range(4)], "_file string, _rec bigint, ID string")

    def run() -> dict:
        feed.compare_stream(feed.arriving(spark, str(src), TEXT), expected, ["ID"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        return {x.event: x["count"] for x in feed.totals(spark, str(tmp_path / "out")).collect()}

    (src / "b.dat").write_text("".join(line(10 + i) for i in range(4)))
    assert run() == {"match": 4}
    (src / "a.dat").write_text("".join(line(i) for i in range(4)))  # an earlier name, later
    assert run() == {"match": 8}
    (src / "c.dat").write_text("".join(line(21 + i) for i in range(4)))
    assert run() == {"match": 8, "drift": 4}


def test_digests_in_pieces(spark, tmp_path):
    import hashlib

    (tmp_path / "s.bin").write_bytes(b"abc")
    (tmp_path / "l.bin").write_bytes(b"x" * 10_000_000)
    got = {r.length: (r.sha256, r.accepted) for r in records.upload_digest(spark, str(tmp_path), most=1000, one_value=100).collect()}
    assert got == {3: (hashlib.sha256(b"abc").hexdigest(), True), 10_000_000: (hashlib.sha256(b"x" * 10_000_000).hexdigest(), False)}


def test_numproc(spark):
    fields = (L.Field("P", 0, 2, "comp3", 0, True),)
    raw = spark.createDataFrame([(i, bytes.fromhex("012" + sign)) for i, sign in enumerate("ABCDEF")], "_rec bigint, raw binary")
    free = L.decoded(raw, L.Layout("f", fields, 2)).orderBy("_rec").collect()
    assert [int(r.P) for r in free] == [12, -12, 12, -12, 12, 12]
    strict = L.decoded(raw, L.Layout.of_json({"fields": [{"name": "P", "start": 0, "length": 2, "type": "comp3"}], "numproc": "pfd"})).orderBy("_rec").collect()
    assert [r.P is None for r in strict] == [True, True, False, False, True, False] and [len(r._abends) for r in strict] == [1, 1, 0, 0, 1, 0]


def sequential(data: bytes, length: int) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(data):
        out.append((at, data[at : at + length]))
        at += length
        at += 2 if data[at : at + 2] == b"\r\n" else data[at : at + 1] in (b"\n", b"\r")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_varying_separators_are_split(spark, tmp_path, seed, monkeypatch):
    r = random.Random(seed)
    length = r.choice([1, 7, 30])
    monkeypatch.setattr(records, "SPLIT", r.choice([40, 64, 200]))
    monkeypatch.setattr(records, "PIECE", r.choice([50, 10_000]))
    monkeypatch.setattr(records, "FAN", 4 * (length + 2))  # so runs of runs
    files = {}
    for name in "ab":
        body = b"".join(bytes(r.choice(b"\n\rAZ0") for _ in range(length)) + r.choice([b"", b"", b"\n", b"\r", b"\r\n"]) for _ in range(r.randint(60, 300)))
        files[name] = body + (b"end" if name == "a" else b"")
        (tmp_path / name).write_bytes(files[name])
    (tmp_path / "empty").write_bytes(b"")
    splits = records.plan_splits(spark, str(tmp_path), length, "varying")
    got = records.read_fixed(spark, str(tmp_path), length, "varying")
    want = sorted((name, *x) for name, data in files.items() for x in sequential(data, length))
    assert sorted((x.file[-1], x.offset, bytes(x.raw)) for x in got.collect()) == want
    assert splits.count() > 10 or length == 1
    assert [bytes(x.raw) for x in records.numbered(got).orderBy("_rec").collect()] == [raw for *_, raw in want]


@pytest.mark.parametrize("strip", [1 << 20, 100])
def test_exits_of_a_chunk(strip, monkeypatch):
    monkeypatch.setattr(records, "STRIP", strip)
    r = random.Random(5)
    for length in (1, 3, 12):
        data = bytes(r.choice(b"\n\rabc") for _ in range(700))
        n = 600
        for entry, got in enumerate(records.exits(data, length, n).tolist()):
            at = entry
            while at < n:
                at += length
                at += 2 if data[at : at + 2] == b"\r\n" else data[at : at + 1] in (b"\n", b"\r")
            assert got == at - n


def test_prefix_sums_of_many_splits(spark):
    counts = spark.range(1_000_000, numPartitions=6).select((F.col("id") * 7919 % 1_000_003).alias("k"), (F.col("id") % 5).alias("n"))
    got = records.prefix_sums(counts, ["k"], "n", "before")
    wrong = got.withColumn("again", F.lag(F.col("before") + F.col("n"), 1, 0).over(Window.partitionBy(F.expr("k div 1000")).orderBy("k"))).where("again <> before AND k % 1000 > 20")
    assert wrong.isEmpty()
    last = got.orderBy(F.desc("k")).first()
    assert last.before + last.n == 2_000_000 and got.count() == 1_000_000


def test_numbers_beyond_a_leaf(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "LEAF", 5)
    monkeypatch.setattr(records, "SPLIT", 30)
    monkeypatch.setattr(records, "SPLITS", 20)
    for name in "ab":
        (tmp_path / name).write_bytes(b"".join(f"{name}{i:04d}".encode() for i in range(400)))
    got = records.numbered(records.read_fixed(spark, str(tmp_path), 5)).orderBy("_rec").collect()
    assert [(x._rec, bytes(x.raw)) for x in got] == [(i, f"{'ab'[i // 400]}{i % 400:04d}".encode()) for i in range(800)]
    assert records.positions(spark.range(50, numPartitions=9), "at", 3).where("at <> id + 3").isEmpty()
    records.register(spark)
    source = spark.read.format("fixedwidth").option("recordLength", 5).load(str(tmp_path))
    assert sorted(bytes(x.raw) for x in source.collect()) == sorted(bytes(x.raw) for x in got)


def test_positions_of_sampled_sort(spark):
    """Range partitions' bounds are sampled, and differ from run to run: a sorted frame must be numbered by the partitions that were counted."""
    size = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    before, merged = spark.conf.get(size), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set(size, "3")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(0, 20_000, numPartitions=4).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("k"), "id").orderBy("k", "id")
        out = records.positions(rows, "at", 1).toPandas().sort_values(["k", "id"])
    finally:
        spark.conf.set(size, before)
        spark.conf.set("spark.sql.adaptive.enabled", merged)
    assert list(out["at"]) == list(range(1, 20_001))


def test_code_pages_by_file(spark, tmp_path):
    """Files of several code pages in one folder; blank records are those of their own page; a file's first record decides nothing."""
    lay = L.Layout("c", (L.Field("N", 0, 3, "integer"), L.Field("T", 3, 9)), 12, codepage="auto")
    from tallyframe.functions import ebcdic

    def encoded(text, page):
        return text.encode("latin-1") if page is None else bytes(ebcdic.page(page).index(c) for c in text)

    for name, page in (("a", None), ("b", "cp037"), ("c", "cp1047"), ("d", None)):
        rows = [f"{i:03d}{'[x] ' + name + ('é' if i < 2 else 'abc'):<9}" for i in range(20)]
        blank = encoded(" " * 12, page)
        (tmp_path / name).write_bytes(blank + b"".join(encoded(r, page) for r in rows[:10]) + blank + b"".join(encoded(r, page) for r in rows[10:]))
    (tmp_path / "e").write_bytes(b"@" * 12 + b"1234567890ab")  # no blanks in ASCII
    got = records.scan(spark, str(tmp_path), lay).orderBy("_rec").collect()
    want = [(20 * k + i, f"[x] {name}{'é' if i < 2 else 'abc'}") for k, name in enumerate("abcd") for i in range(20)] + [(80, "@" * 9), (81, "4567890ab")]
    assert [(x._rec, x.T.rstrip()) for x in got] == want
    assert records.scan(spark, str(tmp_path / "e"), L.Layout("n", (L.Field("N", 0, 12, "integer"),), 12, codepage="auto")).count() == 2
