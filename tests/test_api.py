"""Whole runs: a program over a file against expected output, portfolios, the store."""

import json
from decimal import Decimal

from pyspark.sql import functions as F

from tallyframe import api
from tallyframe.plans import analysis, catalog, fixtures, lang, portfolio, vault
from tallyframe.sources.layout import Field, Layout

GIVEN = Layout("shipment", (Field("SHIP-NO", 0, 8), Field("CARGO-VALUE", 8, 12, "decimal", 2), Field("WEIGHT-KG", 20, 5, "integer"), Field("ZONE-NO", 25, 2, "integer"), Field("SERVICE", 27, 2)), 0, input_mapping={})
WANTED = Layout("bill", (Field("FREIGHT", 0, 40, "decimal", 2), Field("KILO-COST", 40, 40, "decimal", 5), Field("TOTAL-DUE", 80, 40, "decimal", 2)), 0)


def shipment_files(folder, drift=()):
    """Inputs, and bills computed apart from the engine."""
    rows, out = [], []
    cut = lambda x, n: Decimal(int(x * 10**n)) / 10**n
    for i in range(100):
        value, weight, zone, service = Decimal(310412 + i * 93731) / 100, i * 211 % 20000, i % 20, ("ST", "EX", "UR", "AB")[i % 4]
        rows.append(f"{'S' + str(i):<8}{value:>12.2f}{weight:>5d}{zone:>2d}{service}")
        rate = Decimal("41.75") if zone < 3 else Decimal("58.20") if zone < 9 else 60 + zone * Decimal("1.35")
        kilo = cut(rate / 7, 5)
        freight, hurried = cut(weight * kilo, 2), service in ("EX", "UR")
        premium = min(Decimal(int(value * 35 / 100 + Decimal("0.5"))) / 100, Decimal(180))
        extra = min(cut(freight * Decimal("0.185") + (weight // 450 + 1) * Decimal("4.25"), 2), Decimal(950)) if hurried else 0
        total = freight + premium + extra - (Decimal("12.50") if value > 20000 and not hurried else 0) + (Decimal("0.01") if i in drift else 0)
        out.append(f"{freight:>40.2f}{kilo:>40.5f}{total:>40.2f}")
    (folder / "in.dat").write_text("\n".join(rows))
    (folder / "out.dat").write_text("\n".join(out))


def test_shipments_verify(spark, tmp_path):
    program = fixtures.FREIGHT.replace("       01 CARGO-VALUE ", "       01 SHIP-NO PIC X(8).\n       01 CARGO-VALUE ")
    for drift in ((), (10, 25, 50, 75, 90)):
        shipment_files(tmp_path, drift)
        found = api.verify(spark, program, GIVEN, str(tmp_path / "in.dat"), str(tmp_path / "out.dat"), WANTED)
        t = found["totals"].first()
        assert (t.total_records, t.mismatches, t.record_count_mismatch) == (100, len(drift), False)
        assert [(r.record, r.field, r.difference, r.likely_cause) for r in found["diagnosis"].orderBy("record").collect()] == [(i, "TOTAL-DUE", "0.01", "Rounding divergence below a cent") for i in drift]
        assert found["produced"].first()._route == "native"


def test_roles_and_layout():
    p = lang.parse_program(fixtures.TIERS)
    assert dict(analysis.classified(p)) == {"QTY": "input", "LEFTQ": "output", "STEP-N": "input output", "SCORE": "input output"}
    given, out = analysis.layout(p)
    assert [f.name for f in given.fields] == ["QTY", "STEP-N", "SCORE"] and out.record_length == 120
    assert "roles" in api.analyze(fixtures.FREIGHT) and api.analyze("       PROCEDURE DIVISION.\n       X1.\n           MOVE.")["errors"]


def test_trace():
    events = api.trace(fixtures.TIERS, {"QTY": "15"})
    assert events[0]["verb"] == "MOVE" and events[-1]["new_value"] == "10"


def test_batch(spark):
    out = api.analyze_batch(spark, catalog.sources(spark))
    assert out["verdict"].first().programs == 4
    assert {r.program: r.status for r in out["heatmap"].collect()}["MAINPAY"] == "red"
    assert out["errors"].isEmpty() and {r.program for r in portfolio.call_cycles(out["calls"]).collect()} == set()


def test_pills_run(spark):
    layout = Layout("q", (Field("QTY", 0, 5, "integer"),), 5)
    got = {r.pill: r.status for r in api.run_pills(spark, fixtures.TIERS, layout).collect()}
    assert got == {"max": "clean", "zero": "clean", "overflow": "clean"}


def test_vault(spark, tmp_path):
    path = str(tmp_path / "v")
    row = lambda i: {"id": i, "username": "u", "source": f"s{i}", "code": "c", "report": "r"}
    hashes = [vault.append(spark, path, row(i)) for i in range(3)]
    log = spark.read.parquet(path)
    hashed = [c for c in sorted(log.columns) if c != "record_hash"]
    assert vault.summary(vault.verify(log, hashed)).first().chain_intact and len(set(hashes)) == 3
    bad = log.withColumn("report", F.when(F.col("id") == 1, "x").otherwise(F.col("report")))
    s = vault.summary(vault.verify(bad.where("id <> 0"), hashed)).first()
    assert (s.chain_breaks, s.tampered) == (1, 1)
    assert [r.id for r in vault.listing(log, "u", 2).collect()] == [2, 1] and vault.without(log, "u", 1).count() == 2
    key = F.lit("0123456789abcdef")
    assert spark.range(1).select(vault.decrypted(vault.encrypted(F.lit("secret"), key), key)).first()[0] == "secret"


def test_recursion_and_topology(spark):
    calls = spark.createDataFrame([("A", "B", "STATIC"), ("B", "C", "STATIC"), ("C", "B", "STATIC"), ("D", "A", "STATIC")], "program string, target string, kind string")
    programs = spark.createDataFrame([(x,) for x in "ABCDE"], "program string")
    assert {r.program for r in portfolio.call_cycles(calls).collect()} == {"B", "C"}
    assert {r.program: r.depth for r in portfolio.topological(calls, programs).collect()} == {"E": 0, "A": -1, "B": -1, "C": -1, "D": -1}
    assert {r.program for r in portfolio.call_roots(calls, programs).collect()} == {"D", "E"}


def test_signatures_and_export(spark, tmp_path):
    import hashlib
    import hmac
    import json

    key, texts = "k" * 20, ["", "a report", "é\n" * 50]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "id bigint, username string, report string")
    got = [r[0] for r in df.orderBy("id").select(vault.signature(F.col("report"), F.lit(key))).collect()]
    assert got == [hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest() for t in texts]
    lines = [json.loads(r.value) for r in vault.export(df, "u").collect()]
    assert [(x["id"], x["report"]) for x in lines] == list(enumerate(texts)) and vault.export(df, "v").isEmpty()
    vault.save_reports(df, str(tmp_path / "r"))
    vault.save_reports(df.withColumn("username", F.lit("v")), str(tmp_path / "r"))
    assert sorted((r.username, r.id) for r in vault.newest(vault.saved_reports(spark, str(tmp_path / "r")), 2).collect()) == [("u", 1), ("u", 2), ("v", 1), ("v", 2)]
    (tmp_path / "key").write_text(key)
    (tmp_path / "text").write_text(texts[1])
    assert api.main(["signature", str(tmp_path / "text"), str(tmp_path / "key"), got[1]]) == 0 and api.main(["signature", str(tmp_path / "text"), str(tmp_path / "key"), got[0]]) == 1


def test_review_flags():
    text = "       PROGRAM-ID. FLAGS.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       01 N PIC 9(3).\n       01 X PIC X(3).\n       PROCEDURE DIVISION.\n       P1.\n           PERFORM NOWHERE.\n           INSPECT X CONVERTING 'AB' TO 'X'.\n           COMPUTE N = FUNCTION RANDOM(1).\n"
    reasons = [reason for _, reason, *_ in lang.facts("f", text)["issues"]]
    assert sorted(reasons) == ["FUNCTION RANDOM isn't known", "INSPECT CONVERTING of unequal lengths", "PERFORM of NOWHERE, which isn't there"]
    assert lang.facts("t", fixtures.TIERS)["issues"] == [] and lang.facts("f", fixtures.FREIGHT)["issues"] == []


def test_traces_of_many_records(spark):
    from tallyframe.plans import compile as compiler

    rows = spark.createDataFrame([(1, "15"), (2, "3"), (3, "x")], "_rec bigint, q string")
    out = compiler.traced(lang.parse_program(fixtures.TIERS), rows, {"q": "QTY"}).collect()
    one = [r for r in out if r._rec == 1]
    want = api.trace(fixtures.TIERS, {"QTY": "15"})
    assert [(r.idx, r.verb, r.variable, r.new_value) for r in sorted(one, key=lambda r: r.idx)] == [(i, e["verb"], e["variable"], e["new_value"]) for i, e in enumerate(want)]
    assert [r.error is not None for r in out if r._rec == 3] == [True] and sum(r._rec == 2 for r in out) == 2


def test_other_routes_of_the_flagship(spark):
    from tallyframe.plans import compile as compiler

    rows = spark.createDataFrame([(i, f"{i * 7919}.{i % 100:02d}", str(i * 37 % 20000), str(i % 20), ("ST", "EX", "UR")[i % 3]) for i in range(60)], "_rec bigint, value string, weight string, zone string, service string")
    results = [sorted(map(tuple, compiler.execute(lang.parse_program(p), rows, catalog.FREIGHT_IN, catalog.FREIGHT_OUT, route)[0].collect())) for p in (fixtures.FREIGHT, fixtures.FREIGHT_SIZED) for route in ("native", "columns", "arrow")]
    assert results[0] == results[1] == results[2] and results[3] == results[4] == results[5]


def test_large_sbom_is_divided(spark, monkeypatch):
    """No document, and so no task, has more components than ``SHEET``; all are listed once, in order; one of few components is whole."""
    programs = spark.createDataFrame([(f"P{k:02d}",) for k in range(25)], "program string")
    call = spark.createDataFrame([("P01", "P02", "STATIC"), ("P01", "LIB", "STATIC"), ("P02", "ANY", "DYNAMIC")], "program string, target string, kind string")
    copies, tables = spark.createDataFrame([("P01", "LIB")], "program string, copybook string"), spark.createDataFrame([("ACCTS",)], "table string")
    want = [("application", f"P{k:02d}", "program") for k in range(25)] + [("data", "ACCTS", "DB2 table"), ("library", "LIB", "called program"), ("library", "LIB", "copybook"), ("library", "P02", "called program")]

    listed = lambda x: [(c["type"], c["name"], c["description"]) for c in x["components"]]
    for size, parts in ((100, 1), (29, 1), (28, 2), (10, 3), (1, 29)):
        monkeypatch.setattr(portfolio, "SHEET", size, raising=False)
        bom = portfolio.sbom(programs, call, copies, tables)
        docs = sorted((json.loads(r.sbom) for r in bom.collect()), key=listed)
        assert [c for x in docs for c in listed(x)] == want
        assert portfolio.sbom_problems(bom).count() == 0
        assert [len(x["components"]) for x in docs] == [min(size, 29 - i) for i in range(0, 29, size)]
        assert [x["metadata"]["properties"][0]["value"] if "metadata" in x else "1/1" for x in docs] == [f"{i}/{parts}" for i in range(1, parts + 1)]
        assert len({x["serialNumber"] for x in docs}) == parts
    none = portfolio.sbom(*(df.limit(0) for df in (programs, call, copies, tables))).collect()
    assert [json.loads(r.sbom)["components"] for r in none] == [[]]
