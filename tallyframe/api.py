"""Entry points: one function for each thing a user does. All return DataFrames unless they say otherwise."""

from __future__ import annotations

import json
import sys
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.conf import CobolConf
from tallyframe.plans import analysis, diff, interp, jobs, lang, portfolio, vault
from tallyframe.plans import compile as compiler
from tallyframe.sources import pills, records
from tallyframe.sources.layout import Layout, decoded

VERSION = "0.1"


def load_programs(spark: SparkSession, folder: str) -> DataFrame:
    """``name``, ``source`` of a folder's program files (.cbl, .cob, .cobol); the name is the PROGRAM-ID."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.{cbl,cob,cobol,CBL,COB}")
    return files.select(F.upper(F.coalesce(F.nullif(F.regexp_extract("value", r"(?i)PROGRAM-ID\.\s+['\"]?([\w-]+)", 1), F.lit("")), F.lit("UNNAMED"))).alias("name"), F.col("value").alias("source"))


def load_library(folder: str) -> dict[str, str]:
    """Copybook members of a folder, by upper-case name; a zip file is read as a folder."""
    import zipfile

    path = Path(folder)
    if path.suffix == ".zip":
        with zipfile.ZipFile(path) as z:
            return {Path(n).stem.upper(): z.read(n).decode("latin-1") for n in z.namelist() if Path(n).suffix.lower() in (".cpy", ".cbl", ".cob", "") and not n.endswith("/")}
    return {p.stem.upper(): p.read_text("latin-1") for p in path.iterdir() if p.suffix.lower() in (".cpy", ".copy", ".cbl")}


def analyze(source: str, library: Mapping[str, str] | None = None) -> dict:
    """One program's facts, roles and review flags, as a dict."""
    out = lang.facts("program", source, library)
    if not out["errors"]:
        out["roles"] = analysis.classified(lang.parse_program(source, library))
    return out


def analyze_batch(spark: SparkSession, programs: DataFrame, library: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Portfolio tables of many programs and what follows from them."""
    table = lang.portfolio(spark, programs, library)
    t = {name: table(name) for name in lang.TABLES}
    calls = portfolio.calls(t["programs"])
    risks = portfolio.arithmetic_risk(t["computes"], t["variables"].select("program", "name", "int_digits", "dec_digits"))
    flags = t["issues"].groupBy("program").agg(F.count("*").alias("flags"))
    verdicts = t["programs"].select("program").join(flags, "program", "left").select("program", F.coalesce("flags", F.lit(0)).alias("flags"), (F.coalesce("flags", F.lit(0)) == 0).alias("verified"))
    return t | {"calls": calls, "risks": risks, "dead_code": portfolio.dead_code(t["paragraphs"], t["edges"]), "order": portfolio.topological(calls, t["programs"]), "heatmap": heatmap(t), "matrix": portfolio.compiler_matrix(t["programs"].drop("source", "lines"), t["variables"], t["statements"]), "taint": portfolio.taint(portfolio.host_variables(t["blocks"]), t["variables"]), "verdict": portfolio.batch_verdict(verdicts)}


def heatmap(t: Mapping[str, DataFrame]) -> DataFrame:
    n = lambda test, name: F.count_if(test).cast("int").alias(name)
    s, v, b = t["statements"], t["variables"], t["blocks"]
    out = t["programs"].select("program", "lines")
    parts = (
        s.groupBy("program").agg(n(F.col("kind") == "ALTER", "alters"), n(F.col("kind") == "GO TO", "gotos"), n(F.col("kind") == "PERFORM", "performs"), F.size(F.array_intersect(F.collect_set("kind"), F.array(*map(F.lit, portfolio.CATEGORIES)))).alias("categories")),
        v.groupBy("program").agg(n(F.col("odo"), "odo"), n(F.col("occurs") > 50, "large_occurs"), n(F.col("redefines").isNotNull(), "redefines"), n(F.col("storage") == "COMP-3", "comp3")),
        b.groupBy("program").agg(n(F.col("kind") == "EXEC SQL", "exec_sql"), n(F.col("kind") == "EXEC CICS", "exec_cics")), t["copies"].groupBy("program").agg(F.count("*").cast("int").alias("copy_issues")),
    )
    for p in parts:
        out = out.join(p, "program", "left")
    return portfolio.heatmap(out.na.fill(0))


def generate_layout(source: str) -> tuple[Layout, Layout]:
    """Input and output layouts of a program."""
    return analysis.layout(lang.parse_program(source))


def run_program(spark: SparkSession, source: str, rows: DataFrame, inputs: Mapping[str, str], outputs: Mapping[str, str], conf: CobolConf | None = None, library: Mapping[str, str] | None = None, route: str = "auto") -> tuple[DataFrame, str]:
    return compiler.execute(lang.parse_program(source, library, conf), rows, inputs, outputs, route)


def trace(source: str, inputs: Mapping[str, str]) -> list[dict]:
    """State changes of one run (line, verb, variable, old and new value), as a list."""
    m = interp.Machine(lang.parse_program(source), trace=True)
    interp.run_record(m, inputs)
    return m.events


def shadow_diff(produced: DataFrame, expected: DataFrame, layout: Layout) -> dict[str, DataFrame]:
    """Differences, their diagnosis, totals with the verdict, and the event feed."""
    fields = list(layout.output_fields) or [f.name for f in layout.fields]
    outcome = diff.outcomes(produced, expected, fields, [f.name for f in layout.fields if f.edited])
    found = diff.differences(outcome)
    return {"differences": found, "diagnosis": diff.diagnose(found, {f.name: f.type for f in layout.fields}), "totals": diff.totals(outcome), "events": diff.events(outcome)}


def verify(spark: SparkSession, source: str, layout: Layout, input_path: str, expected_path: str, expected_layout: Layout, conf: CobolConf | None = None) -> dict[str, DataFrame]:
    """A program over an input file against an expected output file. Layout names are variables unless ``input_mapping`` says otherwise."""
    rows = records.scan(spark, input_path, layout)
    names = {f.name: layout.input_mapping.get(f.name, f.name) for f in layout.fields}
    produced, route = run_program(spark, source, rows, names, {f.name: f.name for f in expected_layout.fields}, conf)
    produced = produced.join(rows.select("_rec", "_abends"), "_rec")
    return shadow_diff(produced, records.scan(spark, expected_path, expected_layout), expected_layout) | {"produced": produced.withColumn("_route", F.lit(route))}


def run_pills(spark: SparkSession, source: str, layout: Layout) -> DataFrame:
    """Every boundary record through the program: ``field``, ``pill``, ``status`` (clean, abend, error) and ``message``."""
    made = pills.records(pills.field_table(spark, layout))
    made = records.positions(made.orderBy("field", "pill"), "_rec")
    rows = decoded(made.select("_rec", F.encode("record", "ISO-8859-1").alias("raw")), layout)
    names = {f.name: layout.input_mapping.get(f.name, f.name) for f in layout.fields}
    out, _ = run_program(spark, source, rows, names, {}, route="arrow")
    status = F.when(F.size("_abends") > 0, "abend").when(F.col("_error").isNotNull(), "error").otherwise("clean")
    return made.join(rows.select("_rec", "_abends"), "_rec").join(out, "_rec").select("field", "pill", status.alias("status"), F.coalesce("_error", F.lit("")).alias("message"))


def parse_jcl(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    return jobs.tables(spark, spark.createDataFrame([("job", text)], "name string, text string"))


def main(args: list[str]) -> int:
    """``python -m tallyframe.api analyze FILE | layout FILE | batch FOLDER | dependency FOLDER | verify FILE LAYOUT INPUT EXPECTED LAYOUT | chain FOLDER |
    export FOLDER USER TARGET | signature FILE KEYFILE HEX | health | version``. ``verify`` ends with 0 without drift, 1 with drift, 2 on an error; ``chain`` and
    ``signature`` with 1 if something was changed."""
    if not args or args[0] == "version":
        print(VERSION)
        return 0
    if args[0] == "signature":
        import hashlib
        import hmac

        own = hmac.new(Path(args[2]).read_bytes().strip(), Path(args[1]).read_bytes(), hashlib.sha256).hexdigest()
        same = hmac.compare_digest(own, args[3].strip().lower())
        print("valid" if same else "not valid")
        return int(not same)
    if args[0] in ("analyze", "layout"):
        source = Path(args[1]).read_text("latin-1")
        if args[0] == "analyze":
            print(json.dumps(analyze(source), default=str, indent=1))
        else:
            for x in generate_layout(source):
                print(json.dumps({"name": x.name, "record_length": x.record_length, "fields": [vars(f) for f in x.fields]}, indent=1))
        return 0
    spark = SparkSession.builder.appName("tallyframe").config("spark.ui.enabled", "false").getOrCreate()
    try:
        if args[0] == "batch":
            out = analyze_batch(spark, load_programs(spark, args[1]))
            for name in ("verdict", "heatmap", "order"):
                out[name].show(100, False)
            return 0
        if args[0] == "dependency":
            programs = lang.portfolio(spark, load_programs(spark, args[1]))("programs")
            calls = portfolio.calls(programs)
            for found in (portfolio.called_by(calls), portfolio.unresolved(calls, programs), portfolio.call_cycles(calls), portfolio.topological(calls, programs)):
                found.show(1000, False)
            return 0
        if args[0] == "export":
            vault.export(spark.read.parquet(args[1]), args[2]).write.text(args[3])
            return 0
        if args[0] == "health":
            print(json.dumps({"version": VERSION, "spark": spark.version, "master": spark.sparkContext.master, "rows": spark.range(1000).count()}))
            return 0
        if args[0] == "chain":
            log = spark.read.parquet(args[1])
            row = vault.summary(vault.verify(log, [c for c in sorted(log.columns) if c != "record_hash"])).first()
            print(row.asDict())
            return int(not row.chain_intact)
        if args[0] == "verify":
            read = lambda p: Layout.of_json(Path(p).read_text())
            found = verify(spark, Path(args[1]).read_text("latin-1"), read(args[2]), args[3], args[4], read(args[5]))
            print(diff.report(found["totals"], found["differences"], args[2]))
            return int(found["totals"].first().mismatches > 0)
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
