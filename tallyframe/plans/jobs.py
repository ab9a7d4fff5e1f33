"""Job control: JCL cards to tables of steps and data definitions, and the flow between steps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Dispositions that create and that read a data set.
CREATES, READS = ("NEW", "MOD"), ("SHR", "OLD")


def cards(text: str) -> list[str]:
    """Statements with their continuations joined; comments and instream data are left out."""
    out, instream = [], False
    for line in text.splitlines():
        line = line[:72].rstrip()
        if line.startswith("//*") or not line:
            continue
        if not line.startswith("//"):
            if line.startswith("/*"):
                instream = False
            continue
        instream = False
        body = line[2:]
        if out and out[-1].endswith(",") and body[:1] == " " and not re.match(r"\s+(EXEC|DD|JOB|IF|ELSE|ENDIF|SET|PROC|PEND)\b", body):
            out[-1] += body.strip()
        elif body.strip():
            out.append(body)
    return out


def _value(args: str, key: str) -> str | None:
    m = re.search(rf"(?:^|,){key}=(\((?:[^()]|\([^()]*\))*\)|'[^']*'|[^,\s]+)", args)
    return m[1] if m else None


def parse(text: str) -> dict:
    """``job``, ``steps`` (name, program, procedure, cond) and ``dds`` (step, ddname, dsn, disp)."""
    job, steps, dds, name = "UNNAMED", [], [], ""
    for card in cards(text):
        m = re.match(r"(\S*)\s+(JOB|EXEC|DD)\b\s*(.*)$", card)
        if not m:
            continue
        label, verb, args = m[1], m[2], m[3].strip()
        if verb == "JOB":
            job = label or job
        elif verb == "EXEC":
            program = _value(args, "PGM")
            first = args.split(",")[0]
            procedure = None if program else _value(args, "PROC") or (first if "=" not in first else None)
            name = label or f"STEP{len(steps) + 1}"
            steps.append((name, program, procedure, _value(args, "COND")))
        elif steps:
            dsn = _value(args, "DSN") or _value(args, "DSNAME")
            disp = (_value(args, "DISP") or "").strip("()").split(",")[0] or None
            dds.append((name, label or (dds[-1][1] if dds else ""), dsn.strip("'") if dsn else None, disp))
    return {"job": job, "steps": steps, "dds": dds}


def tables(spark: SparkSession, texts: DataFrame, name_col: str = "name", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``steps(job, idx, step, program, procedure, cond)`` and ``dds(job, idx, step, seq, ddname, dsn, disp)`` of many jobs."""
    import pandas as pd

    def steps(batches):
        for b in batches:
            rows = [(p["job"], i, *s) for t in b[text_col] for p in [parse(t or "")] for i, s in enumerate(p["steps"])]
            yield pd.DataFrame(rows, columns=["job", "idx", "step", "program", "procedure", "cond"])

    def dds(batches):
        for b in batches:
            rows = []
            for t in b[text_col]:
                p = parse(t or "")
                at = {s[0]: i for i, s in enumerate(p["steps"])}
                rows += [(p["job"], at[d[0]], d[0], k, *d[1:]) for k, d in enumerate(p["dds"])]
            yield pd.DataFrame(rows, columns=["job", "idx", "step", "seq", "ddname", "dsn", "disp"])

    given = texts.select(name_col, text_col)
    return given.mapInPandas(steps, "job string, idx int, step string, program string, procedure string, cond string"), given.mapInPandas(dds, "job string, idx int, step string, seq int, ddname string, dsn string, disp string")


def datasets(dds: DataFrame) -> DataFrame:
    """Steps of each data set, in order."""
    rows = dds.where(F.col("dsn").isNotNull()).groupBy("job", "dsn").agg(F.array_sort(F.collect_list(F.struct("idx", "seq", "step"))).alias("s"))
    return rows.select("job", "dsn", F.transform("s", lambda x: x["step"]).alias("steps"))


def dependencies(steps: DataFrame, dds: DataFrame) -> DataFrame:
    """``job``, ``src``, ``dst``, ``kind``: each step to the next, and the last creator of a data set to its readers. An edge
    that is both is the sequential one."""
    follow = steps.select("job", F.col("step").alias("src"), F.lead("step").over(Window.partitionBy("job").orderBy("idx")).alias("dst"), F.lit("sequential").alias("kind")).where(F.col("dst").isNotNull())
    created = dds.where(F.col("dsn").isNotNull() & F.col("disp").isin(*CREATES)).groupBy("job", "dsn").agg(F.max_by("step", F.struct("idx", "seq")).alias("src"))
    read = dds.where(F.col("dsn").isNotNull() & F.col("disp").isin(*READS)).select("job", "dsn", F.col("step").alias("dst"))
    handoff = created.join(read, ["job", "dsn"]).where("src <> dst").select("job", "src", "dst", F.lit("dataset").alias("kind")).distinct()
    return follow.union(handoff.join(follow.select("job", "src", "dst"), ["job", "src", "dst"], "left_anti"))


def flow(steps: DataFrame, dds: DataFrame) -> DataFrame:
    """One row for each job: steps, data sets, dependencies, conditional steps."""
    a = steps.groupBy("job").agg(F.count("*").alias("steps"), F.count("cond").alias("conditional"))
    b = dds.groupBy("job").agg(F.countDistinct("dsn").alias("datasets"))
    c = dependencies(steps, dds).groupBy("job").agg(F.count("*").alias("dependencies"))
    return a.join(b, "job", "left").join(c, "job", "left").na.fill(0)
