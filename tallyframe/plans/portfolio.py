"""Portfolio analytics over tables of program facts.

``programs(program, lines, source)``, ``statements(program, seq, paragraph, kind, detail, line)``, ``variables(program, name, picture, storage,
signed, int_digits, dec_digits, occurs)``, ``edges(program, src, dst, kind)``, ``paragraphs(program, idx, name, line, ends)`` and ``blocks(program, seq, kind,
verb, body)`` are what ``plans.lang.facts`` makes of sources; any tables of these columns do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import exact
from tallyframe.plans import graphs
from tallyframe.plans.lang import ENDS, VERBS
from tallyframe.plans.scratch import cut
from tallyframe.sources.records import prefix_sums

#: Statement kinds that count as construct categories.
CATEGORIES = ("PERFORM", "COMPUTE", "IF", "EVALUATE", "MOVE", "ARITHMETIC", "STRING", "UNSTRING", "INSPECT", "SEARCH", "SORT", "CALL", "GO TO")


def control_edges(paragraphs: DataFrame, edges: DataFrame) -> DataFrame:
    """``program``, ``src``, ``dst``: PERFORM and GO TO edges between known paragraphs, the chain of each THRU range, and fall-through from
    paragraphs that neither leave (``ends``) nor are performed. A THRU edge has kind ``THRU`` and its range in src -> first (kind
    PERFORM) and ``first`` .. ``dst``: columns ``first`` and ``dst``."""
    names = paragraphs.select("program", F.col("name").alias("n"), F.col("idx").alias("i"))
    known = lambda df, c: df.join(names.select("program", F.col("n").alias(c)), ["program", c], "left_semi")
    direct = known(known(edges.where(F.col("kind").isin("PERFORM", "GO TO") & F.col("src").isNotNull()).select("program", "src", "dst"), "src"), "dst")
    follows = paragraphs.select("program", F.col("name").alias("src"), "idx", "ends", F.lead("name").over(Window.partitionBy("program").orderBy("idx")).alias("dst")).where(F.col("dst").isNotNull())
    ranges = edges.where(F.col("kind") == "THRU").join(names.select("program", F.col("n").alias("first"), F.col("i").alias("a")), ["program", "first"]).join(names.select("program", F.col("n").alias("dst"), F.col("i").alias("b")), ["program", "dst"])
    ranges = ranges.select("program", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    chain = follows.join(ranges, "program").where((F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi"))).select("program", "src", "dst")
    performed = edges.where(F.col("kind").isin("PERFORM", "THRU")).select("program", F.explode(F.array("dst", F.coalesce("first", "dst"))).alias("src")).distinct()
    fall = follows.where(~F.col("ends")).join(performed, ["program", "src"], "left_anti").select("program", "src", "dst")
    return direct.select("program", "src", "dst").unionByName(chain).unionByName(fall).distinct()


def _each(edges: DataFrame, found: Callable[[list], Iterable[str]]) -> DataFrame:
    """``program``, ``node``: what ``found`` makes of the (``src``, ``dst``) pairs of each program. A program's graph is as small as the program, so it is walked whole, a row of a batch: one shuffle,
    whatever the depth, and no group of its own for Python."""
    import pyarrow as pa

    def rows(batches):
        for b in batches:
            got = [(p, n) for p, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n in found([(x["src"], x["dst"]) for x in pairs])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.string()) for k in (0, 1)], names=["program", "node"])

    return edges.groupBy("program").agg(F.collect_list(F.struct("src", "dst")).alias("pairs")).mapInArrow(rows, "program string, node string")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``program``, ``node``: what the seeds (``program``, ``node``) reach over ``src`` -> ``dst``."""

    def walk(pairs: list) -> set:
        after: dict = {}
        todo = []
        for src, dst in pairs:
            if src is None:
                todo.append(dst)
            else:
                after.setdefault(src, []).append(dst)
        found: set = set()
        while todo:
            node = todo.pop()
            if node not in found:
                found.add(node)
                todo += after.get(node, [])
        return found

    return _each(edges.select("program", "src", "dst").unionByName(seeds.select("program", F.lit(None).cast("string").alias("src"), F.col("node").alias("dst"))), walk)


def seeds(paragraphs: DataFrame, edges: DataFrame) -> DataFrame:
    """The first paragraph, targets of statements before it, and all of a program with ALTER."""
    first = paragraphs.groupBy("program").agg(F.min_by("name", "idx").alias("node"))
    outside = edges.where(F.col("src").isNull() & F.col("kind").isin("PERFORM", "GO TO", "THRU")).select("program", F.col("dst").alias("node"))
    altered = paragraphs.join(edges.where(F.col("kind") == "ALTER").select("program").distinct(), "program", "left_semi").select("program", F.col("name").alias("node"))
    return first.union(outside.join(paragraphs.select("program", F.col("name").alias("node")), ["program", "node"], "left_semi")).union(altered)


def dead_code(paragraphs: DataFrame, edges: DataFrame) -> DataFrame:
    """``program``, ``name``, ``line``, ``reachable``."""
    got = reachable(control_edges(paragraphs, edges), seeds(paragraphs, edges)).withColumn("reachable", F.lit(True))
    return paragraphs.join(got.withColumnRenamed("node", "name"), ["program", "name"], "left").select("program", "name", "line", F.coalesce("reachable", F.lit(False)).alias("reachable"))


def dead_summary(dead: DataFrame) -> DataFrame:
    n = F.count_if(~F.col("reachable"))
    return dead.groupBy("program").agg(F.count("*").alias("total_paragraphs"), F.count_if(F.col("reachable")).alias("reachable_paragraphs"), F.round(n * 100.0 / F.count("*"), 1).alias("dead_percentage"))


def on_cycles(pairs: list) -> list:
    """Nodes on a cycle of one graph's (``src``, ``dst``) pairs: depth-first, then backward from the last left, each node twice (Kosaraju)."""
    after: dict = {}
    before: dict = {}
    for src, dst in pairs:
        after.setdefault(src, []).append(dst)
        before.setdefault(dst, []).append(src)
    left, seen = [], set()
    for start in after:
        todo = [(start, False)]
        while todo:
            node, done = todo.pop()
            if done:
                left.append(node)
            elif node not in seen:
                seen.add(node)
                todo.append((node, True))
                todo += [(n, False) for n in after.get(node, ())]
    found, taken = [], set()
    for start in reversed(left):
        if start in taken:
            continue
        members, todo = [], [start]
        taken.add(start)
        while todo:
            node = todo.pop()
            members.append(node)
            more = set(before.get(node, ())) - taken
            taken |= more
            todo += more
        if len(members) > 1 or start in after.get(start, ()):
            found += members
    return found


def perform_cycles(edges: DataFrame) -> DataFrame:
    """``program``, ``name`` of paragraphs on a cycle of PERFORM edges."""
    performs = edges.where((F.col("kind") == "PERFORM") & F.col("src").isNotNull() & F.col("dst").isNotNull())
    return _each(performs.select("program", "src", "dst"), on_cycles).withColumnRenamed("node", "name")


# Calls --------------------------------------------------------------------------------------------------


def calls(programs: DataFrame) -> DataFrame:
    """``program``, ``target``, ``kind`` (STATIC or DYNAMIC) and ``args`` of CALLs in source texts."""
    stops = "|".join(sorted(VERBS | ENDS, key=len, reverse=True))
    argument = r"(?:BY\s+)?(?:REFERENCE\s+|CONTENT\s+|VALUE\s+)?(?!(?:" + stops + r")\b)[A-Z0-9-]+"
    target = r"""(?:'[^']+'|"[^"]+"|[A-Z0-9-]+)"""
    found = F.regexp_extract_all("source", F.lit(rf"(?is)\bCALL\s+{target}(?:\s+USING\s+{argument}(?:[\s,]+{argument})*)?"), F.lit(0))
    each = programs.select("program", F.explode(found).alias("c"))
    target = F.regexp_extract("c", r"""(?i)CALL\s+['"]?([A-Z0-9-]+)""", 1)
    using = F.regexp_extract("c", r"(?is)\sUSING\s+(.*)$", 1)
    args = F.filter(F.split(F.upper(using), r"[\s,]+"), lambda a: (a != "") & ~a.isin("BY", "REFERENCE", "CONTENT", "VALUE"))
    return each.select("program", F.upper(target).alias("target"), F.when(F.col("c").rlike(r"""(?i)CALL\s+['"]"""), "STATIC").otherwise("DYNAMIC").alias("kind"), args.alias("args"))


def called_by(call: DataFrame) -> DataFrame:
    return call.where("kind = 'STATIC'").groupBy(F.col("target").alias("program")).agg(F.array_sort(F.collect_set("program")).alias("called_by"))


def unresolved(call: DataFrame, programs: DataFrame) -> DataFrame:
    return call.where("kind = 'STATIC'").join(programs.select(F.col("program").alias("target")), "target", "left_anti").select("program", "target").distinct()


def call_roots(call: DataFrame, programs: DataFrame) -> DataFrame:
    return programs.select("program").join(call.where("kind = 'STATIC' AND program <> target").select(F.col("target").alias("program")), "program", "left_anti")


def call_cycles(call: DataFrame) -> DataFrame:
    """Programs on a cycle of static calls."""
    return graphs.components(call.where("kind = 'STATIC'").select(F.col("program").alias("src"), F.col("target").alias("dst"))).select(F.col("node").alias("program"))


def topological(call: DataFrame, programs: DataFrame) -> DataFrame:
    """``program``, ``depth`` (callees first; -1 on or above a cycle) and ``position`` by depth, then name. A level of the graph is a written table."""
    found = graphs.levels(call.where("kind = 'STATIC'").select(F.col("program").alias("src"), F.col("target").alias("dst")), programs.select(F.col("program").alias("node")))
    ranked = cut(found.select(F.col("node").alias("program"), F.col("level").alias("depth"), (F.col("level") < 0).alias("last"), F.lit(1).cast("bigint").alias("one")), "ranked")
    return prefix_sums(ranked, ["last", "depth", "program"], "one", "before").select("program", "depth", (F.col("before") + 1).cast("int").alias("position"))


def call_order(call: DataFrame, programs: DataFrame) -> DataFrame:
    """``program``, ``rank``, ``position``: callees before callers; programs on or below a cycle come first."""
    found = graphs.callees_first(call.where("kind = 'STATIC'").select(F.col("program").alias("src"), F.col("target").alias("dst")), programs.select(F.col("program").alias("node")))
    return found.withColumnRenamed("node", "program")


def parameters(call: DataFrame, linkage: DataFrame) -> DataFrame:
    """``program``, ``target``, ``position``, ``argument``, ``parameter`` (null: UNMATCHED) by place; ``linkage`` has ``program``, ``position``, ``name``. Both are shuffled: Spark takes lists in
    cached rows for much longer than they are, so a whole portfolio's ``linkage`` would look small enough to be broadcast."""
    args = call.select("program", "target", F.posexplode("args").alias("position", "argument"))
    names = linkage.select(F.col("program").alias("target"), "position", F.col("name").alias("parameter"))
    return args.join(names.hint("merge"), ["target", "position"], "left").select("program", "target", "position", "argument", "parameter", F.when(F.col("parameter").isNull(), "UNMATCHED").otherwise("MATCHED").alias("status"))


# Embedded SQL and CICS ----------------------------------------------------------------------------------


def host_variables(blocks: DataFrame) -> DataFrame:
    """``program``, ``seq``, ``kind``, ``verb``, ``clause`` (INTO, WHERE, SET, VALUES, FROM) and ``var`` of EXEC blocks."""
    body = F.upper(F.regexp_replace(F.col("body"), r"\s+", " "))
    part = lambda p: F.regexp_extract(body, p, 1)
    hosts = lambda t: F.regexp_extract_all(t, F.lit(r":([A-Z][A-Z0-9-]*)"), F.lit(1))
    clause = lambda name, v: F.transform(v, lambda x: F.struct(F.lit(name).alias("clause"), F.trim(x).alias("var")))
    verb = F.regexp_extract(body, r"^\s*(\w+)", 1)
    sql = F.concat(
        clause("INTO", hosts(part(r"\bINTO\s+(.+?)(?:\bFROM\b|$)"))), clause("WHERE", hosts(part(r"\bWHERE\s+(.+)$"))),
        clause("SET", hosts(F.when(verb == "UPDATE", part(r"\bSET\s+(.+?)(?:\bWHERE\b|$)")).otherwise(""))), clause("VALUES", hosts(F.when(verb == "INSERT", part(r"\bVALUES\s*\((.+?)\)")).otherwise(""))),
    )
    inside = lambda w: F.regexp_extract_all(body, F.lit(rf"\b{w}\(([^)]+)\)"), F.lit(1))
    cics = F.concat(clause("INTO", inside("INTO")), clause("INTO", inside("SET")), clause("FROM", inside("FROM")))
    return blocks.select("program", "seq", "kind", verb.alias("verb"), F.posexplode(F.when(F.col("kind") == "EXEC SQL", sql).otherwise(cics)).alias("place", "x")).select("program", "seq", "kind", "verb", "place", "x.*")


CONTROL = r"(?i)^(SQLCODE|SQLSTATE|SQLCA|EIBR\w*|DFHRESP\w*|WS-SQLCODE|WS-SQLSTATE)$"


def taint(hosts: DataFrame, variables: DataFrame) -> DataFrame:
    """``program``, ``class`` (tainted, used, control), ``var``, ``source``: the first occurrence of each variable in each class."""
    order = F.struct("seq", "place")
    source = F.concat_ws(" ", "kind", "verb")
    pick = lambda df, name: df.groupBy("program", "var").agg(F.min_by(source, order).alias("source")).select("program", F.lit(name).alias("class"), "var", "source")
    declared = variables.where(F.col("name").rlike(CONTROL)).select("program", F.lit("control").alias("class"), F.col("name").alias("var"), F.lit("DECLARED").alias("source")).distinct()
    moved = pick(hosts.where(F.col("clause").isin("INTO", "FROM") & F.col("var").rlike(CONTROL)), "control")
    values = hosts.where("clause = 'VALUES'").join(hosts.where("clause = 'INTO'").select("program", "var"), ["program", "var"], "left_anti")
    used = hosts.where(F.col("clause").isin("WHERE", "SET", "FROM")).unionByName(values)
    return pick(hosts.where("clause = 'INTO'"), "tainted").union(pick(used, "used")).union(declared).union(moved.join(declared, ["program", "var"], "left_anti").select(*declared.columns))


#: What a condition on a return code has, what it means and the branch it guards; the first holds.
RETURN_CODES = (
    (("NOT", "= 0"), "query failed", "error"), (("= 100",), "no matching rows", "not_found"), (("< 0",), "database exception", "severe"), (("= 0",), "query succeeded", "success"),
    (("> 0",), "warning or not found", "warning"), ((), "return code check", "unknown"),
)


def sqlcode_branch(condition: Column) -> Column:
    """Struct ``meaning``, ``branch`` of a condition on a return code; null of others."""
    u, found = F.upper(condition), None
    for texts, meaning, branch in reversed(RETURN_CODES):
        told = F.struct(F.lit(meaning).alias("meaning"), F.lit(branch).alias("branch"))
        test = F.lit(True)
        for text in texts:
            test = test & u.contains(text)
        found = told if found is None else F.when(test, told).otherwise(found)
    return F.when(u.contains("SQLCODE") | u.contains("SQLSTATE"), found)


# Summaries ----------------------------------------------------------------------------------------------


def statement_counts(statements: DataFrame) -> DataFrame:
    return statements.groupBy("program").pivot("kind", list(CATEGORIES)).count().na.fill(0)


def arithmetic_risk(computes: DataFrame, variables: DataFrame) -> DataFrame:
    """``computes(program, seq, target, op, left, right)``: two operands (names or numbers; op ``=`` has one, ``?`` is complex).
    With ``result_int``, ``result_dec``, ``status`` and ``reason``: a product's digits add, a sum needs one more, a quotient cannot be told."""
    pics = lambda c, k: variables.select(F.col("program").alias(f"pr{k}"), F.col("name").alias(f"n{k}"), F.col("int_digits").alias(f"i{k}"), F.col("dec_digits").alias(f"d{k}"))
    out = computes
    for k, c in ((0, "target"), (1, "left"), (2, "right")):
        side = pics(c, k).hint("merge")  # as in ``parameters``: variables look smaller than they are
        out = out.join(side, (F.col("program") == F.col(f"pr{k}")) & (F.col(c) == F.col(f"n{k}")), "left")
    for k, c in ((1, "left"), (2, "right")):
        number = F.col(c).rlike(r"^-?\d+(\.\d+)?$")
        digits = lambda p: F.length(F.ltrim(F.translate(F.regexp_extract(F.col(c), p, 1), "0", " ")))  # noqa: B023, E731
        out = out.withColumn(f"i{k}", F.when(number, F.greatest(digits(r"^-?(\d+)"), F.lit(1))).otherwise(F.col(f"i{k}"))).withColumn(f"d{k}", F.when(number, F.length(F.regexp_extract(F.col(c), r"\.(\d+)$", 1))).otherwise(F.col(f"d{k}")))
    op = F.col("op")
    ints = F.when(op == "*", F.col("i1") + F.col("i2")).when(op.isin("+", "-"), F.greatest("i1", "i2") + 1).when(op == "=", F.col("i1"))
    decs = F.when(op == "*", F.col("d1") + F.col("d2")).when(op.isin("+", "-"), F.greatest("d1", "d2")).when(op == "=", F.col("d1"))
    out = out.withColumn("result_int", ints).withColumn("result_dec", decs)
    status = (
        F.when(F.col("i0").isNull() | (op == "?"), "WARN").when((op == "/") & F.col("i1").isNull(), "WARN").when((op == "/") & (F.col("i1") > F.col("i0")), "CRITICAL").when(op == "/", "WARN")
        .when(F.col("result_int").isNull(), "WARN").when(F.col("result_int") > F.col("i0"), "CRITICAL").when(F.col("result_dec") > F.col("d0"), "WARN").otherwise("SAFE")
    )
    reason = (
        F.when(F.col("i0").isNull(), "unknown target").when(op == "?", "complex expression").when((op == "/") & (F.col("i1") > F.col("i0")), "numerator exceeds target").when(op == "/", "quotient is inexact")
        .when(F.col("result_int").isNull(), "unknown operand").when(F.col("result_int") > F.col("i0"), "integer digits exceed target").when(F.col("result_dec") > F.col("d0"), "decimals are lost").otherwise("fits")
    )
    return out.select(*computes.columns, "result_int", "result_dec", status.alias("status"), reason.alias("reason"))


def risk_counts(risks: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return risks.groupBy("program").agg(F.count("*").alias("total"), n("SAFE"), n("WARN"), n("CRITICAL"))


def compiler_matrix(programs: DataFrame, variables: DataFrame, statements: DataFrame) -> DataFrame:
    """``programs(program, trunc, arith, numproc, decimal_point)`` (null: not in the source) with counts of what depends on each option, ``warnings`` and
    ``recommendation``."""
    v = variables.groupBy("program").agg(F.count_if(F.col("storage") == "COMP-3").alias("comp3"), F.count_if(F.col("storage") == "COMP").alias("comp"), F.count_if((F.col("storage") == "COMP-3") & F.col("signed")).alias("signed_comp3"))
    s = statements.groupBy("program").agg(F.count_if(F.col("kind") == "COMPUTE").alias("computes"), F.count_if(F.col("detail").rlike("^(MULTIPLY|DIVIDE)")).alias("mul_div"), F.count_if(F.col("detail").contains("SIZE ERROR")).alias("size_errors"))
    out = programs.join(v, "program", "left").join(s, "program", "left").na.fill(0, ["comp3", "comp", "signed_comp3", "computes", "mul_div", "size_errors"])
    needs = {"TRUNC": (F.col("comp3") + F.col("comp") + F.col("size_errors")) > 0, "ARITH": (F.col("computes") + F.col("mul_div")) > 0, "NUMPROC": F.col("signed_comp3") > 0}
    defaults = {"TRUNC": "STD", "ARITH": "COMPAT", "NUMPROC": "NOPFD"}
    missing = lambda o: needs[o] & F.col(o.lower()).isNull()
    warnings = F.array_compact(F.array(*(F.when(missing(o), f"{o} not specified: default {d}") for o, d in defaults.items())))
    options = [F.col(c) for c in ("trunc", "arith", "numproc", "decimal_point")]
    all_ = options[0].isNotNull() & options[1].isNotNull() & options[2].isNotNull() & options[3].isNotNull()
    none = F.coalesce(*options).isNull()
    wanted = F.array_join(F.array_compact(F.array(*(F.when(missing(o), f"{o}={d}") for o, d in defaults.items()))), ", ")
    text = F.when(all_, "All options found.").when(none, "No options found: defaults apply; confirm them.").when(wanted != "", F.concat(F.lit("Defaulting: "), wanted, F.lit(". Confirm."))).otherwise("Remaining defaults are safe.")
    return out.withColumn("warnings", warnings).withColumn("recommendation", text)


#: What makes a program yellow, and each count's points (most, by how much) of its complexity.
YELLOW = {"odo": 0, "large_occurs": 0, "copy_issues": 0, "gotos": 10, "lines": 500}
POINTS = {"lines": (20, "1/25"), "categories": (15, "1.5"), "copy_issues": (10, "2"), "exec": (20, "5"), "gotos": (10, "2"), "redefines": (10, "3"), "comp3": (10, "1"), "performs": (5, "1/4")}


def heatmap(summary: DataFrame) -> DataFrame:
    """``summary(program, lines, alters, exec_sql, exec_cics, odo, large_occurs, copy_issues, gotos, categories, redefines, comp3, performs)`` with ``status``,
    ``predicted``, ``complexity`` and ``risk_factors``. OCCURS DEPENDING and ALTER stand in the same list as EXEC blocks, but only EXEC ones score."""
    c = F.col
    red, yellow, score = (c("alters") + c("exec_sql") + c("exec_cics")) > 0, F.lit(False), F.lit(0).cast("decimal(10,4)")
    for name, most in YELLOW.items():
        yellow = yellow | (c(name) > most)
    for name, (most, each) in POINTS.items():
        n = c("exec_sql") + c("exec_cics") if name == "exec" else c(name)
        times, _, by = each.partition("/")
        points = n * F.lit(float(times)) / F.lit(float(by or 1))
        score = score + F.least(F.lit(most).cast("decimal(10,4)"), points.cast("decimal(10,4)"))
    factor = lambda test, *parts: F.when(test, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    n = lambda x: c(x).cast("string")
    factors = F.array_compact(F.array(
        factor(c("alters") > 0, "ALTER (", n("alters"), ")"), factor(c("exec_sql") > 0, "EXEC SQL (", n("exec_sql"), " blocks)"), factor(c("exec_cics") > 0, "EXEC CICS (", n("exec_cics"), " blocks)"), factor(c("odo") > 0, "OCCURS DEPENDING ON (", n("odo"), ")"),
        factor(c("large_occurs") > 0, "Large OCCURS tables (", n("large_occurs"), " fields)"), factor(c("copy_issues") > 0, "Unresolved copybooks (", n("copy_issues"), ")"), factor(c("gotos") > 10, "GO TO count (", n("gotos"), ")"), factor(c("lines") > 500, "Large program (", n("lines"), " lines)"),
    ))
    return summary.select("*", F.when(red, "red").when(yellow, "yellow").otherwise("green").alias("status"), F.when(red, "MANUAL_REVIEW").otherwise("VERIFIED").alias("predicted"), F.bround(score, 0).cast("int").alias("complexity"), F.array_join(factors, "; ").alias("risk_factors"))


def heatmap_summary(heat: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = heat.agg(F.count("*").alias("total"), n("green"), n("yellow"), n("red"))
    share = F.col("green") * 100.0 / F.nullif(F.col("total"), F.lit(0))
    text = lambda a, b: F.concat(F.floor(share - a).cast("string"), F.lit("-"), F.floor(share - b).cast("string"), F.lit("%"))
    return out.withColumn("predicted", F.when(share.isNull(), "N/A").when(share >= 90, text(5, 0)).when(share >= 70, text(10, 5)).otherwise(text(15, 10)))


#: Base points below so many lines, and the points of a branch and of a nesting level up to a limit.
LINES = ((1, 1), (50, 2), (200, 4), (500, 6))
LONG, BRANCH, NESTED = 8, ("0.05", 20), ("0.10", 10)


def simple_complexity(lines: Column, branches: Column, nesting: Column) -> Column:
    """From 1 to 10."""
    base = F.lit(LONG)
    for below, points in reversed(LINES):
        base = F.when(lines < below, points).otherwise(base)
    score = base.cast("decimal(6,2)")
    for n, (each, most) in ((branches, BRANCH), (nesting, NESTED)):
        score = score + F.least(n, F.lit(most)).cast("decimal(6,2)") * F.lit(each).cast("decimal(3,2)")
    return F.greatest(F.lit(1).cast("decimal(4,2)"), F.least(F.lit(10).cast("decimal(4,2)"), score.cast("decimal(6,2)"))).cast("decimal(4,2)")


def confidence(total: Column, failed: Column) -> Column:
    """Whole percent of what converted; 100 of nothing."""
    return F.when(total == 0, 100).otherwise(F.floor((total - failed) * 100 / total)).cast("int")


def viability(results: DataFrame) -> DataFrame:
    """``results(program, clean, failure)``: tested, clean, rate in percent with one decimal."""
    return results.agg(F.count("*").alias("tested"), F.count_if("clean").alias("clean"), F.round(F.count_if("clean") * 100.0 / F.nullif(F.count("*"), F.lit(0)), 1).alias("rate"))


def failure_categories(results: DataFrame) -> DataFrame:
    return results.where(~F.col("clean")).groupBy("failure").count()


def batch_verdict(programs: DataFrame) -> DataFrame:
    """``programs(program, verified, flags)``: sums and a combined verdict."""
    out = programs.agg(F.count("*").alias("programs"), F.count_if("verified").alias("verified"), F.coalesce(F.sum("flags"), F.lit(0)).alias("flags"), F.coalesce(F.bool_and("verified"), F.lit(True)).alias("all"))
    return out.select("programs", "verified", "flags", F.when(F.col("all"), "VERIFIED").otherwise("REQUIRES_MANUAL_REVIEW").alias("verdict"))


def trace_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """Traces (``trace``, ``idx``, ``line``, ``verb``, ``variable``, ``new_value``): for each trace the first index at which the new values differ (or one side
    ends), the number of matching events before it, and a diagnosis; none of traces that agree."""
    side = lambda df, p: df.select("trace", "idx", *(F.col(c).alias(f"{p}_{c}") for c in ("line", "verb", "variable", "new_value")), F.lit(True).alias(f"{p}_here"))
    both = side(a, "a").join(side(b, "b"), ["trace", "idx"], "full_outer")
    odd = both.where(F.col("a_here").isNull() | F.col("b_here").isNull() | (F.col("a_new_value") != F.col("b_new_value")))
    first = odd.groupBy("trace").agg(F.min_by(F.struct("idx", "a_here", "b_here", "a_verb", "a_variable", "a_new_value", "b_new_value"), "idx").alias("d")).select("trace", "d.*")
    first = first.withColumn("x", exact.canonical(F.col("a_new_value"))).withColumn("y", exact.canonical(F.col("b_new_value")))
    first = first.withColumn("m", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), exact.difference(F.col("x"), F.col("y"))))
    x, y, m = F.col("x"), F.col("y"), F.col("m")
    small = (m != "0") & exact.below(m, "0.01")
    why = (
        F.when(F.col("a_here").isNull() | F.col("b_here").isNull(), "Trace length mismatch").when((x != "0") & (x == exact.negated(y)), "Sign reversal")
        .when(small & (F.col("a_verb") == "DIVIDE"), "Rounding divergence: TRUNC mode").when(small, "Rounding divergence: ROUNDED")
        .when(exact.above(m, 100), "Picture overflow").when(~m.contains("."), "Decimal truncation").when((F.col("a_verb") == "MOVE") & (F.length("a_new_value") != F.length("b_new_value")), "Picture length mismatch").otherwise("Value divergence")
    )
    return first.select("trace", F.col("idx").alias("divergence_index"), F.col("idx").alias("matching_events"), F.col("a_variable").alias("variable"), why.alias("diagnosis"))


#: Components of one document.
SHEET = 50_000


def sbom(programs: DataFrame, call: DataFrame, copies: DataFrame, tables: DataFrame) -> DataFrame:
    """A CycloneDX 1.4 document of a portfolio, one JSON text: programs, copybooks, called programs and DB2 tables as components; the
    serial is a UUID of the components' digest. Beyond ``SHEET`` components it goes on, by type and name, in further documents of as many, each with its place (``2/11``) as
    the property ``part`` of its metadata, so that no task has them all."""
    part = lambda df, name, kind, why: df.select(F.lit(kind).alias("type"), F.col(name).alias("name"), F.lit(why).alias("description")).distinct()
    every = part(programs, "program", "application", "program").union(part(copies, "copybook", "library", "copybook")).union(part(call.where("kind = 'STATIC'"), "target", "library", "called program")).union(part(tables, "table", "data", "DB2 table"))
    every = cut(every.distinct(), "components")
    sheets, place = -(-every.count() // SHEET), []
    listed = F.array_sort(F.collect_list(F.struct("type", "name", "description"))).alias("components")
    if sheets > 1:
        numbered = prefix_sums(every.withColumn("one", F.lit(1).cast("bigint")), ["type", "name", "description"], "one", "before")
        listed = numbered.groupBy(F.floor(F.col("before") / SHEET).alias("sheet")).agg(listed)
        at = F.concat((F.col("sheet") + 1).cast("string"), F.lit(f"/{sheets}"))
        place = [F.struct(F.array(F.struct(F.lit("part").alias("name"), at.alias("value"))).alias("properties")).alias("metadata")]
    else:
        listed = every.agg(listed)
    d = F.md5(F.to_json("components"))
    serial = F.concat(F.lit("urn:uuid:"), F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.concat(F.lit("5"), F.substring(d, 14, 3)), F.concat(F.lit("8"), F.substring(d, 18, 3)), F.substring(d, 21, 12)))
    return listed.select(F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.4").alias("specVersion"), serial.alias("serialNumber"), F.lit(1).alias("version"), *place, F.col("components"))).alias("sbom"))


def sbom_problems(bom: DataFrame) -> DataFrame:
    """Why a document isn't valid; no rows if it is."""
    p = F.from_json("sbom", "bomFormat string, specVersion string, serialNumber string, version int, components array<struct<type:string,name:string>>")
    bad = F.array_compact(F.array(
        F.when(~p["bomFormat"].eqNullSafe(F.lit("CycloneDX")), "bomFormat"), F.when(~p["specVersion"].eqNullSafe(F.lit("1.4")), "specVersion"), F.when(p["components"].isNull(), "components"),
        F.when(~F.coalesce(p["serialNumber"].rlike("^urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False)), "serialNumber"), F.when(F.exists(F.coalesce(p["components"], F.array()), lambda x: x["name"].isNull() | x["type"].isNull()), "component without name or type"),
    ))
    return bom.select(F.explode(bad).alias("problem"))


def db2_tables(blocks: DataFrame) -> DataFrame:
    """Tables after FROM, JOIN, INTO (of INSERT) and UPDATE in EXEC SQL."""
    body = F.upper(F.regexp_replace("body", r"\s+", " "))
    found = F.regexp_extract_all(body, F.lit(r"\b(?:FROM|JOIN|INSERT INTO|UPDATE) ([A-Z][A-Z0-9_.]*)"), F.lit(1))
    return blocks.where("kind = 'EXEC SQL'").select(F.explode(found).alias("table")).distinct()
