"""Positional verification: produced against expected records, field by field, with diagnosis.

Numbers are compared as texts of one canonical form, so any number of digits and decimals counts. ``outcomes`` joins the two sides once, a
row for each record; differences, totals and the event feed all come from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import exact
from tallyframe.functions.codecs import edited_number

#: Details that a report holds, and abends.
DETAILS, ABENDS = 10_000, 100
#: What stands for a numeric difference until it is computed.
NUMBERS = "NUMBERS"


def sided(df: DataFrame, fields: Sequence[str]) -> Column:
    """One side's record as a struct: ``values`` (texts ``v0``, ``v1``, ... of the fields), ``abends`` and ``error``."""
    abends = F.col("_abends") if "_abends" in df.columns else F.array().cast("array<struct<field:string,message:string,invalid_value:string>>")
    error = F.col("_error") if "_error" in df.columns else F.lit(None).cast("string")
    values = F.struct(*(F.col(f).cast("string").alias(f"v{k}") for k, f in enumerate(fields)))
    return F.struct(values.alias("values"), F.transform(abends, lambda a: F.struct(a["field"].alias("field"), a["invalid_value"].alias("value"))).alias("abends"), error.alias("error"))


def outcomes(produced: DataFrame, expected: DataFrame, fields: Sequence[str], edited: Sequence[str] = (), keys: Sequence[str] = ("_rec",)) -> DataFrame:
    """One row for each record: ``record``, ``p_here``, ``e_here`` and ``found``, its differences (and other ``keys`` than ``_rec`` first).

    Both sides have a dense ``_rec`` (or one within the other keys); they are joined by it (a full outer equi-join), so a missing record is
    one difference of field ``_record``. ``_abends`` and ``_error`` of the produced side, and ``_abends`` of the
    expected one, replace the record's fields. Per field: both null agree, one null is
    MISSING_VALUE, edited fields compare as numbers (0 without digits), numbers as numbers, all else as trimmed texts."""
    left, right = produced.select(*keys, sided(produced, fields).alias("p")), expected.select(*keys, sided(expected, fields).alias("e"))
    return judged(left.join(right, list(keys), "full_outer"), fields, edited, keys)


def judged(both: DataFrame, fields: Sequence[str], edited: Sequence[str] = (), keys: Sequence[str] = ("_rec",)) -> DataFrame:
    """``outcomes`` of paired records: ``keys``, ``p`` and ``e`` (as ``sided`` makes them; null: that side is missing); no shuffle."""
    parts = [F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in "pe" for c in ("values", "abends", "error")]
    here = [F.when(F.col(n).isNotNull(), F.lit(True)).alias(f"{n}_here") for n in "pe"]
    both = both.select(*keys, *parts, *here)
    none = F.lit(None).cast("string")
    row = lambda field, p, e, d, a=none, b=none: F.struct(field.alias("field"), p.alias("produced_value"), e.alias("expected_value"), d.alias("difference"), a.alias("a"), b.alias("b"))

    def one(k: int, name: str) -> Column:
        p, e = F.col(f"p_values.v{k}"), F.col(f"e_values.v{k}")
        number = (lambda t: F.coalesce(exact.canonical(edited_number(t)), F.lit("0"))) if name in edited else exact.canonical
        missing = row(F.lit(name), F.coalesce(p, F.lit("None")), F.coalesce(e, F.lit("None")), F.lit("MISSING_VALUE"))

        def told(x: Column) -> Column:
            a, b = x["a"], x["b"]
            numbers = a.isNotNull() & b.isNotNull()
            return F.when(numbers & (a != b), row(F.lit(name), p, e, F.lit(NUMBERS), a, b)).when(~numbers & (F.trim(p) != F.trim(e)), row(F.lit(name), p, e, F.lit("STRING_MISMATCH")))

        unequal = F.get(F.transform(F.array(F.struct(number(p).alias("a"), number(e).alias("b"))), told), F.lit(0))
        return F.when(p.isNull() != e.isNull(), missing).when(p != e, unequal)

    per_field = F.array_compact(F.array(*(one(k, f) for k, f in enumerate(fields))))
    abends = F.concat(
        F.transform("p_abends", lambda a: row(a["field"], a["value"], F.lit("N/A"), F.lit("S0C7_ABEND"))), F.transform("e_abends", lambda a: row(a["field"], F.lit("N/A"), a["value"], F.lit("S0C7_ABEND")))
    )
    found = (
        F.when(F.col("e_here").isNull(), F.array(row(F.lit("_record"), F.lit("present"), F.lit("missing"), F.lit("Record missing from expected"))))
        .when(F.col("p_here").isNull(), F.array(row(F.lit("_record"), F.lit("missing"), F.lit("present"), F.lit("Record missing from produced"))))
        .when(F.size(abends) > 0, abends)
        .when(F.col("p_error").isNotNull(), F.array(row(F.lit("_execution_error"), F.col("p_error"), F.lit("N/A"), F.lit("EXECUTION_ERROR"))))
        .otherwise(per_field)
    )
    return both.select(*(k for k in keys if k != "_rec"), F.col("_rec").alias("record"), F.coalesce("p_here", F.lit(False)).alias("p_here"), F.coalesce("e_here", F.lit(False)).alias("e_here"), found.alias("found"))


def differences(outcome: DataFrame) -> DataFrame:
    """One row for each difference: ``record``, ``field``, ``produced_value``, ``expected_value``, ``difference``."""
    each = outcome.select("record", F.explode("found").alias("d")).select("record", "d.*")
    size = F.when(F.col("difference") == NUMBERS, exact.difference(F.col("a"), F.col("b"))).otherwise(F.col("difference"))
    return each.select("record", "field", "produced_value", "expected_value", size.alias("difference"))


def compare(produced: DataFrame, expected: DataFrame, fields: Sequence[str], edited: Sequence[str] = ()) -> DataFrame:
    """The differences of two sides."""
    return differences(outcomes(produced, expected, fields, edited))


def totals(outcome: DataFrame) -> DataFrame:
    """One row: ``total_records``, ``matches``, ``mismatches`` (records), ``s0c7_abends``, ``record_count_mismatch``, ``details_capped`` and ``verdict``."""
    found = outcome.select("p_here", "e_here", F.size("found").alias("n"), F.size(F.filter("found", lambda d: d["difference"] == "S0C7_ABEND")).alias("a"))
    sums = found.agg(
        F.count_if("p_here").alias("p"), F.count_if("e_here").alias("e"), F.count_if(F.col("n") > 0).alias("mismatches"), F.coalesce(F.sum("n"), F.lit(0)).alias("details"), F.coalesce(F.sum("a"), F.lit(0)).alias("s0c7_abends"),
    )
    total = F.greatest("p", "e")
    return sums.select(
        total.alias("total_records"), (total - F.col("mismatches")).alias("matches"), "mismatches", "s0c7_abends", (F.col("p") != F.col("e")).alias("record_count_mismatch"), (F.col("details") > DETAILS).alias("details_capped"), verdict(F.col("mismatches")).alias("verdict")
    )


def verdict(mismatches: Column) -> Column:
    return F.when(mismatches == 0, "ZERO DRIFT CONFIRMED").otherwise(F.concat(F.lit("DRIFT DETECTED: "), mismatches.cast("string"), F.lit(" RECORDS")))


def details(found: DataFrame, n: int = DETAILS) -> DataFrame:
    """The first ``n`` differences in record order: the report's log."""
    return found.orderBy("record", "field").limit(n)


#: Diagnoses and what to do about them.
FIXES = {
    "S0C7 data exception: non-numeric data in a numeric field": "Inspect the source data and the file's encoding.",
    "Execution error during record processing": "Check the program on this record's input values.",
    "Field present on one side only": "Check that the output layout maps every expected field.",
    "Text against nothing: non-numeric data in a numeric field": "Inspect the encoding; packed or EBCDIC data may be damaged.",
    "Collation or encoding difference": "Check the code page and EBCDIC comparisons.",
    "Packed sign flipped": "Check packed decimal sign handling.",
    "Packed rounding divergence": "Check TRUNC and ROUNDED.",
    "Packed value divergence": "Check the packed layout and REDEFINES overlays.",
    "Equal numbers shown differently": "Check the display picture.",
    "Sign reversal": "Check sign nibbles (C positive, D negative).",
    "Rounding divergence below a cent": "Check TRUNC and ROUNDED.",
    "Picture overflow": "Check the target's digits.",
    "Truncation at a power of ten": "Check integer digits and TRUNC.",
    "Whole-number divergence": "Check the COMPUTE and its intermediate results.",
    "Numeric value divergence": "Compare the precision of the computation.",
    "Unknown divergence": "Inspect the field's logic.",
}


def diagnose(found: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """With ``magnitude`` (a text), ``likely_cause`` and ``suggested_fix``; ``types`` are layout types by field. The order of the tests matters."""
    causes = list(FIXES)
    given = found.withColumn("__a", exact.canonical(F.col("produced_value"))).withColumn("__b", exact.canonical(F.col("expected_value")))
    a, b, m = F.col("__a"), F.col("__b"), F.col("__m")
    given = given.withColumn("__m", F.when(a.isNotNull() & b.isNotNull(), exact.difference(a, b)))
    kinds = dict(types or {})
    packed = F.col("field").isin([f for f, t in kinds.items() if t == "comp3"]) if any(t == "comp3" for t in kinds.values()) else F.lit(False)
    d = F.col("difference")
    zero = (a == "0") | (b == "0")
    cause = (
        F.when(d == "S0C7_ABEND", causes[0]).when(d == "EXECUTION_ERROR", causes[1]).when(d == "MISSING_VALUE", causes[2])
        .when((d == "STRING_MISMATCH") & F.col("expected_value").isin("None", ""), causes[3]).when(d == "STRING_MISMATCH", causes[4])
        .when(packed & (zero | (a.startswith("-") != b.startswith("-"))), causes[5]).when(packed & exact.below(m, "0.01"), causes[6]).when(packed & m.isNotNull(), causes[7])
        .when(m == "0", causes[8]).when(~zero & (a == exact.negated(b)), causes[9]).when(exact.below(m, "0.015"), causes[10]).when(exact.above(m, 100), causes[11])
        .when(m.rlike("^10{1,15}$"), causes[12]).when(~m.contains("."), causes[13]).when(m.isNotNull(), causes[14]).otherwise(causes[15])
    )
    fix = F.create_map(*(F.lit(x) for item in FIXES.items() for x in item))
    out = given.withColumn("magnitude", m).withColumn("likely_cause", cause).drop("__a", "__b", "__m")
    return out.withColumn("suggested_fix", F.element_at(fix, F.col("likely_cause")))


def event_of() -> Column:
    """The event of an outcome: ``match``, ``drift``, ``error`` or ``length_mismatch``."""
    has = lambda test: F.exists("found", test)
    return F.when(~(F.col("p_here") & F.col("e_here")), "length_mismatch").when(has(lambda d: d["difference"].isin("S0C7_ABEND", "EXECUTION_ERROR")), "error").when(F.size("found") > 0, "drift").otherwise("match")


def message_of() -> Column:
    """The fields that differ."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda d: d["field"]))), ",")


def events(outcome: DataFrame) -> DataFrame:
    """The feed of a run: a row for each record (``event_of``) and one ``complete``."""
    feed = outcome.select("record", event_of().alias("event"), message_of().alias("message"))
    return feed.union(feed.agg(F.lit(None).cast("bigint"), F.lit("complete"), F.concat(F.count("*").cast("string"), F.lit(" records, "), F.count_if(F.col("event") != "match").cast("string"), F.lit(" different"))))


def report(total: DataFrame, log: DataFrame, layout: str = "", input_hash: str = "", output_hash: str = "") -> str:
    """The human-readable report of one run (its log is capped)."""
    t = total.first()
    lines = ["VERIFICATION REPORT", f"Layout       : {layout}", f"Total records: {t.total_records}", f"Matches      : {t.matches}", f"Mismatches   : {t.mismatches}", f"S0C7 abends  : {t.s0c7_abends}", f"Input hash   : {input_hash}", f"Output hash  : {output_hash}", f"VERDICT: {t.verdict}"]
    for r in details(log).toLocalIterator():
        lines.append(f"  Record {r.record:>6d} | {r.field:<20s} | produced {r.produced_value} | expected {r.expected_value} | {r.difference}")
    return "\n".join(lines)
