"""Boundary records: one for each edge value of each field, all other fields at their defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.sources.layout import Layout


def field_table(spark: SparkSession, layout: Layout) -> DataFrame:
    rows = [(i, f.name, f.start, f.length, "text" if f.type == "string" or f.edited else "number", f.decimals, f.signed or f.signed_display) for i, f in enumerate(layout.fields)]
    return spark.createDataFrame(rows, "position int, name string, start int, length int, kind string, decimals int, signed boolean")


def joined_pictures(fields: DataFrame, variables: DataFrame) -> DataFrame:
    """Layout fields with the picture of the variable of their name, or of it behind WS- or LS-."""
    out = fields
    for k, prefix in enumerate(("", "WS-", "LS-")):
        side = variables.select(F.col("name").alias(f"n{k}"), F.col("picture").alias(f"p{k}"))
        out = out.join(side, F.concat(F.lit(prefix), fields["name"]) == side[f"n{k}"], "left")
    return out.select(*fields.columns, F.coalesce("p0", "p1", "p2").alias("picture"))


def edges(fields: DataFrame) -> DataFrame:
    """``position``, ``name``, ``pill``, ``value``: number fields get max, zero, -max if signed, overflow and half_cent if
    they have decimals; text fields all_spaces and high_value."""
    nines = lambda n: F.repeat(F.lit("9"), n)
    digits = F.col("length") - F.col("signed").cast("int") - (F.col("decimals") > 0).cast("int")
    ints = F.greatest(digits - F.col("decimals"), F.lit(1))
    point = F.when(F.col("decimals") > 0, F.concat(F.lit("."), nines(F.col("decimals")))).otherwise("")
    largest = F.concat(nines(ints), point)
    pill = lambda name, value: F.struct(F.lit(name).alias("pill"), value.alias("value"))
    numbers = F.array_compact(F.array(
        pill("max", largest), pill("zero", F.lit("0")), F.when(F.col("signed"), pill("negative_max", F.concat(F.lit("-"), largest))), pill("overflow", F.concat(F.lit("1"), F.repeat(F.lit("0"), ints))),
        F.when(F.col("decimals") > 0, pill("half_cent", F.concat(F.lit("0."), F.repeat(F.lit("0"), F.col("decimals")), F.lit("5")))),
    ))
    texts = F.array(pill("all_spaces", F.repeat(F.lit(" "), F.col("length"))), pill("high_value", F.repeat(F.lit("ÿ"), F.col("length"))))
    return fields.select("position", "name", F.explode(F.when(F.col("kind") == "number", numbers).otherwise(texts)).alias("e")).select("position", "name", "e.*")


def records(fields: DataFrame) -> DataFrame:
    """``field``, ``pill`` and ``record``: the pill in its field, 0 or spaces in all others, cut or padded to each length."""
    placed = F.array_sort(F.collect_list(F.struct("position", "kind", "length")))
    shape = fields.agg(placed.alias("fields"))
    each = edges(fields).crossJoin(F.broadcast(shape))  # one row: a layout's fields
    part = lambda f: F.when(f["position"] == F.col("position"), F.col("value")).when(f["kind"] == "number", F.lit("0")).otherwise(F.lit(""))
    fitted = lambda f: F.when(f["kind"] == "number", F.right(F.lpad(part(f), F.greatest(f["length"], F.length(part(f))), F.lit("0")), f["length"])).otherwise(F.rpad(part(f), f["length"], F.lit(" ")))
    return each.select(F.col("name").alias("field"), "pill", F.array_join(F.transform("fields", fitted), "").alias("record"))


def run_summary(results: DataFrame) -> DataFrame:
    """Counts of clean, abended and failed pill runs (``status`` is clean, abend or error)."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.agg(F.count("*").alias("total"), n("clean"), n("abend"), n("error"))


def demo_shipments(spark: SparkSession, n: int = 100) -> DataFrame:
    """Shipment records for demonstrations, from the row number alone."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("_rec"), F.format_string("S%07d", i).alias("SHIP-NO"), (i * 7919 % 9_999_991 * F.lit(1).cast("decimal(1,0)") / 100).cast("decimal(10,2)").alias("CARGO-VALUE"), (i * 389 % 20_000).cast("decimal(5,0)").alias("WEIGHT-KG"),
        (i * 13 % 20).cast("decimal(2,0)").alias("ZONE-NO"), F.element_at(F.array(*map(F.lit, ("ST", "EX", "UR", "ST", "ST"))), (i % 5 + 1).cast("int")).alias("SERVICE"),
    )
