"""SORT and MERGE with mainframe collation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import ebcdic

Key = tuple[str, bool]  # column, ascending


def keys(df: DataFrame, by: Sequence[Key], codepage: str = "cp037") -> list[Column]:
    """Numbers order as numbers, all else by the code page's bytes; the record number keeps ties in order."""
    numeric = {f.name for f in df.schema if f.dataType.simpleString().startswith(("decimal", "int", "bigint", "double", "float", "smallint", "tinyint"))}
    out = []
    for name, ascending in by:
        c = F.col(name) if name in numeric else ebcdic.sort_key(F.col(name).cast("string"), codepage)
        out.append(c.asc() if ascending else c.desc())
    return [*out, F.col("_rec").asc()]


def sort(files: DataFrame | Sequence[DataFrame], by: Sequence[Key], codepage: str = "cp037", input_procedure: Callable[[DataFrame], DataFrame] | None = None, output_procedure: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """SORT ... USING all files (in order) or an INPUT PROCEDURE, GIVING the sorted rows or an OUTPUT PROCEDURE over them. The global
    order is a range-partitioned sort."""
    if not isinstance(files, DataFrame):
        files = merged(files)
    rows = input_procedure(files) if input_procedure else files
    out = rows.orderBy(*keys(rows, by, codepage))
    return output_procedure(out) if output_procedure else out


def merged(files: Sequence[DataFrame]) -> DataFrame:
    """Files one behind the other: record numbers stay in order by file and record."""
    out = None
    for k, f in enumerate(files):
        own = f.withColumn("_rec", F.lit(k).cast("long") * F.lit(1 << 40) + F.col("_rec"))
        out = own if out is None else out.unionByName(own)
    return out


def merge(files: Sequence[DataFrame], by: Sequence[Key], codepage: str = "cp037") -> DataFrame:
    return sort(list(files), by, codepage)


def ranked(df: DataFrame, by: Sequence[Key], partition: Sequence[str], codepage: str = "cp037", name: str = "rank") -> DataFrame:
    """The position of each row in its partition's order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*keys(df, by, codepage))))


def sort_table(tables: Sequence[Column], ascending: bool = True) -> Column:
    """SORT of an OCCURS table: arrays of one length ordered by the first; an array of structs of ``t0``, ``t1``, ... and the old index ``i``."""
    zipped = F.arrays_zip(*(t.alias(f"t{k}") for k, t in enumerate(tables)), F.sequence(F.lit(1), F.size(tables[0])).alias("i"))
    if not ascending:  # the old place still decides ties in order
        return F.array_sort(zipped, lambda x, y: F.when(x["t0"] > y["t0"], -1).when(x["t0"] < y["t0"], 1).when(x["i"] < y["i"], -1).otherwise(1))
    return F.array_sort(zipped, lambda x, y: F.when(x["t0"] < y["t0"], -1).when(x["t0"] > y["t0"], 1).when(x["i"] < y["i"], -1).otherwise(1))


def search(table: Column, test: Callable[[Column], Column]) -> Column:
    """SEARCH: the 1-based index of the first element that passes, 0 AT END."""
    return F.array_position(F.transform(table, lambda x: F.coalesce(test(x), F.lit(False))), True).cast("int")


def search_all(table: Column, value: Column) -> Column:
    """SEARCH ALL: the first element that is equal (the order isn't checked)."""
    return F.array_position(table, value).cast("int")


def search_rows(requests: DataFrame, table: DataFrame, on: Column, request_key: str, index: str = "idx") -> DataFrame:
    """SEARCH of a large table: the smallest index among the matching rows, 0 AT END."""
    found = requests.join(table, on, "left").groupBy(request_key).agg(F.coalesce(F.min(index), F.lit(0)).alias("found"))
    return requests.join(found, request_key)


def corresponding(source: DataFrame, group: str, target: str) -> list[str]:
    """Field names that two struct columns share."""
    fields = lambda c: [f.name for f in source.schema[c].dataType.fields]
    return [n for n in fields(group) if n in fields(target)]


def move_corresponding(df: DataFrame, group: str, target: str) -> DataFrame:
    shared = set(corresponding(df, group, target))
    names = [f.name for f in df.schema[target].dataType.fields]
    return df.withColumn(target, F.struct(*((F.col(f"{group}.{n}") if n in shared else F.col(f"{target}.{n}")).alias(n) for n in names)))


def add_corresponding(df: DataFrame, group: str, target: str, sign: int = 1) -> DataFrame:
    """ADD (SUBTRACT with sign -1) CORRESPONDING."""
    shared = set(corresponding(df, group, target))
    names = [f.name for f in df.schema[target].dataType.fields]
    new = lambda n: F.col(f"{target}.{n}") + sign * F.col(f"{group}.{n}") if n in shared else F.col(f"{target}.{n}")
    return df.withColumn(target, F.struct(*(new(n).alias(n) for n in names)))
