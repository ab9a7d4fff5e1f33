"""COPY members put into programs as joins over a library that is a table.

A *call* is a member's name, its library and its REPLACING clause. What it puts in depends on nothing else, so each distinct call is read from the library, replaced
and cut at the COPY statements inside it once, however many programs make it; those statements are the calls of the next round. Programs then grow round by
round: a call's place takes the pieces of its text, and each piece knows its place (a list of numbers, in text order) and the members it lies in, which is what
cycles and depths are judged by. Rounds are as many as members lie in each other, ``depth`` at most, and each reads the written tables of the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.graphs import Pile
from tallyframe.plans.lang import COPY, cleaned, member_name, replaced
from tallyframe.plans.scratch import cut

#: Deepest members in members.
DEPTH = 10
#: A call that more places than this make is looked up by several tasks.
LOAD = 20_000
#: Calls whose places are split, at most: the split's threshold grows with all places.
HOT = 1_000

_CALL = ["member", "library", "clause"]
_PIECES = pa.list_(pa.struct([("text", pa.string()), ("member", pa.string()), ("library", pa.string()), ("clause", pa.string())]))


def _cut_up(text: str) -> list[dict]:
    """A text's pieces in order: what stands between its COPY statements, and these (``member`` not null)."""
    out, at = [], 0
    for m in COPY.finditer(text):
        out.append({"text": text[at : m.start()], "member": None, "library": None, "clause": None})
        out.append({"text": "", "member": member_name(m[1]), "library": (m[2] or "").upper(), "clause": m[3] or ""})
        at = m.end()
    out.append({"text": text[at:], "member": None, "library": None, "clause": None})
    return out


def _pieces(df: DataFrame, keep: list[str], text: str, clause: str | None = None) -> DataFrame:
    """``keep`` and ``pieces``: the cleaned text after its replacements, cut at COPY statements; null where the text is."""
    arrow = pa.schema([*((c, pa.string()) for c in keep), ("pieces", _PIECES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clauses = b.column(len(keep) + 1).to_pylist()
            found = [None if x is None else _cut_up(replaced(cleaned(x), c)) for x, c in zip(b.column(len(keep)).to_pylist(), clauses, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i).cast(pa.string()) for i in range(len(keep))), pa.array(found, _PIECES)], schema=arrow)

    schema = ", ".join(f"`{c}` string" for c in keep) + ", pieces array<struct<text:string,member:string,library:string,clause:string>>"
    given = df.select(*keep, F.col(text).cast("string").alias("t"), (F.col(clause) if clause else F.lit("")).alias("c"))
    return given.mapInArrow(run, schema)


def shelf(library: DataFrame, member_col: str = "member", text_col: str = "text", library_col: str | None = None) -> DataFrame:
    """``member``, ``library`` ('' for the main one) and ``text``, one row a member: names in capitals without ``.CPY``; of several texts the smallest."""
    name = F.regexp_replace(F.upper(F.trim(member_col)), r"\.CPY$", "")
    own = F.upper(F.trim(F.coalesce(F.col(library_col).cast("string"), F.lit("")))) if library_col else F.lit("")
    rows = library.select(name.alias("member"), own.alias("library"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.where("member IS NOT NULL").groupBy("member", "library").agg(F.min("text").alias("text"))


def _calls(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.explode("pieces").alias("p")).where("p.member IS NOT NULL").select(*(F.col(f"p.{c}").alias(c) for c in _CALL)).distinct()


def texts(calls: DataFrame, members: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``member``, ``library``, ``clause`` and ``pieces`` (null: no such member) of ``calls`` and all calls in their texts, ``depth`` rounds at most.
    A member that isn't in the library that its call names is looked for in the main one."""
    new, out = cut(calls.select(*_CALL), "calls"), None
    for _ in range(depth):
        if new.isEmpty():
            break
        main = members.where("library = ''").select("member", F.col("text").alias("main_text"))
        found = new.join(members, ["member", "library"], "left").join(main, "member", "left").select(*_CALL, F.coalesce("text", "main_text").alias("text"))
        made = cut(_pieces(found, _CALL, "text", "clause"), "texts")
        if out:
            out.add(made)
        else:
            out = Pile(made, "call-texts")
        new = cut(_calls(made).join(out.read().select(*_CALL), _CALL, "left_anti"), "calls")
    return out.read() if out else _pieces(calls.withColumn("text", F.lit("")), _CALL, "text")


def _looked_up(places: DataFrame, known: DataFrame) -> DataFrame:
    """``places`` with the ``pieces`` of their calls. A call that many places make (one copybook of a whole shop) is split: its text is repeated for every ``LOAD`` places or so."""
    counts = cut(places.groupBy(*_CALL).agg(F.count("*").alias("n")), "places")
    load = max(LOAD, (counts.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = F.broadcast(counts.where(F.col("n") > load).select(*_CALL, F.ceil(F.col("n") / load).cast("int").alias("parts")))  # HOT rows at most
    parts = F.coalesce("parts", F.lit(1))
    left = places.join(hot, _CALL, "left").withColumn("part", F.pmod(F.xxhash64("program", "source_sha256", "place"), parts).cast("int")).drop("parts")
    right = known.join(hot, _CALL, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [*_CALL, "part"], "left").drop("part")


def _opened(pieces: DataFrame, keep: list[str], place: Column, within: Column) -> DataFrame:
    return pieces.select(*keep, place.alias("place"), within.alias("within"), F.posexplode("pieces").alias("i", "p")).select(
        *keep, F.concat("place", F.array("i")).alias("place"), "within", F.col("p.text").alias("text"), *(F.col(f"p.{c}").alias(c) for c in _CALL)
    )


def expand(sources: DataFrame, library: DataFrame, name_col: str = "name", source_col: str = "source", member_col: str = "member", text_col: str = "text", library_col: str | None = None, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """Programs with their members put in (``program``, ``source_sha256`` of the text as given, ``source``), and what could not be put in, a row for each place:
    ``program``, ``source_sha256``, ``member``, ``reason`` (``cycle``, ``too deep``, ``not found``) and ``within`` (the members around it, outermost first).

    Such a place is left empty. Null names and sources read as empty; rows alike in name and source are one program; members without a name are left out, of
    members of one name the smallest text counts, null texts are empty; an empty library leaves every COPY ``not found``; other columns are not read."""
    members = cut(shelf(library, member_col, text_col, library_col), "members")
    given = sources.select(F.coalesce(F.col(name_col).cast("string"), F.lit("")).alias("program"), F.coalesce(F.col(source_col), F.lit("")).alias("s"))
    given = given.withColumn("source_sha256", F.sha2(F.encode("s", "UTF-8"), 256)).dropDuplicates(["program", "source_sha256"])
    own = ["program", "source_sha256"]
    top = cut(_pieces(given, own, "s"), "programs")
    known = cut(texts(_calls(top), members, depth), "known")
    state = cut(_opened(top, own, F.array().cast("array<int>"), F.array().cast("array<string>")), "places")
    still = state.where("member IS NULL").select(*own, "place", "text")
    done = Pile(still, "texts")
    issue = [*own, "member", F.col("reason").alias("reason"), "within"]
    failed = Pile(state.limit(0).withColumn("reason", F.lit("")).select(*issue), "issues")
    while True:
        open_ = state.where("member IS NOT NULL").select(*own, "place", "within", *_CALL)
        reason = F.when(F.array_contains("within", F.col("member")), "cycle").when(F.size("within") >= depth, "too deep")
        judged = cut(open_.withColumn("reason", reason), "judged")
        if judged.isEmpty():
            break
        failed.add(judged.where("reason IS NOT NULL").select(*issue))
        met = cut(_looked_up(judged.where("reason IS NULL").drop("reason"), known), "met")
        failed.add(met.where("pieces IS NULL").withColumn("reason", F.lit("not found")).select(*issue))
        state = cut(_opened(met.where("pieces IS NOT NULL"), own, F.col("place"), F.concat("within", F.array("member"))), "places")
        done.add(state.where("member IS NULL").select(*own, "place", "text"))
    whole = F.array_sort(F.collect_list(F.struct("place", "text")))  # of one program
    return done.read().groupBy(*own).agg(F.array_join(F.transform(whole, lambda x: x["text"]), "").alias("source")), failed.read()


def uses(expansions: DataFrame) -> DataFrame:
    """``member``, ``reason``, ``places`` and ``programs`` of what could not be put in, for a report by member."""
    return expansions.groupBy("member", "reason").agg(F.count("*").alias("places"), F.count_distinct("program").alias("programs"))
