"""Secret scans with corpus-wide ownership frequency.

A scan finds candidate spans in each whole text: the base kinds (assign, access,
hex) and three more (opaque, url, pem). Candidates are known by the SHA-256 of
their value only. Counted over the whole corpus by distinct repositories and
owners, a value that many own is an example copied around; a value of few owners
in few repositories looks live. Live-looking candidates of the additional kinds become
spans; base spans stay whatever their frequency, which is told beside them.
A candidate of the additional kinds that one base span covers whole is left out; one that goes beyond stays, so spans may
overlap. No part of a pattern has a greatest length.

Results for odd input: null and empty texts have no spans; a null owner or
repository counts as one owner or repository of its own; repeated rows each
keep their spans and count once by owner; null and repeated ids keep their rows; a key without its end mark is no span; an empty table gives an empty one;
other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, join_known, split_by_ids, table, version, written

#: The base kinds, in their order, their patterns and least lengths.
BASE = (
    ("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Additional kinds: long tokens of mixed characters, passwords in URLs, private keys (by their marks).
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
URL = re.compile(r"(?<=[A-Za-z0-9+.-])://[^\s/:@]*:([^\s/@]{3,})@")
MARK = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY-----")
MORE = ("opaque", "url", "pem")
KINDS = [*(k for k, *_ in BASE), *MORE]
#: Distinct owners or repositories up to which a value looks live.
LIVE_OWNERS, LIVE_REPOSITORIES = 2, 4
#: Bits of entropy per character from which a mixed token counts as random.
ENTROPY = 3.5

_ASSIGN, _ACCESS, _HEX = (re.compile(p if k != "hex" else "[0-9a-f]{24,}") for k, p, _, _ in BASE)


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind number, end, value)`` of the base kinds, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= BASE[0][3]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= BASE[1][3]]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def keys(text: str) -> list[tuple[int, int]]:
    """Private keys: from a begin mark to the first end mark behind it, in one pass."""
    found, opened = [], None
    for m in MARK.finditer(text):
        if m[1] == "BEGIN":
            opened = m.start() if opened is None else opened
        elif opened is not None:
            found.append((opened, m.end()))
            opened = None
    return found


def outside(spans: list[tuple[int, int, int, str]], covers: list[tuple[int, int]]) -> list[tuple[int, int, int, str]]:
    """``spans``, sorted, without those that one of ``covers`` covers whole."""
    covers, at, reach, left = sorted(covers), 0, -1, []
    for x in sorted(spans):
        while at < len(covers) and covers[at][0] <= x[0]:
            reach, at = max(reach, covers[at][1]), at + 1
        if reach < x[2]:
            left.append(x)
    return left


def more_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Candidates of the additional kinds."""
    found = []
    for m in OPAQUE.finditer(text):
        token = m[0]
        if any(c.isdigit() for c in token) and any("A" <= c <= "Z" for c in token) and any("a" <= c <= "z" for c in token) and entropy(token) >= ENTROPY:
            found.append((m.start(), 3, m.end(), token))
    if "://" in text:
        found += [(m.start(1), 4, m.end(1), m[1]) for m in URL.finditer(text)]
    if "-----BEGIN" in text:
        pem = keys(text)
        found = outside(found, pem) + [(a, 5, b, text[a:b]) for a, b in pem]
    return outside(found, [(a, b) for a, _, b, _ in base])


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


SCAN = "struct<start: int, kind: int, end: int, value: string>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str | F.Column = "source", repository: str | F.Column = "source") -> DataFrame:
    """A written table of ``row`` (a number of the row), ``id``, ``owner``, ``repository``, the base
    counts and digest, and all candidates ``found`` with their values hashed."""

    def rows(b: dict) -> dict:
        out: dict = {k: b[k] for k in ("row", "id", "owner", "repository")} | {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "found")}
        for text in b["t"]:
            base = base_spans(text or "")
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(x[1] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans = sorted(base + more_spans(text or "", base))
            out["found"].append([{"start": a, "kind": k, "end": b, "value": hashlib.sha256(v.encode()).hexdigest()} for a, k, b, v in spans])
        return out

    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), as_col(owner).cast("string").alias("owner"), as_col(repository).cast("string").alias("repository"), F.col(text_col).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    return written(arrow_map(given, f"row bigint, id {kind}, owner string, repository string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, found array<{SCAN}>", rows), "candidates")


def ownership(scanned: DataFrame) -> DataFrame:
    """``value``, ``owners``, ``repositories`` (distinct ones over all rows) and ``n``, its candidates. Each step combines on the map
    side, so a value copied everywhere arrives as one row a task."""
    each = scanned.select(F.explode("found.value").alias("value"), "owner", "repository").groupBy("value", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def judged(scanned: DataFrame) -> DataFrame:
    """``row`` and ``spans`` (array of start, kind, end, live) of the rows that have candidates; spans are the base
    ones and those live-looking ones of the additional kinds. The counts of values that many candidates have go to all executors,
    the others are joined, so no value's candidates meet in one task."""
    known = ownership(scanned).select("value", "n", ((F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES)).alias("live"))
    each = scanned.select("row", F.explode("found").alias("s")).select("row", "s.*")
    every = join_known(each, written(known, "ownership"), "value").select("row", "start", "kind", "end", "live")
    return every.where(F.col("live") | (F.col("kind") < len(BASE))).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("spans"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str | F.Column = "source", repository: str | F.Column = "source") -> DataFrame:
    """For every row: base counts and digest, ``spans`` (all, as kind:start:end), and how many spans look live
    (``n_live``) or are widely copied (``n_copied``)."""
    scanned = scan(docs, id_col, text_col, owner, repository)
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = scanned.drop("found").join(judged(scanned), "row", "left")
    n = lambda live: F.coalesce(F.size(F.filter("spans", lambda s: s["live"] == live)), F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"),
        F.when(F.col("spans").isNull(), 0).otherwise(n(True)).cast("long").alias("n_live"), F.when(F.col("spans").isNull(), 0).otherwise(n(False)).cast("long").alias("n_copied"),
    )


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: str | F.Column = "source", repository: str | F.Column = "source") -> DataFrame:
    """``docs``, all columns and rows, with live-looking secrets replaced by ``[secret:kind]`` in ``text_col``.
    Rows meet their spans by id and text, so null and repeated ids make no difference. The name ``__version`` is reserved."""
    columns = docs.columns
    docs = docs.withColumn("__version", version(F.col(id_col), F.col(text_col)))
    scanned = scan(docs, "__version", text_col, owner, repository)
    live = judged(scanned).select("row", F.filter("spans", lambda s: s["live"]).alias("__spans")).where(F.size("__spans") > 0)
    by_id = written(scanned.select("row", F.col("id").alias("__version")).join(live, "row").groupBy("__version").agg(F.first("__spans").alias("__spans"), F.count("*").alias("n")), "live")
    some, clean = split_by_ids(docs, "__version", by_id.select("__version"))  # only texts that may hold one meet the spans

    # Pieces of text between spans, from the last end to the next start; overlapping spans merge as the position only moves on.
    def piece(state, s):
        start, end = F.greatest(s["start"], state["at"]), F.greatest(s["end"], state["at"])
        kept = F.substring(F.col(text_col), state["at"] + 1, start - state["at"])
        tag = F.when(s["end"] > state["at"], F.concat(F.lit("[secret:"), F.get(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.concat(state["out"], kept, tag).alias("out"), end.alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate("__spans", start, piece, lambda s: F.concat(s["out"], F.substring(F.col(text_col), s["at"] + 1, F.length(text_col))))
    out = join_known(some, by_id, "__version", how="left")
    out = out.select(*(F.when(F.col("__spans").isNull(), F.col(c)).otherwise(masked).alias(c) if c == text_col else F.col(c) for c in columns))
    return out.unionByName(clean.select(*columns))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: secrets in every document; a source is an owner, its texts in one language a repository."""
    return find_secrets(table(spark, sf_dir, "documents"), repository=F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))))
