"""How the sources of a language differ in their words: distances between sources, and each source's most overused terms.

Terms are counted in the tasks that read the texts; one shuffle by (language, term) adds them up and drops terms of few documents.
With p a group's smoothed share of a term (an integer, in units of 1 / ``SCALE``), the distance of two groups sums ``|p - q|`` over all kept terms of
their language. Most terms are in neither, one or few groups, so only terms that are there are looked at, against the baseline of a term that isn't:

    V * |p0 - q0|  +  sum over a's terms (|p - q0| - |p0 - q0|)  +  the same for b's
      + sum over shared terms (|p - q| - |p - q0| - |p0 - q| + |p0 - q0|)

The first sums need a group's numbers of terms by p alone; shared terms meet in a join by (language, term), added up before they are shuffled.

The first ``top`` terms of a group come from a radix selection: a term's key is its value's complement in hexadecimal digits, then its UTF-8
bytes. Histograms over the next digits of all groups' open keys find the digits in which each group's ``top``-th key lies, until all keys that begin so
are wanted; first value bits, then, among ties, bytes. So no group's terms are sorted or meet in a task but those that are returned.

Results for odd input: null texts, languages and sources are empty texts, and groups like any other; texts are whole; a row is a document, so repeated rows and ids count each;
a group without kept terms has shares of the baseline, a language without kept terms distances of 0 and no terms; ties are in the order of
UTF-8 bytes; an empty table gives an empty one; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, written

LEAST, ADDED, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms with counts that a task holds at once.
HELD = 300_000
#: Groups up to which a row for each is sent to all executors; beyond, they are shuffled, a language's in SALTS parts.
SMALL, SALTS = 10_000, 64
#: Hexadecimal digits of a value (values are below 2**32) and those by which a step narrows.
VALUE, STEP = 8, 3
#: Bytes of a text to a term's bytes, or to a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` (documents with it): partial sums, several rows a term."""
    schema = "lang string, source string, term string, n bigint, docs bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        docs_: dict[tuple, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in n.items():
                terms = list(found)
                known = docs_[lang, source]
                columns = [[lang] * len(terms), [source] * len(terms), [t.decode() for t in terms], list(found.values()), list(map(known.__getitem__, terms))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "source", "term", "n", "docs"])
            n.clear()
            docs_.clear()

        for batch in batches:
            for some in slices(batch):
                for lang, source, text in zip(*(some.column(k).to_pylist() for k in range(3)), strict=True):
                    terms = text.translate(_BYTES).split()
                    n[lang, source].update(terms)
                    docs_[lang, source].update(set(terms))
                if sum(map(len, n.values())) > HELD:
                    yield from flush()
        yield from flush()

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(_or_empty(lang_col).alias("l"), _or_empty(source_col).alias("s"), text.alias("t")).mapInArrow(run, schema)


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def share(n: Column, all_: Column, v: Column, added: int = ADDED, scale: int = SCALE) -> Column:
    """1 + floor(scale * (n + added) / (all + added * v)), exact for all counts of 64 bits."""
    part = F.lit(scale).cast("decimal(10,0)") * (n + added).cast("decimal(20,0)")
    whole = (all_ + added * v).cast("decimal(20,0)")
    return ((part - part % whole) / whole).cast("long") + 1  # an exact quotient, however many of its decimals are kept


def kept_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST) -> DataFrame:
    """A written table of ``lang``, ``source``, ``term``, ``n`` and ``lang_n`` (the term's occurrences in its language): terms in at least ``least`` documents of the language."""
    by_term = Window.partitionBy("lang", "term")
    sums = term_counts(docs, text_col, lang_col, source_col).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    known = sums.withColumn("lang_n", F.sum("n").over(by_term)).withColumn("lang_docs", F.sum("docs").over(by_term))
    return written(known.where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n"), "terms")


def groups_of(docs: DataFrame, terms: DataFrame, lang_col: str = "lang", source_col: str = "source", added: int = ADDED, scale: int = SCALE) -> DataFrame:
    """A written table, a row for each (lang, source) of ``docs``: ``all`` (kept occurrences), ``lang_all``, ``v`` (kept terms of the language) and ``p0``, the share of a term that isn't there (null if v = 0)."""
    here = docs.select(_or_empty(lang_col).alias("lang"), _or_empty(source_col).alias("source")).distinct()
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("all"))
    distinct = terms.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_all"))
    out = here.join(sums, ["lang", "source"], "left").join(distinct, "lang", "left").fillna(0, ["all", "v", "lang_all"])
    return written(out.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("all"), F.col("v"), added, scale))), "groups")


def _small(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.limit(SMALL + 1).count() <= SMALL else groups


def pairs_of(groups: DataFrame) -> DataFrame:
    """``lang``, ``a``, ``b``, ``v``, ``p0a``, ``p0b``: every two sources of a language, once (a before b). As many rows as the result has."""
    left = groups.select("lang", F.col("source").alias("a"), "v", F.col("p0").alias("p0a"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("p0b"))
    if (some := _small(right)) is not right:
        return left.join(some, "lang").where("a < b")
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", salt).join(right, ["lang", "salt"]).where("a < b").drop("salt")


def distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source), ``value``: for every ordered pair. ``shares`` has ``lang``, ``source``, ``term``, ``p``, ``p0`` of terms that are there."""
    two = written(pairs_of(groups), "pairs")
    base = two.select("lang", "a", "b", F.coalesce(F.col("v") * F.abs(F.col("p0a") - F.col("p0b")), F.lit(0)).alias("d"))
    by_p = written(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k")), "levels")

    def alone(side: str, own: str, other: str) -> DataFrame:
        """What the terms of one side add, as if the other had none of them."""
        rows = by_p.withColumnRenamed("source", side).join(two, ["lang", side])
        return rows.groupBy("lang", "a", "b").agg(F.sum(F.col("k") * (F.abs(F.col("p") - F.col(other)) - F.abs(F.col(own) - F.col(other)))).alias("d"))

    a = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("p0a"))
    b = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("p0b"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b")
    shared = both.agg(F.sum(gap("pa", "pb") - gap("pa", "p0b") - gap("p0a", "pb") + gap("p0a", "p0b")).alias("d"))
    sums = base.unionByName(alone("a", "p0a", "p0b")).unionByName(alone("b", "p0b", "p0a")).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("d").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")


def first_of(rows: DataFrame, top: int = TOP) -> DataFrame:
    """Of a written table of ``lang``, ``source``, ``item``, ``value`` (0 to 2**32 - 1; items of a group differ) each group's first ``top`` by value
    descending, then item ascending by its UTF-8 bytes."""
    key = F.concat(F.lpad(F.hex(F.lit(16**VALUE - 1) - F.col("value")), VALUE, "0"), F.hex(F.col("item").cast("binary")))
    known = rows.withColumn("key", key)
    same = ["lang", "source"]
    # open groups: what all keys looked at begin with, and how many of them are still wanted
    open_ = written(rows.groupBy(*same).agg(F.count("*").alias("n")).select(*same, F.lit("").alias("prefix"), F.least(F.lit(top), F.col("n")).cast("long").alias("want"), (F.col("n") <= top).alias("closed")), "open")
    length = 0
    while open_.where("NOT closed").limit(1).count():
        step = min(STEP, VALUE - length) if length < VALUE else 2 * STEP
        at = _small(open_.where("NOT closed").select(*same, "prefix", "want"))
        inside = known.join(at, same).where(F.col("key").startswith(F.col("prefix")))
        bins = inside.groupBy(*same, "prefix", "want", F.substring("key", length + 1, step).alias("digits")).agg(F.count("*").alias("n"))
        upto = bins.withColumn("upto", F.sum("n").over(Window.partitionBy(*same).orderBy("digits")))
        hit = upto.where("upto >= want").groupBy(*same, "prefix", "want").agg(F.min_by(F.struct("digits", "n", "upto"), "digits").alias("c"))
        found = hit.select(*same, F.concat("prefix", "c.digits").alias("prefix"), (F.col("want") - (F.col("c.upto") - F.col("c.n"))).alias("want"), (F.col("want") == F.col("c.upto")).alias("closed"))
        open_ = written(open_.where("closed").unionByName(found), "open")
        length += step
    cut = _small(open_.select(*same, "prefix"))
    return known.join(cut, same).where(F.expr("substring(key, 1, length(prefix)) <= prefix")).drop("key", "prefix")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, added: int = ADDED, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``, ``value``, ``rank``. ``scale`` is below 2**32."""
    terms = kept_terms(docs, text_col, lang_col, source_col, least)
    groups = groups_of(docs, terms, lang_col, source_col, added, scale)
    known = terms.join(_small(groups), ["lang", "source"])
    shares = known.withColumn("p", share(F.col("n"), F.col("all"), F.col("v"), added, scale)).withColumn("q", share(F.col("lang_n"), F.col("lang_all"), F.col("v"), added, scale))
    shares = written(shares.select("lang", "source", "term", "p", "q", "p0"), "shares")
    over = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    parts = [distances(groups, shares).withColumn("part", F.lit("pair")), first_of(written(over, "over"), top).withColumn("part", F.lit("term"))]
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", rank.alias("rank"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the audit of all documents."""
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), w AS (
  SELECT i, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), l AS (
  SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS al FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), s AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS al FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL
), p AS (
  SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.al::HUGEINT + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (kept.n + 5)) // (l.al::HUGEINT + 5 * l.v) AS q
  FROM s JOIN kept ON s.lang = kept.lang JOIN l ON s.lang = l.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), u AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
