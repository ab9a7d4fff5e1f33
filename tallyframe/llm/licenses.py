"""License scans: TF-IDF cosine to templates, then inheritance from ancestor directories; native expressions only.

Passages (sentences and lines of the whole text that mention a licence at all) are compared with
template vectors: weights are counts times inverse document frequency over all passages
of the corpus, counted for all words. A template is compared with the window of its own length in the
passage that shares most with it, so words before and after it don't matter; short forms and SPDX identifiers count as
they are, with score 1. The best passage decides a file's own licence; of equal scores the longer
template, and ``proprietary`` last. A licence file (by its name) speaks for its directory: a file
without an own licence takes that of the nearest directory above it that has one. Each distinct
directory is joined with its ancestors, not each file, so a directory of any size
costs one row there.

Results for odd input: null and empty texts have no own licence; a null path has no directory to
inherit from; repeated rows get equal results; of several licence files in a directory the
best match speaks, of equal ones the first by path; an empty table gives an empty one; other
columns are neither read nor returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_known, table, written

#: Short forms and opening sentences by which licences are known.
TEMPLATES = (
    ("MIT", "released under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "use of this source code is governed by a bsd style license"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("CC-BY-4.0", "licensed under cc by 4.0"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0"),
    ("MIT", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MIT", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("Apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("BSD-3-Clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("BSD-2-Clause", "licensed under the simplified bsd 2 clause license"),
    ("ISC", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("AGPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"),
    ("Zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("BSL-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("CC0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved"),
)
#: Short forms: words that tell a licence wherever they stand together.
FORMS = (
    *(("MIT", x) for x in ("mit license", "mit licence", "mit licensed", "licensed under mit", "license mit")),
    *(("Apache-2.0", x) for x in ("apache license version 2.0", "apache license v2.0", "apache license 2.0", "apache 2.0 license", "license apache 2.0")),
    *(("BSD-3-Clause", x) for x in ("bsd 3 clause", "3 clause bsd")),
    *(("BSD-2-Clause", x) for x in ("bsd 2 clause", "2 clause bsd", "simplified bsd license")),
    *(("ISC", x) for x in ("isc license", "isc licence")),
    *(("AGPL-3.0", x) for x in ("affero general public license version 3", "affero general public license v3", "agplv3", "agpl v3", "agpl 3.0")),
    *(("EPL-2.0", x) for x in ("eclipse public license 2.0", "eclipse public license v2.0", "eclipse public license v 2.0", "epl 2.0")),
    *(("Zlib", x) for x in ("zlib license", "zlib licence")),
    *(("BSL-1.0", x) for x in ("boost software license version 1.0", "boost software license 1.0")),
    *(("CC0-1.0", x) for x in ("cc0 1.0", "cc0 license")),
    *(("GPL-3.0", x) for x in ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gplv3", "gpl v3", "gpl 3.0")),
    *(("LGPL-3.0", x) for x in ("lesser general public license version 3", "lesser general public license v3", "gnu lgpl version 3", "lgplv3", "lgpl v3", "lgpl 3.0")),
    *(("MPL-2.0", x) for x in ("mozilla public license version 2.0", "mozilla public license v 2.0", "mozilla public license v2.0", "mozilla public license 2.0", "mpl 2.0")),
    ("CC-BY-4.0", "cc by 4.0"),
    ("CC-BY-SA-4.0", "cc by sa 4.0"),
    ("CC-BY-NC-4.0", "cc by nc 4.0"),
)
#: An SPDX tag's first identifier, without what is said of later versions.
SPDX = r"(?i)spdx-license-identifier:\s*\(?([a-z0-9.-]*[a-z0-9])"
LATER = r"-(only|or-later)$"
#: What a passage mentions, and the names of licence files.
MENTION = r"(?i)licen[sc]e|copyright|rights\s+reserved|permission\s+(?:is|to)\s|redistribution\s+and\s+use|names?\s+of\s+(?:the|its)\s|accompanying\s+materials|without\s+warranty|as\s+is\W?\s+basis|\bcc0\b|free\s+software|public\s+domain|\bcc[ -]by\b|\b[al]?gpl[ -]?v?3|\bepl[ -]2|\bmpl[ -]2"
FILES = r"(?i)(^|/)(licen[sc]e|copying|unlicense)(\.[a-z]+)?$"
WORDS = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Cosine from which a passage has a template's licence.
LEAST = 0.6
#: Words at most whose frequencies all executors hold: each has that part of all words of passages.
HOT = 10_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def template_words() -> list[str]:
    import re

    return sorted({w for _, t in TEMPLATES for w in re.findall(WORDS, t)})


def passages(files: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of ``files``, ``words`` (array) and ``spdx`` (the identifier of a tag, in small letters, or empty) of each
    passage that mentions a licence."""
    mentioned = files.where(F.col(text_col).rlike(MENTION))
    each = mentioned.select(*(c for c in files.columns if c != text_col), F.explode(F.filter(F.split(text_col, r"\n|(?<=[.!?;])\s+"), lambda p: p.rlike(MENTION))).alias("p"))
    spdx = F.regexp_replace(F.lower(F.regexp_extract("p", SPDX, 1)), LATER, "")
    return each.withColumn("words", _words(F.col("p"))).withColumn("spdx", spdx).drop("p").where(F.size("words") > 0)


def frequencies(found: DataFrame) -> DataFrame:
    """``word`` and ``k``: how many passages have it, for every word; combined on the map side."""
    return written(found.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("k")), "frequencies")


def weights(n: int, df: dict[str, int]) -> list[dict[str, float]]:
    """Each template's unit vector."""
    unit = []
    for _, text in TEMPLATES:
        v: dict[str, float] = {}
        for w in text.split():
            v[w] = v.get(w, 0) + math.log((1 + n) / (1 + df.get(w, 0))) + 1
        norm = math.sqrt(sum(x * x for x in v.values()))
        unit.append({w: x / norm for w, x in v.items()})
    return unit


def weighed(found: DataFrame, n: int, df: DataFrame) -> DataFrame:
    """``found`` (whose ``passage`` is a key) with ``vector``: its words in order, as structs of ``w`` and weight ``x``. Words that many
    passages have are looked up where they are, the others are joined, so no word's rows meet in one task."""
    total = df.agg(F.sum("k")).first()[0] or 0
    often = F.col("k") * HOT >= total  # at most HOT words
    each = found.select("passage", F.posexplode("words").alias("at", "word")).join(F.broadcast(df.where(often)), "word", "left")
    seldom = each.where(F.col("k").isNull()).drop("k").join(df.where(~often), "word")
    each = each.where(F.col("k").isNotNull()).unionByName(seldom)
    item = F.struct("at", F.col("word").alias("w"), (F.log((1 + n) / (1 + F.col("k"))) + 1).alias("x"))
    return found.drop("words").join(each.groupBy("passage").agg(F.array_sort(F.collect_list(item)).alias("vector")), "passage")


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for item in values.items() for x in item))


def _cosine(unit: dict[str, float], length: int) -> Column:
    """The cosine of a template and the window of its length that shares most of its weight, each word once (the first of such). Windows begin with a
    word of the template, or are the last one. A window costs as many steps as it has words, the cosine of the chosen one their square."""
    own, shares, v = _map(unit), _map({w: u * u for w, u in unit.items()}), F.col("vector")
    template = F.array(*map(F.lit, unit))
    last = F.greatest(F.size(v) - length, F.lit(0))
    starts = F.array_distinct(F.transform(F.filter(v, lambda t: F.try_element_at(own, t["w"]).isNotNull()), lambda t: F.least(t["at"], last) + 1))

    def shared(start: Column) -> Column:
        words = F.array_intersect(F.slice("words", start, F.lit(length)), template)
        return F.struct(F.round(F.aggregate(words, F.lit(0.0), lambda a, w: a + F.try_element_at(shares, w)), 9).alias("shared"), (-start).alias("at"))

    def cosine(window: Column) -> Column:
        dot = F.aggregate(window, F.lit(0.0), lambda a, t: a + t["x"] * F.coalesce(F.try_element_at(own, t["w"]), F.lit(0.0)))
        square = F.aggregate(window, F.lit(0.0), lambda a, t: a + t["x"] * t["x"] * F.size(F.filter(window, lambda o: o["w"] == t["w"])))
        return dot / F.sqrt(square)

    best = F.array_max(F.transform(starts, shared))
    return F.coalesce(F.get(F.transform(F.array(best), lambda b: cosine(F.slice(v, -b["at"], F.lit(length)))), F.lit(0)), F.lit(0.0))


def _rank(name: str, length: int) -> int:
    """Of equal scores the higher: rights are reserved beside a licence, too."""
    return 0 if name == "proprietary" else length


def matched(found: DataFrame, n: int, df: DataFrame) -> DataFrame:
    """``found`` with ``license``, ``score`` (rounded to 6 digits) and ``rank`` of each passage's nearest template or form."""
    unit = weights(n, {r.word: r.k for r in df.where(F.col("word").isin(template_words())).collect()})
    joined = F.concat(F.lit(" "), F.array_join(F.transform("vector", lambda t: t["w"]), " "), F.lit(" "))
    entry = lambda score, name, length, k: F.struct(score.alias("score"), F.lit(_rank(name, length)).alias("rank"), F.lit(-k).alias("order"), F.lit(name).alias("license"))
    scores = [entry(F.round(_cosine(u, len(text.split())), 6), name, len(text.split()), k) for k, ((name, text), u) in enumerate(zip(TEMPLATES, unit, strict=True))]
    scores += [F.when(F.col("joined").contains(f" {text} "), entry(F.lit(1.0), name, len(text.split()), len(TEMPLATES))) for name, text in FORMS]
    scores += [F.when(F.col("spdx") == name.lower(), entry(F.lit(1.0), name, 100, len(TEMPLATES))) for name in sorted({name for name, _ in TEMPLATES} - {"proprietary"})]
    each = weighed(found, n, df).withColumn("joined", joined).withColumn("words", F.transform("vector", lambda t: t["w"]))
    best = each.withColumn("best", F.array_max(F.array(*scores)))
    return best.drop("vector", "words", "joined", "spdx").select("*", "best.license", "best.score", "best.rank").drop("best")


def directory(path: Column) -> Column:
    """All before the last slash; the empty string is the root; null of null."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).when(path.isNotNull(), F.lit(""))


def ancestors(folder: Column) -> Column:
    """A directory and all above it, as structs of depth and path."""
    parts = F.split(folder, "/")
    depth = F.when(folder == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("path")))


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: Column | str = "path", least: float = LEAST) -> DataFrame:
    """For every row ``id_col``, ``path``, ``own_license``, ``own_score`` (of the best passage, null without one), ``license`` and
    ``license_from`` (``own``, the directory that it comes from, or null)."""
    given = files.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (F.col(path) if isinstance(path, str) else path).alias("path"), F.col(text_col).alias("text"))
    found = written(passages(given.select("row", "text")).withColumn("passage", F.monotonically_increasing_id()), "passages")
    own = matched(found, found.count(), frequencies(found)).groupBy("row").agg(F.max_by(F.struct("license", "score"), F.struct("score", "rank", "license")).alias("b"))
    rows = given.select("row", "id", "path", directory(F.col("path")).alias("folder"))
    named = written(rows.join(own, "row", "left").select("id", "path", "folder", F.when(F.col("b.score") >= least, F.col("b.license")).alias("own_license"), F.col("b.score").alias("own_score")), "owns")
    speaks = named.where(F.col("own_license").isNotNull() & F.col("path").rlike(FILES))
    speaks = speaks.groupBy(F.col("folder").alias("above")).agg(F.min_by("own_license", F.struct(-F.col("own_score"), "path")).alias("inherited"))
    # a row for each directory, with its files' number: directories of many files are looked up where the files are
    folders = written(named.where(F.col("folder").isNotNull()).groupBy("folder").agg(F.count("*").alias("n")), "folders")
    near = folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).join(speaks, F.col("a.path") == F.col("above"))
    near = near.groupBy("folder").agg(F.max_by(F.struct("inherited", "above"), "a.depth").alias("near"))
    near = written(folders.join(near, "folder", "left"), "near")
    none = F.lit(None).cast(near.schema["near"].dataType)
    out = join_known(named.where(F.col("folder").isNotNull()), near, "folder").unionByName(named.where(F.col("folder").isNull()).withColumn("near", none))
    return out.select(
        F.col("id").alias(id_col), "path", "own_license", "own_score", F.coalesce("own_license", "near.inherited").alias("license"),
        F.when(F.col("own_license").isNotNull(), F.lit("own")).otherwise(F.col("near.above")).alias("license_from"),
    )


def document_path() -> Column:
    """Documents have no paths: a tree of source, language and blocks of 64 ids, whose first document (and, for every 4096 ids,
    its language's) is a licence file."""
    i = F.col("doc_id")
    base = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    return F.when(i % 4096 == 1, F.concat(base, F.lit("/LICENSE"))).otherwise(F.concat(base, F.lit("/"), F.floor(i / 64).cast("string"), F.lit("/"), F.when(i % 64 == 0, F.lit("LICENSE")).otherwise(F.concat(i.cast("string"), F.lit(".txt")))))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's own and inherited licence."""
    return scan(table(spark, sf_dir, "documents"), path=document_path())
