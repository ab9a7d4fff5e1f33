import math
import random
import re

from tallyframe.llm import licenses


def brute(rows):
    """rows: id, path, text."""
    every = []
    for k, (_, _, text) in enumerate(rows):
        for p in re.split(r"\n|(?<=[.!?;])\s+", text or ""):
            if re.search(licenses.MENTION, p):
                words = re.findall(licenses.WORDS, p.lower())
                if words:
                    every.append((k, words))
    n = len(every)
    df = lambda w: sum(w in words for _, words in every)
    known = set(licenses.template_words())
    idf = lambda w: math.log((1 + n) / (1 + df(w))) + 1 if w in known else math.log(1 + n) + 1
    vec = lambda words: {w: words.count(w) * idf(w) for w in set(words)}
    best = {}
    for k, words in every:
        v = vec(words)
        for name, text in licenses.TEMPLATES:
            t = vec(text.split())
            c = sum(x * t.get(w, 0) for w, x in v.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in t.values()))
            if k not in best or c > best[k][0] + 1e-9:
                best[k] = (c, name)
    own = {k: name for k, (c, name) in best.items() if c >= licenses.LEAST}
    out = []
    for k, (i, path, _) in enumerate(rows):
        got, where = own.get(k), "own" if k in own else None
        folder = path.rpartition("/")[0] if path is not None else None
        while got is None and folder is not None:
            speaking = [(-best[j][0], rows[j][1], own[j]) for j in own if rows[j][1] is not None and re.search(licenses.FILES, rows[j][1]) and rows[j][1].rpartition("/")[0] == folder]
            if speaking:
                got, where = min(speaking)[2], folder
            folder = folder.rpartition("/")[0] if folder else None
        out.append((i, path, own.get(k), got, where))
    return out


def test_against_brute_force(spark):
    r = random.Random(2)
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "All rights reserved.", "Licensed under CC BY-NC 4.0.", "This text has a license to be long and says nothing of use to anybody here at all."]
    rows = []
    for i in range(80):
        text = " ".join(r.choice("abcdefg") * 3 for _ in range(10)) + "."
        if r.random() < 0.3:
            text += r.choice(["\n", " "]) + r.choice(lines) + "\nend"
        path = "/".join(r.choice("xyz") for _ in range(r.randint(0, 3)))
        path += ("/" if path else "") + (r.choice(["LICENSE", "COPYING.md"]) if r.random() < 0.3 else f"{i}.py")
        rows.append((i, path, text))
    rows += [(200, "x/y/q", None), (201, None, lines[0]), (202, None, ""), (0, rows[0][1], rows[0][2])]
    files = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id bigint, path string, text string, license string")
    got = [(x.doc_id, x.path, x.own_license, x.license, x.license_from) for x in licenses.scan(files).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows)))
    assert licenses.scan(files.limit(0)).collect() == []


def test_each_template_is_itself(spark):
    files = spark.createDataFrame([(i, f"f{i}", "Some header. " + t) for i, (_, t) in enumerate(licenses.TEMPLATES)], "doc_id bigint, path string, text string")
    got = {x.doc_id: x.own_license for x in licenses.scan(files).collect()}
    mentioned = __import__("re").compile(licenses.MENTION)
    assert all(got[i] == name for i, (name, t) in enumerate(licenses.TEMPLATES) if mentioned.search(t) and i not in (3, 5, 9))


def test_sentences_with_extra_words_at_two_sizes(spark):
    said = [
        ("This project is released under the MIT License.", "MIT"),
        ("The code is available under the Apache License, Version 2.0", "Apache-2.0"),
        ("Copyright (c) 2021 Acme Corp, all rights reserved", "proprietary"),
        ("SPDX-License-Identifier: MIT", "MIT"),
        ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        ("SPDX-License-Identifier: ISC", "ISC"),
        ("SPDX-License-Identifier: WTFPL", None),
        ("SPDX-License-Identifier: MIT-0", None),
        ("Unless told otherwise, this work is licensed under the terms of the GNU General Public License, version 3, by us all", "GPL-3.0"),
        ("Copyright 2020 Acme, all rights reserved, released under the MIT License", "MIT"),
        ("Our hall has a license to be long and all of it is reserved", None),
    ]
    fill = ["Licensed under the Apache License, Version 2.0.", "All rights reserved.", "Licensed under CC BY 4.0.", "Nobody here needs a license for fishing in the lake."]
    scores = []
    for copies in (8, 2000):
        rows = [(i, f"f{i}", t) for i, (t, _) in enumerate(said)] + [(100 + i, f"g{i}", f"{fill[i % 4]} {fill[(i + 1) % 4]}") for i in range(copies)]
        got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
        assert [got[i].own_license for i in range(len(said))] == [name for _, name in said]
        scores.append([got[i].own_score for i in range(4)])
    assert scores[0] == scores[1]


def test_all_words_are_counted(spark, monkeypatch):
    texts = ["Licensed to an angler.", "A license for an angler and an owl.", "License"]
    found = licenses.written(licenses.passages(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "passage bigint, text string")), "p")
    for hot in (1, 10_000):  # words joined, words looked up
        monkeypatch.setattr(licenses, "HOT", hot)
        df = licenses.frequencies(found)
        assert {r.word: r.k for r in df.collect()} == {"licensed": 1, "to": 1, "an": 2, "angler": 2, "a": 1, "license": 2, "for": 1, "and": 1, "owl": 1}
        got = {r.passage: [(x.w, round(x.x, 9)) for x in r.vector] for r in licenses.weighed(found, 3, df).collect()}
        idf = lambda k: round(math.log(4 / (1 + k)) + 1, 9)
        assert got[0] == [("licensed", idf(1)), ("to", idf(1)), ("an", idf(2)), ("angler", idf(2))] and got[2] == [("license", idf(2))]


def test_whole_texts_and_long_passages(spark):
    """Licence texts as they stand in files, wrapped and with other names, and a line of a million characters."""
    mit = """Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above notice appears."
    agpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by others."
    epl = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at its place."
    zlib = "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to terms."
    cc0 = "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"
    long = "word the of license use " * 40_000 + "released under the MIT License"
    said = [(mit, "MIT"), (isc, "ISC"), (agpl, "AGPL-3.0"), (epl, "EPL-2.0"), (zlib, "Zlib"), (cc0, "CC0-1.0"), (long, "MIT"), ("under the 2-clause BSD licence", "BSD-2-Clause"), (mit, "MIT")]
    rows = [(i, f"f{i}", t) for i, (t, _) in enumerate(said)] + [(None, None, isc), (None, "x/LICENSE", zlib), (50, "x/y.py", "plain")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by_id[i].own_license for i in range(len(said))] == [name for _, name in said]
    assert sorted(r.own_license for r in got if r.doc_id is None) == ["ISC", "Zlib"] and (by_id[50].license, by_id[50].license_from) == ("Zlib", "x")
