import math
import random
import re
import zlib

from tallyframe.llm import toxicity as tox


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_brute_force():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 11)))
    terms = [(t, False, 1.0, tox.edits_allowed(t)) for t in sorted({word() for _ in range(25)})]
    automaton = tox.Automaton(terms)
    for _ in range(3000):
        w = word()
        near = [d for t, _, _, allowed in terms if (d := distance(w, t)) <= allowed]
        hit = automaton.match(w)
        assert (hit[1] if hit else None) == min(near, default=None), (w, hit)


def test_stems():
    automaton = tox.Automaton([("lowei", True, 2.0, 0), ("idiot", False, 3.0, 1)])
    assert automaton.match("loweischaft") == (2.0, 0, "lowei")
    assert automaton.match("lowe") is None
    assert automaton.match("idiot") == (3.0, 0, "idiot") and automaton.match("idiiot") == (3.0, 1, "idiot")
    assert automaton.match("idi") is None


def test_quotation_is_apart():
    hits = tox.Hits(tox.Automaton([("idiot", False, 3.0, 1)]))
    (exact, quoted, *_), n, q = tox.features("you are an idiot", hits)
    assert exact > 0 and quoted == 0 and (n, q) == (1, 0)
    (exact, quoted, *_), n, q = tox.features('he used "the idiot word" once', hits)
    assert exact == 0 and quoted > 0 and (n, q) == (1, 1)
    (_, _, fuzzy, _, *_), n, q = tox.features("what an idiiot", hits)
    assert fuzzy > 0
    assert tox.features("", hits) == ([0.0] * 6, 0, 0)


def corpus():
    r = random.Random(2)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(400):
        text = [r.choice(words) for _ in range(60)]
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                text[r.randrange(60)] = r.choice(["grumpfolk", "zwibbel", "kratzen"])
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(1000, None, 0.5), (1001, "", 0.5), (0, rows[0][1], 0.5)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = tox.train(docs, labels)
    got = {r.doc_id: r for r in tox.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {r.doc_id for r in docs.where(tox.held_out("doc_id")).collect()} - {1000, 1001} == {i for i, _ in held}
    assert sum(got[i].predicted == y for i, y in held) >= 0.98 * len(held)
    assert got[1000].score == got[1001].score < 0.5
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = tox.score(docs, model, keep=True)
    assert kept.count() == docs.count() and "text" in kept.columns
    # labels outside the training part make no difference
    changed = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows], "doc_id bigint, toxic int")
    assert tox.train(docs, changed) == model


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    [row] = tox.score(docs, tox.train(docs, labels)).collect()
    assert row.predicted == 0 and 0 <= row.score < 0.7
    assert tox.score(docs.limit(0), tox.train(docs.limit(0), labels)).collect() == []


def test_ordinary_neighbour_leaves_a_term_its_edits():
    r = random.Random(3)
    words = ["".join(r.choice("aeiulst") for _ in range(r.randint(3, 7))) for _ in range(200)]
    texts, toxic = [], []
    for i in range(400):
        text = [r.choice(words) for _ in range(20)]
        bad = i % 8 == 0
        if bad:
            text[0] = "morrong"
        elif i % 3 == 0:
            text[0] = "morron"  # an ordinary word, one edit away, in many clean documents
        texts.append(" ".join(text))
        toxic.append(int(bad))
    terms, ordinary = tox.learn_terms(texts, toxic)
    assert [(t, e) for t, stem, _, e in terms if not stem] == [("morrong", 1)] and ordinary == ["morron"]
    automaton = tox.Automaton(terms, ordinary)
    assert automaton.match("morron") is None
    assert [automaton.match(w)[1:] for w in ("morrong", "morr0ng", "morrrong")] == [(0, "morrong"), (1, "morrong"), (1, "morrong")]


def test_many_rare_neighbours_take_one_edit_of_two():
    r = random.Random(4)
    words = ["".join(r.choice("aeiulst") for _ in range(r.randint(3, 7))) for _ in range(200)]
    rare = ["gr" + x + "mpf" + y + "lks" for x in "aeio" for y in "aeiu"]  # two edits from the term
    texts, toxic = [], []
    for i in range(400):
        text = [r.choice(words) for _ in range(20)]
        bad = i % 8 == 0
        if bad:
            text[0] = "grumpfolks"
        elif i % 8 == 1 and rare:
            text[0] = rare.pop()
        texts.append(" ".join(text))
        toxic.append(int(bad))
    terms, ordinary = tox.learn_terms(texts, toxic)
    assert [(t, e) for t, stem, _, e in terms if not stem] == [("grumpfolks", 1)] and ordinary == []


def brute_features(text, terms):
    """By the definition: all hits against all tokens, quotations found line by line, windows by comparing positions."""
    lines = [line.split() for line in text.lower().split("\n")]
    tokens = [w for line in lines for w in line]
    quoted, at = set(), 0
    for line in lines:
        k = 0
        while k < len(line):
            if line[k][0] in tox.QUOTES:
                ends = [j for j in range(k, len(line)) if (e := line[j].rstrip(".,;:!?")) and e[-1] in tox.QUOTES[line[k][0]] and (j > k or len(e) > 1)]
                if not ends:
                    break
                quoted |= set(range(at + k, at + ends[0] + 1))
                k = ends[0]
            k += 1
        at += len(line)

    def hit(token):
        found = []
        for word in re.findall(r"[^\W_]+", token):
            near = [(d, -w) for t, stem, w, allowed in terms if not stem and (d := distance(word, t)) <= allowed]
            if near:
                d, w = min(near)
                found.append((-w, d))
            else:
                stems = [(len(t), w) for t, stem, w, _ in terms if stem and word.startswith(t)]
                found += [(max(stems)[1], 0)] if stems else []
        return max(found, key=lambda x: x[0]) if found else None

    hits = {i: h for i, token in enumerate(tokens) if (h := hit(token))}
    sums, best = [0.0] * 4, 0.0
    for i, (weight, edits) in hits.items():
        bare = lambda a, b: {w.strip(".,;:!?\"'") for w in tokens[max(0, a) : b]}
        near = sum(abs(j - i) <= tox.WINDOW for j in hits) - 1
        score = weight * (1 + 0.25 * min(4, near)) * (1.25 if bare(i - tox.WINDOW, i + tox.WINDOW + 1) & tox.ADDRESS else 1) * 0.6**edits
        told = i in quoted or bool(bare(i - 3, i) & tox.REPORTING)
        sums[2 * (edits > 0) + told] += score
        best = best if told else max(best, score)
    n_quoted = sum(i in quoted or bool({w.strip(".,;:!?\"'") for w in tokens[max(0, i - 3) : i]} & tox.REPORTING) for i in hits)
    return [*map(math.log1p, sums), best, math.log1p(100 * (len(hits) - n_quoted) / max(1, len(tokens)))], len(hits), n_quoted


def test_features_against_brute_force():
    r = random.Random(9)
    terms = [("moron", False, 3.0, 1), ("worthless", False, 2.0, 2), ("scum", False, 4.0, 0), ("lowei", True, 2.5, 0)]
    hits = tox.Hits(tox.Automaton(terms))
    words = ["moron", "morron", "m0ron", "worthles", "worhtless", "scum", "scam", "loweischaft", "moron-scum", "you", "said", "the", "plain", "text", "«", "»", '"', "'tis", "it's", "a.", "„so", "ende“", "!?"]
    for _ in range(400):
        text = "".join((r.choice(["", "", "", '"', "“", "'", "«"]) + r.choice(words) + r.choice(["", "", "", '"', "”", "'", "».", ",", '"!'])) + r.choice([" ", " ", " ", "\n"]) for _ in range(r.randint(0, 40)))
        got, want = tox.features(text, hits), brute_features(text, terms)
        assert got[1:] == want[1:] and all(abs(a - b) < 1e-9 for a, b in zip(got[0], want[0], strict=True)), text
    long = '"' + "plain " * 500 + 'moron"'  # a quotation of any length
    assert tox.features(long, hits)[1:] == (1, 1)
    assert tox.features('has "plain\nmoron plain"', hits)[1:] == (1, 0)  # it ends with its line


def test_kinds_that_training_never_showed(spark):
    """Trained on exact open hits only: misspelled ones still count, quoted ones hardly."""
    rows = corpus()
    r = random.Random(5)
    plain = " ".join(r.choice(["lumo", "tesna", "orim", "alsu"]) for _ in range(20))
    planted = {2000: f"{plain} grumpfollk zwibel", 2001: f'{plain} he cited "grumpfolk" there {plain}', 2002: f"{plain} grumpfolk zwibbel", 2003: plain, 2004: f"(grumpf0lk), {plain} kratzzen you", None: f"{plain} grumpfolk zwibbel"}
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + list(planted.items()) + [(2005, "grumpfolk " * 100_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1)], "doc_id bigint, toxic int")
    model = tox.train(docs, labels)
    exact, told, fuzzy, both, *_ = model["weights"]
    assert exact > 0 and abs(fuzzy - tox.FUZZY * exact) < 1e-9 and abs(told - tox.QUOTED * exact) < 1e-9 and abs(both - tox.FUZZY * tox.QUOTED * exact) < 1e-9
    got = {x.doc_id: x for x in tox.score(docs, model).withColumn("held", tox.held_out("doc_id")).collect()}
    assert {i: got[i].predicted for i in planted} == {2000: 1, 2001: 0, 2002: 1, 2003: 0, 2004: 1, None: 1}
    assert got[None].held is False and got[2005].n_hits == 100_000 and got[2001].n_quoted == 1


def test_automaton_is_bounded_and_ties_are_settled(monkeypatch):
    monkeypatch.setattr(tox.Automaton, "FULL", 50)
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(3, 12)))
    terms = [(t, False, 1.0, tox.edits_allowed(t)) for t in sorted({word() for _ in range(20)})]
    small, big = tox.Automaton(terms), tox.Automaton(terms)
    big.FULL = 10**9
    for _ in range(3000):
        w = word()
        assert small.match(w) == big.match(w)
        assert len(small.states) <= 50 + len(w) + 1
    tie = tox.Automaton([("abcde", False, 1.0, 1), ("abcdf", False, 2.0, 1)])
    assert tie.match("abcdx") == (2.0, 1, "abcdf")  # equally near: the heavier


def test_fit_takes_one_row_of_a_repeated_id(spark):
    """A labelled id may have any number of rows: the driver gets one."""
    from tallyframe.llm.common import first_rows

    docs = spark.createDataFrame([(1, f"text {i}", 1) for i in range(3000)] + [(2, "other", 0)] * 5, "id bigint, t string, y int")
    got = first_rows(docs, ["id", "y"], "t").collect()
    assert sorted(r.id for r in got) == [1, 2]
    assert sorted(r.t for r in got) == sorted(r.t for r in first_rows(docs.repartition(7), ["id", "y"], "t").collect())
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    many = spark.createDataFrame([(i % 40, ("you vile scumbag " if i % 2 else "a calm day ") + f"w{i}") for i in range(4000)], "doc_id bigint, text string")
    assert tox.train(many, labels, fit_docs=10) == tox.train(many.repartition(3), labels, fit_docs=10)
