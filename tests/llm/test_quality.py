import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import quality


def brute_base(text):
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = text.split("\n")
    dup = sum(bool(x.strip(" \t\n\x0b\x0c\r")) and x in lines[:i] for i, x in enumerate(lines))
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(hit), "base_failed": len(words) < 20 or 100 * len(hit) > 30 * len(words)}


@pytest.mark.parametrize("seed", range(60))
def test_base_against_brute_force(seed):
    r = random.Random(seed)
    part = [r.choice(["a", "b", "é", "x#*", "c|", "\x85", "\xa0w", "dd"]) for _ in range(r.randint(1, 30))]
    text = "".join(r.choice(part + [" ", " ", "\n", "\t", " " + " ".join(part) + "\n"]) for _ in range(r.randint(0, 80)))
    assert quality.base(text) == brute_base(text)


def sequence_score(scores, labels, move):
    return sum(e for e, y in zip(scores, labels, strict=True) if y) + sum(move[a][b] for a, b in itertools.pairwise(labels))


def test_chain_against_brute_force():
    r = random.Random(1)
    n = len(quality.FEATURES)
    for _ in range(30):
        rows = [1 + sum(1 << k for k in r.sample(range(1, n), 3)) for _ in range(r.randint(1, 6))]
        emit = [r.gauss(0, 1) for _ in range(n)]
        move = [[r.gauss(0, 1), r.gauss(0, 1)], [r.gauss(0, 1), r.gauss(0, 1)]]
        scores = [sum(w for k, w in enumerate(emit) if has >> k & 1) for has in rows]
        table = quality.Emissions(emit)
        assert [table[has] for has in rows] == pytest.approx(scores)
        every = {y: sequence_score(scores, y, move) for y in itertools.product((0, 1), repeat=len(rows))}
        assert tuple(quality.viterbi(scores, move)) == max(every, key=every.get)
        total = np.logaddexp.reduce(list(every.values()))
        inside = np.array([[True] * len(rows) + [False] * 2])
        got, one, pair = quality.chain_sums(np.array([scores + [0.0, 0.0]]), inside, np.array(move))
        p = {y: np.exp(v - total) for y, v in every.items()}
        assert got[0] == pytest.approx(total)
        assert one[0] == pytest.approx([sum(q for y, q in p.items() if y[t]) for t in range(len(rows))] + [0, 0])
        want = np.zeros((2, 2))
        for y, q in p.items():
            for a, b in itertools.pairwise(y):
                want[a, b] += q
        assert pair[0] == pytest.approx(want)
        # both kinds of labels, and the gradients
        has = np.array([rows + [0, 0]])
        content = every[(1,) * len(rows)] - total
        for good, value in ((True, content), (False, np.log1p(-np.exp(content)))):
            given = lambda e, m: quality.likelihood(has, inside, np.array([good]), np.array([2.0]), e, m)  # noqa: B023, E731
            found, by_emit, by_move = given(np.array(emit), np.array(move))
            assert found == pytest.approx(2 * value)
            step = np.zeros(n)
            step[0] = 1e-5
            assert (given(np.array(emit) + step, np.array(move))[0] - given(np.array(emit) - step, np.array(move))[0]) / 2e-5 == pytest.approx(by_emit[0], abs=1e-4)
            for a, b in itertools.product((0, 1), repeat=2):
                step = np.zeros((2, 2))
                step[a, b] = 1e-5
                assert (given(np.array(emit), np.array(move) + step)[0] - given(np.array(emit), np.array(move) - step)[0]) / 2e-5 == pytest.approx(by_move[a, b], abs=1e-4)


def texts(r):
    word = lambda: "".join(r.choice("aeilnorst") for _ in range(r.randint(2, 9)))
    good = lambda n: [" ".join(word() for _ in range(18)) + "." for _ in range(n)]
    bad = lambda n: [" | ".join(word() for _ in range(9)) + " |" for _ in range(n)]
    return good, bad


def test_lines_of_mixed_texts():
    """Fitted on labels of whole texts only, half of the bad ones with clean lines around the junk."""
    r = random.Random(4)
    good, bad = texts(r)
    rows, labels = [], []
    for i in range(300):
        lines = good(r.randint(1, 8)) if i % 4 else bad(r.randint(3, 8)) if i % 8 else good(1) + bad(r.randint(3, 8)) + good(1)
        rows.append(quality.line_features("\n".join(lines))[0])
        labels.append(int(i % 4 > 0))
    model = quality.fit(rows, labels)
    for n, m in ((4, 4), (6, 2), (2, 6), (5, 1), (1, 5)):
        for first, second, planted in ((good(n), bad(m), [1] * n + [0] * m), (bad(n), good(m), [0] * n + [1] * m)):
            found, share = quality.content("\n".join(first + second), model)
            assert found == planted and 0 < share < 1
    # the verdict is the share's: mostly content stays though a text like it is labelled bad
    assert quality.content("\n".join(good(7) + bad(1)), model)[1] > quality.CONTENT_SHARE > quality.content("\n".join(good(1) + bad(7)), model)[1]
    assert quality.content("\n".join(good(2000) + bad(3)), model)[0] == [1] * 2000 + [0] * 3


def test_frame(spark):
    r = random.Random(3)
    good, bad = texts(r)
    rows = [(i, "\n".join(good(r.randint(2, 8)) if i % 3 else bad(r.randint(2, 8))), "c") for i in range(120)]
    mixed = "\n".join(good(5) + bad(2))
    docs = spark.createDataFrame(rows + [(500, None, "c"), (501, "", "c"), (0, rows[0][1], "c"), (None, mixed, "c"), (None, rows[0][1], "c"), (502, mixed * 3000, "c")], "doc_id bigint, text string, kept string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(100)] + [(None, 0), (502, None)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    rated = quality.rate(docs, model)
    out = rated.collect()
    got = {x.doc_id: x for x in out if x.doc_id is not None}
    assert len(out) == 126
    assert all(got[i].kept == (i % 3 > 0) for i in range(120))
    found = quality.evaluate(rated, labels).first()
    assert found.good == found.good_kept > 5 and found.bad == found.bad_dropped > 5
    assert sorted((x.kept, x.n_content_lines) for x in out if x.doc_id is None) == [(False, 0), (True, 5)]
    assert not got[500].kept and got[500].base_failed and got[501].n_words == 0 and got[502].n_lines == 18001
    assert {k: getattr(got[7], k) for k in brute_base("")} == brute_base(rows[7][1])
    # labels of the held-out third and rows of more lines than fitted make no difference
    changed = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.train(docs, changed) == model
    neutral = quality.train(docs, labels.limit(0))
    assert {x.kept for x in quality.rate(docs.where("doc_id = 1"), neutral).collect()} == {True}
    assert quality.rate(docs.limit(0), neutral).collect() == []
