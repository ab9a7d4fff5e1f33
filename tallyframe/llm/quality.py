"""Quality rules by line labelling: a linear-chain conditional random field.

Counting rules come first (too few words, too many repeated). Every line of a whole
text then has features of its form, a chain over two labels (content, boilerplate)
gives each sequence a score, and Viterbi decoding finds the best one. A document is
kept if its content lines hold at least ``CONTENT_SHARE`` of its words.

Labels are of documents, not of lines, so the lines of a bad document are hidden: a good
document's lines are all content, a bad one's are not all content, and which ones are boilerplate
is summed over. Both likelihoods come from the same sums over the chain, P(all content)
and 1 - P(all content); a bad document whose own boilerplate lines already explain it teaches
nothing about its other lines. So the clean lines of a bad document keep the label that
lines like them have elsewhere. A third of the labelled rows is held out of the fit and ``evaluate`` counts on it.

Results for odd input: null and empty texts have no words, fail the base rules and are not
kept; rows without an id are rated like any other and never fitted; repeated rows get equal results; of equally good
label sequences the one with content at the later lines is taken; without labelled rows of both labels the field is neutral and keeps
what passes the base rules; an empty table gives an empty one; other columns are neither read
nor returned.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, first_rows, held_out, table

#: The base rules' least words, most percent of repeated words, window, and symbols.
LEAST_WORDS, MOST_REPEATED, WINDOW, SYMBOLS = 20, 30, 8, "#*$%&|<>"
#: Share of words in content lines from which a document is kept.
CONTENT_SHARE = 0.5
#: The bound of the fitted sample: labelled rows, lines of one text (of which only the features' bits come to the driver).
FIT_DOCS, FIT_LINES = 2_000, 512
#: Ascent: steps at most, and the change a document below which it stops; shrinkage of the line weights and of the moves. Good documents have
#: one move only, so moves are held back: a line's own form comes first.
STEPS, GAIN, RIDGE, MOVE_RIDGE = 200, 1e-5, 0.5, 5.0

FEATURES = (
    "any", "empty", "one word", "2-4 words", "5-11 words", "12+ words", "symbols > 2%", "symbols > 8%", "shouted > half", "digits > 20%",
    "ends as a sentence", "distinct < half", "distinct < fifth", "copy of earlier", "exclamations > 2%", "bars", "long words", "first", "last",
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside any window of ``WINDOW`` words that the text has more than once."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    window = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        window = window * np.uint64(0x9E3779B97F4A7C15) + (hashes[k : k + n] ^ (hashes[k : k + n] >> np.uint64(31)))
    ordered = np.sort(window)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # equal windows have equal hashes
    numbers: dict[bytes, int] = {}
    rank = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    width = 1
    while width < WINDOW:  # exact: a rank stands for one sequence of 2, 4, 8 words
        rank = np.unique(rank[:-width] * (len(words) + 1) + rank[width:], return_inverse=True)[1].astype(np.int64)
        width *= 2
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def base(text: str) -> dict:
    words = text.encode().split()  # exactly the bytes x20 and x09 to x0D separate
    seen, copies = set(), 0
    for line in text.split("\n"):
        if line in seen:
            copies += bool(line.encode().split())
        seen.add(line)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    repeats = repeated_words(words)
    return {
        "n_words": len(words), "word_chars": len(text) - spaces, "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": copies, "n_repeat_words": repeats,
        "base_failed": len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED * len(words),
    }


def line_features(text: str) -> tuple[list[int], list[int]]:
    """For each line the set of its features, as bits, and its words."""
    lines = text.split("\n")
    rows, counts, seen = [], [], set()
    for i, line in enumerate(lines):
        words, has = line.split(), 1
        n, size = len(words), len(line)
        if n == 0:
            has |= 1 << 1
        else:
            has |= 1 << (2 if n == 1 else 3 if n < 5 else 4 if n < 12 else 5)
            symbols = sum(map(line.count, SYMBOLS))
            if symbols > 0.02 * size:
                has |= 1 << 6
            if symbols > 0.08 * size:
                has |= 1 << 7
            if 2 * sum(map(str.isupper, words)) > n:
                has |= 1 << 8
            if sum(map(line.count, "0123456789")) > 0.2 * size:
                has |= 1 << 9
            if words[-1][-1] in ".!?:;…\"”»":
                has |= 1 << 10
            distinct = len(set(words))
            if n >= 8 and 2 * distinct < n:
                has |= 1 << 11
            if n >= 8 and 5 * distinct < n:
                has |= 1 << 12
            if line in seen:
                has |= 1 << 13
            if line.count("!") > 0.02 * size:
                has |= 1 << 14
            if "|" in line:
                has |= 1 << 15
            if size > 14 * n:
                has |= 1 << 16
        seen.add(line)
        if i == 0:
            has |= 1 << 17
        if i == len(lines) - 1:
            has |= 1 << 18
        rows.append(has)
        counts.append(n)
    return rows, counts


def bits(has: np.ndarray) -> np.ndarray:
    """Rows of ones where a feature is."""
    return (has[:, None] >> np.arange(len(FEATURES)) & 1).astype(np.float64)


def chain_sums(score: np.ndarray, inside: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents by lines, where ``score`` is label 1's against 0 and ``inside`` tells lines from padding: the log of the sum over all
    label sequences, each line's probability of label 1, and the expected moves between labels."""
    docs, most = score.shape
    top = np.maximum(score, 0)
    here = np.stack([np.exp(-top), np.exp(score - top)], 2)
    step = np.exp(move)
    ahead, back, scale = np.empty((docs, most, 2)), np.ones((docs, most, 2)), np.zeros(docs)
    ahead[:, 0] = here[:, 0]
    for t in range(most):
        if t:
            ahead[:, t] = np.where(inside[:, t, None], ahead[:, t - 1] @ step * here[:, t], ahead[:, t - 1])
        size = ahead[:, t].sum(1)
        ahead[:, t] /= size[:, None]
        scale += np.log(size)
    for t in range(most - 2, -1, -1):
        new = (back[:, t + 1] * here[:, t + 1]) @ step.T
        back[:, t] = np.where(inside[:, t + 1, None], new / new.sum(1, keepdims=True), 1.0)
    both = ahead * back
    one = both[:, :, 1] / both.sum(2) * inside
    pair = ahead[:, :-1, :, None] * step * (back[:, 1:] * here[:, 1:])[:, :, None, :]
    pair = pair / pair.sum((2, 3), keepdims=True) * inside[:, 1:, None, None]
    return scale + (top * inside).sum(1), one, pair.sum(1)


def likelihood(has: np.ndarray, inside: np.ndarray, good: np.ndarray, times: np.ndarray, emit: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of document labels and its gradients: of a good one that all its lines are content, of a bad one that they aren't."""
    kinds, place = np.unique(has, return_inverse=True)
    x, place = bits(kinds), place.reshape(has.shape)
    score = np.where(inside, (x @ emit)[place], 0.0)
    total, one, pair = chain_sums(score, inside, move)
    n = inside.sum(1)
    every = np.minimum(score.sum(1) + (n - 1) * move[1, 1] - total, -1e-9)  # log P(all content)
    value = np.where(good, every, np.log(-np.expm1(every)))
    weight = times * np.where(good, 1.0, -1 / np.expm1(-every))
    off = np.bincount(place.ravel(), ((inside - one) * weight[:, None]).ravel(), len(kinds))
    moves = -pair
    moves[:, 1, 1] += n - 1
    return float((times * value).sum()), off @ x, (weight[:, None, None] * moves).sum(0)


def fit(rows: list[list[int]], good: list[int], steps: int = STEPS) -> dict:
    """Weights of label 1 (content) and the moves between labels, from the feature bits of documents' lines. Equal documents are worked on once,
    and documents of about as many lines together."""
    if len(set(good)) < 2:
        return {"emit": [0.0] * len(FEATURES), "move": [[0.0, 0.0], [0.0, 0.0]]}
    times = Counter((tuple(r), y) for r, y in zip(rows, good, strict=True))
    groups: dict[int, list] = {}
    for key in sorted(times):
        groups.setdefault(len(key[0]).bit_length(), []).append(key)
    batches = []
    for keys in groups.values():
        most = max(len(r) for r, _ in keys)
        has = np.zeros((len(keys), most), dtype=np.int64)
        for d, (r, _) in enumerate(keys):
            has[d, : len(r)] = r
        batches.append((has, has > 0, np.array([y > 0 for _, y in keys]), np.array([times[k] for k in keys], dtype=float)))
    k, last, flat = len(FEATURES), -np.inf, 0
    w, speed, size = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    ridge = np.array([RIDGE] * k + [MOVE_RIDGE] * 4)
    for step in range(1, steps + 1):
        found = [likelihood(*b, w[:k], w[k:].reshape(2, 2)) for b in batches]
        value = sum(v for v, _, _ in found) - 0.5 * float(ridge @ (w * w))
        flat = flat + 1 if abs(value - last) < GAIN * len(good) else 0
        if flat == 3:
            break
        last = value
        g = np.concatenate([sum(e for _, e, _ in found), sum(m for _, _, m in found).ravel()]) - ridge * w
        speed += 0.1 * (g - speed)
        size += 0.01 * (g * g - size)
        w += 0.15 * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-9)
    return {"emit": w[:k].tolist(), "move": w[k:].reshape(2, 2).tolist()}


def viterbi(scores: list[float], move: list[list[float]]) -> list[int]:
    """The labels of best score, where ``scores`` are label 1's of the lines; of equal ones content."""
    (m00, m01), (m10, m11) = move
    zero, one, came = 0.0, scores[0], []
    for e in scores[1:]:
        from0, from1 = (zero + m00, one + m10), (zero + m01, one + m11)
        came.append((from0[1] >= from0[0], from1[1] >= from1[0]))
        zero, one = max(from0), max(from1) + e
    labels = [int(one >= zero)]
    for step in reversed(came):
        labels.append(int(step[labels[-1]]))
    return labels[::-1]


class Emissions(dict):
    """Feature bits of a line to its score; there are few different ones."""

    def __init__(self, emit: list[float]):
        super().__init__()
        self.emit = emit

    def __missing__(self, has: int) -> float:
        self[has] = found = sum(w for k, w in enumerate(self.emit) if has >> k & 1)
        return found


def content(text: str, model: dict, scores: Emissions | None = None) -> tuple[list[int], float]:
    """Labels of the lines (1: content) and the content lines' share of the words."""
    rows, counts = line_features(text)
    scores = Emissions(model["emit"]) if scores is None else scores
    labels = viterbi([scores[has] for has in rows], model["move"])
    total = sum(counts)
    return labels, sum(n for n, y in zip(counts, labels, strict=True) if y) / total if total else 0.0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_docs: int = FIT_DOCS, fit_lines: int = FIT_LINES) -> dict:
    """Fit on at most ``fit_docs`` labelled rows outside the held-out third (chosen by a hash of the id, half of each label as far as there are; of rows that share an id the one whose text has the smallest hash), of
    at most ``fit_lines`` lines. The features are found where the texts are; the driver gets a number for each line."""
    rated = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) > 0).cast("int").alias("y"))
    rows = []
    for y in (0, 1):
        chosen = rated.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(fit_docs // 2)
        rows += chosen.collect()  # bounded by fit_docs
    ids = docs.sparkSession.createDataFrame(rows, "id " + docs.schema[id_col].dataType.simpleString() + ", y int")
    texts = first_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t") != "").join(F.broadcast(ids), "id"), ["id", "y"], "t").select("y", "t")
    lines = arrow_map(texts, "y int, has array<int>", lambda b: {"y": b["y"], "has": [line_features(t)[0] for t in b["t"]]}).where(F.size("has") <= fit_lines)
    found = sorted((r.y, r.has) for r in lines.collect())
    return fit([has for _, has in found], [y for y, _ in found])


def rate(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, ``base_failed``, ``content_share``, ``n_lines``, ``n_content_lines`` and ``kept`` of every row."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_lines", "n_content_lines")

    def rows(b: dict) -> dict:
        out: dict = {k: [] for k in names} | {id_col: b["i"]}
        scores = Emissions(model["emit"])
        for text in b["t"]:
            found = base(text or "")
            lines, share = content(text or "", model, scores)
            found |= {"content_share": share, "n_lines": len(lines), "n_content_lines": sum(lines), "kept": not found["base_failed"] and share >= CONTENT_SHARE}
            for k in names:
                out[k].append(found[k])
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double, n_lines bigint, n_content_lines bigint"
    return arrow_map(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), schema, rows)


def evaluate(rated: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One row about the labelled rows that the fit doesn't use: ``good``, ``good_kept``, ``bad``, ``bad_dropped``, and how many have lines of both labels (``mixed``)."""
    known = labels.where(F.col(label_col).isNotNull() & held_out(id_col)).groupBy(id_col).agg((F.min(label_col) > 0).alias("__good"))
    g, k = F.col("__good"), F.col("kept")
    return rated.join(known, id_col).agg(
        F.count_if(g).alias("good"), F.count_if(g & k).alias("good_kept"), F.count_if(~g).alias("bad"), F.count_if(~g & ~k).alias("bad_dropped"),
        F.count_if((F.col("n_content_lines") > 0) & (F.col("n_content_lines") < F.col("n_lines"))).alias("mixed"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's base counts and the field's verdict."""
    docs = table(spark, sf_dir, "documents")
    return rate(docs, train(docs, table(spark, sf_dir, "labels")))
