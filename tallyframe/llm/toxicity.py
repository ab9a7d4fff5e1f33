"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

A lexicon of words and word stems is learned from labelled training rows. Its
trie is walked together with the Levenshtein automata of the terms: a state is a
set of (trie node, edits so far), made deterministic on demand, so a word costs
one table step per character and most words die after three. Every hit
gets a score from its window: other hits nearby and being addressed to somebody
raise it, standing in quotation marks (of one line, of any length) or after a reporting word puts it into a
separate sum. A logistic model, fitted on the same training rows, weighs the sums
of exact, misspelled, open and quoted hits; only open hits make a text dense. Misspelled and quoted hits
start from the weight of exact open ones, discounted by ``FUZZY`` and ``QUOTED``, from which training rows that have such hits
move them: a kind that training never showed still counts.

Results for odd input: null and empty texts have no hits and get the model's
score for that; rows without an id are scored, not held out and never fitted; repeated rows get equal scores; of equally good
terms of a word the heavier counts, then the one with fewer edits; without usable training rows
the lexicon is empty and every score is the model's floor; an empty table gives
an empty one; other columns are neither read nor returned unless ``keep`` asks.
Repeated labels of one id count as toxic if any is.
"""

from __future__ import annotations

import functools
import math
import re
import sys
from collections import Counter
from collections.abc import Callable, Collection, Iterable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, first_rows, held_out, remembered, table, written
from .simhash import fingerprint

#: Training rows at most, and the characters of the longest text among them: the bound of the fitted sample.
FIT_DOCS, FIT_CHARS = 8_000, 20_000
#: Terms at most, least documents of a term, least likelihood ratio, and clean documents of a term by its toxic ones.
TERMS, LEAST_DOCS, LEAST_G2, CLEAN_SHARE = 500, 2, 18.0, 0.05
#: Bits up to which two fingerprints of training rows with one label are copies.
COPIES = 10
#: Distinct words of a stem that count in one document.
STEM_WORDS = 3
#: Lengths of stems; words around a hit; score from which a document is predicted toxic.
STEMS, WINDOW, THRESHOLD = (4, 5, 6, 7, 8), 8, 0.7

#: Weight of a misspelled and of a quoted hit, as a part of an exact open one's, before training rows tell more.
FUZZY, QUOTED = 0.8, 0.1

#: Words that report speech, and words that address somebody.
REPORTING = frozenset("said says say called calls call calling quote quotes quoted wrote writes word words term slur insult shouted dit disait appelé mot sagte sagt nannte wort dijo dice llamó palabra".split())
ADDRESS = frozenset("you your youre u ur du dich dein ihr sie tu te toi vous votre usted tú ti vosotros".split())
#: Quotation marks and what closes them.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "'": "'’", "‘": "’", "‚": "‘’"}

_WORDS = re.compile(r"[^\W_]+").findall


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Deterministic on demand; terms are ``(text, is_stem, weight, edits allowed)``. Words of ``ordinary``
    are no misspellings."""

    #: States from which it begins anew before the next word.
    FULL = 50_000

    def __init__(self, terms: list[tuple[str, bool, float, int]], ordinary=()):
        self.ordinary = frozenset(ordinary)
        self.children: list[dict[str, int]] = [{}]
        self.budget = [-1]
        self.word: dict[int, tuple[float, int, str]] = {}
        self.stem: dict[int, tuple[float, int, str]] = {}
        for text, is_stem, weight, allowed in terms:
            node = 0
            self.budget[0] = max(self.budget[0], allowed)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(-1)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], allowed)
            (self.stem if is_stem else self.word)[node] = (weight, allowed, text)
        self.reset()

    def reset(self) -> None:
        self.states: dict[frozenset, dict] = {}
        self.start = self._state({(0, 0)})

    def _closed(self, items: set[tuple[int, int]]) -> frozenset:
        """With characters of the term left out, and without items that a cheaper one covers."""
        todo, least = sorted(items, key=lambda x: -x[1]), {}
        while todo:
            node, e = todo.pop()
            if e > self.budget[node] or least.get(node, 99) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(least.items())

    def _state(self, items: set[tuple[int, int]]) -> dict | None:
        key = self._closed(items)
        if not key:
            return None
        if key not in self.states:
            ends = [(e, -self.word[n][0], self.word[n]) for n, e in key if n in self.word and e <= self.word[n][1]]
            stems = [self.stem[n] for n, e in key if n in self.stem and e == 0]
            best = min(ends, default=None)
            self.states[key] = {"items": key, "end": (best[2][0], best[0], best[2][2]) if best else None, "stem": max(stems, default=None)}
        return self.states[key]

    def _step(self, state: dict, c: str) -> dict | None:
        items = set()
        for node, e in state["items"]:
            items.add((node, e + 1))  # c is too much
            for label, child in self.children[node].items():
                items.add((child, e if label == c else e + 1))
        state[c] = new = self._state(items)
        return new

    def match(self, word: str) -> tuple[float, int, str] | None:
        """``(weight, edits, term)`` of the best whole term, else of the longest stem, else None."""
        if len(self.states) >= self.FULL:
            self.reset()
        state, stem = self.start, None
        if state is None:
            return None
        for c in word:
            state = state[c] if c in state else self._step(state, c)
            if state is None:
                return stem
            if state["stem"]:
                stem = (state["stem"][0], 0, state["stem"][2])
        end = state["end"]
        return stem if end is None or (end[1] and word in self.ordinary) else end


class Hits(dict):
    """A token between white space to its best hit, or None; forgets everything when full."""

    FULL = 100_000

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, token: str):
        found = None
        for word in _WORDS(token):
            hit = self.automaton.match(word)
            if hit and (found is None or hit[0] > found[0]):
                found = hit
        if len(token) <= 40:
            if len(self) >= self.FULL:
                self.clear()
            self[token] = found
        return found


def quoted_places(lines: list[list[str]]) -> set[int]:
    """Numbers of the tokens inside quotation marks that open and close in one line."""
    inside: set[int] = set()
    at = 0
    for tokens in lines:
        opened, closing = None, ""
        for i, token in enumerate(tokens, at):
            if opened is None and token[0] in QUOTES:
                opened, closing = i, QUOTES[token[0]]
            if opened is not None and token.rstrip(".,;:!?")[-1:] in closing and (i > opened or len(token.rstrip(".,;:!?")) > 1) and token.rstrip(".,;:!?"):
                inside.update(range(opened, i + 1))
                opened = None
        at += len(tokens)
    return inside


def features(text: str, hits: Hits) -> tuple[list[float], int, int]:
    """Four sums (exact open, exact quoted, misspelled open, misspelled quoted), the best open score and the open hits' density; the
    number of hits and of quoted ones."""
    low = text.lower()
    tokens = low.split()
    found = [(i, h) for i, h in enumerate(map(hits.__getitem__, tokens)) if h]
    if not found:
        return [0.0] * 6, 0, 0
    inside = quoted_places([line.split() for line in low.split("\n")])
    sums, quoted, best = [0.0] * 4, 0, 0.0
    at = [i for i, _ in found]
    first = last = 0
    for k, (i, (weight, edits, _)) in enumerate(found):
        while at[first] < i - WINDOW:
            first += 1
        last = max(last, k)
        while last + 1 < len(at) and at[last + 1] <= i + WINDOW:
            last += 1
        around = {w.strip(".,;:!?\"'") for w in tokens[max(0, i - WINDOW) : i + WINDOW + 1]}
        score = weight * (1 + 0.25 * min(4, last - first)) * (1.25 if around & ADDRESS else 1.0) * 0.6**edits
        told = i in inside or bool(REPORTING & {w.strip(".,;:!?\"'") for w in tokens[max(0, i - 3) : i]})
        quoted += told
        sums[2 * (edits > 0) + told] += score
        best = best if told else max(best, score)
    return [*map(math.log1p, sums), best, math.log1p(100 * (len(found) - quoted) / len(tokens))], len(found), quoted


def distinct_words(text: str) -> frozenset[str]:
    return frozenset(_WORDS(text.lower()))


def learn_terms(texts: list[str], toxic: list[int]) -> tuple[list[tuple[str, bool, float, int]], list[str]]:
    return learn([distinct_words(t) for t in texts], toxic)


def learn(docs: Sequence[Collection[str]], toxic: list[int]) -> tuple[list[tuple[str, bool, float, int]], list[str]]:
    """Words and stems whose documents are nearly all toxic, beyond chance, and the ordinary words that would be misspellings of
    them: those whose documents are not nearly all toxic. A term has an edit less, and then none, if too many of its ordinary words
    are in one clean document only: about as many documents as these will have ordinary words that the sample doesn't show.
    ``docs`` are the distinct words of each document."""
    n_toxic = sum(toxic)
    n_clean = len(toxic) - n_toxic
    if not n_toxic or not n_clean:
        return [], []

    def units(words: Collection[str], of: Callable[[str], Iterable[tuple[str, bool]]]) -> Counter:
        """Words once, stems as often as distinct words have them, up to a limit."""
        found: Counter = Counter()
        for w in words:
            for u in of(w):
                if not u[1] or found[u] < STEM_WORDS:
                    found[u] += 1
        return found

    every = lambda w: [(w, False), *((w[:k], True) for k in STEMS if len(w) > k)] if len(w) >= 3 else []
    seen, a, b = Counter(), Counter(), Counter()
    for words, y in zip(docs, toxic, strict=True):
        if y:
            found = units(words, every)
            a.update(found)
            seen.update(found.keys())
    a = Counter({u: n for u, n in a.items() if seen[u] >= LEAST_DOCS})
    known = functools.cache(lambda w: [u for u in every(w) if u in a])
    for words, y in zip(docs, toxic, strict=True):
        if not y:
            b.update(units(words, known))
    share = n_toxic / len(toxic)
    rated = []
    for u, n in a.items():
        m = b[u]
        p = n / (n + m)
        if m <= CLEAN_SHARE * n:
            g2 = 2 * (n * math.log(p / share) + (m * math.log((1 - p) / (1 - share)) if m else 0))
            if g2 >= LEAST_G2:
                rated.append((g2, not u[1], len(u[0]), u, math.log((n + 0.5) / (n_toxic + 1)) - math.log((m + 0.5) / (n_clean + 1))))
    chosen: list[tuple[str, bool, float]] = []
    for _, _, _, (text, is_stem), weight in sorted(rated, reverse=True):
        related = any((is_stem and t.startswith(text)) or (s and text.startswith(t)) for t, s, _ in chosen)
        if not related and len(chosen) < TERMS:
            chosen.append((text, is_stem, weight))
    terms = [(t, stem, w, 0 if stem else edits_allowed(t)) for t, stem, w in chosen]
    in_clean, in_toxic = Counter(), Counter()
    for words, y in zip(docs, toxic, strict=True):
        (in_toxic if y else in_clean).update(words)
    automaton = Automaton(terms)
    clean = {w: m for w, m in in_clean.items() if (hit := automaton.match(w)) and hit[1]}
    ordinary = sorted(w for w, m in clean.items() if m > CLEAN_SHARE * in_toxic[w])
    while True:  # a term's words may be another's once it has fewer edits
        automaton, once = Automaton(terms), Counter()
        near = [(w, hit[2]) for w in ordinary if (hit := automaton.match(w)) and hit[1]]
        once.update(t for w, t in near if clean[w] == 1)
        fewer = [(t, stem, weight, allowed - (allowed > 0 and once[t] > max(1, CLEAN_SHARE * a[t, stem]))) for t, stem, weight, allowed in terms]
        if fewer == terms:
            return terms, [w for w, _ in near]
        terms = fewer


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    keep = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + keep, x1.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: How the six weights come from the fitted ones: the first is shared, those of quoted and misspelled hits are what these differ by.
SHARED = np.eye(6)
SHARED[:4, 0] = 1, QUOTED, FUZZY, QUOTED * FUZZY


def weigh(x: np.ndarray, toxic: np.ndarray) -> list[float]:
    """Weights of the six features and the intercept."""
    w = fit_logistic(x @ SHARED, toxic)
    return [*(SHARED @ w[:-1]).tolist(), float(w[-1])]


def without_copies(fps: np.ndarray, toxic: np.ndarray) -> list[int]:
    """Positions of the rows that are no near copies of an earlier one of their label."""
    kept, n = np.empty(len(fps), dtype=np.int64), 0
    for i in range(len(fps)):
        before = kept[:n]
        if not ((np.bitwise_count(fps[before] ^ fps[i]) <= COPIES) & (toxic[before] == toxic[i])).any():
            kept[n] = i
            n += 1
    return kept[:n].tolist()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> dict:
    """Fit on at most ``fit_docs`` labelled rows outside the held-out third, of at most ``fit_chars`` characters,
    chosen by a hash of the id; of rows that share an id the one whose text has the smallest hash. Near copies of one label count once. Texts stay on the executors; the driver gets their distinct words and,
    once terms are known, six numbers each."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id", F.lit("fit")), "id").limit(fit_docs)
    ids = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # bounded by fit_docs
    texts = first_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.length("t") <= fit_chars).join(F.broadcast(ids), "id"), ["id", "y"], "t")
    kind = docs.schema[id_col].dataType.simpleString()

    def summary(b: dict) -> dict:
        return b | {"fp": [fingerprint(t) - (1 << 63) for t in b["t"]], "words": [" ".join(sorted(distinct_words(t))) for t in b["t"]]}

    held = written(arrow_map(texts.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "y", "t"), f"row bigint, id {kind}, y int, t string, fp bigint, words string", summary), "fit")
    rows = sorted((r.id, r.y, r.fp, r.words, r.row) for r in held.drop("t").toLocalIterator())
    toxic = np.array([y for _, y, *_ in rows], dtype=np.int64)
    kept = without_copies(np.array([fp for _, _, fp, *_ in rows], dtype=np.int64).view(np.uint64), toxic)
    words, toxic = [tuple(map(sys.intern, rows[i][3].split())) for i in kept], toxic[kept]  # a word is one object, however many texts have it
    terms, ordinary = learn(words, toxic.tolist())
    if not terms:
        return {"terms": [], "ordinary": [], "weights": [0.0] * 6 + [-3.0]}
    # The weights are fitted on sums that each half of the rows gets from the other half's terms: a term that only
    # chance has made look toxic counts as little there as it will in new texts.
    other = [learn(words[1 - half :: 2], toxic[1 - half :: 2].tolist()) for half in (0, 1)]
    place = {rows[i][4]: k for k, i in enumerate(kept)}

    def sums(b: dict) -> dict:
        hits = remembered(("toxicity halves", tuple(map(str, other))), lambda: [Hits(Automaton(*x)) for x in other])
        at = [place.get(row, -1) for row in b["row"]]
        return {"k": at, "x": [features(t, hits[k % 2])[0] if k >= 0 else [] for k, t in zip(at, b["t"], strict=True)]}

    x = np.zeros((len(kept), 6))
    spread = held.select("row", "t").repartition(held.sparkSession.sparkContext.defaultParallelism)
    for r in arrow_map(spread, "k int, x array<double>", sums).where("k >= 0").collect():
        x[r.k] = r.x
    return {"terms": terms, "ordinary": ordinary, "weights": weigh(x, toxic.astype(float))}


def hits_of(terms: list[tuple[str, bool, float, int]], ordinary: list[str]) -> Hits:
    """One table of hits for each worker process, while the terms are the same."""
    return remembered(("toxicity", tuple(terms), tuple(ordinary)), lambda: Hits(Automaton(terms, ordinary)))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``id_col``, ``score``, ``predicted``, ``n_hits``, ``n_quoted``; with ``keep`` also all columns of ``docs``
    whose names differ from these."""
    weights = np.array(model["weights"])

    def rows(b: dict) -> dict:
        hits = hits_of(model["terms"], model["ordinary"])
        found = [features(t or "", hits) for t in b[text_col if keep else "__text"]]
        p = 1 / (1 + np.exp(-np.clip(np.array([x for x, _, _ in found]) @ weights[:-1] + weights[-1], -30, 30)))
        return b | {"score": p.tolist(), "predicted": (p >= THRESHOLD).astype(int).tolist(), "n_hits": [n for _, n, _ in found], "n_quoted": [q for _, _, q in found]}

    own = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_hits", T.IntegerType()), T.StructField("n_quoted", T.IntegerType())]
    if keep:
        given = docs.drop(*(f.name for f in own))
    else:
        given = docs.select(id_col, F.col(text_col).alias("__text"))
    carried = [f for f in given.schema if keep or f.name != "__text"]
    return arrow_map(given, T.StructType([*carried, *own]), rows)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's toxicity, learned from labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_hits", "n_quoted")
