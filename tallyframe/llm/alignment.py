"""Alignment of two tokenizers' tokens over the bytes of each text.

Both encode space + text, so both cut the same bytes. The union of their end offsets (``union1d``) makes elementary intervals; the token of a side
that covers an interval is the first whose end isn't before the interval's (``searchsorted``). So each interval is one overlap of
a token of A and one of B (counted), and an offset where both end closes a group. Two kinds of links come from it:

* ``end``: pairs that end together, one at each shared offset; these are counted over the corpus;
* ``group``: all pairs of a group, expanded in ``products``.

Texts are cut at spaces where neither tokenizer has a token that goes on (checked: A is byte-level with its own splitting rule and without a normaliser, no piece of B has a
space after another character; else a text is one part). So a part's ends are shared, and what is found for a part is remembered by a worker.

Counts over the corpus: of two tokens that end together the shorter one's bytes are the end of the other's. The vocabularies alone
say which pairs can do that (under a million); so their counts are one array of a proven bound, added up in each task, summed by Spark and sent to all executors.

Results for odd input: null and empty texts, and texts whose tokens' bytes aren't the text (U+2581 in a text, unknown tokens) have no tokens: zeros and an empty digest;
long texts are whole; repeated ids and rows count and are returned each; ties of a count are all best; an empty table gives an empty one; other columns are
neither read nor returned.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import SPLIT_CHARS, in_blocks
from .common import arrow_map, arrow_schema, remembered, slices, table, written
from .words import Memo, parts

#: Parts that are aligned together.
TOGETHER = 2_000
#: In a part's packed counts (tokens of A and of B): the bytes of a side aren't the part's.
BAD = 1 << 80
LINKS = ("end", "group")
#: Parts that begin and end with a character that no definition of white space has.
_EDGES = re.compile(r"[!-~\w](?:.*[!-~\w])?\Z", re.DOTALL)


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each elementary interval: its token of A, its token of B, and whether it closes a group (both end with it)."""
    ends = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, (ends_a[a] == ends) & (ends_b[b] == ends)


def products(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of all groups, group by group: every token of A with every token of B. Sizes are the groups' numbers of tokens."""
    n = a_sizes * b_sizes
    group = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = np.divmod(within, b_sizes[group])
    return (np.cumsum(a_sizes) - a_sizes)[group] + i, (np.cumsum(b_sizes) - b_sizes)[group] + j


def byte_alphabet() -> dict[str, int]:
    """Byte-level characters to bytes: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def _joined(ids: list[list[int]], of: list[bytes]) -> bytes:
    return b"".join(map(of.__getitem__, chain.from_iterable(ids)))


class Aligner:
    """Two tokenizers, the bytes of their tokens, and what is known of parts."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a.decode()), SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        rule = json.loads(a)
        before = rule.get("pre_tokenizer") or {}
        self.cut = not rule.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.keys = self._pairs()
        # how ids look in a group's text: followed by the next of their side, or by what follows the side
        self.text_a = np.array([x for i in range(len(self.bytes_a)) for x in (f"{i},", f"{i}|")], dtype=object)
        self.text_b = np.array([x for i in range(len(self.bytes_b)) for x in (f"{i},", f"{i};")], dtype=object)
        self.memo = Memo(self.make)

    def _pairs(self) -> np.ndarray:
        """Sorted ``b * vocabulary of A + a`` of all pairs of which one's bytes are the end of the other's."""
        n, found = len(self.bytes_a), []
        for mine, others, key in ((self.bytes_a, self.bytes_b, lambda i, j: j * n + i), (self.bytes_b, self.bytes_a, lambda i, j: i * n + j)):
            by: dict[bytes, list[int]] = {}
            for j, x in enumerate(others):
                by.setdefault(x, []).append(j)
            found += [key(i, j) for i, x in enumerate(mine) for k in range(len(x)) for j in by.get(x[k:], ())]
        return np.unique(np.array(found, dtype=np.int64))

    def split(self, text: str) -> list[str]:
        return parts(text) if self.cut else [text]

    def tokens(self, some: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A of space + part, and of B of part (which adds the space), of each."""
        of_b = self.b.encode(some, num_threads=1)
        if not self.cut:
            return [e.ids for e in self.a.encode_batch_fast([" " + x for x in some], add_special_tokens=False)], of_b
        # a text of parts with plain edges has just their tokens: one call, cut where a part's bytes end
        together = [x for x in some if _EDGES.match(x)]
        ids = np.array(self.a.encode_batch_fast([" " + " ".join(together)], add_special_tokens=False)[0].ids if together else [], dtype=np.int64)
        upto = np.searchsorted(np.cumsum(self.sizes_a[ids]), np.cumsum([len(x.encode()) + 1 for x in together])) + 1
        flat = ids.tolist()
        known = iter([flat[i:j] for i, j in zip([0, *upto.tolist()], upto.tolist(), strict=False)])
        alone = iter(self.a.encode_batch_fast([" " + x for x in some if not _EDGES.match(x)], add_special_tokens=False))
        return [next(known) if _EDGES.match(x) else next(alone).ids for x in some], of_b

    def make(self, new: list[str]) -> Iterator[tuple[str, bytes, int, int]]:
        """Of each part: the text of its groups, the places of its links in ``keys`` (4 bytes each), tokens of A and of B in one number, overlaps and pairs of groups in one."""
        for k in range(0, len(new), TOGETHER):
            some = new[k : k + TOGETHER]
            yield from self._aligned(some, *self.tokens(some))

    def _aligned(self, some: list[str], of_a: list[list[int]], of_b: list[list[int]]) -> list[tuple[str, bytes, int, int]]:
        out: list = [("", b"", BAD, 0)] * len(some)
        good = list(range(len(some)))
        if not _joined(of_a, self.bytes_a) == " ".join(["", *some]).encode() == _joined(of_b, self.bytes_b):
            good = [i for i, x in enumerate(some) if _joined([of_a[i]], self.bytes_a) == (" " + x).encode() == _joined([of_b[i]], self.bytes_b)]
            of_a, of_b = ([of[i] for i in good] for of in (of_a, of_b))
        if not good:
            return out
        counts_a, counts_b = list(map(len, of_a)), list(map(len, of_b))
        a, b = (np.fromiter(chain.from_iterable(of), dtype=np.int64, count=sum(n)) for of, n in ((of_a, counts_a), (of_b, counts_b)))
        first, second, closes = intervals(np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b]))
        end_a, end_b = first[closes], second[closes]  # the last token of each group
        places = np.searchsorted(self.keys, b[end_b] * len(self.bytes_a) + a[end_a]).astype("<u4").tobytes()
        sizes_a, sizes_b = np.diff(end_a, prepend=-1), np.diff(end_b, prepend=-1)
        # texts of groups: A's tokens, then B's, group by group
        group_a, group_b = np.repeat(np.arange(len(end_a)), sizes_a), np.repeat(np.arange(len(end_b)), sizes_b)
        last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        last_a[end_a] = last_b[end_b] = 1
        table = np.empty(len(a) + len(b), dtype=object)
        table[np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]] = self.text_a[2 * a + last_a]
        table[np.arange(len(b)) + np.cumsum(sizes_a)[group_b]] = self.text_b[2 * b + last_b]
        text = table.tolist()
        upto_overlap, upto_product = np.cumsum(np.ones(len(closes), dtype=np.int64))[closes], np.cumsum(sizes_a * sizes_b)
        t = g = 0
        overlap = product = 0
        ends_a, ends_b = np.cumsum(counts_a).tolist(), np.cumsum(counts_b).tolist()
        groups = (np.searchsorted(end_a, np.array(ends_a) - 1) + 1).tolist()
        for k, i in enumerate(good):
            u, h = ends_a[k] + ends_b[k], groups[k]
            o, p = int(upto_overlap[h - 1]), int(upto_product[h - 1])
            out[i] = ("".join(text[t:u]), places[4 * g : 4 * h], counts_a[k] << 32 | counts_b[k], (o - overlap) << 40 | (p - product))
            t, g, overlap, product = u, h, o, p
        return out

    def align_all(self, texts: list[str | None]) -> Iterator[tuple[str, bytes, int, int, int, int]]:
        """Of each text: groups, links, tokens of A, tokens of B, overlaps, pairs of groups; all empty where there are no tokens."""
        nothing = ("", b"", 0, 0, 0, 0)
        for some in in_blocks([t or "" for t in texts], SPLIT_CHARS):
            split = [self.split(t) if t else [] for t in some]
            self.memo.learn(split)
            for words in split:
                found = list(map(self.memo.__getitem__, words))
                n, m = sum(map(itemgetter(2), found)), sum(map(itemgetter(3), found))
                if not found or n >= BAD:
                    yield nothing
                else:
                    yield "".join(map(itemgetter(0), found))[:-1], b"".join(map(itemgetter(1), found)), n >> 32, n & 0xFFFFFFFF, m >> 40, m & (1 << 40) - 1


def vocabularies(spark: SparkSession, a: str | None = None, b: str | None = None):
    """The two vocabulary files (about 2 MB, whatever the corpus) for all executors."""
    import public_tokenizers

    out = []
    for path in (a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")):
        with open(path, "rb") as f:
            out.append(f.read())
    return spark.sparkContext.broadcast(tuple(out))


def aligner(files) -> Aligner:
    """One for each worker process and pair of vocabularies."""
    return remembered(("align", *map(hash, files)), lambda: Aligner(*files))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None, with_groups: bool = True) -> DataFrame:
    """A row for each text: ``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_overlaps``, ``n_products`` (pairs of groups), ``groups`` (as ``a1,a2|b1;a3|b2``, or its digest alone
    as ``groups_sha256``) and ``links`` (binary: places in the pair array of pairs that end together)."""
    files = vocabularies(docs.sparkSession, a, b)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: dict) -> dict:
        out: dict = {id_col: batch["i"], **{k: [] for k in ("n_a", "n_b", "n_groups", "n_overlaps", "n_products", "groups", "groups_sha256", "links")}}
        for groups, links, n_a, n_b, overlaps, pairs in aligner(files.value).align_all(batch["t"]):
            for k, v in zip(list(out)[1:], (n_a, n_b, len(links) // 4, overlaps, pairs, groups if with_groups else None, hashlib.sha256(groups.encode()).hexdigest() if n_a else "", links), strict=True):
                out[k].append(v)
        return out

    schema = f"`{id_col}` {kind}, n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, n_products bigint, groups string, groups_sha256 string, links binary"
    out = arrow_map(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), schema, rows)
    return out if with_groups else out.drop("groups")


def expand(aligned_: DataFrame, id_col: str = "doc_id", links: str = "end") -> DataFrame:
    """A row for each link of ``aligned(...)``: ``id_col``, ``a_pos``, ``b_pos`` (numbers of tokens in their text), ``a_id``, ``b_id``. ``links`` is one of
    ``LINKS``. Groups are expanded in blocks."""
    if links not in LINKS:
        raise ValueError(f"links is one of {LINKS}")
    kind = aligned_.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, a_pos bigint, b_pos bigint, a_id int, b_id int"

    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                for id_, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    sides = [x.split("|") for x in text.split(";")]
                    of_a, of_b = ([x[k].split(",") for x in sides] for k in (0, 1))
                    a, b = (np.array([y for x in of for y in x], dtype=np.int32) for of in (of_a, of_b))
                    n_a, n_b = (np.array(list(map(len, of)), dtype=np.int64) for of in (of_a, of_b))
                    if links == "end":
                        blocks: Iterator = iter([(np.cumsum(n_a) - 1, np.cumsum(n_b) - 1)])
                    else:
                        blocks = _product_blocks(n_a, n_b)
                    for i, j in blocks:
                        yield pa.RecordBatch.from_arrays([pa.array([id_] * len(i), arrow.field(0).type), pa.array(i), pa.array(j), pa.array(a[i]), pa.array(b[j])], schema=arrow)

    return aligned_.select(F.col(id_col).alias("i"), "groups").mapInArrow(run, schema)


#: Pairs of groups that are expanded at once.
PAIRS = 100_000


def _product_blocks(n_a: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``products`` of runs of groups; a group of more than ``PAIRS`` pairs is expanded a run of its A tokens at a time."""
    at_a, at_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    block = (np.cumsum(n_a * n_b) - 1) // PAIRS
    for run in np.split(np.arange(len(n_a)), np.flatnonzero(np.diff(block)) + 1):
        if len(run) == 1:
            g = run[0]
            step = max(1, PAIRS // int(n_b[g]))
            for k in range(0, int(n_a[g]), step):
                i, j = products(np.array([min(step, n_a[g] - k)]), n_b[run])
                yield i + at_a[g] + k, j + at_b[g]
        elif len(run):
            i, j = products(n_a[run], n_b[run])
            yield i + at_a[run[0]], j + at_b[run[0]]


def pair_counts(aligned_: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """How many links hold each pair: ``place`` (in the pair array), ``a_id``, ``b_id``, ``n``. A task adds up in one array and returns what isn't zero."""
    files = vocabularies(aligned_.sparkSession, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(files.value)
        n = np.zeros(len(known.keys), dtype=np.int64)
        for batch in batches:
            for some in slices(batch, 32 << 20):
                np.add(n, np.bincount(np.frombuffer(b"".join(some.column(0).to_pylist()), dtype="<u4"), minlength=len(n)), out=n)
        at = np.flatnonzero(n)
        if len(at):
            b_id, a_id = np.divmod(known.keys[at], len(known.bytes_a))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(a_id.astype(np.int32)), pa.array(b_id.astype(np.int32)), pa.array(n[at])], names=["place", "a_id", "b_id", "n"])

    return aligned_.select("links").mapInArrow(run, "place int, a_id int, b_id int, n bigint").groupBy("place", "a_id", "b_id").agg(F.sum("n").alias("n"))


def judged(aligned_: DataFrame, id_col: str = "doc_id", a: str | None = None, b: str | None = None) -> DataFrame:
    """``aligned_`` (a written table) without ``links`` but with ``n_links``, ``n_best`` and ``count_sum``: links counted over the whole table."""
    spark = aligned_.sparkSession
    # one row for each pair at most that the vocabularies allow: under a million, 12 bytes each
    best = F.max("n").over(Window.partitionBy("b_id"))
    found = pair_counts(aligned_, a, b).select("place", "n", (F.col("n") == best).alias("best")).toArrow()
    place, n, top = (found.column(k).to_numpy() for k in range(3))
    counts = spark.sparkContext.broadcast((place.astype(np.int32), n.astype(np.int64), top.astype(bool)))
    keep = [c for c in aligned_.columns if c != "links"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned_.schema if f.name != "links") + ", n_links bigint, n_best bigint, count_sum bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n, top = counts.value
        size = int(place.max()) + 1 if len(place) else 1
        count, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        count[place], best[place] = n, top
        for batch in batches:
            for some in slices(batch, 32 << 20):
                raw = some.column(some.schema.names.index("links")).to_pylist()
                sizes = np.array(list(map(len, raw)), dtype=np.int64) // 4
                links = np.frombuffer(b"".join(raw), dtype="<u4")
                upto = np.concatenate([[0], np.cumsum(sizes)])
                sums = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[upto]) for x in (best, count)]
                columns = [some.column(some.schema.names.index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), *map(pa.array, sums)], names=[*keep, "n_links", "n_best", "count_sum"])

    return aligned_.mapInArrow(run, schema)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's alignment. Links are the pairs that end together; overlaps and pairs of groups are counted beside them."""
    found = written(aligned(table(spark, sf_dir, "documents"), with_groups=False), "aligned")
    return judged(found).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_products")
