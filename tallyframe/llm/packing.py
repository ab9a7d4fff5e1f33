"""Packing documents into training sequences of balanced attention cost.

A document is its token ids and an end id. Attention is within documents, so a piece of n ids costs
``LINEAR * n + QUADRATIC * n * n``. Each partition packs its own documents, a block of about ``BLOCK`` ids at a
time, so nothing is shuffled and a task holds one block:

* a document is cut into pieces of at most ``size`` ids; whole ones are sequences of their own, nothing fits beside them;
* the rests of a block have T ids together. They go into T div ``size`` sequences, and one for each binary digit of
  T mod ``size``: a sequence whose length is a power of two needs no padding, so there is none anywhere;
* rests are dealt in descending order, each to the sequence of lowest cost that still has room for all of it. If none has, the
  rest is cut: its head fills the sequence that has most room, its tail is dealt on. Room and rests have the same sum, so all ends filled.

Results for odd input: null and empty texts are documents of one id (the end id); texts of any length are cut as above; a row is a
document, so repeated ids and rows are packed each; ties are dealt in the order of the rows; an empty table gives an empty one;
other columns are neither read nor returned. Sequence ids begin with the partition's number, so they are the same whenever the table's
partitions are (files or a written table), also when a lost executor's task runs again; shuffled input should be written first.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SPLIT_CHARS, in_blocks
from .common import arrow_schema, remembered, slices, table
from .words import Memo

SIZE, END = 2048, 1
#: Cost of a piece of n ids: a linear part and one for attention within the piece (of a model whose width is about SIZE * 6).
LINEAR, QUADRATIC = 1.0, 1.0 / (6 * SIZE)
#: Ids that are packed together, about: 8 MB and 1,024 sequences.
BLOCK = 1 << 21


def cost_of(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Estimated cost of a piece of ``n`` ids."""
    return linear * n + quadratic * n * n


def deal(lengths: list[int], size: int = SIZE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[list[tuple[int, int, int, int]]], list[float]]:
    """For each rest the pieces ``(start, length, sequence, offset)`` it is cut into (mostly one), and each sequence's cost."""
    total = sum(lengths)
    rooms = [size] * (total // size) + [1 << b for b in range(size.bit_length()) if total % size >> b & 1]
    room, cost, used = np.array(rooms, dtype=np.int64), np.zeros(len(rooms)), [0] * len(rooms)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    waiting = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapify(waiting)
    while waiting:
        n, i, start = heappop(waiting)
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        k = int(fits.argmin())
        put = n
        if fits[k] == np.inf:
            k = int(room.argmax())
            put = int(room[k])
            heappush(waiting, (put - n, i, start + put))
        out[i].append((start, put, k, used[k]))
        used[k] += put
        room[k] -= put
        cost[k] += cost_of(put, linear, quadratic)
    return out, cost.tolist()


#: A part that is one word of letters whose normal form and lower case are single letters, and a mark that no contraction begins with: two tokenizer words.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
#: Words that are remembered at once: a word and its ids take about 200 bytes.
WORDS = 1_000_000
#: Words of one library call.
TOGETHER = 500


class Encoder:
    """Ids of texts by a lower-casing word-end BPE that drops white space, so parts between spaces are encoded each on its own."""

    def __init__(self, data: bytes, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.special = [x.content.encode().lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)  # ids that end a word
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        self.end = np.array([end], dtype="<u4").tobytes()
        self.memo = Memo(self.make, WORDS)
        self.marks = dict(zip(".,;:!?", self.alone(list(".,;:!?")), strict=True)) | {"": b""}

    def alone(self, new: list[str]) -> list[bytes]:
        """Ids of parts of any kind."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    def joined(self, words: list[str]) -> dict[str, bytes]:
        """Ids of plain words: many in one text, cut where a word ends."""
        out: dict[str, bytes] = {}
        for a in range(0, len(words), TOGETHER):
            some = words[a : a + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            flat, after = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(after) == len(some):
                out.update(zip(some, [flat[x:y] for x, y in zip([0, *after], after, strict=False)], strict=True))
            else:  # a tokenizer of another kind
                out.update(zip(some, self.alone(some), strict=True))
        return out

    def make(self, new: list[str]) -> list[bytes]:
        plain = [_PLAIN.fullmatch(x) for x in new]
        stems = [m and m[1].lower() for m in plain]
        words = self.joined(list(set(stems) - {None}))
        others = iter(self.alone([x for x, m in zip(new, plain, strict=True) if not m]))
        return [words[stem] + self.marks[m[2]] if m else next(others) for stem, m in zip(stems, plain, strict=True)]

    def lowered(self, text: str) -> str:
        """``text`` with A-Z in lower case, so that a word is remembered once; as it is where combining marks are, some of which make one character
        with a small letter only, or where it would hold a special token."""
        data = text.encode()
        low = data.lower()
        return text if b"\xcc" in data or b"\xcd" in data or any(x in low for x in self.special) else low.decode()

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids (4 bytes each, the last is the end id) of each text in turn."""
        for some in in_blocks(texts, SPLIT_CHARS):
            split = [self.lowered(t).replace("\n", " ").split(" ") for t in some]
            ids = self.memo.all(list(chain.from_iterable(split)))
            at = 0
            for n in map(len, split):
                yield b"".join([*ids[at : at + n], self.end])
                at += n


class _Block:
    """Documents until they are packed."""

    def __init__(self, size: int, linear: float, quadratic: float):
        self.size, self.cost = size, (linear, quadratic)
        self.held: list[tuple[object, bytes]] = []
        self.ids = 0

    def add(self, id_, ids: bytes) -> None:
        self.held.append((id_, ids))
        self.ids += len(ids) // 4

    def packed(self, first: int) -> tuple[dict[str, list], int]:
        """Columns of all pieces, and the first sequence number that is free."""
        size, out = self.size, {k: [] for k in ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost", "sequence_cost", "ids")}

        def piece(id_, ids: bytes, start: int, n: int, sequence: int, offset: int, whole: float) -> None:
            own = ids[4 * start : 4 * (start + n)]
            for k, v in zip(out, (id_, start, n, crc32(own), len(ids) // 4, sequence, offset, cost_of(n, *self.cost), whole, own), strict=True):
                out[k].append(v)

        rests, full = [len(ids) // 4 % size for _, ids in self.held], cost_of(size, *self.cost)
        dealt, costs = deal(rests, size, *self.cost)
        after = first + len(costs)
        for (id_, ids), rest, pieces in zip(self.held, rests, dealt, strict=True):
            head = len(ids) // 4 - rest
            for start in range(0, head, size):
                piece(id_, ids, start, size, after, 0, full)
                after += 1
            for start, n, k, offset in pieces:
                piece(id_, ids, head + start, n, first + k, offset, costs[k])
        self.held, self.ids = [], 0
        return out, after


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SIZE, end: int = END, linear: float = LINEAR, quadratic: float = QUADRATIC, block: int = BLOCK, with_ids: bool = True) -> DataFrame:
    """A row for each piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``cost``, ``sequence_cost`` and,
    ``with_ids``, the piece's ``ids`` (array<int>). A sequence is its pieces by ``offset``."""
    import public_tokenizers

    if size < 1 or block < 1:
        raise ValueError("size and block are at least 1")
    with open(path or public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the corpus
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, cost double, sequence_cost double" + (", ids array<int>" if with_ids else "")

    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(("pack", hash(data.value), end), lambda: Encoder(data.value, end))
        free, held = TaskContext.get().partitionId() << 40, _Block(size, linear, quadratic)

        def flush() -> pa.RecordBatch:
            nonlocal free
            columns, free = held.packed(free)
            if with_ids:
                columns["ids"] = [np.frombuffer(b, dtype="<u4").astype(np.int32) for b in columns["ids"]]
            return pa.RecordBatch.from_arrays([pa.array(columns["id" if i == 0 else f.name], f.type) for i, f in enumerate(arrow)], schema=arrow)

        for batch in batches:
            for some in slices(batch):
                for id_, ids in zip(some.column(0).to_pylist(), encoder.encode_all([t or "" for t in some.column(1).to_pylist()]), strict=True):
                    held.add(id_, ids)
                    if held.ids >= block:
                        yield flush()
        if held.held:
            yield flush()

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's pieces and their places in sequences."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
