"""Byte-level BPE encoding and decoding.

Each match of the splitting pattern is merged on its own. A segment tree over
its byte positions keeps the smallest ``rank * n + position`` of any live pair,
so the root is the leftmost pair of minimum rank; a merge changes three leaves
(the merged pair, the pair before it and the dead right neighbour), each in a
logarithmic number of steps. A match of n bytes thus costs O(n log n), also one
of a hundred thousand bytes without a space. The matches of a batch that are new
to a worker and at most ``TOGETHER`` bytes long are merged together: one row of
numpy arrays holds one match's tree, and a step merges one pair in every row.

Results for odd input: null and empty texts have no tokens (and the digest of
the empty string); repeated rows give repeated results; an empty table gives an
empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, remembered, table

#: Merged matches that a worker remembers; longer matches are merged each time.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 48
#: Bytes of a match up to which new matches are merged together, and how many at a time.
TOGETHER, ROWS = 64, 4_096
#: Characters of the texts that are split at once.
SPLIT_CHARS = 600_000
#: The key of no pair.
NONE = 1 << 62


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 1:
        raise ValueError(f"no token for byte {piece!r}")
    none = NONE
    size = 1 << (n - 1).bit_length()
    tree = [none] * (2 * size)
    part = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            least = value if value < other else other
            if tree[k] == least:
                return
            tree[k] = value = least

    while tree[1] != none:
        i = tree[1] % n
        j = after[i]
        part[i] += part[j]
        part[j] = b""
        follow = after[i] = after[j]
        put(j, none)
        r = None
        if follow < n:
            before[follow] = i
            r = get(part[i] + part[follow])
        put(i, none if r is None else r * n + i)
        if (p := before[i]) >= 0:
            r = get(part[p] + part[i])
            put(p, none if r is None else r * n + p)
    return [ranks[p] for p in part if p]


class Pairs:
    """Ranks of pairs of token ids, for arrays of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = max(ranks.values()) + 1
        keys, values = array("q"), array("q")
        for t, r in ranks.items():
            for i in range(1, len(t)):
                left, right = ranks.get(t[:i]), ranks.get(t[i:])
                if left is not None and right is not None:
                    keys.append(left * self.n + right)
                    values.append(r)
        by = np.argsort(np.frombuffer(keys, dtype=np.int64))
        self.keys, self.ranks = (np.frombuffer(x, dtype=np.int64)[by] for x in (keys, values))

    def leaf(self, left: np.ndarray, right: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
        """``rank * size + at`` of each pair, ``NONE`` where there is none (an id is below 0)."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = np.where((left >= 0) & (right >= 0), left * self.n + right, -1)
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i] * size + at, NONE)


def merge_together(pieces: list[bytes], pairs: Pairs, byte_ids: np.ndarray, size: int) -> list[bytes]:
    """Token ids (4 bytes each) of matches of at most ``size`` (a power of 2) bytes."""
    m = len(pieces)
    part = np.full((m, size + 1), -1, dtype=np.int64)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=m)
    inside = np.arange(size + 1) < lengths[:, None]
    part[inside] = byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    after = np.tile(np.arange(1, size + 2), (m, 1))
    before = np.tile(np.arange(-1, size), (m, 1))
    tree = np.full((m, 2 * size), NONE, dtype=np.int64)
    at = np.broadcast_to(np.arange(size), (m, size))
    tree[:, size:] = pairs.leaf(part[:, :-1].ravel(), part[:, 1:].ravel(), size, at.ravel()).reshape(m, size)
    k = size
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    row = np.flatnonzero(tree[:, 1] != NONE)
    while len(row):
        rank, i = np.divmod(tree[row, 1], size)
        j = after[row, i]
        follow = np.minimum(after[row, j], size)
        part[row, i] = rank
        part[row, j] = -1
        after[row, i] = follow
        before[row, follow] = i
        p = before[row, i]
        tree[row, size + j] = NONE
        tree[row, size + i] = pairs.leaf(rank, part[row, follow], size, i)
        held = p >= 0
        tree[row[held], size + p[held]] = pairs.leaf(part[row[held], p[held]], rank[held], size, p[held])
        for leaf in (j, i, np.maximum(p, 0)):
            k = (size + leaf) >> 1
            while k[0] >= 1:
                tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])
                k = k >> 1
        row = row[tree[row, 1] != NONE]
    live = part >= 0
    flat, ends = part[live].astype(np.int32).tobytes(), (4 * np.cumsum(live.sum(1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class _Pieces(dict):
    """Match to token ids, 4 bytes each; forgets everything when full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = packed(merge(piece.encode(), self.ranks))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self.ranks)
        self.pairs = Pairs(self.ranks)
        self.decimal = list(map(str, range(self.pairs.n)))
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)

    def learn(self, pieces: set[str]) -> None:
        """Merge the matches that aren't remembered, together."""
        if len(self.pieces) + len(pieces) > CACHE_ENTRIES:
            self.pieces.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            if len(piece) <= CACHE_CHARS and piece not in self.pieces:
                raw = piece.encode()
                if raw in self.ranks:
                    self.pieces[piece] = packed([self.ranks[raw]])
                elif len(raw) <= TOGETHER:
                    by_size.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for size, group in by_size.items():
            for a in range(0, len(group), ROWS):
                some = group[a : a + ROWS]
                self.pieces.update(zip([x for x, _ in some], merge_together([x for _, x in some], self.pairs, self.byte_ids, size), strict=True))

    def encode(self, text: str) -> list[int]:
        return self.ids(self.split(text)).tolist()

    def ids(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, words)), dtype=np.int32)

    def encode_all(self, texts: list[str], chars: int = SPLIT_CHARS) -> Iterator[np.ndarray]:
        """Token ids of each text in turn; texts are split ahead until they have ``chars`` characters."""
        for some in in_blocks(texts, chars):
            split = [self.split(t) for t in some]
            self.learn(set(chain.from_iterable(split)))
            for words in split:
                yield self.ids(words)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def in_blocks(texts: list[str], chars: int):
    """Runs of texts that have about ``chars`` characters together."""
    block, held = [], 0
    for t in texts:
        block.append(t)
        held += len(t) + 1
        if held >= chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def codec_of(data: bytes, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary."""
    return remembered(("bpe", hash(data), pattern), lambda: Codec(data, pattern))


def vocabulary(spark: SparkSession, path: str | None = None):
    """The rank file's bytes (under 1 MB, whatever the corpus) for all executors."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _pattern(pattern: str | None) -> str:
    import public_tokenizers

    return pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col``, ``n_bytes`` and ``token_ids`` (array<int>) of each row's whole text."""
    data, pat = vocabulary(docs.sparkSession, path), _pattern(pattern)

    def rows(b: dict) -> dict:
        codec = codec_of(data.value, pat)
        texts = [t or "" for t in b["t"]]
        return {id_col: b["i"], "n_bytes": [len(t.encode()) for t in texts], "token_ids": list(codec.encode_all(texts))}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), f"`{id_col}` {kind}, n_bytes bigint, token_ids array<int>", rows)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col`` and ``decoded`` (binary) of rows of token ids (null: empty)."""
    data, pat = vocabulary(tokens.sparkSession, path), _pattern(pattern)

    def rows(b: dict) -> dict:
        codec = codec_of(data.value, pat)
        return {id_col: b["i"], "decoded": [codec.decode(ids or []) for ids in b["t"]]}

    kind = tokens.schema[id_col].dataType.simpleString()
    return arrow_map(tokens.select(F.col(id_col).alias("i"), F.col(ids_col).alias("t")), f"`{id_col}` {kind}, decoded binary", rows)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode, decode the ids, and return digests of both: ``n_tokens``, ``ids_sha256``,
    ``decoded_sha256`` and ``lossless`` (the decoded bytes are the text's)."""
    data, pat = vocabulary(docs.sparkSession, path), _pattern(pattern)

    def rows(b: dict) -> dict:
        codec = codec_of(data.value, pat)
        out: dict = {id_col: b["i"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "lossless": []}
        for text, ids in zip(b["t"], codec.encode_all([t or "" for t in b["t"]]), strict=True):
            back = codec.decode(ids.tolist())
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(" ".join(map(codec.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            out["lossless"].append(back == (text or "").encode())
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, lossless boolean", rows)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's whole text, encoded and decoded."""
    return round_trip(table(spark, sf_dir, "documents"))
