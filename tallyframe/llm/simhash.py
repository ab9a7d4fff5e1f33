"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are dealt to blocks so that any two within ``distance`` bits meet in
one (``distance + spare`` bands of bits, keyed by the choices of ``spare`` bands that
must be equal; ``spare`` grows with the number of fingerprints). In a block they
are sorted by the rank of their bits in the reflected Gray code. Runs of ``FAN``
neighbours form a node that holds the bits all of them share, runs of nodes a
node above; a child keeps only the shared bits its ancestors don't have. A search
adds up differences on the way down and drops a whole group once they exceed the
distance, or once the group is known to be in the searcher's own component. So a
block returns a forest, not all pairs: no link between components is lost and a
group of many near copies costs about as much as its size.

Fingerprints are first made distinct, so exact copies cost one; joins by fingerprint and by component look up hot ones where their rows are. Keys with more
rows than a few partitions should hold are split into chunks that meet pairwise.

Results for odd input: a null or empty text has fingerprint zero and is linked
like any other; repeated rows and repeated ids give a row each; rows without an id have no say in which id is the smallest, and a component of
such rows only has none; ids are integers; an empty table
gives an empty one; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, join_known, split_by_ids, table, version, written
from .components import roots

SEED, SHINGLE, DISTANCE = 42, 4, 4
#: Children of an index node, queries searched at once, and (query, node) pairs held at once.
FAN, QUERIES, HELD = 16, 512, 1 << 19
#: Distinct fingerprints from which two bands must be equal, and from which three.
SPARE = ((50_000_000, 2), (20_000_000_000, 3))

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: each is 1 if it is set in over half of the hashes of the word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    by_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    set_in = (by_byte @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * set_in > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """``id``, ``fp`` (the fingerprint as a signed bigint), and ``key`` (the string column of that name) if given."""
    more = [F.col(key).alias("key")] if key else []

    def rows(b: dict) -> dict:
        fp = [fingerprint(t) for t in b["t"]]
        return b | {"id": b["i"], "fp": [x - (1 << 64) if x >> 63 else x for x in fp]}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), *more), "id bigint, fp bigint" + ", key string" * len(more), rows)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray code."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over distinct codes sorted by Gray rank; ``levels[0]`` is above the codes."""

    def __init__(self, codes: np.ndarray, fan: int = FAN):
        self.codes, self.fan = codes, fan
        ones = zeros = codes
        shared = []
        while len(ones) > 1:
            at = np.arange(0, len(ones), fan)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(zeros, at)
            shared.append((ones, ~(ones ^ zeros)))
        self.levels = []  # pattern, and the mask of bits that the parent doesn't share
        for k, (pattern, mask) in enumerate(shared):
            above = shared[k + 1][1] if k + 1 < len(shared) else np.zeros(1, dtype=np.uint64)
            self.levels.append((pattern, mask & ~np.repeat(above, fan)[: len(mask)]))
        #: The bits that a code doesn't share with its parent.
        self.rest = ~np.repeat(shared[0][1], fan)[: len(codes)] if shared else np.full(len(codes), ~np.uint64(0))

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each level, the label that all codes of a node have, or -1."""
        found, low, high = [], labels, labels
        while len(low) > 1:
            at = np.arange(0, len(low), self.fan)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            found.append(np.where(low == high, low, -1))
        return found

    def search(self, queries: np.ndarray, distance: int, labels: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions of codes: each query position with every later code within
        ``distance``, except in groups that ``labels`` put in the query's own component."""
        if not self.levels:
            return
        same = self.uniform(labels) if labels is not None else None
        top = len(self.levels) - 1
        todo = [(top, queries, np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.uint8))]
        while todo:
            level, q, node, far = todo.pop()
            if len(q) > HELD // self.fan:
                half = len(q) // 2
                todo += [(level, q[:half], node[:half], far[:half]), (level, q[half:], node[half:], far[half:])]
                continue
            if level == top:
                pattern, mask = self.levels[top]
                far = far + np.bitwise_count((self.codes[q] ^ pattern[node]) & mask[node])
            below = self.levels[level - 1] if level else (self.codes, self.rest)
            child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
            q, far = np.repeat(q, self.fan), np.repeat(far, self.fan)
            keep = (child < len(below[0])) & ((child + 1) * self.fan**level > q + 1)  # only later codes
            q, child, far = q[keep], child[keep], far[keep]
            far = far + np.bitwise_count((self.codes[q] ^ below[0][child]) & below[1][child])
            keep = far <= distance
            if same is not None:
                keep &= (same[level - 1] if level else labels)[child] != labels[q]
            q, child, far = q[keep], child[keep], far[keep]
            if level == 0:
                yield q, child
            elif len(q):
                todo.append((level - 1, q, child, far))


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the components of each ``a[i]`` and ``b[i]`` become one (the smaller label stays)."""
    left, right = labels[a], labels[b]
    pairs = np.unique(np.stack([np.maximum(left, right), np.minimum(left, right)], 1)[left != right], axis=0)
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            if up[x] in up:
                up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in pairs.tolist():
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    if not up:
        return labels
    new = np.arange(len(labels))
    for x in list(up):
        new[x] = root(x)
    return new[labels]


def block_labels(codes: np.ndarray, distance: int) -> np.ndarray:
    """For distinct codes in Gray order: the smallest position in each one's component."""
    labels = np.arange(len(codes))
    near = np.flatnonzero(np.bitwise_count(codes[1:] ^ codes[:-1]) <= distance)
    labels = _joined(labels, near, near + 1)
    index = GrayIndex(codes)
    for start in range(0, len(codes), QUERIES):
        found = [(a, b) for a, b in index.search(np.arange(start, min(start + QUERIES, len(codes))), distance, labels) if len(a)]
        if found:
            labels = _joined(labels, np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
    return labels


def _spread(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """The bits of each fingerprint in the order of their numbers in ``order``, highest first."""
    out = np.zeros(len(fps), dtype=np.uint64)
    for bit in order:
        out = (out << np.uint64(1)) | ((fps >> np.uint64(bit)) & np.uint64(1))
    return out


def _bands(bands: int) -> list[list[int]]:
    edges = [64 * k // bands for k in range(bands + 1)]
    return [list(range(b - 1, a - 1, -1)) for a, b in zip(edges, edges[1:], strict=False)]


def _choices(distance: int, spare: int) -> list[tuple[int, ...]]:
    return list(combinations(range(distance + spare), spare))


def _key(fp, bands: list[list[int]], chosen: tuple[int, ...]):
    key = F.lit(0).cast("long")
    for b in chosen:
        bits = bands[b]
        key = F.shiftleft(key, len(bits)).bitwiseOR(F.shiftrightunsigned(fp, bits[-1]).bitwiseAND(F.lit((1 << len(bits)) - 1)))
    return key


def block_links(batches: list[pa.RecordBatch], distance: int, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a forest over the rows (choice, key, lo, hi, fp) of whole blocks."""
    whole = pa.Table.from_batches(batches)
    column = lambda name: whole[name].combine_chunks().to_numpy(zero_copy_only=False)
    choice, key, lo, hi = column("choice"), column("key"), column("lo"), column("hi")
    fps = column("fp").astype(np.int64).view(np.uint64)
    bands = _bands(distance + spare)
    a_out, b_out = [], []
    for c, chosen in enumerate(_choices(distance, spare)):
        rows = np.flatnonzero(choice == c)
        if len(rows) < 2:
            continue
        first = [bit for b in chosen for bit in bands[b]]
        codes = _spread(fps[rows], first + [bit for b in range(distance + spare) if b not in chosen for bit in bands[b]])
        by = np.lexsort((gray_rank(codes), hi[rows], lo[rows], key[rows]))
        rows, codes = rows[by], codes[by]
        new = np.flatnonzero((np.diff(key[rows]) != 0) | (np.diff(lo[rows]) != 0) | (np.diff(hi[rows]) != 0)) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(rows)]])
        small = ends - starts <= FAN  # fits one node: its codes are compared as they are
        block = np.repeat(np.where(small, np.arange(len(starts)), -1), ends - starts)
        for step in range(1, FAN):
            near = np.flatnonzero((block[step:] == block[:-step]) & (block[step:] >= 0))
            near = near[np.bitwise_count(codes[near] ^ codes[near + step]) <= distance]
            a_out.append(fps[rows[near]])
            b_out.append(fps[rows[near + step]])
        for s, e in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
            labels = block_labels(codes[s:e], distance)
            moved = np.flatnonzero(labels != np.arange(e - s))
            a_out.append(fps[rows[s + moved]])
            b_out.append(fps[rows[s + labels[moved]]])
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a_out).view(np.int64), np.concatenate(b_out).view(np.int64)) if a_out else (none.view(np.int64), none.view(np.int64))


def links(distinct: DataFrame, n: int, distance: int = DISTANCE, most: int | None = None) -> DataFrame:
    """``a``, ``b``: links that connect exactly the ``n`` distinct ``fp`` that any chain of
    pairs within ``distance`` bits connects. ``most``: rows of a key before it is split
    (default: twice what a partition holds on average, 4096 at least)."""
    spark = distinct.sparkSession
    spare = max([1, *(s for least, s in SPARE if n >= least)])
    choices, bands = _choices(distance, spare), _bands(distance + spare)
    keyed = distinct.select("fp", F.posexplode(F.array(*(_key(F.col("fp"), bands, c) for c in choices))).alias("choice", "key"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * len(choices) // 200_000)
    most = most or max(4096, 2 * n * len(choices) // parts)
    hot = written(keyed.groupBy("choice", "key").count().where(F.col("count") > most).select("choice", "key", F.ceil(F.col("count") / most).cast("int").alias("chunks")), "hotkeys")
    if count := hot.count():
        keyed = keyed.join(F.broadcast(hot) if count <= 100_000 else hot, ["choice", "key"], "left")
        chunk = F.expr("cast(pmod(xxhash64(fp, 'chunk'), coalesce(chunks, 1)) as int)")
        keyed = keyed.select("fp", "choice", "key", chunk.alias("own"), F.explode(F.expr("sequence(0, coalesce(chunks, 1) - 1)")).alias("other"))
        keyed = keyed.select("choice", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    else:
        keyed = keyed.select("choice", "key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            a, b = block_links(held, distance, spare)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return keyed.repartition(parts, "choice", "key", "lo", "hi").mapInArrow(run, "a bigint, b bigint")


def members(fps: DataFrame, distance: int, first: F.Column) -> DataFrame:
    """A written table of ``fp`` (each once), ``n`` (its rows) and ``least``: the smallest ``first`` of its component's rows."""
    distinct = written(fps.groupBy("fp").agg(F.min(first).alias("least"), F.count("*").alias("n")), "distinct")
    up = roots(links(distinct.select("fp"), distinct.count(), distance))
    member = written(distinct.join(up.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "members")
    of_root = written(member.groupBy("root").agg(F.min("least").alias("of_component"), F.count("*").alias("rows")), "components")
    return written(join_known(member, of_root, "root", "rows").select("fp", "n", F.col("of_component").alias("least")), "least")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest id that
    links reach) for every row."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    of_fp = members(fps, distance, F.col("id"))
    return join_known(fps, of_fp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the smallest id, null ids last, and of equal ids that of the
    smallest key of its text. Rows that share an id (or have none) but are no near-duplicates all stay. Only
    rows that may go meet the list of those that do. Column names beginning with ``__`` are reserved."""
    keyed = docs.withColumn("__simhash_key", version(F.col(id_col).cast("long"), F.col(text_col)))
    fps = written(fingerprints(keyed, id_col, text_col, "__simhash_key"), "fingerprints")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    found = join_known(fps, members(fps, distance, first), "fp").select(F.col("key").alias("__simhash_id"), (F.col("key") == F.col("least.key")).alias("keep"))
    doubtful = found.groupBy("__simhash_id").agg(F.count("*").alias("__simhash_n"), F.bool_or("keep").alias("__simhash_keep"))
    doubtful = written(doubtful.where("__simhash_n > 1 OR NOT __simhash_keep"), "doubtful")
    some, unique = split_by_ids(keyed, "__simhash_key", doubtful.select("__simhash_id"))
    # rows of one key are equal but for other columns: tasks drop all but one before they are shuffled or joined
    kept = some.dropDuplicates(["__simhash_key"]).join(doubtful, F.col("__simhash_key") == F.col("__simhash_id"), "left").where(F.coalesce("__simhash_keep", F.lit(True)))
    return kept.select(*docs.columns).unionByName(unique.select(*docs.columns))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's fingerprint and near-duplicate component."""
    return near_duplicates(table(spark, sf_dir, "documents"))
