"""Media columns: baseline JPEG with DC-only luminance thumbnails.

A reader parses the markers, decodes the Huffman-coded scan and keeps each block's
DC coefficient, which gives the image at an eighth of its size without an inverse
transform. A scan with restart markers is decoded in step: every restart interval of
every image of a batch is a row of numpy arrays, and one step decodes one block of each.
A scan without them, or of several components, is decoded one code after the other.

A writer stores bytes losslessly in the format's own unit, the DC coefficient: byte
``b`` becomes a block whose quantised DC is ``b - 128`` at a quantiser of 8, so that each
sample of the block, and the thumbnail's sample, is exactly ``b``. Images are 64 blocks
wide with a restart interval of one block row; a comment holds the length without
padding; a payload above ``ROWS`` block rows goes on in further images of the column.

Results for odd input: null and empty texts are one row of 64 zero bytes; repeated rows
give repeated results; an empty table gives an empty one; media that is no baseline JPEG
gives nulls, the reason in ``error``; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

#: Bytes of a block row, and block rows of one image (65,535 lines of samples at most).
WIDTH, ROWS = 64, 8191
#: Payload bytes that are coded at once.
TOGETHER = 1 << 20

#: The luminance DC table of the standard's annex K (codes of each length, then categories).
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = tuple(range(12))
#: An AC table with one code, for "end of block".
AC_COUNTS = (1, *[0] * 15)
AC_VALUES = (0,)


class NotBaseline(ValueError):
    pass


def code_table(counts, values) -> list[tuple[int, int, int]]:
    """``(code, length, value)`` in the order of the standard."""
    found, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            found.append((code, length, values[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return found


def lookup(counts, values) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits: the length of the code that they begin with (0: none) and its value."""
    lengths, found = np.zeros(65536, dtype=np.int64), np.zeros(65536, dtype=np.int64)
    for code, length, value in code_table(counts, values):
        a = code << (16 - length)
        lengths[a : a + (1 << (16 - length))], found[a : a + (1 << (16 - length))] = length, value
    return lengths, found


def _codewords() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference + 255: a whole block's bits (category, difference, end of block) and their number."""
    dc = {value: (code, length) for code, length, value in code_table(DC_COUNTS, DC_VALUES)}
    bits, n = [], []
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = dc[category]
        extra = d if d >= 0 else d + (1 << category) - 1
        bits.append(((code << category) | extra) << 1)
        n.append(length + category + 1)
    return np.array(bits, dtype=np.int64), np.array(n, dtype=np.int64)


_BITS, _N = _codewords()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int, n_bytes: int) -> bytes:
    return b"".join([
        b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xFE, b"bytes=%d" % n_bytes), _segment(0xDB, b"\0" + b"\x08" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + b"\1\x11\0"), _segment(0xC4, b"\0" + bytes(DC_COUNTS) + bytes(DC_VALUES)),
        _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_VALUES)), _segment(0xDD, struct.pack(">H", WIDTH)), _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ])


def pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _coded_rows(rows: np.ndarray) -> list[bytes]:
    """Each row of 64 bytes as the stuffed bytes of one restart interval."""
    value = rows.astype(np.int64) - 128
    index = np.diff(value, axis=1, prepend=0) + 255
    bits, n = _BITS[index], _N[index]
    end = np.cumsum(n, axis=1)
    total = end[:, -1]
    width = 128  # bytes: 64 blocks of at most 15 bits, and 3 to spare
    start = end - n
    at = np.arange(len(rows))[:, None] * width + (start >> 3)
    word = bits << (24 - (start & 7) - n)
    packed = sum(np.bincount((at + k).ravel(), ((word >> (16 - 8 * k)) & 255).ravel(), len(rows) * width) for k in range(3))
    packed = packed.astype(np.uint8).reshape(len(rows), width)
    size = (total + 7) >> 3
    packed[np.arange(len(rows)), size - 1] |= ((1 << (size * 8 - total)) - 1).astype(np.uint8)  # filled up with ones
    flat = packed[np.arange(width) < size[:, None]]
    each = 1 + (flat == 255)
    out = np.zeros(each.sum(), dtype=np.uint8)
    out[np.cumsum(each) - each] = flat
    ends = np.cumsum(np.bincount(np.repeat(np.arange(len(rows)), size), each, len(rows)).astype(np.int64)).tolist()
    whole = out.tobytes()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def store_all(raws: list[bytes]) -> list[bytes]:
    """Each raw string, padded, as one or more JPEG images."""
    payload = b"".join(map(pad, raws))
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    coded: list[bytes] = []
    for a in range(0, len(rows), TOGETHER // WIDTH):
        coded += _coded_rows(rows[a : a + TOGETHER // WIDTH])
    restart = [bytes([0xFF, 0xD0 + k]) for k in range(8)]
    out, at = [], 0
    for raw in raws:
        n = max(1, -(-len(raw) // WIDTH))
        images = []
        for a in range(at, at + n, ROWS):
            own = coded[a : min(a + ROWS, at + n)]
            parts = [own[0]]
            for k, x in enumerate(own[1:]):
                parts += (restart[k % 8], x)
            images += [_header(len(own), len(raw)), *parts, b"\xff\xd9"]
        out.append(b"".join(images))
        at += n
    return out


def parse(data: bytes, at: int = 0) -> dict:
    """Markers of the image that begins at ``at``: size, components, tables, comment and where its scan lies."""
    if data[at : at + 2] != b"\xff\xd8":
        raise NotBaseline("no start of image")
    found: dict = {"quant": {}, "huff": {}, "interval": 0, "comment": b"", "frame": None}
    at += 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise NotBaseline("broken marker")
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                found["quant"][body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # the DC entry comes first
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                found["huff"][body[0]] = (bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC0:
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not height or not width:
                raise NotBaseline("samples of other than 8 bits, or no size")
            found["frame"] = (width, height, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise NotBaseline("not a baseline frame")
        elif marker == 0xDD:
            found["interval"] = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            found["comment"] = bytes(body)
        elif marker == 0xDA:
            if not found["frame"]:
                raise NotBaseline("scan before frame")
            scan = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            end = at
            while True:
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    raise NotBaseline("no end of scan")
                if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                    end += 2
                    continue
                break
            if "scan" not in found and any(i == found["frame"][2][0][0] for i, _, _ in scan):  # the luminance's, with the tables of its time
                found |= {"scan": scan, "coded": data[at:end], "huff": dict(found["huff"]), "quant": dict(found["quant"]), "interval_then": found["interval"]}
                later = {k: dict(found[k]) for k in ("huff", "quant")}
            if data[end + 1] not in (0xD8, 0xD9):  # another scan, or tables for it
                at = end
                continue
            if "scan" not in found:
                raise NotBaseline("no scan of the first component")
            found |= later | {"interval": found.pop("interval_then"), "end": end + 2 if data[end + 1] == 0xD9 else end}
            return found


def in_step(coded: list[bytes], lanes: list[int], blocks: np.ndarray, dc, ac) -> np.ndarray:
    """DC differences of many restart intervals at once: ``coded`` are scans, ``lanes`` their numbers of
    intervals, ``blocks`` each interval's number of blocks."""
    raw = np.frombuffer(b"\xff\xd0".join(coded), dtype=np.uint8)
    follow = np.append(raw[1:], 0)
    mark = np.flatnonzero((raw == 255) & (follow >= 0xD0) & (follow <= 0xD7))
    keep = np.ones(len(raw), dtype=bool)
    keep[mark] = keep[mark + 1] = False
    keep[np.flatnonzero((raw == 255) & (follow == 0)) + 1] = False
    if len(mark) + 1 != sum(lanes):
        raise NotBaseline("restart markers are missing")
    before = np.cumsum(keep) - keep
    starts = np.concatenate([[0], before[mark]]).astype(np.int64)
    data = np.concatenate([raw[keep], np.full(8, 255, dtype=np.uint8)]).astype(np.int64)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    last = len(window) - 1
    peek = lambda pos: (window[np.minimum(pos >> 3, last)] >> (16 - (pos & 7))) & 0xFFFF
    pos = starts * 8
    out = np.zeros((int(blocks.max()), len(pos)), dtype=np.int64)
    even = bool((blocks == blocks[0]).all())
    for step in range(out.shape[0]):
        lane = slice(None) if even else np.flatnonzero(blocks > step)
        p = pos[lane]
        word = peek(p)
        length, category = dc[0][word], dc[1][word]
        if not length.all():
            raise NotBaseline("no such DC code")
        p = p + length
        value = peek(p) >> (16 - category)
        out[step, lane] = np.where((value >> np.maximum(category - 1, 0)) == 0, value - (1 << category) + 1, value) * (category > 0)
        p += category
        word = peek(p)
        length, value = ac[0][word], ac[1][word]
        if not length.all():
            raise NotBaseline("no such AC code")
        p += length
        open_ = np.flatnonzero(value)
        k = np.ones(len(p), dtype=np.int64)
        while len(open_):
            v = value[open_]
            p[open_] += v & 15
            k[open_] += (v >> 4) + 1
            open_ = open_[k[open_] <= 63]
            word = peek(p[open_])
            length = ac[0][word]
            if not length.all():
                raise NotBaseline("no such AC code")
            p[open_] += length
            value[open_] = ac[1][word]
            open_ = open_[value[open_] != 0]
        pos[lane] = p
    return out.T


def one_by_one(image: dict, tables: dict) -> np.ndarray:
    """The luminance (first) component's DC coefficients, block rows by blocks, of any baseline scan."""
    width, height, components = image["frame"]
    own = {c[0]: c for c in components}
    scan = [(own[i], tables[d], tables[16 + a]) for i, d, a in image["scan"]]
    h, v = max(c[1] for c in components), max(c[2] for c in components)
    alone = len(scan) == 1
    first = components[0]
    cols, rows = -(-(-(-width * first[1] // h)) // 8), -(-(-(-height * first[2] // v)) // 8)
    across, down = (cols, rows) if alone else (-(-width // (8 * h)), -(-height // (8 * v)))
    out = np.zeros((down * (1 if alone else first[2]), across * (1 if alone else first[1])), dtype=np.int64)
    data, at, held, n_held = image["coded"], 0, 0, 0

    def fill() -> None:
        nonlocal at, held, n_held
        while n_held < 16:
            byte = 255
            if at < len(data):
                if data[at] == 255 and at + 1 < len(data) and data[at + 1]:
                    byte = 255  # a restart marker: padding until it is passed
                else:
                    byte = data[at]
                    at += 2 if byte == 255 else 1
            held, n_held = ((held << 8) | byte) & 0xFFFFFFFF, n_held + 8

    def code(table) -> int:
        nonlocal n_held
        fill()
        word = (held >> (n_held - 16)) & 0xFFFF
        if not table[0][word]:
            raise NotBaseline("no such code")
        n_held -= int(table[0][word])
        return int(table[1][word])

    def bits(n: int) -> int:
        nonlocal n_held
        fill()
        n_held -= n
        return (held >> n_held) & ((1 << n) - 1)

    before = dict.fromkeys(own, 0)
    for unit in range(across * down):
        if image["interval"] and unit and unit % image["interval"] == 0:
            at = data.index(b"\xff", at)
            while not 0xD0 <= data[at + 1] <= 0xD7:
                at = data.index(b"\xff", at + 1)
            at, held, n_held = at + 2, 0, 0
            before = dict.fromkeys(own, 0)
        for (ident, ch, cv, _), dc, ac in scan:
            for y in range(1 if alone else cv):
                for x in range(1 if alone else ch):
                    n = code(dc)
                    value = bits(n)
                    before[ident] += value if n and value >> (n - 1) else value - (1 << n) + 1 if n else 0
                    k = 1
                    while k <= 63:
                        v_ = code(ac)
                        if v_ == 0:
                            break
                        bits(v_ & 15)
                        k += (v_ >> 4) + 1
                    if ident == first[0]:
                        row, col = divmod(unit, across)
                        out[row * (1 if alone else cv) + y, col * (1 if alone else ch) + x] = before[ident]
    return out[:rows, :cols]


_tables: dict = {}


def _lookup(table: tuple[bytes, bytes]):
    if table not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        _tables[table] = lookup(*table)
    return _tables[table]


def thumbnails(medias: list[bytes | None]) -> list[tuple[list[np.ndarray], dict] | str]:
    """For each media its images' thumbnails (uint8, block rows by blocks) and the first one's markers, or what
    is wrong with it."""
    images, together, out = [], {}, []
    for k, media in enumerate(medias):
        try:
            at, own = 0, []
            while not own or (media or b"")[at : at + 2] == b"\xff\xd8":  # what follows an image's end and begins none is padding
                own.append(image := parse(media or b"", at))
                at = image["end"]
            images.append(own)
        except (NotBaseline, IndexError, struct.error, KeyError) as e:
            images.append(str(e) or "broken")
            continue
        for image in own:
            width, height, components = image["frame"]
            if len(components) == 1 and image["interval"] and len(image["scan"]) == 1:
                _, d, a = image["scan"][0]
                together.setdefault((image["huff"].get(d), image["huff"].get(16 + a)), []).append(image)

    def decoded(group: list[dict], dc, ac) -> None:
        shapes = [(-(-i["frame"][1] // 8), -(-i["frame"][0] // 8)) for i in group]
        lanes = [-(-r * c // i["interval"]) for (r, c), i in zip(shapes, group, strict=True)]
        blocks = np.concatenate([np.minimum(i["interval"], r * c - np.arange(n) * i["interval"]) for (r, c), n, i in zip(shapes, lanes, group, strict=True)])
        dcs = np.cumsum(in_step([i["coded"] for i in group], lanes, blocks, dc, ac), axis=1)
        inside = np.arange(dcs.shape[1]) < blocks[:, None]
        flat, at = dcs[inside].astype(np.int16), 0
        for (r, c), i in zip(shapes, group, strict=True):
            i["dc"] = flat[at : at + r * c].reshape(r, c)
            at += r * c

    for (dc, ac), group in together.items():
        at = 0
        while dc and ac and at < len(group):
            size, end = 0, at
            while end < len(group) and (end == at or size < TOGETHER):
                size += len(group[end]["coded"])
                end += 1
            try:
                decoded(group[at:end], _lookup(dc), _lookup(ac))
            except (NotBaseline, IndexError):  # one of them is broken: each for itself
                pass
            at = end
    for own in images:
        if isinstance(own, str):
            out.append(own)
            continue
        try:
            thumbs = []
            for image in own:
                dc = image["dc"] if "dc" in image else one_by_one(image, {k: _lookup(t) for k, t in image["huff"].items()})
                quant = image["quant"][image["frame"][2][0][3]]
                thumbs.append(np.clip((dc.astype(np.int64) * quant + 1028) >> 3, 0, 255).astype(np.uint8))
                image.pop("coded", None)
                image.pop("dc", None)
            out.append((thumbs, own[0]))
        except (NotBaseline, IndexError, KeyError, ValueError) as e:
            out.append(str(e) or "broken")
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """16 hex digits: which of 8 by 9 cell means are below their right neighbours."""
    r = np.linspace(0, thumb.shape[0], 9).astype(np.int64)
    c = np.linspace(0, thumb.shape[1], 10).astype(np.int64)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), dtype=np.int64)
    sums[1:, 1:] = np.cumsum(np.cumsum(thumb, axis=0, dtype=np.int64), axis=1)
    top, bottom = r[:-1], np.maximum(r[1:], np.minimum(r[:-1] + 1, thumb.shape[0]))
    left, right = c[:-1], np.maximum(c[1:], np.minimum(c[:-1] + 1, thumb.shape[1]))
    cells = sums[np.ix_(bottom, right)] - sums[np.ix_(top, right)] - sums[np.ix_(bottom, left)] + sums[np.ix_(top, left)]
    areas = np.outer(bottom - top, right - left)
    means = cells * 1_000_000 // np.maximum(areas, 1)
    return np.packbits(means[:, :-1] < means[:, 1:]).tobytes().hex()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``media`` (binary): each whole text's UTF-8 bytes as JPEG."""

    def rows(b: dict) -> dict:
        return {id_col: b["i"], "media": store_all([(t or "").encode() for t in b["t"]])}

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), f"`{id_col}` {kind}, media binary", rows)


def read_media(medias: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id_col``, ``width``, ``height`` (samples; of all images of the media, one below the other), ``thumbnail`` (binary,
    rows of ceil(width / 8)), ``thumbnail_hash``, ``n_bytes`` (from the comment, null without one) and ``error``."""

    def rows(b: dict) -> dict:
        out: dict = {k: [] for k in ("width", "height", "thumbnail", "thumbnail_hash", "n_bytes", "error")} | {id_col: b["i"]}
        for found in thumbnails(b["t"]):
            if not isinstance(found, str) and len({t.shape[1] for t in found[0]}) > 1:
                found = "images of several widths"
            if isinstance(found, str):
                values = [None] * 5 + [found]
            else:
                thumbs, image = found
                thumb = thumbs[0] if len(thumbs) == 1 else np.concatenate(thumbs)
                note = image["comment"].partition(b"bytes=")[2]
                values = [image["frame"][0], image["frame"][1] if len(thumbs) == 1 else 8 * len(thumb), thumb.tobytes(), thumbnail_hash(thumb), int(note) if note.isdigit() else None, None]
            for k, v in zip(("width", "height", "thumbnail", "thumbnail_hash", "n_bytes", "error"), values, strict=True):
                out[k].append(v)
        return out

    kind = medias.schema[id_col].dataType.simpleString()
    return arrow_map(medias.select(F.col(id_col).alias("i"), F.col(media_col).alias("t")), f"`{id_col}` {kind}, width int, height int, thumbnail binary, thumbnail_hash string, n_bytes bigint, error string", rows)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and return digests of both forms."""
    stored = store(docs, id_col, text_col)

    def rows(b: dict) -> dict:
        out: dict = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")} | {id_col: b["i"]}
        for media, found in zip(b["t"], thumbnails(b["t"]), strict=True):
            if isinstance(found, str):
                raise ValueError(found)
            thumbs, image = found
            payload = b"".join(t.tobytes() for t in thumbs)
            if len(payload) != max(1, -(-int(image["comment"].partition(b"bytes=")[2]) // 64)) * 64:
                raise ValueError("an image of the payload is missing")
            whole = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
            out["n_bytes"].append(int(image["comment"].partition(b"bytes=")[2]))
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-64:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(f"{8 * WIDTH}x{8 * len(whole)}:{thumbnail_hash(whole)}")
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(stored.select(F.col(id_col).alias("i"), F.col("media").alias("t")), f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string", rows)


def op2_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's whole text through JPEG storage and back."""
    return digests(table(spark, sf_dir, "documents"))
