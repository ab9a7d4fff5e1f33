import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyframe.llm import media


@pytest.mark.parametrize("raw", [b"", b"\0", b"\xff" * 64, b"\xff\0" * 99, bytes(range(256)) * 3, b"x" * 65, random.Random(1).randbytes(50_000)])
def test_round_trip(raw):
    [stored] = media.store_all([raw])
    [(thumbs, image)] = media.thumbnails([stored])
    assert thumbs[0].tobytes() == media.pad(raw) and len(media.pad(raw)) % 64 == 0 and len(media.pad(raw)) >= 64
    assert image["comment"] == b"bytes=%d" % len(raw)
    image = media.parse(stored)
    slow = media.one_by_one(image, {k: media.lookup(*t) for k, t in image["huff"].items()})
    assert (slow + 128).astype(np.uint8).tobytes() == media.pad(raw)


def test_many_and_several_images(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 5)
    monkeypatch.setattr(media, "TOGETHER", 640)
    raws = [random.Random(i).randbytes(i * 37) for i in range(40)]
    for raw, (thumbs, _) in zip(raws, media.thumbnails(media.store_all(raws)), strict=True):
        assert b"".join(t.tobytes() for t in thumbs) == media.pad(raw)


def idct_dc_only(quantised, quant):
    """All samples of a block with only a DC coefficient, by the standard's formula."""
    return round(quantised * quant / 8 + 128)


def bit_string(pairs):
    bits = "".join(f"{v:0{n}b}" for v, n in pairs if n)
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")


def small_image(dcs, interval, components=1, ac=True):
    """A file with AC coefficients, made code by code."""
    dc = {v: (c, n) for c, n, v in media.code_table(media.DC_COUNTS, media.DC_VALUES)}
    ac_counts, ac_values = (0, 2, 1) + (0,) * 13, (0x00, 0x11, 0xF0)
    acs = {v: (c, n) for c, n, v in media.code_table(ac_counts, ac_values)}
    out, pairs, before, mark = b"", [], [0] * components, 0
    for i, values in enumerate(dcs):
        if interval and i and i % interval == 0:
            out += bit_string(pairs) + bytes([0xFF, 0xD0 + mark % 8])
            pairs, before, mark = [], [0] * components, mark + 1
        for c in range(components):
            d = values[c] - before[c]
            before[c] = values[c]
            n = abs(d).bit_length()
            pairs += [dc[n], (d if d >= 0 else d + (1 << n) - 1, n)]
            if ac and i % 2:
                pairs += [acs[0x11], (1, 1), acs[0xF0]]
            pairs.append(acs[0])
    out += bit_string(pairs)
    seg = media._segment
    frame = b"".join(bytes([c + 1, 0x11, 0]) for c in range(components))
    scan = bytes([components]) + b"".join(bytes([c + 1, 0]) for c in range(components)) + b"\0\x3f\0"
    return b"".join([b"\xff\xd8", seg(0xDB, b"\0" + bytes([16] * 64)), seg(0xC0, b"\x08\0\x11\0\x1a" + bytes([components]) + frame), seg(0xC4, b"\0" + bytes(media.DC_COUNTS) + bytes(media.DC_VALUES)), seg(0xC4, b"\x10" + bytes(ac_counts) + bytes(ac_values)), seg(0xDD, bytes([0, interval])) if interval else b"", seg(0xDA, scan), out, b"\xff\xd9"])


@pytest.mark.parametrize("interval", [0, 1, 5])
@pytest.mark.parametrize("components", [1, 3])
def test_general_images(interval, components):
    r = random.Random(interval)
    dcs = [[r.randint(-64, 63) for _ in range(components)] for _ in range(12)]  # 26 x 17 samples: 4 x 3 blocks
    [(thumbs, image)] = media.thumbnails([small_image(dcs, interval, components)])
    assert image["frame"][:2] == (26, 17)
    assert thumbs[0].ravel().tolist() == [idct_dc_only(d[0], 16) for d in dcs]


def test_scans_of_their_own_and_padding():
    """Each component in a scan of its own, with tables between; bytes behind the end; another image of another width."""
    r = random.Random(7)
    dcs = [[r.randint(-64, 63)] for _ in range(12)]
    one = small_image(dcs, 0)
    at = one.index(b"\xff\xc0")
    frame = media._segment(0xC0, b"\x08\0\x11\0\x1a\x03" + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3)))
    head, scan = one[:at] + frame + one[at + 2 + int.from_bytes(one[at + 2 : at + 4], "big") : one.index(b"\xff\xda")], one[one.index(b"\xff\xda") : -2]
    tables = one[one.index(b"\xff\xc4") : one.index(b"\xff\xda")]
    other = scan.replace(b"\xff\xda\0\x08\x01\x01", b"\xff\xda\0\x08\x01\x02", 1)
    for body in (scan + tables + other, other + tables + scan, other + scan + other):
        for tail in (b"", b"\0\0", b"x"):
            [(thumbs, image)] = media.thumbnails([head + body + b"\xff\xd9" + tail])
            assert thumbs[0].ravel().tolist() == [idct_dc_only(d[0], 16) for d in dcs] and image["frame"][:2] == (26, 17)
    assert isinstance(media.thumbnails([head + other + b"\xff\xd9"])[0], str)
    [(thumbs, _)] = media.thumbnails([media.store_all([b"abc"])[0] + one + b"\0"])
    assert [t.shape[1] for t in thumbs] == [64, 4]


def test_broken_media():
    good = media.store_all([b"abc"])[0]
    found = media.thumbnails([good, good[:-9], b"GIF89a", None, good])
    assert [isinstance(x, str) for x in found] == [False, True, True, True, False]


def test_frame(spark):
    rows = [(1, "hello", "z"), (2, None, "z"), (3, "", "z"), (3, "", "z"), (4, "é😀" * 20_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, feature string")
    got = sorted(map(tuple, media.digests(docs).collect()))
    assert len(got) == 5
    for r, (i, text, _) in zip(got, rows, strict=True):
        raw = (text or "").encode()
        payload = media.pad(raw)
        assert r[:5] == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[2] == got[3]
    read = {r.doc_id: r for r in media.read_media(media.store(docs)).collect()}
    assert bytes(read[1].thumbnail) == media.pad(b"hello") and (read[1].width, read[1].height, read[1].n_bytes) == (512, 8, 5)
    wide = spark.createDataFrame([(7, bytearray(media.store_all([b"abc"])[0] + small_image([[1]] * 12, 0)))], "doc_id bigint, media binary")
    assert media.read_media(wide).first().error == "images of several widths"
    assert media.digests(docs.limit(0)).collect() == []
