import hashlib
import os
import zlib

import numpy as np
import pytest

from lumiframe.llm import media


@pytest.mark.parametrize("data", [b"", b"\xff" * 5000, bytes(range(256)) * 9, os.urandom(40000), b"\x00" * 577])
def test_lossless(data):
    payload = media.pad(data)
    image = media.Image(media.write_jpeg(payload))
    assert image.payload() == payload and len(payload) % media.UNIT == 0 and payload.startswith(data)
    assert image.rgb().shape == (image.height, image.width, 3)


def coded(symbols, table):
    return "".join(table[s] + b for s, b in symbols)


def test_general_scans():
    """A grey image of two blocks in one scan of each kind, with runs, end-of-band codes and new coefficients in refinement."""
    blocks = np.zeros((2, 64), int)
    blocks[0, 0], blocks[1, 0] = 5, -3
    blocks[0, 1], blocks[0, 5], blocks[1, 2], blocks[0, 20] = 4, -7, 2, 1
    out = [b"\xff\xd8", media._segment(0xDB, b"\0" + bytes([2] * 64)), media._segment(0xC2, b"\x08\x00\x08\x00\x10\x01\x01\x11\x00")]
    cat = lambda v: abs(v).bit_length()
    bits = lambda v: "" if v == 0 else f"{v if v > 0 else v + (1 << cat(v)) - 1:0{cat(v)}b}"
    # mean levels: upper bits, then the lowest
    up = [5 >> 1, -3 >> 1]
    steps = [up[0], up[1] - up[0]]
    table = {s: f"{i:03b}" for i, s in enumerate([0, 1, 2, 3, 4])}
    pack = lambda s: media._bits(np.array([int(c) for c in s], np.uint8))
    out += [media._huffman(0x00, {3: [0, 1, 2, 3, 4]}), media._scan([(1, 0)], (0, 0), 0, 1, pack("".join(table[cat(v)] + bits(v) for v in steps)))]
    out.append(media._scan([(1, 0)], (0, 0), 1, 0, pack("".join(str(v & 1) for v in (5, -3)))))
    # first pass of the band: values halved towards zero; block 0: 2 at 1, run 3, -3 at 5, end; block 1: run 1, 1 at 2, end
    symbols = [0x02, 0x32, 0x11, 0x00]
    t = {s: f"{i:03b}" for i, s in enumerate(symbols)}
    first = t[0x02] + bits(2) + t[0x32] + bits(-3) + t[0x00] + t[0x11] + bits(1) + t[0x00]
    out += [media._huffman(0x10, {3: symbols}), media._scan([(1, 0)], (1, 63), 0, 1, pack(first))]
    # refinement: block 0 gets a new 1 at 20 after a run of 16 zeros (3 before 5, then 6..19 = 14: 17 zeros; 0xF0 skips 16, run 1)
    symbols = [0xF0, 0x11, 0x00]
    t = {s: f"{i:02b}" for i, s in enumerate(symbols)}
    zeros_before = 20 - 1 - 2  # coefficients 1..19 without those at 1 and 5
    assert zeros_before == 17
    refine = t[0xF0] + "0" + "1" + t[0x11] + "1" + t[0x00] + t[0x00] + "0"
    out += [media._huffman(0x11, {2: symbols}), media._scan([(1, 1)], (1, 63), 1, 0, pack(refine))]
    image = media.Image(b"".join(out) + b"\xff\xd9")
    assert np.array_equal(image.coefficients[1].reshape(2, 64), blocks)
    a = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]
    dense = np.zeros((2, 64))
    dense[:, media.ZIGZAG] = blocks * 2
    plain = [a.T @ x.reshape(8, 8) @ a + 128 for x in dense]
    assert np.abs(image.rgb()[:, :, 0] - np.hstack(plain)).max() <= 0.51


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "é" * 400), (3, "é" * 400), (None, "x" * 200000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, media int")
    out = media.digests(docs).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    for i, t in rows:
        payload = media.pad((t or "").encode())
        stored = media.write_jpeg(payload)
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len((t or "").encode()), len(payload), len(stored))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["feature"]
    assert media.digests(docs.limit(0)).count() == 0
    full = media.load(media.store(docs.select("doc_id", "text"))).collect()
    assert all(len(r["rgb"]) == 3 * r["height"] * r["width"] and r["problem"] is None for r in full)


def test_damaged_media(spark):
    good = media.write_jpeg(media.pad(b"abc"))
    rows = [(1, None), (2, b""), (3, b"\xff\xd8\xff"), (4, good[:-40]), (5, b"GIF89a"), (6, good)]
    out = {r["k"]: r for r in media.load(spark.createDataFrame(rows, "k int, media binary")).collect()}
    assert all(out[k]["rgb"] is None and out[k]["problem"] for k in (1, 2, 3, 4, 5)) and bytes(out[6]["payload"]) == media.pad(b"abc")


def test_a_colour_image_of_general_scans():
    """Made here from known coefficients, with general codes, interleaved means and three components at half chroma, and decoded by plain sums."""
    rng = np.random.default_rng(4)
    width, height = 30, 17  # not whole units
    wide, high = 2, 2  # units of 16 x 16
    shape = {1: (2 * high, 2 * wide), 2: (high, wide), 3: (high, wide)}
    coefficients = {c: np.zeros((*s, 64), int) for c, s in shape.items()}
    for c in shape:
        coefficients[c][..., 0] = rng.integers(-40, 40, shape[c])
        for _ in range(5):
            k = rng.integers(1, 64)
            coefficients[c][..., k] = rng.integers(-30, 30, shape[c]) * (rng.random(shape[c]) < 0.6)
    quant = {0: rng.integers(1, 9, 64), 1: rng.integers(1, 9, 64)}
    cat = lambda v: int(abs(v)).bit_length()
    bits = lambda v: "" if v == 0 else f"{v if v > 0 else v + (1 << cat(v)) - 1:0{cat(v)}b}"
    pack = lambda s: media._bits(np.array([int(x) for x in s], np.uint8))
    code = lambda s: f"{s:08b}"
    out = [b"\xff\xd8", media._segment(0xDB, b"\0" + bytes(quant[0].tolist())), media._segment(0xDB, b"\1" + bytes(quant[1].tolist()))]
    out.append(media._segment(0xC2, bytes([8, 0, height, 0, width, 3, 1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])))
    # codes of eight bits, each its own symbol; the last one isn't used
    out += [media._huffman(0x00, {8: list(range(12))}), media._huffman(0x10, {8: list(range(255))})]
    out[-2] = media._huffman(0x00, {8: list(range(12))})
    last, stream, low = {1: 0, 2: 0, 3: 0}, "", ""
    for m in range(wide * high):
        y, x = divmod(m, wide)
        for c, h in ((1, 2), (2, 1), (3, 1)):
            for j in range(h):
                for i in range(h):
                    v = int(coefficients[c][y * h + j, x * h + i, 0])
                    step = (v >> 1) - last[c]
                    last[c] = v >> 1
                    stream += code(cat(step)) + bits(step)
                    low += str(v & 1)
    out += [media._scan([(1, 0), (2, 0), (3, 0)], (0, 0), 0, 1, pack(stream)), media._scan([(1, 0), (2, 0), (3, 0)], (0, 0), 1, 0, pack(low))]
    own = {1: (-(-height // 8), -(-width // 8)), 2: (-(-(-(-height // 2)) // 8), -(-(-(-width // 2)) // 8))}
    own[3] = own[2]
    for c in shape:
        for a, b in ((1, 9), (10, 63)):
            stream = ""
            for y in range(own[c][0]):
                for x in range(own[c][1]):
                    run = 0
                    for v in coefficients[c][y, x, a : b + 1]:
                        if v == 0:
                            run += 1
                            continue
                        while run > 15:
                            stream, run = stream + code(0xF0), run - 16
                        stream += code(run << 4 | cat(v)) + bits(int(v))
                        run = 0
                    if run:
                        stream += code(0)
            out.append(media._scan([(c, 0)], (a, b), 0, 0, pack(stream)))
    image = media.Image(b"".join(out) + b"\xff\xd9")
    for c in shape:
        rows, cols = own[c]
        assert np.array_equal(image.coefficients[c][:rows, :cols], coefficients[c][:rows, :cols])
    got = image.rgb()
    assert got.shape == (height, width, 3)
    basis = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    planes = {}
    for c, q in ((1, 0), (2, 1), (3, 1)):
        rows, cols = image.coefficients[c].shape[:2]
        plane = np.zeros((8 * rows, 8 * cols))
        for y in range(rows):
            for x in range(cols):
                dense = np.zeros(64)
                dense[media.ZIGZAG] = image.coefficients[c][y, x] * quant[q]
                plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = basis.T @ dense.reshape(8, 8) @ basis
        planes[c] = plane
    for y in range(height):
        for x in range(width):
            l, cb, cr = planes[1][y, x] + 128, planes[2][y // 2, x // 2], planes[3][y // 2, x // 2]
            want = np.clip([l + 1.402 * cr, l - 0.344136 * cb - 0.714136 * cr, l + 1.772 * cb], 0, 255)
            assert np.abs(got[y, x].astype(float) - want).max() <= 2.5
