"""Media columns: progressive JPEG. Bytes are kept losslessly as coefficients, and decoded to full-resolution RGB tensors.

The format's lossless unit is the quantised coefficient: a byte is one AC coefficient of category 8, whose sign and
magnitude bits are that byte. Scans split the spectrum in two bands and send the lowest magnitude bit later.
"""

from __future__ import annotations

import functools
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiframe.llm.common import materialize, text_bytes, with_columns_from

#: Payloads are padded with 255 to a positive multiple of this; bands of AC coefficients; blocks that one EOB run covers at most.
UNIT, BANDS, MOST_RUN = 576, ((1, 5), (6, 63)), 32767
#: Component ids with their sampling factors (4:2:0).
SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))
FRACTION = 13


def zigzag_order() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order: by antidiagonals, every other one upwards."""
    return np.array([8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


ZIGZAG = zigzag_order()


def inverse_transform() -> np.ndarray:
    """Matrix from the 64 coefficients in zigzag order to 64 samples, in whole multiples of 2^-FRACTION: sums are exact in float64."""
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    a = np.cos((2 * x + 1) * u * math.pi / 16) * np.where(u == 0, math.sqrt(1 / 8), 0.5)
    return np.rint(np.kron(a, a)[ZIGZAG] * (1 << FRACTION))


INVERSE = inverse_transform()


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _huffman(place: int, lengths: dict[int, list[int]]) -> bytes:
    return _segment(0xC4, bytes([place, *[len(lengths.get(n, [])) for n in range(1, 17)], *[s for n in range(1, 17) for s in lengths.get(n, [])]]))


def _scan(components: list[tuple[int, int]], band: tuple[int, int], high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(components), *[x for c in components for x in c], band[0], band[1], high << 4 | low])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _bits(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last one filled with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def write_jpeg(payload: bytes) -> bytes:
    """A progressive JPEG whose AC coefficients hold the payload; its length stands in a comment."""
    mcus = max(1, -(-len(payload) // (6 * 63)))
    wide = math.ceil(math.sqrt(mcus))
    high = -(-mcus // wide)
    if 16 * max(wide, high) > 65535:
        raise ValueError("payload is too long for one image")
    n = wide * high
    flat = np.zeros(n * 6 * 63, np.uint8)
    flat[: len(payload)] = np.frombuffer(payload, np.uint8)
    parts = [p.reshape(-1, 63) for p in np.split(flat, [n * 4 * 63, n * 5 * 63])]
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in SAMPLING))]
    # mean levels are all 0: a scan of zero differences, and one of their lowest bits
    out += [_huffman(0x00, {1: [0]}), _scan([(c, 0) for c, _, _ in SAMPLING], (0, 0), 0, 1, _bits(np.zeros(6 * n, np.uint8)))]
    out += [_scan([(c, 0) for c, _, _ in SAMPLING], (0, 0), 1, 0, _bits(np.zeros(6 * n, np.uint8)))]
    out.append(_huffman(0x10, {1: [0x07]}))
    for (c, _, _), part in zip(SAMPLING, parts, strict=True):
        for a, b in BANDS:
            # a code of one zero bit, then the upper seven bits: a byte a coefficient
            out.append(_scan([(c, 0)], (a, b), 0, 1, (part[:, a - 1 : b] >> 1).tobytes()))
    out.append(_huffman(0x11, {4: [r << 4 for r in range(15)]}))
    for (c, _, _), part in zip(SAMPLING, parts, strict=True):
        lowest = (part ^ (part < 128)) & 1
        for a, b in BANDS:
            bits = []
            for at in range(0, len(part), MOST_RUN):
                run = min(MOST_RUN, len(part) - at)
                r = run.bit_length() - 1
                bits += [np.array([int(x) for x in f"{r:04b}" + (f"{run - (1 << r):0{r}b}" if r else "")], np.uint8), lowest[at : at + run, a - 1 : b].ravel()]
            out.append(_scan([(c, 1)], (a, b), 1, 0, _bits(np.concatenate(bits))))
    return b"".join(out) + b"\xff\xd9"


class _Table:
    """A Huffman table: symbol and length for each 16 bits that may follow, and the one symbol if it has no other."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.symbol, self.length = [0] * (1 << 16), [0] * (1 << 16)
        code, i = 0, 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                a = code << (16 - n)
                k = 1 << (16 - n)
                self.symbol[a : a + k], self.length[a : a + k] = [symbols[i]] * k, [n] * k
                code, i = code + 1, i + 1
            code <<= 1
        self.only = (symbols[0], next(n for n in range(1, 17) if counts[n - 1])) if i == 1 else None


_table = functools.lru_cache(256)(_Table)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.size = data + b"\xff" * 8, 0, 8 * len(data)

    def peek(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        i, end = self.at >> 3, self.at + n
        if end > self.size:
            raise ValueError("a scan ends early")
        j = (end + 7) >> 3
        self.at = end
        return int.from_bytes(self.data[i:j], "big") >> (8 * j - end) & ((1 << n) - 1)

    def many(self, n: int) -> np.ndarray:
        """The next n bits, one a byte."""
        i, end = self.at >> 3, self.at + n
        if end > self.size:
            raise ValueError("a scan ends early")
        out = np.unpackbits(np.frombuffer(self.data, np.uint8, (end + 7 >> 3) - i, i))[self.at & 7 :][:n]
        self.at = end
        return out

    def code(self, t: _Table) -> int:
        x = self.peek()
        n = t.length[x]
        if not n or self.at + n > self.size:
            raise ValueError("no such code")
        self.at += n
        return t.symbol[x]

    def fields(self, n: int, code: int, size: int) -> np.ndarray:
        """The `size` bits after each of n codes of `code` bits: the fields of a scan that has one symbol only."""
        if code + size == 8 and self.at % 8 == 0:
            i = self.at >> 3
            if self.at + 8 * n > self.size:
                raise ValueError("a scan ends early")
            self.at += 8 * n
            return (np.frombuffer(self.data, np.uint8, n, i) & ((1 << size) - 1)).astype(np.int32)
        bits = self.many(n * (code + size)).reshape(n, code + size)[:, code:]
        return bits @ (1 << np.arange(size)[::-1]).astype(np.int32)


def _extend(x, size: int):
    """Value of a category's bits."""
    return np.where(x < 1 << (size - 1), x - (1 << size) + 1, x) if size else x * 0


class Image:
    """The coefficients of a progressive JPEG by component, accumulated scan by scan."""

    def __init__(self, data: bytes):
        self.comment, self.tables, self.quant, self.coefficients = b"", {}, {}, {}
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        at = 2
        while True:
            at = data.index(b"\xff", at)
            marker = data[at + 1]
            if marker in (0xFF, 0x00) or 0xD0 <= marker <= 0xD7:
                at += 1
                continue
            if marker == 0xD9:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC2:
                self._frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not progressive with Huffman codes")
            elif marker == 0xDD and body != b"\0\0":
                raise ValueError("restart intervals aren't supported")
            elif marker == 0xDA:
                end = at
                while data[(end := data.index(b"\xff", end)) + 1] == 0:
                    end += 2
                self._scan(body, data[at:end].replace(b"\xff\x00", b"\xff"))
                at = end

    def _quantisation(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            n = 128 if wide else 64
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float64)
            body = body[1 + n :]

    def _frame(self, body: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if precision != 8 or n not in (1, 3):
            raise ValueError("only 8-bit grey and colour images are supported")
        self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.hmax, self.vmax = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.mcux, self.mcuy = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c, h, v, _ in self.parts:
            self.coefficients[c] = np.zeros((self.mcuy * v, self.mcux * h, 64), np.int32)

    def _order(self, chosen: list) -> list[tuple[int, np.ndarray]]:
        """Component and block places (in its raster) in the order of a scan."""
        if len(chosen) == 1:
            c, h, v, _ = chosen[0]
            wide, high = -(-(-(-self.width * h // self.hmax)) // 8), -(-(-(-self.height * v // self.vmax)) // 8)
            return [(c, (np.arange(high)[:, None] * (self.mcux * h) + np.arange(wide)).ravel())]
        m = np.arange(self.mcux * self.mcuy)
        y, x = m // self.mcux, m % self.mcux
        return [(c, (y * v + j) * (self.mcux * h) + x * h + i) for c, h, v, _ in chosen for j in range(v) for i in range(h)]

    def _scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        which = {head[1 + 2 * i]: head[2 + 2 * i] for i in range(n)}
        first, last, steps = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n]
        chosen = [p for p in self.parts if p[0] in which]
        order = self._order(chosen)
        bits = _Bits(data)
        if first == 0:
            self._means(order, which, bits, steps >> 4, steps & 15)
            return
        c, places = order[0]
        blocks = self.coefficients[c].reshape(-1, 64)
        table = self.tables[0x10 | which[c] & 15]
        (self._refine if steps >> 4 else self._first)(blocks, places, table, bits, first, last, steps & 15)

    def _means(self, order, which, bits: _Bits, high: int, low: int) -> None:
        k = len(order)
        n = len(order[0][1])
        if high:
            got = bits.many(n * k).reshape(n, k).astype(np.int32) << low
            for i, (c, places) in enumerate(order):
                self.coefficients[c].reshape(-1, 64)[places, 0] |= got[:, i]
            return
        tables = [self.tables[which[c] >> 4] for c, _ in order]
        if tables[0].only and all(t.only == tables[0].only for t in tables):
            size, length = tables[0].only
            steps = _extend(bits.fields(n * k, length, size), size).reshape(n, k)
        else:
            steps = np.zeros((n, k), np.int32)
            for m in range(n):
                for i in range(k):
                    size = bits.code(tables[i])
                    steps[m, i] = _extend(np.int32(bits.take(size)), size)
        for c in dict.fromkeys(c for c, _ in order):
            own = [i for i, (d, _) in enumerate(order) if d == c]
            level = np.cumsum(steps[:, own].ravel()).reshape(n, len(own))
            for j, i in enumerate(own):
                self.coefficients[c].reshape(-1, 64)[order[i][1], 0] = level[:, j] << low

    def _first(self, blocks, places, table: _Table, bits: _Bits, a: int, b: int, low: int) -> None:
        if table.only and 0 < table.only[0] < 16:
            size, length = table.only
            got = _extend(bits.fields(len(places) * (b - a + 1), length, size), size)
            blocks[places, a : b + 1] = (got << low if low == 0 else np.sign(got) * (np.abs(got) << low)).reshape(len(places), -1)
            return
        run = 0
        for place in places:
            if run:
                run -= 1
                continue
            k = a
            while k <= b:
                x = bits.code(table)
                r, size = x >> 4, x & 15
                if size:
                    k += r
                    v = int(_extend(np.int32(bits.take(size)), size))
                    blocks[place, k] = v * (1 << low)
                    k += 1
                elif r == 15:
                    k += 16
                else:
                    run = (1 << r) - 1 + bits.take(r)
                    break

    def _refine(self, blocks, places, table: _Table, bits: _Bits, a: int, b: int, low: int) -> None:
        one = 1 << low

        def correct(rows, start: int) -> None:
            """One bit for each coefficient that is already there, from `start` on in the first row."""
            part = blocks[rows, a : b + 1]
            there = part != 0
            there[0, : start - a] = False
            part[there] += bits.many(int(there.sum())).astype(np.int32) * one * np.sign(part[there])
            blocks[rows, a : b + 1] = part

        i = 0
        while i < len(places):
            row, k = blocks[places[i]], a
            while k <= b:
                x = bits.code(table)
                r, size = x >> 4, x & 15
                new = 0
                if size:
                    new = one if bits.take(1) else -one
                elif r < 15:
                    run = (1 << r) + bits.take(r)
                    correct(places[i : i + run], k)
                    i += run - 1
                    break
                while k <= b:
                    if row[k]:
                        if bits.take(1):
                            row[k] += one if row[k] > 0 else -one
                    elif r == 0:
                        row[k] = new
                        k += 1
                        break
                    else:
                        r -= 1
                    k += 1
            i += 1

    def payload(self) -> bytes:
        """The bytes that write_jpeg() kept in the coefficients."""
        kept = np.concatenate([self.coefficients[c].reshape(-1, 64)[:, 1:].ravel() for c, _, _, _ in self.parts])
        size = int(self.comment.split()[1])
        return np.where(kept < 0, kept + 255, kept)[:size].astype(np.uint8).tobytes()

    def rgb(self) -> np.ndarray:
        """Full-resolution tensor (height, width, 3) of uint8: dequantised, inverse-transformed, chroma repeated to the luma's grid."""
        planes = []
        for c, h, v, q in self.parts:
            x = self.coefficients[c]
            high, wide, _ = x.shape
            flat = x.reshape(-1, 64)
            out = np.empty((high * wide, 64), np.int32)
            for i in range(0, len(flat), 4096):
                out[i : i + 4096] = np.floor((flat[i : i + 4096] * self.quant[q]) @ INVERSE * (1.0 / (1 << FRACTION)) + 0.5)
            plane = out.reshape(high, wide, 8, 8).swapaxes(1, 2).reshape(8 * high, 8 * wide)
            plane = plane.repeat(self.vmax // v, 0).repeat(self.hmax // h, 1)
            planes.append(plane[: self.height, : self.width])
        y = planes[0] + 128
        if len(planes) == 1:
            return np.clip(y, 0, 255).astype(np.uint8)[:, :, None].repeat(3, 2)
        cb, cr = np.clip(planes[1], -4096, 4096), np.clip(planes[2], -4096, 4096)
        half = 1 << 15
        # fixed values of the colour transform, times 65536
        r = y + (91881 * cr + half >> 16)
        g = y - (22554 * cb + 46802 * cr + half >> 16)
        b = y + (116130 * cb + half >> 16)
        return np.clip(np.stack([r, g, b], 2), 0, 255).astype(np.uint8)


def feature(rgb: np.ndarray) -> str:
    """Height, width, mean of each channel in thousandths, and crc32 of a tensor."""
    n = rgb.shape[0] * rgb.shape[1]
    return f"{rgb.shape[0]}x{rgb.shape[1]};" + ",".join(str(int(s) * 1000 // n) for s in rgb.reshape(-1, 3).sum(0, dtype=np.int64)) + f";{zlib.crc32(rgb.tobytes()):08x}"


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a column of progressive JPEGs that keep the texts' padded UTF-8 bytes; null and empty texts are padding alone."""

    def make():
        return lambda column: [pa.array([write_jpeg(pad(t)) for t in text_bytes(column)], pa.binary())]

    return with_columns_from(df, [text], make, [T.StructField(media, T.BinaryType())])


def load(df: DataFrame, media: str = "media", tensors: bool = True) -> DataFrame:
    """df with what the JPEGs of a column hold: payload (null without a payload comment), height, width, rgb, feature, problem.

    rgb has height x width x 3 bytes, row by row; without `tensors` it is made for the feature but not returned. Null or
    damaged media, and kinds other than 8-bit progressive Huffman, give nulls and the reason in `problem`.
    """

    def make():
        def one(data: bytes | None):
            if data is None:
                return None, None, None, None, None, "null"
            try:
                image = Image(data)
                rgb = image.rgb()
                return image.payload() if image.comment.startswith(b"payload ") else None, image.height, image.width, rgb.tobytes() if tensors else None, feature(rgb), None
            except (ValueError, IndexError, KeyError, AttributeError, struct.error) as e:
                return None, None, None, None, None, f"{type(e).__name__}: {e}"

        def work(column: pa.Array):
            rows = [one(x) for x in column.to_pylist()]
            return [[r[i] for r in rows] for i in range(6)] if rows else [[]] * 6

        return work

    fields = [("payload", T.BinaryType()), ("height", T.IntegerType()), ("width", T.IntegerType()), ("rgb", T.BinaryType()), ("feature", T.StringType()), ("problem", T.StringType())]
    return with_columns_from(df, [media], make, [T.StructField(*f) for f in fields])


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest columns of store() and load() for every text of df: media are written to the shared folder and read back.

    Null and empty texts are padding alone; equal texts, and so repeated rows, give equal values; a null key stays. Other
    columns of df, whatever their names, are ignored.
    """
    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    stored = store(rows).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    return load(materialize(stored, "media"), tensors=False).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
