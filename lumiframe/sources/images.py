"""Chunked arrays (Zarr version 2) and TIFF stacks as Spark data sources and sinks; a partition per chunk or run of planes."""

from __future__ import annotations

import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes that one task reads of a folder of files, and what opening a file counts as.
TASK_BYTES, FILE_COST = 32 << 20, 256 << 10
BLOCK = "array string, gx long, gy long, gz long, ox long, oy long, oz long, nx int, ny int, nz int, data array<double>"


def open_store(uri: str):
    """File system and path of a URI (file, hdfs, s3, gs) or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def put_file(store, path: str, data: bytes) -> None:
    """A file that appears whole: written aside, then moved into place."""
    store.create_dir(path.rpartition("/")[0], recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(aside) as f:
        f.write(data)
    store.move(aside, path)


def encode(data: bytes, compressor: dict | None) -> bytes:
    if compressor is None:
        return data
    kind = compressor["id"]
    if kind in ("zlib", "gzip"):
        c = zlib.compressobj(compressor.get("level", 5), zlib.DEFLATED, 31 if kind == "gzip" else 15)
        return c.compress(data) + c.flush()
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=compressor.get("level", 3)).compress(data)
    raise ValueError(f"compressor {kind} isn't supported")


def decode(data: bytes, compressor: dict | None) -> bytes:
    if compressor is None:
        return data
    if compressor["id"] in ("zlib", "gzip"):
        return zlib.decompress(data, 47)
    if compressor["id"] == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"compressor {compressor['id']} isn't supported")


def _row(schema: str, values: list, samples: np.ndarray):
    """One row of a source as an Arrow batch, whose samples are a numpy buffer; workers can't parse schemas, so the few types are spelt out."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32())}
    fields = pa.schema([pa.field(n, kinds[t]) for n, t in (f.split(" ") for f in schema.split(", "))])
    flat = np.ascontiguousarray(samples).ravel().astype(fields[-1].type.value_type.to_pandas_dtype())
    data = pa.ListArray.from_arrays(pa.array([0, flat.size], pa.int32()), pa.array(flat))
    return pa.RecordBatch.from_arrays([*[pa.array([v], f.type) for v, f in zip(values, list(fields)[:-1], strict=True)], data], schema=fields)


class _Part(InputPartition):
    def __init__(self, *what):
        self.what = what


class ZarrSource(DataSource):
    """`zarrarray`: path of an array of up to three dimensions (z, y, x), or of five (t, c, z, y, x) with options t and c."""

    @classmethod
    def name(cls) -> str:
        return "zarrarray"

    def schema(self) -> str:
        return BLOCK

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ZarrReader(self.options)


class _ZarrReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.t, self.c = options["path"].rstrip("/"), int(options.get("t", "0")), int(options.get("c", "0"))

    def _meta(self) -> dict:
        store, path = open_store(self.uri)
        with store.open_input_file(f"{path}/.zarray") as f:
            return json.loads(f.read())

    def partitions(self):
        m = self._meta()
        grid = [-(-s // c) for s, c in zip(m["shape"][-3:], m["chunks"][-3:], strict=True)]
        return [_Part(*g) for g in itertools.product(*[range(n) for n in grid])]

    def read(self, part):
        m = self._meta()
        shape, chunks = m["shape"], m["chunks"]
        lead = [self.t, self.c][-(len(shape) - 3) :] if len(shape) > 3 else []
        place = [a // b for a, b in zip(lead, chunks, strict=False)] + list(part.what)
        store, path = open_store(self.uri)
        name = f"{path}/{m.get('dimension_separator', '.').join(map(str, place))}"
        kind = np.dtype(m["dtype"])
        from pyarrow import fs

        if store.get_file_info(name).type == fs.FileType.NotFound:
            block = np.full(chunks, m.get("fill_value") or 0, kind)
        else:
            with store.open_input_file(name) as f:
                block = np.frombuffer(decode(f.read(), m.get("compressor")), kind).reshape(chunks, order=m.get("order", "C"))
        for a, b in zip(lead, chunks, strict=False):
            block = block[a % b]
        # chunks at the far sides reach beyond the array
        at = [0] * (3 - len(part.what)) + list(part.what)
        size, step = [1] * (3 - len(part.what)) + shape[-3:], [1] * (3 - len(part.what)) + chunks[-3:]
        block = block.reshape([1] * (3 - block.ndim) + list(block.shape))
        n = [min(s, z - g * s) for g, s, z in zip(at, step, size, strict=True)]
        block = block[: n[0], : n[1], : n[2]]
        yield _row(BLOCK, [self.uri, at[2], at[1], at[0], at[2] * step[2], at[1] * step[1], at[0] * step[0], n[2], n[1], n[0]], block)


def write_zarr(blocks: DataFrame, path: str, shape: list[int], chunks: list[int], kind: str = "<u2", compressor: dict | None = None, separator: str = "/") -> int:
    """Blocks (gx, gy, gz, nx, ny, nz, data) of one array as chunk files; returns how many were written. Chunks of zeros alone are left out.

    Tasks write chunks whole, so a retried one repeats its files; values are rounded half up and clamped to the kind.
    """
    store, at = open_store(path)
    meta = {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": kind, "compressor": compressor, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": separator}
    put_file(store, f"{at}/.zarray", json.dumps(meta).encode())

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        out, root = open_store(path)
        for df in parts:
            n = 0
            for r in df.itertuples():
                v = np.asarray(r.data, float).reshape(r.nz, r.ny, r.nx)
                if not v.any():
                    continue
                k = np.dtype(kind)
                if k.kind in "iu":
                    v = np.clip(np.floor(v + 0.5), np.iinfo(k).min, np.iinfo(k).max)
                full = np.zeros(chunks, k)
                full[: r.nz, : r.ny, : r.nx] = v
                put_file(out, f"{root}/{separator.join(map(str, (r.gz, r.gy, r.gx)))}", encode(full.tobytes(), compressor))
                n += 1
            yield pd.DataFrame({"n": [n]})

    return blocks.select("gx", "gy", "gz", "nx", "ny", "nz", "data").mapInPandas(run, "n long").agg({"n": "sum"}).first()[0] or 0


def tiff_bytes(stack: np.ndarray) -> bytes:
    """An uncompressed little-endian TIFF of a stack (z, y, x) of uint8, uint16 or float32: a page per plane, a strip per page."""
    out = bytearray(b"II*\0\0\0\0\0")
    last = 4
    bits = stack.dtype.itemsize * 8
    for plane in stack:
        data = plane.astype(plane.dtype.newbyteorder("<")).tobytes()
        start = len(out)
        out += data + b"\0" * (len(data) % 2)
        tags = [(256, 4, plane.shape[1]), (257, 4, plane.shape[0]), (258, 3, bits), (259, 3, 1), (262, 3, 1), (273, 4, start), (277, 3, 1), (278, 4, plane.shape[0]), (279, 4, len(data)), (339, 3, 3 if stack.dtype.kind == "f" else 1)]
        struct.pack_into("<I", out, last, len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
        last = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(read_at) -> Iterator[dict]:
    """Tags of each page of an uncompressed TIFF; read_at(size, offset) gives its bytes."""
    head = read_at(8, 0)
    e = {b"II": "<", b"MM": ">"}.get(head[:2])
    if e is None or struct.unpack(e + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack(e + "I", head[4:])[0]
    while at:
        n = struct.unpack(e + "H", read_at(2, at))[0]
        body = read_at(12 * n + 4, at + 2)
        tags: dict = {"order": e}
        for i in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", body, 12 * i)
            size = {1: 1, 3: 2, 4: 4}.get(kind)
            if size is None:
                continue
            raw = body[12 * i + 8 : 12 * i + 12]
            if size * count > 4:
                raw = read_at(size * count, struct.unpack(e + "I", raw)[0])
            tags[tag] = struct.unpack_from(e + {1: "B", 2: "H", 4: "I"}[size] * count, raw)
        yield tags
        at = struct.unpack_from(e + "I", body, 12 * n)[0]


def tiff_plane(tags: dict, read_at) -> np.ndarray:
    if tags.get(259, (1,))[0] != 1:
        raise ValueError("compressed TIFF isn't supported")
    bits, form = tags[258][0], tags.get(339, (1,))[0]
    kind = np.dtype({(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4"}[bits, form]).newbyteorder(tags["order"])
    data = b"".join(read_at(n, o) for o, n in zip(tags[273], tags[279], strict=True))
    return np.frombuffer(data, kind).reshape(tags[257][0], tags[256][0])


class TiffSource(DataSource):
    """`tiffstack`: path of a TIFF or of a folder of them; a row per plane: array (the file), place in the stack, samples."""

    @classmethod
    def name(cls) -> str:
        return "tiffstack"

    def schema(self) -> str:
        return BLOCK

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TiffReader(self.options)


class _TiffReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]

    def partitions(self):
        from pyarrow import fs

        store, path = open_store(self.uri)
        info = store.get_file_info(path)
        if info.is_file:
            return [_Part(path)]
        found = sorted((f for f in store.get_file_info(fs.FileSelector(path)) if f.path.lower().endswith((".tif", ".tiff"))), key=lambda f: f.path)
        # small files share a task, large ones have their own
        lot = np.cumsum([FILE_COST + (f.size or 0) for f in found]) // TASK_BYTES
        return [_Part(*(f.path for _, f in g)) for _, g in itertools.groupby(zip(lot.tolist(), found, strict=True), key=lambda x: x[0])]

    def read(self, part):
        store, _ = open_store(self.uri)
        for path in part.what:
            with store.open_input_file(path) as f:
                for z, tags in enumerate(tiff_pages(f.read_at)):
                    v = tiff_plane(tags, f.read_at)
                    yield _row(BLOCK, [path, 0, 0, z, 0, 0, z, v.shape[1], v.shape[0], 1], v)


def write_tiff(stacks: DataFrame, path: str) -> int:
    """A TIFF per row of (name, nx, ny, nz, data); returns how many."""

    def run(parts: Iterator) -> Iterator:
        import pandas as pd

        store, root = open_store(path)
        for df in parts:
            for r in df.itertuples():
                put_file(store, f"{root}/{r.name}.tif", tiff_bytes(np.asarray(r.data, np.float32).reshape(r.nz, r.ny, r.nx)))
            yield pd.DataFrame({"n": [len(df)]})

    return stacks.select("name", "nx", "ny", "nz", "data").mapInPandas(run, "n long").agg({"n": "sum"}).first()[0] or 0


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZarrSource)
    spark.dataSource.register(TiffSource)
