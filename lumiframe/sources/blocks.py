"""Blocked images as tables, and their pyramids: one row per block, written by level, read by chunk."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "tp int, setup int, level int, ox long, oy long, oz long, nx int, ny int, nz int, data array<float>"


def grid(dims: DataFrame, block: tuple[int, int, int], times: tuple[int, int, int] = (1, 1, 1)) -> DataFrame:
    """Blocks of volumes (key columns, sx, sy, sz): offset, size and place in the grid; a job is `times` storage blocks a side."""
    out = dims
    for i, c in enumerate("xyz"):
        step = block[i] * times[i]
        out = out.withColumn(f"o{c}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"s{c}") - 1, F.lit(step).cast("long"))))
        out = out.withColumn(f"n{c}", F.least(F.lit(step).cast("long"), F.col(f"s{c}") - F.col(f"o{c}")).cast("int")).withColumn(f"g{c}", (F.col(f"o{c}") / block[i]).cast("long"))
    return out


def pyramid(dims: list[int], factors: list[list[int]]) -> list[list[int]]:
    """Sizes of levels: each by its factors relative to the level before, rounded down, at least 1."""
    out, last = [list(dims)], [1, 1, 1]
    for f in factors:
        out.append([max(1, d // (a // b)) for d, a, b in zip(out[-1], f, last, strict=True)])
        last = f
    return out


def level_step(factor: Column, full: Column) -> Column:
    return factor / full


def best_level(levels: DataFrame, by: list[str], scale: list[float]) -> DataFrame:
    """The coarsest level whose step on each axis is under 1.02 of the wanted scale, or as fine as full resolution; ties by level.

    levels: key columns, level, fx, fy, fz.
    """
    ok = F.lit(True)
    for c, s in zip("xyz", scale, strict=True):
        step = F.col(f"f{c}") / F.lit(float(s))
        ok &= (step < 1.02) | (F.abs(F.col(f"f{c}") - 1) <= 0.02)
    total = F.col("fx") * F.col("fy") * F.col("fz")
    return levels.where(ok).groupBy(*by).agg(F.max_by("level", F.struct(total, -F.col("level"))).alias("level"))


def coarsest_level(levels: DataFrame, by: list[str]) -> DataFrame:
    return levels.groupBy(*by).agg(F.max_by("level", F.struct(F.col("fx") * F.col("fy") * F.col("fz"), -F.col("level"))).alias("level"))


def to_blocks(voxels: DataFrame, by: list[str], block: int, background: float = 0.0) -> DataFrame:
    """Lines of voxels as blocks; places without a voxel take the background, blocks of background alone are left out."""
    o = (F.floor(F.col("x") / block) * block).cast("long")
    b = voxels.groupBy(*by, o.alias("ox")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("x") - o).cast("int"), F.col("v").cast("float")))).alias("m"))
    data = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(float(background)).cast("float")))
    out = b.select(*by, "ox", F.lit(block).alias("nx"), data.alias("data"))
    return out.where(F.exists("data", lambda v: v != background))


def from_blocks(blocks: DataFrame, by: list[str]) -> DataFrame:
    return blocks.select(*by, "ox", F.posexplode("data").alias("i", "v")).select(*by, (F.col("ox") + F.col("i")).alias("x"), "v")


def downsampled(blocks: DataFrame, by: list[str], factor: int) -> DataFrame:
    """The next level of lines of blocks: means of neighbouring voxels."""
    x = from_blocks(blocks, by)
    return x.groupBy(*by, F.floor(F.col("x") / factor).alias("x")).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") == factor).drop("n")


def write(blocks: DataFrame, path: str) -> None:
    """Blocks as Parquet, a folder per level and setup, so that a reader of one prunes the others."""
    blocks.write.mode("overwrite").partitionBy("level", "setup").parquet(path)


def split_view(voxels: DataFrame, parts: DataFrame) -> DataFrame:
    """Voxels of virtual sub-views (setup, new_setup, from, to) in their own coordinates."""
    out = voxels.join(parts.select("setup", "new_setup", "from", "to"), "setup").where(F.col("x").between(F.col("from"), F.col("to")))
    return out.select(F.col("new_setup").alias("setup"), (F.col("x") - F.col("from")).alias("x"), "v")


class _Chunk(InputPartition):
    def __init__(self, file: str, offset: int, count: int):
        self.file, self.offset, self.count = file, offset, count


class RawVolumeSource(DataSource):
    """Raw volumes as a data source `rawvolume`: little-endian samples, x fastest; a partition per run of planes.

    Options: path (a file, or a folder of .raw files), dims `sx,sy,sz`, type (uint8, uint16, float32), planes per chunk.
    """

    @classmethod
    def name(cls) -> str:
        return "rawvolume"

    def schema(self) -> str:
        return "file string, oz long, nx int, ny int, nz int, data array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RawVolumeReader(self.options)


class _RawVolumeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind, self.planes = options["path"], options.get("type", "uint16"), int(options.get("planes", "16"))
        self.dims = [int(x) for x in options["dims"].split(",")]

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self):
        from pyarrow import fs

        store, path = self._store()
        info = store.get_file_info(path)
        files = [path] if info.is_file else sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".raw"))
        return [_Chunk(f, z, min(self.planes, self.dims[2] - z)) for f in files for z in range(0, self.dims[2], self.planes)]

    def read(self, chunk):
        import numpy as np

        kind = np.dtype(self.kind).newbyteorder("<")
        plane = self.dims[0] * self.dims[1]
        store, _ = self._store()
        with store.open_input_file(chunk.file) as f:
            data = np.frombuffer(f.read_at(plane * chunk.count * kind.itemsize, plane * chunk.offset * kind.itemsize), kind)
        if len(data) != plane * chunk.count:
            raise OSError(f"{chunk.file} is shorter than its dimensions say")
        from lumiframe.sources.images import _row

        yield _row("file string, oz long, nx int, ny int, nz int, data array<float>", [chunk.file, chunk.offset, self.dims[0], self.dims[1], chunk.count], data)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawVolumeSource)


def count_blocks(dims: list[int], block: list[int]) -> int:
    return math.prod(-(-d // b) for d, b in zip(dims, block, strict=True))
