"""Export of fused volumes: an interface with several writers, and multi-level OME-Zarr."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.operators.iterate import materialize
from lumiframe.sources import images
from lumiframe.sources.blocks import pyramid


def next_level(blocks: DataFrame, size: tuple[int, int, int], dims: list[int], factors: list[int], by: list[str]) -> DataFrame:
    """Blocks (by, bx, by, bz, data, x fastest) of the level that is smaller by factors: means of the voxels of a cell; dims are the finer level's.

    An incomplete last cell is dropped, as sizes are divided down; blocks that aren't there count as zeros. Blocks
    join those that their voxels end up in, so a task holds one block of the new level and its sources.
    """
    small = [max(1, d // f) for d, f in zip(dims, factors, strict=True)]
    kinds = "".join(f"`{c}` {dict(blocks.dtypes)[c]}, " for c in by)
    up = blocks
    for c, s, f in zip("xyz", size, factors, strict=True):
        first = F.floor(F.col(f"b{c}") * s / f / s)
        last = F.floor(((F.col(f"b{c}") + 1) * s - 1) / f / s)
        up = up.withColumn(f"n{c}", F.explode(F.sequence(first.cast("int"), last.cast("int"))))

    def work(g: pd.DataFrame) -> pd.DataFrame:
        own = g[["nx", "ny", "nz"]].iloc[0].to_numpy(int)
        total = np.zeros(size[::-1])
        for r in g.itertuples():
            at = np.array([r.bx, getattr(r, "by"), r.bz]) * size
            v = np.asarray(r.data, float).reshape(size[::-1])
            place = [(np.arange(n) + a) // f - o * n for n, a, f, o in zip(size, at, factors, own, strict=True)]
            ok = [(p >= 0) & (p < n) & (p + o * n < m) for p, n, o, m in zip(place, size, own, small, strict=True)]
            z, y, x = np.meshgrid(place[2][ok[2]], place[1][ok[1]], place[0][ok[0]], indexing="ij")
            np.add.at(total, (z, y, x), v[np.ix_(ok[2], ok[1], ok[0])])
        return pd.DataFrame({**{c: [g[c].iloc[0]] for c in keys}, "bx": [own[0]], "by": [own[1]], "bz": [own[2]], "data": [(total / np.prod(factors)).ravel()]})

    keys = by
    fits = [(F.col(f"n{c}") * s < m) for c, s, m in zip("xyz", size, small, strict=True)]
    return up.where(fits[0] & fits[1] & fits[2]).groupBy(*by, "nx", "ny", "nz").applyInPandas(work, f"{kinds}bx int, `by` int, bz int, data array<double>")


def write_ome_zarr(blocks: DataFrame, path: str, dims: list[int], size: tuple[int, int, int], factors: list[list[int]], kind: str = "<f4", compressor: dict | None = None, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), unit: str = "micrometer") -> list[list[int]]:
    """Blocks (bx, by, bz, data) of one volume as OME-Zarr: s0 and a level for each of the factors (relative to s0), with `multiscales` metadata.

    Each level is made of the one before, which is written out; chunks of zeros alone are left out. Returns the levels' sizes.
    """
    steps = [[1, 1, 1], *factors]
    sizes = pyramid(dims, factors)
    store, at = images.open_store(path)
    level = materialize(blocks.select("bx", "by", "bz", "data"))
    for i, d in enumerate(sizes):
        if i:
            ratio = [a // b for a, b in zip(steps[i], steps[i - 1], strict=True)]
            level = materialize(next_level(level, size, sizes[i - 1], ratio, []))
        inside = [F.least(F.lit(s), F.lit(n) - F.col(f"b{c}") * s).cast("int").alias(f"n{c}") for c, s, n in zip("xyz", size, d, strict=True)]
        cut = level.select(*[F.col(f"b{c}").cast("long").alias(f"g{c}") for c in "xyz"], *inside, "data").where("nx > 0 and ny > 0 and nz > 0")
        x = F.transform(F.sequence(F.lit(0), F.col("nx") * F.col("ny") * F.col("nz") - 1), lambda k: F.get("data", (k % F.col("nx") + size[0] * (F.floor(k / F.col("nx")) % F.col("ny") + size[1] * F.floor(k / (F.col("nx") * F.col("ny"))))).cast("int")))
        images.write_zarr(cut.withColumn("data", x), f"{path}/s{i}", d[::-1], list(size[::-1]), kind, compressor)
    axes = [{"name": c, "type": "space", "unit": unit} for c in "zyx"]
    scale = lambda f: [v * k for v, k in zip(voxel[::-1], f[::-1], strict=True)]
    # a coarser voxel's centre lies half its surplus further in
    shift = lambda f: [v * (k - 1) / 2 for v, k in zip(voxel[::-1], f[::-1], strict=True)]
    sets = [{"path": f"s{i}", "coordinateTransformations": [{"type": "scale", "scale": scale(f)}, {"type": "translation", "translation": shift(f)}]} for i, f in enumerate(steps)]
    images.put_file(store, f"{at}/.zgroup", json.dumps({"zarr_format": 2}).encode())
    images.put_file(store, f"{at}/.zattrs", json.dumps({"multiscales": [{"version": "0.4", "name": at.rpartition("/")[2], "axes": axes, "datasets": sets}]}).encode())
    return sizes


def read_ome_zarr(spark: SparkSession, path: str, level: int = 0) -> tuple[DataFrame, list[float]]:
    """Blocks of one level of an OME-Zarr volume, and its scale in x, y, z."""
    store, at = images.open_store(path)
    with store.open_input_file(f"{at}/.zattrs") as f:
        d = json.loads(f.read())["multiscales"][0]["datasets"][level]
    images.register(spark)
    scale = next(t["scale"] for t in d["coordinateTransformations"] if t["type"] == "scale")
    return spark.read.format("zarrarray").option("path", f"{path}/{d['path']}").load(), scale[::-1][:3]


#: Writers of fused volumes by title: write(blocks, path, title, dims, size, **how) of the blocks of one group.
WRITERS: dict[str, Callable] = {}


def writer(title: str):
    def put(f: Callable) -> Callable:
        WRITERS[title] = f
        return f

    return put


@writer("OME-Zarr")
def _zarr(blocks: DataFrame, path: str, title: str, dims: list[int], size: tuple[int, int, int], factors: list[list[int]] | None = None, **how) -> str:
    write_ome_zarr(blocks, f"{path}/{title}.ome.zarr", dims, size, factors or [], **how)
    return f"{path}/{title}.ome.zarr"


@writer("blocks")
def _parquet(blocks: DataFrame, path: str, title: str, dims: list[int], size: tuple[int, int, int], factors: list[list[int]] | None = None) -> str:
    sizes, level = pyramid(dims, factors or []), materialize(blocks.select("bx", "by", "bz", "data"))
    steps = [[1, 1, 1], *(factors or [])]
    for i in range(len(sizes)):
        if i:
            level = materialize(next_level(level, size, sizes[i - 1], [a // b for a, b in zip(steps[i], steps[i - 1], strict=True)], []))
        level.write.mode("overwrite").parquet(f"{path}/{title}/level={i}")
    return f"{path}/{title}"


@writer("TIFF planes")
def _tiff(blocks: DataFrame, path: str, title: str, dims: list[int], size: tuple[int, int, int], factors: list[list[int]] | None = None) -> str:
    """A TIFF per plane of the volume; a task holds one plane."""
    place = F.floor(F.col("i") / size[0])
    v = blocks.select("bx", "by", "bz", F.posexplode("data").alias("i", "v"))
    v = v.select((F.col("bx") * size[0] + F.col("i") % size[0]).alias("x"), (F.col("by") * size[1] + place % size[1]).alias("y"), (F.col("bz") * size[2] + F.floor(place / size[1])).alias("z"), "v").where((F.col("x") < dims[0]) & (F.col("y") < dims[1]) & (F.col("z") < dims[2]) & (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("z") >= 0))
    wide, high = dims[0], dims[1]

    def work(g: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((high, wide), np.float32)
        plane[g["y"].to_numpy(int), g["x"].to_numpy(int)] = g["v"].to_numpy()
        return pd.DataFrame({"name": [f"{title}_z{int(g['z'].iloc[0]):05d}"], "nx": [wide], "ny": [high], "nz": [1], "data": [plane.ravel().astype(float)]})

    images.write_tiff(v.groupBy("z").applyInPandas(work, "name string, nx int, ny int, nz int, data array<double>"), path)
    return path


class Export:
    """Export of fused groups in turn: export() each one's blocks, then finish()."""

    def __init__(self, title: str, path: str, size: tuple[int, int, int] = (32, 32, 32), factors: list[list[int]] | None = None, **how):
        if title not in WRITERS:
            raise ValueError(f"no such writer: {title}; there are {sorted(WRITERS)}")
        self.writer, self.path, self.size, self.factors, self.how = title, path, size, factors, how
        self.written: list[str] = []

    def block_size(self) -> tuple[int, int, int]:
        return self.size

    def export(self, blocks: DataFrame, title: str, dims: list[int]) -> str:
        """Write the blocks (bx, by, bz from 0, data of block_size(), x fastest) of one volume; returns where it is."""
        self.written.append(WRITERS[self.writer](blocks, self.path, title, dims, self.size, factors=self.factors, **self.how))
        return self.written[-1]

    def finish(self) -> list[str]:
        """All volumes that were written."""
        return self.written


def resave(images_: DataFrame, path: str, views: DataFrame, size: tuple[int, int, int], factors: list[list[int]], kind: str = "<f4") -> list[str]:
    """Each view's blocks (tp, setup, bx, by, bz, data) as OME-Zarr of its own; views: tp, setup, sx, sy, sz, a few rows, worked off in turn."""
    out = []
    for v in views.orderBy("tp", "setup").collect():
        own = images_.where((F.col("tp") == v["tp"]) & (F.col("setup") == v["setup"]))
        name = f"{path}/setup{v['setup']}/timepoint{v['tp']}"
        write_ome_zarr(own, name, [v["sx"], v["sy"], v["sz"]], size, factors, kind)
        out.append(name)
    return out
