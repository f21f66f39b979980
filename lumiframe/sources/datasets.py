"""Dataset definitions: what makes the tables of a project from files, by title."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiframe.functions import affine
from lumiframe.sources import filenames

#: create(spark, path, **how) by title: the tables `files` (path, tp, setup), `setups` and `registrations` (tp, setup, m).
DEFINITIONS: dict[str, Callable[..., dict[str, DataFrame]]] = {}


def definition(title: str):
    def put(f: Callable) -> Callable:
        DEFINITIONS[title] = f
        return f

    return put


def titles() -> list[str]:
    return sorted(DEFINITIONS)


def create(spark: SparkSession, title: str, path: str, **how) -> dict[str, DataFrame]:
    """The tables of a dataset of a kind."""
    if title not in DEFINITIONS:
        raise ValueError(f"no such dataset: {title}; there are {titles()}")
    return DEFINITIONS[title](spark, path, **how)


def tiff_sizes(files: DataFrame) -> DataFrame:
    """files with sx, sy, sz from the pages' headers; the samples aren't read. Files that aren't TIFF have nulls."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lumiframe.sources.images import open_store, tiff_pages

        for df in parts:
            out = []
            for p in df["path"]:
                uri = p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p
                store, at = open_store(uri)
                try:
                    with store.open_input_file(at) as f:
                        pages = list(tiff_pages(f.read_at))
                    out.append((p, pages[0][256][0], pages[0][257][0], len(pages)))
                except (ValueError, IndexError, KeyError):
                    out.append((p, None, None, None))
            yield pd.DataFrame(out, columns=["path", "sx", "sy", "sz"]).astype({"sx": "Int64", "sy": "Int64", "sz": "Int64"})

    sizes = files.select("path").mapInPandas(run, "path string, sx long, sy long, sz long")
    return files.join(sizes, "path")


def place_tiles(setups: DataFrame, columns: int, rows: int, overlap: float, **order) -> DataFrame:
    """setup, m: translations that put the tiles (setup, tile from 0, sx, sy) on a regular grid, which overlap by a share of their size."""
    x, y = filenames.tile_place(F.col("tile"), columns, rows, **order)
    step = lambda at, size: at * F.col(size) * (1.0 - overlap)
    return setups.select("setup", affine.translation(step(x, "sx"), step(y, "sy"), F.lit(0.0)).alias("m"))


@definition("file list")
def file_list(spark: SparkSession, path: str, glob: str = "*", roles: dict[int, str] | None = None, grid: tuple[int, int, float] | None = None, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), **order) -> dict[str, DataFrame]:
    """Files whose names share a pattern: the numbers that `roles` names (position -> attribute) tell views apart.

    Sizes come from the files (TIFF). grid: columns, rows and overlap of the tiles, which are then placed by their `tile`
    number; without it all registrations are identity. Attributes without a role are 0.
    """
    found = tiff_sizes(filenames.file_list(spark, path, glob))
    found = filenames.views_from_names(found, roles or {})
    for c in ("channel", "angle", "illumination", "tile"):
        if c not in found.columns:
            found = found.withColumn(c, F.lit(0))
    setups = found.groupBy("setup").agg(*[F.min(c).alias(c) for c in ("channel", "angle", "illumination", "tile", "sx", "sy", "sz")])
    setups = setups.withColumns({f"v{c}": F.lit(v) for c, v in zip("xyz", voxel, strict=True)}).withColumn("unit", F.lit("um"))
    places = place_tiles(setups, *grid, **order) if grid else setups.select("setup", affine.literal(affine.IDENTITY).alias("m"))
    files = found.select("path", "tp", "setup")
    return {"files": files, "setups": setups, "registrations": files.select("tp", "setup").join(places, "setup")}


@definition("OME-Zarr")
def ome_zarr(spark: SparkSession, path: str, voxel: tuple[float, float, float] | None = None) -> dict[str, DataFrame]:
    """One OME-Zarr volume as a view: its size from s0, its voxel size from the first level's scale."""
    import json

    from lumiframe.sources.images import open_store

    store, at = open_store(path)
    with store.open_input_file(f"{at}/.zattrs") as f:
        d = json.loads(f.read())["multiscales"][0]["datasets"][0]
    with store.open_input_file(f"{at}/{d['path']}/.zarray") as f:
        shape = json.loads(f.read())["shape"][-3:]
    scale = voxel or next((tuple(t["scale"][::-1][:3]) for t in d.get("coordinateTransformations", []) if t["type"] == "scale"), (1.0, 1.0, 1.0))
    setups = spark.createDataFrame([(0, 0, 0, 0, 0, *shape[::-1], *map(float, scale), "um")], "setup int, channel int, angle int, illumination int, tile int, sx long, sy long, sz long, vx double, vy double, vz double, unit string")
    files = spark.createDataFrame([(f"{path}/{d['path']}", 0, 0)], "path string, tp int, setup int")
    return {"files": files, "setups": setups, "registrations": files.select("tp", "setup", affine.literal(affine.IDENTITY).alias("m"))}


@definition("TIFF stacks")
def tiff_stacks(spark: SparkSession, path: str, **how) -> dict[str, DataFrame]:
    """A folder of TIFF stacks, a view each unless `roles` says otherwise."""
    return file_list(spark, path, "*.tif", **({"roles": {0: "tile"}} | how))
