"""Tables of registrations: taking maps over, averages, axes of rotation, corrections of smaller levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiframe.functions import affine
from lumiframe.functions import kernels as K


def duplicate(models: DataFrame) -> DataFrame:
    """Views (tp, setup, m) with the map of their setup's first timepoint; other columns stay."""
    source = models.groupBy("setup").agg(F.min_by("m", "tp").alias("d_source"))
    return models.join(source, "setup").withColumn("m", F.col("d_source")).drop("d_source")


def average(models: DataFrame, by: list[str]) -> DataFrame:
    """by, m: the mean of each group's maps, cell by cell; null maps don't count, and a group of none has a null map."""
    cells = models.groupBy(*by).agg(*[F.avg(F.col("m")[i]).alias(f"c{i}") for i in range(12)])
    return cells.select(*by, F.when(F.col("c0").isNotNull(), F.array(*[f"c{i}" for i in range(12)])).alias("m"))


def rotation_axis(m: Column) -> tuple[list[Column], Column]:
    """Unit axis and angle in degrees, 0 to 180, of a map's rotation; without a rotation the axis is 0.

    The axis is the skew part of the matrix; at half a turn that vanishes, and the axis stands in the diagonal, its
    signs by the largest component being positive.
    """
    skew = [m[9] - m[6], m[2] - m[8], m[4] - m[1]]
    length = F.sqrt(skew[0] * skew[0] + skew[1] * skew[1] + skew[2] * skew[2])
    trace = m[0] + m[5] + m[10]
    flat = length < 1e-9
    half = flat & (trace < 0)
    size = [F.sqrt(F.greatest(F.lit(0.0), (m[5 * i] + 1) / 2)) for i in range(3)]
    big = F.greatest(*size)
    # the row of the largest component has the signs of the others
    row = [F.when(size[0] == big, m[j] if j else m[0] + 1).when(size[1] == big, m[4 + j] if j != 1 else m[5] + 1).otherwise(m[8 + j] if j != 2 else m[10] + 1) for j in range(3)]
    axis = [F.when(half, size[i] * F.when(row[i] < 0, -1.0).otherwise(1.0)).when(flat, 0.0).otherwise(skew[i] / length) for i in range(3)]
    return axis, F.degrees(F.atan2(length, trace - 1))


def mipmap_map(factors: list[Column]) -> Column:
    """Map from voxels to those of a level that is smaller by factors: pixel centres stay where they are."""
    nil = F.lit(0.0)
    f = [1 / x for x in factors]
    off = [(x - 1) / 2 for x in f]
    return affine.from_columns(f[0], nil, nil, off[0], nil, f[1], nil, off[1], nil, nil, f[2], off[2])


def map_back(views: DataFrame, model: str = "rigid") -> DataFrame:
    """Views with `back`: the map of a kind that takes four corners of the moved image to where they were, as well as it can."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            back = [K.map_back(np.asarray(m, float).reshape(3, 4), np.array(s, float), model).ravel().tolist() for m, s in zip(df["m"], df[["sx", "sy", "sz"]].to_numpy(), strict=True)]
            yield df[["tp", "setup"]].assign(back=back)

    rows = views.where("m is not null and sx is not null and sy is not null and sz is not null")
    return rows.select("tp", "setup", "m", "sx", "sy", "sz").mapInPandas(run, "tp int, setup int, back array<double>")
