"""Fusion of overlapping views: weights per voxel, and the aggregates that combine views."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of the table that the cosine ramp is looked up in, less one.
RAMP = 30


def ramp(d: Column) -> Column:
    """Half a cosine wave from 0 to 1 for d in [0, 1], between RAMP + 1 points joined by straight lines."""
    table = F.array(*[F.lit((math.cos((1 - i / RAMP) * math.pi) + 1) / 2) for i in range(RAMP + 1)])
    at = F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0)) * RAMP
    i = F.least(F.floor(at).cast("int"), F.lit(RAMP - 1))
    lo, hi = F.element_at(table, i + 1), F.element_at(table, i + 2)
    return lo + (hi - lo) * (at - i)


def blend_weight(at: Column, size: Column, border: float, width: float) -> Column:
    """Weight of a place on one axis of an image: 0 in the border, a ramp over `width`, 1 within, and the same on the far side.

    Where the ramps would cross, they meet in the middle.
    """
    b0, b3 = F.lit(float(border)), size - 1 - border
    b1, b2 = F.lit(float(border + width)), size - 1 - border - width
    middle = (b1 + b2) / 2
    c1, c2 = F.when(b1 > b2, middle).otherwise(b1), F.when(b1 > b2, middle).otherwise(b2)
    return F.when((at < b0) | (at >= b3), 0.0).when(at < c1, ramp((at - b0) / width)).when(at < c2, 1.0).otherwise(ramp((b3 - at) / width))


def mask_weight(at: Column, size: Column, border: float) -> Column:
    """1 inside the border, else 0."""
    return F.when((at >= border) & (at <= size - 1 - border), 1.0).otherwise(0.0)


def weighted_average(voxels: DataFrame, by: list[str], value: str = "v", weight: str = "w") -> DataFrame:
    """Sum of weight x value over the sum of weights, 0 where that is 0; partial sums are formed before the shuffle."""
    total = F.sum(weight)
    return voxels.groupBy(*by).agg(F.when(total != 0, F.sum(F.col(weight) * F.col(value)) / total).otherwise(0.0).alias("fused"), F.count_if(F.col(weight) > 0).alias("n"))


def maximum(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Largest value of the views whose mask is set, 0 without any."""
    return voxels.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("mask") > 0, F.col("v"))), F.lit(0.0)).alias("fused"))


def by_order(voxels: DataFrame, by: list[str], order: str, lowest: bool) -> DataFrame:
    """Value of the first (or last) view of an order whose mask is set, 0 without any; equal places by value."""
    key = F.when(F.col("mask") > 0, F.struct(F.col(order), F.col("v")))
    pick = F.min_by("v", key) if lowest else F.max_by("v", key)
    return voxels.groupBy(*by).agg(F.coalesce(pick, F.lit(0.0)).alias("fused"))


def closest(voxels: DataFrame, by: list[str], order: str) -> DataFrame:
    """Value of the largest positive weight; of equal weights that of the earliest view, then the smallest value; 0 without any."""
    key = F.when(F.col("w") > 0, F.struct(F.col("w"), -F.col(order), -F.col("v")))
    return voxels.groupBy(*by).agg(F.coalesce(F.max_by("v", key), F.lit(0.0)).alias("fused"))


def convert(value: Column, low: float, high: float, bits: int) -> Column:
    """Linear conversion of [low, high] to whole numbers of so many bits, rounded half up and clamped."""
    most = (1 << bits) - 1
    return F.least(F.lit(most), F.greatest(F.lit(0), F.floor((value - low) / (high - low) * most + 0.5))).cast("int")


def edge_clamp(at: Column, size: Column) -> Column:
    """Coordinate of the nearest voxel of the image: its border is continued outwards."""
    return F.greatest(F.lit(0).cast("long"), F.least(at, size - 1))


def min_max(voxels: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    return voxels.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def normalise(voxels: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Values mapped so that each image's least is 0 and largest 1; a constant image is 0."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return voxels.withColumn("normal", F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.0)))


def half_average(voxels: DataFrame, by: list[str], axis: str = "x", value: str = "v", factor: int = 2) -> DataFrame:
    """Mean of each `factor` neighbouring voxels; an incomplete last group is dropped, as sizes are divided down."""
    out = voxels.groupBy(*by, F.floor(F.col(axis) / factor).cast("int").alias("cell")).agg(F.avg(value).alias("v"), F.count(F.lit(1)).alias("c"))
    return out.where(F.col("c") == factor).drop("c").withColumnRenamed("cell", axis)


def half_gauss(voxels: DataFrame, by: list[str], axis: str = "x", value: str = "v") -> DataFrame:
    """Every other voxel of (v0/2 + v1 + v2/2)/2 around it; the ends repeat."""
    w = Window.partitionBy(*by).orderBy(axis)
    v = F.col(value)
    before, after = F.coalesce(F.lag(value).over(w), v), F.coalesce(F.lead(value).over(w), v)
    return voxels.withColumns({"soft": (before / 2 + v + after / 2) / 2, "place": F.row_number().over(w) - 1}).where("place % 2 = 0").select(*by, (F.col("place") / 2).cast("int").alias(axis), F.col("soft").alias("v"))


def halvings(factor: int) -> int:
    """How often a volume is halved for a factor: the factor is divided by two while it is above 1, so 3 is as 2."""
    n = 0
    while factor > 1:
        factor //= 2
        n += 1
    return n


def project_maximum(voxels: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    return voxels.groupBy(*by).agg(F.max(value).alias("v"))


def views_for_deformation(views: DataFrame, fused: DataFrame, across_time: bool) -> DataFrame:
    """Present views of the fused views' timepoints; several timepoints ask for across_time."""
    times = fused.select("tp").distinct()
    if not across_time and times.count() > 1:
        raise ValueError("views of several timepoints are fused together only across time")
    return views.join(times, "tp", "left_semi")


def displacement(parts: list[Column], scale: float = 1.0) -> Column:
    """Length of a displacement, times a scale for display."""
    return scale * F.sqrt(sum((c * c for c in parts[1:]), parts[0] * parts[0]))


def content_weight(signal: DataFrame, by: list[str], axis: str, value: str, small: float = 20.0, large: float = 40.0, effective: int = 4096) -> DataFrame:
    """by, axis, value, content: local contrast along lines without gaps: a wide Gaussian of the squared difference from a narrow one, over 2048.

    Lines are handled block by block with a halo as far as both Gaussians reach; at a line's ends they see its mirror
    image. Volumes go to content_weight_blocks() of the restoration operators.
    """
    from lumiframe.functions import kernels as K
    from lumiframe.operators.restoration import blockwise

    halo = len(K.gauss_kernel(small)) // 2 + len(K.gauss_kernel(large)) // 2
    found = blockwise(signal, by, axis, value, effective, halo, lambda v: K.content_weights(v, small, large), "content")
    return signal.join(found, [*by, axis])


def approximate_min_max(voxels: DataFrame, by: list[str], share: float, value: str = "v", seed: int = 1) -> DataFrame:
    """Least and largest value of a share of each image's voxels, chosen by md5 of the seed and their place: bounds from within."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(",", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*by, "x"]])), 1, 5), 16, 10).cast("long")
    chosen = draw < int(share * (1 << 20))
    return min_max(voxels.where(chosen), by, value)


def merge_rgb(red: DataFrame, green: DataFrame, blue: DataFrame, key: list[str]) -> DataFrame:
    """Three fused images as one: values 0 to 255 by voxel, 0 where a colour has none."""
    tagged = [d.select(*key, F.lit(c).alias("colour"), "v") for c, d in (("r", red), ("g", green), ("b", blue))]
    both = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    pick = lambda c: F.coalesce(F.max(F.when(F.col("colour") == c, F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col("v"))))), F.lit(0.0)).alias(c)
    return both.groupBy(*key).agg(pick("r"), pick("g"), pick("b"))
