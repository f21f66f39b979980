"""Deconvolution, weights, point spread functions, image quality. Voxel steps are expressions; blocks go to dense kernels."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.functions import kernels as K
from lumiframe.operators.iterate import materialize


def quotient(image: Column, blurred: Column) -> Column:
    """Observed over expected; 1 where nothing was observed or is expected."""
    return F.when((image > 0) & (blurred != 0), image / blurred).otherwise(1.0)


def update(last: Column, integral: Column, weight: Column, top: float, damping: float, least: float = 1e-4) -> Column:
    """Next estimate: last x integral, damped, not below `least`, and approached by the weight's share."""
    v = last * integral / F.lit(top)
    t = v if damping == 0 else (F.sqrt(1 + 2 * damping * F.greatest(v, F.lit(0.0))) - 1) / damping
    adjusted = F.when((v > 0) & ~F.isnan(v), F.greatest(F.lit(least), t * top)).otherwise(least)
    return last + (adjusted - last) * weight


def multiplicative_update(last: Column, integrals: list[Column], weights: list[Column]) -> Column:
    """Geometric mean of the views' factors by weight, the sum of weights at most 1."""
    total = sum(weights[1:], weights[0])
    scale = F.when(total > 1, 1 / total).otherwise(1.0)
    return last * F.exp(sum((w * scale * F.ln(F.greatest(i, F.lit(1e-12))) for w, i in zip(weights, integrals, strict=True)), F.lit(0.0)))


def change(estimates: DataFrame, last: str, after: str, by: list[str]) -> DataFrame:
    """Signed sum and largest of the changes."""
    d = F.col(after) - F.col(last)
    return estimates.groupBy(*by).agg(F.sum(d).alias("total"), F.max(d).alias("largest"))


def normalise_weights(weights: DataFrame, voxel: list[str], weight: str = "w", smooth: bool = False, speed: float = 1.0) -> DataFrame:
    """Weights of a voxel's views, which add up to 1 at most.

    Hard: each by the sum of the weights, capped at 1 each, where that is above 1. Smooth: weights near their share are
    lowered a little. Times the speed-up, at most 1; 0 where the sum is 0.
    """
    w = F.least(F.lit(1.0), F.col(weight))
    total = F.sum(w).over(Window.partitionBy(*voxel))
    if smooth:
        ideal = w / total
        y = F.greatest(F.lit(0.0), (F.lit(0.1) - F.abs(w - ideal)) / 0.1)
        out = F.least(w, ideal) - y * w * 0.05
    else:
        out = F.when(total > 1, w / total).otherwise(w)
    return weights.withColumn("normal", F.when(total <= 0, 0.0).otherwise(F.least(F.lit(1.0), out * speed)))


def initial_estimate(voxels: DataFrame, voxel: list[str], how: str, blur: float = 0.0, given: DataFrame | None = None) -> DataFrame:
    """The voxels' first estimate psi.

    blurred fused: the weighted average per voxel, with `blur` then softened along the first axis of `voxel`. average: the
    mean of all views' means everywhere; approximate average: the mean over the voxels in the middle of the first axis.
    given: psi of a table (voxel, psi), 1 where it has none.
    """
    every = voxels.select(*voxel).distinct()
    if how == "given":
        return every.join(given.select(*voxel, F.col("psi").alias("g_psi")), voxel, "left").select(*voxel, F.coalesce("g_psi", F.lit(1.0)).alias("psi"))
    if how in ("average", "approximate average"):
        rows = voxels
        if how == "approximate average":
            ends = voxels.agg(F.floor((F.min(voxel[0]) + F.max(voxel[0])) / 2).alias("e_middle"))
            rows = voxels.join(F.broadcast(ends), F.col(voxel[0]) == F.col("e_middle"))  # one row
        mean = rows.agg(F.avg("v").alias("psi"))
        return every.crossJoin(F.broadcast(mean))  # one row
    if how != "blurred fused":
        raise ValueError(f"no such estimate: {how}")
    t = F.sum("w")
    fused = voxels.groupBy(*voxel).agg(F.when(t > 0, F.sum(F.col("w") * F.col("v")) / t).otherwise(1.0).alias("psi"))
    if blur <= 0:
        return fused
    return gauss_line(fused, voxel[1:], voxel[0], "psi", blur).withColumnRenamed("soft", "psi")


def group_inputs(voxels: DataFrame, by: list[str], group: str) -> DataFrame:
    """by, group, v, w: a group's views as one: their average where they overlap, by weight, and the sum of their weights."""
    t = F.sum("w")
    return voxels.groupBy(*by, group).agg(F.when(t > 0, F.sum(F.col("w") * F.col("v")) / t).otherwise(0.0).alias("v"), t.alias("w"))


def batches(blocks: DataFrame, places: list[str]) -> DataFrame:
    """Blocks with the number of a batch, 0 to 2^n - 1: no two blocks of a batch are neighbours, so they may be written at the same time."""
    return blocks.withColumn("batch", sum(((F.pmod(F.col(c), F.lit(2)) * (1 << i)) for i, c in enumerate(places)), F.lit(0)).cast("int"))


def block_grid(lengths: tuple[int, int, int], block: tuple[int, int, int], kernel: tuple[int, int, int]) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """Effective size and halo of blocks of a fixed size, or of one that covers the whole where it is larger: block - kernel + 1, and half a kernel."""
    halo = tuple(k // 2 for k in kernel)
    effective = tuple(min(n, b - k + 1) for n, b, k in zip(lengths, block, kernel, strict=True))
    if min(effective) < 1:
        raise ValueError("blocks are larger than their kernels")
    return effective, halo


def blocks(length: int, effective: int, halo: int) -> list[tuple[int, int, int, int]]:
    """Blocks of a line: where each one's own part starts and stops, and where the part it reads does."""
    return [(s, min(length, s + effective), s - halo, min(length, s + effective) + halo) for s in range(0, length, effective)]


def with_halo(cells: DataFrame, axis: str, effective: int, halo: int) -> DataFrame:
    """Cells dealt to every block that reads them, marked where they are the block's own."""
    x = F.col(axis)
    first, last = F.floor((x - halo) / effective), F.floor((x + halo) / effective)
    dealt = cells.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    return dealt.withColumn("own", F.floor(x / effective) == F.col("block"))


def blockwise(cells: DataFrame, by: list[str], axis: str, value: str, effective: int, halo: int, kernel, name: str) -> DataFrame:
    """A kernel on lines of values, block by block with a halo; rows of a block's own part come back with the result."""
    dealt = with_halo(cells.select(*by, axis, value), axis, effective, halo)
    dtypes = dict(cells.dtypes)
    kinds = ", ".join(f"`{c}` {dtypes[c]}" for c in [*by, axis])

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(axis)
        out = kernel(g[value].to_numpy(float))
        return g.assign(**{name: out})[g["own"].to_numpy(bool)][[*by, axis, name]]

    return dealt.where(F.col("block").isNotNull()).groupBy(*by, "block").applyInPandas(work, f"{kinds}, `{name}` double")


def gauss_line(cells: DataFrame, by: list[str], axis: str, value: str, sigma: float, effective: int = 4096) -> DataFrame:
    """Gaussian along a line in blocks; their halo is the kernel's reach, so that block edges don't show."""
    return blockwise(cells, by, axis, value, effective, len(K.gauss_kernel(sigma)) // 2, lambda v: K.gauss(v, sigma), "soft")


def detect_blobs(images: DataFrame, sigma: float = 1.8, threshold: float = 0.01) -> DataFrame:
    """Bright blobs of blocked images (block, ox, oy, oz, nx, ny, nz, data, lo, hi): place and response, refined below a pixel.

    data has x fastest. Blocks carry their halo; each is handled by itself.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for r in df.itertuples():
                image = np.asarray(r.data, float).reshape(r.nz, r.ny, r.nx)
                image = image if r.nz > 1 else image[0]
                d = K.dog(image, sigma, r.lo, r.hi)
                for p in K.local_minima(d, threshold / 3):
                    at, value = K.refine(d, p)
                    if abs(value) > threshold:
                        zyx = at if image.ndim == 3 else np.concatenate([[0.0], at])
                        out.append((r.block, zyx[2] + r.ox, zyx[1] + r.oy, zyx[0] + r.oz, value))
            yield pd.DataFrame(out, columns=["block", "x", "y", "z", "response"]).astype({"block": "int64", "x": float, "y": float, "z": float, "response": float})

    return images.mapInPandas(run, "block long, x double, y double, z double, response double")


def content_weight_blocks(images: DataFrame, small: float, large: float) -> DataFrame:
    """block and content weights of blocked images."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            yield pd.DataFrame({"block": df["block"], "weight": [K.content_weights(np.asarray(r.data, float).reshape(r.nz, r.ny, r.nx).squeeze(), small, large).ravel().tolist() for r in df.itertuples()]})

    return images.mapInPandas(run, "block long, weight array<double>")


def update_kernels(psfs: DataFrame, kind: str) -> DataFrame:
    """grp, view, data: the kernels that spread a view's ratios back, of the psfs (grp, view, data) of each group's views."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("view")
        every = [np.asarray(x, float) for x in g["data"]]
        return g[["grp", "view"]].assign(data=[K.psf_pair(every, v, kind)[1].tolist() for v in range(len(every))])

    return psfs.groupBy("grp").applyInPandas(work, "grp long, view int, data array<double>")


def deconvolve_lines(cells: DataFrame, by: list[str], axis: str, psfs: list[list[float]], rounds: int, kind: str = "optimization II", damping: float = 0.006, least: float = 1e-4, effective: int = 4096) -> DataFrame:
    """by, axis, psi: multi-view Richardson-Lucy along lines, block by block, as if each line were whole.

    cells: by, axis (whole places without gaps), view (0 to the number of psfs less one), v, w, a row for each view of
    every place; a null value or weight is 0. Every round reads the last one's estimate of all blocks: a block gets its
    neighbours' places as far as a round's kernels reach through all views, and gives back its own part, so results
    don't depend on the blocks. The estimate starts at the mean of a line's values. It is written out each round, and a
    task holds one block of all views.
    """
    kernels = [np.asarray(p, float) for p in psfs]
    pairs = [K.psf_pair(kernels, v, kind) for v in range(len(kernels))]
    halo = sum(len(a) // 2 + len(b) // 2 for a, b in pairs)
    dtypes = dict(cells.dtypes)
    kinds = ", ".join(f"`{c}` {dtypes[c]}" for c in [*by, axis])
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    views = range(len(kernels))
    pick = lambda c, v: F.max(F.when(F.col("view") == v, value(c)))
    wide = materialize(cells.groupBy(*by, axis).agg(*[F.coalesce(pick(c, v), F.lit(0.0)).alias(f"{c}{v}") for v in views for c in "vw"]))
    each = [F.col(f"v{v}") for v in views]
    start = wide.groupBy(*by).agg(F.greatest(F.lit(least), sum((F.avg(c) for c in each[1:]), F.avg(each[0])) / len(each)).alias("d_first"), F.greatest(*[F.max(c) for c in each], F.lit(least)).alias("d_top"))
    start = materialize(start.select(*[F.col(c).alias(f"d_{c}") for c in by], "d_first", "d_top"))
    images = wide.join(start, functools.reduce(lambda a, b: a & b, [F.col(c) == F.col(f"d_{c}") for c in by])).drop(*[f"d_{c}" for c in by])
    images = materialize(with_halo(images, axis, effective, halo))
    psi = images.where("own").select(*by, axis, F.col("d_first").alias("psi"))

    def work(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        g, p = g.sort_values(axis), p.sort_values(axis)
        x = p["psi"].to_numpy(float)
        out = K.deconvolve_round(x, [g[f"v{v}"].to_numpy(float) for v in views], [g[f"w{v}"].to_numpy(float) for v in views], pairs, float(g["d_top"].iloc[0]), least, damping)
        own = g["own"].to_numpy(bool)
        return g[own][[*by, axis]].assign(psi=out[own])

    for _ in range(rounds):
        now = with_halo(psi, axis, effective, halo)
        psi = materialize(images.groupBy(*by, "block").cogroup(now.groupBy(*by, "block")).applyInPandas(work, f"{kinds}, psi double"))
    return psi.select(*by, axis, "psi")


def psf_extract(voxels: DataFrame, points: DataFrame, radius: int, axis: str = "x") -> DataFrame:
    """Mean neighbourhood of the points of each view: offset, value, less the least and over the most; an aggregate of a join."""
    at = points.select("setup", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("offset"), F.col(axis).alias("centre")).withColumn(axis, (F.col("centre") + F.col("offset")).cast(dict(voxels.dtypes)[axis]))
    s = at.join(voxels, ["setup", axis]).groupBy("setup", "offset").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("setup")
    v = F.col("total") / F.col("n")
    s = s.withColumn("mean", v)
    return s.withColumn("psf", F.coalesce(F.try_divide(F.col("mean") - F.min("mean").over(w), F.max("mean").over(w) - F.min("mean").over(w)), F.lit(0.0))).select("setup", "offset", "psf")


def psf_extract_volume(voxels: DataFrame, points: DataFrame, radius: tuple[int, int, int], remove_minima: bool = False) -> DataFrame:
    """setup, dx, dy, dz, psf: sum of the neighbourhoods of the points (setup, x, y, z) in their images (setup, x, y, z, v), scaled to [0, 1].

    Neighbourhoods are sampled n-linearly at the points' own places, 0 outside the image. remove_minima: on each axis in
    turn, the least value along it is taken off first.
    """
    from lumiframe.operators.volume import interpolate

    at = points.where("x is not null and y is not null and z is not null")
    for c, r in zip("xyz", radius, strict=True):
        at = at.withColumn(f"d{c}", F.explode(F.sequence(F.lit(-r), F.lit(r)))).withColumn(f"p{c}", F.col(c).cast("double") + F.col(f"d{c}"))
    places = {"px": "x", "py": "y", "pz": "z"}
    values = interpolate(at, voxels, ["setup"], places, outside=0.0)
    own = ["setup", "dx", "dy", "dz"]
    out = at.select(*own, *places).join(values, ["setup", *places]).groupBy(*own).agg(F.sum("v").alias("psf"))
    if remove_minima:
        for c in "xyz":
            along = Window.partitionBy("setup", *[f"d{o}" for o in "xyz" if o != c])
            out = out.withColumn("psf", F.col("psf") - F.min("psf").over(along))
    w = Window.partitionBy("setup")
    lo, hi = F.min("psf").over(w), F.max("psf").over(w)
    return out.withColumn("psf", F.coalesce(F.try_divide(F.col("psf") - lo, hi - lo), F.lit(0.0)))


def quality_places(volumes: DataFrame, distance: int, step_z: int, first_z: int, square: int | None = None, tolerance: float = 0.0) -> DataFrame:
    """volumes (sx, sy, sz) with x, y, z of the centres of quality measurements: evenly spread squares of every `step_z`-th plane.

    Squares are as many as fit in `distance`, one more for a rest. square: tiles of that size instead, one more where the
    rest is at least `tolerance` of one. Planes run from first_z to sz - first_z, the end left out.
    """
    out = volumes
    for c in "xy":
        size = F.col(f"s{c}")
        if square is None:
            n = F.greatest(F.lit(1), F.floor(size / distance)) + F.when(size % distance > 0, 1).otherwise(0)
        else:
            whole = F.floor(size / square)
            n = whole + F.when(((size % square) / square >= tolerance) | (whole == 0), 1).otherwise(0)
        out = out.withColumn(f"q_{c}", n).withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"q_{c}") - 1)))
        out = out.withColumn(c, F.floor(size / (F.col(f"q_{c}") * 2.0) + F.col(c) * (size / F.col(f"q_{c}")) + 0.5)).drop(f"q_{c}")
    out = out.where(F.col("sz") - first_z > first_z)
    return out.withColumn("z", F.explode(F.sequence(F.lit(first_z).cast("long"), F.col("sz").cast("long") - first_z - 1, F.lit(step_z).cast("long"))))


def psf_average(psfs: DataFrame, common: str = "most") -> DataFrame:
    """Mean of point spread functions aligned at their centres; over the largest extent (missing is 0), or the smallest."""
    n = psfs.agg(F.count_distinct("setup").alias("views"))
    out = psfs.groupBy("offset").agg(F.sum("psf").alias("total"), F.count(F.lit(1)).alias("has")).crossJoin(F.broadcast(n))  # one row
    out = out if common == "most" else out.where("has = views")
    return out.select("offset", (F.col("total") / F.col("views")).alias("psf"))


def ring_correlations(tiles: DataFrame, size: int) -> DataFrame:
    """location, ring, value of pairs of square tiles (location, first, second, both row by row)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            for r in df.itertuples():
                c = K.ring_correlation(np.asarray(r.first, float).reshape(size, size), np.asarray(r.second, float).reshape(size, size))
                yield pd.DataFrame({"location": r.location, "ring": np.arange(1, len(c) + 1), "value": c})

    return tiles.mapInPandas(run, "location long, ring int, value double")


def crossings(curve: DataFrame, by: list[str], at: str, value: str, threshold: Column) -> DataFrame:
    """Places where a curve falls below its threshold, on the straight lines between its points."""
    w = Window.partitionBy(*by).orderBy(at)
    c = curve.withColumn("d", F.col(value) - threshold)
    c = c.withColumns({"d0": F.lag("d").over(w), "x0": F.lag(at).over(w)})
    return c.where("d0 > 0 and d <= 0").select(*by, (F.col("x0") + (F.col(at) - F.col("x0")) * F.col("d0") / (F.col("d0") - F.col("d"))).alias("crossing"))


def resolution(crossing: Column, rings: int) -> Column:
    """Resolution in pixels of a crossing."""
    return 2 * (rings + 1) / crossing


def thresholds(kind: str, n: Column) -> Column:
    """Curves that a correlation must stay above: fixed, half-bit, three sigma; n is the number of samples of a ring."""
    if kind == "fixed":
        return F.lit(0.1428)
    r = F.sqrt(n)
    return (0.2071 * r + 1.9102) / (1.2071 * r + 0.9102) if kind == "half-bit" else 3 / F.sqrt(n / 2)


def flat_field(image: DataFrame, bright: DataFrame, dark: DataFrame, key: list[str], low: float, high: float) -> DataFrame:
    """(v - dark) x mean(bright - dark) / (bright - dark), 0 where that is 0, clamped to the type's range."""
    b = bright.select(*key, F.col("v").alias("bright")).join(dark.select(*key, F.col("v").alias("dark")), key)
    mean = b.agg(F.avg(F.col("bright") - F.col("dark")).alias("mean"))
    d = F.col("bright") - F.col("dark")
    out = image.join(b, key).crossJoin(F.broadcast(mean))  # one row
    v = F.when(d == 0, 0.0).otherwise((F.col("v") - F.col("dark")) * F.col("mean") / F.when(d != 0, d))
    return out.withColumn("v", F.least(F.lit(high), F.greatest(F.lit(low), v))).drop("bright", "dark", "mean")


def deform(points: DataFrame, matches: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Grid points (view, x, y, z) moved by the affine maps that moving least squares of a view's matches give there."""

    def work(g: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame({c: [] for c in ("view", "x", "y", "z", "wx", "wy", "wz")}).astype({"view": "int64"})
        at = g[["x", "y", "z"]].to_numpy(float)
        if len(m):
            f = K.moving_least_squares(at, m[["px", "py", "pz"]].to_numpy(float), m[["qx", "qy", "qz"]].to_numpy(float), alpha)
            moved = np.einsum("nij,nj->ni", f[:, :, :3], at) + f[:, :, 3]
        else:
            moved = at
        return g[["view", "x", "y", "z"]].assign(wx=moved[:, 0], wy=moved[:, 1], wz=moved[:, 2])

    return points.groupBy("view").cogroup(matches.groupBy("view")).applyInPandas(work, "view long, x double, y double, z double, wx double, wy double, wz double")


def unique_targets(links: DataFrame) -> DataFrame:
    """point, target place: points that correspondences connect, however long the way, share the mean of their world places.

    links: a, b (points as longs) with wx_a .. wz_b.
    """
    from lumiframe.operators.iterate import components

    found = components(links.select("a", "b"))
    ends = links.select(F.inline(F.array(*[F.struct(F.col(e).alias("point"), *[F.col(f"w{c}_{e}").alias(f"w{c}") for c in "xyz"]) for e in "ab"]))).dropDuplicates(["point"])
    w = Window.partitionBy("component")
    return ends.join(found, F.col("point") == F.col("node")).select("point", "component", *[F.avg(f"w{c}").over(w).alias(f"t{c}") for c in "xyz"])
