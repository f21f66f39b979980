"""Volumes of voxels: interpolation, blocks, the views that a block needs, and fusion of blocks through affine maps."""

from __future__ import annotations

import functools
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiframe.functions import affine
from lumiframe.functions import kernels as K

AXES = ("x", "y", "z")
#: Edge of a block, and how far a place may lie beyond an image's border by rounding and still count as on it.
BLOCK, SLACK = (32, 32, 32), 1e-9


def bias_floor(voxels: DataFrame, least: float, value: str = "v") -> DataFrame:
    """Voxels whose value is `least` at least; a null value becomes it."""
    return voxels.withColumn(value, F.greatest(F.col(value), F.lit(float(least))))


def interpolate(at: DataFrame, voxels: DataFrame, by: list[str], places: dict[str, str], how: str = "linear", outside: float | None = None) -> DataFrame:
    """by, the places and v: the value of an image (by, whole coordinates, v) at places between its voxels.

    places: column of `at` by that of the voxels' coordinate; any number of axes. linear weighs the voxels around a place, of
    which those with weight must all be there; nearest takes the closest one, halves upwards. Elsewhere the value is
    `outside`. A place asked for several times has one row. Voxels join by equality, 2^n a place at most.
    """
    names = list(places)
    asked = at.select(*by, *names).where(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])).distinct()
    if how == "nearest":
        wanted = asked.select("*", *[F.floor(F.col(c) + 0.5).cast("long").alias(f"i_{k}") for c, k in places.items()], F.lit(1.0).alias("i_w"), F.lit(1).alias("i_n"))
    else:
        part = {c: F.col(c) - F.floor(c) for c in names}
        corners = []
        for corner in product((0, 1), repeat=len(names)):
            w = functools.reduce(lambda a, b: a * b, [part[c] if up else 1 - part[c] for c, up in zip(names, corner, strict=True)])
            corners.append(F.struct(*[(F.floor(c) + up).cast("long").alias(f"i_{places[c]}") for c, up in zip(names, corner, strict=True)], w.alias("i_w")))
        wanted = asked.select("*", F.filter(F.array(*corners), lambda c: c["i_w"] > 0).alias("i_c")).select("*", F.size("i_c").alias("i_n"), F.inline("i_c")).drop("i_c")
    image = voxels.select(*[F.col(c).alias(f"v_{c}") for c in by], *[F.col(c).cast("long").alias(f"v_{c}") for c in places.values()], F.col("v").alias("v_value"))
    on = [F.col(c) == F.col(f"v_{c}") for c in by] + [F.col(f"i_{c}") == F.col(f"v_{c}") for c in places.values()]
    met = wanted.join(image, on, "left").groupBy(*by, *names).agg(F.sum(F.col("i_w") * F.col("v_value")).alias("i_v"), F.count("v_value").alias("i_has"), F.max("i_n").alias("i_n"))
    other = F.lit(None).cast("double") if outside is None else F.lit(float(outside))
    return met.select(*by, *names, F.when(F.col("i_has") == F.col("i_n"), F.col("i_v")).otherwise(other).alias("v"))


def block_views(blocks: DataFrame, bounds: DataFrame, axes: list[str], grow: float, cell: float) -> DataFrame:
    """Pairs of blocks and views whose boxes (lo_x, hi_x, ...), the view's grown by some voxels, meet on the given axes.

    Both are dealt to cells of the first axis, and a pair is kept in the first cell that both cover.
    """
    first = axes[0]
    ends = [f"{e}_{c}" for c in axes for e in ("lo", "hi")]
    left = blocks.select("*", *[F.col(e).alias(f"b_{e}") for e in ends]).drop(*ends)
    right = bounds.withColumns({f"lo_{c}": F.col(f"lo_{c}") - grow for c in axes} | {f"hi_{c}": F.col(f"hi_{c}") + grow for c in axes})
    deal = lambda d, lo, hi, name: d.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
    left, right = deal(left, f"b_lo_{first}", f"b_hi_{first}", "b_cell"), deal(right, f"lo_{first}", f"hi_{first}", "v_cell")
    meets = functools.reduce(lambda a, b: a & b, [(F.col(f"lo_{c}") <= F.col(f"b_hi_{c}")) & (F.col(f"b_lo_{c}") <= F.col(f"hi_{c}")) for c in axes])
    once = F.floor(F.greatest(f"lo_{first}", f"b_lo_{first}") / cell) == F.col("b_cell")
    return left.join(right.hint("merge"), F.col("b_cell") == F.col("v_cell")).where(meets & once).drop("b_cell", "v_cell", *[f"b_{e}" for e in ends])


def to_blocks(voxels: DataFrame, by: list[str], size: tuple[int, int, int] = BLOCK, value: str = "v") -> DataFrame:
    """by, bx, `by`, bz, data: voxels (by, x, y, z from 0, a value) as blocks with x fastest; a missing voxel is 0.

    Voxels without a coordinate are left out; of several at one place the largest value counts.
    """
    n = size[0] * size[1] * size[2]
    kinds = ", ".join(f"`{c}` {dict(voxels.dtypes)[c]}" for c in by)
    at = [F.floor(F.col(c) / s).cast("int").alias(f"b{c}") for c, s in zip(AXES, size, strict=True)]
    place = F.pmod("x", F.lit(size[0])) + size[0] * (F.pmod("y", F.lit(size[1])) + size[1] * F.pmod("z", F.lit(size[2])))
    rows = voxels.where("x is not null and y is not null and z is not null").select(*by, *at, place.cast("int").alias("place"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))

    def work(g: pd.DataFrame) -> pd.DataFrame:
        data = np.full(n, -np.inf)
        np.maximum.at(data, g["place"].to_numpy(), g["v"].to_numpy())
        data[np.isneginf(data)] = 0.0
        return pd.DataFrame({**{c: [g[c].iloc[0]] for c in [*by, "bx", "by", "bz"]}, "data": [data.astype(np.float32)]})

    return rows.groupBy(*by, "bx", "by", "bz").applyInPandas(work, f"{kinds}, bx int, `by` int, bz int, data array<float>")


def from_blocks(blocks: DataFrame, by: list[str], size: tuple[int, int, int] = BLOCK) -> DataFrame:
    """Voxels (by, x, y, z, v) of blocks."""
    v = blocks.select(*by, "bx", "by", "bz", F.posexplode("data").alias("place", "v"))
    i = F.col("place")
    x, y, z = i % size[0], F.floor(i / size[0]) % size[1], F.floor(i / (size[0] * size[1]))
    return v.select(*by, *[(F.col(f"b{c}") * s + o).cast("int").alias(c) for c, s, o in zip(AXES, size, (x, y, z), strict=True)], "v")


#: Ways to combine the views of a voxel, and which of them weigh by the blending ramp and by content.
MODES = ("average", "blend", "content", "blend and content", "maximum", "lowest view", "highest view", "closest", "minimum", "sum")


def fuse_blocks(images: DataFrame, views: DataFrame, grid: DataFrame, mode: str = "blend", size: tuple[int, int, int] = BLOCK, input_size: tuple[int, int, int] = BLOCK, border: tuple[float, float, float] = (0, 0, 0), ramp: tuple[float, float, float] = (40, 40, 40), linear: bool = True, order: str = "setup", convert: tuple[float, float, int] | None = None, knots: DataFrame | None = None, step: float = 10.0, grow: float = 1.0) -> DataFrame:
    """bx, by, bz, data of the blocks of an output grid, fused from the views that meet them through their affine maps.

    images: tp, setup, bx, by, bz, data (blocks of input_size, x fastest), and `weight` of the same form for the content
    modes. views: tp, setup, m (from voxels to the world), sx, sy, sz, and the order's column. grid: bx, by, bz; a block's
    first voxel is at its number times `size`. Each world voxel is mapped back into a view and sampled there, n-linear or
    nearest; a view counts where the place is inside its image, less a border, and is weighed by a cosine ramp from the
    border inwards. Voxels without a view are 0, and so are blocks that no view meets, which have no row. convert: low,
    high and bits of whole numbers that the values are scaled to. Axes of a single voxel take no ramp, so planes fuse
    as volumes do.

    knots: tp, setup, gx, gy, gz, back: maps from the world into a view at the knots of a grid of so wide a `step` in the
    world, as non-rigid registration makes them; a voxel's map is then their n-linear blend, and views are looked for
    `grow` voxels beyond their own box. Blocks need the knots around them; a view without any is left out.

    The plan: blocks join views by cells; a pair's box, mapped back and grown by a voxel, tells the input blocks that
    it needs, which join by equality; a task holds what one output block needs. So blocks may have any size, and the
    result doesn't depend on it.
    """
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode}")
    content = "content" in mode
    lo, hi = affine.bounds(F.col("m"), [F.lit(0.0)] * 3, [(F.col(f"s{c}") - 1).cast("double") for c in AXES])
    ready = views.where("m is not null").select("tp", "setup", "m", *[F.col(f"s{c}").cast("int").alias(f"s{c}") for c in AXES], F.col(order).cast("long").alias("f_order"), affine.inverse(F.col("m")).alias("back"))
    ready = ready.where("back is not null").withColumns({f"lo_{c}": lo[i] for i, c in enumerate(AXES)} | {f"hi_{c}": hi[i] for i, c in enumerate(AXES)})
    out = grid.select(*[F.col(f"b{c}").alias(f"o{c}") for c in AXES]).distinct()
    out = out.select("*", *[e for c, s in zip(AXES, size, strict=True) for e in ((F.col(f"o{c}") * float(s)).alias(f"lo_{c}"), (F.col(f"o{c}") * float(s) + s - 1).alias(f"hi_{c}"))])
    pairs = block_views(out, ready, list(AXES), max(1.0, grow), float(size[0]))
    own = ["ox", "oy", "oz", "tp", "setup"]
    block = [F.col(f"o{c}") * float(s) for c, s in zip(AXES, size, strict=True)], [F.col(f"o{c}") * float(s) + (s - 1) for c, s in zip(AXES, size, strict=True)]
    if knots is None:
        b_lo, b_hi = affine.bounds(F.col("back"), *block)
        need = pairs.withColumns({f"b_lo{i}": b_lo[i] for i in range(3)} | {f"b_hi{i}": b_hi[i] for i in range(3)}).withColumn("knots", F.lit(None).cast("array<struct<gx:int,gy:int,gz:int,back:array<double>>>"))
    else:
        around = pairs
        for c, s in zip(AXES, size, strict=True):
            around = around.withColumn(f"g{c}", F.explode(F.sequence(F.floor(F.col(f"o{c}") * float(s) / step).cast("int"), (F.floor((F.col(f"o{c}") * float(s) + (s - 1)) / step) + 1).cast("int"))))
        maps = knots.select("tp", "setup", *[F.col(f"g{c}").cast("int").alias(f"g{c}") for c in AXES], F.col("back").alias("k_back"))
        met = around.join(maps, ["tp", "setup", "gx", "gy", "gz"])
        k_lo, k_hi = affine.bounds(F.col("k_back"), *block)
        # a blend of places lies between them, so the box of all knots' images has it
        seen = met.groupBy(*own).agg(F.collect_list(F.struct("gx", "gy", "gz", F.col("k_back").alias("back"))).alias("knots"), *[F.min(k_lo[i]).alias(f"b_lo{i}") for i in range(3)], *[F.max(k_hi[i]).alias(f"b_hi{i}") for i in range(3)])
        need = pairs.join(seen, own)
    for i, (c, s) in enumerate(zip(AXES, input_size, strict=True)):
        first = F.greatest(F.lit(0), F.floor((F.floor(f"b_lo{i}") - 1) / s))
        last = F.least(F.floor((F.col(f"s{c}") - 1) / s), F.floor((F.floor(f"b_hi{i}") + 2) / s))
        need = need.withColumns({f"f_{c}": first.cast("int"), f"l_{c}": last.cast("int")})
    need = need.where("f_x <= l_x and f_y <= l_y and f_z <= l_z")
    for c in AXES:
        need = need.withColumn(f"n{c}", F.explode(F.sequence(f"f_{c}", f"l_{c}")))
    need = need.select("ox", "oy", "oz", "tp", "setup", "back", "knots", "f_order", "sx", "sy", "sz", "nx", "ny", "nz")
    parts = images.select("tp", "setup", F.col("bx").alias("nx"), F.col("by").alias("ny"), F.col("bz").alias("nz"), "data", *(["weight"] if content else []))
    rows = need.join(parts, ["tp", "setup", "nx", "ny", "nz"])

    def work(g: pd.DataFrame) -> pd.DataFrame:
        origin = g[["ox", "oy", "oz"]].iloc[0].to_numpy(int) * size
        fused = _combine(g, origin, mode, size, input_size, border, ramp, linear, content, step)
        if convert is not None:
            low, high, bits = convert
            fused = np.clip(np.floor((fused - low) / (high - low) * ((1 << bits) - 1) + 0.5), 0, (1 << bits) - 1)
        return pd.DataFrame({"bx": [g["ox"].iloc[0]], "by": [g["oy"].iloc[0]], "bz": [g["oz"].iloc[0]], "data": [fused]})

    return rows.groupBy("ox", "oy", "oz").applyInPandas(work, "bx int, `by` int, bz int, data array<double>")


def _deformed(knots: list, step: float, world: np.ndarray) -> np.ndarray:
    """Places in a view of world places, by the maps at the knots around; a knot that isn't there has the nearest one's."""
    places = np.array([[k["gx"], k["gy"], k["gz"]] for k in knots], int)
    maps = np.stack([np.asarray(k["back"], float).reshape(3, 4) for k in knots])
    low, high = places.min(0), places.max(0)
    every = np.stack(np.meshgrid(*[np.arange(a, b + 1) for a, b in zip(low, high, strict=True)], indexing="ij"), -1)
    which, _ = K.nearest_rows(every.reshape(-1, 3).astype(float), places.astype(float))
    return K.blended_maps(maps[which].reshape(*every.shape[:3], 3, 4), low, step, world.astype(float))


def _combine(g: pd.DataFrame, origin: np.ndarray, mode: str, size, input_size, border, ramp, linear: bool, content: bool, step: float) -> np.ndarray:
    """One output block, x fastest, of the input blocks that its views need."""
    z, y, x = np.meshgrid(*[np.arange(n) for n in size[::-1]], indexing="ij")
    world = np.stack([x.ravel(), y.ravel(), z.ravel()], 1) + origin
    total, weights = np.zeros(len(world)), np.zeros(len(world))
    best, value = np.full(len(world), -np.inf), np.zeros(len(world))
    for _, v in sorted(g.groupby(["f_order", "tp", "setup"]), key=lambda kv: kv[0]):
        r = v.iloc[0]
        dims = np.array([r["sx"], r["sy"], r["sz"]], int)
        at = K.transform(np.asarray(r["back"], float).reshape(3, 4), world) if r["knots"] is None else _deformed(r["knots"], step, world)
        inside = ((at >= -SLACK) & (at <= dims - 1 + SLACK)).all(1)
        at = np.clip(at, 0, dims - 1)
        where = {(i, j, k): n for n, (i, j, k) in enumerate(zip(v["nx"], v["ny"], v["nz"], strict=True))}
        sampled = K.sample_blocks(at[inside], where, list(v["data"]), input_size, dims, linear)
        mask = np.ones(inside.sum())
        blend = mask.copy()
        for a in range(3):
            if dims[a] > 1:
                p = at[inside, a]
                mask *= (p >= border[a] - SLACK) & (p <= dims[a] - 1 - border[a] + SLACK)
                blend *= K.blend_weight(p, int(dims[a]), border[a], ramp[a])
        w = blend if mode in ("blend", "blend and content", "closest") else mask
        if content:
            w = w * K.sample_blocks(at[inside], where, list(v["weight"]), input_size, dims, True)
        i = np.flatnonzero(inside)
        if mode in ("average", "blend", "content", "blend and content"):
            total[i] += w * sampled
            weights[i] += w
            continue
        i, s, w = i[w > 0], sampled[w > 0], w[w > 0]
        if mode == "sum":
            value[i] += s
            continue
        # the view that wins has the largest rank, of equal ones the earliest; for the highest view, the last one
        rank = {"maximum": s, "minimum": -s, "closest": w}.get(mode, np.zeros(len(i)))
        better = rank >= best[i] if mode == "highest view" else rank > best[i]
        best[i[better]], value[i[better]] = rank[better], s[better]
    if mode in ("average", "blend", "content", "blend and content"):
        return np.divide(total, weights, out=np.zeros_like(total), where=weights > 0)
    return value
