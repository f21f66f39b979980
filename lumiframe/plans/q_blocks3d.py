"""Queries that fuse volumes block by block through affine maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumiframe.functions import affine
from lumiframe.operators import volume as V
from lumiframe.plans import bindings as B
from lumiframe.plans.q_fusion import RAMP_SQL, _lerp
from lumiframe.plans.registry import query

SIZE = (12, 7, 5)
#: Output voxels: blocks of 8 from -1 to 3 in x and y, one in z.
GRID = 8


def volumes(spark, d):
    """Four small volumes: setup, x, y, z, v, the mean quantity of the order lines of each place."""
    one = B.table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("setup"), (F.col("l_partkey") % 12).cast("int").alias("x"), (F.col("l_linenumber") - 1).cast("int").alias("y"), (F.col("l_orderkey") % 5).cast("int").alias("z"), F.col("l_quantity").alias("v"))
    return one.groupBy("setup", "x", "y", "z").agg(F.avg("v").alias("v"))


VOLUMES = "SELECT CAST(l_suppkey % 4 AS INT) AS setup, CAST(l_partkey % 12 AS INT) AS x, CAST(l_linenumber - 1 AS INT) AS y, CAST(l_orderkey % 5 AS INT) AS z, avg(l_quantity)::FLOAT::DOUBLE AS v FROM lineitem GROUP BY ALL"
#: Cosine, sine and place of each view: turned about the axis z.
PLACES = [(0, 1.0, 0.0, 0.0, 0.0, 0.0), (1, 0.8, 0.6, 9.5, -2.0, 1.25), (2, 0.6, 0.8, 6.0, 3.0, 0.5), (3, 1.0, 0.0, 4.25, 1.5, 2.0)]


def views(spark, d):
    rows = [(0, k, [c, -s, 0.0, x, s, c, 0.0, y, 0.0, 0.0, 1.0, z], *SIZE) for k, c, s, x, y, z in PLACES]
    return spark.createDataFrame(rows, "tp int, setup int, m array<double>, sx int, sy int, sz int")


def fused(spark, d, mode, plane=False, linear=True, ramp=3.0, border=0.45, block=8, **how):
    v = volumes(spark, d)
    w = views(spark, d)
    if plane:
        v, w = v.where("z = 0"), w.withColumns({"sz": F.lit(1), "m": F.transform("m", lambda x, i: F.when(i == 11, 0.0).otherwise(x))})
    images = V.to_blocks(v.withColumn("tp", F.lit(0)), ["tp", "setup"], (4, 4, 4))
    first, stop = -GRID // block, -(-4 * GRID // block)
    n, deep = stop - first, -(-GRID // block)
    cells = spark.range(n * n).select((F.col("id") % n + first).cast("int").alias("bx"), (F.floor(F.col("id") / n) + first).cast("int").alias("by"), F.explode(F.sequence(F.lit(0), F.lit(deep - 1))).alias("bz"))
    size = (block, block, block)
    out = V.fuse_blocks(images, w, cells, mode, size, (4, 4, 4), (border,) * 3, (ramp,) * 3, linear, **how)
    return V.from_blocks(out, [], size).select("x", "y", "z", F.round(F.col("v") + 1e-9, 4).alias("v")).where("v <> 0")


def _fused_sql(mode: str, plane: bool = False, linear: bool = True, ramp: float = 3.0, border: float = 0.45) -> str:
    """The same fusion voxel by voxel: every output voxel mapped back into every view."""
    dims = [SIZE[0], SIZE[1], 1 if plane else SIZE[2]]
    places = ", ".join(f"({k}, {c}::DOUBLE, {s}::DOUBLE, {x}::DOUBLE, {y}::DOUBLE, {0 if plane else z}::DOUBLE)" for k, c, s, x, y, z in PLACES)
    axes = list(zip(("px", "py", "pz"), dims, strict=True))
    inside = " AND ".join(f"{p} BETWEEN -1e-9 AND {n - 1} + 1e-9" for p, n in axes)
    clip = ", ".join(f"greatest(0, least({n - 1}, {p})) AS {p}" for p, n in axes)
    base = lambda p, n: f"least(floor({p}), {max(n - 2, 0)})" if linear else f"least(floor({p} + 0.5), {n - 1})"
    ups = "SELECT a, b, c FROM range(2) x(a), range(2) y(b), range(2) z(c)" if linear else "SELECT 0 AS a, 0 AS b, 0 AS c"
    part = lambda p, n, u: f"CASE WHEN {u} = 1 THEN {p} - {base(p, n)} ELSE 1 - ({p} - {base(p, n)}) END" if linear else "1"
    w = " * ".join(f"({part(p, n, u)})" for (p, n), u in zip(axes, "abc", strict=True))
    corner = " AND ".join(f"g.{c} = least({base(p, n)} + u.{u}, {n - 1})" for c, (p, n), u in zip("xyz", axes, "abc", strict=True))
    mask = " * ".join(f"CASE WHEN {p} BETWEEN {border} - 1e-9 AND {n - 1 - border} + 1e-9 THEN 1 ELSE 0 END" for p, n in axes if n > 1)
    blend = " * ".join(f"CASE WHEN {p} < {border} OR {p} >= {n - 1 - border} THEN 0 WHEN {p} < {(n - 1) / 2} THEN {_lerp(f'({p} - {border}) / {ramp}')} ELSE {_lerp(f'({n - 1 - border} - {p}) / {ramp}')} END" for p, n in axes if n > 1)
    weight = blend if mode in ("blend", "closest") else mask
    total = {"blend": "sum(w * s) / sum(w)", "average": "sum(w * s) / sum(w)", "maximum": "max(s)", "minimum": "min(s)", "sum": "sum(s)", "lowest view": "arg_min(s, setup)", "highest view": "arg_max(s, setup)", "closest": "arg_max(s, (w, -setup))"}[mode]
    return f"""WITH g AS MATERIALIZED ({VOLUMES}), v(setup, c, s, tx, ty, tz) AS (VALUES {places}), r AS (SELECT {RAMP_SQL} AS t),
 o AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM range(-8, 32) a(x), range(-8, 32) b(y), range(0, 8) c(z)),
 m AS (SELECT o.*, v.setup, c * (x - tx) + s * (y - ty) AS px, c * (y - ty) - s * (x - tx) AS py, z - tz AS pz FROM o, v),
 i AS MATERIALIZED (SELECT x, y, z, setup, {clip} FROM m WHERE {inside}),
 n AS (SELECT i.x, i.y, i.z, i.setup, sum(({w}) * coalesce(g.v, 0)) AS s FROM i CROSS JOIN ({ups}) u LEFT JOIN g ON g.setup = i.setup AND {corner} GROUP BY ALL),
 k AS (SELECT n.*, {weight} AS w FROM n JOIN i USING (x, y, z, setup), r)
 SELECT * FROM (SELECT x, y, z, round({total} + 1e-9, 4) AS v FROM k WHERE w > 0 GROUP BY x, y, z) WHERE v <> 0"""


@query(_fused_sql("blend"))
def fuse_blocks(spark, d):
    """Grid, overlap, inverse map, n-linear sampling, cosine blending and weighted average in one plan."""
    return fused(spark, d, "blend")


@query(_fused_sql("average"))
def fuse_blocks_average(spark, d):
    return fused(spark, d, "average", block=5)


@query(_fused_sql("maximum"))
def fuse_blocks_maximum(spark, d):
    return fused(spark, d, "maximum")


@query(_fused_sql("lowest view"))
def fuse_blocks_lowest(spark, d):
    return fused(spark, d, "lowest view")


@query(_fused_sql("highest view"))
def fuse_blocks_highest(spark, d):
    return fused(spark, d, "highest view")


@query(_fused_sql("minimum", plane=True))
def fuse_plane_minimum(spark, d):
    """Images of a single plane: the least value of the views."""
    return fused(spark, d, "minimum", plane=True)


@query(_fused_sql("sum", plane=True))
def fuse_plane_sum(spark, d):
    return fused(spark, d, "sum", plane=True)


@query(_fused_sql("blend"))
def fuse_deformed(spark, d):
    """Through a grid of maps that all are the view's own, fusion is as without a grid."""
    back = affine.inverse(F.col("m"))
    k = views(spark, d).select("tp", "setup", back.alias("back"))
    for c, ends in zip("xyz", ((-2, 7), (-2, 7), (0, 2)), strict=True):
        k = k.withColumn(f"g{c}", F.explode(F.sequence(*map(F.lit, ends))))
    return fused(spark, d, "blend", knots=k, step=5.0, grow=4.0)
