"""Queries over fusion, downsampling and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumiframe.operators import fusion as E
from lumiframe.plans import bindings as B
from lumiframe.plans.bindings import gauss_sql, sql
from lumiframe.plans.registry import query

#: Border and ramp of the blending weight of the images here, which are 51 long.
BORDER, WIDTH, SIZE = 1.0, 12.0, 51


def placed(spark, d):
    """Voxels of all views in world cells, with blend weight and mask; the view's place is a translation."""
    v = B.voxel2(spark, d)
    size = F.lit(float(SIZE))
    cell = F.floor(F.col("x") + (7 * F.col("setup")) % 50 + 0.5).cast("long")
    return v.select("setup", cell.alias("cx"), "v", E.blend_weight(F.col("x"), size, BORDER, WIDTH).alias("w"), E.mask_weight(F.col("x"), size, 5.0).alias("mask"))


RAMP_SQL = "(SELECT list_transform(range(31), lambda i: (cos((1 - i / 30.0) * pi()) + 1) / 2))"


def _lerp(dist: str) -> str:
    at = f"(least(greatest({dist}, 0.0), 1.0) * 30)"
    i = f"least(CAST(floor({at}) AS BIGINT), 29)"
    return f"(t[{i} + 1] + (t[{i} + 2] - t[{i} + 1]) * ({at} - {i}))"


PLACED = f"""WITH r AS (SELECT {RAMP_SQL} AS t), p AS (SELECT setup, CAST(floor(x + (7 * setup) % 50 + 0.5) AS BIGINT) AS cx, v,
 CASE WHEN x < 1 OR x >= 49 THEN 0 WHEN x < 13 THEN {_lerp('(x - 1) / 12')} WHEN x < 37 THEN 1 ELSE {_lerp('(49 - x) / 12')} END::DOUBLE AS w,
 CASE WHEN x BETWEEN 5 AND 45 THEN 1 ELSE 0 END::DOUBLE AS mask FROM voxel2, r) """


@query(sql(PLACED + "SELECT cx, round(CASE WHEN sum(w) <> 0 THEN sum(w * v) / sum(w) ELSE 0 END, 5) AS fused, count(*) FILTER (w > 0) AS n FROM p GROUP BY cx", "voxel2"))
def fuse_avg_blend(spark, d):
    return E.weighted_average(placed(spark, d), ["cx"]).select("cx", F.round("fused", 5).alias("fused"), "n")


@query(sql(PLACED + "SELECT cx, round(CASE WHEN sum(mask) <> 0 THEN sum(mask * v) / sum(mask) ELSE 0 END, 5) AS fused, count(*) FILTER (mask > 0) AS n FROM p GROUP BY cx", "voxel2"))
def fuse_avg(spark, d):
    return E.weighted_average(placed(spark, d), ["cx"], weight="mask").select("cx", F.round("fused", 5).alias("fused"), "n")


@query(sql(PLACED + "SELECT cx, coalesce(max(v) FILTER (mask > 0), 0) AS fused FROM p GROUP BY cx", "voxel2"))
def fuse_max(spark, d):
    return E.maximum(placed(spark, d), ["cx"])


@query(sql(PLACED + "SELECT cx, coalesce(arg_min(v, (setup, v)) FILTER (mask > 0), 0) AS fused FROM p GROUP BY cx", "voxel2"))
def fuse_lowest_view(spark, d):
    return E.by_order(placed(spark, d), ["cx"], "setup", True)


@query(sql(PLACED + "SELECT cx, coalesce(arg_max(v, (setup, v)) FILTER (mask > 0), 0) AS fused FROM p GROUP BY cx", "voxel2"))
def fuse_highest_view(spark, d):
    return E.by_order(placed(spark, d), ["cx"], "setup", False)


@query(sql(PLACED + "SELECT cx, coalesce(arg_max(v, (round(w, 9), -setup, -v)) FILTER (w > 0), 0) AS fused FROM p GROUP BY cx", "voxel2"))
def fuse_closest(spark, d):
    return E.closest(placed(spark, d).withColumn("w", F.round("w", 9)), ["cx"], "setup")


@query(sql(PLACED + "SELECT setup, cx, v, mask FROM p", "voxel2"))
def mask_weight(spark, d):
    return placed(spark, d).select("setup", "cx", "v", "mask")


#: Content weights of lines: Gaussians of 2 and 8 voxels.
CONTENT = f"""WITH g AS ({gauss_sql("line", "v", 2.0)}), e AS MATERIALIZED (SELECT l.setup, l.x, (l.v - g.g) ** 2 AS e FROM line l JOIN g ON g.setup = l.setup AND g.x = l.x),
 h AS ({gauss_sql("e", "e", 8.0)}), c AS (SELECT l.setup, l.x, l.v, h.g / 2048 AS w0 FROM line l JOIN h ON h.setup = l.setup AND h.x = l.x)"""


def weighed(spark, d):
    return E.content_weight(B.line(spark, d), ["setup"], "x", "v", 2.0, 8.0, 64)


@query(sql(CONTENT + " SELECT x, round(CASE WHEN sum(m) <> 0 THEN sum(m * v) / sum(m) ELSE 0 END, 5) AS fused, count(*) FILTER (m > 0) AS n FROM (SELECT *, w0 * CASE WHEN x BETWEEN 5 AND 250 THEN 1 ELSE 0 END AS m FROM c) GROUP BY x", "line"))
def fuse_avg_content(spark, d):
    """The product of the content weight and the mask, in blocks of 64."""
    v = weighed(spark, d).withColumn("w", F.col("content") * E.mask_weight(F.col("x").cast("double"), F.lit(256.0), 5.0))
    return E.weighted_average(v, ["x"]).select("x", F.round("fused", 5).alias("fused"), "n")


@query(sql(CONTENT + f""", r AS (SELECT {RAMP_SQL} AS t),
 b AS (SELECT c.*, w0 * CASE WHEN x < 1 OR x >= 254 THEN 0 WHEN x < 41 THEN {_lerp('(x - 1) / 40.0')} WHEN x < 214 THEN 1 ELSE {_lerp('(254 - x) / 40.0')} END AS w FROM c, r)
 SELECT x, round(CASE WHEN sum(w) <> 0 THEN sum(w * v) / sum(w) ELSE 0 END, 5) AS fused, count(*) FILTER (w > 0) AS n FROM b GROUP BY x""", "line"))
def fuse_avg_blend_content(spark, d):
    """The product of the content and the blending weight."""
    v = weighed(spark, d)
    v = v.withColumn("w", F.col("content") * E.blend_weight(F.col("x").cast("double"), F.lit(256.0), 1.0, 40.0))
    return E.weighted_average(v, ["x"]).select("x", F.round("fused", 5).alias("fused"), "n")


@query(sql("SELECT setup, x, CAST(least(255, greatest(0, floor((v - 900) / (100000 - 900) * 255 + 0.5))) AS INT) AS b8, CAST(least(65535, greatest(0, floor((v - 900) / (100000 - 900) * 65535 + 0.5))) AS INT) AS b16 FROM voxel2", "voxel2"))
def convert_output(spark, d):
    return B.voxel2(spark, d).select("setup", "x", E.convert(F.col("v"), 900.0, 100000.0, 8).alias("b8"), E.convert(F.col("v"), 900.0, 100000.0, 16).alias("b16"))


@query(sql("SELECT setup, q.i AS \"at\", CAST(greatest(0, least(q.i, sx - 1)) AS BIGINT) AS x FROM view_setup, range(-3, 70) q(i)", "view_setup"))
def edge_extension(spark, d):
    s = B.view_setup(spark, d).withColumn("at", F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(69).cast("long"))))
    return s.select("setup", "at", E.edge_clamp(F.col("at"), F.col("sx")).alias("x"))


@query(sql("SELECT setup, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM voxel GROUP BY setup", "voxel"))
def image_min_max(spark, d):
    return E.min_max(B.voxel(spark, d), ["setup"]).select("setup", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query(sql("SELECT setup, x, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS normal FROM voxel WINDOW w AS (PARTITION BY setup)", "voxel"))
def normalize_image(spark, d):
    return E.normalise(B.voxel(spark, d), ["setup"]).select("setup", "x", F.round("normal", 6).alias("normal"))


@query(sql("SELECT setup, CAST(x // 2 AS INT) AS x, round(avg(v), 6) AS v FROM voxel GROUP BY setup, x // 2 HAVING count(*) = 2", "voxel"))
def downsample_avg(spark, d):
    return E.half_average(B.voxel(spark, d), ["setup"]).select("setup", "x", F.round("v", 6).alias("v"))


@query(sql("WITH g AS (SELECT setup, row_number() OVER w - 1 AS p, (coalesce(lag(v) OVER w, v) / 2 + v + coalesce(lead(v) OVER w, v) / 2) / 2 AS s FROM voxel WINDOW w AS (PARTITION BY setup ORDER BY x)) SELECT setup, CAST(p // 2 AS INT) AS x, round(s, 6) AS v FROM g WHERE p % 2 = 0", "voxel"))
def downsample_gauss(spark, d):
    return E.half_gauss(B.voxel(spark, d), ["setup"]).select("setup", "x", F.round("v", 6).alias("v"))


@query("SELECT CAST(f AS INT) AS factor, CAST(floor(log2(f) + 1e-9) AS INT) AS n FROM range(1, 20) t(f)")
def downsample_halvings(spark, d):
    return spark.createDataFrame([(f, E.halvings(f)) for f in range(1, 20)], "factor int, n int")


@query(sql("SELECT tp, setup, CAST(floor(x) AS BIGINT) AS cx, max(intensity) AS v FROM point GROUP BY ALL", "point"))
def max_project(spark, d):
    p = B.interest_point(spark, d).select("tp", "setup", F.floor("x").alias("cx"), F.col("intensity").alias("v"))
    return E.project_maximum(p, ["tp", "setup", "cx"])


@query(sql("SELECT tp, setup FROM view WHERE tp = 2", "view"))
def deformation_views(spark, d):
    v = B.view(spark, d)
    return E.views_for_deformation(v, v.where("tp = 2 and channel = 0"), False).select("tp", "setup")


@query(sql("SELECT setup, x, round(10 * sqrt(v * v + x * x), 4) AS d FROM voxel", "voxel"))
def deformation_distance(spark, d):
    """Length of a displacement, scaled for display."""
    return B.voxel(spark, d).select("setup", "x", F.round(E.displacement([F.col("v"), F.col("x")], 10.0), 4).alias("d"))
