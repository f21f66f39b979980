"""Queries over image stores, boxes of points and made-up points."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from lumiframe.operators import boxes, fusion
from lumiframe.plans import bindings as B
from lumiframe.plans.bindings import sql
from lumiframe.plans.q_sources import scratch
from lumiframe.plans.registry import query
from lumiframe.sources import blocks as K
from lumiframe.sources import images as I

R = F.round
ROUNDED = "SELECT CAST(i.i AS BIGINT) AS x, s.setup, floor(least(65535, greatest(0, coalesce((SELECT v FROM voxel w WHERE w.setup = s.setup AND w.x = i.i), 0) * 100)) + 0.5)::DOUBLE AS v FROM range(256) i(i), (SELECT DISTINCT setup FROM voxel) s"


def planes(spark, d):
    """All small images as the rows of one array (setup, x) in blocks of 3 x 50."""
    v = B.voxel(spark, d).select("setup", "x", (F.col("v") * 100).alias("v"))
    dims = spark.createDataFrame([(256, 8, 1)], "sx long, sy long, sz long")
    grid = K.grid(dims, (50, 3, 1))
    cells = v.groupBy((F.col("setup") / 3).cast("int").cast("long").alias("gy"), (F.col("x") / 50).cast("int").cast("long").alias("gx")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("setup") * 256 + F.col("x")).cast("long"), "v"))).alias("m"))
    place = lambda i: ((F.col("oy") + F.floor(i / F.col("nx"))) * 256 + F.col("ox") + F.pmod(i, F.col("nx"))).cast("long")
    data = F.transform(F.sequence(F.lit(0), F.col("nx") * F.col("ny") - 1), lambda i: F.coalesce(F.try_element_at(F.col("m"), place(i)), F.lit(0.0)))
    return grid.join(cells, ["gx", "gy"]).withColumn("data", data)


@query(sql(f"SELECT setup, x, v FROM ({ROUNDED}) WHERE v <> 0", "voxel"))
def chunked_array_round_trip(spark, d):
    """Written as compressed chunks and read again by the data source, a partition per chunk."""
    path = scratch(spark)
    I.write_zarr(planes(spark, d), path, [1, 8, 256], [1, 3, 50], "<u2", {"id": "zlib", "level": 1})
    I.register(spark)
    b = spark.read.format("zarrarray").option("path", path).load()
    out = b.select("ox", "oy", "nx", F.posexplode("data").alias("i", "v"))
    return out.select((F.col("oy") + F.floor(F.col("i") / F.col("nx"))).cast("int").alias("setup"), (F.col("ox") + F.pmod("i", "nx")).alias("x"), "v").where("v <> 0")


@query(sql("SELECT setup, CAST(x AS BIGINT) AS x, round(CAST(v AS FLOAT)::DOUBLE, 4) AS v FROM voxel", "voxel"))
def tiff_round_trip(spark, d):
    path = scratch(spark)
    line = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(-1.0)))
    s = B.voxel(spark, d).groupBy("setup").agg(F.map_from_entries(F.collect_list(F.struct("x", "v"))).alias("m"))
    I.write_tiff(s.select(F.format_string("s%d", "setup").alias("name"), F.lit(64).alias("nx"), F.lit(2).alias("ny"), F.lit(2).alias("nz"), line.alias("data")), path)
    I.register(spark)
    b = spark.read.format("tiffstack").option("path", path).load()
    setup = F.regexp_extract("array", r"/s(\d+)\.tif$", 1).cast("int")
    return b.select(setup.alias("setup"), "oz", F.posexplode("data").alias("i", "v")).where("v <> -1").select("setup", (F.col("oz") * 128 + F.col("i")).alias("x"), R("v", 4).alias("v"))


@query(sql("WITH p AS (SELECT setup, row_number() OVER (PARTITION BY setup ORDER BY tp, label, id) AS id, x, y, z FROM point), q AS (SELECT a.setup, a.id AS id_a, b.id AS id_b, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2 FROM p a JOIN p b ON a.setup = b.setup AND a.id < b.id) SELECT setup, round(max(d2), 5) AS d2 FROM q GROUP BY setup", "point"))
def farthest_points(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("setup").orderBy("tp", "label", "id")
    p = B.interest_point(spark, d).withColumn("id", F.row_number().over(w)).select("setup", "id", "x", "y", "z")
    return boxes.farthest_pairs(p, ["setup"]).select("setup", R("d2", 5).alias("d2"))


@query(sql("SELECT count(*) AS points, count(*) AS inside, true AS no_larger FROM point", "point"))
def smallest_box(spark, d):
    """The box holds all points, and isn't larger than that along the axes."""
    p = B.interest_point(spark, d).select(F.xxhash64("tp", "setup", "label", "id").alias("id"), (F.col("x") + F.col("y")).alias("x"), (F.col("y") - F.col("x")).alias("y"), "z")
    b = boxes.smallest_box(p)
    at = [F.col("x") * r[0] + F.col("y") * r[1] + F.col("z") * r[2] for r in b["rotation"]]
    inside = functools.reduce(lambda x, y: x & y, [a.between(lo - 1e-6, hi + 1e-6) for a, lo, hi in zip(at, b["low"], b["high"], strict=True)])
    whole = functools.reduce(lambda x, y: x * y, [F.max(c) - F.min(c) for c in "xyz"])
    return p.agg(F.count(F.lit(1)).alias("points"), F.count_if(inside).alias("inside"), (whole >= b["volume"] - 1e-6).alias("no_larger"))


@query(sql("SELECT CAST(s.i AS INT) AS setup, count(*) AS n FROM range(20) s(i), range(30) k(i) WHERE k.i < CASE WHEN s.i IN (0, 19) THEN 15 ELSE 30 END GROUP BY s.i", "view_setup"))
def fake_points(spark, d):
    o = spark.range(19).select(F.col("id").cast("int").alias("setup_a"), (F.col("id") + 1).cast("int").alias("setup_b"), *[F.lit(0.0).alias(f"lo_{c}") for c in "xyz"], *[F.lit(9.0).alias(f"hi_{c}") for c in "xyz"])
    return boxes.add_fake_points(o, 15000.0, 1, 50, 0.5, "fake").groupBy("setup").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT setup, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM voxel WHERE CAST(concat('0x', substr(md5(concat('1,', setup, ',', x)), 1, 5)) AS BIGINT) < 524288 GROUP BY setup", "voxel"))
def approximate_min_max(spark, d):
    """Half of the voxels, chosen by a hash of their place."""
    return fusion.approximate_min_max(B.voxel(spark, d), ["setup"], 0.5).select("setup", R("lo", 6).alias("lo"), R("hi", 6).alias("hi"))


@query(sql("SELECT x, round(coalesce(max(CASE WHEN setup = 0 THEN least(255, v) END), 0), 5) AS r, round(coalesce(max(CASE WHEN setup = 1 THEN least(255, v) END), 0), 5) AS g, round(coalesce(max(CASE WHEN setup = 2 THEN least(255, v) END), 0), 5) AS b FROM voxel WHERE setup < 3 GROUP BY x", "voxel"))
def merge_rgb(spark, d):
    v = B.voxel(spark, d)
    one = lambda k: v.where(F.col("setup") == k)
    return fusion.merge_rgb(one(0), one(1), one(2), ["x"]).select("x", *[R(c, 5).alias(c) for c in "rgb"])
