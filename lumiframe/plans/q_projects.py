"""Queries over projects, datasets and exports: what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumiframe.operators import volume as V
from lumiframe.plans import bindings as B
from lumiframe.plans.bindings import sql
from lumiframe.plans.q_blocks3d import SIZE, VOLUMES, volumes
from lumiframe.plans.q_sources import scratch
from lumiframe.plans.registry import query
from lumiframe.sources import datasets, export
from lumiframe.sources import images as Z
from lumiframe.sources import project as P

R = F.round


def project(spark, d):
    """A project written as XML, and its tables read again."""
    path = scratch(spark) + "/dataset.xml"
    v = B.view(spark, d)
    boxes = spark.createDataFrame([("all", -1, -2, -3, 10, 20, 30), ("a & b", 0, 0, 0, 5, 5, 5)], "name string, min_x int, min_y int, min_z int, max_x int, max_y int, max_z int")
    points = B.interest_point(spark, d).select("tp", "setup", "label").distinct().join(v.select("tp", "setup"), ["tp", "setup"]).withColumns({"params": F.lit("sigma < 2"), "path": F.concat(F.lit("points/"), "label")})
    psfs = v.where("tp = 3").select("tp", "setup", F.format_string("psf/%d.tif", "setup").alias("path"))
    P.write_project(path, B.view_setup(spark, d), B.view_transform(spark, d), B.missing(spark, d), boxes, points, psfs, "0-6")
    return P.read_project(spark, path)


@query(sql("SELECT tp, setup, ord, name, i, round(v, 6) AS v FROM (SELECT tp, setup, 0 AS ord, 'shear' AS name, unnest(range(12)) AS i, unnest([1, 0.1::DOUBLE * (setup % 3), 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]) AS v FROM model UNION ALL SELECT tp, setup, 1, 'translation', unnest(range(12)), unnest([1, 0, 0, tx, 0, 1, 0, ty, 0, 0, 1, tz]) FROM model UNION ALL SELECT tp, setup, 2, 'calibration', unnest(range(12)), unnest([vx, 0, 0, 0, 0, vy, 0, 0, 0, 0, vz, 0]) FROM model)", "model"))
def project_registrations(spark, d):
    r = project(spark, d)["registrations"]
    return r.select("tp", "setup", "ord", "name", F.posexplode("m").alias("i", "v")).select("tp", "setup", "ord", "name", F.col("i").cast("long").alias("i"), R("v", 6).alias("v"))


@query(sql("""SELECT 'missing' AS section, CAST(tp AS VARCHAR) || ',' || setup AS what FROM all_view WHERE (tp + setup) % 13 = 0 UNION ALL SELECT 'boxes', * FROM (VALUES ('all,-1,-2,-3,10,20,30'), ('a & b,0,0,0,5,5,5')) t(w) UNION ALL SELECT 'timepoints', CAST(t AS VARCHAR) FROM range(7) r(t) UNION ALL SELECT 'psfs', concat('3,', setup, ',psf/', setup, '.tif') FROM view WHERE tp = 3
 UNION ALL SELECT DISTINCT 'points', concat(p.tp, ',', p.setup, ',', p.label, ',sigma < 2,points/', p.label) FROM point p JOIN view v ON v.tp = p.tp AND v.setup = p.setup UNION ALL SELECT 'setups', concat(setup, ',', channel, ',', tile, ',', sx, ',', sz, ',', unit) FROM view_setup""", "view_setup", "all_view", "view", "point"))
def project_sections(spark, d):
    t = project(spark, d)
    line = lambda name, *cols: t[name].select(F.lit(name).alias("section"), F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("what"))
    out = line("missing", "tp", "setup").unionByName(line("boxes", "name", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z")).unionByName(line("timepoints", "tp"))
    return out.unionByName(line("psfs", "tp", "setup", "path")).unionByName(line("points", "tp", "setup", "label", "params", "path")).unionByName(line("setups", "setup", "channel", "tile", "sx", "sz", "unit"))


@query(sql("SELECT tp, setup, label, id FROM point WHERE NOT (tp = 2 AND label = 'N') AND NOT (tp = 4 AND setup = 3)", "point"))
def points_after_delete(spark, d):
    """Deleted: all lists of a label at one timepoint, and one view's lists at another."""
    path = scratch(spark)
    P.write_points(B.interest_point(spark, d), path)
    P.delete_points(spark, path, tp=2, label="N")
    P.delete_points(spark, path, tp=4, setup=3)
    return P.read_points(spark, path).select("tp", "setup", "label", "id")


@query(sql("SELECT tp, setup, CAST(i % 3 AS INT) AS x, CAST(i // 3 % 3 AS INT) AS y, CAST(i // 9 AS INT) AS z, CAST(setup + i / 4.0 AS FLOAT)::DOUBLE AS v FROM view, range(45) r(i) WHERE tp = 1", "view"))
def psf_round_trip(spark, d):
    """Point spread functions as TIFF stacks."""
    path = scratch(spark)
    v = B.view(spark, d).where("tp = 1").select("tp", "setup", F.lit(3).alias("nx"), F.lit(3).alias("ny"), F.lit(5).alias("nz"), F.transform(F.sequence(F.lit(0), F.lit(44)), lambda i: F.col("setup") + i / 4.0).alias("data"))
    P.write_psfs(v, path)
    return P.read_psfs(spark, path)


@query(sql("SELECT tp, setup, CAST(c AS INT) AS cell, CASE WHEN c = 5 THEN 1 ELSE 0.5 + setup + c / 8.0 END::DOUBLE AS a, CASE WHEN c = 5 THEN 0 ELSE tp - c END::DOUBLE AS b FROM view, range(12) r(c)", "view"))
def fields_round_trip(spark, d):
    """Coefficient fields of 3 x 2 x 2 cells as chunked arrays of each view; a cell that isn't written is identity."""
    path = scratch(spark)
    v = B.view(spark, d).select("tp", "setup", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("cell"))
    f = v.where("cell <> 5").withColumns({"a": 0.5 + F.col("setup") + F.col("cell") / 8.0, "b": (F.col("tp") - F.col("cell")).cast("double")})
    P.write_fields(f, path, (3, 2, 2))
    return P.read_fields(B.all_views(spark, d), path)


def one_volume(spark, d):
    return V.to_blocks(volumes(spark, d).where("setup = 1"), ["setup"], (4, 4, 4))


LEVEL = f"WITH g AS MATERIALIZED ({VOLUMES}), f AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, coalesce((SELECT v FROM g WHERE g.setup = 1 AND g.x = a.x AND g.y = b.y AND g.z = c.z), 0) AS v FROM range(12) a(x), range(7) b(y), range(5) c(z))"


@query(LEVEL + " SELECT 0 AS level, x, y, z, round(v, 4) AS v FROM f WHERE v <> 0 UNION ALL SELECT 1, CAST(x // 2 AS INT), CAST(y // 2 AS INT), z, round(avg(v) + 1e-9, 4) FROM f WHERE x // 2 < 6 AND y // 2 < 3 GROUP BY ALL HAVING avg(v) <> 0 UNION ALL SELECT 2, CAST(x // 4 AS INT), CAST(y // 4 AS INT), CAST(z // 2 AS INT), round(avg(v) + 1e-9, 4) FROM f WHERE x // 4 < 3 AND y // 4 < 1 AND z // 2 < 2 GROUP BY x // 4, y // 4, z // 2 HAVING avg(v) <> 0".replace("z, round(avg(v) + 1e-9, 4) FROM f WHERE x // 2 < 6 AND y // 2 < 3 GROUP BY ALL", "z, round(avg(v) + 1e-9, 4) FROM f WHERE x // 2 < 6 AND y // 2 < 3 GROUP BY x // 2, y // 2, z"))
def ome_zarr_levels(spark, d):
    """A volume as OME-Zarr of three levels, each read through its `multiscales` entry."""
    e = export.Export("OME-Zarr", scratch(spark), (4, 4, 4), [[2, 2, 1], [4, 4, 2]], compressor={"id": "zlib"}, kind="<f8")
    path = e.export(one_volume(spark, d), "volume", list(SIZE))
    out = None
    for level in range(3):
        b, _ = export.read_ome_zarr(spark, path, level)
        i = F.col("i")
        v = b.select("ox", "oy", "oz", "nx", "ny", F.posexplode("data").alias("i", "v"))
        v = v.select(F.lit(level).alias("level"), (F.col("ox") + i % F.col("nx")).cast("int").alias("x"), (F.col("oy") + F.floor(i / F.col("nx")) % F.col("ny")).cast("int").alias("y"), (F.col("oz") + F.floor(i / (F.col("nx") * F.col("ny")))).cast("int").alias("z"), R(F.col("v") + F.lit(1e-9 if level else 0.0), 4).alias("v")).where("v <> 0")
        out = v if out is None else out.unionByName(v)
    return out


@query(LEVEL + " SELECT 'blocks' AS writer, sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END)::BIGINT AS n, round(sum(v), 2) AS total FROM f UNION ALL SELECT 'TIFF planes', sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END)::BIGINT, round(sum(v), 2) FROM f")
def export_writers(spark, d):
    """The same volume through the other writers."""
    b = one_volume(spark, d)
    path = export.Export("blocks", scratch(spark), (4, 4, 4)).export(b, "volume", list(SIZE))
    one = V.from_blocks(spark.read.parquet(f"{path}/level=0"), [], (4, 4, 4))
    folder = export.Export("TIFF planes", scratch(spark), (4, 4, 4)).export(b, "volume", list(SIZE))
    Z.register(spark)
    two = spark.read.format("tiffstack").option("path", folder).load().select(F.explode("data").alias("v"))
    sums = lambda t, n: t.agg(F.count_if(F.col("v") != 0).alias("n"), R(F.sum("v"), 2).alias("total")).select(F.lit(n).alias("writer"), "n", "total")
    return sums(one, "blocks").unionByName(sums(two, "TIFF planes"))


@query(sql("SELECT DISTINCT setup, setup % 3 AS tile, 8::BIGINT AS sx, 6::BIGINT AS sy, 2::BIGINT AS sz, 0.75::DOUBLE * 8 * (setup % 3) AS m3 FROM (SELECT CAST(i AS INT) AS setup FROM range(6) r(i)) s".replace("SELECT DISTINCT setup, setup % 3", "SELECT setup, setup % 3")))
def dataset_from_files(spark, d):
    """TIFF files whose names tell timepoint, channel and tile: views with sizes from their headers, and tiles placed on a grid."""
    path = scratch(spark)
    f = spark.range(12).select(F.format_string("img_t%d_c%d_tile%d", F.floor(F.col("id") / 6), F.floor(F.col("id") / 3) % 2, F.col("id") % 3).alias("name"), F.lit(8).alias("nx"), F.lit(6).alias("ny"), F.lit(2).alias("nz"), F.array_repeat(F.lit(1.0), 96).alias("data"))
    Z.write_tiff(f, path)
    t = datasets.create(spark, "file list", path, glob="*.tif", roles={0: "tp", 1: "channel", 2: "tile"}, grid=(3, 1, 0.25))
    m = t["registrations"].where("tp = 0").select("setup", F.col("m")[3].alias("m3"))
    return t["setups"].join(m, "setup").select("setup", "tile", "sx", "sy", "sz", "m3")


@query("SELECT 12::BIGINT AS sx, 7::BIGINT AS sy, 5::BIGINT AS sz, 0.5::DOUBLE AS vx, 2.0::DOUBLE AS vz, 'OME-Zarr' AS title")
def dataset_from_ome_zarr(spark, d):
    path = export.Export("OME-Zarr", scratch(spark), (4, 4, 4), voxel=(0.5, 0.5, 2.0)).export(one_volume(spark, d), "volume", list(SIZE))
    title = next(t for t in datasets.titles() if "Zarr" in t)
    return datasets.create(spark, title, path)["setups"].select("sx", "sy", "sz", "vx", "vz", F.lit(title).alias("title"))


@query(LEVEL.replace("g.setup = 1", "g.setup = 1") + " SELECT count(*) FILTER (v <> 0) AS n, round(sum(v), 2) AS total, 2 AS levels FROM f")
def resaved_views(spark, d):
    """Each view's blocks as OME-Zarr of its own; the second one's voxels read again."""
    images = V.to_blocks(volumes(spark, d).withColumn("tp", F.lit(0)), ["tp", "setup"], (4, 4, 4))
    views = spark.createDataFrame([(0, s, *SIZE) for s in (0, 1)], "tp int, setup int, sx int, sy int, sz int")
    names = export.resave(images, scratch(spark), views, (4, 4, 4), [[2, 2, 1]], "<f8")
    b, _ = export.read_ome_zarr(spark, names[1])
    return b.select(F.explode("data").alias("v")).agg(F.count_if(F.col("v") != 0).alias("n"), R(F.sum("v"), 2).alias("total")).withColumn("levels", F.lit(2))


