"""Queries over maps, boxes and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumiframe.functions import affine
from lumiframe.operators import boxes, spatial, transforms, volume
from lumiframe.plans import bindings as B
from lumiframe.plans.bindings import sql
from lumiframe.plans.registry import query

XYZ = ("x", "y", "z")


def rounded(*names, digits=6):
    return [F.round(n, digits).alias(n) for n in names]


def m_columns(c="m"):
    return [F.round(F.col(c)[i], 6).alias(f"m{i}") for i in range(12)]


@query(sql("SELECT p.tp, p.setup, p.label, p.id, round(p.x + m.tx, 6) AS x, round(p.y + m.ty, 6) AS y, round(p.z + m.tz, 6) AS z FROM point p JOIN model m ON p.tp = m.tp AND p.setup = m.setup", "point", "model"))
def apply_affine(spark, d):
    p = B.interest_point(spark, d).join(B.view_model(spark, d).select("tp", "setup", "m"), ["tp", "setup"])
    x, y, z = affine.apply(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    return p.select("tp", "setup", "label", "id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


FOLDED = "SELECT tp, setup, 1.0 AS m0, round(0.1 * (setup % 3), 6) AS m1, 0.0 AS m2, round(tx + 0.1 * (setup % 3) * ty, 6) AS m3, 0.0 AS m4, 1.0 AS m5, 0.0 AS m6, ty AS m7, 0.0 AS m8, 0.0 AS m9, vz AS m10, tz AS m11 FROM model"
FOLDED = FOLDED.replace(" 1.0 AS", " 1.0::DOUBLE AS").replace(" 0.0 AS", " 0.0::DOUBLE AS").replace("0.1 *", "0.1::DOUBLE *")


def folded(spark, d):
    t = B.view_transform(spark, d).groupBy("tp", "setup").agg(F.collect_list(F.struct("ord", "m")).alias("list"))
    return t.select("tp", "setup", affine.fold(F.col("list")).alias("m"))


@query(sql(FOLDED, "model"))
def fold_transform(spark, d):
    return folded(spark, d).select("tp", "setup", *m_columns())


@query(sql("SELECT tp, setup, i, CASE WHEN i IN (0, 5, 10) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM model, range(12) t(i)", "model"))
def invert_transform(spark, d):
    f = folded(spark, d)
    back = affine.composed(affine.inverse(F.col("m")), F.col("m"))
    return f.select("tp", "setup", F.posexplode(back).alias("i", "v")).select("tp", "setup", F.col("i").cast("long").alias("i"), (F.round("v", 6) + 0.0).alias("v"))


@query(sql("SELECT setup, vx / m AS m0, vy / m AS m5, vz / m AS m10 FROM (SELECT *, least(vx, vy, vz) AS m FROM view_setup)", "view_setup"))
def set_to_calibration(spark, d):
    s = B.view_setup(spark, d)
    least = F.least("vx", "vy", "vz")
    return s.withColumn("m", affine.scaling(F.col("vx") / least, F.col("vy") / least, F.col("vz") / least)).select("setup", F.col("m")[0].alias("m0"), F.col("m")[5].alias("m5"), F.col("m")[10].alias("m10"))


@query(sql("WITH c AS (SELECT tp, avg(x) AS cx, avg(y) AS cy FROM point GROUP BY tp) SELECT p.tp, p.setup, p.label, p.id, round(cx - (y - cy), 5) AS x, round(cy + (x - cx), 5) AS y, round(z, 5) AS z FROM point p JOIN c USING (tp)", "point"))
def rotate_about_centre(spark, d):
    """Rotation by 90 degrees about the axis z through the centre of mass of each timepoint."""
    p = B.interest_point(spark, d)
    c = p.groupBy("tp").agg(*[F.avg(a).alias(f"c{a}") for a in XYZ])
    back = affine.translation(F.col("cx"), F.col("cy"), F.col("cz"))
    away = affine.translation(-F.col("cx"), -F.col("cy"), -F.col("cz"))
    c = c.select("tp", affine.compose(back, affine.compose(affine.rotation(2, 90.0), away)).alias("m"))
    x, y, z = affine.apply(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    return p.join(c, "tp").select("tp", "setup", "label", "id", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"), F.round(z, 5).alias("z"))


@query("SELECT CAST(i AS INT) AS i, v::DOUBLE AS v FROM (SELECT unnest(range(12)) AS i, unnest([1, 0, 0, 2.5, 0, 1, 0, -3, 0, 0, 2, 0]) AS v)")
def parse_transform(spark, d):
    m = affine.parse("[1, 0, 0, 2.5; 0 1 0 -3, (0,0,2,0)]")
    return spark.createDataFrame([(i, v) for i, v in enumerate(m)], "i int, v double")


@query(sql("SELECT a.tp, a.setup, m.tx + m.tp AS m3, m.ty - m.tp AS m7, m.tz AS m11 FROM view a JOIN model m ON m.setup = a.setup AND m.tp = CASE WHEN a.setup % 13 = 0 THEN 1 ELSE 0 END", "view", "model"))
def duplicate_transform(spark, d):
    """The transform of each setup's first timepoint taken over by all its timepoints."""
    m = B.view_model(spark, d).withColumn("m", affine.compose(affine.translation(F.col("tp"), -F.col("tp"), F.lit(0.0)), F.col("m")))
    return transforms.duplicate(m).select("tp", "setup", *[F.col("m")[i].alias(f"m{i}") for i in (3, 7, 11)])


@query(sql("SELECT tp, setup, tx AS lo_x, tx + sx - 1 AS hi_x, ty AS lo_y, ty + sy - 1 AS hi_y, tz AS lo_z, tz + sz - 1 AS hi_z FROM model", "model"))
def transformed_bounds(spark, d):
    return boxes.view_bounds(B.view_model(spark, d)).select("tp", "setup", *[f"{e}_{c}" for c in XYZ for e in ("lo", "hi")])


@query(sql("SELECT setup, CAST(floor(lo / 4 + 0.5) AS BIGINT) AS lo, CAST(floor(hi / 4 + 0.5) AS BIGINT) AS hi FROM iv", "iv"))
def scale_box(spark, d):
    lo, hi = boxes.scaled_box(F.col("lo"), F.col("hi"), F.lit(4.0))
    return B.interval(spark, d).select("setup", lo.alias("lo"), hi.alias("hi"))


@query(sql("SELECT setup, CAST(floor(lo / 2.5::DOUBLE) AS BIGINT) AS lo, CAST(ceil(hi / 2.5::DOUBLE) AS BIGINT) AS hi, CAST(floor(lo + 0.5) - 1 AS BIGINT) AS ilo, CAST(floor(hi + 0.5) + 1 AS BIGINT) AS ihi FROM iv", "iv"))
def anisotropic_box(spark, d):
    lo, hi = boxes.anisotropic_box(F.col("lo"), F.col("hi"), 2.5)
    ilo, ihi = boxes.integer_box(F.col("lo"), F.col("hi"))
    return B.interval(spark, d).select("setup", lo.alias("lo"), hi.alias("hi"), ilo.alias("ilo"), ihi.alias("ihi"))


@query(sql("SELECT tp, setup, 1.0::DOUBLE AS sx, round(sqrt(1 + (0.1::DOUBLE * (setup % 3)) ** 2), 6) AS sy, vz AS sz FROM model", "model"))
def axis_scale(spark, d):
    s = affine.axis_scale(F.col("m"))
    return folded(spark, d).select("tp", "setup", *[F.round(s[i], 6).alias(f"s{c}") for i, c in enumerate(XYZ)])


@query(sql("SELECT tp, i, round(avg(v), 5) AS v FROM (SELECT tp, unnest(range(12)) AS i, unnest([c, -s, 0, tx, s, c, 0, ty, 0, 0, 1, tz]) AS v FROM turned) GROUP BY tp, i", "turned"))
def average_transform(spark, d):
    m = transforms.average(B.turned_model(spark, d), ["tp"])
    return m.select("tp", F.posexplode("m").alias("i", "v")).select("tp", F.col("i").cast("long").alias("i"), (F.round("v", 5) + 0.0).alias("v"))


@query(sql("SELECT tp, setup, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, CASE WHEN setup % 3 = 0 THEN 0 ELSE 1 END::DOUBLE AS az, round(degrees(acos(c)), 5) AS degrees FROM turned", "turned"))
def rotation_axis(spark, d):
    """Axis and angle of each view's rotation; without one, the axis is 0."""
    axis, angle = transforms.rotation_axis(F.col("m"))
    return B.turned_model(spark, d).select("tp", "setup", *[(F.round(a, 5) + 0.0).alias(f"a{c}") for a, c in zip(axis, XYZ, strict=True)], F.round(angle, 5).alias("degrees"))


@query(sql("SELECT tp, setup, i, CASE WHEN i = 3 THEN -tx WHEN i = 7 THEN -ty WHEN i = 11 THEN -tz WHEN i IN (0, 5, 10) THEN 1 ELSE 0 END::DOUBLE AS v FROM model, range(12) t(i)", "model"))
def map_back(spark, d):
    """The rigid map that takes a moved view's corners back to where they were is the inverse translation."""
    out = transforms.map_back(B.view_model(spark, d), "rigid")
    return out.select("tp", "setup", F.posexplode("back").alias("i", "v")).select("tp", "setup", F.col("i").cast("long").alias("i"), (F.round("v", 6) + 0.0).alias("v"))


@query(sql("SELECT tp, setup, label, id, round(x / 2 - 0.25, 6) AS x, round(y / 4 - 0.375, 6) AS y FROM point", "point"))
def mipmap_correction(spark, d):
    """Coordinates in a level that is smaller by 2 and 4: pixel centres stay where they are."""
    m = transforms.mipmap_map([F.lit(2.0), F.lit(4.0), F.lit(1.0)])
    p = B.interest_point(spark, d).withColumn("m", m)
    x, y, _ = affine.apply(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    return p.select("tp", "setup", "label", "id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(sql("SELECT setup, CASE WHEN a = 0 THEN 0 ELSE sx - 1 END AS x, CASE WHEN b = 0 THEN 0 ELSE sy - 1 END AS y, CASE WHEN c = 0 THEN 0 ELSE sz - 1 END AS z FROM view_setup, range(2) t(a), range(2) u(b), range(2) w(c)", "view_setup"))
def cube_corners(spark, d):
    return boxes.corners(B.view_setup(spark, d)).select("setup", *XYZ)


@query(sql("WITH q AS (SELECT setup, x + 0.3::DOUBLE AS at FROM voxel) SELECT q.setup, round(q.at, 6) AS at, round(0.7 * a.v + 0.3 * b.v, 6) AS v FROM q LEFT JOIN voxel a ON a.setup = q.setup AND a.x = floor(q.at) JOIN voxel b ON b.setup = q.setup AND b.x = floor(q.at) + 1", "voxel"))
def interpolate(spark, d):
    """Linear interpolation at shifted places; those without both neighbours have no value."""
    v = B.voxel(spark, d)
    at = v.select("setup", (F.col("x") + 0.3).alias("at"))
    return volume.interpolate(at, v, ["setup"], {"at": "x"}).where("v is not null").select("setup", F.round("at", 6).alias("at"), F.round("v", 6).alias("v"))


@query(sql("WITH g AS (SELECT l_suppkey % 20 AS x, l_linenumber AS y, l_partkey % 5 AS z, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), n AS (SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, v FROM g) SELECT a.x, a.y, a.z, round(CASE WHEN count(b.v) = 8 THEN sum(b.v * CASE WHEN b.x = a.x THEN 0.75 ELSE 0.25 END * CASE WHEN b.y = a.y THEN 0.5 ELSE 0.5 END * CASE WHEN b.z = a.z THEN 0.9 ELSE 0.1 END) ELSE -1 END, 6) AS linear, round(any_value(CASE WHEN b.x = a.x AND b.y = a.y + 1 AND b.z = a.z THEN b.v END), 6) AS nearest FROM n a LEFT JOIN n b ON b.x IN (a.x, a.x + 1) AND b.y IN (a.y, a.y + 1) AND b.z IN (a.z, a.z + 1) GROUP BY a.x, a.y, a.z"))
def interpolate_volume(spark, d):
    """Three axes: linear with -1 outside, and the nearest voxel (halves upwards) with null outside."""
    one = B.table(spark, d, "lineitem").select((F.col("l_suppkey") % 20).cast("int").alias("x"), F.col("l_linenumber").cast("int").alias("y"), (F.col("l_partkey") % 5).cast("int").alias("z"), F.col("l_quantity").alias("v"))
    g = one.groupBy(*XYZ).agg(F.avg("v").alias("v")).withColumn("image", F.lit(1))
    at = g.select("image", *XYZ, (F.col("x") + 0.25).alias("px"), (F.col("y") + 0.5).alias("py"), (F.col("z") + 0.1).alias("pz"))
    places = {"px": "x", "py": "y", "pz": "z"}
    linear = volume.interpolate(at, g, ["image"], places, outside=-1.0).select(*[F.floor(f"p{c}").cast("int").alias(c) for c in XYZ], F.round("v", 6).alias("linear"))
    nearest = volume.interpolate(at, g, ["image"], places, "nearest").select(*[F.floor(f"p{c}").cast("int").alias(c) for c in XYZ], F.round("v", 6).alias("nearest"))
    return linear.join(nearest, list(XYZ))


@query(sql("SELECT setup, x, round(greatest(v, 50), 6) AS v FROM voxel", "voxel"))
def bias_floor(spark, d):
    return volume.bias_floor(B.voxel(spark, d), 50.0).select("setup", "x", F.round("v", 6).alias("v"))


@query(sql("SELECT CAST(floor(min(tx)) AS INT) AS min_x, CAST(floor(min(ty)) AS INT) AS min_y, CAST(floor(min(tz)) AS INT) AS min_z, CAST(ceil(max(tx + sx - 1)) AS INT) AS max_x, CAST(ceil(max(ty + sy - 1)) AS INT) AS max_y, CAST(ceil(max(tz + sz - 1)) AS INT) AS max_z FROM model", "model"))
def bbox_max(spark, d):
    return boxes.maximal_box(boxes.view_bounds(B.view_model(spark, d)))


@query(sql("""WITH b AS (SELECT DISTINCT angle, round(tx + least(0, -s * (sy - 1)), 6) AS lx, round(tx + c * (sx - 1), 6) AS hx, round(ty, 6) AS ly, round(ty + s * (sx - 1) + c * (sy - 1), 6) AS hy, round(tz, 6) AS lz, round(tz + sz - 1, 6) AS hz FROM turned),
 n AS (SELECT *, dense_rank() OVER (ORDER BY angle) AS k FROM b),
 r AS (SELECT k, lx, hx, ly, hy, lz, hz FROM n WHERE k = 1 UNION SELECT n.k, greatest(r.lx, n.lx), least(r.hx, n.hx), greatest(r.ly, n.ly), least(r.hy, n.hy), greatest(r.lz, n.lz), least(r.hz, n.hz)
  FROM r JOIN n ON n.k = r.k + 1 AND r.lx <= n.hx AND n.lx <= r.hx AND r.ly <= n.hy AND n.ly <= r.hy AND r.lz <= n.hz AND n.lz <= r.hz)
 SELECT CAST(floor(min(lx)) AS INT) AS min_x, CAST(floor(min(ly)) AS INT) AS min_y, CAST(floor(min(lz)) AS INT) AS min_z, CAST(ceil(max(hx)) AS INT) AS max_x, CAST(ceil(max(hy)) AS INT) AS max_y, CAST(ceil(max(hz)) AS INT) AS max_z
 FROM r WHERE k = (SELECT max(k) FROM n) HAVING count(*) > 0""", "turned", recursive=True))
def bbox_group(spark, d):
    v = boxes.view_bounds(B.turned_model(spark, d))
    return boxes.group_overlap_box(v.withColumns({c: F.round(c, 6) for c in boxes.ENDS}), "angle")


@query(sql("WITH e AS (SELECT setup, x, (SELECT min(n.v) FROM voxel n WHERE n.setup = c.setup AND n.x BETWEEN c.x - 1 AND c.x + 1) AS e FROM voxel c), l AS (SELECT setup, min(v) + (max(v) - min(v)) * 0.2 AS t FROM voxel GROUP BY setup) SELECT e.setup, min(x) - 3 AS lo, max(x) + 3 AS hi FROM e JOIN l ON e.setup = l.setup WHERE e > t GROUP BY e.setup", "voxel"))
def bbox_threshold(spark, d):
    return boxes.threshold_box(B.voxel(spark, d), ["setup"], "x", "v", 0.2, 1)


@query(sql("WITH RECURSIVE t AS (SELECT setup, sx, 0::BIGINT AS part, 0::BIGINT AS f, least(sx, 20) - 1 AS t FROM view_setup UNION ALL SELECT setup, sx, part + 1, t - 5 + 1, least(sx, t - 5 + 1 + 20) - 1 FROM t WHERE t < sx - 1) SELECT setup, CAST(part AS INT) AS part, CAST(row_number() OVER (ORDER BY setup, part) - 1 AS INT) AS new_setup, f AS \"from\", t AS \"to\" FROM t", "view_setup").replace("WITH ", "WITH RECURSIVE ", 1).replace(", RECURSIVE", ","))
def split_views(spark, d):
    return boxes.split_views(B.view_setup(spark, d), 20, 5).select("setup", "part", "new_setup", "from", "to")


@query(sql("WITH parts AS (SELECT setup, sx, unnest(range(CAST(ceil((sx - 5) / 15.0) AS BIGINT))) AS part FROM view_setup), q AS (SELECT *, part * 15 AS f, least(sx, part * 15 + 20) - 1 AS t FROM parts), n AS (SELECT *, row_number() OVER (ORDER BY setup, part) - 1 AS new_setup FROM q) SELECT CAST(new_setup AS INT) AS new_setup, p.tp, p.label, p.id, p.x - n.f AS x FROM point p JOIN n ON p.setup = n.setup AND p.x BETWEEN n.f AND n.t", "view_setup", "point"))
def split_points(spark, d):
    parts = boxes.split_views(B.view_setup(spark, d), 20, 5)
    return boxes.points_of_parts(B.interest_point(spark, d), parts).select("new_setup", "tp", "label", "id", "x")


@query(sql("SELECT setup, CAST(greatest(20, least(50, ceil(sx * sy * sz * 1000 / 1000000.0))) AS INT) AS n FROM view_setup", "view_setup"))
def fake_point_count(spark, d):
    return B.view_setup(spark, d).select("setup", boxes.fake_points(F.col("sx") * F.col("sy") * F.col("sz"), 1000.0, 20, 50).alias("n"))


@query(sql("""WITH w AS (SELECT p.tp, p.setup, p.label, p.id, m.tile, m.c * p.x - m.s * p.y + m.tx AS wx, m.s * p.x + m.c * p.y + m.ty AS wy, p.z + m.tz AS wz FROM point p JOIN turned m ON p.tp = m.tp AND p.setup = m.setup)
 SELECT tp, setup, label, id FROM w WHERE EXISTS (SELECT 1 FROM turned o WHERE o.tp = w.tp AND o.tile <> w.tile AND o.c * (w.wx - o.tx) + o.s * (w.wy - o.ty) BETWEEN -1e-9 AND o.sx - 1 + 1e-9 AND o.c * (w.wy - o.ty) - o.s * (w.wx - o.tx) BETWEEN -1e-9 AND o.sy - 1 + 1e-9 AND w.wz - o.tz BETWEEN -1e-9 AND o.sz - 1 + 1e-9)""", "point", "turned"))
def points_in_overlap(spark, d):
    """Points inside the image of another view of the same timepoint and another tile; views are turned."""
    views = B.turned_model(spark, d).select("tp", "setup", "tile", "m", "sx", "sy", "sz")
    p = B.interest_point(spark, d).join(views.select("tp", "setup", "tile", "m"), ["tp", "setup"])
    world = affine.apply(F.col("m"), F.col("x"), F.col("y"), F.col("z"))
    p = p.withColumns({f"w{c}": world[i] for i, c in enumerate(XYZ)}).drop("m")
    return spatial.points_in_other_views(p, views, "tile", 20.0).select("tp", "setup", "label", "id")


@query(sql("WITH b AS (SELECT t.b AS b, b * 16 AS lo, b * 16 + 15 AS hi FROM range(7) t(b)) SELECT b.b AS block, m.tp, m.setup FROM b JOIN model m ON m.tx - 2 <= b.hi AND m.tx + m.sx - 1 + 2 >= b.lo", "model"))
def block_views(spark, d):
    """Views that an output block of 16 needs: their boxes grown by two voxels."""
    grid = spark.range(7).select(F.col("id").alias("block"), (F.col("id") * 16.0).alias("lo_x"), (F.col("id") * 16.0 + 15).alias("hi_x"))
    return volume.block_views(grid, boxes.view_bounds(B.view_model(spark, d)), ["x"], 2.0, 16.0).select("block", "tp", "setup")
