"""Queries over models, splits, components and neighbourhoods in three axes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumiframe.functions import affine
from lumiframe.operators import boxes, spatial
from lumiframe.operators import intensity as I
from lumiframe.operators import matching as M
from lumiframe.operators import points as P
from lumiframe.operators import restoration as X
from lumiframe.plans import bindings as B
from lumiframe.plans.bindings import gauss_sql, sql
from lumiframe.plans.q_blocks3d import SIZE, VOLUMES, volumes
from lumiframe.plans.q_matching import jittered
from lumiframe.plans.q_relations import LINK, correspondences
from lumiframe.plans.registry import query

R = F.round


def mapped(spark, d, cells):
    """Points of every list against their images under a map of twelve numbers: a task per list."""
    p = B.interest_point(spark, d).select(F.format_string("%d-%d-%s", "tp", "setup", "label").alias("task"), F.col("id").cast("long").alias("id_a"), (F.col("id") + 1000).cast("long").alias("id_b"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("z").alias("za"))
    q = affine.apply(affine.literal(cells), F.col("xa"), F.col("ya"), F.col("za"))
    return p.withColumns({f"{c}b": v for c, v in zip("xyz", q, strict=True)})


def fitted(spark, d, model, cells, least):
    """task, error and cell m01 of the fits of lists of at least so many points."""
    m = mapped(spark, d, cells)
    m = m.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("task"))).where(F.col("n") >= least)
    return M.fit_models(m, model).select("task", (R("error", 5) + 0.0).alias("error"), R(F.col("m")[1], 5).alias("m1"), R(F.col("m")[3], 4).alias("m3"))


def _fitted_sql(least, m1, m3):
    return sql(f"SELECT concat(tp, '-', setup, '-', label) AS task, 0.0::DOUBLE AS error, {m1}::DOUBLE AS m1, {m3}::DOUBLE AS m3 FROM point GROUP BY tp, setup, label HAVING count(*) >= {least}", "point")


@query(_fitted_sql(12, -0.9, 5.0))
def similarity_models(spark, d):
    """A turn by 0.8/0.6 with a scale of 1.5 and a shift come back from their matches."""
    return fitted(spark, d, "similarity", [1.2, -0.9, 0, 5, 0.9, 1.2, 0, -7, 0, 0, 1.5, 2], 12)


@query(_fitted_sql(24, 0.25, 5.0))
def affine_models(spark, d):
    """So does a shear."""
    return fitted(spark, d, "affine", [1, 0.25, 0, 5, 0, 1, 0.125, -7, 0, 0, 1.25, 2], 24)


@query(_fitted_sql(3, -0.6, 5.0))
def plane_models(spark, d):
    """Turns in the plane alone."""
    return fitted(spark, d, "plane rigid", [0.8, -0.6, 0, 5, 0.6, 0.8, 0, -7, 0, 0, 1, 0], 3)


@query(sql("SELECT concat(tp, '-', setup, '-', label) AS task, CAST(id AS BIGINT) AS id_a, CAST(id + 1000 AS BIGINT) AS id_b, 3.0::DOUBLE AS m3 FROM (SELECT *, count(*) OVER (PARTITION BY tp, setup, label) AS n FROM point) WHERE n >= 12", "point"))
def icp_ransac(spark, d):
    """Closest points with a robust fit in every round; points without a partner lie at some distance from all others."""
    a, b = jittered(spark, d)
    lost = b.where("id % 3 = 0").select("task", (F.col("id") + 100000).alias("id"), (F.col("x") + 4000).alias("x"), "y", "z")
    out = M.icp_matches(a, b.unionByName(lost), reach=6.0, least=12, robust=(1.0, 0.1, 200))
    return out.select("task", "id_a", "id_b", R(F.col("m")[3], 5).alias("m3"))


@query(sql("SELECT concat(tp, '-', setup, '-', label) AS task, 0::BIGINT AS id_a, 0::BIGINT AS id_b, round(avg(x), 5) AS xa, round(avg(x) + 3, 5) AS xb, round(avg(z) + 1, 5) AS zb FROM point GROUP BY tp, setup, label", "point"))
def centre_match(spark, d):
    p = B.interest_point(spark, d).select(F.format_string("%d-%d-%s", "tp", "setup", "label").alias("task"), "x", "y", "z")
    q = p.withColumns({"x": F.col("x") + 3, "z": F.col("z") + 1})
    return M.centre_match(p, q).select("task", "id_a", "id_b", R("xa", 5).alias("xa"), R("xb", 5).alias("xb"), R("zb", 5).alias("zb"))


@query("WITH e AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), p AS (SELECT id_a, id_b, i, sqrt(sum((x[4 * i + k + 1]::DOUBLE - y[4 * i + k + 1]::DOUBLE) ** 2)) AS d FROM e, range(16) r(i), range(4) s(k) GROUP BY 1, 2, 3) SELECT id_a, id_b, round(sum(d) / 4, 6) AS linear FROM p GROUP BY 1, 2")
def linear_distances(spark, d):
    """Descriptors as sixteen points on four axes."""
    e = B.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    p = e.toDF("id_a", "va").join(e.toDF("id_b", "vb"), F.col("id_b") == F.col("id_a") + 1)
    return p.select("id_a", "id_b", R(M.linear_distance("va", "vb", 16), 6).alias("linear"))


@query(sql("SELECT tp, setup, round(1 + 0.03 * (greatest(5, degrees(acos(c))) - 5) ** 2, 5) AS w FROM turned", "turned"))
def prior_weights(spark, d):
    """How far each view's turn is from none."""
    return B.turned_model(spark, d).select("tp", "setup", R(M.prior_weight(F.col("m"), affine.literal(affine.IDENTITY)), 5).alias("w"))


@query(sql(f"WITH l AS ({LINK}), w(label, weight) AS (VALUES ('A', 0.5), ('N', 2.0)) SELECT l.tp * 4294967296::BIGINT + l.setup AS a, l.c_tp * 4294967296::BIGINT + l.c_setup AS b, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz, coalesce(w.weight, 1)::DOUBLE AS weight, 1.0::DOUBLE AS quality FROM l JOIN point p ON p.tp = l.tp AND p.setup = l.setup AND p.label = l.label AND p.id = l.id JOIN point q ON q.tp = l.c_tp AND q.setup = l.c_setup AND q.label = l.c_label AND q.id = l.c_id LEFT JOIN w ON w.label = l.label", "point"))
def point_matches(spark, d):
    w = spark.createDataFrame([("A", 0.5), ("N", 2.0)], "label string, weight double")
    return M.point_matches(correspondences(spark, d), B.interest_point(spark, d), w)


FLAT = "SELECT setup, tx AS lx, tx + sx - 1 AS hx, ty AS ly, ty + sy - 1 AS hy, CASE WHEN setup % 3 = 0 THEN 0 ELSE tz END::DOUBLE AS lz, CASE WHEN setup % 3 = 0 THEN 0 ELSE tz + sz - 1 END::DOUBLE AS hz, CASE WHEN setup % 3 = 0 THEN 1 ELSE sz END AS sz FROM model WHERE tp = 1"


@query(sql(f"WITH b AS ({FLAT}), p AS (SELECT a.setup AS setup_a, b.setup AS setup_b, greatest(a.lx, b.lx) AS lo_x, least(a.hx, b.hx) AS hi_x, greatest(a.ly, b.ly) AS lo_y, least(a.hy, b.hy) AS hi_y, greatest(a.lz, b.lz) AS lo_z, least(a.hz, b.hz) AS h, a.sz = 1 AND b.sz = 1 AS flat FROM b a JOIN b ON a.setup < b.setup) SELECT setup_a, setup_b, lo_x, hi_x, lo_z, CASE WHEN flat AND lo_z = 0 AND h = 0 THEN 1 ELSE h END AS hi_z FROM p WHERE lo_x < hi_x AND lo_y < hi_y AND lo_z < CASE WHEN flat AND lo_z = 0 AND h = 0 THEN 1 ELSE h END", "model"))
def overlap_boxes(spark, d):
    """What pairs of views have in common; a third of them are planes. Of the first timepoint that all have."""
    v = B.view_model(spark, d).where("tp = 1").withColumns({"sz": F.when(F.col("setup") % 3 == 0, 1).otherwise(F.col("sz")), "m": F.when(F.col("setup") % 3 == 0, F.transform("m", lambda x, i: F.when(i == 11, 0.0).otherwise(x))).otherwise(F.col("m"))})
    b = boxes.view_bounds(v)
    p = spatial.overlap_pairs(b, "setup", [(f"lo_{c}", f"hi_{c}") for c in "xyz"], keep=("sx", "sy", "sz"))
    return spatial.overlap_boxes(p).select("setup_a", "setup_b", "lo_x", "hi_x", "lo_z", "hi_z")


@query(sql("SELECT setup, round(lo / 4 - floor(lo / 4 + 0.5), 6) AS off, round((lo / 4 - floor(lo / 4 + 0.5)) + floor(lo / 4 + 0.5), 6) AS lo FROM iv", "iv"))
def scale_box_offset(spark, d):
    off = boxes.scaled_offset(F.col("lo"), F.lit(4.0))
    return B.interval(spark, d).select("setup", R(off, 6).alias("off"), R(off + boxes.scaled_box(F.col("lo"), F.col("hi"), F.lit(4.0))[0], 6).alias("lo"))


SPLIT = "WITH p AS (SELECT tp, setup, m.sx, m.sy, m.sz, tx, ty, tz, i, j, k, greatest(1, CAST(ceil((sx - 5) / 15.0) AS INT)) AS nx, greatest(1, CAST(ceil((sy - 4) / 16.0) AS INT)) AS ny, greatest(1, CAST(ceil((sz - 2) / 6.0) AS INT)) AS nz FROM model m, range(10) a(i), range(10) b(j), range(10) c(k)), q AS (SELECT *, i + nx * (j + ny * k) AS part FROM p WHERE i < nx AND j < ny AND k < nz), s AS (SELECT tp, setup, CAST(part AS INT) AS part, CAST(dense_rank() OVER (ORDER BY setup, part) - 1 AS INT) AS new_setup, i * 15 AS fx, j * 16 AS fy, k * 6 AS fz, least(sx, i * 15 + 20) - 1 AS hx, least(sy, j * 16 + 20) - 1 AS hy, least(sz, k * 6 + 8) - 1 AS hz, tx, ty, tz FROM q)"


def parts(spark, d):
    return boxes.split_volumes(B.view_model(spark, d).select("tp", "setup", "m", "sx", "sy", "sz"), (20, 20, 8), (5, 4, 2))


@query(sql(SPLIT + " SELECT tp, setup, part, new_setup, tx + fx AS m3, ty + fy AS m7, tz + fz AS m11, hx - fx + 1 AS sx, hz - fz + 1 AS sz FROM s", "model"))
def split_volumes(spark, d):
    """Views in parts on three axes, whose registrations start at the part's first voxel."""
    return parts(spark, d).select("tp", "setup", "part", "new_setup", *[F.col("m")[i].alias(f"m{i}") for i in (3, 7, 11)], "sx", "sz")


@query(sql(SPLIT + " SELECT p.tp, p.setup, s.new_setup, p.label, p.id, round(p.x - fx, 6) AS x, round(p.y - fy, 6) AS y, round(p.z - fz, 6) AS z FROM point p JOIN s ON p.tp = s.tp AND p.setup = s.setup AND p.x BETWEEN fx AND hx AND p.y BETWEEN fy AND hy AND p.z BETWEEN fz AND hz", "model", "point"))
def split_volume_points(spark, d):
    out = boxes.points_of_volumes(B.interest_point(spark, d), parts(spark, d))
    return out.select("tp", "setup", "new_setup", "label", "id", *[R(c, 6).alias(c) for c in "xyz"])


@query(f"""WITH RECURSIVE g AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY setup, x, y, z) AS n FROM ({VOLUMES}) WHERE v > 28), e AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM g a JOIN g b ON a.setup = b.setup AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
 r AS (SELECT n, n AS reach FROM g UNION SELECT r.n, e.b FROM r JOIN e ON r.reach = e.a), c AS (SELECT n, min(reach) AS c FROM r GROUP BY n)
 SELECT setup, count(*) AS size, round(max(v), 4) AS peak, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM g JOIN c USING (n) GROUP BY setup, c""")
def cell_components(spark, d):
    """Bright cells of the volumes that touch, also at corners."""
    v = volumes(spark, d).withColumn("v", F.col("v").cast("float").cast("double"))
    return P.cell_components(v, ["setup"], ["x", "y", "z"], "v", 28.0).withColumn("peak", R("peak", 4))


@query(sql("SELECT tp, setup, label, id FROM point a WHERE NOT EXISTS (SELECT 1 FROM point b WHERE a.tp = b.tp AND a.setup = b.setup AND a.label = b.label AND (b.intensity > a.intensity OR (b.intensity = a.intensity AND b.id < a.id)) AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 25)", "point"))
def drop_weaker(spark, d):
    return P.drop_weaker(B.interest_point(spark, d), 5.0).select("tp", "setup", "label", "id")


PATCH = f"""WITH g AS MATERIALIZED ({VOLUMES}), q(i, x, y, z) AS (VALUES (0, 5.25::DOUBLE, 3.5::DOUBLE, 2.0::DOUBLE), (1, 7.0, 2.25, 1.5), (2, 0.5, 3.0, 2.25)), o AS (SELECT CAST(a AS INT) AS dx, CAST(b AS INT) AS dy, CAST(c AS INT) AS dz FROM range(-2, 3) x(a), range(-1, 2) y(b), range(-1, 2) z(c)),
 s AS (SELECT DISTINCT setup FROM g), a AS (SELECT s.setup, q.i, o.*, q.x + dx AS px, q.y + dy AS py, q.z + dz AS pz FROM s, q, o),
 u AS (SELECT a.*, k, l, m, (CASE WHEN k = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) * (CASE WHEN l = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE WHEN m = 1 THEN pz - floor(pz) ELSE 1 - pz + floor(pz) END) AS w FROM a, range(2) x(k), range(2) y(l), range(2) z(m)),
 v AS (SELECT u.setup, u.i, dx, dy, dz, CASE WHEN count(g.v) = count(*) THEN sum(w * g.v) ELSE 0 END AS v FROM u LEFT JOIN g ON g.setup = u.setup AND g.x = floor(px) + k AND g.y = floor(py) + l AND g.z = floor(pz) + m WHERE w > 0 GROUP BY ALL),
 p AS (SELECT setup, dx, dy, dz, sum(v) AS p FROM v GROUP BY ALL), p1 AS (SELECT setup, dx, dy, dz, p - min(p) OVER (PARTITION BY setup, dy, dz) AS p FROM p), p2 AS (SELECT setup, dx, dy, dz, p - min(p) OVER (PARTITION BY setup, dx, dz) AS p FROM p1), p3 AS (SELECT setup, dx, dy, dz, p - min(p) OVER (PARTITION BY setup, dx, dy) AS p FROM p2)
 SELECT setup, dx, dy, dz, round((p - min(p) OVER w) / (max(p) OVER w - min(p) OVER w), 5) AS psf FROM p3 WINDOW w AS (PARTITION BY setup)"""


@query(PATCH)
def psf_extract_volume(spark, d):
    """Neighbourhoods of 5 x 3 x 3 around three places between voxels, less their least values along each axis."""
    v = volumes(spark, d).withColumn("v", F.col("v").cast("float").cast("double"))
    at = spark.createDataFrame([(5.25, 3.5, 2.0), (7.0, 2.25, 1.5), (0.5, 3.0, 2.25)], "x double, y double, z double")
    points = v.select("setup").distinct().crossJoin(F.broadcast(at))  # three rows
    out = X.psf_extract_volume(v, points, (2, 1, 1), remove_minima=True)
    return out.select("setup", "dx", "dy", "dz", R("psf", 5).alias("psf"))


@query(sql("WITH n AS (SELECT *, greatest(1, sx // 20) + CASE WHEN sx % 20 > 0 THEN 1 ELSE 0 END AS nx, sy // 16 + CASE WHEN sy % 16 >= 4 OR sy // 16 = 0 THEN 1 ELSE 0 END AS ny, greatest(1, sy // 20) + CASE WHEN sy % 20 > 0 THEN 1 ELSE 0 END AS my, sx // 16 + CASE WHEN sx % 16 >= 4 OR sx // 16 = 0 THEN 1 ELSE 0 END AS mx FROM view_setup) SELECT setup, 0 AS kind, CAST(floor(sx / (nx * 2.0) + i * (sx / nx::DOUBLE) + 0.5) AS BIGINT) AS x, CAST(floor(sy / (my * 2.0) + j * (sy / my::DOUBLE) + 0.5) AS BIGINT) AS y, CAST(k AS BIGINT) AS z FROM n, range(20) a(i), range(20) b(j), range(2, 20, 3) c(k) WHERE i < nx AND j < my AND k < sz - 2 UNION ALL SELECT setup, 1, CAST(floor(sx / (mx * 2.0) + i * (sx / mx::DOUBLE) + 0.5) AS BIGINT), CAST(floor(sy / (ny * 2.0) + j * (sy / ny::DOUBLE) + 0.5) AS BIGINT), CAST(k AS BIGINT) FROM n, range(20) a(i), range(20) b(j), range(2, 20, 3) c(k) WHERE i < mx AND j < ny AND k < sz - 2", "view_setup"))
def quality_places(spark, d):
    """A fixed grid, and tiles of 16 with a quarter's tolerance."""
    s = B.view_setup(spark, d).select("setup", "sx", "sy", "sz")
    one = lambda kind, **how: X.quality_places(s, 20, 3, 2, **how).select("setup", F.lit(kind).alias("kind"), "x", "y", "z")
    return one(0).unionByName(one(1, square=16, tolerance=0.25))


@query(sql(f"WITH f AS (SELECT x, sum(v * (1 + setup)) / sum(1 + setup) AS v FROM line GROUP BY x), o AS (SELECT 0 AS setup, x, v FROM f), g AS ({gauss_sql('o', 'v', 2.0)}) SELECT g.x, round(g.g, 5) AS fused, round((SELECT avg(v) FROM line WHERE x = 127), 5) AS approximate, round(CASE WHEN g.x % 2 = 0 THEN g.x / 2.0 ELSE 1 END, 5) AS given FROM g", "line"))
def initial_estimates(spark, d):
    """A softened fusion, the mean of the middle plane, and a given estimate."""
    v = B.line(spark, d).withColumns({"w": 1.0 + F.col("setup"), "all": F.lit(0)})
    own = ["x", "all"]
    given = v.select(*own).distinct().where("x % 2 = 0").withColumn("psi", F.col("x") / 2.0)
    a = X.initial_estimate(v, own, "blurred fused", blur=2.0).select("x", R("psi", 5).alias("fused"))
    b = X.initial_estimate(v, own, "approximate average").select("x", R("psi", 5).alias("approximate"))
    c = X.initial_estimate(v, own, "given", given=given).select("x", R("psi", 5).alias("given"))
    return a.join(b, "x").join(c, "x")


@query(sql("SELECT setup % 2 AS grp, x, round(CASE WHEN sum(x % 4) > 0 THEN sum(v * (x % 4)) / sum(x % 4) ELSE 0 END + 1e-9, 5) AS v, CAST(sum(x % 4) AS BIGINT) AS w FROM line GROUP BY 1, 2", "line"))
def group_inputs(spark, d):
    v = B.line(spark, d).withColumns({"grp": F.col("setup") % 2, "w": F.col("x") % 4})
    return X.group_inputs(v, ["x"], "grp").select("grp", "x", R(F.col("v") + 1e-9, 5).alias("v"), F.col("w").cast("long").alias("w"))


@query(sql("SELECT setup, x, CAST(x % 2 + 2 * (setup % 2) AS INT) AS batch FROM voxel", "voxel"))
def block_batches(spark, d):
    return X.batches(B.voxel(spark, d).select("setup", "x"), ["x", "setup"])


FIELD = "SELECT CAST(s AS INT) AS setup, CAST(c AS INT) AS cell, 0.512345::DOUBLE + (s * 8 + c) % 10 / 7.0::DOUBLE AS a, (s + c * 3) % 7 - 3.0::DOUBLE AS b FROM range(4) t(s), range(12) u(c)"


def field(spark):
    f = spark.range(48).select(F.floor(F.col("id") / 12).cast("int").alias("setup"), (F.col("id") % 12).cast("int").alias("cell"))
    return f.select("setup", "cell", (0.512345 + (F.col("setup") * 8 + F.col("cell")) % 10 / 7.0).alias("a"), ((F.col("setup") + F.col("cell") * 3) % 7 - 3.0).alias("b"))


@query(f"""WITH g AS ({VOLUMES}), f AS ({FIELD}), p AS (SELECT *, (x + 0.5) * 3 / 12 - 0.5 AS px, (y + 0.5) * 2 / 7 - 0.5 AS py, (z + 0.5) * 2 / 5 - 0.5 AS pz FROM g),
 c AS (SELECT p.*, CAST(greatest(0, least(2, floor(px) + i)) + 3 * (greatest(0, least(1, floor(py) + j)) + 2 * greatest(0, least(1, floor(pz) + k))) AS INT) AS cell, (CASE WHEN i = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) * (CASE WHEN j = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE WHEN k = 1 THEN pz - floor(pz) ELSE 1 - pz + floor(pz) END) AS w FROM p, range(2) x(i), range(2) y(j), range(2) z(k))
 SELECT c.setup, x, y, z, round(least(255, greatest(0, v * sum(w * a) + sum(w * b))), 4) AS v FROM c JOIN f ON f.setup = c.setup AND f.cell = c.cell GROUP BY c.setup, x, y, z, v""")
def apply_field_volume(spark, d):
    """Fields of 3 x 2 x 2 cells over the volumes."""
    v = volumes(spark, d).withColumn("v", F.col("v").cast("float").cast("double"))
    sizes = spark.createDataFrame([(s, *SIZE) for s in range(4)], "setup int, sx int, sy int, sz int")
    out = I.apply_field_volume(v, field(spark), sizes, (3, 2, 2), 0.0, 255.0)
    return out.select("setup", "x", "y", "z", R("v", 4).alias("v"))


@query("""WITH n AS (SELECT CAST(s * 12 + c AS BIGINT) AS a, CAST(s * 12 + c + st AS BIGINT) AS b FROM range(4) t(s), range(12) u(c), (VALUES (1, 3, 1), (3, 2, 3), (6, 2, 6)) w(st, size, d) WHERE c // d % size < size - 1),
 m AS (SELECT CAST(s * 12 + c AS BIGINT) AS a, CAST((s + 1) * 12 + c AS BIGINT) AS b, s FROM range(3) t(s), range(12) u(c))
 SELECT a, b, p::DOUBLE AS p, p::DOUBLE AS q, 1.0::DOUBLE AS weight FROM n, (VALUES (0), (1)) v(p) UNION ALL SELECT a, b, p::DOUBLE, p::DOUBLE, 1e-6::DOUBLE FROM m, (VALUES (0), (1)) v(p) WHERE s = 2 UNION ALL SELECT a, b, 10.0 + a % 5, 20.0 + a % 3, 2.0 FROM m WHERE s < 2 AND a % 2 = 0""")
def field_links(spark, d):
    """Cells of four views in a row: the last two have no match at all, the others at every other cell."""
    m = spark.range(36).select(F.floor(F.col("id") / 12).cast("int").alias("setup_a"), (F.col("id") % 12).cast("int").alias("cell_a"))
    m = m.withColumns({"setup_b": F.col("setup_a") + 1, "cell_b": F.col("cell_a")}).withColumn("a", F.col("setup_a").cast("long") * 12 + F.col("cell_a"))
    known = (F.col("setup_a") < 2) & (F.col("a") % 2 == 0)
    m = m.withColumns({"p": F.when(known, 10.0 + F.col("a") % 5), "q": F.when(known, 20.0 + F.col("a") % 3), "weight": F.lit(2.0)})
    return I.field_links(m, (3, 2, 2))


@query(sql("SELECT setup_a, setup_b, count(*) AS n FROM (SELECT a.setup AS setup_a, b.setup AS setup_b, a.x FROM voxel a JOIN voxel b ON a.x = b.x AND a.setup < b.setup) GROUP BY ALL", "voxel").replace("count(*) AS n FROM (SELECT", "least(100, count(*)) AS n FROM (SELECT"))
def thin_pairs(spark, d):
    """A hundred pairs of each two views at most: what thinning is for."""
    p = I.thin(I.voxel_pairs(B.voxel(spark, d)), 100, ["setup_a", "setup_b"])
    return p.groupBy("setup_a", "setup_b").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT setup, CAST(c AS INT) AS cell, round(1 + setup / 4.0, 4)::DOUBLE AS a, round(setup * 3.0, 3)::DOUBLE AS b FROM (SELECT DISTINCT setup FROM voxel), range(2) t(c)", "voxel"))
def intensity_correction(spark, d):
    """From pairs of voxels to coefficients and back from files: views that are one signal under a line each get these lines back."""
    from lumiframe.plans.q_sources import scratch

    c = I.IntensityCorrection((2, 1, 1), shift=0.0, stay=0.0)
    signal = B.line(spark, d).groupBy("x").agg(F.avg("v").alias("u"))
    v = B.line(spark, d).select("setup", "x").join(signal, "x").select("setup", "x", ((F.col("u") - 3 * F.col("setup")) / (1 + F.col("setup") / 4)).alias("v"))
    pairs = I.voxel_pairs(v).withColumn("cell_a", F.floor(F.col("x") / 128).cast("int")).withColumn("cell_b", F.col("cell_a"))
    f = c.solve(c.match_histograms(pairs))
    path = scratch(spark)
    c.write(f, path)
    return c.read(spark, path, f.select(F.lit(0).alias("tp"), "setup")).select("setup", "cell", R("a", 4).alias("a"), (R("b", 3) + 0.0).alias("b"))
