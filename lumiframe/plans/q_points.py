"""Queries over interest points and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumiframe.operators import iterate, spatial
from lumiframe.operators import points as P
from lumiframe.plans import bindings as B
from lumiframe.plans.bindings import sql
from lumiframe.plans.q_relations import LINK, correspondences
from lumiframe.plans.registry import query

KEY = ["tp", "setup", "label", "id"]
LIMIT = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY tp, setup, label ORDER BY {order}, id) - 1 AS r, count(*) OVER (PARTITION BY tp, setup, label) AS n FROM point) SELECT tp, setup, label, id FROM r WHERE n <= {k} OR {keep}"


@query(sql(LIMIT.format(order="abs(intensity) DESC", k=6, keep="r < 6"), "point"))
def limit_brightest(spark, d):
    return P.limit_detections(B.interest_point(spark, d), 6, "brightest").select(*KEY)


@query(sql(LIMIT.format(order="abs(intensity)", k=6, keep="r < 6"), "point"))
def limit_weakest(spark, d):
    return P.limit_detections(B.interest_point(spark, d), 6, "weakest").select(*KEY)


@query(sql(LIMIT.format(order="abs(intensity) DESC", k=6, keep="r BETWEEN n // 2 - 3 AND n // 2 + 3"), "point"))
def limit_median(spark, d):
    return P.limit_detections(B.interest_point(spark, d), 6, "median").select(*KEY)


NEAREST = "SELECT a.tp, a.setup, a.label, a.id, sqrt(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS d FROM point a JOIN point b ON a.tp = b.tp AND a.setup = b.setup AND a.label = b.label AND a.id <> b.id GROUP BY ALL"
CROSS = "SELECT a.tp, a.setup, a.label, a.id, sqrt(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS d FROM point a JOIN point b ON a.tp = b.tp AND a.setup = b.setup WHERE a.label = 'N' AND b.label <> 'N' GROUP BY ALL"


def self_distance(spark, d):
    p = B.interest_point(spark, d)
    return spatial.nearest_distance(p, p, P.AXES, KEY, P.VIEW, True)


@query(sql(f"SELECT tp, setup, label, id, round(d, 6) AS d FROM ({NEAREST})", "point"))
def nearest_self(spark, d):
    return self_distance(spark, d).select(*KEY, F.round("d", 6).alias("d"))


@query(sql(f"SELECT tp, setup, label, id, round(d, 6) AS d FROM ({CROSS})", "point"))
def nearest_cross(spark, d):
    p = B.interest_point(spark, d)
    out = spatial.nearest_distance(p.where("label = 'N'"), p.where("label <> 'N'"), P.AXES, KEY, ["tp", "setup"], False)
    return out.select(*KEY, F.round("d", 6).alias("d"))


@query(sql("WITH c AS (SELECT a.tp, a.label, a.setup AS s, a.id AS i, b.setup AS t, b.id AS j, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2 FROM point a JOIN point b ON a.tp = b.tp AND a.label = b.label AND b.setup = a.setup + 1) SELECT tp, label, s AS setup_a, i AS id_a, t AS setup_b, j AS id_b, round(d2, 6) AS d2 FROM c WHERE d2 <= 9 QUALIFY row_number() OVER (PARTITION BY tp, label, s, i ORDER BY d2, t, j) = 1", "point"))
def nearest_target(spark, d):
    """For each point the nearest one of the next setup within 3: the assignment step of iterative closest points."""
    p = B.interest_point(spark, d)
    a = p.select("tp", "label", F.col("setup").alias("pair"), "setup", "id", *P.AXES)
    b = p.select("tp", "label", (F.col("setup") - 1).alias("pair"), "setup", "id", *P.AXES)
    out = spatial.nearest(a, b, P.AXES, ["tp", "label", "setup", "id"], ["setup", "id"], 3.0, ["tp", "label", "pair"])
    return out.select(F.col("tp_a").alias("tp"), F.col("label_a").alias("label"), "setup_a", "id_a", "setup_b", "id_b", F.round("d2", 6).alias("d2"))


THIN = "SELECT p.tp, p.setup, p.label, CAST(row_number() OVER (PARTITION BY p.tp, p.setup, p.label ORDER BY p.id) - 1 AS INT) AS id, round(p.x, 6) AS x FROM point p {join} ({source}) n ON p.tp = n.tp AND p.setup = n.setup AND p.label = n.label AND p.id = n.id AND n.d BETWEEN 2 AND 6"


@query(sql(THIN.format(join="ANTI JOIN", source=NEAREST), "point"))
def thin_out(spark, d):
    return P.thin_out(B.interest_point(spark, d), 2.0, 6.0, False).select(*KEY, F.round("x", 6).alias("x"))


@query(sql(THIN.format(join="SEMI JOIN", source=CROSS), "point"))
def relative_thin_out(spark, d):
    p = B.interest_point(spark, d)
    return P.relative_thin_out(p.where("label = 'N'"), p.where("label <> 'N'"), 2.0, 6.0, True).select(*KEY, F.round("x", 6).alias("x"))


HIST = "WITH n AS ({source}), e AS (SELECT min(d) AS lo, (max(d) - min(d) + 1e-6) / 100 AS w FROM n) SELECT CAST(floor((d - lo) / w) AS INT) AS bin, count(*) AS n, round(min(lo) + (CAST(floor((d - lo) / w) AS INT) + 0.5) * min(w), 6) AS centre FROM n, e GROUP BY floor((d - lo) / w)"


@query(sql(HIST.format(source=NEAREST), "point"))
def distance_histogram(spark, d):
    return P.histogram(self_distance(spark, d), "d").select("bin", "n", F.round("centre", 6).alias("centre"))


@query(sql(HIST.format(source=CROSS), "point"))
def relative_distance_histogram(spark, d):
    p = B.interest_point(spark, d)
    near = spatial.nearest_distance(p.where("label = 'N'"), p.where("label <> 'N'"), P.AXES, KEY, ["tp", "setup"], False)
    return P.histogram(near, "d").select("bin", "n", F.round("centre", 6).alias("centre"))


@query(sql("SELECT tp, setup, label, id FROM point a WHERE NOT EXISTS (SELECT 1 FROM point b WHERE a.tp = b.tp AND a.setup = b.setup AND a.label = b.label AND b.id < a.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 4)", "point"))
def drop_near_duplicates(spark, d):
    return P.drop_duplicates_within(B.interest_point(spark, d), 2.0).select(*KEY)


@query(sql(f"SELECT label, count(DISTINCT (tp, setup)) AS views, count(*) AS points, count(l.c_tp) AS linked FROM point p LEFT JOIN ({LINK}) l USING (tp, setup, label, id) GROUP BY label", "point"))
def label_inventory(spark, d):
    return P.labels(B.interest_point(spark, d), correspondences(spark, d))


@query(sql("SELECT tp, setup, label, id, CAST(row_number() OVER (PARTITION BY tp, label ORDER BY setup, id) - 1 AS INT) AS group_point FROM point", "point"))
def group_points(spark, d):
    return P.group_all(B.interest_point(spark, d)).select(*KEY, "group_point")


@query(sql("SELECT tp, setup, label, id FROM point WHERE NOT (x BETWEEN 10 AND 30 AND y BETWEEN 5 AND 20)", "point"))
def roi_removal(spark, d):
    return P.box_filter(B.interest_point(spark, d), [10, 5], [30, 20], False).select(*KEY)


@query(sql("WITH s AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM series WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, i, round(v, 6) AS v, CASE WHEN v >= a AND v >= b THEN 'max' ELSE 'min' END AS kind FROM s WHERE a IS NOT NULL AND b IS NOT NULL AND (v >= a AND v >= b OR v <= a AND v <= b) AND abs(v) >= 10", "series"))
def extrema_1d(spark, d):
    return P.local_extrema(B.series(spark, d), "user_id", "i", "v", 10.0).select("user_id", "i", F.round("v", 6).alias("v"), "kind")


@query(sql("WITH b AS (SELECT setup, x, v, x - row_number() OVER (PARTITION BY setup ORDER BY x) AS run FROM voxel WHERE v > 50) SELECT setup, count(*) AS size, min(x) AS first, max(x) AS last, round(max(v), 6) AS peak FROM b GROUP BY setup, run", "voxel"))
def blob_labels(spark, d):
    return P.blob_labels(B.voxel(spark, d), ["setup"], "x", "v", 50.0).select("setup", "size", "first", "last", F.round("peak", 6).alias("peak"))


@query(sql("""WITH o AS MATERIALIZED (SELECT *, md5(concat_ws(',', tp, setup, id)) AS o FROM point), c AS MATERIALIZED (SELECT *, CAST(floor(x / 5) AS BIGINT) AS cx, row_number() OVER () AS n FROM o),
 l AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM c a JOIN c b ON a.tp = b.tp AND a.label = b.label AND b.cx BETWEEN a.cx - 1 AND a.cx + 1 AND a.setup <> b.setup AND (b.o, b.setup, b.id) < (a.o, a.setup, a.id) AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 6.25),
 t(n, stays) USING KEY (n) AS (SELECT n, true FROM c WHERE n NOT IN (SELECT a FROM l) UNION SELECT l.a, count(*) FILTER (r.stays) = 0 FROM l LEFT JOIN recurring.t r ON r.n = l.b WHERE l.a NOT IN (SELECT n FROM recurring.t) GROUP BY l.a HAVING count(*) FILTER (r.stays) > 0 OR count(r.n) = count(*))
 SELECT tp, setup, label, id FROM c JOIN t ON t.n = c.n WHERE stays""", "point", recursive=True))
def suppress_neighbours(spark, d):
    """In the order of md5 of the points' keys."""
    p = B.interest_point(spark, d)
    return P.suppress(p, 2.5, order=F.md5(F.concat_ws(",", "tp", "setup", "id"))).select(*KEY)


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS a, (o_custkey * 31 + o_orderkey) % 1500 AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
 r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.reach = u.a) SELECT node, min(reach) AS component FROM r GROUP BY node""")
def components(spark, d):
    return iterate.components(B.edge(spark, d))


@query(sql("""WITH m AS (SELECT CAST(tile AS BIGINT) AS g, tp, setup FROM view UNION ALL SELECT 100 + setup // 10, tp, setup FROM view),
 l AS (SELECT DISTINCT a.g AS a, b.g AS b FROM m a JOIN m b ON a.tp = b.tp AND a.setup = b.setup), r AS (SELECT a AS g, a AS reach FROM l UNION SELECT r.g, l.b FROM r JOIN l ON r.reach = l.a) SELECT CAST(g AS BIGINT) AS group_id, CAST(min(reach) AS BIGINT) AS merged FROM r GROUP BY g""", "view", recursive=True))
def merge_groups(spark, d):
    """Groups by tile and by tens of setups, merged while they overlap; a group is linked with the smallest that shares a view."""
    v = B.view(spark, d)
    m = v.select(F.col("tile").cast("long").alias("g"), "tp", "setup").unionByName(v.select((100 + F.floor(F.col("setup") / 10)).cast("long").alias("g"), "tp", "setup"))
    first = m.groupBy("tp", "setup").agg(F.min("g").alias("a"))
    links = m.join(first, ["tp", "setup"]).select("a", F.col("g").alias("b")).distinct()
    found = iterate.components(links)
    return m.select(F.col("g").alias("group_id")).distinct().join(found, F.col("group_id") == F.col("node"), "left").select("group_id", F.coalesce("component", "group_id").alias("merged"))
