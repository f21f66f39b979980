"""Queries over matching and alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumiframe.functions import affine
from lumiframe.functions import kernels as K
from lumiframe.operators import alignment as O
from lumiframe.operators import boxes
from lumiframe.operators import matching as M
from lumiframe.plans import bindings as B
from lumiframe.plans.bindings import sql
from lumiframe.plans.q_relations import LINK, correspondences
from lumiframe.plans.registry import query

DESC = "WITH d AS (SELECT a.vec_id AS i, b.vec_id AS j, list_sum(list_transform(range(1, 65), lambda k: (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE) ** 2)) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS p FROM d), t AS (SELECT i, max(CASE WHEN p = 1 THEN j END) AS j, max(CASE WHEN p = 1 THEN d END) AS best, max(CASE WHEN p = 2 THEN d END) AS second FROM r WHERE p <= 2 GROUP BY i) "


@query(DESC + "SELECT i AS id_a, j AS id_b, round(best, 6) AS best, round(second, 6) AS second FROM t WHERE best * 1.05 <= second")
def ratio_match(spark, d):
    """Descriptors of even ids against those of odd ids: the best two of each, and the ratio test."""
    e = B.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    two = M.nearest_two(e.where("id % 2 = 0"), e.where("id % 2 = 1"))
    return M.ratio_filter(two, 1.05, False).select("id_a", "id_b", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"))


@query("SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_sum(list_transform(range(1, 65), lambda k: (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE) ** 2)), 6) AS square, round(list_sum(list_transform(range(1, 65), lambda k: abs(a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE))), 6) AS manhattan FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def descriptor_distances(spark, d):
    e = B.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    p = e.toDF("id_a", "va").join(e.toDF("id_b", "vb"), F.col("id_b") == F.col("id_a") + 1)
    return p.select("id_a", "id_b", F.round(M.square_distance("va", "vb"), 6).alias("square"), F.round(M.manhattan_distance("va", "vb"), 6).alias("manhattan"))


WIDE = "SELECT o_custkey AS id_a, (o_custkey * 31 + o_orderkey) % 15000 AS id_b FROM orders"


def wide_matches(spark, d):
    return B.edge(spark, d, 15000).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


@query(f"WITH m AS ({WIDE}) SELECT id_a, id_b FROM (SELECT *, count(*) OVER (PARTITION BY id_a) AS n, count(*) OVER (PARTITION BY id_b) AS k FROM m) WHERE n = 1 AND k = 1")
def consistent_matches(spark, d):
    return M.consistent(wide_matches(spark, d))


@query(f"WITH m AS ({WIDE}) SELECT id_a, id_b FROM m WHERE id_a % 2 = 1 OR id_b % 3 <> 0")
def remove_inliers(spark, d):
    m = wide_matches(spark, d)
    return M.remove_matches(m, m.where("id_a % 2 = 0 and id_b % 3 = 0"), ["id_a", "id_b"])


@query(sql("SELECT tp, setup, label, round(avg(x), 5) AS x, round(avg(y), 5) AS y, round(avg(z), 5) AS z, round(median(x), 5) AS mx, round(median(y), 5) AS my, round(median(z), 5) AS mz FROM point GROUP BY tp, setup, label", "point"))
def center_of_mass(spark, d):
    p = B.interest_point(spark, d)
    by = ["tp", "setup", "label"]
    mean = M.centre_of_mass(p, by).select(*by, *[F.round(c, 5).alias(c) for c in "xyz"])
    return mean.join(M.centre_of_mass(p, by, "median").select(*by, *[F.round(c, 5).alias(f"m{c}") for c in "xyz"]), by)


@query("SELECT i AS i, s[1] AS a, s[2] AS b, s[3] AS c FROM (SELECT unnest(range(4)) AS i, unnest([[0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3]]) AS s)")
def neighbour_subsets(spark, d):
    return spark.createDataFrame([(i, *s) for i, s in enumerate(K.subsets(4, 3))], "i long, a int, b int, c int")


def shifted(spark, d):
    """Points of each view against the same points moved by a known shift, and back to front: a task per view and label."""
    p = B.interest_point(spark, d).withColumn("task", F.format_string("%d-%d-%s", "tp", "setup", "label")).withColumn("id", F.col("id").cast("long"))
    q = p.withColumns({"x": F.col("x") + 3.0, "y": F.col("y") - 2.0, "z": F.col("z") + 1.0, "id": F.col("id") + 1000})
    return p.select("task", "id", "x", "y", "z"), q.select("task", "id", "x", "y", "z")


def found(spark, d, matches):
    """task, n, off of matches: how many there are, and how far their places are from the known shift at most."""
    a, b = shifted(spark, d)
    m = matches.join(a.toDF("task", "id_a", "xa", "ya", "za"), ["task", "id_a"]).join(b.toDF("task", "id_b", "xb", "yb", "zb"), ["task", "id_b"])
    off = F.abs(F.col("xb") - F.col("xa") - 3) + F.abs(F.col("yb") - F.col("ya") + 2) + F.abs(F.col("zb") - F.col("za") - 1)
    return m.groupBy("task").agg(F.count(F.lit(1)).alias("n"), (F.round(F.max(off), 6) + 0.0).alias("off"))


#: Every point finds one that looks like it, and lies where the shift says; lists of four and fewer have too few neighbours.
FOUND = sql("SELECT concat(tp, '-', setup, '-', label) AS task, count(*) AS n, 0.0::DOUBLE AS off FROM point GROUP BY tp, setup, label HAVING count(*) > 4", "point")


@query(FOUND.replace("count(*) AS n", "count(DISTINCT (x, y, z)) AS n").replace("HAVING count(*) > 4", "HAVING count(DISTINCT (x, y, z)) > 4"))
def redundant_descriptor_matches(spark, d):
    """One point of each place: two at the same one look alike, and a strict ratio tells neither."""
    one = [s.groupBy("task", "x", "y", "z").agg(F.min("id").alias("id")).select("task", "id", "x", "y", "z") for s in shifted(spark, d)]
    return found(spark, d, M.descriptor_matches(*one, "redundant", 3.0, threshold=1e9))


@query(FOUND)
def fast_descriptor_matches(spark, d):
    return found(spark, d, M.descriptor_matches(*shifted(spark, d), "fast", 10.0))


@query(FOUND)
def geometric_hashing_matches(spark, d):
    return found(spark, d, M.descriptor_matches(*shifted(spark, d), "hashing", 10.0))


def true_matches(spark, d):
    a, b = shifted(spark, d)
    b = b.withColumn("id_a", F.col("id") - 1000)
    m = a.toDF("task", "id_a", "xa", "ya", "za").join(b.select("task", "id_a", F.col("id").alias("id_b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("z").alias("zb")), ["task", "id_a"])
    # every fourth match is wrong
    return m.withColumn("xb", F.col("xb") + F.when(F.col("id_a") % 4 == 3, 40.0 + F.col("id_a")).otherwise(0.0))


@query(sql("WITH n AS (SELECT *, count(*) OVER (PARTITION BY tp, setup, label) AS n FROM point) SELECT concat(tp, '-', setup, '-', label) AS task, CAST(id AS BIGINT) AS id_a, CAST(id + 1000 AS BIGINT) AS id_b, 0::BIGINT AS consensus FROM n WHERE id % 4 <> 3 AND n - n // 4 >= 6", "point"))
def ransac_inliers(spark, d):
    """Three quarters of the matches follow the shift; the others are off by different amounts, so the consensus is unique."""
    return M.ransac_inliers(true_matches(spark, d), "translation", 0.5, 0.1, 60, 6)


@query(sql("SELECT concat(tp, '-', setup, '-', label) AS task, round(3 + sum(CASE WHEN id % 4 = 3 THEN 40 + id ELSE 0 END) / count(*)::DOUBLE, 6) AS tx, -2.0::DOUBLE AS ty, 1.0::DOUBLE AS tz, count(*) AS n FROM point GROUP BY tp, setup, label", "point"))
def fit_translation(spark, d):
    return M.fit_translations(true_matches(spark, d)).select("task", *[F.round(c, 6).alias(c) for c in ("tx", "ty", "tz")], "n")


@query(sql("SELECT concat(tp, '-', setup, '-', label) AS task, i, CASE WHEN i IN (0, 5, 10) THEN 1.0 WHEN i = 3 THEN 2.7 WHEN i = 7 THEN -1.8 WHEN i = 11 THEN 0.9 ELSE 0.0 END::DOUBLE AS v FROM (SELECT tp, setup, label FROM point WHERE id % 4 <> 3 GROUP BY ALL) t, range(12) r(i)", "point"))
def interpolated_model(spark, d):
    """Translations blended with identity by a tenth."""
    m = M.fit_models(true_matches(spark, d).where("id_a % 4 <> 3"), "translation", "identity", 0.1)
    return m.select("task", F.posexplode("m").alias("i", "v")).select("task", F.col("i").cast("long").alias("i"), (F.round("v", 6) + 0.0).alias("v"))


@query(sql("SELECT concat(tp, '-', setup, '-', label) AS task, CASE WHEN count(*) >= 3 THEN 0.0::DOUBLE END AS error FROM point WHERE id % 4 <> 3 GROUP BY tp, setup, label", "point"))
def rigid_models(spark, d):
    out = M.fit_models(true_matches(spark, d).where("id_a % 4 <> 3"), "rigid")
    return out.select("task", F.round("error", 6).alias("error"))


def jittered(spark, d):
    """Points on a grid of 20 and the same points moved by (3, -2, 1), nearer to their own partner than to any other; a list's points share no place."""
    w = Window.partitionBy("tp", "setup", "label").orderBy("id")
    p = B.interest_point(spark, d).withColumn("k", F.row_number().over(w) - 1)
    p = p.select(F.format_string("%d-%d-%s", "tp", "setup", "label").alias("task"), F.col("id").cast("long").alias("id"), *[(F.expr(e) * 20 + F.col("z") % 3).alias(c) for c, e in (("x", "k % 10"), ("y", "k div 10 % 10"), ("z", "k div 100"))])
    return p, p.select("task", (F.col("id") + 1000).alias("id"), (F.col("x") + 3).alias("x"), (F.col("y") - 2).alias("y"), (F.col("z") + 1).alias("z"))


@query(sql("SELECT concat(tp, '-', setup, '-', label) AS task, CAST(id AS BIGINT) AS id_a, CAST(id + 1000 AS BIGINT) AS id_b, round(m.v, 5) AS m3 FROM (SELECT *, count(*) OVER (PARTITION BY tp, setup, label) AS n FROM point), (SELECT 3.0::DOUBLE AS v) m WHERE n >= 6", "point"))
def icp_matches(spark, d):
    """Every point finds its own partner, and the map is the shift."""
    return M.icp_matches(*jittered(spark, d), reach=6.0, least=6).select("task", "id_a", "id_b", F.round(F.col("m")[3], 5).alias("m3"))


@query(sql(f"WITH l AS ({LINK}), w(label, weight) AS (VALUES ('A', 0.5), ('N', 2.0)), k AS (SELECT l.*, (coalesce(a.weight, 1) + coalesce(b.weight, 1)) / 2 AS weight FROM l LEFT JOIN w a ON a.label = l.label LEFT JOIN w b ON b.label = l.c_label) SELECT tp, setup, label, id, c_tp, c_setup, c_label, c_id, weight::DOUBLE AS weight FROM k UNION ALL SELECT c_tp, c_setup, c_label, c_id, tp, setup, label, id, weight::DOUBLE FROM k", "point"))
def strong_links(spark, d):
    w = spark.createDataFrame([("A", 0.5), ("N", 2.0)], "label string, weight double")
    return O.strong_links(correspondences(spark, d), w)


EDGE_MATCH = "WITH m AS (SELECT a, b, CASE WHEN a % 7 = 0 THEN 0 ELSE 1 END::DOUBLE AS weight, r FROM edge WHERE a <> b)"


def edge_matches(spark, d):
    e = B.edge(spark, d).where("a <> b")
    return e.select("a", "b", F.when(F.col("a") % 7 == 0, 0.0).otherwise(1.0).alias("weight"), "r")


@query(sql(EDGE_MATCH + ", n AS (SELECT v AS view, count(*) AS n FROM (SELECT a AS v FROM m UNION ALL SELECT b FROM m) GROUP BY v), s AS (SELECT view, n / sum(n) OVER (PARTITION BY view % 10) AS share FROM n WHERE view % 3 = 0), f AS (SELECT view, max(share) OVER (PARTITION BY view % 10) / share AS f FROM s) SELECT a, b, r, round(CASE WHEN weight = 0 THEN 1 ELSE weight END * greatest(coalesce(x.f, 1), coalesce(y.f, 1)), 6) AS weight FROM m LEFT JOIN f x ON x.view = a LEFT JOIN f y ON y.view = b", "edge"))
def balance_weights(spark, d):
    m = edge_matches(spark, d)
    groups = m.select(F.explode(F.array("a", "b")).alias("view")).distinct().where("view % 3 = 0").withColumn("group", F.col("view") % 10)
    return O.balance_weights(m, groups).select("a", "b", "r", F.round("weight", 6).alias("weight"))


SCORED = "WITH m AS (SELECT a, b, 1.0::DOUBLE AS weight, sqrt(r) AS distance, (a % 10) / 10.0::DOUBLE AS quality FROM edge WHERE a <> b), s AS (SELECT a, b, sum(weight * (1.01 - least(1, greatest(0.01, quality))) * distance) / sum(weight) AS score FROM m GROUP BY a, b), g AS (SELECT v, count(*) AS d FROM (SELECT a AS v FROM s UNION ALL SELECT b FROM s) GROUP BY v) "


def scored(spark, d):
    return B.edge(spark, d).where("a <> b").select("a", "b", F.lit(1.0).alias("weight"), F.sqrt("r").alias("distance"), ((F.col("a") % 10) / 10).alias("quality"))


@query(sql(SCORED + "SELECT s.a, s.b, round(score, 3) AS score, x.d AS d_a, y.d AS d_b FROM s JOIN g x ON x.v = s.a JOIN g y ON y.v = s.b", "edge"))
def link_scores(spark, d):
    return O.link_scores(scored(spark, d)).select("a", "b", F.round("score", 3).alias("score"), "d_a", "d_b")


@query(sql(SCORED + "SELECT s.a, s.b, round(score, 3) AS score FROM s JOIN g x ON x.v = s.a JOIN g y ON y.v = s.b WHERE x.d > 1 AND y.d > 1 ORDER BY s.score DESC, s.a, s.b LIMIT 1", "edge"))
def worst_link(spark, d):
    return O.worst_link(scored(spark, d)).select("a", "b", F.round("score", 3).alias("score"))


@query(sql("SELECT a, b, round(sum(r * r) / sum(r), 4) AS error, count(*) AS n FROM edge GROUP BY a, b", "edge"))
def alignment_error(spark, d):
    e = B.edge(spark, d).select("a", "b", F.col("r").alias("weight"), F.col("r").alias("distance"))
    return O.alignment_errors(e).select("a", "b", F.round("error", 4).alias("error"), "n")


@query(sql("WITH p AS (SELECT a, b, r, 0.5 * (a % 5) AS dx, 1.0 * (b % 3) AS dy FROM edge), e AS (SELECT a, b, r, sqrt(dx * dx + dy * dy) AS e FROM p) SELECT v AS view, round(avg(e), 5) AS error, round(avg(r), 4) AS r FROM (SELECT a AS v, e, r FROM e UNION ALL SELECT b, e, r FROM e) GROUP BY v", "edge"))
def stitching_errors(spark, d):
    e = B.edge(spark, d).select("a", "b", "r", (0.5 * (F.col("a") % 5)).alias("dx"), (1.0 * (F.col("b") % 3)).alias("dy"), F.lit(0.0).alias("dz"))
    return O.stitching_errors(e).select("view", F.round("error", 5).alias("error"), F.round("r", 4).alias("r"))


@query(sql("WITH p AS (SELECT a, b, r / 1000000 AS r, CAST(a % 9 AS DOUBLE) AS sx FROM edge WHERE r >= 250000) SELECT a, b, x AS px, y AS py, z AS pz, x - sx AS qx, y AS qy, z AS qz, r AS quality FROM p, (VALUES (0.0::DOUBLE), (99.0)) vx(x), (VALUES (0.0::DOUBLE), (49.0)) vy(y), (VALUES (0.0::DOUBLE), (9.0)) vz(z)", "edge"))
def stitching_links(spark, d):
    box = {"min_x": 0.0, "min_y": 0.0, "min_z": 0.0, "max_x": 99.0, "max_y": 49.0, "max_z": 9.0, "shift_y": 0.0, "shift_z": 0.0}
    e = B.edge(spark, d).select("a", "b", (F.col("r") / 1000000).alias("r"), (F.col("a") % 9).cast("double").alias("shift_x"), *[F.lit(v).alias(k) for k, v in box.items()])
    return O.stitching_links(e, 0.25)


@query(sql("WITH b AS (SELECT tp, setup, channel, tx AS lx, tx + sx - 1 AS hx, ty AS ly, ty + sy - 1 AS hy, tz AS lz, tz + sz - 1 AS hz FROM model), p AS (SELECT i.tp, i.setup AS setup_a, j.setup AS setup_b, greatest(i.lx, j.lx) AS lx, least(i.hx, j.hx) AS hx, greatest(i.ly, j.ly) AS ly, least(i.hy, j.hy) AS hy, greatest(i.lz, j.lz) AS lz, least(i.hz, j.hz) AS hz FROM b i JOIN b j ON i.tp = j.tp AND i.setup < j.setup AND i.channel <> j.channel) SELECT tp, setup_a, setup_b, CASE WHEN q.i % 2 = 0 THEN lx ELSE hx END AS x, CASE WHEN q.i // 2 % 2 = 0 THEN ly ELSE hy END AS y, CASE WHEN q.i // 4 = 0 THEN lz ELSE hz END AS z FROM p, range(8) q(i) WHERE lx <= hx AND ly <= hy AND lz <= hz", "model"))
def weak_links(spark, d):
    v = boxes.view_bounds(B.view_model(spark, d))
    return O.weak_links(v, "setup", "channel", ["tp"])


@query(sql("WITH p AS (SELECT CAST(a % 20 AS INT) AS tp_a, CAST(b % 20 AS INT) AS tp_b, CASE WHEN a % 11 = 0 THEN NULL ELSE r END AS error, (b % 7) / 10.0::DOUBLE AS ratio FROM edge), q AS (SELECT tp_a AS tp, error, ratio FROM p UNION ALL SELECT tp_b, error, ratio FROM p WHERE tp_a <> tp_b) SELECT tp, round(min(error) FILTER (ratio > 0), 4) AS least, round(avg(error) FILTER (ratio > 0), 4) AS mean, round(max(error) FILTER (ratio > 0), 4) AS most, count(*) FILTER (error IS NOT NULL AND ratio > 0) AS valid, count(*) FILTER (NOT (error IS NOT NULL AND ratio > 0)) AS invalid FROM q GROUP BY tp", "edge"))
def timepoint_statistics(spark, d):
    return O.timepoint_statistics(_results(spark, d)).select("tp", *[F.round(c, 4).alias(c) for c in ("least", "mean", "most")], "valid", "invalid")


def _results(spark, d):
    return B.edge(spark, d).select((F.col("a") % 20).cast("int").alias("tp_a"), (F.col("b") % 20).cast("int").alias("tp_b"), F.when(F.col("a") % 11 != 0, F.col("r")).alias("error"), ((F.col("b") % 7) / 10).alias("ratio"))


@query(sql("WITH p AS (SELECT CAST(a % 20 AS INT) AS tp_a, CAST(b % 20 AS INT) AS tp_b, r AS error, (b % 7) / 10.0::DOUBLE AS ratio, a % 11 <> 0 AND b % 7 > 0 AS ok FROM edge), q AS (SELECT tp_a AS tp, error, ratio, ok FROM p UNION ALL SELECT tp_b, error, ratio, ok FROM p WHERE tp_a <> tp_b), s AS (SELECT tp, max(error) FILTER (ok) AS most, min(ratio) FILTER (ok) AS ratio FROM q GROUP BY tp), k AS (SELECT tp, rank() OVER (ORDER BY most) + rank() OVER (ORDER BY 10 - ratio) AS ranks FROM s) SELECT arg_min(tp, (ranks, tp)) AS tp, min(ranks) AS ranks FROM k", "edge"))
def reference_timepoint(spark, d):
    out = O.reference_timepoint(O.timepoint_statistics(_results(spark, d)))
    return out.select("tp", F.col("ranks").cast("long").alias("ranks"))


def chain(spark, d):
    """Pair statistics along lines of setups whose true positions are known, ten to a line."""
    s = B.view_setup(spark, d).select(F.col("setup").cast("long").alias("a")).where("a % 10 < 9")
    s = s.join(B.view_setup(spark, d).select((F.col("setup") - 1).cast("long").alias("a")), "a")
    shift = lambda k: ((k * (F.col("a") + 1)) % 17 - (k * F.col("a")) % 17).cast("double")
    return s.select("a", (F.col("a") + 1).alias("b"), F.lit(8).alias("n"), F.lit(1.0).alias("weight"), shift(3).alias("sx"), shift(5).alias("sy"), shift(7).alias("sz"), F.lit(0.9).alias("quality"))


CHAIN = "SELECT CAST(setup AS BIGINT) AS view, round((3 * setup % 17 - 3 * (setup - setup % 10) % 17)::DOUBLE, 6) AS tx, round((5 * setup % 17 - 5 * (setup - setup % 10) % 17)::DOUBLE, 6) AS ty, round((7 * setup % 17 - 7 * (setup - setup % 10) % 17)::DOUBLE, 6) AS tz FROM view_setup"


@query(sql(CHAIN, "view_setup"))
def global_solve(spark, d):
    """Exact shifts give back the positions, relative to the first view of each line."""
    none = spark.createDataFrame([], "view long")
    return O.solve(chain(spark, d), none).select("view", *[(F.round(c, 6) + 0.0).alias(c) for c in ("tx", "ty", "tz")])


@query(sql(CHAIN, "view_setup"))
def global_solve_iterative(spark, d):
    """A wrong link from each line's first to its last view is dropped, and the positions come back."""
    c = chain(spark, d)
    wrong = c.where("a % 10 = 0").join(c.where("b % 10 = 9").select(F.col("b").alias("last")), F.floor(F.col("a") / 10) == F.floor(F.col("last") / 10)).select("a", F.col("last").alias("b"), "n", "weight", F.lit(400.0).alias("sx"), F.lit(0.0).alias("sy"), F.lit(0.0).alias("sz"), F.lit(0.1).alias("quality"))
    none = spark.createDataFrame([], "view long")
    return O.solve(c.unionByName(wrong), none, 2.5, 3.5).select("view", *[(F.round(x, 6) + 0.0).alias(x) for x in ("tx", "ty", "tz")])


@query("SELECT CAST(i AS BIGINT) AS view, x::DOUBLE AS tx, y::DOUBLE AS ty, 0.0::DOUBLE AS tz FROM (SELECT unnest(range(3)) AS i, unnest([0, 100, 50]) AS x, unnest([0, 0, 0]) AS y)")
def global_solve_two_rounds(spark, d):
    """Two views with a strong link, a third that only weak links hold between them."""
    cols = "a long, b long, n int, weight double, sx double, sy double, sz double, quality double"
    strong = spark.createDataFrame([(0, 1, 8, 1.0, 100.0, 0.0, 0.0, 0.5)], cols)
    weak = spark.createDataFrame([(0, 2, 8, 8.0, 0.0, 0.0, 0.0, 0.1), (1, 2, 8, 8.0, 0.0, 0.0, 0.0, 0.1)], cols)
    views = spark.createDataFrame([(0,), (1,), (2,)], "view long")
    out = O.solve_two_rounds(strong, weak, views, spark.createDataFrame([(0,)], "view long"), 10.0, 10.0)
    return out.select("view", *[(F.round(c, 6) + 0.0).alias(c) for c in ("tx", "ty", "tz")])


def truth(spark, d, shear: bool):
    """view, m: made-up placements of as many views as there are customers, in lines of ten whose first stays: turned by 0.8/0.6 about z, sheared, moved."""
    k = F.col("view") % 10
    t = k % 3
    c, s = 1 - 0.2 * t, F.when(t == 0, 0.0).otherwise(0.4 + 0.2 * t)
    h = (0.1 * (k % 4)) if shear else F.lit(0.0)
    nil, one = F.lit(0.0), F.lit(1.0)
    v = B.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("view"))
    return v.withColumn("m", affine.from_columns(c, h * c - s, nil, 7 * k, s, h * s + c, nil, -11 * k, nil, nil, one, 3 * k))


def truth_matches(spark, d, shear: bool):
    """Twelve places in the world seen by each view and by the next two of its line."""
    m = truth(spark, d, shear)
    step = m.select(F.col("view").alias("a"), F.col("m").alias("m_a"), F.explode(F.array(F.lit(1), F.lit(2))).alias("by")).where("a % 10 + by < 10")
    # maps are many times the file's column of keys, so they're never broadcast
    step = step.join(m.select(F.col("view").alias("b"), F.col("m").alias("m_b")).hint("merge"), F.col("b") == F.col("a") + F.col("by"))
    w = step.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(11))))
    at = [(F.col("i") * 17 % 29 + F.col("a") % 5).cast("double"), (F.col("i") * 11 % 23).cast("double"), (F.col("i") * 5 % 13).cast("double")]
    p, q = (affine.apply(affine.inverse(F.col(f"m_{e}")), *at) for e in "ab")
    return w.select("a", "b", *[x.alias(f"{s}{c}") for s, v in (("p", p), ("q", q)) for x, c in zip(v, "xyz", strict=True)], F.lit(1.0).alias("weight"), F.lit(0.9).alias("quality"))


def placed(out):
    return out.select("view", F.posexplode("m").alias("i", "v")).select("view", F.col("i").cast("long").alias("i"), (F.round("v", 4) + 0.0).alias("v"))


TRUTH = """WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS view, c_custkey % 10 AS k, c_custkey % 10 % 3 AS t FROM customer),
 c AS (SELECT view, k, 1 - 0.2::DOUBLE * t AS c, CASE WHEN t = 0 THEN 0 ELSE 0.4::DOUBLE + 0.2::DOUBLE * t END AS s, {shear} AS h FROM t)
 SELECT view, CAST(i AS BIGINT) AS i, round(v, 4) AS v FROM (SELECT view, unnest(range(12)) AS i, unnest([c, h * c - s, 0, 7 * k, s, h * s + c, 0, -11 * k, 0, 0, 1, 3 * k]) AS v FROM c)"""
RIGID, SHEARED = TRUTH.format(shear="0"), TRUTH.format(shear="0.1::DOUBLE * (k % 4)")


@query(RIGID)
def global_solve_rigid(spark, d):
    """Turned views come back from their matches."""
    return placed(O.solve_models(truth_matches(spark, d, False), truth(spark, d, False).select("view"), spark.createDataFrame([], "view long"), "rigid"))


@query(SHEARED)
def global_solve_affine(spark, d):
    return placed(O.solve_models(truth_matches(spark, d, True), truth(spark, d, True).select("view"), spark.createDataFrame([], "view long"), "affine"))


@query(RIGID)
def global_solve_rigid_iterative(spark, d):
    """A wrong link from each line's first to its last view is found and dropped."""
    good = truth_matches(spark, d, False)
    first = good.where("a % 10 = 0 and b % 10 = 1")
    last = truth(spark, d, False).select(F.col("view").alias("last")).where("last % 10 = 9")
    wrong = first.join(last, F.col("last") == F.col("a") + 9).withColumns({"b": F.col("last"), "qx": F.col("qx") + 400, "quality": F.lit(0.1)}).drop("last")
    return placed(O.solve_models(good.unionByName(wrong), truth(spark, d, False).select("view"), spark.createDataFrame([], "view long"), "rigid", relative=2.5, absolute=3.5))


@query(RIGID)
def global_solve_rigid_two_rounds(spark, d):
    """Links over the middle of each line are weak: round one places its halves, round two the second half as a whole."""
    m = truth_matches(spark, d, False)
    over = "a % 10 < 5 and b % 10 >= 5"
    lines = truth(spark, d, False).select("view").where("view % 10 = 0")
    return placed(O.solve_models_two_rounds(m.where(f"not ({over})"), m.where(over), truth(spark, d, False).select("view"), lines, "rigid"))


@query("""WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS view, c_custkey % 10 AS k FROM customer) SELECT view, CAST(i AS BIGINT) AS i, round(v, 4) AS v
 FROM (SELECT view, unnest(range(12)) AS i, unnest([1, 0, 0, 6.0 * (k // 2), 0, 1, 0, 2.0 * (k // 2), 0, 0, 1, 0]) AS v FROM t)""")
def global_solve_groups(spark, d):
    """Views in pairs that move as one tile: links between neighbouring pairs move both alike."""
    v = truth(spark, d, False).select("view")
    at = v.select(F.col("view").alias("a")).where("a % 10 < 9 and a % 2 = 1").join(v.select(F.col("view").alias("b")), F.col("b") == F.col("a") + 1)
    m = at.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("a", "b", *[(F.col("i") * k % 11).cast("double").alias(f"p{c}") for c, k in zip("xyz", (3, 5, 7), strict=True)], F.lit(1.0).alias("weight"), F.lit(0.9).alias("quality"))
    m = m.withColumns({"qx": F.col("px") - 6, "qy": F.col("py") - 2, "qz": F.col("pz")})
    groups = v.select(F.expr("view div 2").alias("group_id"), "view")
    return placed(O.solve_models(m, v, spark.createDataFrame([], "view long"), "translation", groups=groups))


@query(sql("SELECT CAST(setup - setup % 10 AS BIGINT) AS component, CAST(setup - setup % 10 AS BIGINT) AS view FROM view_setup WHERE setup % 10 = 0", "view_setup"))
def fix_views(spark, d):
    m = B.view_setup(spark, d).select(F.col("setup").cast("long").alias("view"), (F.col("setup") - F.col("setup") % 10).cast("long").alias("component"))
    return O.fix_views(m)
