"""Queries over intensities, deconvolution and quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumiframe.operators import intensity as I
from lumiframe.operators import restoration as X
from lumiframe.plans import bindings as B
from lumiframe.plans.bindings import sql
from lumiframe.plans.registry import query

R = F.round
PAIRS = "SELECT a.setup AS setup_a, b.setup AS setup_b, a.x, a.v AS p, b.v AS q FROM voxel a JOIN voxel b ON a.x = b.x AND a.setup < b.setup"


@query(sql(PAIRS.replace("a.v AS p, b.v AS q", "round(a.v, 6) AS p, round(b.v, 6) AS q") + " WHERE a.v BETWEEN 5 AND 250 AND b.v BETWEEN 5 AND 250", "voxel"))
def intensity_pairs(spark, d):
    return I.voxel_pairs(B.voxel(spark, d), 5.0, 250.0).select("setup_a", "setup_b", "x", R("p", 6).alias("p"), R("q", 6).alias("q"))


@query(sql(f"WITH p AS ({PAIRS}) SELECT setup_a, setup_b, CAST(x // 32 AS INT) AS cell, count(*) AS n, count(*) > 31 AS used FROM p GROUP BY ALL", "voxel"))
def intensity_candidates(spark, d):
    c = I.candidates(I.voxel_pairs(B.voxel(spark, d)), 32, 31)
    return c.select("setup_a", "setup_b", "cell", "n", "used").distinct()


@query(sql("WITH c AS (SELECT setup, i AS cell, 7 * setup % 50 + i * 8.0::DOUBLE AS lo, 7 * setup % 50 + i * 8.0::DOUBLE + 7.5 AS hi FROM view_setup, range(8) r(i)) SELECT a.setup AS setup_a, CAST(a.cell AS INT) AS cell_a, b.setup AS setup_b, CAST(b.cell AS INT) AS cell_b FROM c a JOIN c b ON a.setup < b.setup AND a.lo <= b.hi AND b.lo <= a.hi", "view_setup"))
def coefficient_cell_pairs(spark, d):
    s = B.view_setup(spark, d).select("setup", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("cell"))
    c = s.withColumn("lo", ((7 * F.col("setup")) % 50 + F.col("cell") * 8.0)).withColumn("hi", F.col("lo") + 7.5)
    return I.cell_pairs(c).select("setup_a", "cell_a", "setup_b", "cell_b")


@query(sql(f"WITH p AS ({PAIRS}) SELECT setup_a, setup_b, round(regr_slope(q, p), 5) AS slope, round(regr_intercept(q, p), 5) AS intercept, count(*) AS n FROM p GROUP BY ALL", "voxel"))
def linear_fit(spark, d):
    f = I.line_fit(I.voxel_pairs(B.voxel(spark, d)), ["setup_a", "setup_b"])
    return f.select("setup_a", "setup_b", R("slope", 5).alias("slope"), R("intercept", 5).alias("intercept"), "n")


@query(sql(f"WITH p AS ({PAIRS}), s AS (SELECT setup_a, setup_b, list_sort(list(p)) AS ps, list_sort(list(q)) AS qs, count(*) AS n FROM p GROUP BY ALL), k AS (SELECT setup_a, setup_b, ps[n * i // 100 + 1] AS p, qs[n * i // 100 + 1] AS q FROM s, range(100) r(i)) SELECT setup_a, setup_b, round(regr_slope(q, p), 5) AS slope, round(regr_intercept(q, p), 4) AS intercept, round(min(p), 5) AS lo, round(max(p), 5) AS hi FROM k GROUP BY ALL", "voxel"))
def histogram_match(spark, d):
    h = I.histogram_match(I.voxel_pairs(B.voxel(spark, d)), ["setup_a", "setup_b"])
    return h.select("setup_a", "setup_b", R("slope", 5).alias("slope"), R("intercept", 4).alias("intercept"), R("lo", 5).alias("lo"), R("hi", 5).alias("hi"))


FIELD = "SELECT s.setup, CAST(c.i AS INT) AS cell, 0.512345::DOUBLE + (s.setup * 8 + c.i) % 10 / 7.0::DOUBLE AS a, (s.setup + c.i * 3) % 7 - 3.0::DOUBLE AS b FROM range(8) s(setup), range(8) c(i)"


def field(spark, d):
    f = spark.range(64).select((F.col("id") / 8).cast("int").alias("setup"), (F.col("id") % 8).cast("int").alias("cell"))
    return f.select("setup", "cell", (0.512345 + (F.col("setup") * 8 + F.col("cell")) % 10 / 7.0).alias("a"), ((F.col("setup") + F.col("cell") * 3) % 7 - 3.0).alias("b"))


@query(sql(f"WITH f AS ({FIELD}), v AS (SELECT *, (x - 16.0) / 32 AS pos, floor((x - 16.0) / 32) AS c FROM voxel), w AS (SELECT v.*, pos - c AS t, greatest(0, least(7, c)) AS c0, greatest(0, least(7, c + 1)) AS c1 FROM v) SELECT w.setup, w.x, round(least(255, greatest(0, v * ((1 - t) * p.a + t * q.a) + (1 - t) * p.b + t * q.b)), 5) AS v FROM w JOIN f p ON p.setup = w.setup AND p.cell = c0 JOIN f q ON q.setup = w.setup AND q.cell = c1", "voxel"))
def apply_coefficients(spark, d):
    return I.apply_field(B.voxel(spark, d), field(spark, d), 256, 8, 0.0, 255.0).select("setup", "x", R("v", 5).alias("v"))


@query(sql("SELECT setup, x, round(v / power(0.9::DOUBLE, setup % 3), 5) AS v FROM voxel", "voxel"))
def unbleach(spark, d):
    v = B.voxel(spark, d)
    n = v.select("setup").distinct().withColumn("n", F.col("setup") % 3)
    return I.unbleach(v, n, 0.9).select("setup", "x", R("v", 5).alias("v"))


def _noisy_pairs(spark, d):
    v = B.voxel(spark, d)
    p = v.select("setup", "x", F.col("v").alias("p"))
    wrong = F.when(F.col("x") % 5 == 0, 50.0 + F.col("x")).otherwise(0.0)
    return p.withColumn("q", (1 + F.col("setup") / 4) * F.col("p") + F.col("setup") + wrong)


@query(sql("SELECT DISTINCT setup, round(1 + setup / 4.0, 5)::DOUBLE AS slope, setup::DOUBLE AS intercept FROM voxel", "voxel"))
def intensity_ransac(spark, d):
    """A fifth of the pairs is off; the line through the others comes back."""
    m = I.ransac_match(_noisy_pairs(spark, d), ["setup"], 0.01, 0.1, 200, 10, 1000.0)
    return m.select("setup", R("slope", 5).alias("slope"), (R("intercept", 4) + 0.0).alias("intercept"))


@query(sql("SELECT CAST(setup AS BIGINT) AS node, round(1 + setup / 4.0, 5)::DOUBLE AS a, round(setup * 3.0, 4)::DOUBLE AS b FROM (SELECT DISTINCT setup FROM voxel)", "voxel"))
def intensity_solve(spark, d):
    """Joint value maps of all views, which are one signal under a line each: the lines come back, relative to the first view."""
    signal = B.line(spark, d).groupBy("x").agg(F.avg("v").alias("u"))
    v = B.line(spark, d).select("setup", "x").join(signal, "x").select("setup", "x", ((F.col("u") - 3 * F.col("setup")) / (1 + F.col("setup") / 4)).alias("v"))
    p = I.voxel_pairs(v).select(F.col("setup_a").cast("long").alias("node_a"), F.col("setup_b").cast("long").alias("node_b"), "p", "q", F.lit(1.0).alias("weight"))
    return I.subtract_least(I.solve_fields(p, rigidity=0.0)).select("node", R("a", 5).alias("a"), (R("b", 4) + 0.0).alias("b"))


@query(sql("SELECT setup, x, round(CASE WHEN v > 40 THEN v / (v * 0.5 + x + 1) ELSE 1 END, 6) AS r FROM (SELECT setup, x, v, v FROM voxel)", "voxel"))
def quotient(spark, d):
    v = B.voxel(spark, d)
    return v.select("setup", "x", R(X.quotient(F.when(F.col("v") > 40, F.col("v")).otherwise(0.0), F.col("v") * 0.5 + F.col("x") + 1), 6).alias("r"))


@query(sql("WITH u AS (SELECT setup, x, v + 1 AS last, 0.5 + x / 256.0::DOUBLE AS i, (x % 4) / 4.0::DOUBLE AS w FROM voxel), t AS (SELECT *, last * i / 100 AS y FROM u) SELECT setup, x, round(last + (CASE WHEN y > 0 THEN greatest(1e-4, (sqrt(1 + 2 * 0.006 * greatest(y, 0)) - 1) / 0.006 * 100) ELSE 1e-4 END - last) * w, 5) AS psi FROM t", "voxel"))
def rl_update(spark, d):
    v = B.voxel(spark, d)
    return v.select("setup", "x", R(X.update(F.col("v") + 1, 0.5 + F.col("x") / 256.0, (F.col("x") % 4) / 4.0, 100.0, 0.006), 5).alias("psi"))


@query(sql("WITH u AS (SELECT setup, x, v + 1 AS last, 0.5 + x / 256.0::DOUBLE AS i, 1.5 - x / 256.0::DOUBLE AS j, 0.7::DOUBLE AS w, (x % 4) / 4.0::DOUBLE AS u FROM voxel) SELECT setup, x, round(last * exp(w * CASE WHEN w + u > 1 THEN 1 / (w + u) ELSE 1 END * ln(i) + u * CASE WHEN w + u > 1 THEN 1 / (w + u) ELSE 1 END * ln(j)), 5) AS psi FROM u", "voxel"))
def rl_update_multiplicative(spark, d):
    x = F.col("x")
    psi = X.multiplicative_update(F.col("v") + 1, [0.5 + x / 256.0, 1.5 - x / 256.0], [F.lit(0.7), (x % 4) / 4.0])
    return B.voxel(spark, d).select("setup", "x", R(psi, 5).alias("psi"))


@query(sql("SELECT setup, round(sum(x * 0.25 - v), 4) AS total, round(max(x * 0.25 - v), 4) AS largest FROM voxel GROUP BY setup", "voxel"))
def change_statistics(spark, d):
    v = B.voxel(spark, d).withColumn("next", F.col("x") * 0.25)
    return X.change(v, "v", "next", ["setup"]).select("setup", R("total", 4).alias("total"), R("largest", 4).alias("largest"))


WEIGHTS = "WITH u AS (SELECT setup, x, least(1, v / 100) AS w, sum(least(1, v / 100)) OVER (PARTITION BY x) AS t FROM voxel) "


@query(sql(WEIGHTS + "SELECT setup, x, round(CASE WHEN t <= 0 THEN 0 ELSE least(1, CASE WHEN t > 1 THEN w / t ELSE w END * 2) END, 6) AS normal FROM u", "voxel"))
def normalize_weights(spark, d):
    v = B.voxel(spark, d).withColumn("w", F.col("v") / 100)
    return X.normalise_weights(v, ["x"], speed=2.0).select("setup", "x", R("normal", 6).alias("normal"))


@query(sql(WEIGHTS + "SELECT setup, x, round(CASE WHEN t <= 0 THEN 0 ELSE least(1, least(w, w / t) - greatest(0, (0.1 - abs(w - w / t)) / 0.1) * w * 0.05) END, 6) AS normal FROM u", "voxel"))
def normalize_weights_smooth(spark, d):
    v = B.voxel(spark, d).withColumn("w", F.col("v") / 100)
    return X.normalise_weights(v, ["x"], smooth=True).select("setup", "x", R("normal", 6).alias("normal"))


@query(sql("SELECT x, round(sum(v * v) / sum(v), 5) AS psi, round((SELECT avg(v) FROM voxel), 5) AS mean FROM voxel GROUP BY x", "voxel"))
def initial_estimate(spark, d):
    v = B.voxel(spark, d).withColumn("w", F.col("v"))
    mean = X.initial_estimate(v, ["x"], "average").select("x", R("psi", 5).alias("mean"))
    return X.initial_estimate(v, ["x"], "blurred fused").select("x", R("psi", 5).alias("psi")).join(mean, "x")


@query(sql("SELECT CAST(b.i AS BIGINT) AS block, setup, x, x // 64 = b.i AS own FROM voxel, range(5) b(i) WHERE x >= b.i * 64 - 5 AND x < (b.i + 1) * 64 + 5", "voxel"))
def halo_blocks(spark, d):
    return X.with_halo(B.voxel(spark, d), "x", 64, 5).select("block", "setup", "x", "own")


@query(sql("WITH p AS (SELECT setup, x FROM voxel WHERE v > 55 AND x BETWEEN 8 AND 240), s AS (SELECT p.setup, o.i AS offs, avg(v.v) AS m FROM p, range(-3, 4) o(i), voxel v WHERE v.setup = p.setup AND v.x = p.x + o.i GROUP BY ALL) SELECT setup, CAST(offs AS INT) AS \"offset\", round((m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w), 5) AS psf FROM s WINDOW w AS (PARTITION BY setup)", "voxel"))
def psf_extract(spark, d):
    v = B.voxel(spark, d)
    return X.psf_extract(v, v.where("v > 55 and x between 8 and 240").select("setup", "x"), 3).select("setup", "offset", R("psf", 5).alias("psf"))


@query(sql("WITH p AS (SELECT setup, x - 128 AS offs, v FROM voxel WHERE abs(x - 128) <= 2 + setup) SELECT offs AS \"offset\", round(sum(v) / (SELECT count(DISTINCT setup) FROM p), 5) AS psf FROM p GROUP BY offs", "voxel"))
def psf_average(spark, d):
    p = B.voxel(spark, d).select("setup", (F.col("x") - 128).alias("offset"), F.col("v").alias("psf")).where("abs(offset) <= 2 + setup")
    return X.psf_average(p).select("offset", R("psf", 5).alias("psf"))


@query(sql("WITH d AS (SELECT user_id, i, v - 20 AS d, lag(v - 20) OVER w AS e, lag(i) OVER w AS h FROM series WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, round(h + (i - h) * e / (e - d), 5) AS crossing, round(2 * 257 / (h + (i - h) * e / (e - d)), 5) AS pixels FROM d WHERE e > 0 AND d <= 0", "series"))
def frc_crossings(spark, d):
    c = X.crossings(B.series(spark, d), ["user_id"], "i", "v", F.lit(20.0))
    return c.select("user_id", R("crossing", 5).alias("crossing"), R(X.resolution(F.col("crossing"), 256), 5).alias("pixels"))


@query("SELECT CAST(n AS INT) AS n, 0.1428::DOUBLE AS fixed, round((0.2071 * sqrt(n) + 1.9102) / (1.2071 * sqrt(n) + 0.9102), 6) AS half_bit, round(3 / sqrt(n / 2.0), 6) AS three_sigma FROM range(1, 200) t(n)")
def frc_thresholds(spark, d):
    n = spark.range(1, 200).select(F.col("id").cast("int").alias("n"))
    t = lambda k: X.thresholds(k, F.col("n"))
    return n.select("n", t("fixed").alias("fixed"), R(t("half-bit"), 6).alias("half_bit"), R(t("three sigma"), 6).alias("three_sigma"))


def tiles(spark, d):
    """Squares of 16 from pairs of views of 256 voxels."""
    v = B.voxel(spark, d).groupBy("setup").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("s"), F.count(F.lit(1)).alias("n"))
    full = v.select("setup", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.get(F.col("s")["v"], F.pmod(i, F.size("s")))).alias("data"))
    return full.toDF("a", "first").join(full.toDF("b", "second"), F.col("a") < F.col("b")).select((F.col("a") * 8 + F.col("b")).cast("long").alias("location"), "first", "second")


#: The same by sums over all frequencies: tiles of 16, tapered over two places, rings of radius 1 to 6.
RINGS = """WITH s AS (SELECT setup, list(v ORDER BY x) AS s FROM voxel GROUP BY setup), e AS (SELECT setup, CAST(i AS INT) AS i, s[i % len(s) + 1] AS v FROM s, range(256) q(i)), m AS (SELECT setup, avg(v) AS m FROM e GROUP BY setup),
 w AS (SELECT CAST(k AS INT) AS k, (1 - cos(pi() * least(1, least(k, 15 - k) / 2.0))) / 2 AS t FROM range(16) q(k)),
 t AS MATERIALIZED (SELECT e.setup, i // 16 AS y, i % 16 AS x, (v - m) * wy.t * wx.t AS v FROM e JOIN m USING (setup) JOIN w wy ON wy.k = i // 16 JOIN w wx ON wx.k = i % 16),
 f AS MATERIALIZED (SELECT setup, (fy + 8) % 16 AS y, (fx + 8) % 16 AS x, sum(v * cos(pi() * (fy * y + fx * x) / 8.0)) AS re, -sum(v * sin(pi() * (fy * y + fx * x) / 8.0)) AS im FROM t, range(16) a(fy), range(16) b(fx) GROUP BY setup, fy, fx),
 p AS (SELECT r, k, 8 + r * cos(k * (1.0::DOUBLE / r)) AS x, 8 + r * sin(k * (1.0::DOUBLE / r)) AS y FROM range(1, 7) q(r), range(25) u(k) WHERE k * (1.0::DOUBLE / r) < pi()),
 c AS MATERIALIZED (SELECT f.setup, r, k, sum(re * (CASE WHEN a = 1 THEN p.y - floor(p.y) ELSE 1 - p.y + floor(p.y) END) * (CASE WHEN b = 1 THEN p.x - floor(p.x) ELSE 1 - p.x + floor(p.x) END)) AS re, sum(im * (CASE WHEN a = 1 THEN p.y - floor(p.y) ELSE 1 - p.y + floor(p.y) END) * (CASE WHEN b = 1 THEN p.x - floor(p.x) ELSE 1 - p.x + floor(p.x) END)) AS im
  FROM p, range(2) g(a), range(2) h(b), f WHERE f.y = floor(p.y) + a AND f.x = floor(p.x) + b GROUP BY f.setup, r, k),
 o AS (SELECT CAST(a.setup * 8 + b.setup AS BIGINT) AS location, CAST(a.r AS INT) AS ring, sum(a.re * b.re + a.im * b.im) / sqrt(sum(a.re * a.re + a.im * a.im) * sum(b.re * b.re + b.im * b.im)) AS value FROM c a JOIN c b ON a.r = b.r AND a.k = b.k AND a.setup < b.setup GROUP BY ALL)"""


@query(sql(RINGS + " SELECT location, ring, round(value, 6) AS value FROM o", "voxel"))
def ring_correlation(spark, d):
    return X.ring_correlations(tiles(spark, d), 16).select("location", "ring", R("value", 6).alias("value"))


@query(sql(RINGS + " SELECT location, round(sum(value), 6) AS quality FROM o GROUP BY location", "voxel"))
def local_quality(spark, d):
    """Sum of each location's curve."""
    return X.ring_correlations(tiles(spark, d), 16).groupBy("location").agg(R(F.sum("value"), 6).alias("quality"))


@query(sql("WITH b AS (SELECT x, v AS bright FROM voxel WHERE setup = 1), k AS (SELECT x, v AS dark FROM voxel WHERE setup = 2), c AS (SELECT x, bright - dark AS d, dark FROM b JOIN k USING (x)) SELECT v.setup, v.x, round(CASE WHEN d = 0 THEN 0 ELSE least(255, greatest(0, (v - dark) * (SELECT avg(d) FROM c) / d)) END, 3) AS v FROM voxel v JOIN c USING (x)", "voxel"))
def flat_field(spark, d):
    v = B.voxel(spark, d)
    out = X.flat_field(v, v.where("setup = 1"), v.where("setup = 2"), ["x"], 0.0, 255.0)
    return out.select("setup", "x", R("v", 3).alias("v"))


def images(spark, d):
    """Blocks of 32 x 32 with a bright spot on a dark ground, placed by setup."""
    s = B.view_setup(spark, d).select("setup")
    cx, cy = 10 + F.col("setup") % 11, 9 + F.col("setup") % 13
    value = lambda i: 100 * F.exp(-(F.pow(i % 32 - cx, 2) + F.pow(F.floor(i / 32) - cy, 2)) / 8.0)
    return s.select(F.col("setup").cast("long").alias("block"), F.lit(0).alias("ox"), F.lit(0).alias("oy"), F.lit(0).alias("oz"), F.lit(32).alias("nx"), F.lit(32).alias("ny"), F.lit(1).alias("nz"), F.transform(F.sequence(F.lit(0), F.lit(1023)), value).alias("data"), F.lit(0.0).alias("lo"), F.lit(100.0).alias("hi"))


@query(sql("SELECT CAST(setup AS BIGINT) AS block, CAST(10 + setup % 11 AS DOUBLE) AS x, CAST(9 + setup % 13 AS DOUBLE) AS y FROM view_setup", "view_setup"))
def detect_blobs(spark, d):
    """The spots come back, to a tenth of a pixel."""
    return X.detect_blobs(images(spark, d), 1.8, 0.05).select("block", R("x", 1).alias("x"), R("y", 1).alias("y"))


def _gauss_plane(source: str, column: str, sigma: float) -> str:
    """A Gaussian of images (block, x, y from 0 to 31) along x and then along y, mirrored at their edges: block, x, y, g."""
    r = max(1, int(-(-3 * sigma // 1)))
    kernel = f"(SELECT o, exp(-(o * o) / (2.0 * {sigma} * {sigma})) / (SELECT sum(exp(-(i * i) / (2.0 * {sigma} * {sigma}))) FROM range(-{r}, {r} + 1) q(i)) AS w FROM range(-{r}, {r} + 1) t(o))"
    place = lambda c: f"CASE WHEN a.{c} + k.o < 0 THEN -(a.{c} + k.o) WHEN a.{c} + k.o > 31 THEN 62 - (a.{c} + k.o) ELSE a.{c} + k.o END"
    one = f"SELECT a.block, a.x, a.y, sum(k.w * b.{column}) AS g FROM {source} a CROSS JOIN {kernel} k JOIN {source} b ON b.block = a.block AND b.y = a.y AND b.x = {place('x')} GROUP BY a.block, a.x, a.y"
    return f"WITH h AS MATERIALIZED ({one}) SELECT a.block, a.x, a.y, sum(k.w * b.g) AS g FROM h a CROSS JOIN {kernel} k JOIN h b ON b.block = a.block AND b.x = a.x AND b.y = {place('y')} GROUP BY a.block, a.x, a.y"


@query(sql(f"WITH im AS MATERIALIZED (SELECT CAST(setup AS BIGINT) AS block, CAST(i % 32 AS INT) AS x, CAST(i // 32 AS INT) AS y, 100 * exp(-(((i % 32) - (10 + setup % 11)) ** 2 + ((i // 32) - (9 + setup % 13)) ** 2) / 8.0) AS v FROM view_setup, range(1024) q(i)), a AS ({_gauss_plane('im', 'v', 2.0)}), dev AS MATERIALIZED (SELECT im.block, im.x, im.y, (v - g) ** 2 AS v FROM im JOIN a ON a.block = im.block AND a.x = im.x AND a.y = im.y), c AS ({_gauss_plane('dev', 'v', 4.0)}) SELECT block, 1024 AS n, round(max(g) / 2048, 6) AS most, round(sum(g) / 2048, 4) AS total FROM c GROUP BY block", "view_setup"))
def content_weight_blocks(spark, d):
    w = X.content_weight_blocks(images(spark, d), 2.0, 4.0)
    return w.select("block", F.size("weight").alias("n"), R(F.array_max("weight"), 6).alias("most"), R(F.aggregate("weight", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _kernels_sql() -> str:
    """Kernels of three taps of each two neighbouring setups, by kind."""
    conv = lambda x, k: f"[{k}[1] * {x}[2] + {k}[2] * {x}[1] + {k}[3] * {x}[1], {k}[1] * {x}[3] + {k}[2] * {x}[2] + {k}[3] * {x}[1], {k}[1] * {x}[3] + {k}[2] * {x}[3] + {k}[3] * {x}[2]]"
    turn = lambda x: f"list_reverse({x})"
    times = lambda x, y: f"list_transform(list_zip({x}, {y}), lambda p: p[1] * p[2])"
    unit = lambda x: f"list_transform({x}, lambda v: v / list_sum({x}))"
    made = {"independent": turn("a"), "optimization II": turn(unit(times("a", "a"))), "optimization I": turn(unit(times("a", "c1"))), "efficient Bayesian": unit(times("m", "c3"))}
    rows = " UNION ALL ".join(f"SELECT grp, view, '{k}' AS kind, {e} AS data FROM u3" for k, e in made.items())
    return f"""WITH k AS (SELECT setup, list(v + 1 ORDER BY x) AS k FROM line WHERE x BETWEEN 100 AND 102 GROUP BY setup), n AS (SELECT setup, {unit('k')} AS k FROM k),
 u AS (SELECT CAST(x.setup AS BIGINT) AS grp, v AS view, CASE WHEN v = 0 THEN x.k ELSE y.k END AS a, CASE WHEN v = 0 THEN y.k ELSE x.k END AS b FROM n x JOIN n y ON y.setup = x.setup + 1, range(2) t(v)),
 u1 AS (SELECT *, list_reverse(a) AS m, list_reverse(b) AS mb FROM u), u2 AS (SELECT *, {conv('a', 'mb')} AS c1, {conv('m', 'b')} AS c2 FROM u1), u3 AS (SELECT *, {conv('c2', 'mb')} AS c3 FROM u2),
 r AS ({rows}) SELECT grp, CAST(view AS INT) AS view, kind, CAST(i AS INT) AS i, round(data[i + 1], 6) AS v FROM r, range(3) q(i)"""


@query(sql(_kernels_sql(), "line"))
def psf_kinds(spark, d):
    """The four ways to make a view's second kernel from its own and another view's."""
    k = B.line(spark, d).where("x between 100 and 102").groupBy("setup").agg(F.array_sort(F.collect_list(F.struct("x", (F.col("v") + 1).alias("v")))).alias("k")).select("setup", F.col("k")["v"].alias("data"))
    pairs = k.select(F.col("setup").cast("long").alias("grp"), F.lit(0).alias("view"), "data").unionByName(k.select((F.col("setup") - 1).cast("long").alias("grp"), F.lit(1).alias("view"), "data"))
    full = pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("grp"))).where("n = 2").drop("n")
    out = None
    for kind in ("independent", "optimization I", "optimization II", "efficient Bayesian"):
        one = X.update_kernels(full, kind).select("grp", "view", F.lit(kind).alias("kind"), F.posexplode("data").alias("i", "v"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("v", R("v", 6))


@query(sql(f"SELECT setup, x, round(g, 6) AS soft FROM ({B.gauss_sql('line', 'v', 2.0)})", "line"))
def gauss_blocks(spark, d):
    """A Gaussian in blocks of 64 is that of the whole line."""
    return X.gauss_line(B.line(spark, d), ["setup"], "x", "v", 2.0, 64).select("setup", "x", R("soft", 6).alias("soft"))


def _deconvolved(rounds: int) -> str:
    """Rounds of two views with kernels of three taps, each step a table expression: location, x, psi."""
    beside = lambda c: (f"coalesce(lag({c}) OVER w, {c})", f"coalesce(lead({c}) OVER w, {c})")
    out = ["p AS (SELECT a.setup * 8 + b.setup AS location, a.x, a.v AS v0, b.v AS v1 FROM line a JOIN line b ON a.x = b.x AND a.setup < b.setup)", "z AS (SELECT location, greatest(max(v0), max(v1)) AS top, (avg(v0) + avg(v1)) / 2 AS first FROM p GROUP BY location)", "s0 AS (SELECT p.*, z.top, z.first AS psi FROM p JOIN z USING (location))"]
    for i in range(2 * rounds):
        a, b = beside("psi")
        out.append(f"b{i} AS MATERIALIZED (SELECT *, 0.25 * {a} + 0.5 * psi + 0.25 * {b} AS soft FROM s{i} WINDOW w AS (PARTITION BY location ORDER BY x))")
        out.append(f"r{i} AS (SELECT *, CASE WHEN v{i % 2} > 0 THEN v{i % 2} / greatest(soft, 1e-4) ELSE 1 END AS r FROM b{i})")
        a, b = beside("r")
        out.append(f"y{i} AS MATERIALIZED (SELECT *, psi * ({a} / 6 + r * 2 / 3 + {b} / 6) / top AS y FROM r{i} WINDOW w AS (PARTITION BY location ORDER BY x))")
        out.append(f"s{i + 1} AS (SELECT location, x, v0, v1, top, psi + (CASE WHEN y > 0 THEN greatest(1e-4, (sqrt(1 + 2 * 0.006 * y) - 1) / 0.006 * top) ELSE 1e-4 END - psi) * 0.5 AS psi FROM y{i})")
    return "WITH " + ", ".join(out) + f" SELECT CAST(location AS BIGINT) AS location, x, round(psi, 4) AS psi FROM s{2 * rounds}"


@query(sql(_deconvolved(3), "line"))
def deconvolve(spark, d):
    """Two views of each pair of lines, three rounds, in blocks of 64 that exchange their edges every round."""
    v = B.line(spark, d)
    pairs = v.toDF("a", "x", "v0").join(v.toDF("b", "x", "v1"), "x").where("a < b")
    cells = pairs.select((F.col("a") * 8 + F.col("b")).cast("long").alias("location"), "x", F.inline(F.array(*[F.struct(F.lit(i).alias("view"), F.col(f"v{i}").alias("v"), F.lit(0.5).alias("w")) for i in range(2)])))
    out = X.deconvolve_lines(cells, ["location"], "x", [[0.25, 0.5, 0.25]] * 2, 3, effective=64)
    return out.select("location", "x", R("psi", 4).alias("psi"))


@query(sql("SELECT CAST(setup AS BIGINT) AS view, x, y, round(x + tx, 5) AS wx, round(y + ty, 5) AS wy FROM (SELECT DISTINCT setup, tx, ty FROM model) m, (VALUES (0.0::DOUBLE), (10.0), (20.0)) a(x), (VALUES (0.0::DOUBLE), (10.0), (20.0)) b(y)", "model"))
def deform_grid(spark, d):
    """Matches that are all moved alike move the grid alike."""
    m = B.view_model(spark, d).select(F.col("setup").cast("long").alias("view"), "m").dropDuplicates(["view"])
    corner = lambda k: F.array(F.lit(-5.0), F.lit(31.0 + k))
    p = m.withColumn("px", F.explode(corner(0))).withColumn("py", F.explode(corner(2))).withColumn("pz", F.explode(corner(4)))
    matches = p.select("view", "px", "py", "pz", (F.col("px") + F.col("m")[3]).alias("qx"), (F.col("py") + F.col("m")[7]).alias("qy"), (F.col("pz") + F.col("m")[11]).alias("qz"))
    grid = m.select("view").withColumn("x", F.explode(F.array(F.lit(0.0), F.lit(10.0), F.lit(20.0)))).withColumn("y", F.explode(F.array(F.lit(0.0), F.lit(10.0), F.lit(20.0)))).withColumn("z", F.lit(3.0))
    return X.deform(grid, matches).select("view", "x", "y", R("wx", 5).alias("wx"), R("wy", 5).alias("wy"))


@query(sql("WITH k AS (SELECT setup, setup // 10 AS g FROM view_setup) SELECT CAST(setup AS BIGINT) AS point, round(avg(setup * 2) OVER (PARTITION BY g), 5) AS tx FROM k", "view_setup"))
def unique_targets(spark, d):
    s = B.view_setup(spark, d).select(F.col("setup").cast("long").alias("a"))
    links = s.where("a % 10 < 9").withColumn("b", F.col("a") + 1)
    for e in "ab":
        links = links.withColumns({f"wx_{e}": F.col(e) * 2.0, f"wy_{e}": F.lit(0.0), f"wz_{e}": F.lit(0.0)})
    return X.unique_targets(links).select("point", R("tx", 5).alias("tx"))
