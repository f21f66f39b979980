"""Queries over sources, sinks and streams: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumiframe.functions import affine  # noqa: F401
from lumiframe.operators import boxes, iterate
from lumiframe.plans import bindings as B
from lumiframe.plans.bindings import sql
from lumiframe.plans.q_relations import LINK, correspondences
from lumiframe.plans.registry import query
from lumiframe.sources import blocks as K
from lumiframe.sources import filenames as N
from lumiframe.sources import project as P
from lumiframe.streaming import intervals as S


def scratch(spark) -> str:
    """A new folder in the cluster's shared one."""
    iterate.materialize(spark.range(1))  # sets the folder where it is unset
    return spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/lumiframe/out-" + uuid.uuid4().hex


@query("SELECT regexp_replace(url, '[0-9]+', '{}', 'g') AS skeleton, count(*) AS n, CAST(max(len(regexp_extract_all(url, '[0-9]+'))) AS INT) AS numbers FROM pages GROUP BY 1")
def filename_skeletons(spark, d):
    p = B.table(spark, d, "pages").select(F.col("url").alias("name"))
    return p.groupBy(N.skeleton(F.col("name")).alias("skeleton")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(N.number_parts(F.col("name")))).alias("numbers"))


@query("WITH s AS (SELECT regexp_replace(url, '[0-9]+', '{}', 'g') AS skeleton, regexp_extract_all(url, '[0-9]+') AS k FROM pages), c AS (SELECT skeleton, count(*) AS n FROM s GROUP BY 1), b AS (SELECT arg_max(skeleton, (n, skeleton)) AS best FROM c), e AS (SELECT skeleton, unnest(range(len(k))) AS position, unnest(k) AS v FROM s, b WHERE skeleton = best) SELECT skeleton, CAST(position AS INT) AS position, count(DISTINCT v) AS \"values\", count(DISTINCT v) > 1 AS varies FROM e GROUP BY 1, 2")
def filename_pattern(spark, d):
    return N.detect_pattern(B.table(spark, d, "pages"), "url")


@query("SELECT CAST(i AS INT) AS i, CAST(CASE WHEN i // 6 % 2 = 1 THEN 5 - i % 6 ELSE i % 6 END AS INT) AS x, CAST(3 - i // 6 AS INT) AS y, CAST(i // 4 AS INT) AS cx, CAST(i % 4 AS INT) AS cy FROM range(24) t(i)")
def tile_grid(spark, d):
    i = spark.range(24).select(F.col("id").cast("int").alias("i"))
    x, y = N.tile_place(F.col("i"), 6, 4, snake=True, down=False)
    cx, cy = N.tile_place(F.col("i"), 6, 4, by_rows=False)
    return i.select("i", x.alias("x"), y.alias("y"), cx.alias("cx"), cy.alias("cy"))


@query(sql("SELECT setup, CAST(a.i * 32 AS BIGINT) AS ox, CAST(b.i * 32 AS BIGINT) AS oy, CAST(least(32, sx - a.i * 32) AS INT) AS nx, CAST(least(32, sy - b.i * 32) AS INT) AS ny, CAST(a.i * 2 AS BIGINT) AS gx FROM view_setup, range(3) a(i), range(3) b(i) WHERE a.i * 32 < sx AND b.i * 32 < sy", "view_setup"))
def block_grid(spark, d):
    return K.grid(B.view_setup(spark, d), (16, 16, 16), (2, 2, 1)).select("setup", "ox", "oy", "nx", "ny", "gx")


@query("SELECT CAST(l AS INT) AS level, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z FROM (VALUES (0, 101, 67, 10), (1, 50, 33, 10), (2, 25, 16, 5)) t(l, x, y, z)")
def pyramid_levels(spark, d):
    return spark.createDataFrame([(i, *s) for i, s in enumerate(K.pyramid([101, 67, 10], [[2, 2, 1], [4, 4, 2]]))], "level int, x int, y int, z int")


LEVELS = "SELECT setup, CAST(l.i AS INT) AS level, power(2.0::DOUBLE, l.i) AS fx, power(2.0::DOUBLE, l.i) AS fy, CASE WHEN l.i < 2 THEN 1.0::DOUBLE ELSE power(2.0::DOUBLE, l.i - 1 - setup % 2) END AS fz FROM view_setup, range(4) l(i)"


def levels(spark, d):
    s = B.view_setup(spark, d).select("setup", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    two = lambda e: F.pow(F.lit(2.0), e)
    return s.select("setup", "level", two(F.col("level")).alias("fx"), two(F.col("level")).alias("fy"), F.when(F.col("level") < 2, 1.0).otherwise(two(F.col("level") - 1 - F.col("setup") % 2)).alias("fz"))


@query(sql(f"WITH l AS ({LEVELS}) SELECT setup, arg_max(level, (fx * fy * fz, -level)) FILTER ((fx / 4 < 1.02 OR abs(fx - 1) <= 0.02) AND (fy / 4 < 1.02 OR abs(fy - 1) <= 0.02) AND (fz / 1.5 < 1.02 OR abs(fz - 1) <= 0.02)) AS level, arg_max(level, (fx * fy * fz, -level)) AS coarsest FROM l GROUP BY setup", "view_setup"))
def level_choice(spark, d):
    l = levels(spark, d)
    return K.best_level(l, ["setup"], [4.0, 4.0, 1.5]).join(K.coarsest_level(l, ["setup"]).withColumnRenamed("level", "coarsest"), "setup")


@query(sql("SELECT setup, CAST(x AS BIGINT) AS x, round(CAST(v AS FLOAT)::DOUBLE, 4) AS v FROM voxel", "voxel"))
def block_round_trip(spark, d):
    """Voxels as blocks, written by level and setup, read again; places without a voxel are background and left out here."""
    path = scratch(spark)
    v = B.voxel(spark, d)
    K.write(K.to_blocks(v, ["setup"], 64, -1.0).withColumn("level", F.lit(0)), path)
    back = K.from_blocks(spark.read.parquet(path).where("level = 0"), ["setup"]).where("v <> -1.0")
    return back.select("setup", "x", F.round(F.col("v").cast("double"), 4).alias("v"))


@query(sql("SELECT setup, CAST(x // 2 AS BIGINT) AS x, round(avg(coalesce(v, 0)), 3) AS v FROM (SELECT s.setup, CAST(g.i AS INT) AS x, (SELECT CAST(v AS FLOAT) FROM voxel w WHERE w.setup = s.setup AND w.x = g.i) AS v FROM (SELECT DISTINCT setup FROM voxel) s, range(256) g(i)) GROUP BY setup, x // 2", "voxel"))
def block_pyramid(spark, d):
    b = K.to_blocks(B.voxel(spark, d), ["setup"], 64)
    return K.downsampled(b, ["setup"], 2).select("setup", "x", F.round("v", 3).alias("v"))


@query(sql("WITH parts AS (SELECT i AS part, greatest(0, i * 48) AS f, least(256, i * 48 + 64) - 1 AS t FROM range(5) r(i)) SELECT CAST(v.setup * 5 + part AS INT) AS setup, CAST(x - f AS BIGINT) AS x, round(v, 5) AS v FROM voxel v, parts WHERE x BETWEEN f AND t", "voxel"))
def virtual_split(spark, d):
    s = spark.range(8).select(F.col("id").cast("int").alias("setup"), F.lit(256).cast("long").alias("sx"))
    return K.split_view(B.voxel(spark, d), boxes.split_views(s, 64, 16)).select("setup", "x", F.round("v", 5).alias("v"))


@query(sql("SELECT setup, channel, angle, illumination, tile, sx, sy, sz, vx, vy, vz, unit FROM view_setup", "view_setup"))
def project_xml(spark, d):
    path = scratch(spark)
    P.write_setups(B.view_setup(spark, d), path)
    return P.read_setups(spark, path)


@query(sql("SELECT tp, setup, label, id, round(x, 6) AS x FROM point WHERE tp = 3 AND label = 'R'", "point"))
def points_round_trip(spark, d):
    path = scratch(spark)
    P.write_points(B.interest_point(spark, d), path)
    return P.read_points(spark, path, tp=3, label="R").select("tp", "setup", "label", "id", F.round("x", 6).alias("x"))


@query(sql(f"SELECT tp, setup, label, id, c_tp, c_setup, c_label, c_id FROM ({LINK})", "point"))
def links_round_trip(spark, d):
    return P.decode_links(*P.encode_links(correspondences(spark, d)))


@query("SELECT CAST(i AS INT) AS i, p::DOUBLE AS p, q::DOUBLE AS q FROM (VALUES (0, 1.5, 2), (0, 3, 4.25), (2, 7, 8)) t(i, p, q)")
def match_text(spark, d):
    rows = spark.createDataFrame([(0, "0 1 2 1.5 2 3 4.25"), (1, "0 1 2"), (2, "  a b c 7 8 9 ")], "i int, line string")
    once = rows.select("i", P.parse_matches(F.col("line")).alias("pairs"))
    again = once.select("i", P.parse_matches(P.format_matches(F.lit("x y z"), F.col("pairs"))).alias("pairs"))
    return again.select("i", F.inline("pairs"))


@query(sql("SELECT concat('coefficients/setup', setup, '/timepoint', tp, '/dataset') AS path FROM view", "view"))
def dataset_paths(spark, d):
    return B.view(spark, d).select(P.dataset_path("coefficients", F.col("setup"), F.col("tp")).alias("path"))


@query(sql("SELECT 'points' AS name, count(*) AS n FROM point p SEMI JOIN (SELECT * FROM view WHERE tile = 4) v ON p.tp = v.tp AND p.setup = v.setup UNION ALL SELECT 'setups', count(*) FROM view_setup WHERE tile = 4", "point", "view"))
def dataset_reduction(spark, d):
    out = P.reduce_dataset({"points": B.interest_point(spark, d), "setups": B.view_setup(spark, d)}, B.view(spark, d).where("tile = 4"))
    one = lambda n: out[n].agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
    return one("points").unionByName(one("setups"))


@query(sql("SELECT setup, sx FROM view_setup UNION ALL SELECT CAST((SELECT max(setup) FROM view_setup) + i + 1 AS INT), 100 + i FROM range(2) t(i)", "view_setup"))
def fused_setups(spark, d):
    g = spark.createDataFrame([("a", 100, 1, 1), ("b", 101, 1, 1)], "title string, sx long, sy long, sz long")
    return P.add_fused_setups(B.view_setup(spark, d), g).select("setup", "sx")


@query("SELECT a.event_id AS event_id_a, b.event_id AS event_id_b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 600 SECONDS AND a.ts + INTERVAL 600 SECONDS WHERE a.event_id < b.event_id")
def pairs_in_time(spark, d):
    e = B.table(spark, d, "events").select("event_id", "user_id", "ts")
    return S.pairs_in_range(e, e, "user_id", "ts", 600).where("event_id_a < event_id_b").select("event_id_a", "event_id_b")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    out = S.windowed(B.table(spark, d, "events"), "ts", "value", ["event_type"], "1 hour")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts_stream(spark, d):
    """The same windows of the table read as a stream, run until all of it is seen."""
    path, name = scratch(spark), "s" + uuid.uuid4().hex
    B.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = S.windowed(stream, "ts", "value", ["event_type"], "1 hour")
    sink = scratch(spark)
    q = out.writeStream.outputMode("complete").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(sink)).option("checkpointLocation", scratch(spark)).queryName(name).start()
    q.awaitTermination()
    return spark.read.parquet(sink).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
