"""The test tables read as acquisitions: views, models, interest points, voxels, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumiframe.functions import affine


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view_setup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("int")
    return table(spark, d, "supplier").select(
        k.alias("setup"),
        (F.col("s_nationkey") % 3).alias("channel"),
        (F.col("s_nationkey") % 4).alias("angle"),
        (k % 2).alias("illumination"),
        F.col("s_nationkey").alias("tile"),
        (50 + k % 11).cast("long").alias("sx"),
        (40 + k % 7).cast("long").alias("sy"),
        (10 + k % 3).cast("long").alias("sz"),
        F.lit(1.0).alias("vx"),
        F.lit(1.0).alias("vy"),
        (1 + k % 4).cast("double").alias("vz"),
        F.lit("um").alias("unit"),
    )


def all_views(spark: SparkSession, d: str) -> DataFrame:
    return view_setup(spark, d).withColumn("tp", F.explode(F.sequence(F.lit(0), F.lit(6))))


def missing(spark: SparkSession, d: str) -> DataFrame:
    return all_views(spark, d).where((F.col("tp") + F.col("setup")) % 13 == 0).select("tp", "setup")


def view(spark: SparkSession, d: str) -> DataFrame:
    """Present views with their attributes."""
    return all_views(spark, d).where((F.col("tp") + F.col("setup")) % 13 != 0)


def model_of(setup: F.Column) -> F.Column:
    return affine.translation((7 * setup) % 50, (11 * setup) % 40, (3 * setup) % 10)


def view_model(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d).withColumn("m", model_of(F.col("setup")))


def turned_model(spark: SparkSession, d: str) -> DataFrame:
    """Views turned about the axis z, by setup, and then moved as in view_model(): cosines 1, 0.8, 0.6 and sines 0, 0.6, 0.8."""
    k = F.col("setup")
    c, s = 1 - 0.2 * (k % 3), F.when(k % 3 == 0, 0.0).otherwise(0.4 + 0.2 * (k % 3))
    nil, one = F.lit(0.0), F.lit(1.0)
    return view(spark, d).withColumn("m", affine.from_columns(c, -s, nil, (7 * k) % 50, s, c, nil, (11 * k) % 40, nil, nil, one, (3 * k) % 10))


def view_transform(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("setup")
    shear = affine.from_columns(F.lit(1.0), 0.1 * (k % 3), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    parts = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("shear").alias("name"), shear.alias("m")),
        F.struct(F.lit(1).alias("ord"), F.lit("translation").alias("name"), model_of(k).alias("m")),
        F.struct(F.lit(2).alias("ord"), F.lit("calibration").alias("name"), affine.scaling(F.col("vx"), F.col("vy"), F.col("vz")).alias("m")),
    )
    return view(spark, d).select("tp", "setup", F.inline(parts))


def interest_point(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("tp", "setup", "label").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = table(spark, d, "lineitem").select("*", (F.col("l_linenumber") - 1).cast("int").alias("tp"), F.col("l_suppkey").cast("int").alias("setup"), F.col("l_returnflag").alias("label"))
    return rows.select("tp", "setup", "label", (F.row_number().over(w) - 1).alias("id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2500).alias("y"), (F.col("l_discount") * 100).alias("z"), F.col("l_extendedprice").alias("intensity"))


def voxel(spark: SparkSession, d: str) -> DataFrame:
    """Small one-dimensional images with overlap: setup, x, v."""
    return table(spark, d, "events").groupBy((F.col("user_id") % 8).cast("int").alias("setup"), (F.col("event_id") % 256).cast("int").alias("x")).agg(F.avg("value").alias("v"))


def line(spark: SparkSession, d: str) -> DataFrame:
    """voxel() without gaps: places 0 to 255 of every setup, 0 where there is no voxel."""
    v = voxel(spark, d)
    every = v.select("setup").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return every.join(v, ["setup", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def voxel2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").cast("int").alias("setup"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("v"))


def edge(spark: SparkSession, d: str, modulus: int = 1500) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 31 + F.col("o_orderkey")) % modulus).alias("b"), F.col("o_totalprice").alias("r"))


def interval(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("setup"), F.col("s_nationkey").alias("tile"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 100).alias("hi"))


def series(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).alias("i"), F.col("value").alias("v"))


#: The same bindings for the SQL side: common table expressions.
CTE = {
    "view_setup": "SELECT CAST(s_suppkey AS INT) AS setup, s_nationkey % 3 AS channel, s_nationkey % 4 AS angle, CAST(s_suppkey % 2 AS INT) AS illumination, s_nationkey AS tile, CAST(50 + s_suppkey % 11 AS BIGINT) AS sx, CAST(40 + s_suppkey % 7 AS BIGINT) AS sy, CAST(10 + s_suppkey % 3 AS BIGINT) AS sz, 1.0::DOUBLE AS vx, 1.0::DOUBLE AS vy, CAST(1 + s_suppkey % 4 AS DOUBLE) AS vz, 'um' AS unit FROM supplier",
    "all_view": "SELECT s.*, CAST(t.tp AS INT) AS tp FROM view_setup s, range(7) t(tp)",
    "view": "SELECT * FROM all_view WHERE (tp + setup) % 13 <> 0",
    "model": "SELECT *, CAST(7 * setup % 50 AS DOUBLE) AS tx, CAST(11 * setup % 40 AS DOUBLE) AS ty, CAST(3 * setup % 10 AS DOUBLE) AS tz FROM view",
    "turned": "SELECT *, 1 - 0.2::DOUBLE * (setup % 3) AS c, CASE WHEN setup % 3 = 0 THEN 0 ELSE 0.4::DOUBLE + 0.2::DOUBLE * (setup % 3) END AS s FROM model",
    "point": "SELECT CAST(l_linenumber - 1 AS INT) AS tp, CAST(l_suppkey AS INT) AS setup, l_returnflag AS label, CAST(row_number() OVER (PARTITION BY l_linenumber, l_suppkey, l_returnflag ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INT) AS id, l_quantity AS x, l_extendedprice / 2500 AS y, l_discount * 100 AS z, l_extendedprice AS intensity FROM lineitem",
    "voxel": "SELECT CAST(user_id % 8 AS INT) AS setup, CAST(event_id % 256 AS INT) AS x, avg(value) AS v FROM events GROUP BY ALL",
    "line": "SELECT s.setup, CAST(r.x AS INT) AS x, coalesce(v.v, 0) AS v FROM (SELECT DISTINCT setup FROM voxel) s CROSS JOIN range(256) r(x) LEFT JOIN voxel v ON v.setup = s.setup AND v.x = r.x",
    "voxel2": "SELECT CAST(l_suppkey AS INT) AS setup, l_quantity AS x, l_extendedprice AS v FROM lineitem",
    "edge": "SELECT o_custkey AS a, (o_custkey * 31 + o_orderkey) % 1500 AS b, o_totalprice AS r FROM orders",
    "iv": "SELECT CAST(s_suppkey AS INT) AS setup, s_nationkey AS tile, s_acctbal AS lo, s_acctbal + 100 AS hi FROM supplier",
    "series": "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS i, value AS v FROM events",
}
NEEDS = {"all_view": ["view_setup"], "view": ["view_setup", "all_view"], "model": ["view_setup", "all_view", "view"], "turned": ["view_setup", "all_view", "view", "model"], "line": ["voxel"]}
#: Named more than once in a query and costly: computed once.
ONCE = {"point", "voxel", "series", "line"}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """A query with the bindings that it names."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    if not wanted:
        return body.strip()
    head = "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({CTE[n]})" for n in wanted)
    body = body.strip()
    return f"{head}, {body[5:]}" if body[:5].upper() == "WITH " else f"{head} {body}"


def gauss_sql(source: str, column: str, sigma: float, last: int = 255) -> str:
    """A Gaussian of a column of lines (setup, x from 0 to `last`), which are mirrored at their ends: setup, x, g."""
    r = max(1, -(-3 * sigma // 1))
    at = "(a.x + k.o)"
    place = f"CASE WHEN {at} < 0 THEN -{at} WHEN {at} > {last} THEN {2 * last} - {at} ELSE {at} END"
    kernel = f"(SELECT o, exp(-(o * o) / (2.0 * {sigma} * {sigma})) / (SELECT sum(exp(-(i * i) / (2.0 * {sigma} * {sigma}))) FROM range(-{r:.0f}, {r:.0f} + 1) q(i)) AS w FROM range(-{r:.0f}, {r:.0f} + 1) t(o))"
    return f"SELECT a.setup, a.x, sum(k.w * b.{column}) AS g FROM {source} a CROSS JOIN {kernel} k JOIN {source} b ON b.setup = a.setup AND b.x = {place} GROUP BY a.setup, a.x"
