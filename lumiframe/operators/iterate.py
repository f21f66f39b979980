"""Shared storage, lineage cuts and connected components of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Unset, a temporary folder is made and set if the master is local (as in tests), where driver and executors are one
    process; on a cluster executors wouldn't see it, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lumiframe-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str, on_exit: bool = False) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(at) if on_exit else store.delete(at, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder. All of that part goes when the application ends."""
    own = f"{shared_dir(spark)}/lumiframe/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
        _delete(spark, own, on_exit=True)
    return f"{own}/{name}-{uuid.uuid4().hex}"


_OWN: set[str] = set()
#: Spark's setting that drops a plan's shuffle files once the plan has run.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, and any executor may be lost.

    The shuffle files of the plan that made it go at once. The table goes with discard(), or when the application ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumiframe_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df._lumiframe_path)


#: Rows of one file of a round's tables.
ROWS_A_FILE = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node of an edge table of longs that isn't the smallest of its component.

    Edges with a null end and loops are left out; repeated edges count once. No node's neighbours are ever gathered:
    the minimum of a node's neighbours is an aggregate, which is written out before it is joined, so that the join is of
    two plain exchanges and Spark splits the partition of a hot node. A round's tables are as many files as their rows
    ask for, ROWS_A_FILE each.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = materialize(edges.where(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(), "edges")
    state = _state(now)
    while True:
        files = max(1, -(-2 * state[0] // ROWS_A_FILE))
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(files), "least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct().coalesce(files), "large")
        parent = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")).coalesce(files), "parent")
        small = large.join(parent, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(parent.select("hi", F.col("m").alias("lo"))).distinct()
        after = materialize(small.coalesce(files), "edges")
        discard(least, large, parent)
        after_state = _state(after)
        discard(now)
        now = after
        if after_state == state:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        state = after_state


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node) of every node of an edge table (a, b), also of those that only have loops."""
    found = stars(edges).withColumnRenamed("node", "found")
    every = edges.select(F.col("a").cast("long").alias("node")).union(edges.select(F.col("b").cast("long"))).where("node is not null").distinct()
    return every.join(found, F.col("node") == F.col("found"), "left").select("node", F.coalesce("component", "node").alias("component"))
