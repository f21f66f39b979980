"""File lists as acquisitions: numeric patterns in names, tile grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_list(spark, path: str, glob: str = "*") -> DataFrame:
    """path, name, size of files, without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))


def number_parts(name: Column) -> Column:
    """The numbers of a name, in order, as text."""
    return F.regexp_extract_all(name, F.lit(r"(\d+)"), 1)


def skeleton(name: Column) -> Column:
    """A name with each number as {}."""
    return F.regexp_replace(name, r"\d+", "{}")


def detect_pattern(files: DataFrame, name: str = "name") -> DataFrame:
    """skeleton, position, values, varies: the numbers of the most common skeleton, and whether they vary; ties by skeleton."""
    s = files.select(skeleton(F.col(name)).alias("skeleton"), number_parts(F.col(name)).alias("numbers"))
    best = s.groupBy("skeleton").count().agg(F.max_by("skeleton", F.struct("count", "skeleton")).alias("best"))
    own = s.join(best, F.col("skeleton") == F.col("best"), "left_semi")
    return own.select("skeleton", F.posexplode("numbers").alias("position", "value")).groupBy("skeleton", "position").agg(F.count_distinct("value").alias("values")).withColumn("varies", F.col("values") > 1)


def tile_place(i: Column, columns: int, rows: int, by_rows: bool = True, snake: bool = False, right: bool = True, down: bool = True) -> tuple[Column, Column]:
    """Column and row of tile number i on a regular grid: row or column first, back and forth or not, in four directions."""
    fast_n, slow_n = (columns, rows) if by_rows else (rows, columns)
    slow, fast = F.floor(i / fast_n).cast("int"), F.pmod(i, F.lit(fast_n)).cast("int")
    if snake:
        fast = F.when(slow % 2 == 1, fast_n - 1 - fast).otherwise(fast)
    x, y = (fast, slow) if by_rows else (slow, fast)
    del slow_n
    return (x if right else columns - 1 - x), (y if down else rows - 1 - y)


def views_from_names(files: DataFrame, roles: dict[int, str], name: str = "name") -> DataFrame:
    """Files of the most common name pattern with the attributes that its numbers stand for (position -> attribute), and a setup each.

    Setups number the distinct attributes other than `tp`, in their order; without a `tp` role all files are of timepoint 0.
    """
    from pyspark.sql import Window

    s = files.withColumns({"n_skeleton": skeleton(F.col(name)), "n_parts": number_parts(F.col(name))})
    best = s.groupBy("n_skeleton").count().agg(F.max_by("n_skeleton", F.struct("count", "n_skeleton")).alias("best"))
    own = s.join(best, F.col("n_skeleton") == F.col("best"), "left_semi")
    own = own.withColumns({a: F.get("n_parts", F.lit(p)).cast("int") for p, a in roles.items()}).drop("n_skeleton", "n_parts")
    if "tp" not in roles.values():
        own = own.withColumn("tp", F.lit(0))
    by = sorted(a for a in roles.values() if a != "tp")
    if not by:
        return own.withColumn("setup", F.lit(0))
    setups = own.select(*by).distinct().withColumn("setup", (F.row_number().over(Window.orderBy(*by)) - 1).cast("int"))
    return own.join(setups, by)
