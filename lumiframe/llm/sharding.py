"""Sharding along a Hilbert curve over several quantised dimensions, so that a shard's files prune on all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.llm.common import materialize

#: Bits of each of the quantised dimensions: 16 codes of equal depth.
BITS = 4


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Next digit and next state of the curve for (state, corner), made by the Gray-code rule: a state is an entry corner and a direction."""
    n, mask = dims, (1 << dims) - 1
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    place = {g: i for i, g in enumerate(gray)}

    def turn(x: int, k: int) -> int:
        k %= n
        return ((x << k) | (x >> (n - k))) & mask

    ones = [next((b for b in range(n + 1) if not i >> b & 1), n) % n for i in range(1 << n)]
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(1 << n)]
    side = [0 if i == 0 else ones[i - 1] if i % 2 == 0 else ones[i] for i in range(1 << n)]
    digit, state = [], []
    for s in range(n << n):
        e, d = s // n, s % n
        for corner in range(1 << n):
            w = place[turn(corner ^ e, -(d + 1))]
            digit.append(w)
            state.append((e ^ turn(entry[w], d + 1)) * n + (d + side[w] + 1) % n)
    return digit, state


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a cell whose coordinates have `bits` bits each; a SQL expression."""
    n = len(coordinates)
    digit, state = (F.array(*[F.lit(x) for x in t]) for t in curve_tables(n))
    corners = F.array(*[sum((F.shiftleft(F.shiftright(c.cast("int"), b).bitwiseAND(F.lit(1)), i) for i, c in enumerate(coordinates)), F.lit(0)) for b in reversed(range(bits))])
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))

    def step(acc: Column, corner: Column) -> Column:
        at = acc["s"] * F.lit(1 << n) + corner + F.lit(1)
        return F.struct((acc["h"] * F.lit(1 << n) + F.element_at(digit, at)).cast("long").alias("h"), F.element_at(state, at).alias("s"))

    return F.aggregate(corners, start, step, lambda acc: acc["h"])


def depth_codes(df: DataFrame, column: str, bits: int) -> DataFrame:
    """value, code (0 to 2^bits - 1) of every distinct value of a column that isn't null, in its order, so that codes hold about equally many rows.

    A value's code is 2^bits times the share of rows with a smaller value. Values are counted, the counts are dealt by
    range and summed up within a range, and the ranges' sums give the offsets: no task holds all values, however many
    there are, and reruns agree.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts.repartitionByRange(parts, "value").withColumn("r_part", F.spark_partition_id()), "value-counts")
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.groupBy("r_part").agg(F.sum("n").alias("n")).select("r_part", upto(Window.orderBy("r_part")).alias("r_before"))
    offsets = materialize(offsets, "offsets")  # a row per range
    total = counts.agg(F.sum("n")).first()[0] or 1
    place = F.col("r_before") + upto(Window.partitionBy("r_part").orderBy("value"))
    return materialize(counts.join(offsets, "r_part").select("value", F.expr(f"{1 << bits}").alias("cells"), place.alias("before")).select("value", F.expr(f"cast((before * cells) div {total} as int)").alias("code")), "codes")


def quantise(df: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """df with q0, q1, ...: codes of its dimensions by depth_codes(); null takes code 0, with the smallest values.

    Codes are joined from written tables: small ones are broadcast, as Spark knows their size, and beyond that both sides
    are shuffled by value.
    """
    for i, c in enumerate(dimensions):
        codes = depth_codes(df, c, bits).toDF("q_value", f"q_{i}")
        df = df.join(codes, F.col(c) == F.col("q_value"), "left").withColumn(f"q{i}", F.coalesce(f"q_{i}", F.lit(0))).drop("q_value", f"q_{i}")
    return df


def ranks(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with `rank`, 0 to n - 1 in the total order of the given columns, and n; no task sees more than its range.

    Rows are dealt by range and sorted within; a written table fixes each one's partition and place, and the ranges'
    counts, one row per partition, give the offsets.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("r_part", F.spark_partition_id()).withColumn("r_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = materialize(placed, "ranks")
    sizes = placed.groupBy("r_part").count()
    offsets = sizes.select("r_part", F.coalesce(F.sum("count").over(Window.orderBy("r_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("r_before"))
    offsets = materialize(offsets, "offsets")  # a row per range: known to be small when the join is planned
    n = sizes.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return placed.join(offsets, "r_part").withColumn("rank", F.col("r_before") + F.col("r_place")).drop("r_part", "r_place", "r_before"), n


def shard(docs: DataFrame, shards: int, categorical: list[str], numeric: list[str], key: str = "doc_id", text: str = "text", bits: int = BITS, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot of every row of docs, by the law of equal counts.

    The dimensions are the categorical and numeric columns named and the size, quantised to 2^bits codes each by equal
    depth. Rows are sorted by curve index, then by a hash of the text, then key, and cut into runs whose counts are at
    most one apart; with fewer rows than shards some shards are empty. Equal texts of a cell are neighbours, so a group
    of them is cut only where the law of counts cuts a run through it; equal texts that differ in another dimension may
    be in different cells. size is the text's UTF-8 bytes (null: none) plus 8. Null dimensions take code 0, a null key
    sorts first, and repeated rows take neighbouring slots. The columns of docs aren't carried but with `whole`, as a
    struct `row`.
    """
    plain = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mix"),
        *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(categorical)],
        *[F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(numeric)],
        *([F.struct("*").alias("row")] if whole else []),
    )
    dims = [*[f"c{i}" for i in range(len(categorical))], "size", *[f"n{i}" for i in range(len(numeric))]]
    own = ["doc_id", "size", "text_crc32"]
    kept = ["row"] if whole else []
    rows = quantise(plain, dims, bits).withColumn("curve", hilbert_index([F.col(f"q{i}") for i in range(len(dims))], bits)).select(*own, "curve", "mix", *kept)
    ranked, n = ranks(rows, ["curve", "mix", "doc_id", "text_crc32", "size"])
    number = F.expr(f"(rank * {shards}) div {max(1, n)}")
    first = F.expr(f"(shard_ * {max(1, n)} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard_", number).select(*own, "curve", F.col("shard_").cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"), *kept)


def write_shards(docs: DataFrame, folder: str, shards: int, categorical: list[str], numeric: list[str], key: str = "doc_id", text: str = "text", bits: int = BITS) -> None:
    """Write docs, with all their columns, as Parquet files of folders shard=0, shard=1, ..., in the order of slots.

    A shard is a run of the curve, so its files span few values of every dimension, and the footers' least and largest
    values let a reader skip files by a filter on any of them. A shard is one task's output.
    """
    out = shard(docs, shards, categorical, numeric, key, text, bits, whole=True)
    if {"shard", "slot"} & set(docs.columns):
        raise ValueError("docs has a column named shard or slot")
    rows = out.select("shard", "slot", "row.*")
    rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(folder)
