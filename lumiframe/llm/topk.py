"""Exact nearest binary codes by incremental multi-index hashing.

A code is cut in segments of about log2(n) bits, and an index holds each code under (segment, value). Probing goes on
segment by segment at growing radius: a query looks up all values within r bits of its segment. Once the first j + 1 of
m segments are searched to radius r and the others to r - 1, every code within m * r + j bits has been met; so a query
is done when its kth verified distance is no more than that. Index and probes meet by equality across the cluster, and
only queries that aren't done go on.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.llm.common import discard, materialize

#: Bits of a code, and probes of a query up to which all segments of a radius are looked up in one round.
BITS, AT_ONCE = 64, 4096


def sign_code(vector: str = "embedding", bits: int = 64) -> F.Column:
    """The code of a vector: bit i is set where component i is above 0; missing and null components are not. Null for a null vector."""
    v = F.col(vector)
    one = [F.when(F.coalesce(F.get(v, F.lit(i)), F.lit(0.0)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(bits)]
    out = one[0]
    for x in one[1:]:
        out = out.bitwiseOR(x)
    return F.when(v.isNotNull(), out)


def widths(n: int) -> list[int]:
    """Bits of each of n segments, as even as can be."""
    return [BITS // n + (i < BITS % n) for i in range(n)]


def segments_for(codes: int) -> int:
    """The number of segments for so many codes: each of about as many bits as number them, so that a value has few codes."""
    return min(8, max(2, round(BITS / math.log2(max(codes, 4)))))


def segment(code: F.Column, s: int, parts: list[int]) -> F.Column:
    """A segment's value."""
    return F.shiftrightunsigned(code, sum(parts[:s])).bitwiseAND(F.lit((1 << parts[s]) - 1))


def masks(width: int, radius: int) -> list[int]:
    """All masks of `width` bits with `radius` of them set."""
    return [sum(1 << b for b in c) for c in combinations(range(width), radius)]


def rounds(parts: list[int]) -> list[tuple[int, list[int]]]:
    """Radius and segments of each round of probing: all segments while a query's probes are few, then one at a time."""
    out = []
    for r in range(max(parts) + 1):
        has = [s for s, w in enumerate(parts) if r <= w]
        if sum(math.comb(parts[s], r) for s in has) <= AT_ONCE:
            out.append((r, has))
        else:
            out += [(r, [s]) for s in has]
    return out


def probes(active: DataFrame, radius: int, at: list[int], parts: list[int]) -> DataFrame:
    """q_code, seg, value: the values at exactly `radius` bits from these segments of the queries."""
    flips = active.sparkSession.createDataFrame([(s, m) for s in at for m in masks(parts[s], radius)], "flip_seg int, mask long")
    each = active.select("q_code", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), segment(F.col("q_code"), s, parts).alias("own")) for s in at])).alias("p"))
    # a row per segment and mask of this radius, which the widths alone fix
    return each.join(F.broadcast(flips), F.col("p.seg") == F.col("flip_seg")).select("q_code", "p.seg", F.col("p.own").bitwiseXOR(F.col("mask")).alias("value"))


def hamming_top_k(rows: DataFrame, queries: DataFrame, k: int, segments: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, distance: for each row of queries the k rows nearest in Hamming distance, ties by vec_id, itself included.

    rows: vec_id, code; queries: query_id, code; codes are longs. Rows or queries without a code or an id are left out;
    a repeated row is one row for each time, a repeated query_id is answered once for each of its codes and must have one
    only. Other columns are ignored; ids are numbers or text of whole numbers, other text raises. Equal codes are one
    entry of the index, with its k smallest ids, and equal queries one query. A pair of codes is taken up in one radius
    and segment only, those where it is first met, so nothing needs to be told apart later; a query keeps its k best
    codes from round to round. segments: segments_for() the codes if not given.
    """
    by_code = Window.partitionBy("code").orderBy("vec_id")
    # the first k ids of each code: cut within each task before the shuffle
    ids = materialize(rows.select(F.col("vec_id").cast("long"), F.col("code").cast("long")).where("vec_id is not null and code is not null").withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= k), "codes")
    codes = ids.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("id"))
    size, total = codes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    m = segments or segments_for(size)
    parts = widths(m)
    index = materialize(codes.select("code", "n", "id", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), segment(F.col("code"), s, parts).alias("value")) for s in range(m)])).alias("p")).select("code", "n", "id", "p.seg", "p.value"), "code-index")
    asked = queries.select(F.col("query_id").cast("long"), F.col("code").cast("long")).where("query_id is not null and code is not null")
    active = materialize(asked.select(F.col("code").alias("q_code")).distinct(), "active")
    best = None
    wanted = min(k, total)
    other = F.col("code").bitwiseXOR(F.col("q_code"))
    errors = F.array(*[F.bit_count(segment(other, s, parts)) for s in range(m)])
    by_query = Window.partitionBy("q_code")
    found: list[DataFrame] = []
    for radius, at in rounds(parts):
        if not wanted or active.isEmpty():
            break
        # probes are never broadcast: Spark would plan by what they are made from
        met = probes(active, radius, at, parts).hint("merge").join(index, ["seg", "value"])
        new = met.where((F.array_min(errors) == radius) & (F.array_position(errors, F.lit(radius)) - 1 == F.col("seg"))).select("q_code", "code", "n", "id", F.bit_count(other).cast("int").alias("distance"))
        both = new if best is None else best.unionByName(new)
        ranked = both.withColumn("place", F.row_number().over(by_query.orderBy("distance", "id"))).where(F.col("place") <= k).drop("place")
        ranked = ranked.withColumn("rows", F.sum("n").over(by_query.orderBy("distance")))
        reach = F.min(F.when(F.col("rows") >= wanted, F.col("distance"))).over(by_query)
        after = materialize(ranked.withColumn("done", F.coalesce(reach <= m * radius + at[-1], F.lit(False))).drop("rows"), "best")
        found.append(after.where("done"))
        best = after.where("not done").drop("done")
        left = materialize(active.join(after.where("done").select("q_code").distinct(), "q_code", "left_anti"), "active")
        discard(active)
        active = left
    discard(index)
    if not found:
        return asked.select("query_id", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("distance")).limit(0)
    near = found[0]
    for x in found[1:]:
        near = near.unionByName(x)
    order = Window.partitionBy("q_code").orderBy("distance", "vec_id", "place")
    top = near.select("q_code", "code", "distance").join(ids, "code").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q_code", "rank", "vec_id", "distance")
    return asked.join(top, F.col("code") == F.col("q_code")).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.col("distance").cast("long").alias("distance"))
