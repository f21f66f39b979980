"""Spatial joins by grid cells: overlap, containment, nearest neighbours, radius."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.functions import affine
from lumiframe.operators.iterate import materialize
from lumiframe.operators.relations import blocks, spread


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def typical_extent(df: DataFrame, low: str, high: str) -> float:
    """Mean extent, as a cell's size: an interval then covers about two cells; at least a tiny one."""
    return max(1e-9, float(df.agg(F.avg(F.col(high) - F.col(low))).first()[0] or 1.0))


def overlap_pairs(df: DataFrame, key: str, axes: list[tuple[str, str]], cell: float | None = None, keep: tuple[str, ...] = (), by: list[str] | None = None, near: tuple[str, ...] = ()) -> DataFrame:
    """Pairs key_a < key_b whose closed intervals meet on every axis, each once, with the ends of both; by: columns that must agree, which come first.

    Intervals are dealt to the cells that they cover on the first axis, so the join is by equality; a pair is kept in
    the first cell that both cover, which one of the two starts in. What lies in a cell, starts there or not, and is of
    one level meets by blocks, so that a cell of very many intervals is spread over all tasks; of two blocks, only where
    some key of a's is below one of b's. Cells grow with the interval: one of length l is dealt at the level whose cells are
    about as long, and to coarser levels too, so very long intervals cover two cells of their own and no more; of two
    levels, a pair meets at the coarser one. Rows with a null end are in no pair.
    """
    by = by or []
    cell = cell or typical_extent(df, *axes[0])
    ends = [c for a in axes for c in a]
    cols = list(dict.fromkeys([key, *ends, *keep]))
    low, high = F.col(axes[0][0]), F.col(axes[0][1])
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((high - low) / cell, F.lit(1.0)))).cast("int"))
    ready = df.where(functools.reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in ends])).withColumn("grid_level", level)
    top = ready.agg(F.max("grid_level")).first()[0] or 0
    size = lambda c: F.lit(cell) * F.pow(F.lit(2.0), c)
    # levels of intervals are few: a row meets its own level and those above
    dealt = ready.withColumn("grid_at", F.explode(F.sequence("grid_level", F.lit(top))))
    from_ = F.floor(low / size(F.col("grid_at")))
    dealt = dealt.withColumn("grid_cell", F.explode(F.sequence(from_, F.floor(high / size(F.col("grid_at")))))).withColumn("grid_starts", from_ == F.col("grid_cell"))
    place, kind = [*by, "grid_at", "grid_cell"], ["grid_level", "grid_starts", "first", "last"]
    # intervals that are alike are neighbours in a block: by the columns `near` of those kept, and then by their ends
    own = [c for c in dict.fromkeys([*near, *ends, *keep, key]) if c not in by]
    parts = blocks(dealt, [*place, *kind[:2]], key, own)
    side = lambda s: parts.select(*place, *[F.col(c).alias(f"{c}_{s}") for c in (*kind, "rows")])
    at = F.col("grid_at")
    level = (F.col("grid_level_a") == at) | (F.col("grid_level_b") == at)
    met = side("a").join(side("b").hint("merge"), place).where(level & (F.col("grid_starts_a") | F.col("grid_starts_b")) & (F.col("first_a") < F.col("last_b")))
    meets = functools.reduce(lambda x, y: x & y, [(F.col(f"{lo}_a") <= F.col(f"{hi}_b")) & (F.col(f"{lo}_b") <= F.col(f"{hi}_a")) for lo, hi in axes])
    out = spread(met.select(*by, "rows_a", "rows_b"), own).where((F.col(f"{key}_a") < F.col(f"{key}_b")) & meets)
    return out.select(*by, *[(F.col(c) if c in by else F.col(f"{c}_{s}")).alias(f"{c}_{s}") for s in "ab" for c in cols])


def overlap_interval(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> tuple[Column, Column]:
    """Ends of the intersection of two closed intervals, null where it is empty."""
    lo, hi = F.greatest(lo_a, lo_b), F.least(hi_a, hi_b)
    return F.when(lo <= hi, lo), F.when(lo <= hi, hi)


def overlap_boxes(pairs: DataFrame, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Pairs (lo_x_a, hi_x_a, lo_x_b, ...) with lo_x .. hi_z of what their boxes have in common; those without an extent on some axis are left out.

    Two images of one plane each (sz_a and sz_b are 1) that both lie at 0 of the last axis have [0, 1] there.
    """
    last = axes[-1]
    for c in axes:
        lo, hi = F.greatest(f"lo_{c}_a", f"lo_{c}_b"), F.least(f"hi_{c}_a", f"hi_{c}_b")
        flat = (lo == hi) & (lo == 0) & (F.col(f"s{c}_a") == 1) & (F.col(f"s{c}_b") == 1) if c == last else F.lit(False)
        pairs = pairs.withColumns({f"lo_{c}": lo, f"hi_{c}": F.when(flat, 1.0).otherwise(hi)})
    return pairs.where(functools.reduce(lambda x, y: x & y, [F.col(f"lo_{c}") < F.col(f"hi_{c}") for c in axes]))


def inside_intervals(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, cell: float, condition: Column | None = None) -> DataFrame:
    """Points that lie in some interval (semi-join), found by cells."""
    dealt = intervals.withColumn("i_cell", F.explode(_cells(F.col(low), F.col(high), cell)))
    on = (F.floor(F.col(at) / cell) == F.col("i_cell")) & (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))
    return points.join(dealt, on if condition is None else on & condition, "left_semi")


def points_in_other_views(points: DataFrame, views: DataFrame, group: str, cell: float, slack: float = 1e-9) -> DataFrame:
    """Points (tp, setup, the group, world place wx, wy, wz) that lie in the image of a view of their timepoint and of another group.

    Views have tp, the group, m and sizes sx, sy, sz. A point's candidates are the views whose world box covers its cell
    of x; each then maps the point back by its inverse, and the image has it if it lies between 0 and size - 1 on every
    axis, or beyond by `slack` at most. Views whose map has no inverse contain nothing.
    """
    lo, hi = affine.bounds(F.col("m"), [F.lit(0.0)] * 3, [(F.col(f"s{c}") - 1).cast("double") for c in "xyz"])
    v = views.select(F.col("tp").alias("v_tp"), F.col(group).alias("v_group"), affine.inverse(F.col("m")).alias("v_back"), *[F.col(f"s{c}").alias(f"v_s{c}") for c in "xyz"], lo[0].alias("v_lo"), hi[0].alias("v_hi"))
    v = v.where("v_back is not null").withColumn("v_cell", F.explode(_cells(F.col("v_lo") - slack, F.col("v_hi") + slack, cell)))
    at = affine.apply(F.col("v_back"), F.col("wx"), F.col("wy"), F.col("wz"))
    inside = functools.reduce(lambda x, y: x & y, [(a >= -slack) & (a <= F.col(f"v_s{c}") - 1 + slack) for a, c in zip(at, "xyz", strict=True)])
    return points.join(v.hint("merge"), (F.col("tp") == F.col("v_tp")) & (F.floor(F.col("wx") / cell) == F.col("v_cell")) & (F.col(group) != F.col("v_group")) & inside, "left_semi")


def distance_squared(axes: list[str]) -> Column:
    return functools.reduce(lambda x, y: x + y, [(F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in axes])


def within_radius(a: DataFrame, b: DataFrame, axes: list[str], radius: float, by: list[str] | None = None) -> DataFrame:
    """Pairs of rows of a and b at most radius apart, with d2; columns get _a and _b. by: columns that must agree.

    Cells are two radii wide, so the ball around a row of b touches at most two of them on an axis: b is dealt to
    2^n cells at most, a to its own. The dealt side has many times the rows that its file tells of, so it's never
    broadcast. Rows with a null coordinate or a null in `by` have no pair.
    """
    by = by or []
    cell = 2.0 * radius
    left = a.select(*[F.col(c).alias(f"{c}_a") for c in a.columns], *[F.floor(F.col(c) / cell).alias(f"cell_{i}") for i, c in enumerate(axes)])
    right = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    for i, c in enumerate(axes):
        right = right.withColumn(f"cell_{i}", F.explode(_cells(F.col(f"{c}_b") - radius, F.col(f"{c}_b") + radius, cell)))
    for c in by:
        right = right.withColumn(f"same_{c}", F.col(f"{c}_b"))
        left = left.withColumn(f"same_{c}", F.col(f"{c}_a"))
    on = [f"cell_{i}" for i in range(len(axes))] + [f"same_{c}" for c in by]
    out = left.join(right.hint("merge"), on).withColumn("d2", distance_squared(axes)).where(F.col("d2") <= radius * radius)
    return out.drop(*on)


def nearest(a: DataFrame, b: DataFrame, axes: list[str], key_a: list[str], key_b: list[str], radius: float, by: list[str] | None = None, k: int = 1, skip_self: bool = False) -> DataFrame:
    """The k nearest rows of b within radius for each row of a, with place 1..k; ties by the key of b."""
    found = within_radius(a, b, axes, radius, by)
    if skip_self:
        found = found.where(~functools.reduce(lambda x, y: x & y, [F.col(f"{p}_a") == F.col(f"{q}_b") for p, q in zip(key_a, key_b, strict=True)]))
    w = Window.partitionBy(*[f"{c}_a" for c in key_a]).orderBy("d2", *[f"{c}_b" for c in key_b])
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


#: Points of a leaf of the tree of boxes, and nodes of a node above, as powers of two; bits of a coordinate in the order along the leaves.
LEAF_BITS, FAN_BITS, ORDER_BITS = 4, 3, 16


def _interleaved(columns: list[Column], low: list[float], high: list[float]) -> Column:
    """Places of cells along the curve that takes one bit of each coordinate in turn."""
    out = F.lit(0).cast("long")
    most = (1 << ORDER_BITS) - 1
    for i, (c, lo, hi) in enumerate(zip(columns, low, high, strict=True)):
        at = F.least(F.lit(most), F.floor((c - lo) / max(hi - lo, 1e-300) * most)).cast("long")
        for bit in range(ORDER_BITS):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(at, bit).bitwiseAND(F.lit(1)), bit * len(columns) + i))
    return out


def box_tree(rows: DataFrame, axes: list[str], by: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """rows with `node`, the leaf of each, and the levels of a tree of boxes over the leaves of each list, the finest first.

    A list's rows are put in the order of a curve; runs of 2^LEAF_BITS places are leaves, and 2^FAN_BITS neighbouring
    nodes make one of the next level, up to that where no list has more than 2^FAN_BITS + 1 nodes. The order is a sort by
    range and places are counted per partition, so no task holds a list. A level: by, node, n, lo_i and hi_i of each axis.
    """
    ends = rows.agg(*[f(c).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i, c in enumerate(axes)]).first()
    n = len(axes)
    low, high = [float(x or 0) for x in ends[:n]], [float(x or 0) for x in ends[n:]]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    curve = rows.withColumn("b_curve", _interleaved([F.col(c) for c in axes], low, high))
    placed = curve.repartitionByRange(parts, *by, "b_curve").sortWithinPartitions(*by, "b_curve").drop("b_curve")
    placed = materialize(placed.withColumn("b_part", F.spark_partition_id()).withColumn("b_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    # a row per partition
    before = F.coalesce(F.sum("count").over(Window.orderBy("b_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(placed.groupBy("b_part").count().select("b_part", before.alias("b_before")))
    ranked = placed.join(F.broadcast(offsets), "b_part").withColumn("node", F.shiftright(F.col("b_before") + F.col("b_place"), LEAF_BITS)).drop("b_part", "b_place", "b_before")
    box = [f(c).alias(f"{e}_{i}") for i, c in enumerate(axes) for e, f in (("lo", F.min), ("hi", F.max))]
    levels = [materialize(ranked.groupBy(*by, "node").agg(F.count(F.lit(1)).alias("n"), *box))]
    up = [f(f"{e}_{i}").alias(f"{e}_{i}") for i in range(n) for e, f in (("lo", F.min), ("hi", F.max))]
    while (levels[-1].groupBy(*by).count().agg(F.max("count")).first()[0] or 0) > (1 << FAN_BITS) + 1:
        levels.append(materialize(levels[-1].withColumn("node", F.shiftright("node", FAN_BITS)).groupBy(*by, "node").agg(F.sum("n").alias("n"), *up)))
    return ranked, levels


def nearest_distance(points: DataFrame, others: DataFrame, axes: list[str], key: list[str], by: list[str], skip_self: bool) -> DataFrame:
    """key, d: distance of each point to the nearest of others that agrees on `by`; points without any are left out.

    Others are put in a tree of boxes, and points go down it level by level: a box is entered only if it's nearer than
    the farthest place of some box that is known to hold another point. So a point meets a few boxes at each level and
    a few leaves, wherever it lies and however dense the others are; equal places are settled by their box. Each level
    is a join by node and a window by point. Rows with a null coordinate or a null in `by` take no part.
    """
    whole = functools.reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*axes, *by]])
    rows, levels = box_tree(others.where(whole).select(*dict.fromkeys([*key, *by, *axes])), axes, by)
    own = list(dict.fromkeys([*key, *by]))
    gap = lambda i, c: F.greatest(F.col(f"lo_{i}") - F.col(c), F.col(c) - F.col(f"hi_{i}"), F.lit(0.0))
    far = lambda i, c: F.greatest(F.abs(F.col(c) - F.col(f"lo_{i}")), F.abs(F.col(c) - F.col(f"hi_{i}")))
    least = functools.reduce(lambda x, y: x + y, [gap(i, c) * gap(i, c) for i, c in enumerate(axes)])
    most = functools.reduce(lambda x, y: x + y, [far(i, c) * far(i, c) for i, c in enumerate(axes)])
    most = F.when(F.col("n") > (1 if skip_self else 0), most)
    by_point = Window.partitionBy(*key)
    at = points.where(whole).select(*own, *axes, F.lit(None).cast("double").alias("bound"))
    for level in reversed(levels):
        if "node" in at.columns:
            level = level.withColumn("above", F.shiftright("node", FAN_BITS))
            met = at.withColumnRenamed("node", "above").join(level.hint("merge"), [*by, "above"]).drop("above")
        else:
            met = at.join(level.hint("merge"), by)
        met = met.withColumns({"nearest": least, "bound": F.least("bound", F.min(most).over(by_point)), "first": F.row_number().over(by_point.orderBy(least, "node"))})
        # the first box stays in any case: its row carries the bound
        at = met.where((F.col("first") == 1) | F.col("bound").isNull() | (F.col("nearest") < F.col("bound"))).select(*own, *axes, "bound", "node")
        if level is not levels[0]:
            at = materialize(at)
    left = at.select(*[F.col(c).alias(f"{c}_a") for c in [*own, *axes]], "bound", "node", *[F.col(c).alias(f"same_{c}") for c in by])
    right = rows.select(*[F.col(c).alias(f"{c}_b") for c in [*own, *axes]], "node", *[F.col(c).alias(f"same_{c}") for c in by])
    d2 = distance_squared(axes)
    if skip_self:
        d2 = F.when(~functools.reduce(lambda x, y: x & y, [F.col(f"{c}_a") == F.col(f"{c}_b") for c in key]), d2)
    out = left.join(right.hint("merge"), ["node", *[f"same_{c}" for c in by]]).groupBy(*[F.col(f"{c}_a").alias(c) for c in key]).agg(F.least(F.min("bound"), F.min(d2)).alias("d2"))
    return out.where("d2 is not null").select(*key, F.sqrt("d2").alias("d"))
