"""Interest points: filters, thinning, grouping, histograms, extrema of signals."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.functions import kernels as K
from lumiframe.operators import spatial

VIEW = ["tp", "setup", "label"]
AXES = ["x", "y", "z"]


def limit_detections(points: DataFrame, most: int, how: str = "brightest") -> DataFrame:
    """Of each list the brightest, weakest, or those around the median, by absolute intensity; ties by id.

    Around the median, ranks n/2 - most/2 to n/2 + most/2 of the descending order stay, both included: one more than
    `most` where that is even. A list that has no more than `most` points stays whole.
    """
    size = F.abs(F.col("intensity"))
    order = Window.partitionBy(*VIEW).orderBy(size.asc() if how == "weakest" else size.desc(), "id")
    p = points.withColumn("r", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*VIEW)))
    middle = F.floor(F.col("n") / 2)
    keep = F.col("r").between(middle - most // 2, middle + most // 2) if how == "median" else F.col("r") < most
    return p.where(keep | (F.col("n") <= most)).drop("r", "n")


def renumber(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ids from 0 in the order of the old ones, within each list."""
    return points.withColumn("id", F.row_number().over(Window.partitionBy(*(by or VIEW)).orderBy("id")) - 1)


def thin_out(points: DataFrame, low: float, high: float, keep: bool) -> DataFrame:
    """Points whose distance to the nearest other point of their list is in [low, high], kept or cut; ids are renumbered.

    A point without any other isn't in a range.
    """
    key = [*VIEW, "id"]
    d = spatial.nearest_distance(points.select(*key, *AXES), points.select(*key, *AXES), AXES, key, VIEW, True)
    inside = d.where(F.col("d").between(low, high)).select(*key)
    return renumber(points.join(inside, key, "left_semi" if keep else "left_anti"))


def relative_thin_out(points: DataFrame, others: DataFrame, low: float, high: float, keep: bool) -> DataFrame:
    """As thin_out(), by the distance to the nearest point of another label of the same view."""
    key, view = [*VIEW, "id"], ["tp", "setup"]
    d = spatial.nearest_distance(points.select(*key, *AXES), others.select(*key, *AXES), AXES, key, view, False)
    inside = d.where(F.col("d").between(low, high)).select(*key)
    return renumber(points.join(inside, key, "left_semi" if keep else "left_anti"))


def histogram(values: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """bin, centre, n of a column: bins of equal width over [min, max + 1e-6); empty bins are left out."""
    ends = values.agg(F.min(column).alias("h_lo"), F.max(column).alias("h_hi"))
    width = (F.col("h_hi") - F.col("h_lo") + F.lit(1e-6)) / bins
    at = F.floor((F.col(column) - F.col("h_lo")) / width)
    out = values.crossJoin(F.broadcast(ends)).where(F.col(column).isNotNull())  # one row
    return out.groupBy(at.cast("int").alias("bin"), F.lit(None).alias("none")).agg(F.count(F.lit(1)).alias("n"), F.first((F.col("h_lo") + (at + 0.5) * width)).alias("centre")).drop("none")


def drop_duplicates_within(points: DataFrame, radius: float) -> DataFrame:
    """Points without an earlier one (by id) of the same list within radius.

    Each list is swept along x: a task holds the points of a slab of one radius, and pairs are neither written nor
    shuffled. Lists come from a window, so points that were numbered by one aren't shuffled again. Points with a null
    coordinate or id, or of a list with a null in its name, stay.
    """
    columns = points.columns
    listed = points.withColumn("s_place", F.row_number().over(Window.partitionBy(*VIEW).orderBy("x")))
    whole = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*VIEW, *AXES, "id"]])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute

        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t.append_column("s_gone", pa.array(np.zeros(len(t), bool)))
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not len(t):
                continue
            column = lambda c: t.column(c).to_numpy()  # noqa: B023, E731
            n, use = len(t), np.flatnonzero(column("s_whole"))
            part = np.cumsum(column("s_place") == 1)
            at = np.stack([t.column(c).cast(pa.float64()).to_numpy()[use] for c in AXES], 1)
            gone = column("s_gone").copy()
            gone[use] |= K.later_within(part[use], at, column("id")[use], radius)
            t = t.set_column(t.schema.get_field_index("s_gone"), "s_gone", pa.array(gone))
            # what may still meet a point of the last list
            last = use[part[use] == part[-1]]
            open_ = last[at[-1, 0] - at[len(use) - len(last) :, 0] <= radius * (1 + 1e-12)] if len(last) else last
            wait = np.zeros(n, bool)
            wait[open_] = True
            held = t.filter(pa.array(wait))
            yield from t.filter(pa.array(~wait & ~gone)).select(columns).to_batches()
        if held is not None:
            yield from held.filter(pa.compute.invert(held.column("s_gone"))).select(columns).to_batches()

    return listed.withColumn("s_whole", whole).mapInArrow(run, points.schema)


def labels(points: DataFrame, links: DataFrame) -> DataFrame:
    """Labels with the number of views and points that have them, and of points with partners."""
    linked = links.select(*VIEW, "id").distinct().withColumn("linked", F.lit(1))
    return points.join(linked, [*VIEW, "id"], "left").groupBy("label").agg(F.count_distinct("tp", "setup").alias("views"), F.count(F.lit(1)).alias("points"), F.count("linked").alias("linked"))


def group_all(points: DataFrame) -> DataFrame:
    """Points of all views of a group as one list per timepoint and label; their order is (setup, id)."""
    w = Window.partitionBy("tp", "label").orderBy("setup", "id")
    return points.withColumn("group_point", F.row_number().over(w) - 1)


def local_extrema(signal: DataFrame, by: str, at: str, value: str, threshold: float) -> DataFrame:
    """Places of a one-dimensional signal that no neighbour exceeds (max) or falls below (min), with |value| >= threshold.

    Comparisons aren't strict, so plateaus give several; ends of a signal are left out.
    """
    w = Window.partitionBy(by).orderBy(at)
    v, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
    s = signal.withColumns({"before": before, "after": after}).where("before is not null and after is not null")
    kind = F.when((v >= F.col("before")) & (v >= F.col("after")), "max").when((v <= F.col("before")) & (v <= F.col("after")), "min")
    return s.withColumn("kind", kind).where(F.col("kind").isNotNull() & (F.abs(v) >= threshold)).drop("before", "after")


#: Open points of a cell of half a radius, in the mean of points, from which suppress() goes by cells.
DENSE = 2


def suppress(points: DataFrame, radius: float, seed: int = 234, order: Column | None = None) -> DataFrame:
    """Points that stay when each, in an order of hashes, takes away those of other views within radius that are still there.

    The order is xxhash64(tp, setup, id, seed), or the column given. A point goes if an earlier one that stays is near.

    While points are dense, no pairs are formed: each round, a cell's earliest point, and those of its view that come
    before all others, stay if no cell in reach has an earlier one of another view; they then take away what is near, and
    both leave. All that stay in a cell are of few views, so what a round compares grows with the cells. Once cells have
    about DENSE open points, links are made: each round then settles the points whose earlier neighbours are settled.
    """
    from lumiframe.operators.iterate import discard, materialize

    key = ["tp", "label", "setup", "id"]
    side = radius / 2 * (1 + 1e-9)
    places = [f"c_{c}" for c in AXES]
    cell = ["tp", "label", *places]
    p = points.select(*key, *AXES).where(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*key, *AXES]]))
    p = p.withColumn("o", F.xxhash64("tp", "setup", "id", F.lit(seed)) if order is None else order)
    p = materialize(p.withColumns({f"c_{c}": F.floor(F.col(c) / side) for c in AXES}))
    rank = F.struct("o", "setup", "id")
    stayed = [points.where(functools.reduce(lambda a, b: a | b, [F.col(c).isNull() for c in AXES])).select(*key)]

    def reach(d: DataFrame) -> DataFrame:
        """Rows once for each cell that a ball around a point of theirs may touch."""
        for c in places:
            d = d.withColumn(c, F.explode(F.sequence(F.col(c) - 2, F.col(c) + 2)))
        return d

    while True:
        n, crowd = p.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if not n or crowd <= DENSE * n:
            break
        # the first points of the first two views of each cell
        firsts = p.groupBy(*cell, "setup").agg(F.min(rank).alias("r"))
        firsts = firsts.withColumn("place", F.row_number().over(Window.partitionBy(*cell).orderBy("r"))).where("place <= 2")
        firsts = materialize(firsts.groupBy(*cell).agg(F.min("r").alias("r_1"), F.max(F.when(F.col("place") == 2, F.col("r"))).alias("r_2")))
        own = firsts.select(*cell, F.col("r_1.setup").alias("own_setup"))
        limit = reach(firsts).join(own.hint("merge"), cell).groupBy(*cell, "own_setup").agg(F.min(F.when(F.col("r_1.setup") != F.col("own_setup"), F.col("r_1")).otherwise(F.col("r_2"))).alias("limit"))
        stay = p.join(limit.withColumnRenamed("own_setup", "setup"), [*cell, "setup"]).where(F.col("limit").isNull() | (rank < F.col("limit")))
        stay = materialize(stay.select(*key, *AXES, *places))
        stayed.append(stay.select(*key))
        near = reach(stay.select("tp", "label", *places, F.col("setup").alias("n_setup"), F.col("id").alias("n_id"), *[F.col(c).alias(f"n_{c}") for c in AXES]))
        gone = (F.col("setup") == F.col("n_setup")) & (F.col("id") == F.col("n_id"))
        for c in AXES:
            near = near.withColumnRenamed(f"c_{c}", f"m_{c}")
        near = near.withColumnsRenamed({"tp": "m_tp", "label": "m_label"})
        d2 = functools.reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"n_{c}")) * (F.col(c) - F.col(f"n_{c}")) for c in AXES])
        same = functools.reduce(lambda a, b: a & b, [F.col(c) == F.col(f"m_{c.removeprefix('c_')}") for c in cell])
        left = materialize(p.join(near.hint("merge"), same & (gone | ((F.col("setup") != F.col("n_setup")) & (d2 <= radius * radius))), "left_anti"))
        discard(p, firsts)
        p = left
    near = spatial.within_radius(p, p, AXES, radius, ["tp", "label"]).where((F.col("setup_a") != F.col("setup_b")) & (F.struct("o_b", "setup_b", "id_b") < F.struct("o_a", "setup_a", "id_a")))
    links = materialize(near.select(*[F.col(f"{c}_a").alias(c) for c in key], *[F.col(f"{c}_b").alias(f"n_{c}") for c in key]))
    state = materialize(p.select(*key, F.lit(None).cast("boolean").alias("stays")))
    while True:
        other = state.select(*[F.col(c).alias(f"n_{c}") for c in key], F.col("stays").alias("n_stays"))
        seen = links.join(other, [f"n_{c}" for c in key]).groupBy(*key).agg(F.coalesce(F.bool_or("n_stays"), F.lit(False)).alias("taken"), F.count_if(F.col("n_stays").isNull()).alias("open"))
        after = state.join(seen, key, "left").select(*key, F.when(F.col("stays").isNotNull(), F.col("stays")).when(F.col("taken"), False).when(F.coalesce("open", F.lit(0)) == 0, True).alias("stays"))
        before, state = state, materialize(after)
        discard(before)
        if state.where("stays is null").isEmpty():
            stayed.append(state.where("stays").select(*key))
            return points.join(functools.reduce(DataFrame.unionByName, stayed), key, "left_semi")


def blob_labels(cells: DataFrame, by: list[str], axis: str, value: str, threshold: float) -> DataFrame:
    """Runs of neighbouring cells above a threshold on a line: label, size, extent and peak of each."""
    bright = cells.where(F.col(value) > threshold)
    w = Window.partitionBy(*by).orderBy(axis)
    run = bright.withColumn("run", F.col(axis) - F.row_number().over(w))
    return run.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("size"), F.min(axis).alias("first"), F.max(axis).alias("last"), F.max(value).alias("peak")).drop("run")


def cell_components(cells: DataFrame, by: list[str], axes: list[str], value: str, threshold: float, corners: bool = True) -> DataFrame:
    """by, size, peak, min_x, max_x, ...: connected cells above a threshold, on any number of axes; with corners, cells that meet at one touch.

    Each cell joins its neighbours by equality, and components come from alternating stars, so none is gathered.
    """
    from itertools import product

    from lumiframe.operators.iterate import components, materialize

    bright = cells.where(F.col(value) > threshold).select(*by, *axes, F.col(value).alias("b_value")).dropDuplicates([*by, *axes])
    bright = materialize(bright.withColumn("b_id", F.monotonically_increasing_id()))
    ways = [w for w in product((-1, 0, 1), repeat=len(axes)) if w > (0,) * len(axes) and (corners or sum(map(abs, w)) == 1)]
    beside = bright.select(*by, F.col("b_id").alias("a"), F.inline(F.array(*[F.struct(*[(F.col(c) + s).alias(c) for c, s in zip(axes, w, strict=True)]) for w in ways])))
    edges = beside.join(bright.select(*by, *axes, F.col("b_id").alias("b")), [*by, *axes]).select("a", "b")
    found = components(edges)
    label = bright.join(found, F.col("b_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "b_id"))
    ends = [f(c).alias(f"{n}_{c}") for c in axes for n, f in (("min", F.min), ("max", F.max))]
    return label.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("size"), F.max("b_value").alias("peak"), *ends).drop("component")


def drop_weaker(points: DataFrame, radius: float) -> DataFrame:
    """Points without a stronger one (by absolute intensity, of equal ones the smaller id) of the same list within radius."""
    p = points.select(*VIEW, "id", *AXES, F.abs("intensity").alias("strength"))
    near = spatial.within_radius(p, p, AXES, radius, VIEW).where("strength_b > strength_a or (strength_b = strength_a and id_b < id_a)")
    weaker = near.select(*[F.col(f"{c}_a").alias(c) for c in [*VIEW, "id"]]).distinct()
    return points.join(weaker, [*VIEW, "id"], "left_anti")


def box_filter(points: DataFrame, low: list[float], high: list[float], inside: bool) -> DataFrame:
    """Points inside a box, or outside it."""
    at: Column = functools.reduce(lambda a, b: a & b, [F.col(c).between(low[i], high[i]) for i, c in enumerate(AXES[: len(low)])])
    return points.where(at if inside else ~at)
