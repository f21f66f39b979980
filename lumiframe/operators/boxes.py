"""Bounding boxes and the splitting of views."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.functions import affine
from lumiframe.operators.iterate import materialize
from lumiframe.operators.spatial import typical_extent

AXES = ("x", "y", "z")


def view_bounds(views: DataFrame, model: str = "m") -> DataFrame:
    """lo_x .. hi_z of the transformed image of each view: voxels 0 to size - 1."""
    lo, hi = affine.bounds(F.col(model), [F.lit(0.0)] * 3, [(F.col(f"s{c}") - 1).cast("double") for c in AXES])
    return views.withColumns({f"lo_{c}": lo[i] for i, c in enumerate(AXES)} | {f"hi_{c}": hi[i] for i, c in enumerate(AXES)})


def corners(views: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    """The corner voxels of each view's image: 0 or size - 1 on each axis, a row each."""
    for c in axes:
        views = views.withColumn(c, F.explode(F.array(F.lit(0).cast("long"), (F.col(f"s{c}") - 1).cast("long"))))
    return views


def maximal_box(bounds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whole-numbered box around all views: floor of the least, ceiling of the most."""
    out = [F.floor(F.min(f"lo_{c}")).cast("int").alias(f"min_{c}") for c in AXES] + [F.ceil(F.max(f"hi_{c}")).cast("int").alias(f"max_{c}") for c in AXES]
    return bounds.groupBy(*(by or [])).agg(*out)


ENDS = [f"{e}_{c}" for c in AXES for e in ("lo", "hi")]


def _merged(boxes: DataFrame) -> DataFrame:
    """Boxes that cover the same places: on each axis, those that agree on the other two and touch are joined."""
    for c in AXES:
        lo, hi = f"lo_{c}", f"hi_{c}"
        w = Window.partitionBy(*[e for e in ENDS if e not in (lo, hi)]).orderBy(lo, hi)
        before = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
        runs = boxes.withColumn("run", F.when(before.isNull() | (before < F.col(lo)), 1).otherwise(0)).withColumn("run", F.sum("run").over(w))
        others = [e for e in ENDS if e not in (lo, hi)]
        boxes = runs.groupBy(*others, "run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).select(*ENDS)
    return boxes


#: Boxes of a group that the first choices are made of, and choices held while they are made.
SEEDS, CHOICES = 24, 4096


def _seed_choices(rows: list, groups: list, end: str):
    """What choices of some boxes of each group have in common, as arrays of ENDS; those that reach farthest are held."""
    import numpy as np

    at, sign = ENDS.index(end), 1 if end.startswith("lo") else -1
    lows = np.array([e.startswith("lo") for e in ENDS])
    now = None
    for g in groups:
        other = np.array([[r[e] for e in ENDS] for r in rows if r["g"] == g], float)
        if now is None:
            now = other
            continue
        met = np.where(lows, np.maximum(now[:, None], other[None]), np.minimum(now[:, None], other[None])).reshape(-1, len(ENDS))
        now = met[(met[:, lows] <= met[:, ~lows]).all(1)]
        now = now[np.argsort(sign * now[:, at], kind="stable")[:CHOICES]]
    return now


def group_overlap_box(bounds: DataFrame, group: str) -> DataFrame:
    """Box around what each choice of one view per group has in common on all axes, over all choices that have something.

    Each of its six ends is that of one choice. A first choice is made of some boxes of each group that reach farthest to
    the end; only choices of boxes that all reach beyond it can be better, and where some group has no such box, the end
    is found. Else all choices of the boxes that do are tried by _common(). Views without a box or a group are left out.
    """
    views = bounds.where(functools.reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [group, *ENDS]])).select(F.col(group).alias("g"), *[F.col(e).cast("double").alias(e) for e in ENDS]).distinct()
    views = materialize(views)
    groups = [r["g"] for r in views.select("g").distinct().orderBy("g").collect()]
    if not groups:
        return _whole_box(views)
    lower = lambda e: e.startswith("lo")
    first = lambda e: views.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(F.col(e) if lower(e) else F.desc(e), *[c for c in ENDS if c != e]))).where(F.col("place") <= SEEDS).select(F.lit(e).alias("end"), "g", *ENDS)
    seeds = functools.reduce(DataFrame.unionByName, [first(e) for e in ENDS]).collect()
    best: dict[str, float] = {}
    for e in ENDS:
        made = _seed_choices([r for r in seeds if r["end"] == e], groups, e)
        for k, c in enumerate(ENDS):
            if len(made):
                v = float(made[:, k].min() if lower(c) else made[:, k].max())
                best[c] = v if c not in best else min(best[c], v) if lower(c) else max(best[c], v)
    beyond = {e: F.lit(True) if e not in best else F.col(e) < best[e] if lower(e) else F.col(e) > best[e] for e in ENDS}
    left = views.groupBy("g").agg(*[F.count_if(beyond[e]).alias(e) for e in ENDS]).collect()
    found = [views.sparkSession.createDataFrame([tuple(best[e] for e in ENDS)], ", ".join(f"{e} double" for e in ENDS))] if best else []
    for e in ENDS if best else ENDS[:1]:
        if all(r[e] for r in left):
            found.append(_common(views.where(beyond[e]), groups))
    return _whole_box(functools.reduce(DataFrame.unionByName, found))


def _common(views: DataFrame, groups: list) -> DataFrame:
    """What the choices have in common, taken together: the places that some view of every group covers, as boxes.

    Groups are taken one after the other: the places covered so far are intersected with the next group's boxes, which
    are found by cells of x; boxes that repeat or continue one another are joined. One step per group, of which there are
    a few (angles, channels).
    """
    cell = typical_extent(views, "lo_x", "hi_x")
    deal = lambda d, a, b: d.withColumn("cell", F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))))
    now = materialize(_merged(views.where(F.col("g") == groups[0]).select(*ENDS)))
    for g in groups[1:]:
        other = deal(views.where(F.col("g") == g).select(*[F.col(c).alias(f"o_{c}") for c in ENDS]), "o_lo_x", "o_hi_x")
        both = deal(now, "lo_x", "hi_x").join(other.hint("merge"), "cell")
        met = both.select(*[f(f"{e}_{c}", f"o_{e}_{c}").alias(f"{e}_{c}") for c in AXES for e, f in (("lo", F.greatest), ("hi", F.least))])
        now = materialize(_merged(met.where(functools.reduce(lambda x, y: x & y, [F.col(f"lo_{c}") <= F.col(f"hi_{c}") for c in AXES])).distinct()))
    return now


def _whole_box(boxes: DataFrame) -> DataFrame:
    ends = boxes.agg(*[f(f"{e}_{c}").alias(f"{e}_{c}") for c in AXES for e, f in (("lo", F.min), ("hi", F.max))]).where("lo_x is not null")
    return ends.select(*[F.floor(f"lo_{c}").cast("int").alias(f"min_{c}") for c in AXES], *[F.ceil(f"hi_{c}").cast("int").alias(f"max_{c}") for c in AXES])


def scaled_box(lo: Column, hi: Column, factor: Column) -> tuple[Column, Column]:
    """Ends of a box after downsampling, rounded half up."""
    return affine.round_half_up(lo / factor), affine.round_half_up(hi / factor)


def scaled_offset(lo: Column, factor: Column) -> Column:
    """What rounding takes off a scaled box's lower end, so that its transform can make up for it."""
    return lo / factor - affine.round_half_up(lo / factor)


def anisotropic_box(lo: Column, hi: Column, anisotropy: float) -> tuple[Column, Column]:
    """Ends of the z axis shrunk by the anisotropy: floor and ceiling."""
    return F.floor(lo / anisotropy), F.ceil(hi / anisotropy)


def integer_box(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Ends rounded half up and grown by one."""
    return affine.round_half_up(lo) - 1, affine.round_half_up(hi) + 1


def threshold_box(cells: DataFrame, by: list[str], axis: str, value: str, share: float, radius: int) -> DataFrame:
    """Extent of the cells whose least neighbour value within radius is above min + share x (max - min), grown by 3 radii."""
    near = Window.partitionBy(*by).orderBy(axis).rangeBetween(-radius, radius)
    all_ = Window.partitionBy(*by)
    lo, hi = F.min(value).over(all_), F.max(value).over(all_)
    c = cells.withColumns({"eroded": F.min(value).over(near), "limit": lo + (hi - lo) * share})
    return c.where("eroded > limit").groupBy(*by).agg((F.min(axis) - 3 * radius).alias("lo"), (F.max(axis) + 3 * radius).alias("hi"))


def split_interval(low: int, high: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Closed tiles of a length with a fixed overlap, from low; the last may be shorter."""
    if size <= overlap:
        raise ValueError("tiles are longer than their overlap")
    out, start = [], low
    while True:
        stop = min(high, start + size - 1)
        out.append((start, stop))
        if stop == high:
            return out
        start = stop - overlap + 1


def last_size(length: int, size: int, overlap: int) -> int:
    a, b = split_interval(0, length - 1, size, overlap)[-1]
    return b - a + 1


def best_size(length: int, size: int, overlap: int, step: int) -> int:
    """A tile length near `size`, in steps, whose last tile is as full as can be.

    While the last tile is at most half full, tiles grow as long as it keeps shrinking; then, or else, they shrink as
    long as it keeps growing, and the last step back is undone.
    """
    if length <= size:
        return size
    last = last_size(length, size, overlap)
    if last <= size / 2:
        while True:
            nxt = last_size(length, size + step, overlap)
            size += step
            if nxt >= last:
                return size
            last = nxt
    while size - step > overlap:
        nxt = last_size(length, size - step, overlap)
        size -= step
        if nxt < last:
            return size + step
        last = nxt
    return size


def split_views(setups: DataFrame, size: int, overlap: int, axis: str = "x") -> DataFrame:
    """Sub-views of each setup along an axis: new setup id, interval, and the translation that they start with.

    Tiles are an expression of the length, so no list of tiles is collected: tile i starts at i x (size - overlap).
    """
    step = size - overlap
    length = F.col(f"s{axis}")
    n = F.greatest(F.lit(1), F.ceil((length - F.lit(overlap)) / F.lit(step))).cast("int")
    tiles = setups.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    start = (F.col("part") * step).cast("long")
    return tiles.withColumns({"from": start, "to": F.least(length, start + size) - 1}).withColumn("new_setup", F.row_number().over(Window.orderBy("setup", "part")) - 1)


def running_total(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with `before`, the sum of the values of all smaller keys. Keys are dealt by range; a row per partition meets in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, key).withColumn("r_part", F.spark_partition_id()))
    earlier = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("r_part").agg(F.sum(value).alias(value)).select("r_part", earlier(Window.orderBy("r_part")).alias("r_before"))
    within = dealt.withColumn("before", earlier(Window.partitionBy("r_part").orderBy(key)))
    return within.join(F.broadcast(offsets), "r_part").withColumn("before", F.col("before") + F.col("r_before")).drop("r_part", "r_before")


def split_volumes(views: DataFrame, size: tuple[int, int, int], overlap: tuple[int, int, int]) -> DataFrame:
    """Sub-views of views (tp, setup, m, sx, sy, sz) on three axes: new_setup, part, from_x .. to_z, and the map m of the part's own voxels.

    A part's map is the view's after the translation by the part's first voxel. New setups number (setup, part) from 0,
    for all timepoints alike; the last part of an axis may be shorter. Views without a size are left out.
    """
    out = views.where("sx is not null and sy is not null and sz is not null")
    n = {}
    for c, s, o in zip(AXES, size, overlap, strict=True):
        if s <= o:
            raise ValueError("parts are longer than their overlap")
        n[c] = F.greatest(F.lit(1), F.ceil((F.col(f"s{c}") - o) / (s - o))).cast("int")
    # a setup's parts are numbered without gaps, so new setups go on from the number of all parts before: a row per setup
    before = running_total(out.groupBy("setup").agg(F.max((n["x"] * n["y"] * n["z"]).cast("long")).alias("parts")), "setup", "parts")
    out = out.join(before.withColumnRenamed("before", "first_setup").select("setup", "first_setup"), "setup")
    for c, s, o in zip(AXES, size, overlap, strict=True):
        out = out.withColumn(f"n_{c}", n[c]).withColumn(f"i_{c}", F.explode(F.sequence(F.lit(0), F.col(f"n_{c}") - 1)))
        out = out.withColumn(f"from_{c}", (F.col(f"i_{c}") * (s - o)).cast("long")).withColumn(f"to_{c}", F.least(F.col(f"s{c}").cast("long"), F.col(f"from_{c}") + s) - 1)
    place = F.col("i_x") + F.col("n_x") * (F.col("i_y") + F.col("n_y") * F.col("i_z"))
    out = out.withColumn("part", place.cast("int")).withColumn("new_setup", (F.col("first_setup") + F.col("part")).cast("int"))
    moved = affine.compose(F.col("m"), affine.translation(*[F.col(f"from_{c}") for c in AXES]))
    out = out.withColumn("m", moved).withColumns({f"s{c}": F.col(f"to_{c}") - F.col(f"from_{c}") + 1 for c in AXES})
    return out.drop("first_setup", *[f"{k}_{c}" for k in "ni" for c in AXES])


def points_of_volumes(points: DataFrame, parts: DataFrame) -> DataFrame:
    """Points that lie in a part of their view on all axes, in its coordinates and under its id; one in an overlap is in several."""
    p = parts.select("tp", "setup", "new_setup", *[f"{e}_{c}" for c in AXES for e in ("from", "to")])
    inside = functools.reduce(lambda a, b: a & b, [F.col(c).between(F.col(f"from_{c}"), F.col(f"to_{c}")) for c in AXES])
    # parts are many more than the file that views come from tells of, so they're never broadcast
    return points.join(p.hint("merge"), ["tp", "setup"]).where(inside).withColumns({c: F.col(c) - F.col(f"from_{c}") for c in AXES}).drop(*[f"{e}_{c}" for c in AXES for e in ("from", "to")])


def points_of_parts(points: DataFrame, parts: DataFrame, axis: str = "x") -> DataFrame:
    """Points that lie in a sub-view, in its coordinates and under its id."""
    p = parts.select("setup", "new_setup", "from", "to")
    return points.join(p, "setup").where(F.col(axis).between(F.col("from"), F.col("to"))).withColumn(axis, F.col(axis) - F.col("from"))


def fake_points(voxels: Column, density: float, least: int, most: int) -> Column:
    """Number of made-up points of an overlap: density per million voxels, within bounds."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(voxels * F.lit(density) / 1e6))).cast("int")


#: Points of a group up to which farthest_pairs() measures its pairs in arrays.
FEW = 4096


def _farthest_of_few(points: DataFrame, by: list[str]) -> DataFrame:
    """farthest_pairs() of groups of some thousand points at most: each group's distances in arrays of bounded size."""
    import numpy as np

    from lumiframe.functions import kernels as K
    from lumiframe.operators.matching import map_chunks

    def work(t, cuts) -> list:
        at, ids = np.stack([t.column(c).to_numpy() for c in AXES], 1).astype(float), t.column("id").to_numpy()
        found = []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            x, own, best = at[s:e], ids[s:e], None
            for rows in K.row_blocks(e - s, int(e - s)):
                d = K.square_distances(x[rows], x)
                d[own[rows, None] == own[None, :]] = -1.0
                k = int(d.argmax())
                i, j = divmod(k, d.shape[1])
                if d[i, j] >= 0 and (best is None or d[i, j] > best[2]):
                    best = (s + rows.start + i, s + j, d[i, j])
            if best is not None:
                found.append(best)
        a, b, d2 = (np.array([f[k] for f in found], np.float64 if k == 2 else np.int64) for k in range(3))
        return [*[t.column(c).take(a).combine_chunks() for c in ("group", *by)], ids[a], ids[b], d2]

    rows = points.withColumn("group", F.to_json(F.struct(*by))).select("group", *by, "id", *[F.col(c).cast("double").alias(c) for c in AXES])
    kind = dict(points.dtypes)["id"]
    ordered = ", ".join(f"`{c}` {dict(points.dtypes)[c]}" for c in by)
    return map_chunks(rows, "group", ["id"], work, f"group string, {ordered}, id_a {kind}, id_b {kind}, d2 double").drop("group")


def farthest_pairs(points: DataFrame, by: list[str], most: int = 256) -> DataFrame:
    """by, id_a, id_b, d2: the two points of each group that are farthest apart; ties by (id_a, id_b); groups of one have none.

    The groups' points are dealt to cells of their box, refined until two cells' boxes tell enough: of all pairs of
    occupied cells, those whose farthest corners are nearer than the nearest corners of another pair are dropped, and
    what is left is halved on each axis; a cell whose points share a place is final. Once so few pairs of points are left
    that they are under `most` squared a group, they are measured. So points on a sphere cost their surface's opposite
    cells, not all pairs. Groups of FEW points at most are measured as they are, so that very many of them form no cells.
    """
    p = points.where(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*AXES, "id"]])).select(*by, "id", *AXES)
    box = p.groupBy(*by).agg(*[f(c).alias(f"b{e}_{c}") for c in AXES for e, f in (("lo", F.min), ("hi", F.max))])
    counted = p.join(p.groupBy(*by).agg(F.count(F.lit(1)).alias("b_n")), by)
    few = _farthest_of_few(counted.where(F.col("b_n") <= FEW).drop("b_n"), by)
    p = materialize(counted.where(F.col("b_n") > FEW).drop("b_n").join(box, by))
    if p.isEmpty():
        return few
    kept, depth = None, 1
    far = lambda a, b: functools.reduce(lambda x, y: x + y, [F.pow(F.greatest(F.abs(F.col(f"hi_{c}_{a}") - F.col(f"lo_{c}_{b}")), F.abs(F.col(f"hi_{c}_{b}") - F.col(f"lo_{c}_{a}"))), 2) for c in AXES])
    near = lambda a, b: functools.reduce(lambda x, y: x + y, [F.pow(F.greatest(F.lit(0.0), F.col(f"lo_{c}_{a}") - F.col(f"hi_{c}_{b}"), F.col(f"lo_{c}_{b}") - F.col(f"hi_{c}_{a}")), 2) for c in AXES])
    while True:
        cell = [F.least(F.lit((1 << depth) - 1), F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"blo_{c}"), F.col(f"bhi_{c}") - F.col(f"blo_{c}")), F.lit(0.0)) * (1 << depth))).cast("int").alias(f"c_{c}") for c in AXES]
        dealt = p.select("*", *cell)
        places = [f"c_{c}" for c in AXES]
        if kept is not None:
            up = kept.select(*by, F.explode(F.array(*[F.struct(*[F.col(f"c_{c}_{s}").alias(f"u_{c}") for c in AXES]) for s in "ab"])).alias("u")).select(*by, "u.*").distinct()
            dealt = dealt.withColumns({f"u_{c}": F.shiftright(f"c_{c}", 1) for c in AXES}).join(up, [*by, *[f"u_{c}" for c in AXES]], "left_semi").drop(*[f"u_{c}" for c in AXES])
        cells = materialize(dealt.groupBy(*by, *places).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{e}_{c}") for c in AXES for e, f in (("lo", F.min), ("hi", F.max))]))
        side = lambda s: cells.select(*by, *[F.col(x).alias(f"{x}_{s}") for x in [*places, "n", *[f"{e}_{c}" for c in AXES for e in ("lo", "hi")]]])  # noqa: B023, E731
        order = F.struct(*[F.col(f"{x}_a") for x in places]) <= F.struct(*[F.col(f"{x}_b") for x in places])
        if kept is None:
            pairs = side("a").join(side("b"), by).where(order)
        else:
            # only children of pairs that were kept
            old = kept.select(*by, *[F.col(f"c_{c}_{s}").alias(f"u_{c}_{s}") for s in "ab" for c in AXES])
            one = old.join(side("a").withColumns({f"u_{c}_a": F.shiftright(f"c_{c}_a", 1) for c in AXES}), [*by, *[f"u_{c}_a" for c in AXES]])
            pairs = one.join(side("b").withColumns({f"u_{c}_b": F.shiftright(f"c_{c}_b", 1) for c in AXES}), [*by, *[f"u_{c}_b" for c in AXES]])
            pairs = pairs.select(*by, *[F.when(order, F.col(f"{x}_{s}")).otherwise(F.col(f"{x}_{t}")).alias(f"{x}_{s}") for s, t in ("ab", "ba") for x in [*places, "n", *[f"{e}_{c}" for c in AXES for e in ("lo", "hi")]]]).distinct()
        w = Window.partitionBy(*by)
        pairs = pairs.withColumns({"most": far("a", "b"), "least": near("a", "b")}).withColumn("known", F.max("least").over(w)).where("most >= known - 1e-9 * (1 + known)")
        kept = materialize(pairs.withColumn("rows", F.sum(F.col("n_a") * F.col("n_b")).over(w)))
        worst = kept.agg(F.max("rows")).first()[0]
        if worst is None or worst <= most * most or depth >= 20:
            break
        depth += 1
    at = dealt.select(*by, "id", *AXES, *places)
    a = at.select(*by, F.col("id").alias("id_1"), *[F.col(c).alias(f"a{c}") for c in AXES], *[F.col(x).alias(f"{x}_a") for x in places])
    b = at.select(*by, F.col("id").alias("id_2"), *[F.col(c).alias(f"b{c}") for c in AXES], *[F.col(x).alias(f"{x}_b") for x in places])
    met = kept.select(*by, *[f"{x}_{s}" for s in "ab" for x in places]).join(a, [*by, *[f"{x}_a" for x in places]]).join(b, [*by, *[f"{x}_b" for x in places]]).where("id_1 <> id_2")
    d2 = functools.reduce(lambda x, y: x + y, [(F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in AXES])
    met = met.select(*by, F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b"), d2.alias("d2"))
    best = F.max_by(F.struct("id_a", "id_b", "d2"), F.struct("d2", -F.col("id_a"), -F.col("id_b")))
    return few.unionByName(met.groupBy(*by).agg(best.alias("p")).select(*by, "p.id_a", "p.id_b", "p.d2"))


def rotation_xyz(a: float, b: float, c: float) -> list[list[float]]:
    """Rotation about x, then y, then z."""
    import numpy as np

    def about(i: int, t: float) -> np.ndarray:
        m = np.eye(3)
        j, k = (i + 1) % 3, (i + 2) % 3
        m[j, j], m[j, k], m[k, j], m[k, k] = np.cos(t), -np.sin(t), np.sin(t), np.cos(t)
        return m

    return (about(2, c) @ about(1, b) @ about(0, a)).tolist()


def onto_x(v) -> list[list[float]]:
    """The rotation about the shortest way that takes a direction to the axis x."""
    import numpy as np

    x = np.asarray(v, float) / np.linalg.norm(v)
    if x[0] < -1 + 1e-12:
        return np.diag([-1.0, -1.0, 1.0]).tolist()
    k = np.array([[0, x[1], x[2]], [-x[1], 0, 0], [-x[2], 0, 0]])
    return (np.eye(3) + k + k @ k / (1 + x[0])).tolist()


#: The steps of the search.
SEARCH_STEPS = (0.4, 0.2, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001)


def smallest_box(points: DataFrame, margin: float = 0.0, steps: tuple[float, ...] = SEARCH_STEPS) -> dict | None:
    """Rotation under which the box around all points (id, x, y, z) is smallest, found from their farthest pair on.

    The pair's direction is to be the axis x; each step measures the 27 directions around the best one so far, in one
    aggregate over the points, which stay where they are. As an axis leaves the turn about it open, the rotation itself is
    then refined in the same steps. Returns axis, rotation, low and high ends (grown by the margin's
    share of the extent) and volume; None without two different points.
    """
    from itertools import product

    import numpy as np

    p = points.select("id", *AXES).where("x is not null and y is not null and z is not null")
    pair = farthest_pairs(p.withColumn("all", F.lit(0)), ["all"]).first()
    if pair is None or pair["d2"] == 0:
        return None
    at = {r["id"]: np.array([r["x"], r["y"], r["z"]], float) for r in p.where(F.col("id").isin(pair["id_a"], pair["id_b"])).collect()}
    ends = sorted(at.values(), key=lambda v: v[0])
    axis = (ends[-1] - ends[0]) / np.linalg.norm(ends[-1] - ends[0])
    turn = lambda v: np.array(rotation_xyz(*v))
    best = None

    def measure(tries: list[np.ndarray]) -> None:
        """Boxes under many rotations in one aggregate; the best one so far is kept."""
        nonlocal best
        cells = []
        for r in tries:
            for row in r:
                value = sum((F.col(c) * F.lit(float(k)) for c, k in zip(AXES[1:], row[1:], strict=True)), F.col("x") * F.lit(float(row[0])))
                cells += [F.min(value), F.max(value)]
        got = np.array(list(p.agg(*cells).first()), float).reshape(len(tries), 3, 2)
        volume = np.prod(got[:, :, 1] - got[:, :, 0], axis=1)
        k = int(volume.argmin())
        if best is None or volume[k] < best[0]:
            best = (float(volume[k]), tries[k], got[k])

    moves = list(product((-1, 0, 1), repeat=3))
    for step in steps:
        measure([np.array(onto_x(v)) for d in moves if np.linalg.norm(v := axis + step * np.array(d)) > 1e-12])
        axis = best[1][0]
    for step in steps:
        base = best[1]
        measure([turn(step * np.array(d)) @ base for d in moves])
    volume, rotation, ends_ = best
    grow = margin * (ends_[:, 1] - ends_[:, 0])
    return {"axis": rotation[0].tolist(), "rotation": rotation.tolist(), "low": (ends_[:, 0] - grow).tolist(), "high": (ends_[:, 1] + grow).tolist(), "volume": volume}


def add_fake_points(overlaps: DataFrame, density: float, least: int, most: int, error: float, label: str, seed: int = 23424459) -> DataFrame:
    """Made-up corresponding points in the overlaps of sub-views (setup_a, setup_b, lo_x .. hi_z): both sides, a row each.

    Places come from hashes of the pair, the point's number and the seed, so reruns agree; the second side is off by up
    to `error` on each axis.
    """
    volume = (F.col("hi_x") - F.col("lo_x") + 1) * (F.col("hi_y") - F.col("lo_y") + 1) * (F.col("hi_z") - F.col("lo_z") + 1)
    p = overlaps.withColumn("id", F.explode(F.sequence(F.lit(0), fake_points(volume, density, least, most) - 1)))
    draw = lambda *salt: F.pmod(F.xxhash64("setup_a", "setup_b", "id", F.lit(seed), *[F.lit(s) for s in salt]), F.lit(1 << 30)) / float(1 << 30)
    for c in AXES:
        p = p.withColumn(c, F.col(f"lo_{c}") + draw(c) * (F.col(f"hi_{c}") - F.col(f"lo_{c}")))
    side = lambda s, off: p.select(F.col(s).alias("setup"), F.lit(label).alias("label"), F.concat_ws("-", "setup_a", "setup_b", "id").alias("point"), *[(F.col(c) + off(c)).alias(c) for c in AXES])
    return side("setup_a", lambda c: F.lit(0.0)).unionByName(side("setup_b", lambda c: (draw(c, "error") * 2 - 1) * error))
