"""Matching of point sets: descriptors, nearest pairs, robust models. Relational where it can be, dense kernels per task elsewhere."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.functions import batches
from lumiframe.functions import kernels as K

MATCH = "task string, id_a long, id_b long"


def task_seed(task: str) -> int:
    """Seed of a task's random samples: the same in every run."""
    return zlib.crc32(task.encode())


def square_distance(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def manhattan_distance(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)


def linear_distance(a: str, b: str, points: int):
    """Sum of the distances of the points of two descriptors, over the number of axes; a descriptor is its points' coordinates, one after the other."""
    size = F.size(a) / points
    one = lambda i: F.sqrt(F.aggregate(F.sequence(F.lit(0), (size - 1).cast("int")), F.lit(0.0), lambda s, k: s + F.pow(F.get(a, (i * size + k).cast("int")) - F.get(b, (i * size + k).cast("int")), 2)))
    return F.aggregate(F.sequence(F.lit(0), F.lit(points - 1)), F.lit(0.0), lambda s, i: s + one(i)) / size


def prior_weight(m, prior, slack: float = 5.0):
    """Factor on a descriptor distance by how far its map's rotation is from that of a prior, both as columns of 12 numbers: 1 + 0.03 (degrees beyond the slack)^2."""
    same = sum((m[4 * r + c] * prior[4 * r + c] for r in range(3) for c in range(3)), F.lit(0.0))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (same - 1) / 2))))
    beyond = F.greatest(F.lit(slack), angle) - slack
    return 1 + 0.03 * beyond * beyond


def centre_match(a: DataFrame, b: DataFrame, how: str = "mean") -> DataFrame:
    """task, id_a, id_b and both places of the one made-up match of each task: the centres of its two lists (task, x, y, z)."""
    one = lambda d, s: centre_of_mass(d, ["task"], how).select("task", F.lit(0).cast("long").alias(f"id_{s}"), *[F.col(c).alias(f"{c}{s}") for c in "xyz"])
    return one(a, "a").join(one(b, "b"), "task")


def point_matches(links: DataFrame, points: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """a, b, px .. qz, weight, quality of correspondences (tp, setup, label, id, c_tp, ...) whose points are there: what a solution takes.

    A view is named tp * 2^32 + setup; weight is the mean weight of the two labels, 1 for those not listed (label, weight).
    """
    own = ["tp", "setup", "label", "id"]
    view = lambda p: (F.col(f"{p}tp").cast("long") * (1 << 32) + F.col(f"{p}setup"))
    out = links.join(points.select(*own, *[F.col(c).alias(f"p{c}") for c in "xyz"]), own).join(points.select(*[F.col(c).alias(f"c_{c}") for c in own], *[F.col(c).alias(f"q{c}") for c in "xyz"]), [f"c_{c}" for c in own])
    if weights is not None:
        out = out.join(weights.select("label", F.col("weight").alias("w_a")), "label", "left").join(weights.select(F.col("label").alias("c_label"), F.col("weight").alias("w_b")), "c_label", "left")
        weight = (F.coalesce("w_a", F.lit(1.0)) + F.coalesce("w_b", F.lit(1.0))) / 2
    else:
        weight = F.lit(1.0)
    return out.select(view("").alias("a"), view("c_").alias("b"), *[f"{s}{c}" for s in "pq" for c in "xyz"], weight.alias("weight"), F.lit(1.0).alias("quality"))


def best_two(candidates: DataFrame, left: str, right: str, distance: str) -> DataFrame:
    """left, right, best, second of each left row: its nearest candidate and the next one's distance (null if there is none)."""
    w = Window.partitionBy(left).orderBy(distance, right)
    two = candidates.withColumn("place", F.row_number().over(w)).where("place <= 2")
    pick = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    return two.groupBy(left).agg(pick(1, right).alias(right), pick(1, distance).alias("best"), pick(2, distance).alias("second"))


def nearest_two(a: DataFrame, b: DataFrame, block: int = 1 << 12) -> DataFrame:
    """id_a, id_b, best, second: of each row of a (id, vec) the nearest row of b in squared distance, ties by id, and the next distance.

    Every row of a is compared with every row of b, block by block: both sides are dealt to blocks of about `block` rows,
    a task compares a pair of blocks in arrays of bounded size, by a matrix product and then exactly, and two rows per row of a and block are shuffled. That
    is a stated query set against all rows; rows without an id or a vector are left out, null components count as 0.
    """
    a, b = (x.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("id is not null and vec is not null") for x in (a, b))
    blocks = [max(1, -(-x.count() // block)) for x in (a, b)]
    own = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.withColumn("block_a", own(blocks[0])).withColumn("block_b", every(blocks[1]))
    right = b.withColumn("block_b", own(blocks[1])).withColumn("block_a", every(blocks[0]))

    def work(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"id_a": [], "id_b": [], "d": []}).astype({"id_a": "int64", "id_b": "int64", "d": "float64"})
        q = q.sort_values("id")
        width = max(max(map(len, p["vec"])), max(map(len, q["vec"])))
        even = lambda v: list(v) if set(map(len, v)) == {width} else [np.pad(np.asarray(x, float), (0, width - len(x))) for x in v]
        full = lambda v: np.nan_to_num(np.array(even(v), float).reshape(len(v), width))
        x, y, ids = full(p["vec"]), full(q["vec"]), q["id"].to_numpy()
        out = []
        for rows in K.row_blocks(len(x), len(y)):
            at, d = K.two_nearest(x[rows], y)
            out.append(pd.DataFrame({"id_a": np.repeat(p["id"].to_numpy()[rows], at.shape[1]), "id_b": ids[at].ravel(), "d": d.ravel()}))
        return pd.concat(out)

    near = left.groupBy("block_a", "block_b").cogroup(right.groupBy("block_a", "block_b")).applyInPandas(work, "id_a long, id_b long, d double")
    return best_two(near, "id_a", "id_b", "d")


def ratio_filter(two: DataFrame, ratio: float, strict: bool, threshold: float | None = None) -> DataFrame:
    """Matches whose best candidate beats the second by a factor; without a second there is none."""
    best, second = F.col("best") * ratio, F.col("second")
    out = two.where((best < second) if strict else (best <= second))
    return out if threshold is None else out.where(F.col("best") < threshold)


def consistent(matches: DataFrame, a: str = "id_a", b: str = "id_b", by: list[str] | None = None) -> DataFrame:
    """Matches none of whose ends is in another match."""
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(*(by or []), c))
    return matches.withColumns({"n_a": n(a), "n_b": n(b)}).where("n_a = 1 and n_b = 1").drop("n_a", "n_b")


def remove_matches(matches: DataFrame, taken: DataFrame, key: list[str]) -> DataFrame:
    """Matches that aren't among those taken."""
    return matches.join(taken.select(*key).distinct(), key, "left_anti")


def centre_of_mass(points: DataFrame, by: list[str], how: str = "mean") -> DataFrame:
    """Mean or median of each axis of each list."""
    f = F.avg if how == "mean" else F.median
    return points.groupBy(*by).agg(*[f(c).alias(c) for c in ("x", "y", "z")], F.count(F.lit(1)).alias("n"))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a and b (task, id, x, y, z) as one table, told apart by `side`."""
    side = lambda d, n: d.select("task", F.lit(n).cast("byte").alias("side"), F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in XYZ])
    return side(a, 0).unionByName(side(b, 1))


def _sides(t, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, number of rows of side 0, and of side 1, of each task of a table of _both()."""
    start, n = cuts[:-1], np.diff(cuts)
    second = np.concatenate([[0], np.cumsum(t.column("side").to_numpy().astype(np.int64))])
    nb = second[cuts[1:]] - second[start]
    return start, n - nb, nb


XYZ = ["x", "y", "z"]


def descriptor_matches(a: DataFrame, b: DataFrame, method: str, ratio: float, neighbours: int = 3, redundancy: int = 1, threshold: float = np.inf) -> DataFrame:
    """task, id_a, id_b: points of a and b (task, id, x, y, z) whose neighbourhoods look alike.

    redundant: translation-invariant neighbourhoods with some neighbours too many, compared in all subsets, strict
    ratio. fast: one vector per subset, ratio not strict. hashing: rotation-invariant frames, ratio not strict.
    A task is one pair of views and is bounded by a view's points; small ones are stacked, many at a time.
    """
    k = neighbours + redundancy

    def one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        nx, ny = K.nearest_others(x, k), K.nearest_others(y, k)
        if method == "redundant":
            return K.matches_by_ratio(x[nx] - x[:, None], y[ny] - y[:, None], ratio, True, threshold, lambda u, v: K.redundant_distance(u, v, neighbours))
        own_a, own_b, va, vb = [], [], [], []
        for s in K.subsets(k, neighbours):
            for own, vec, pts, near in ((own_a, va, x, nx), (own_b, vb, y, ny)):
                own.append(np.arange(len(pts)))
                sub = near[:, list(s)]
                vec.append((pts[sub] - pts[:, None]).reshape(len(pts), -1) if method == "fast" else K.local_frames(pts, sub))
        own_a, own_b, va, vb = (np.concatenate(v) for v in (own_a, own_b, va, vb))
        fa, fb = np.isfinite(va).all(1), np.isfinite(vb).all(1)
        own_a, own_b, va, vb = own_a[fa], own_b[fb], va[fa], vb[fb]
        scale = 3 if method == "fast" else 1
        m = K.matches_by_ratio(va, vb, ratio, False, threshold, lambda u, v: K.square_distances(u, v) / scale)
        return np.unique(np.stack([own_a[m[:, 0]], own_b[m[:, 1]]], 1), axis=0) if len(m) else m

    def work(t, cuts: np.ndarray) -> list:
        at = np.stack([t.column(c).to_numpy() for c in XYZ], 1).astype(float)
        start, na, nb = _sides(t, cuts)
        found = [np.empty((0, 2), int)]
        use = np.flatnonzero((na > k) & (nb > k))
        small = use[np.maximum(na[use], nb[use]) <= batches.SMALL]
        width = lambda s: s * s * (k * k if method == "redundant" else len(K.subsets(k, neighbours)) ** 2)
        for size, which in batches.stacks(na[small], nb[small], width):
            g = small[which]
            (x, in_x), (y, in_y) = batches.padded(at, start[g], na[g], size), batches.padded(at, start[g] + na[g], nb[g], size)
            i, r, c = batches.descriptor_matches(x, in_x, y, in_y, method, ratio, neighbours, redundancy, threshold)
            found.append(np.stack([start[g[i]] + r, start[g[i]] + na[g[i]] + c], 1))
        for g in np.setdiff1d(use, small):
            middle = start[g] + na[g]
            m = one(at[start[g] : middle], at[middle : middle + nb[g]])
            found.append(m + [start[g], middle])
        rows = np.concatenate(found)
        ids = t.column("id").to_numpy()
        return [t.column("task").take(rows[:, 0]).combine_chunks(), ids[rows[:, 0]], ids[rows[:, 1]]]

    return map_chunks(_both(a, b), "task", ["side", "id"], work, MATCH)


PAIR = ["xa", "ya", "za", "xb", "yb", "zb"]


def map_chunks(df: DataFrame, key: str, order: list[str], work, schema: str) -> DataFrame:
    """work(table, cuts) -> list of columns, for Arrow tables of whole groups of a key, one after the other in the given order; cuts: their first rows, and the end.

    Rows are sorted once per partition, so that very many small groups cost no more than their rows.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = [key, *[c for c in df.columns if c != key]]
    out_schema = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches_):
        held: list = []

        def done(table):
            keys = table.column(0).combine_chunks()
            cuts = np.array([0, *(np.flatnonzero(np.asarray(pc.not_equal(keys[1:], keys[:-1]))) + 1).tolist(), len(keys)])
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(work(table, cuts), out_schema, strict=True)], schema=out_schema)

        for b in batches_:
            if not b.num_rows:
                continue
            last = b.column(0)[b.num_rows - 1]
            same = np.asarray(pc.equal(b.column(0), last))
            cut = len(same) - int(same[::-1].argmin() if not same.all() else len(same))
            # a batch that is of one group: the held rows are of it, or are whole groups
            if cut or (held and held[-1].column(0)[-1] != last):
                held.append(b.slice(0, cut))
                yield done(pa.Table.from_batches([h for h in held if h.num_rows]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield done(pa.Table.from_batches(held))

    rows = df.where(F.col(key).isNotNull()).select(*columns).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInArrow(run, schema)


def map_groups(df: DataFrame, key: str, order: list[str], work, schema: str) -> DataFrame:
    """work(key, table) -> list of columns, for the rows of each key as an Arrow table in the given order; a task has whole groups, one after the other.

    As applyInPandas, for very many small groups: a group costs its slice alone.
    """

    def chunk(t, cuts: np.ndarray) -> list:
        keys = t.column(0)
        made = [work(keys[int(a)].as_py(), t.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
        return [np.concatenate(m) for m in zip(*made, strict=True)]

    return map_chunks(df, key, order, chunk, schema)


def ransac_inliers(matches: DataFrame, model: str = "translation", epsilon: float = 5.0, least_ratio: float = 0.1, rounds: int = 1000, least: int = 12, multi: bool = False) -> DataFrame:
    """Inliers of matches (task, id_a, id_b, places of both), with the number of their consensus set; samples are seeded by task."""

    def work(task: str, t) -> list:
        at = np.stack([t.column(c).to_numpy() for c in PAIR], 1).astype(float)
        args = (model, epsilon, least_ratio, rounds, least, task_seed(task))
        p, q = at[:, :3], at[:, 3:]
        sets = K.multi_consensus(p, q, *args) if multi else [s for s in [K.ransac(p, q, *args)] if len(s)]
        every = np.concatenate(sets) if sets else np.array([], int)
        which = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)]) if sets else np.array([], int)
        return [np.full(len(every), task, object), t.column("id_a").to_numpy()[every], t.column("id_b").to_numpy()[every], which]

    rows = matches.select("task", F.col("id_a").cast("long"), F.col("id_b").cast("long"), *[F.col(c).cast("double").alias(c) for c in PAIR])
    return map_groups(rows, "task", ["id_a", "id_b"], work, MATCH + ", consensus long")


def icp_matches(a: DataFrame, b: DataFrame, model: str = "translation", reach: float = 5.0, rounds: int = 100, least: int = 12, robust: tuple[float, float, int] | None = None) -> DataFrame:
    """task, id_a, id_b and the map of iterated closest points, from identity; tasks without enough pairs give no row.

    robust: epsilon, least ratio and rounds of a RANSAC over the pairs of every round, its samples seeded by task.
    """

    import pyarrow as pa

    def work(t, cuts: np.ndarray) -> list:
        at = np.stack([t.column(c).to_numpy() for c in XYZ], 1).astype(float)
        start, na, nb = _sides(t, cuts)
        names, found, maps = t.column("task"), [np.empty((0, 2), int)], [np.empty((0, 12))]
        for s, n, k in zip(start, na, nb, strict=True):
            if n and k:
                m, pairs, _ = K.icp(at[s : s + n], at[s + n : s + n + k], model, reach, rounds, least, robust, task_seed(names[int(s)].as_py()) if robust else 0)
                found.append(pairs + [s, s + n])
                maps.append(np.broadcast_to(m.ravel(), (len(pairs), 12)))
        rows, ids = np.concatenate(found), t.column("id").to_numpy()
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * 12), pa.array(np.concatenate(maps).ravel()))
        return [names.take(rows[:, 0]).combine_chunks(), ids[rows[:, 0]], ids[rows[:, 1]], cells]

    return map_chunks(_both(a, b), "task", ["side", "id"], work, MATCH + ", m array<double>")


def fit_models(matches: DataFrame, model: str, other: str | None = None, share: float = 0.1) -> DataFrame:
    """task, m, error: map of least squares of each task's matches (weight optional); null where they are too few or lie badly.

    Tasks are fitted many at a time; those whose points lie badly for the model one by one.
    """
    import pyarrow as pa

    weighted = "weight" in matches.columns

    def one(p: np.ndarray, q: np.ndarray, w: np.ndarray | None) -> np.ndarray | None:
        try:
            return K.fit_interpolated(model, other, share, p, q, w) if len(p) >= K.LEAST_POINTS[model] else None
        except np.linalg.LinAlgError:
            return None

    def work(t, cuts: np.ndarray) -> list:
        at = np.stack([t.column(c).to_numpy() for c in PAIR], 1).astype(float)
        p, q, w = at[:, :3], at[:, 3:], t.column("weight").to_numpy().astype(float) if weighted else np.ones(len(at))
        start, count = cuts[:-1], np.diff(cuts)
        maps, known = batches.fits(model, p, q, w, start, count)
        if other is not None:
            stiff, also = batches.fits(other, p, q, w, start, count)
            maps, known = (1 - share) * maps + share * stiff, known & also
        for g in np.flatnonzero(~known):
            rows = slice(start[g], cuts[g + 1])
            m = one(p[rows], q[rows], w[rows] if weighted else None)
            if m is not None:
                maps[g], known[g] = m, True
        of = maps[np.repeat(np.arange(len(start)), count)]
        off = np.einsum("nij,nj->ni", of[:, :, :3], p) + of[:, :, 3] - q
        error = np.add.reduceat(np.sqrt((off * off).sum(1)), start) / count
        cells = [m.ravel().tolist() if ok else None for m, ok in zip(maps, known, strict=True)]
        return [t.column("task").take(start).combine_chunks(), pa.array(cells, pa.list_(pa.float64())), pa.array(error, mask=~known)]

    rows = matches.select("task", *[F.col(c).cast("double").alias(c) for c in [*PAIR, *(["weight"] if weighted else [])]])
    return map_chunks(rows, "task", [], work, "task string, m array<double>, error double")


def fit_translations(matches: DataFrame) -> DataFrame:
    """The translation models of fit_models() as a plain aggregate."""
    w = F.col("weight") if "weight" in matches.columns else F.lit(1.0)
    mean = lambda a, b: F.sum((F.col(b) - F.col(a)) * w) / F.sum(w)
    return matches.groupBy("task").agg(mean("xa", "xb").alias("tx"), mean("ya", "yb").alias("ty"), mean("za", "zb").alias("tz"), F.count(F.lit(1)).alias("n"))
