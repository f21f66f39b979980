"""Intensity correction: pairs of voxels, line fits, coefficient fields, and their joint solution."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.functions import kernels as K


def voxel_pairs(voxels: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """setup_a, setup_b, x, p, q: values of each two views at the same place, both within the finite bounds given."""
    v = voxels
    if low is not None:
        v = v.where(F.col("v") >= low)
    if high is not None:
        v = v.where(F.col("v") <= high)
    a, b = v.toDF("setup_a", "x", "p"), v.toDF("setup_b", "x", "q")
    return a.join(b, "x").where("setup_a < setup_b")


def candidates(pairs: DataFrame, cell: int, more_than: int) -> DataFrame:
    """Pairs by the coefficient cells that they lie in; cells with no more than a number of pairs have none, but stay listed."""
    at = pairs.withColumn("cell", F.floor(F.col("x") / cell).cast("int"))
    n = F.count(F.lit(1)).over(Window.partitionBy("setup_a", "setup_b", "cell"))
    return at.withColumn("n", n).withColumn("used", F.col("n") > more_than)


def cell_pairs(cells: DataFrame) -> DataFrame:
    """Pairs of cells of different views whose bounds meet: setup, cell, lo, hi."""
    from lumiframe.operators.spatial import overlap_pairs

    return overlap_pairs(cells, "setup", [("lo", "hi")], keep=("cell",), near=("cell",))


def thin(pairs: DataFrame, most: int, by: list[str], seed: int = 344) -> DataFrame:
    """At most so many pairs of each group: those with the smallest hash, cut in each task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(*by, "x", F.lit(seed)), "x")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def line_fit(pairs: DataFrame, by: list[str], p: str = "p", q: str = "q", weight: Column | None = None) -> DataFrame:
    """slope and intercept of least squares of each group by exact sums, null where p doesn't vary; a plain aggregate."""
    w = F.lit(1.0) if weight is None else weight
    x, y = F.col(p), F.col(q)
    s = pairs.groupBy(*by).agg(F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.count(F.lit(1)).alias("n"))
    d = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(F.abs(d) > 1e-12 * F.greatest(F.lit(1.0), F.col("s") * F.col("sxx")), (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / d)
    return s.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("s")).select(*by, "slope", "intercept", "n")


def histogram_match(pairs: DataFrame, by: list[str], quantiles: int = 100) -> DataFrame:
    """Two matches of each group: the ends of a line through quantiles of p and of q, each sorted by itself.

    Ranks are windows, so that no group's values are gathered into one array.
    """
    w = lambda c: Window.partitionBy(*by).orderBy(c)
    n = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rank = lambda c: pairs.select(*by, c, (F.row_number().over(w(c)) - 1).alias("r"))
    at = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(quantiles - 1)))).withColumn("r", F.floor(F.col("n") * F.col("i") / quantiles).cast("int"))
    got = at.join(rank("p"), [*by, "r"]).join(rank("q"), [*by, "r"])
    ends = got.groupBy(*by).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    line = line_fit(got, by).join(ends, by)
    return line.select(*by, "slope", "intercept", "lo", (F.col("slope") * F.col("lo") + F.col("intercept")).alias("at_lo"), "hi", (F.col("slope") * F.col("hi") + F.col("intercept")).alias("at_hi"))


def ransac_match(pairs: DataFrame, by: list[str], epsilon: float, least_ratio: float = 0.1, rounds: int = 1000, least: int = 10, trust: float = 3.0) -> DataFrame:
    """Two matches of each group: the ends of the line through its inliers. Samples are seeded by group. A group is one task: thin() cuts what is too large."""
    kinds = ", ".join(f"`{c}` {dict(pairs.dtypes)[c]}" for c in by)

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["p", "q"])
        p, q = g["p"].to_numpy(float), g["q"].to_numpy(float)
        key = {c: g[c].iloc[0] for c in by}
        ok = K.ransac_line(p, q, epsilon, least_ratio, rounds, least, trust, zlib.crc32(repr(sorted((k, str(v)) for k, v in key.items())).encode()))
        line = K.fit_line(p[ok], q[ok]) if len(ok) else None
        if line is None:
            return pd.DataFrame({**{c: [] for c in by}, "slope": [], "intercept": [], "lo": [], "hi": [], "n": []})
        return pd.DataFrame({**{c: [v] for c, v in key.items()}, "slope": [line[0]], "intercept": [line[1]], "lo": [p[ok].min()], "hi": [p[ok].max()], "n": [len(ok)]})

    return pairs.select(*by, "p", "q").groupBy(*by).applyInPandas(work, f"{kinds}, slope double, intercept double, lo double, hi double, n long")


def solve_fields(matches: DataFrame, rigidity: float = 0.01) -> DataFrame:
    """node, a, b: value maps a v + b of all nodes (views or cells) that bring matched values together, by least squares.

    matches: node_a, node_b, p, q, weight; the nodes of a field that touch are matched with equal values by the caller.
    A component's first node stays identity; every other is held to it with `rigidity` times the weight of its own
    matches. One task solves a component by conjugate gradients over its pair sums, six numbers each.
    """
    from lumiframe.operators.iterate import components, materialize

    w = F.col("weight")
    sums = matches.groupBy("node_a", "node_b").agg(F.sum(w).alias("w"), F.sum(w * F.col("p")).alias("p"), F.sum(w * F.col("q")).alias("q"), F.sum(w * F.col("p") * F.col("p")).alias("pp"), F.sum(w * F.col("q") * F.col("q")).alias("qq"), F.sum(w * F.col("p") * F.col("q")).alias("pq"))
    sums = materialize(sums)
    found = components(sums.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    rows = sums.join(found.select(F.col("node").alias("node_a"), "component"), "node_a")

    def work(g: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([g["node_a"], g["node_b"]]))
        i, j = np.searchsorted(nodes, g["node_a"].to_numpy()), np.searchsorted(nodes, g["node_b"].to_numpy())
        maps = K.least_lines(len(nodes), i, j, *[g[c].to_numpy(float) for c in ("w", "p", "q", "pp", "qq", "pq")], rigidity)
        return pd.DataFrame({"node": nodes, "a": maps[:, 0], "b": maps[:, 1]})

    return rows.groupBy("component").applyInPandas(work, "node long, a double, b double")


def field_links(matches: DataFrame, cells: tuple[int, int, int], weight: float = 1.0) -> DataFrame:
    """Links (a, b, p, q, weight) of a joint solution: the matches, what stands in for missing ones, and neighbours within each field.

    matches: setup_a, cell_a, setup_b, cell_b, p, q, weight; a pair of cells that meets without a match has one row with
    null p. Where no pair of cells of two views has a match, theirs are held to equal values with weight 1e-6, so that
    nothing is loose; where some have, those without give no link. Cells that touch in a view's grid are held to equal
    values (0 and 1) with `weight`. A node is setup * cells + cell.
    """
    n = cells[0] * cells[1] * cells[2]
    node = lambda s, c: (F.col(s).cast("long") * n + F.col(c)).alias
    loose = ~F.max(F.col("p").isNotNull()).over(Window.partitionBy("setup_a", "setup_b"))
    rows = matches.withColumn("loose", loose).select(node("setup_a", "cell_a")("a"), node("setup_b", "cell_b")("b"), "p", "q", "weight", "loose")
    found = rows.where("p is not null").select("a", "b", F.col("p").cast("double"), F.col("q").cast("double"), F.col("weight").cast("double"))
    same = F.explode(F.array(F.lit(0.0), F.lit(1.0)))
    held = rows.where("loose").select("a", "b").distinct().withColumn("p", same).select("a", "b", "p", F.col("p").alias("q"), F.lit(1e-6).alias("weight"))
    setups = matches.select(F.explode(F.array("setup_a", "setup_b")).alias("setup")).distinct()
    cell = setups.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    steps = F.array(*[F.when(at % size < size - 1, F.lit(step)) for at, size, step in ((F.col("cell"), cells[0], 1), (F.floor(F.col("cell") / cells[0]), cells[1], cells[0]), (F.floor(F.col("cell") / (cells[0] * cells[1])), cells[2], cells[0] * cells[1]))])
    beside = cell.withColumn("step", F.explode(steps)).where("step is not null")
    beside = beside.select(node("setup", "cell")("a"), (F.col("setup").cast("long") * n + F.col("cell") + F.col("step")).alias("b")).withColumn("p", same).select("a", "b", "p", F.col("p").alias("q"), F.lit(float(weight)).alias("weight"))
    return found.unionByName(held).unionByName(beside)


def solve_field_maps(links: DataFrame, shift: float = 0.01, stay: float = 0.01, rounds: int = 2000, damping: float = 0.75, tolerance: float = 1e-9) -> DataFrame:
    """node, a, b: value maps of all nodes that bring linked values together, each a blend of its best line with its best shift and with identity.

    Every round fits each node to where its partners' maps now take their values, blends (by `shift` with the best shift,
    then by `stay` with identity) and goes `damping` of the way; a component's first node stays identity. Links are summed
    to moments per pair, and a component's pairs, seven numbers each, are one task.
    """
    from lumiframe.operators.iterate import components, materialize

    w = F.col("weight")
    sums = links.groupBy("a", "b").agg(F.sum(w).alias("w"), *[F.sum(w * x).alias(n) for n, x in (("p", F.col("p")), ("q", F.col("q")), ("pp", F.col("p") * F.col("p")), ("qq", F.col("q") * F.col("q")), ("pq", F.col("p") * F.col("q")))])
    sums = materialize(sums)
    found = components(sums.select("a", "b"))
    rows = sums.join(found.select(F.col("node").alias("a"), "component"), "a")

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["a", "b"])
        nodes = np.unique(np.concatenate([g["a"], g["b"]]))
        i, j = np.searchsorted(nodes, g["a"].to_numpy()), np.searchsorted(nodes, g["b"].to_numpy())
        maps = K.place_lines(len(nodes), i, j, *[g[c].to_numpy(float) for c in ("w", "p", "q", "pp", "qq", "pq")], shift, stay, rounds, damping, tolerance)
        return pd.DataFrame({"node": nodes, "a": maps[:, 0], "b": maps[:, 1]})

    return rows.groupBy("component").applyInPandas(work, "node long, a double, b double")


class IntensityCorrection:
    """Intensity correction of views from matching to applying: bounds, matches, solution, and coefficients in files."""

    def __init__(self, cells: tuple[int, int, int] = (8, 8, 8), shift: float = 0.01, stay: float = 0.01):
        self.cells, self.shift, self.stay = cells, shift, stay

    def bounds(self, voxels: DataFrame, by: list[str]) -> DataFrame:
        """Least and largest value of each image."""
        return voxels.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))

    def bleachers(self, views: DataFrame) -> DataFrame:
        """For each view (ord, lo, hi) the earlier ones that its light may have bleached."""
        from lumiframe.operators.relations import earlier_bleachers

        return earlier_bleachers(views)

    def match_ransac(self, pairs: DataFrame, epsilon: float = 0.1 * 255, most: int = 1000, **how) -> DataFrame:
        """Matches of pairs of cells (setup_a, cell_a, setup_b, cell_b, x, p, q): the ends of a robust line, over at most so many pairs each."""
        by = ["setup_a", "cell_a", "setup_b", "cell_b"]
        return self._ends(pairs, ransac_match(thin(pairs, most, by), by, epsilon, **how), by)

    def match_histograms(self, pairs: DataFrame) -> DataFrame:
        """Matches by quantiles, of the same pairs."""
        by = ["setup_a", "cell_a", "setup_b", "cell_b"]
        return self._ends(pairs, histogram_match(pairs, by), by)

    def _ends(self, pairs: DataFrame, lines: DataFrame, by: list[str]) -> DataFrame:
        at = lambda c: F.col("slope") * F.col(c) + F.col("intercept")
        two = lines.where("slope is not null").select(*by, F.inline(F.array(*[F.struct(F.col(c).alias("p"), at(c).alias("q")) for c in ("lo", "hi")])))
        return pairs.select(*by).distinct().join(two, by, "left").withColumn("weight", F.lit(1.0))

    def solve(self, matches: DataFrame) -> DataFrame:
        """setup, cell, a, b of all cells of all matched views."""
        n = self.cells[0] * self.cells[1] * self.cells[2]
        maps = solve_field_maps(field_links(matches, self.cells), self.shift, self.stay)
        return maps.select(F.floor(F.col("node") / n).cast("int").alias("setup"), F.pmod("node", F.lit(n)).cast("int").alias("cell"), "a", "b")

    def write(self, field: DataFrame, path: str, tp: int = 0) -> int:
        from lumiframe.sources.project import write_fields

        return write_fields(field.withColumn("tp", F.lit(tp)), path, self.cells)

    def read(self, spark, path: str, views: DataFrame) -> DataFrame:
        from lumiframe.sources.project import read_fields

        return read_fields(views, path)

    def apply(self, voxels: DataFrame, field: DataFrame, sizes: DataFrame, low: float, high: float) -> DataFrame:
        return apply_field_volume(voxels, field, sizes, self.cells, low, high)


def apply_field_volume(voxels: DataFrame, field: DataFrame, sizes: DataFrame, cells: tuple[int, int, int], low: float, high: float) -> DataFrame:
    """Voxels (setup, x, y, z, v) under a field of maps (setup, cell, a, b) of their view, interpolated between cell centres on all axes, and clamped.

    sizes: setup, sx, sy, sz. Cells number x fastest; beyond the outer centres the nearest ones go on. A voxel joins its
    eight cells by equality; views without a field, or without a size, are left out.
    """
    from itertools import product

    at = voxels.join(sizes.select("setup", "sx", "sy", "sz"), "setup")
    place = {c: (F.col(c) + 0.5) * n / F.col(f"s{c}") - 0.5 for c, n in zip("xyz", cells, strict=True)}
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("int")
    corners = []
    for up in product((0, 1), repeat=3):
        i = [clip(F.floor(place[c]) + u, n) for c, n, u in zip("xyz", cells, up, strict=True)]
        w = [(place[c] - F.floor(place[c])) if u else (1 - place[c] + F.floor(place[c])) for c, u in zip("xyz", up, strict=True)]
        corners.append(F.struct((i[0] + cells[0] * (i[1] + cells[1] * i[2])).alias("cell"), (w[0] * w[1] * w[2]).alias("w")))
    met = at.select("setup", "x", "y", "z", "v", F.inline(F.array(*corners))).join(field.select("setup", "cell", "a", "b"), ["setup", "cell"])
    out = met.groupBy("setup", "x", "y", "z", "v").agg(F.sum(F.col("w") * F.col("a")).alias("a"), F.sum(F.col("w") * F.col("b")).alias("b"))
    return out.select("setup", "x", "y", "z", F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), F.col("v") * F.col("a") + F.col("b"))).alias("v"))


def subtract_least(maps: DataFrame) -> DataFrame:
    """Value maps with the smallest offset taken off all, so that none is negative."""
    least = maps.agg(F.min("b").alias("least"))
    return maps.crossJoin(F.broadcast(least)).withColumn("b", F.col("b") - F.col("least")).drop("least")  # one row


def apply_maps(voxels: DataFrame, maps: DataFrame, by: list[str]) -> DataFrame:
    """Values under their view's map; views without one stay as they are."""
    out = voxels.join(maps, by, "left")
    return out.withColumn("v", F.coalesce(F.col("a") * F.col("v") + F.col("b"), F.col("v"))).drop("a", "b")


def apply_field(voxels: DataFrame, field: DataFrame, size: int, cells: int, low: float, high: float) -> DataFrame:
    """Values under a field of maps (setup, cell, a, b), interpolated between cell centres and repeated at the edges, and clamped.

    A voxel joins its two cells by equality.
    """
    at = (F.col("x") - size / (2 * cells)) * cells / size
    lo = F.floor(at)
    clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(cells - 1), c)).cast("int")
    f = at - lo
    corners = voxels.withColumn("corner", F.explode(F.array(F.struct(clip(lo).alias("cell"), (1 - f).alias("w")), F.struct(clip(lo + 1).alias("cell"), f.alias("w"))))).select("setup", "x", "v", "corner.cell", "corner.w")
    out = corners.join(field, ["setup", "cell"]).groupBy("setup", "x", "v").agg(F.sum(F.col("w") * F.col("a")).alias("a"), F.sum(F.col("w") * F.col("b")).alias("b"))
    return out.select("setup", "x", F.least(F.lit(high), F.greatest(F.lit(low), F.col("v") * F.col("a") + F.col("b"))).alias("v"))


def unbleach(voxels: DataFrame, exposures: DataFrame, factor: float) -> DataFrame:
    """Values raised by what earlier exposures (setup, n) took: v / factor^n."""
    return voxels.join(exposures, "setup", "left").withColumn("v", F.col("v") / F.pow(F.lit(factor), F.coalesce("n", F.lit(0)))).drop("n")
