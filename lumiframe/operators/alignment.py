"""Global alignment over link graphs: link tables, weights, scores, and solvers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.functions import affine
from lumiframe.functions import kernels as K
from lumiframe.operators.iterate import components, materialize


def strong_links(links: DataFrame, label_weights: DataFrame) -> DataFrame:
    """Correspondences with the mean weight of their two labels, in both directions; labels without a weight count 1."""
    w = label_weights.select("label", "weight")
    out = links.join(w.toDF("label", "w_own"), "label", "left").join(w.toDF("c_label", "w_other"), "c_label", "left")
    out = out.withColumn("weight", (F.coalesce("w_own", F.lit(1.0)) + F.coalesce("w_other", F.lit(1.0))) / 2).drop("w_own", "w_other")
    own = ["tp", "setup", "label", "id"]
    back = out.select(*[F.col(f"c_{c}").alias(c) for c in own], *[F.col(c).alias(f"c_{c}") for c in own], "weight")
    return out.select(*own, *[f"c_{c}" for c in own], "weight").unionByName(back)


def balance_weights(matches: DataFrame, groups: DataFrame) -> DataFrame:
    """Weights of matches (a, b, weight) balanced within the groups of views (view, group).

    A view's share is its matches over its group's; the group's largest share over its own is its factor, 1 without a
    group; a match is weighted by the larger factor of its two views. A weight of 0 counts as 1.
    """
    ends = matches.select(F.explode(F.array("a", "b")).alias("view"))
    n = ends.groupBy("view").agg(F.count(F.lit(1)).alias("n")).join(groups, "view")
    w = Window.partitionBy("group")
    share = n.withColumn("share", F.col("n") / F.sum("n").over(w))
    factor = share.withColumn("f", F.max("share").over(w) / F.col("share")).select("view", "f")
    out = matches.join(factor.toDF("a", "f_a"), "a", "left").join(factor.toDF("b", "f_b"), "b", "left")
    base = F.when(F.col("weight") == 0, 1.0).otherwise(F.col("weight"))
    return out.withColumn("weight", base * F.greatest(F.coalesce("f_a", F.lit(1.0)), F.coalesce("f_b", F.lit(1.0)))).drop("f_a", "f_b")


def stitching_links(pairs: DataFrame, threshold: float) -> DataFrame:
    """Corner matches of pairwise shifts with r at or above a threshold: p in the box of a, q where b has it; quality is r."""
    out = pairs.where(F.col("r") >= threshold)
    for c in ("x", "y", "z"):
        out = out.withColumn(f"p{c}", F.explode(F.array(f"min_{c}", f"max_{c}"))).withColumn(f"q{c}", F.col(f"p{c}") - F.col(f"shift_{c}"))
    return out.select("a", "b", *[f"{e}{c}" for e in "pq" for c in ("x", "y", "z")], F.col("r").alias("quality"))


def weak_links(boxes: DataFrame, key: str, group: str, by: list[str] | None = None) -> DataFrame:
    """The eight corners of what two views of different groups have in common, in world coordinates; by: columns that must agree."""
    from lumiframe.operators.spatial import overlap_pairs

    axes = [("lo_x", "hi_x"), ("lo_y", "hi_y"), ("lo_z", "hi_z")]
    out = overlap_pairs(boxes, key, axes, keep=(group,), by=by, near=(group,)).where(f"{group}_a <> {group}_b")
    # a corner is a number of three bits, so no array is made for a pair
    out = out.withColumn("corner", F.explode(F.array(*map(F.lit, range(8)))))
    for i, (lo, hi) in enumerate(axes):
        out = out.withColumn(lo[-1], F.when(F.col("corner").bitwiseAND(1 << i) == 0, F.greatest(f"{lo}_a", f"{lo}_b")).otherwise(F.least(f"{hi}_a", f"{hi}_b")))
    return out.select(*(by or []), f"{key}_a", f"{key}_b", "x", "y", "z")


def link_scores(matches: DataFrame) -> DataFrame:
    """a, b, score: weighted mean of (1.01 - quality) x distance of each linked pair, quality within 0.01 to 1, and how many links its views have."""
    q = F.least(F.lit(1.0), F.greatest(F.lit(0.01), F.col("quality")))
    s = matches.groupBy("a", "b").agg((F.sum(F.col("weight") * (F.lit(1.01) - q) * F.col("distance")) / F.sum("weight")).alias("score"))
    degree = s.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    return s.join(degree.toDF("a", "d_a"), "a").join(degree.toDF("b", "d_b"), "b")


def worst_link(matches: DataFrame) -> DataFrame:
    """The pair of the largest score both of whose views have other links; ties by (a, b)."""
    return link_scores(matches).where("d_a > 1 and d_b > 1").orderBy(F.desc("score"), "a", "b").limit(1).select("a", "b", "score")


def converged(average: float, largest: float, relative: float, absolute: float) -> bool:
    """Whether errors are even enough and small enough."""
    return not ((average * relative < largest and largest > 0.75) or average > absolute)


def pair_statistics(links: DataFrame) -> DataFrame:
    """a, b, n, weight, shift of each pair of views: all that a least-squares translation needs of its matches."""
    w = F.col("weight")
    mean = lambda c: F.sum((F.col(f"p{c}") - F.col(f"q{c}")) * w) / F.sum(w)
    return links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), *[mean(c).alias(f"s{c}") for c in "xyz"], F.max("quality").alias("quality"))


def solve(statistics: DataFrame, fixed: DataFrame, relative: float | None = None, absolute: float = 3.5) -> DataFrame:
    """view, component, tx, ty, tz: translations of least squares, by component; a component's fixed views, or its first, stay.

    relative: pairs are dropped, the worst first, until converged(); the worst one has the largest weighted error, and
    both of its views keep a link. A component is a task: its pair statistics, not its matches.
    """
    found = components(statistics.select("a", "b"))
    rows = statistics.join(found.select(F.col("node").alias("a"), "component"), "a")
    fix = fixed.join(found, F.col("view") == F.col("node")).groupBy("component").agg(F.collect_set("view").alias("fixed"))
    rows = rows.join(fix, "component", "left")

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["a", "b"])
        views = sorted({*g["a"], *g["b"]})
        at = {v: i for i, v in enumerate(views)}
        edges = [(at[r.a], at[r.b], r.weight, np.array([r.sx, r.sy, r.sz]), r.quality) for r in g.itertuples()]
        hold = {at[v] for v in (g["fixed"].iloc[0] if g["fixed"].iloc[0] is not None else [])}
        while True:
            # x[b] - x[a] = shift: what stands at p in a stands at q in b
            x = K.solve_translations(len(views), [(b, a, w, s) for a, b, w, s, _ in edges], hold)
            if relative is None:
                break
            e = np.array([np.linalg.norm(x[b] - x[a] - s) for a, b, _, s, _ in edges])
            degree = np.bincount([i for a, b, *_ in edges for i in (a, b)], minlength=len(views))
            if converged(float(e.mean()), float(e.max()), relative, absolute):
                break
            score = [(1.01 - min(1.0, max(0.01, q))) * d if degree[a] > 1 and degree[b] > 1 else -1 for (a, b, _, _, q), d in zip(edges, e, strict=True)]
            k = int(np.argmax(score))
            if score[k] <= 0:
                break
            edges.pop(k)
        return pd.DataFrame({"view": views, "component": g["component"].iloc[0], "tx": x[:, 0], "ty": x[:, 1], "tz": x[:, 2]})

    return rows.groupBy("component").applyInPandas(work, "view long, component long, tx double, ty double, tz double")


def solve_two_rounds(strong: DataFrame, weak: DataFrame, views: DataFrame, fixed: DataFrame, relative: float, absolute: float) -> DataFrame:
    """view, tx, ty, tz: strong links first; their components are then moved as wholes by the weak links between them."""
    one = materialize(solve(strong, fixed, relative, absolute))
    placed = materialize(views.join(one, "view", "left").select("view", F.coalesce("component", "view").alias("component"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("tx", "ty", "tz")]))
    side = lambda s: placed.select(F.col("view").alias(s), F.col("component").alias(f"c_{s}"), *[F.col(f"t{c}").alias(f"{c}_{s}") for c in "xyz"])
    between = weak.join(side("a"), "a").join(side("b"), "b").where("c_a <> c_b")
    # what is left to move of a shift after round one
    moved = between.select(F.col("c_a").alias("a"), F.col("c_b").alias("b"), "n", "weight", *[(F.col(f"s{c}") + F.col(f"{c}_a") - F.col(f"{c}_b")).alias(f"s{c}") for c in "xyz"], "quality")
    total = moved.groupBy("a", "b").agg(F.sum("n").alias("n"), *[(F.sum(F.col(f"s{c}") * F.col("weight")) / F.sum("weight")).alias(f"s{c}") for c in "xyz"], F.sum("weight").alias("weight"), F.max("quality").alias("quality"))
    held = placed.join(fixed, "view", "left_semi").select(F.col("component").alias("view")).distinct()
    two = solve(total, held).select(F.col("view").alias("component"), *[F.col(f"t{c}").alias(f"u{c}") for c in "xyz"])
    return placed.join(two, "component", "left").select("view", *[(F.col(f"t{c}") + F.coalesce(f"u{c}", F.lit(0.0))).alias(f"t{c}") for c in "xyz"])


def tiles(views: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """view, tile: views that move as one. Groups (group_id, view) that share a view are merged; a tile is named by its smallest view.

    Views without a group are tiles of their own, and a null view or group counts for nothing.
    """
    own = views.select(F.col("view").cast("long").alias("view")).where("view is not null").distinct()
    if groups is None:
        return own.select("view", F.col("view").alias("tile"))
    m = groups.select(F.col("group_id"), F.col("view").cast("long").alias("view")).where("group_id is not null and view is not null")
    first = m.groupBy("group_id").agg(F.min("view").alias("a"))
    merged = components(m.join(first, "group_id").select("a", F.col("view").alias("b"))).select(F.col("node").alias("g_view"), "component")
    every = own.union(m.select("view")).distinct()
    return every.join(merged, F.col("view") == F.col("g_view"), "left").select("view", F.coalesce("component", "view").alias("tile"))


def pair_moments(matches: DataFrame) -> DataFrame:
    """a, b, n, pp, pq, qq, quality of each linked pair: the weighted moments of (p, 1) and (q, 1), 16 numbers each, row by row.

    matches: a, b, px .. qz, weight, quality. That is all that a solution needs of them; sums are formed before the shuffle.
    """
    w = F.col("weight").cast("double")
    side = lambda s: [*[F.col(f"{s}{c}").cast("double") for c in "xyz"], F.lit(1.0)]
    p, q = side("p"), side("q")
    table = lambda u, v: F.array(*[F.sum(w * x * y) for x in u for y in v])
    rows = matches.where("a <> b and weight > 0")
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), table(p, p).alias("pp"), table(p, q).alias("pq"), table(q, q).alias("qq"), F.max("quality").alias("quality"))


#: Pairs of components that are solved together.
LOT = 1 << 12


def solve_models(matches: DataFrame, views: DataFrame, fixed: DataFrame, model: str = "rigid", other: str | None = None, share: float = 0.1, groups: DataFrame | None = None, relative: float | None = None, absolute: float = 3.5, rounds: int = 200) -> DataFrame:
    """view, tile, component, m: maps of a kind (translation, rigid, similarity, affine) that bring matched points together, for all views.

    Views of a group move as one tile; tiles that hold a fixed view stay identity, or a component's first tile if it
    holds none. other: blends each map with that of a stiffer model. relative: links are dropped, the worst first, until
    converged(); the worst has the largest error, weighed by its quality, and both of its tiles keep a link; a link's
    error is the root of its mean square distance. Tiles without links have the identity and a component of their own.
    Matches stay where they are: they are summed to moments per pair. Components are dealt to lots of about LOT pairs, 48
    numbers each, which are solved together; a component is never cut, so a large one is a lot.
    """
    tile = materialize(tiles(views.select("view").union(matches.select("a")).union(matches.select("b")), groups))
    at = lambda s: tile.select(F.col("view").alias(s), F.col("tile").alias(f"t_{s}"))
    linked = matches.join(at("a"), "a").join(at("b"), "b").withColumns({"a": F.col("t_a"), "b": F.col("t_b")}).drop("t_a", "t_b")
    pairs = materialize(pair_moments(linked))
    found = materialize(components(pairs.select("a", "b")))
    held = fixed.select(F.col("view").cast("long").alias("view")).join(tile, "view").join(found, F.col("tile") == F.col("node")).groupBy("component").agg(F.collect_set("tile").alias("fixed"))
    rows = pairs.join(found.select(F.col("node").alias("a"), "component"), "a").join(held, "component", "left")
    lots = max(1, -(-pairs.count() // LOT))
    # work counts, not bytes: the number is given, so that small lots aren't put together again
    rows = rows.withColumn("lot", F.pmod(F.xxhash64("component"), F.lit(lots)).cast("int")).repartition(lots, "lot")

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["component", "a", "b"])
        kinds, first_row, own = np.unique(g["component"].to_numpy(), return_index=True, return_inverse=True)
        ends = pd.DataFrame({"c": np.concatenate([own, own]), "v": np.concatenate([g["a"], g["b"]])}).drop_duplicates().sort_values(["c", "v"])
        of, names = ends["c"].to_numpy(), ends["v"].to_numpy()
        # components share no tile
        by_name = np.argsort(names)
        a, b = (by_name[np.searchsorted(names, g[s].to_numpy(), sorter=by_name)] for s in "ab")
        pp, pq, qq = (np.stack(g[c].to_list()).astype(float).reshape(-1, 4, 4) for c in ("pp", "pq", "qq"))
        quality = np.clip(g["quality"].to_numpy(float), 0.01, 1.0)
        stay = np.concatenate([[True], of[1:] != of[:-1]])
        for k, hold in enumerate(g["fixed"].to_numpy()[first_row]):
            if hold is not None:
                stay[of == k] = np.isin(names[of == k], hold)
        keep, open_ = np.ones(len(a), bool), np.ones(len(kinds), bool)
        maps = np.zeros((len(names), 3, 4))
        while open_.any():
            i, e = np.flatnonzero(open_[of]), np.flatnonzero(keep & open_[own])
            at = np.unique(of[i], return_inverse=True)[1]
            links = [np.searchsorted(i, a[e]), np.searchsorted(i, b[e]), pp[e], pq[e], qq[e]]
            maps[i] = K.place_components(at, *links, model, stay[i], other, share, rounds)
            if relative is None:
                break
            off = K.link_errors(maps[i], *links)
            degree = np.bincount(np.concatenate(links[:2]), minlength=len(i))
            score = np.where((degree[links[0]] > 1) & (degree[links[1]] > 1), (1.01 - quality[e]) * off, -1)
            # each component's worst link, the first of equal ones
            worst = np.lexsort((np.arange(len(e)), -score, own[e]))
            worst = worst[np.unique(own[e][worst], return_index=True)[1]]
            n = np.bincount(own[e], minlength=len(kinds))
            mean, largest = np.bincount(own[e], off, len(kinds)) / np.maximum(n, 1), np.zeros(len(kinds))
            np.maximum.at(largest, own[e], off)
            open_ &= [not converged(float(x), float(y), relative, absolute) for x, y in zip(mean, largest, strict=True)]
            left = np.zeros(len(kinds), bool)
            left[own[e][worst]] = score[worst] > 0
            open_ &= left
            keep[e[worst[open_[own[e][worst]]]]] = False
        return pd.DataFrame({"tile": names, "component": kinds[of], "m": list(maps.reshape(-1, 12))})

    placed = rows.groupBy("lot").applyInPandas(work, "tile long, component long, m array<double>")
    placed = placed.withColumnRenamed("tile", "p_tile")
    identity = F.array(*[F.lit(float(i in (0, 5, 10))) for i in range(12)])
    out = tile.join(placed, F.col("tile") == F.col("p_tile"), "left")
    return out.select("view", "tile", F.coalesce("component", "tile").alias("component"), F.coalesce("m", identity).alias("m"))


def solve_models_two_rounds(strong: DataFrame, weak: DataFrame, views: DataFrame, fixed: DataFrame, model: str = "rigid", groups: DataFrame | None = None, relative: float | None = None, absolute: float = 3.5, second: str | None = None) -> DataFrame:
    """view, m: strong links first; then each component is one tile, and the weak links between them move them as wholes.

    Weak links are matches in the views' own coordinates, as strong ones are; they are carried along by round one, and
    their points' places in the world are what round two brings together, with a model of its own if `second` names
    one. A component with a fixed view stays. The map is round two's after round one's.
    """
    one = materialize(solve_models(strong, views, fixed, model, groups=groups, relative=relative, absolute=absolute))
    side = lambda s: one.select(F.col("view").alias(s), F.col("component").alias(f"c_{s}"), F.col("m").alias(f"m_{s}"))
    moved = weak.join(side("a"), "a").join(side("b"), "b").where("c_a <> c_b")
    p = affine.apply(F.col("m_a"), F.col("px"), F.col("py"), F.col("pz"))
    q = affine.apply(F.col("m_b"), F.col("qx"), F.col("qy"), F.col("qz"))
    world = moved.select("a", "b", *[x.alias(f"{s}{c}") for s, v in (("p", p), ("q", q)) for x, c in zip(v, "xyz", strict=True)], "weight", "quality")
    two = solve_models(world, one.select("view"), fixed, second or model, groups=one.select(F.col("component").alias("group_id"), "view"))
    two = two.select(F.col("view").alias("w_view"), F.col("m").alias("m_two"))
    return one.join(two, F.col("view") == F.col("w_view")).select("view", affine.composed(F.col("m_two"), F.col("m")).alias("m"))


def fix_views(members: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """component, view of the views that stay: the chosen ones, or each component's first."""
    if chosen is not None:
        return members.join(chosen.select("view"), "view", "left_semi").select("component", "view")
    return members.groupBy("component").agg(F.min("view").alias("view"))


def stitching_errors(pairs: DataFrame) -> DataFrame:
    """view, error, r: mean length of what is left of the shifts of a view's pairs, and their mean correlation."""
    e = pairs.withColumn("error", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    return e.select(F.explode(F.array("a", "b")).alias("view"), "error", "r").groupBy("view").agg(F.avg("error").alias("error"), F.avg("r").alias("r"))


def alignment_errors(matches: DataFrame) -> DataFrame:
    """a, b, error, n: weighted mean distance of each pair's matches in the world."""
    return matches.groupBy("a", "b").agg((F.sum(F.col("weight") * F.col("distance")) / F.sum("weight")).alias("error"), F.count(F.lit(1)).alias("n"))


def timepoint_statistics(results: DataFrame) -> DataFrame:
    """tp, least, mean, most, ratio, valid, invalid over the pairs (tp_a, tp_b, error, ratio) that have a side in a timepoint."""
    both = results.select("*", F.explode(F.array_distinct(F.array("tp_a", "tp_b"))).alias("tp"))
    ok = F.col("error").isNotNull() & (F.col("ratio") > 0)
    at = lambda f, c: f(F.when(ok, F.col(c)))
    return both.groupBy("tp").agg(at(F.min, "error").alias("least"), at(F.avg, "error").alias("mean"), at(F.max, "error").alias("most"), at(F.min, "ratio").alias("ratio"), F.count_if(ok).alias("valid"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid"))


def reference_timepoint(statistics: DataFrame) -> DataFrame:
    """The timepoint with the smallest sum of ranks by largest error and by 10 less the least ratio; ties by timepoint."""
    rank = lambda c: F.rank().over(Window.orderBy(c))
    s = statistics.withColumn("ranks", rank(F.col("most")) + rank(10 - F.col("ratio")))
    return s.agg(F.min_by("tp", F.struct("ranks", "tp")).alias("tp"), F.min("ranks").alias("ranks"))
