"""Operators in three axes against plain loops: fusion by blocks, placements, fields, boxes, export."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiframe.functions import affine
from lumiframe.functions import kernels as K
from lumiframe.operators import alignment, boxes, fusion, intensity, restoration, spatial, transforms, volume
from lumiframe.sources import export

rng = np.random.default_rng(7)
DIMS = (9, 6, 4)
MAPS = [np.hstack([np.eye(3), [[0], [0], [0]]]), np.array([[0.8, -0.6, 0, 5.3], [0.6, 0.8, 0, -1.2], [0, 0, 1, 0.5]]), np.array([[1.1, 0.2, 0, 2.0], [0, 0.9, 0, 1.0], [0.1, 0, 1.0, 0.25]])]
IMAGES = [rng.uniform(1, 100, DIMS[::-1]).astype(np.float32) for _ in MAPS]


def tables(spark, size):
    rows, views = [], []
    for s, (image, m) in enumerate(zip(IMAGES, MAPS, strict=True)):
        views.append((0, s, m.ravel().tolist(), *DIMS))
        rows += [(0, s, x, y, z, float(image[z, y, x])) for z, y, x in product(*map(range, image.shape))]
    v = spark.createDataFrame(rows, "tp int, setup int, x int, y int, z int, v double")
    blocks = volume.to_blocks(v, ["tp", "setup"], size)
    return blocks.withColumn("weight", F.transform("data", lambda x: x / 50)), spark.createDataFrame(views, "tp int, setup int, m array<double>, sx int, sy int, sz int")


def plain(mode, at, border, ramp, linear=True):
    """One output voxel, view by view."""
    found = []
    for s, (image, m) in enumerate(zip(IMAGES, MAPS, strict=True)):
        p = np.linalg.solve(m[:, :3], np.array(at) - m[:, 3])
        if any(v < -1e-9 or v > n - 1 + 1e-9 for v, n in zip(p, DIMS, strict=True)):
            continue
        p = [min(max(v, 0.0), n - 1.0) for v, n in zip(p, DIMS, strict=True)]
        base = [min(int(math.floor(v)), n - 2) for v, n in zip(p, DIMS, strict=True)]
        value = weight = 0.0
        for up in product((0, 1), repeat=3):
            w = math.prod(v - b if u else 1 - v + b for v, b, u in zip(p, base, up, strict=True))
            x, y, z = (b + u for b, u in zip(base, up, strict=True))
            value += w * float(image[z, y, x])
            weight += w * float(image[z, y, x]) / 50
        if not linear:
            x, y, z = (min(int(math.floor(v + 0.5)), n - 1) for v, n in zip(p, DIMS, strict=True))
            value = float(image[z, y, x])
        mask = all(border - 1e-9 <= v <= n - 1 - border + 1e-9 for v, n in zip(p, DIMS, strict=True))
        blend = math.prod(float(K.blend_weight(np.array([v]), n, border, ramp)[0]) for v, n in zip(p, DIMS, strict=True))
        w = (blend if mode in ("blend", "blend and content", "closest") else float(mask)) * (weight if "content" in mode else 1)
        if w > 0:
            found.append((s, value, w))
    if not found:
        return 0.0
    v = [f[1] for f in found]
    if mode in ("average", "blend", "content", "blend and content"):
        return sum(a * w for _, a, w in found) / sum(w for *_, w in found)
    return {"maximum": max(v), "minimum": min(v), "sum": sum(v), "lowest view": v[0], "highest view": v[-1], "closest": max(found, key=lambda f: (f[2], -f[0]))[1]}[mode]


@pytest.mark.parametrize("mode", volume.MODES)
def test_fusion_by_blocks(spark, mode):
    images, views = tables(spark, (4, 4, 3))
    got = []
    for size in ((5, 4, 3), (16, 16, 8)):
        n = [-(-16 // size[0]), -(-12 // size[1]), -(-6 // size[2])]
        grid = spark.createDataFrame([(x, y, z) for x in range(-1, n[0]) for y in range(-1, n[1]) for z in range(-1, n[2])], "bx int, `by` int, bz int")
        out = volume.fuse_blocks(images, views, grid, mode, size, (4, 4, 3), (0.45,) * 3, (2.5,) * 3)
        got.append({(r["x"], r["y"], r["z"]): r["v"] for r in volume.from_blocks(out, [], size).collect()})
    inside = list(product(range(16), range(12), range(6)))
    for at in inside:
        want = plain(mode, at, 0.45, 2.5)
        assert all(math.isclose(g.get(at, 0.0), want, rel_tol=1e-6, abs_tol=1e-6) for g in got), (mode, at)


def test_nearest_sampling_and_conversion(spark):
    images, views = tables(spark, (32, 32, 32))
    grid = spark.createDataFrame([(0, 0, 0)], "bx int, `by` int, bz int")
    out = volume.from_blocks(volume.fuse_blocks(images, views, grid, "maximum", (8, 8, 4), (32, 32, 32), linear=False, convert=(0.0, 100.0, 8)), [], (8, 8, 4)).collect()
    assert len(out) == 256
    for r in out:
        want = plain("maximum", (r["x"], r["y"], r["z"]), 0, 40, False)
        assert r["v"] == min(255, max(0, math.floor(want / 100 * 255 + 0.5)))
    with pytest.raises(ValueError, match="no such mode"):
        volume.fuse_blocks(images, views, grid, "median")
    assert volume.fuse_blocks(images.limit(0), views, grid).count() == 0


def test_ramps_agree(spark):
    at = [i / 7 for i in range(-3, 100)]
    df = spark.createDataFrame([(x,) for x in at], "x double")
    for size, border, width in ((12, 1.0, 3.0), (12, 0.0, 40.0), (13, 2.0, 5.0)):
        one = [r[0] for r in df.select(fusion.blend_weight(F.col("x"), F.lit(float(size)), border, width)).collect()]
        inside = [i for i, x in enumerate(at) if 0 <= x <= size - 1]
        assert np.allclose(np.array(one)[inside], K.blend_weight(np.array(at)[inside], size, border, width))


def test_levels_of_a_volume(spark):
    image = rng.uniform(0, 9, (5, 7, 11))
    rows = [(x, y, z, float(image[z, y, x])) for z, y, x in product(*map(range, image.shape))]
    b = volume.to_blocks(spark.createDataFrame(rows, "x int, y int, z int, v double").withColumn("k", F.lit(1)), ["k"], (4, 4, 2))
    out = volume.from_blocks(export.next_level(b, (4, 4, 2), [11, 7, 5], [2, 3, 2], ["k"]), ["k"], (4, 4, 2)).collect()
    got = {(r["x"], r["y"], r["z"]): r["v"] for r in out}
    for z, y, x in product(range(2), range(2), range(5)):
        assert math.isclose(got[x, y, z], image[2 * z : 2 * z + 2, 3 * y : 3 * y + 3, 2 * x : 2 * x + 2].mean(), rel_tol=1e-6)
    assert all(v == 0 for (x, y, z), v in got.items() if x >= 5 or y >= 2 or z >= 2)


def test_no_choice_that_overlaps_gives_no_box(spark):
    """Each axis by itself has an overlap; no choice of one view a group has one on all."""
    b = [("A", 0, 10, 0, 10), ("A", 20, 30, 20, 30), ("B", 0, 10, 20, 30), ("B", 20, 30, 0, 10)]
    cols = "g string, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double"
    df = spark.createDataFrame([(g, *map(float, (a, c, d, e)), 0.0, 9.0) for g, a, c, d, e in b], cols)
    assert boxes.group_overlap_box(df, "g").count() == 0 and boxes.group_overlap_box(df.limit(0), "g").count() == 0
    r = random.Random(3)
    for _ in range(6):
        rows = [(g, *[float(v) for _ in range(3) for v in (lambda a: (a, a + r.randint(0, 12)))(r.randint(0, 20))]) for g in "ABC" for _ in range(4)]
        got = [tuple(x) for x in boxes.group_overlap_box(spark.createDataFrame(rows, cols), "g").collect()]
        common = []
        for choice in product(*[[x for x in rows if x[0] == g] for g in "ABC"]):
            ends = [(max(c[1 + 2 * k] for c in choice), min(c[2 + 2 * k] for c in choice)) for k in range(3)]
            if all(a <= z for a, z in ends):
                common.append(ends)
        want = [(*[int(min(c[k][0] for c in common)) for k in range(3)], *[int(max(c[k][1] for c in common)) for k in range(3)])] if common else []
        assert got == want


def test_long_intervals_meet_as_all_do(spark):
    r = random.Random(5)
    rows = [(i, r.choice("ab"), *(lambda a, n: (a, a + n))(r.uniform(0, 900), r.choice([0.0, 1.0, 5.0, 700.0]))) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, g string, lo double, hi double")
    for by in (None, ["g"]):
        got = sorted((x["k_a"], x["k_b"]) for x in spatial.overlap_pairs(df, "k", [("lo", "hi")], by=by).collect())
        assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] <= b[3] and b[2] <= a[3] and (by is None or a[1] == b[1]))


def test_nearest_of_dense_and_repeated_places(spark):
    r = random.Random(8)
    rows = [(0, i, 1.0, 1.0) for i in range(40)] + [(0, 100 + i, r.gauss(50, 0.1), r.gauss(50, 0.1)) for i in range(300)] + [(0, 900, 1e6, -1e6), (1, 0, 3.0, 3.0), (1, 1, None, 3.0)]
    df = spark.createDataFrame(rows, "g int, i int, x double, y double")
    got = {(x["g"], x["i"]): x["d"] for x in spatial.nearest_distance(df, df, ["x", "y"], ["g", "i"], ["g"], True).collect()}
    for g, i, x, y in rows:
        others = [math.dist((x, y), (p, q)) for h, j, p, q in rows if h == g and j != i and p is not None] if x is not None else []
        assert ((g, i) in got) == bool(others) and (not others or math.isclose(got[g, i], min(others), abs_tol=1e-9))
    assert spatial.nearest_distance(df.limit(0), df, ["x", "y"], ["g", "i"], ["g"], True).count() == 0


def test_farthest_pairs_on_a_sphere(spark):
    p = rng.normal(size=(900, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    df = spark.createDataFrame([(g, i, *map(float, x)) for g in (0, 1) for i, x in enumerate(p[: 900 if g else 40])], "g int, id int, x double, y double, z double")
    got = {r["g"]: r for r in boxes.farthest_pairs(df, ["g"], most=30).collect()}
    for g, n in ((0, 40), (1, 900)):
        d = ((p[:n, None] - p[None, :n]) ** 2).sum(2)
        assert math.isclose(got[g]["d2"], d.max()) and math.isclose(d[got[g]["id_a"], got[g]["id_b"]], d.max())


def test_placements_come_back(spark):
    turn = lambda v: K._turned(np.array([v]))[0]
    for model in ("translation", "rigid", "similarity", "affine"):
        n = 40
        true = np.zeros((n, 3, 4))
        for i in range(n):
            a = np.eye(3) if model == "translation" else turn(rng.normal(size=3) * 0.5)
            a = a * rng.uniform(0.7, 1.4) if model == "similarity" else np.eye(3) + rng.normal(size=(3, 3)) * 0.1 if model == "affine" else a
            true[i] = np.hstack([a, rng.normal(size=(3, 1)) * 50])
        true[0] = np.eye(3, 4)
        rows = []
        for i, j in [(i, i + k) for k in (1, 7) for i in range(n - k)]:
            for w in rng.uniform(-100, 100, (10, 3)):
                p, q = (np.linalg.solve(true[e][:, :3], w - true[e][:, 3]) for e in (i, j))
                rows.append((i, j, *map(float, p), *map(float, q), 1.0, 0.9))
        m = spark.createDataFrame(rows, "a long, b long, px double, py double, pz double, qx double, qy double, qz double, weight double, quality double")
        views = spark.createDataFrame([(i,) for i in range(n + 2)], "view long")
        out = {r["view"]: np.array(r["m"]).reshape(3, 4) for r in alignment.solve_models(m, views, views.where("view = 0"), model).collect()}
        assert all(np.abs(out[i] - true[i]).max() < 1e-4 for i in range(n)) and np.array_equal(out[n + 1], np.eye(3, 4))
    assert alignment.solve_models(m.limit(0), views, views, "rigid").count() == n + 2


def test_blended_models_settle_where_every_image_is_at_its_blend():
    n, links = 6, [(i, (i + k) % 6) for k in (1, 2) for i in range(6)]
    pp, pq, qq = [], [], []
    for _ in links:
        p = np.c_[rng.uniform(-10, 10, (8, 3)), np.ones(8)]
        q = p + np.c_[rng.normal(0, 0.3, (8, 3)), np.zeros(8)]
        pp.append(p.T @ p), pq.append(p.T @ q), qq.append(q.T @ q)
    a, b = np.array(links).T
    pp, pq, qq = map(np.array, (pp, pq, qq))
    fixed = np.arange(n) == 0
    maps = K.place_images(n, a, b, pp, pq, qq, "affine", fixed, "rigid", 0.1, rounds=500)
    for i in range(1, n):
        cross, own = np.zeros((3, 4)), np.zeros((4, 4))
        for e, (x, y) in enumerate(links):
            if x == i:
                cross, own = cross + maps[y] @ pq[e].T, own + pp[e]
            if y == i:
                cross, own = cross + maps[x] @ pq[e], own + qq[e]
        want = 0.9 * K.fit_moments("affine", cross[None], own[None])[0] + 0.1 * K.fit_moments("rigid", cross[None], own[None])[0]
        assert np.abs(maps[i] - want).max() < 1e-6


def test_lines_settle_as_by_plain_rounds():
    links = [(0, 1), (1, 2), (0, 2), (2, 3)]
    p, q = rng.uniform(5, 250, (4, 30)), rng.uniform(5, 250, (4, 30))
    q = 0.3 * q + 0.8 * p
    w = rng.uniform(0.5, 2, (4, 30))
    a, b = np.array(links).T
    sums = [(w * x).sum(1) for x in (1, p, q, p * p, q * q, p * q)]
    got = K.place_lines(4, a, b, *sums, 0.01, 0.02, 3000, 0.75, 1e-12)
    maps = np.tile([1.0, 0.0], (4, 1))
    for _ in range(3000):
        new = maps.copy()
        for i in range(1, 4):
            v = np.concatenate([p[e] if x == i else q[e] for e, (x, y) in enumerate(links) if i in (x, y)])
            t = np.concatenate([maps[y, 0] * q[e] + maps[y, 1] if x == i else maps[x, 0] * p[e] + maps[x, 1] for e, (x, y) in enumerate(links) if i in (x, y)])
            k = np.concatenate([w[e] for e, l in enumerate(links) if i in l])
            mv, mt = np.average(v, weights=k), np.average(t, weights=k)
            s = (k * (v - mv) * (t - mt)).sum() / (k * (v - mv) ** 2).sum()
            line, shift = np.array([s, mt - s * mv]), np.array([1.0, mt - mv])
            best = 0.98 * (0.99 * line + 0.01 * shift) + 0.02 * np.array([1.0, 0.0])
            new[i] = maps[i] + 0.75 * (best - maps[i])
        maps = new
    assert np.allclose(got, maps, atol=1e-8)


def test_intensity_correction_brings_views_together(spark):
    rows = [(s, x, (40 + x + 10 * math.sin(x / 9)) * (1 + 0.2 * s) + 5 * s) for s in range(3) for x in range(128)]
    v = spark.createDataFrame(rows, "setup int, x int, v double")
    c = intensity.IntensityCorrection((2, 1, 1), shift=0.001, stay=0.001)
    pairs = intensity.voxel_pairs(v).withColumn("cell_a", F.floor(F.col("x") / 64).cast("int")).withColumn("cell_b", F.col("cell_a"))
    for matches in (c.match_ransac(pairs, 1.0), c.match_histograms(pairs)):
        f = c.solve(matches)
        sizes = spark.createDataFrame([(s, 128, 1, 1) for s in range(3)], "setup int, sx int, sy int, sz int")
        out = c.apply(v.withColumns({"y": F.lit(0), "z": F.lit(0)}), f, sizes, 0.0, 1000.0).collect()
        spread = lambda t: np.mean([np.ptp([a for *_, x, a in t if x == k]) for k in range(128)])
        after = spread([(r["setup"], r["x"], r["v"]) for r in out])
        assert after < 0.25 * spread(rows)


@pytest.mark.parametrize("effective", [37, 4096])
def test_deconvolution_of_blocks_is_that_of_the_whole(spark, effective):
    images = [rng.uniform(0, 50, 150) for _ in range(3)]
    weights = [rng.uniform(0, 0.6, 150) for _ in range(3)]
    psfs = [[0.2, 0.5, 0.3], [0.1, 0.2, 0.4, 0.2, 0.1], [0.25, 0.5, 0.25]]
    rows = [(k, x, v, float(images[v][x] * (1 + k)), float(weights[v][x])) for k in range(2) for x in range(150) for v in range(3)]
    df = spark.createDataFrame(rows, "k int, x int, view int, v double, w double")
    got = {(r["k"], r["x"]): r["psi"] for r in restoration.deconvolve_lines(df, ["k"], "x", psfs, 4, "independent", effective=effective).collect()}
    for k in range(2):
        want = K.deconvolve([i * (1 + k) for i in images], weights, [np.array(p) for p in psfs], 4, "independent", damping=0.006)
        assert np.allclose([got[k, x] for x in range(150)], want)


def test_rotation_axes(spark):
    rows = []
    for i in range(30):
        v = rng.normal(size=3)
        v *= (math.pi if i < 5 else rng.uniform(0.1, 3)) / np.linalg.norm(v)
        rows.append((i, np.hstack([K._turned(v[None])[0], [[1], [2], [3]]]).ravel().tolist(), v.tolist()))
    df = spark.createDataFrame(rows, "i int, m array<double>, v array<double>")
    axis, angle = transforms.rotation_axis(F.col("m"))
    for r in df.select("v", *[a.alias(c) for a, c in zip(axis, "xyz", strict=True)], angle.alias("angle")).collect():
        n = np.linalg.norm(r["v"])
        got = np.array([r["x"], r["y"], r["z"]])
        assert math.isclose(r["angle"], math.degrees(n), abs_tol=1e-4) and min(np.abs(got - np.array(r["v"]) / n).max(), np.abs(got + np.array(r["v"]) / n).max() if abs(n - math.pi) < 1e-9 else 9) < 1e-4
    one = spark.range(1).select(*transforms.rotation_axis(affine.literal(affine.IDENTITY))[0]).first()
    assert list(one) == [0, 0, 0]


def test_nearest_of_many_points():
    """The grid finds what all distances give, in dense and in empty places, with repeated points and outliers."""
    sets = [rng.uniform(0, 100, (4000, 3)), np.concatenate([rng.normal(0, 1, (3000, 3)), rng.uniform(-500, 500, (200, 3)), np.zeros((50, 3))]), rng.uniform(0, 9, (2500, 2)), np.c_[rng.uniform(0, 9, (2000, 2)), np.zeros(2000)]]
    for x in sets:
        d = K.square_distances(x, x)
        np.fill_diagonal(d, np.inf)
        want = np.argsort(d, axis=1, kind="stable")[:, :5]
        got, far = K.nearest(x, x, 5, True)
        assert np.allclose(far, np.sqrt(np.take_along_axis(d, want, 1))) and (got == want).mean() > 0.999
        y = rng.uniform(x.min() - 20, x.max() + 20, (700, x.shape[1]))
        e = K.square_distances(y, x)
        assert np.allclose(K.nearest_rows(y, x)[1], np.sqrt(e.min(1)))


def test_fusion_through_a_deformed_grid(spark):
    """Maps that differ from knot to knot: every voxel by itself, blended between the eight knots around it."""
    images, views = tables(spark, (4, 4, 3))
    r = np.random.default_rng(3)
    step, low, n = 4.0, -1, 7
    maps = {}
    for s, m in enumerate(MAPS):
        inverse = np.linalg.inv(np.vstack([m, [0, 0, 0, 1]]))[:3]
        for g in product(range(low, low + n), repeat=3):
            maps[s, g] = inverse + r.normal(0, 0.01, (3, 4)) * [1, 1, 1, 30]
    knots = spark.createDataFrame([(0, s, *g, m.ravel().tolist()) for (s, g), m in maps.items()], "tp int, setup int, gx int, gy int, gz int, back array<double>")
    got = []
    for size in ((5, 4, 3), (16, 16, 8)):
        grid = spark.createDataFrame([(x, y, z) for x in range(-(-16 // size[0])) for y in range(-(-12 // size[1])) for z in range(-(-6 // size[2]))], "bx int, `by` int, bz int")
        out = volume.fuse_blocks(images, views, grid, "average", size, (4, 4, 3), knots=knots, step=step, grow=6.0)
        got.append({(x["x"], x["y"], x["z"]): x["v"] for x in volume.from_blocks(out, [], size).collect()})
    for at in product(range(16), range(12), range(6)):
        values = []
        for s, image in enumerate(IMAGES):
            base = [int(math.floor(v / step)) for v in at]
            part = [v / step - b for v, b in zip(at, base, strict=True)]
            p = sum(math.prod(q if u else 1 - q for q, u in zip(part, up, strict=True)) * (maps[s, tuple(b + u for b, u in zip(base, up, strict=True))] @ [*at, 1]) for up in product((0, 1), repeat=3))
            if all(-1e-9 <= v <= k - 1 + 1e-9 for v, k in zip(p, DIMS, strict=True)):
                b = [min(max(int(math.floor(v)), 0), k - 2) for v, k in zip(p, DIMS, strict=True)]
                values.append(sum(math.prod(v - c if u else 1 - v + c for v, c, u in zip(p, b, up, strict=True)) * float(image[b[2] + up[2], b[1] + up[1], b[0] + up[0]]) for up in product((0, 1), repeat=3)))
        want = sum(values) / len(values) if values else 0.0
        assert all(math.isclose(g.get(at, 0.0), want, rel_tol=1e-6, abs_tol=1e-6) for g in got), at
