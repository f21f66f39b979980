"""Dense kernels and iterative operators against closed forms and plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiframe.functions import affine
from lumiframe.functions import kernels as K
from lumiframe.operators import alignment, boxes, fusion, intensity, iterate, points, relations, restoration, spatial
from lumiframe.sources import blocks

rng = np.random.default_rng(1)


def rotation(a):
    return np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])


def test_fits_recover_their_model():
    p = rng.normal(size=(30, 3)) * 50
    for model, m in {"translation": np.eye(3), "rigid": rotation(0.7), "similarity": 1.3 * rotation(0.7), "affine": rng.normal(size=(3, 3))}.items():
        q = p @ m.T + [3, -2, 9]
        f = K.FITS[model](p, q)
        assert np.allclose(K.transform(f, p), q, atol=1e-8)
        w = rng.uniform(0.1, 2, 30)
        assert np.allclose(K.transform(K.FITS[model](p, q, w), p), q, atol=1e-8)
    assert np.allclose(K.fit_interpolated("translation", "identity", 0.1, p, p + 10)[:, 3], 9)
    assert np.allclose(K.map_back(np.hstack([rotation(0.4), [[1], [2], [3]]]), np.array([10, 20, 30]))[:, :3], rotation(-0.4))
    with pytest.raises(np.linalg.LinAlgError):
        K.fit_affine(np.ones((5, 3)), np.ones((5, 3)))


def test_ransac():
    p = rng.normal(size=(60, 3)) * 50
    q = p + [5, 6, 7]
    q[40:] += rng.normal(size=(20, 3)) * 200 + 500
    assert K.ransac(p, q, "translation", 1.0, 0.1, 100, 12, 3).tolist() == list(range(40))
    assert len(K.ransac(p, q, "translation", 1.0, 0.9, 100, 12, 3)) == 0 and len(K.ransac(p[:3], q[:3], "rigid", 1.0, 0.1, 10, 12, 3)) == 0
    q[40:] = p[40:] + [-90, 4, 1]
    assert [len(s) for s in K.multi_consensus(p, q, "translation", 1.0, 0.1, 200, 12, 3)] == [40, 20]
    x = np.linspace(0, 1, 50)
    y = 2 * x + 1
    y[::5] += 3 + x[::5]
    assert set(K.ransac_line(x, y, 0.01, 0.1, 200, 10, 3.0, 1)) == set(range(50)) - set(range(0, 50, 5))
    assert np.allclose(K.fit_line(x, 2 * x + 1), (2, 1)) and K.fit_line(np.ones(4), np.arange(4.0)) is None


def test_icp():
    p = rng.uniform(0, 100, (40, 3))
    m, pairs, _ = K.icp(p, p[::-1] + [1, -1, 0.5], "translation", 8.0, 50, 12)
    assert np.allclose(m[:, 3], [1, -1, 0.5], atol=1e-6) and len(pairs) == 40 and all(a + b == 39 for a, b in pairs)


def test_descriptors():
    x = rng.uniform(0, 100, (25, 3))
    near = K.nearest_others(x, 3)
    turned = x @ rotation(1.1).T + [3, 4, 5]
    assert np.allclose(K.local_frames(x, near), K.local_frames(turned, K.nearest_others(turned, 3)))
    d = K.redundant_distance(x[near] - x[:, None], x[near] - x[:, None], 2)
    assert np.allclose(np.diag(d), 0)
    d = np.array([[1.0, 2.0, 9.0], [3.0, 3.0, 3.0]])
    assert K.ratio_matches(d, 2.0, False).tolist() == [[0, 0]] and K.ratio_matches(d, 2.0, True).tolist() == [] and len(K.ratio_matches(d[:, :1], 1, True)) == 0


def test_images():
    image = np.full((40, 41), 5.0)
    assert np.allclose(K.gauss(image, 3.0), 5)
    one = np.zeros((41, 41))
    one[20, 20] = 1
    assert np.isclose(K.gauss(one, 2.0).sum(), 1) and np.allclose(K.convolve(one, np.ones((3, 5))), np.pad(np.ones((3, 5)), ((19, 19), (18, 18))), atol=1e-12)
    y, x = np.mgrid[:41, :41]
    blob = 100 * np.exp(-((y - 20.3) ** 2 + (x - 17.6) ** 2) / 8)
    d = K.dog(blob, 1.8, 0, 100)
    places = K.local_minima(d, 0.05)
    at, _ = K.refine(d, places[0])
    assert len(places) == 1 and np.allclose(at, [20.3, 17.6], atol=0.1)
    mask = (x > 10).astype(float)
    assert np.allclose(K.weighted_gauss(np.where(x > 10, 7.0, 0.0), mask, 2.0)[:, 12:], 7.0)
    assert np.allclose(K.ring_correlation(blob, blob), 1.0) and len(K.ring_correlation(blob, blob)) == 30
    assert np.allclose(K.smooth(np.arange(100.0) * 2 + 1), np.arange(100.0) * 2 + 1)


def test_deconvolution_sharpens():
    truth = np.zeros(80)
    truth[[20, 45, 50]] = 10, 20, 15
    truth += 1
    psf = np.array([0.1, 0.2, 0.4, 0.2, 0.1])
    seen = K.convolve(truth, psf)
    for kind in ("independent", "efficient Bayesian", "optimization I", "optimization II"):
        out = K.deconvolve([seen, seen], [np.full(80, 0.5)] * 2, [psf, psf], 30, kind)
        assert np.abs(out - truth).sum() < 0.6 * np.abs(seen - truth).sum()
    k1, k2 = K.psf_pair([psf, psf], 0, "independent")
    assert np.isclose(k1.sum(), 1) and np.allclose(k2, psf[::-1])


def test_moving_least_squares():
    p = rng.uniform(0, 50, (30, 3))
    for f in K.moving_least_squares(np.array([[1.0, 2, 3], [30, 20, 10]]), p, p @ rotation(0.2).T + 4):
        assert np.allclose(f[:, :3], rotation(0.2), atol=1e-6)
    assert np.allclose(K.moving_least_squares(np.zeros((1, 3)), p[:2], p[:2] + 3)[0][:, 3], 3)


def test_global_translations():
    true = rng.normal(size=(6, 3))
    edges = [(a, b, 1.0, true[a] - true[b]) for a, b in [(0, 1), (1, 2), (2, 0), (3, 4)]]
    x = K.solve_translations(6, edges, {0})
    assert np.allclose(x[:3] - x[0], true[:3] - true[0]) and np.allclose(x[4] - x[3], true[4] - true[3]) and np.allclose(x[5], 0)
    assert alignment.converged(1, 2, 2.5, 3.5) and not alignment.converged(4, 4.1, 2.5, 3.5) and alignment.converged(0.1, 0.7, 2.5, 3.5) and not alignment.converged(0.1, 0.8, 2.5, 3.5)


def test_intervals_and_factors():
    assert boxes.split_interval(0, 9, 4, 1) == [(0, 3), (3, 6), (6, 9)] and boxes.split_interval(0, 2, 4, 1) == [(0, 2)]
    with pytest.raises(ValueError, match="longer"):
        boxes.split_interval(0, 9, 2, 2)
    for length in range(30, 200, 7):
        size = boxes.best_size(length, 40, 10, 5)
        tiles = boxes.split_interval(0, length - 1, size, 10)
        assert tiles[0][0] == 0 and tiles[-1][1] == length - 1 and all(b[0] == a[1] - 9 for a, b in zip(tiles, tiles[1:], strict=False))
    assert relations.least_step([[1, 2], [4, 2], [6, 2]]) == [12, 2]
    assert [fusion.halvings(f) for f in (1, 2, 3, 4, 6, 8)] == [0, 1, 1, 2, 2, 3]
    assert blocks.pyramid([5, 4, 1], [[2, 2, 1], [4, 4, 2]]) == [[5, 4, 1], [2, 2, 1], [1, 1, 1]] and blocks.count_blocks([5, 4, 1], [2, 2, 2]) == 6
    assert restoration.blocks(10, 4, 1) == [(0, 4, -1, 5), (4, 8, 3, 9), (8, 10, 7, 11)]
    with pytest.raises(ValueError, match="12 numbers"):
        affine.parse("1 2 3")


def test_suppression_is_greedy(spark):
    r = random.Random(2)
    rows = [(0, s, "l", i, r.uniform(0, 12), r.uniform(0, 12), 0.0) for s in range(3) for i in range(25)]
    df = spark.createDataFrame(rows, "tp int, setup int, label string, id int, x double, y double, z double")
    order = {(x["setup"], x["id"]): x["o"] for x in df.select("setup", "id", F.xxhash64("tp", "setup", "id", F.lit(234)).alias("o")).collect()}
    stays = []
    for row in sorted(rows, key=lambda x: (order[x[1], x[3]], x[1], x[3])):
        if not any(s[1] != row[1] and (s[4] - row[4]) ** 2 + (s[5] - row[5]) ** 2 <= 2.5**2 for s in stays):
            stays.append(row)
    assert sorted((x["setup"], x["id"]) for x in points.suppress(df, 2.5).collect()) == sorted((s[1], s[3]) for s in stays)


def test_nearest_distance(spark):
    r = random.Random(3)
    rows = [(g, i, r.uniform(0, 100) ** 2, r.uniform(0, 5)) for g in range(3) for i in range(30)] + [(9, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, i int, x double, y double")
    out = {(x["g"], x["i"]): x["d"] for x in spatial.nearest_distance(df, df, ["x", "y"], ["g", "i"], ["g"], True).collect()}
    for g, i, x, y in rows:
        others = [math.dist((x, y), (p, q)) for h, j, p, q in rows if h == g and j != i]
        assert (g, i) in out if others else (g, i) not in out
        if others:
            assert math.isclose(out[g, i], min(others))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50) if i % 10 < 7] + [(100, 3), (4, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {x["node"]: x["component"] for x in iterate.components(df).collect()}
    assert found[100] == 0 and found[7] == 0 and found[11] == 10 and len(found) == 41


def test_value_maps(spark):
    """Views that differ by lines come together; the first stays as it is."""
    r = random.Random(5)
    rows = [(a, b, 2.0 * v if a == 1 else v, v if b == 0 else 2.0 * v if b == 1 else v - 5, 1.0) for a, b in ((0, 1), (0, 2), (1, 2)) for v in [r.uniform(10, 100) for _ in range(40)]]
    rows = [(a, b, {0: v, 1: 2 * v, 2: v - 5}[a], {0: v, 1: 2 * v, 2: v - 5}[b], 1.0) for a, b, v in [(a, b, r.uniform(10, 100)) for a, b in ((0, 1), (0, 2), (1, 2)) for _ in range(40)]]
    df = spark.createDataFrame(rows, "node_a long, node_b long, p double, q double, weight double")
    out = {x["node"]: (x["a"], x["b"]) for x in intensity.solve_fields(df, 1e-9).collect()}
    assert np.allclose([out[0], out[1], out[2]], [(1, 0), (0.5, 0), (1, 5)], atol=1e-4)


def test_blocks_equal_whole_lines(spark):
    v = rng.uniform(0, 100, 300)
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "setup int, x int, v double")
    out = [x["soft"] for x in restoration.gauss_line(df, ["setup"], "x", "v", 2.0, 64).orderBy("x").collect()]
    assert np.allclose(out[20:-20], K.gauss(v, 2.0)[20:-20])


def test_raw_volumes(spark, tmp_path):
    v = rng.integers(0, 1000, (7, 3, 4)).astype("<u2")
    (tmp_path / "a.raw").write_bytes(v.tobytes())
    blocks.register(spark)
    rows = spark.read.format("rawvolume").option("path", str(tmp_path)).option("dims", "4,3,7").option("planes", "3").load().orderBy("oz").collect()
    assert [r["oz"] for r in rows] == [0, 3, 6] and np.array_equal(np.concatenate([r["data"] for r in rows]), v.ravel())


def test_arrays_of_five_dimensions(spark, tmp_path):
    import json

    from lumiframe.sources import images

    v = rng.integers(0, 99, (2, 3, 2, 5, 7)).astype("<i4")
    root = tmp_path / "a"
    root.mkdir()
    (root / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": list(v.shape), "chunks": [1, 1, 2, 3, 4], "dtype": "<i4", "compressor": {"id": "gzip", "level": 1}, "fill_value": 7, "order": "C", "filters": None, "dimension_separator": "/"}))
    full = np.full((2, 3, 2, 6, 8), 0, "<i4")
    full[:, :, :, :5, :7] = v
    for t, c, y, x in np.ndindex(2, 3, 2, 2):
        if (t, c, y, x) == (1, 2, 0, 1):
            v[t, c, :, :3, 4:] = 7  # a missing chunk has the fill value
            continue
        f = root / f"{t}/{c}/0/{y}/{x}"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(images.encode(full[t, c, :, 3 * y : 3 * y + 3, 4 * x : 4 * x + 4].tobytes(), {"id": "gzip"}))
    images.register(spark)
    got = np.zeros((2, 5, 7))
    for r in spark.read.format("zarrarray").option("path", str(root)).option("t", "1").option("c", "2").load().collect():
        got[r["oz"] : r["oz"] + r["nz"], r["oy"] : r["oy"] + r["ny"], r["ox"] : r["ox"] + r["nx"]] = np.reshape(r["data"], (r["nz"], r["ny"], r["nx"]))
    assert np.array_equal(got, v[1, 2])
    with pytest.raises(ValueError, match="isn't supported"):
        images.decode(b"", {"id": "blosc"})


def test_tiff():
    from lumiframe.sources import images

    for kind in ("u1", "<u2", "<f4"):
        v = rng.integers(0, 200, (3, 4, 5)).astype(kind)
        b = images.tiff_bytes(v)
        at = lambda n, o, b=b: b[o : o + n]
        assert np.array_equal([images.tiff_plane(t, at) for t in images.tiff_pages(at)], v)
    with pytest.raises(ValueError, match="not a TIFF"):
        list(images.tiff_pages(lambda n, o: b"nothing!"[:n]))


def test_boxes_of_points(spark):
    p = rng.uniform(-1, 1, (400, 3)) * [10, 4, 1]
    turned = p @ np.array(boxes.rotation_xyz(0.2, -0.3, 0.25)).T
    df = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(turned)], "g int, id int, x double, y double, z double")
    plain = np.prod(np.ptp(turned, axis=0))
    best = boxes.smallest_box(df, margin=0.1)
    assert best["volume"] < 0.6 * plain and best["volume"] < 1.2 * np.prod(np.ptp(p, axis=0))
    r = boxes.farthest_pairs(df, ["g"]).first()
    d = ((turned[:, None] - turned[None]) ** 2).sum(2)
    assert math.isclose(r["d2"], d.max()) and math.isclose(d[r["id_a"], r["id_b"]], d.max())
    assert boxes.smallest_box(df.limit(0)) is None and boxes.farthest_pairs(df.limit(1), ["g"]).count() == 0


def test_sampled_ends_lie_within(spark):
    df = spark.createDataFrame([(s, i, float(i)) for s in range(2) for i in range(500)], "setup int, x int, v double")
    for r in fusion.approximate_min_max(df, ["setup"], 0.3).collect():
        assert 0 <= r["lo"] < 30 and 470 < r["hi"] <= 499


def test_project_versions_and_file_lists(spark, tmp_path):
    from lumiframe.sources import filenames, project

    at = str(tmp_path / "p")
    for i in range(8):
        project.backups(at, spark)
        spark.range(i).coalesce(1).write.parquet(at)
    assert spark.read.parquet(at).count() == 7 and [spark.read.parquet(f"{at}~{k}").count() for k in range(1, 6)] == [6, 5, 4, 3, 2]
    assert not (tmp_path / "p~6").exists()
    for n in ("img_t0_c1.tif", "img_t1_c1.tif", "img_t12_c1.tif", "note.txt"):
        (tmp_path / "f").mkdir(exist_ok=True)
        (tmp_path / "f" / n).write_bytes(b"x")
    files = filenames.file_list(spark, str(tmp_path / "f"))
    assert files.count() == 4
    assert [(r["position"], r["values"], r["varies"]) for r in filenames.detect_pattern(files).orderBy("position").collect()] == [(0, 3, True), (1, 1, False)]
    views = filenames.views_from_names(files, {0: "tp", 1: "channel"})
    assert sorted((r["tp"], r["setup"], r["channel"], r["name"]) for r in views.collect()) == [(0, 0, 1, "img_t0_c1.tif"), (1, 0, 1, "img_t1_c1.tif"), (12, 0, 1, "img_t12_c1.tif")]


def test_streams_join_as_tables_do(spark, tmp_path):
    from lumiframe.streaming import intervals

    rows = [(i, i % 3, 1e9 + i * 100) for i in range(40)]
    e = spark.createDataFrame(rows, "id long, k long, s double").select("id", "k", F.timestamp_seconds("s").alias("ts"))
    e.write.parquet(str(tmp_path / "in"))
    want = sorted((r["id_a"], r["id_b"]) for r in intervals.pairs_in_range(e, e, "k", "ts", 400).collect())
    s = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = intervals.pairs_in_range(s(), s(), "k", "ts", 400).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["id_a"], r["id_b"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want and want
