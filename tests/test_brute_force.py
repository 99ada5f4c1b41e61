"""Operators without a SQL form, or with one that is too slow, against plain loops on small inputs."""

import itertools
import math
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe import registry
from voxframe.operators import kernels, network, order, regions, spatial, stencil, tracking
from voxframe.plans.adapters import points
from voxframe.plans.engine import Config, Engine
from voxframe.plans.settings import SETTINGS

YX = ("y", "x")
SF = "/root/testdata/sf0.001"


def plain_components(cells):
    """Labels in scan order by a walk over neighbours."""
    left, out = set(cells), {}
    for c in sorted(cells):
        if c in out:
            continue
        label, todo = 1 + max(out.values(), default=0), deque([c])
        out[c] = label
        while todo:
            at = todo.popleft()
            for step in itertools.product((-1, 0, 1), repeat=len(c)):
                to = tuple(a + s for a, s in zip(at, step))
                if to in left and to not in out:
                    out[to] = label
                    todo.append(to)
    return out


@pytest.mark.parametrize("shape", [(23, 17), (7, 8, 9)])
def test_components_of_many_frames(spark, shape):
    rng = np.random.default_rng(2)
    axes = ["z", "y", "x"][-len(shape) :]
    frames = {t: [tuple(map(int, c)) for c in np.argwhere(rng.random(shape) < 0.3)] for t in range(40)}
    frames[7] = []
    rows = [(t, *c) for t, cells in frames.items() for c in cells]
    df = spark.createDataFrame(rows, "t int, " + ", ".join(f"{a} int" for a in axes))
    got = {tuple(r)[:-1]: r["label"] for r in regions.components(df, ["t"], axes).collect()}
    assert got == {(t, *c): label for t, cells in frames.items() for c, label in plain_components(cells).items()}


def test_a_frame_longer_than_a_batch_stays_whole(spark):
    rows = [(t, y, x) for t in (0, 1) for y in range(130) for x in range(130)] + [(2, 0, 0)]
    got = regions.components(spark.createDataFrame(rows, "t int, y int, x int"), ["t"], ["y", "x"]).groupBy("t").agg(F.max("label"), F.count("*")).collect()
    assert {tuple(r) for r in got} == {(0, 1, 16900), (1, 1, 16900), (2, 1, 1)}


def plain_thinning(mask):
    """Zhang and Suen, pixel by pixel."""
    m = {tuple(map(int, c)) for c in np.argwhere(mask)}
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        changed = False
        for step in (0, 1):
            gone = set()
            for y, x in m:
                p = [(y + dy, x + dx) in m for dy, dx in ring]
                turns = sum(not p[i] and p[(i + 1) % 8] for i in range(8))
                n, e, s, w = p[0], p[2], p[4], p[6]
                free = not (n and e and s) and not (e and s and w) if step == 0 else not (n and e and w) and not (n and s and w)
                if 2 <= sum(p) <= 6 and turns == 1 and free:
                    gone.add((y, x))
            m -= gone
            changed |= bool(gone)
        if not changed:
            return m


def test_thinning_pixel_by_pixel():
    rng = np.random.default_rng(4)
    for _ in range(20):
        mask = kernels.smooth(rng.random((20, 24)), 1.2) > 0.5
        assert {tuple(map(int, c)) for c in np.argwhere(kernels.Thinning()(mask.astype(float)))} == plain_thinning(mask)


def test_thinning_in_3d_keeps_pieces_holes_and_ends():
    tube = np.zeros((9, 9, 30))
    tube[3:6, 3:6, 3:27] = 1
    thin = kernels.Thinning3D()(tube)
    assert regions.label_grid(thin > 0).max() == 1 and 15 <= thin.sum() <= 30 and (thin <= tube).all()
    assert np.ptp(np.argwhere(thin)[:, 2]) >= 15
    ring = tube.copy()
    ring[:, :, 12:18] = 0
    assert regions.label_grid(kernels.Thinning3D()(ring) > 0).max() == 2
    torus = np.zeros((5, 15, 15))
    y, x = np.indices((15, 15)) - 7
    torus[1:4, (abs(np.hypot(y, x) - 5) < 1.6)] = 1
    thin = kernels.Thinning3D()(torus) > 0
    flat = thin.any(axis=0)
    assert regions.label_grid(thin).max() == 1 and not flat[7, 7] and kernels.FillHoles()(flat)[7, 7]  # the hole stays, closed all around


def test_simple_cells():
    cube = np.zeros((3, 3, 3), bool)
    cube[1, 1, 1] = cube[1, 1, 0] = True
    assert kernels.is_simple(cube)
    cube[1, 1, 2] = True
    assert not kernels.is_simple(cube)  # it joins two parts
    assert not kernels.is_simple(np.ones((3, 3, 3), bool))  # it would open a hole


def test_mean_filter_and_holes():
    rng = np.random.default_rng(6)
    image = rng.random((6, 7))
    padded = np.pad(image, 1, mode="edge")
    want = sum(padded[1 + dy : 7 + dy, 1 + dx : 8 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 9
    assert np.allclose(kernels.MeanFilter()(image), want)
    box = np.ones((5, 5, 5))
    box[2, 2, 2] = 0
    assert kernels.FillHoles()(box).all()
    box[2, 2, :3] = 0  # a way out
    assert (kernels.FillHoles()(box) == box).all()


def test_scales_are_smoothed_from_the_image():
    image = np.random.default_rng(1).random((6, 20, 22))
    space = kernels.ScaleSpace((1.0, 1.5), 0.5)(image)
    assert len(space) == 3
    first = image
    for axis, s in enumerate((0.5, 1.0, 1.0)):
        first = kernels.convolve(first, kernels.gaussian_weights(s), axis)
    assert np.allclose(space[0], first)


def test_eigenvalues_of_3d_matrices(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(200, 3, 3))
    m = m + m.transpose(0, 2, 1)
    m[0] = np.diag([2.0, 2.0, 2.0])
    m[1] = 0
    rows = [(i, *map(float, (a[0, 0], a[0, 1], a[0, 2], a[1, 1], a[1, 2], a[2, 2]))) for i, a in enumerate(m)]
    df = spark.createDataFrame(rows, "i int, zz double, zy double, zx double, yy double, yx double, xx double")
    got = {r[0]: r[1:] for r in df.select("i", *stencil.eigen_3d(*map(F.col, ("zz", "zy", "zx", "yy", "yx", "xx")))).collect()}
    for i, a in enumerate(m):
        want = np.linalg.eigvalsh(a)
        assert got[i] == pytest.approx(want[np.argsort(np.abs(want))], abs=1e-6)


def plain_hull_area(cells):
    """Area on the inner side of every edge that has all corners on one side."""
    corners = sorted({(y + a, x + b) for y, x in cells for a in (0, 1) for b in (0, 1)})
    area = 0.0
    for p, q in itertools.permutations(corners, 2):
        side = [(q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) for r in corners]
        between = [r for r, s in zip(corners, side) if s == 0 and r not in (p, q) and min(p, q) < r < max(p, q)]
        beyond = [r for r, s in zip(corners, side) if s == 0 and r not in (p, q) and not min(p, q) < r < max(p, q)]
        if min(side) >= 0 and not beyond:
            assert len(between) >= 0
            area += (p[0] * q[1] - p[1] * q[0]) / 2
    return abs(area)


def test_hulls():
    rng = np.random.default_rng(3)
    for _ in range(15):
        cells = np.unique(rng.integers(0, 6, (7, 2)), axis=0)
        assert kernels.hull_area(cells) == pytest.approx(plain_hull_area([tuple(map(int, c)) for c in cells]))


def test_distances_to_the_background(spark):
    rng = np.random.default_rng(8)
    mask = kernels.smooth(rng.random((16, 18)), 1.5) > 0.5
    rows = [(0, y, x, bool(mask[y, x])) for y in range(16) for x in range(18)]
    got = {(r["y"], r["x"]): r["distance"] for r in kernels.distance(spark.createDataFrame(rows, "t int, y int, x int, on boolean"), ["t"], "on", 3.5).collect()}
    outside = np.argwhere(~mask)
    for y, x in np.argwhere(mask):
        assert got[y, x] == pytest.approx(min(3.5, np.hypot(*(outside - (y, x)).T).min()))
    assert len(got) == mask.sum()


def test_nearest_seed_in_a_large_object(spark):
    rng = np.random.default_rng(5)
    cells = [(0, 1, y, x) for y in range(40) for x in range(40)] + [(0, 2, 50, 50)]
    seeds = [(0, 1, int(y), int(x), i) for i, (y, x) in enumerate(rng.integers(0, 12, (9, 2)))]
    vox = spark.createDataFrame(cells, "t int, label int, y int, x int")
    got = {(r["y"], r["x"]): r["seed"] for r in network.nearest_seed(vox, spark.createDataFrame(seeds, "t int, label int, y int, x int, seed int"), ["t", "label"], YX, (0.2, 0.3), "seed").collect()}
    want = {(y, x): min((round(math.hypot((y - b) * 0.2, (x - c) * 0.3), 9), s) for _, _, b, c, s in seeds)[1] for _, label, y, x in cells if label == 1}
    assert got == want


def test_numbers_are_gapless_and_in_order(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 50, (5000, 2))]
    got = sorted((r["n"], r["a"], r["b"]) for r in order.numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a", "b"], "n").collect())
    assert [g[0] for g in got] == list(range(5000)) and [g[1:] for g in got] == sorted(rows)
    kept = kernels.every_kth(spark.createDataFrame(rows, "a int, b int"), ["a", "b"], 7, 20).collect()
    assert sorted(map(tuple, kept)) == sorted(rows)[::7][:20]


def test_ten_steps_of_a_track_have_a_flat_plan(spark):
    flow = spark.createDataFrame([(t, float(t), float(i * 10), 1.0, 0.5, -1.0) for t in range(12) for i in range(4)], "t int, y double, x double, dy double, dx double, cost double")
    seeds = spark.createDataFrame([(i, 0, 0.0, float(i * 10)) for i in range(4)], "id long, t int, y double, x double")
    size = {}
    for steps in (1, 10):
        out = tracking.extend_tracks(seeds, flow, YX, 6.0, steps)
        size[steps] = out._jdf.queryExecution().analyzed().toString().count("Join")
    assert size == {1: 0, 10: 0}
    assert out.groupBy("track_id").count().where("count = 11").count() == 4
    assert tracking.extend_tracks(seeds, flow, YX, 6.0, 100).agg(F.max("t")).first()[0] == 12


def plain_turn(a, b, dt):
    if len(a) == 2:
        d = math.atan2(b[1], b[0]) - math.atan2(a[1], a[0])
        return np.array([((d + math.pi) % (2 * math.pi) - math.pi) / dt])
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return np.cross(a, b) / size / dt if size else np.full(3, np.nan)


@pytest.mark.parametrize("dims", [2, 3])
def test_motility_by_hand(spark, dims):
    rng = np.random.default_rng(dims)
    axes, spacing, dt = ("z", "y", "x")[-dims:], (0.5, 0.2, 0.3)[-dims:], 2.0
    vox = [(0, i, i % 3, *map(int, rng.integers(1, 20, dims))) for i in range(12)]
    steps = {k: {i: rng.normal(size=dims) for i in range(12) if i != miss} for k, miss in (("f", 4), ("b", 7))}
    frame = lambda k: spark.createDataFrame([(0, i, *map(float, v)) for i, v in steps[k].items()], "t int, id int, " + ", ".join(f"d{a} double" for a in axes))
    df = spark.createDataFrame(vox, "t int, id int, branch int, " + ", ".join(f"{a} int" for a in axes))
    got = {r["id"]: r for r in tracking.motility(df, frame("f"), frame("b"), axes, spacing, dt).collect()}
    at = {v[1]: np.array(v[3:]) * spacing for v in vox}
    branch = {v[1]: v[2] for v in vox}
    ref = {k: {b: min((round(float(np.linalg.norm(d)), 9), i) for i, d in steps[k].items() if branch[i] == b)[1] for b in range(3)} for k in "fb"}
    for i in range(12):
        ends = {}
        for k in "fb":
            if i in steps[k]:
                path = lambda j, k=k: (at[j], at[j] + steps[k][j]) if k == "f" else (at[j] - steps[k][j], at[j])
                own, mid = path(i), path(ref[k][branch[i]])
                ends[k] = own, (own[0] - mid[0], own[1] - mid[1])
        for n, name in enumerate(("", "rel_")):
            r = got[i]
            if "f" not in ends:
                assert r[f"{name}linear_vel"] is None and r[f"{name}linear_acc"] is None
                continue
            v = (ends["f"][n][1] - ends["f"][n][0]) / dt
            w = plain_turn(*ends["f"][n], dt)
            assert r[f"{name}linear_vel"] == pytest.approx(np.linalg.norm(v))
            if np.isfinite(w).all():
                assert r[f"{name}angular_vel"] == pytest.approx(np.linalg.norm(w))
            if "b" in ends:
                u = (ends["b"][n][1] - ends["b"][n][0]) / dt
                assert r[f"{name}linear_acc"] == pytest.approx(np.linalg.norm((v - u) / dt))
            else:
                assert r[f"{name}linear_acc"] is None
        if "f" in ends:
            a, b = (np.linalg.norm(x) for x in ends["f"][1])
            assert got[i]["rel_directionality"] == (pytest.approx(abs(b - a) / (a + b)) if a + b else None)


def test_every_point_has_its_nearest(spark):
    frames = {}
    for r in points(spark, SF).collect():
        frames.setdefault(r["t"], []).append((r["id"], r["y"], r["x"]))
    near = {}
    for t, here in frames.items():
        for i, y, x in here:
            if t + 1 in frames:
                near[t, i] = min((round(math.hypot(y - b, x - c), 9), j) for j, b, c in frames[t + 1])[1]
    assert {(r["t"], r["id"]): r["nearest_id"] for r in registry.queries()["jon_6_nearest_by_rings"](spark, SF).collect()} == near


def test_points_far_from_all_others(spark):
    left = spark.createDataFrame([(0, i, 1000.0 * i, 0.0) for i in range(30)], "t int, id int, y double, x double")
    right = spark.createDataFrame([(0, 7, 0.0, 0.0), (0, 8, 0.5, 0.0)], "t int, id int, y double, x double")
    got = {r["id"]: (r["nearest_id"], r["distance"]) for r in spatial.nearest_any(left, right, ["t"], YX, 1.0, "id", "id").collect()}
    assert got == {i: ((7, 0.0) if i == 0 else (8, 1000.0 * i - 0.5)) for i in range(30)}


def frames_of_moving_rods(spark, depth=0):
    """Two rods that move a cell a frame."""
    rows = []
    rng = np.random.default_rng(0)
    for t in range(3):
        noise = rng.random((max(depth, 1), 32, 32)) * 0.02
        for z, y, x in itertools.product(range(max(depth, 1)), range(32), range(32)):
            near = min(math.hypot(y - 8 - t, max(0, 5 - x, x - 25)), math.hypot(x - 16 - t, max(0, 18 - y, y - 29)))
            v = math.exp(-(near**2) / 3) * math.exp(-((z - depth // 2) ** 2) / 3 if depth else 0) + noise[z, y, x]
            rows.append((t, *([z] if depth else []), y, x, float(v)))
    return spark.createDataFrame(rows, "t int, " + ("z int, " if depth else "") + "y int, x int, v double")


@pytest.mark.parametrize("depth", [0, 6])
def test_a_full_run(spark, depth):
    config = Config(height=32, width=32, depth=depth, bins=64, least_object=5, least_radius=1.0, most_radius=6.0, least_marker_radius=1.0, most_marker_radius=4.0, most_speed=4.0, match_speed=3.0)
    frames = frames_of_moving_rods(spark, depth)
    out = {k: v.persist() for k, v in Engine(config).run(frames).items()}
    labels = {tuple(r[a] for a in ("t", *config.axes)): r["label"] for r in out["labels"].collect()}
    assert {(k[0], v) for k, v in labels.items()} >= {(t, 1) for t in range(3)}
    big = {}
    for k, v in labels.items():
        big[k[0], v] = big.get((k[0], v), 0) + 1
    assert all(sum(n > 20 for (u, _), n in big.items() if u == t) in (1, 2) for t in range(3))
    # every object has a skeleton, every skeleton cell lies in its object
    bones = [(tuple(r[a] for a in ("t", *config.axes)), r["label"]) for r in out["skeleton"].collect()]
    assert all(labels[k] == v for k, v in bones) and {(k[0], v) for k, v in bones} == set(big)
    assert out["voxels"].count() == len(labels) and out["organelles"].count() == len(big)
    # sums over levels agree: intensity of the image is that of its voxels, and of its organelles' voxels
    total = out["voxels"].groupBy("t").agg(F.sum("intensity_raw").alias("s")).collect()
    image = {r["t"]: r["intensity_sum"] for r in out["image"].collect()}
    assert {r["t"]: pytest.approx(r["s"]) for r in total} == image
    assert {r["t"]: pytest.approx(r["s"]) for r in out["organelles"].groupBy("t").agg(F.sum("intensity_sum").alias("s")).collect()} == image
    # labels are carried over: the first frame keeps its own, later frames have only those
    carried = out["reassigned_organelles"]
    first = {r["label"] for r in carried.where("t = 0").select("label").distinct().collect()}
    assert {r["label"] for r in carried.select("label").distinct().collect()} <= first | {0}
    assert carried.where("t = 2 and label > 0").count() > 0 and out["flow"].count() > 0
    kinds = {r["kind"] for r in out["edges"].select("kind").distinct().collect()}
    assert kinds == {"v_b", "v_o", "v_n", "b_o", "n_b", "n_o"}
    for name in ("linear_vel", "rel_directionality"):
        assert out["voxels"].where(F.col(f"{name}_raw").isNotNull()).count() > 0
    assert {"node_thickness_mean", "linear_vel_mean", "branch_length_mean", "organelle_area_raw", "reassigned_label_raw"} <= set(out["organelles"].columns)


def test_labels_by_tiles_are_those_of_whole_frames(spark):
    frames = frames_of_moving_rods(spark).persist()
    whole, tiled = (Engine(Config(height=32, width=32, threshold=0.3, tile=t)).label(frames) for t in (None, 7))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, tiled.collect()))


def test_settings_make_a_config():
    saved = {n: v for n, v, _ in SETTINGS}
    assert len(saved) == 68 and Config.from_settings(saved) == Config()
    changed = Config.from_settings(saved | {"remove_edges": True, "segmentation_label_threshold": 0.2, "mocap_use_im": "frangi", "feature_skip_nodes": True}, height=9)
    assert changed.remove_edges and changed.threshold == 0.2 and changed.peaks_from == "vesselness" and not changed.nodes and changed.height == 9
