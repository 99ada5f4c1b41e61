"""Volumes and large frames against plain loops: distances, thinning, hulls, axes, components by contraction."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import kernels, regions

ZYX = ("z", "y", "x")


def cells_of(spark, cells, extra=()):
    return spark.createDataFrame([(0, *extra, *map(int, c)) for c in cells], "t int, " + "label int, " * len(extra) + "z int, y int, x int")


def test_distances_in_a_volume_at_a_reach_of_twenty(spark):
    rng = np.random.default_rng(1)
    mask = np.zeros((8, 32, 32), bool)
    mask[1:7, 4:28, 3:30] = True
    mask &= rng.random(mask.shape) < 0.99
    df = spark.createDataFrame([(0, *map(int, c), bool(mask[tuple(c)])) for c in np.argwhere(mask | ~mask)], "t int, z int, y int, x int, on boolean").repartition(1)
    df.count()
    began = time.perf_counter()
    got = {(r["z"], r["y"], r["x"]): r["distance"] for r in kernels.distance(df, ["t"], "on", 20.0, ZYX).collect()}
    assert time.perf_counter() - began < 30
    outside = np.argwhere(~mask)
    assert got == {tuple(map(int, c)): pytest.approx(min(20.0, float(np.sqrt(((outside - c) ** 2).sum(axis=1).min())))) for c in np.argwhere(mask)}


def test_cells_that_are_lacking_are_no_background():
    image = np.array([[1.0, 1, 0, 2], [1, 1, 0, 0]])
    assert kernels.Distance(9.0)(image)[0].tolist() == [3, 2, 1, 0]
    assert (kernels.Distance(2.0)(np.ones((3, 3))) == 2).all()


def plain_simple(cube):
    """Parts by walks: one of the mask around the middle, one of the background through faces within the 18 neighbours that lies on its faces."""

    def parts(cells, near):
        left, out = set(cells), []
        while left:
            todo, part = [left.pop()], set()
            while todo:
                a = todo.pop()
                part.add(a)
                beside = {b for b in left if near(a, b)}
                left -= beside
                todo += beside
            out.append(part)
        return out

    at = [c for c in itertools.product((-1, 0, 1), repeat=3) if any(c)]
    on = [c for c in at if cube[tuple(np.add(c, 1))]]
    off = [c for c in at if not cube[tuple(np.add(c, 1))] and sum(map(abs, c)) <= 2]
    face = lambda a, b: sum(abs(p - q) for p, q in zip(a, b)) == 1
    touch = lambda a, b: max(abs(p - q) for p, q in zip(a, b)) == 1
    return len(parts(on, touch)) == 1 and sum(any(sum(map(abs, c)) == 1 for c in p) for p in parts(off, face)) == 1


def plain_thinning(mask):
    """The same order of sides and fields, cell by cell."""
    m = np.pad(mask, 1)
    changed = True
    while changed:
        changed = False
        for side in ((-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)):
            edge = [c for c in map(tuple, np.argwhere(m)) if not m[tuple(np.add(c, side))]]
            for field in itertools.product((0, 1), repeat=3):
                for z, y, x in [c for c in edge if tuple(v % 2 for v in c) == field]:
                    cube = m[z - 1 : z + 2, y - 1 : y + 2, x - 1 : x + 2]
                    if cube.sum() > 2 and plain_simple(cube):
                        m[z, y, x] = False
                        changed = True
    return m[1:-1, 1:-1, 1:-1]


def test_simple_cells_and_thinning_cell_by_cell():
    rng = np.random.default_rng(7)
    cubes = rng.random((400, 27)) < rng.random((400, 1))
    cubes[:, 13] = True
    assert kernels.simple_cells(cubes).tolist() == [plain_simple(c.reshape(3, 3, 3)) for c in cubes]
    for _ in range(4):
        mask = kernels.smooth(rng.random((7, 11, 12)), 1.2) > 0.5
        assert (kernels.Thinning3D()(mask.astype(float)) > 0).tolist() == plain_thinning(mask).tolist()


def plain_hull_volume(cells):
    """Pyramids from the middle to every plane that has all corners on one side."""
    c = np.array(sorted({tuple(np.add(x, d)) for x in cells for d in itertools.product((0, 1), repeat=3)}))
    planes = {}
    for i, j, k in itertools.combinations(range(len(c)), 3):
        n = np.cross(c[j] - c[i], c[k] - c[i])
        side = (c - c[i]) @ n
        if not n.any() or (side.max() > 0 and side.min() < 0):
            continue
        n = (-n if side.max() > 0 else n) // np.gcd.reduce(n)
        planes[tuple(map(int, n)), int(n @ c[i])] = c[side == 0]
    middle, total = c.mean(axis=0), 0.0
    for (n, level), points in planes.items():
        axis = int(np.abs(n).argmax())
        flat = [tuple(p) for p in np.delete(points, axis, axis=1)]
        centre = np.mean(flat, axis=0)
        hull = [p for p in flat if any(all((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) >= 0 for r in flat) for q in flat if q != p)]
        y, x = np.array(sorted(hull, key=lambda p: math.atan2(p[1] - centre[1], p[0] - centre[0]))).T
        total += abs(float(y @ np.roll(x, -1) - x @ np.roll(y, -1))) / 2 / abs(n[axis]) * (level - np.dot(n, middle)) / 3
    return total


def test_hull_volumes():
    rng = np.random.default_rng(2)
    for _ in range(8):
        cells = np.unique(rng.integers(0, 4, (int(rng.integers(1, 5)), 3)), axis=0)
        assert kernels.hull_size(cells) == pytest.approx(plain_hull_volume(cells))
    assert kernels.hull_size(np.argwhere(np.ones((3, 5, 4)))) == 60


def test_solidity_of_many_regions_in_batches(spark):
    rng = np.random.default_rng(3)
    regions_of = {k: np.unique(rng.integers(0, 5, (int(rng.integers(1, 30)), 3)), axis=0) for k in range(300)}
    df = spark.createDataFrame([(k, *map(int, c)) for k, cells in regions_of.items() for c in cells], "label int, z int, y int, x int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # regions go on over batches
    try:
        got = {r["label"]: r["solidity"] for r in kernels.solidity(df, ["label"], ZYX).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: pytest.approx(len(c) / kernels.hull_size(c)) for k, c in regions_of.items()}


def test_axes_of_an_ellipsoid(spark):
    z, y, x = np.indices((31, 31, 31)) - 15
    cells = np.argwhere((z / 14) ** 2 + (y / 9) ** 2 + (x / 5) ** 2 <= 1)
    r = regions.geometry(cells_of(spark, cells), ["t"], ZYX, (0.5, 0.5, 0.5)).first()
    assert r["axis_major"] == pytest.approx(14, rel=0.03) and r["axis_minor"] == pytest.approx(5, rel=0.05)


def test_a_snake_over_64_tiles_settles_in_few_rounds(spark):
    side = 8  # tiles a side; the snake runs through all of them in turn
    order = [(i, j if i % 2 == 0 else side - 1 - j) for i in range(side) for j in range(side)]
    pairs = [(0, list(a), list(b)) for a, b in itertools.pairwise(order)]
    nodes = spark.createDataFrame([(0, list(a)) for a in order] + [(1, [0, 0])], "t int, node array<int>")
    rounds = []
    got = regions.contracted(nodes, spark.createDataFrame(pairs, "t int, a array<int>, b array<int>"), ["t"], rounds=rounds).collect()
    assert {tuple(r["root"]) for r in got} == {(0, 0)} and len(got) == 65 and len(rounds) <= 8
    assert rounds == sorted(rounds, reverse=True) and rounds[-1] == 0


def test_components_over_tiles_of_a_winding_line(spark):
    cells = [(0, y, x) for y in range(0, 32, 2) for x in range(32)] + [(0, y, 31 if y % 4 == 1 else 0) for y in range(1, 31, 2)] + [(0, 40, 40)]
    df = spark.createDataFrame(cells, "t int, y int, x int")
    got = regions.components_tiled(df, ["t"], ["y", "x"], 4).groupBy("label").agg(F.count("*").alias("n")).collect()
    assert {(r["label"], r["n"]) for r in got} == {(1, len(cells) - 1), (2, 1)}
