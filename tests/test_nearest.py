"""Nearest rows at any distance, against NumPy: crowds far apart, groups of all sizes, ties."""

import numpy as np
import pytest

from voxframe.operators import spatial, tracking


def near(spark, left, right, cell, axes=("y", "x")):
    columns = "t int, id int, " + ", ".join(f"{a} double" for a in axes)
    rows = lambda points: [(t, i, *map(float, p)) for t, i, p in points]
    out = spatial.nearest_any(spark.createDataFrame(rows(left), columns), spark.createDataFrame(rows(right), columns), ["t"], axes, cell, "id", "id")
    return {(r["t"], r["id"]): (r["nearest_id"], r["distance"]) for r in out.collect()}, out


def plain(left, right):
    out = {}
    for t, i, p in left:
        found = [(round(float(np.sqrt(((q - p) ** 2).sum())), 9), j) for u, j, q in right if u == t]
        if found:
            d, j = min(found)
            out[t, i] = j, pytest.approx(d)
    return out


@pytest.mark.parametrize("dims", [2, 3])
def test_groups_of_all_sizes(spark, dims):
    rng = np.random.default_rng(dims)
    axes = ("z", "y", "x")[-dims:]
    left = [(t, i, rng.normal(size=dims) * 10.0 ** rng.integers(-1, 4)) for t in range(4) for i in range(25)]
    right = [(t, i, rng.normal(size=dims) * 10.0 ** rng.integers(-1, 4) - 50) for t, n in ((0, 40), (1, 1), (2, 7)) for i in range(n)]
    assert near(spark, left, right, 1.0, axes)[0] == plain(left, right)


def test_ties_take_the_smaller_id(spark):
    square = [(0, i, np.array(p, float)) for i, p in enumerate([(100, 0), (0, 100), (-100, 0), (0, -100)], 5)]
    assert near(spark, [(0, 1, np.zeros(2))], square[::-1], 1.0)[0] == {(0, 1): (5, 100.0)}


def test_a_far_crowd_is_met_at_its_near_side(spark, monkeypatch):
    rng = np.random.default_rng(1)
    left = [(0, i, p) for i, p in enumerate(rng.uniform(0, 100, (3000, 2)))]
    right = [(0, i, p + 50_000) for i, p in enumerate(rng.uniform(0, 100, (3000, 2)))]
    written, keep = [], spatial.checkpointed
    monkeypatch.setattr(spatial, "checkpointed", lambda df: written.append(keep(df)) or written[-1])
    monkeypatch.setattr(spatial, "drop", lambda df: None)
    got, _ = near(spark, left, right, 2.0)
    r = np.array([q for _, _, q in right])
    assert got == {(0, i): (int(((r - p) ** 2).sum(axis=1).argmin()), pytest.approx(float(np.sqrt(((r - p) ** 2).sum(axis=1).min())))) for _, i, p in left}
    assert max(df.count() for df in written) < 40 * 3000  # of 9,000,000 pairs


@pytest.fixture
def joined(monkeypatch):
    """What the radius joins of a test return."""
    made, join = [], spatial.radius_join
    keep = lambda *a, **k: made.append(join(*a, **k)) or made[-1]
    monkeypatch.setattr(spatial, "radius_join", keep)
    monkeypatch.setattr(tracking, "radius_join", keep)
    monkeypatch.setattr(spatial, "drop", lambda df: None)
    return made


def test_copies_of_points_are_searched_once(spark, joined):
    rng = np.random.default_rng(4)
    at = rng.uniform(0, 20, (30, 2))
    points = [(0, 30 * k + i, p) for k in range(20) for i, p in enumerate(at)]
    got, _ = near(spark, points, [(t, i + 5, p + 0.25) for t, i, p in points], 2.0)
    assert got == plain(points, [(t, i + 5, p + 0.25) for t, i, p in points])
    assert sum(df.count() for df in joined) < 30 * 30  # of 360,000 pairs of copies


def test_crowds_are_searched_within_small_radii_first(spark, joined):
    rng = np.random.default_rng(6)
    left = [(0, i, p) for i, p in enumerate(rng.uniform(0, 10, (1500, 2)))]
    right = [(0, i, p) for i, p in enumerate(rng.uniform(0, 10, (1500, 2)))]
    assert near(spark, left, right, 4.0)[0] == plain(left, right)
    assert sum(df.count() for df in joined) < 60 * 1500  # of more than 750,000 within the radius


def test_the_spread_side_of_a_radius_join_is_not_broadcast(spark):
    rows = spark.range(1000).selectExpr("0 as t", "id", "rand(1) * 9 as y", "rand(2) * 9 as x")
    plan = spatial.radius_join(rows, rows, ["t"], ("y", "x"), 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_copies_of_a_seed_share_their_way(spark, joined):
    flow = [(t, 0.5 * t + i * 9.0, 1.0, 0.5, 0.0, -1.0) for t in range(4) for i in range(3) for _ in range(10)]
    flow = spark.createDataFrame(flow, "t int, y double, x double, dy double, dx double, cost double")
    seeds = spark.createDataFrame([(3 * k + i, 0, i * 9.0, 1.0) for k in range(10) for i in range(3)], "id long, t int, y double, x double")
    got = {(r["track_id"], r["t"]): (r["y"], r["x"]) for r in tracking.extend_tracks(seeds, flow, ("y", "x"), 2.0, 4).collect()}
    assert got == {(3 * k + i, t): (i * 9.0 + 0.5 * t, 1.0) for k in range(10) for i in range(3) for t in range(5)}
    assert sum(df.count() for df in joined) == 3 * 4  # of 1,200 pairs of copies


def test_seeds_of_one_id_in_two_frames_keep_apart(spark):
    flow = spark.createDataFrame([(t, float(t), 0.0, 1.0, 0.0, -1.0) for t in range(3)], "t int, y double, x double, dy double, dx double, cost double")
    seeds = spark.createDataFrame([(7, 0, 0.0, 0.0), (7, 1, 40.0, 0.0)], "id long, t int, y double, x double")
    got = sorted((r["t"], r["y"]) for r in tracking.extend_tracks(seeds, flow, ("y", "x"), 2.0, 2).collect())
    assert got == [(0, 0.0), (1, 1.0), (1, 40.0), (2, 2.0)]


def test_boxes_count_the_points_that_copies_stand_for(spark, monkeypatch):
    met, join = [], spatial.box_join
    monkeypatch.setattr(spatial, "box_join", lambda *a: met.append(join(*a)) or met[-1])
    points = spark.createDataFrame([(0, 20 * k + i, i * 1.0, 0.5) for k in range(30) for i in range(20)], "t int, id int, y double, x double")
    boxes = points.selectExpr("t", "id as node", "y - 1 as low_y", "y + 1 as high_y", "x - 1 as low_x", "x + 1 as high_x")
    got = {r["node"]: r["n"] for r in spatial.box_counts(points, boxes, ["t"], ("y", "x"), 8, "node").collect()}
    assert got == {20 * k + i: 30 * (2 if i in (0, 19) else 3) for k in range(30) for i in range(20)}
    assert met[0].count() == 58  # of 52,200 pairs of copies


def test_flow_joins_places_and_stands_for_rows(spark, joined):
    rng = np.random.default_rng(8)
    at = {t: rng.uniform(0, 12, (20, 2)) for t in range(3)}
    points = [(t, 20 * k + i, *map(float, p)) for t, own in at.items() for k in range(15) for i, p in enumerate(own)]
    df = spark.createDataFrame([*points, (0, None, 1.0, 1.0)], "t int, id long, y double, x double")
    flow = tracking.nearest_flow(df, ("y", "x"), 2.0, -3.0)
    want = {}
    for t in (0, 1):
        for p in at[t]:
            d, j = min((round(float(np.sqrt(((q - p) ** 2).sum())), 9), j) for j, q in enumerate(at[t + 1]))
            if d < 2:
                want[t, *p] = (*(at[t + 1][j] - p), pytest.approx(d - 3), 15)
    assert {(r["t"], r["y"], r["x"]): (r["dy"], r["dx"], r["cost"], r["_copies"]) for r in flow.collect()} == want
    assert sum(df.count() for df in joined) < 20 * 40  # of 180,000 pairs of copies
    rows = flow.selectExpr("*", "explode(sequence(1, _copies)) AS k").drop("_copies", "k")
    for forward in (True, False):
        key = lambda r: (r["t"], r["id"], r["neighbours"], round(r["dy"], 9), round(r["dx"], 9))
        by_place, by_row = ({key(r) for r in tracking.interpolate(df, f, ("y", "x"), 3.0, forward).collect()} for f in (flow, rows))
        assert by_place == by_row
