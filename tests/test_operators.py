import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import moments, thresholds
from voxframe.operators import features, kernels, network, regions, spatial, stats, stencil, tracking
from voxframe.plans.adapters import raster

YX = ("y", "x")


def cells(spark, mask, t=0):
    return spark.createDataFrame([(t, int(y), int(x)) for y, x in np.argwhere(mask)], "t int, y int, x int")


def test_five_stats_ignore_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, math.nan), (2, 4.0), (3, math.nan)], "g int, v double")
    got = {r["g"]: r for r in stats.five_stats(df, ["g"], ["v"]).collect()}
    assert (got[1]["v_mean"], got[1]["v_std_dev"], got[1]["v_min"], got[1]["v_max"], got[1]["v_sum"]) == (1.5, 0.5, 1.0, 2.0, 3.0)
    assert (got[2]["v_mean"], got[2]["v_std_dev"], got[2]["v_sum"]) == (4.0, 0.0, 4.0)
    assert got[3]["v_mean"] is None and got[3]["v_sum"] == 0.0


def test_log_hu_is_finite(spark):
    df = spark.createDataFrame([(0.0,), (1e-12,), (-1e-6,), (-0.0,)], "h double")
    got = [r[0] for r in df.select(moments.signed_log(F.col("h"))).collect()]
    assert got == [0.0, 12.0, -6.0, 0.0]


def test_labels_restart_each_frame(spark):
    mask = np.zeros((5, 5), bool)
    mask[1:4, 1:4] = True
    both = cells(spark, mask, 0).unionByName(cells(spark, mask, 1))
    got = regions.components(both, ["t"], ["y", "x"]).groupBy("t").agg(F.max("label"), F.count("*")).collect()
    assert {tuple(r) for r in got} == {(0, 1, 9), (1, 1, 9)}


def test_tiled_components_equal_whole_ones(spark):
    rng = np.random.default_rng(3)
    frames = cells(spark, rng.random((17, 19)) < 0.4).unionByName(cells(spark, rng.random((17, 19)) < 0.5, 1))
    whole = {tuple(r) for r in regions.components(frames, ["t"], ["y", "x"]).collect()}
    tiled = {tuple(r) for r in regions.components_tiled(frames, ["t"], ["y", "x"], 5).collect()}
    assert whole == tiled


def test_components_in_3d(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 1), (0, 3, 3, 3)], "t int, z int, y int, x int")
    assert sorted(r["label"] for r in regions.components(df, ["t"], ["z", "y", "x"]).collect()) == [1, 1, 2]


def test_border_is_the_cross_shell_outside(spark):
    mask = np.zeros((7, 7), bool)
    mask[2:5, 2:5] = True
    m = cells(spark, mask)
    b = stencil.border(m, ["t"], YX, {"y": 7, "x": 7})
    assert b.count() == 12 and b.join(m, ["t", *YX]).count() == 0


def test_markers_peak_in_the_middle(spark):
    rows = [(0, y, x, 10.0 if (y, x) == (4, 4) else 0.0) for y in range(9) for x in range(9)]
    df = spark.createDataFrame(rows, "t int, y int, x int, v double")
    got = stencil.local_maxima(df, ["t"], YX, "v", 2).collect()
    assert [(r["y"], r["x"]) for r in got] == [(4, 4)]


def test_pixel_classes_of_a_line(spark):
    line = spark.createDataFrame([(0, 0, x) for x in range(4)] + [(0, 5, 5)], "t int, y int, x int")
    got = {(r["y"], r["x"]): r["pixel_class"] for r in stencil.pixel_class(line, ["t"], YX).collect()}
    assert got == {(0, 0): 2, (0, 1): 3, (0, 2): 3, (0, 3): 2, (5, 5): 1}


def test_radius_join_equals_cross_join(spark):
    rng = np.random.default_rng(5)
    rows = [(0, i, float(y), float(x)) for i, (y, x) in enumerate(rng.random((60, 2)) * 20)]
    df = spark.createDataFrame(rows, "t int, id int, y double, x double")
    got = {(r["l_id"], r["r_id"]) for r in spatial.radius_join(df, df, ["t"], YX, 3.0, strict=True).collect()}
    want = {(a[1], b[1]) for a in rows for b in rows if math.dist(a[2:], b[2:]) < 3.0}
    assert got == want


def test_radius_bounds(spark):
    a, b = spark.createDataFrame([(0, 1, 0.0, 0.0)], "t int, id int, y double, x double"), spark.createDataFrame([(0, 2, 3.0, 4.0)], "t int, id int, y double, x double")
    assert spatial.radius_join(a, b, ["t"], YX, 5.0).count() == 1
    assert spatial.radius_join(a, b, ["t"], YX, 5.0, strict=True).count() == 0


def test_nearest_any_reaches_far_points(spark):
    left = spark.createDataFrame([(0, 1, 0.0, 0.0), (1, 2, 0.0, 0.0)], "t int, id int, y double, x double")
    right = spark.createDataFrame([(0, 7, 100.0, 0.0), (0, 8, 0.0, 300.0)], "t int, id int, y double, x double")
    got = spatial.nearest_any(left, right, ["t"], YX, 1.0, "id", "id").collect()
    assert [(r["id"], r["nearest_id"], r["distance"]) for r in got] == [(1, 7, 100.0)]


def test_box_join_includes_both_ends(spark):
    p = spark.createDataFrame([(0, i, y, 0) for i, y in enumerate((0, 1, 5, 6))], "t int, id int, y int, x int")
    box = spark.createDataFrame([(0, 9, 1, 5, 0, 0)], "t int, node int, low_y int, high_y int, low_x int, high_x int")
    assert sorted(r["id"] for r in spatial.box_join(p, box, ["t"], YX, 2).collect()) == [1, 2]


def test_matches_keep_mutual_bests_twice(spark):
    m = [(t, i, y + 0.1 * t, x, [1.0 * i, 2.0], [float(i)] * 6) for t in (0, 1) for i, (y, x) in enumerate([(0.0, 0.0), (100.0, 100.0)])]
    df = spark.createDataFrame(m, "t int, id int, y double, x double, stats array<double>, hu array<double>")
    costs = tracking.pair_costs(tracking.gated_pairs(df, YX, 5.0, "stats", "hu"), 5.0, 2, 6)
    got = sorted((r["pre"], r["post"]) for r in tracking.best_matches(costs).collect())
    assert got == [(0, 0), (0, 0), (1, 1), (1, 1)]


def test_interpolation_takes_coincident_anchors_alone(spark):
    flow = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 0.0, -1.0), (0, 1.0, 0.0, 9.0, 9.0, -1.0)], "t int, y double, x double, dy double, dx double, cost double")
    at = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 50.0, 50.0)], "t int, id int, y double, x double")
    got = tracking.interpolate(at, flow, YX, 2.0).collect()
    # weights 1 and 0 are raised by 1, as the least weight becomes 1
    assert [(r["id"], round(r["dy"], 6)) for r in got] == [(1, round((2 * 1.0 + 1 * 9.0) / 3, 6))]


def test_vote_takes_the_smaller_label_on_a_tie(spark):
    c = spark.createDataFrame([(0, 5, 2, 1.0), (0, 5, 1, 1.0), (0, 6, 3, 0.1), (0, 6, 1, 1.0)], "t int, next int, label int, d double")
    assert {(r["next"], r["label"]) for r in tracking.vote(c, ["t"], "next", "label", "d").collect()} == {(5, 1), (6, 3)}


def test_branch_of_one_node_and_of_a_line(spark):
    rows = [(0, 1, 0, x, 1.0) for x in range(3)] + [(0, 2, 9, 9, 0.5)]
    nodes = spark.createDataFrame(rows, "t int, branch int, y int, x int, r double")
    got = {r["branch"]: r for r in network.branch_geometry(nodes, ["t"], "branch", YX, (1.0, 1.0), "r").collect()}
    assert (got[1]["length"], got[1]["thickness"], got[1]["tortuosity"]) == (4.0, 2.0, 2.0)
    assert (got[2]["length"], got[2]["thickness"], got[2]["tortuosity"]) == (1.0, 1.0, 1.0)


def test_thinning_keeps_a_connected_line():
    mask = np.zeros((9, 20))
    mask[3:6, 2:18] = 1
    thin = kernels.Thinning()(mask)
    assert thin.sum() < mask.sum() / 2 and regions.label_grid(thin > 0).max() == 1 and (thin <= mask).all()


def test_gaussian_keeps_mass_and_log_finds_blobs():
    image = np.zeros((21, 21))
    image[10, 10] = 1
    assert abs(kernels.Gaussian((1.0, 2.0))(image).sum() - 1) < 1e-9
    assert kernels.LogPeaks((1.0, 2.0))(kernels.smooth(image, 1.5))[10, 10] == 1


def test_solidity_of_a_square_and_an_ell(spark):
    rows = [(1, y, x) for y in range(3) for x in range(3)] + [(2, y, 0) for y in range(4)] + [(2, 3, x) for x in range(1, 4)]
    got = {r["label"]: r["solidity"] for r in kernels.solidity(spark.createDataFrame(rows, "label int, y int, x int"), ["label"]).collect()}
    assert got[1] == 1.0 and got[2] < 0.7


def test_otsu_splits_two_levels(spark):
    df = spark.createDataFrame([(0, v) for v in [0.0] * 10 + [1.0] * 10], "t int, v double")
    bar = thresholds.otsu(df, ["t"], "v", 16).first()["threshold"]
    assert 0 < bar < 1


def test_overlay_averages_over_parents(spark):
    edges = spark.createDataFrame([(0, 1, 10), (0, 1, 11), (0, 2, 10)], "t int, src int, dst int")
    table = spark.createDataFrame([(0, 10, 1.0), (0, 11, 3.0)], "t int, label int, v double")
    assert {(r["src"], r["v"]) for r in features.overlay(edges, table, "v").collect()} == {(1, 2.0), (2, 1.0)}


def test_mode_takes_the_smallest(spark):
    df = spark.createDataFrame([(0, 1, v) for v in (3, 2, 3, 2, 9)], "t int, b int, q int")
    assert features.reassigned_label(df, "b", "q").first()["reassigned_label"] == 2


def test_filters_reach_the_scan(spark):
    plan = raster(spark, "/root/testdata/sf0.001").where("t = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "vec_id" in plan and "label" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("column,want", [("intensity_mean", ("intensity", "mean")), ("x_std_dev", ("x", "std_dev")), ("area", ("area", "raw"))])
def test_split_name(column, want):
    assert features.split_name(column) == want


def test_quantiles_of_groups_are_exact_and_held_by_no_task(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 900), rng.integers(0, 200, 900), strict=True)] + [(7, 1.5), (8, None)]
    found = stats.quantiles(spark.createDataFrame(rows, "g int, v double").repartition(5), ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.98})
    got = {r["g"]: (r["n"], r["a"], r["b"], r["c"]) for r in found.collect()}
    want = {g: [v for h, v in rows if h == g and v is not None] for g in (0, 1, 2, 7)}
    assert got == {g: (len(v), *[pytest.approx(float(np.quantile(v, p))) for p in (0.01, 0.5, 0.98)]) for g, v in want.items()}
    assert "percentile" not in found._jdf.queryExecution().toString().lower()
