"""Pairs of near points are added up where they are made: no shuffle and no window has pairs below it."""

import math
import random

import pytest

from voxframe.operators import tracking
from voxframe.plans.session import checkpointed


def shuffled_joins(df) -> list[str]:
    """Lines of joins that lie below a shuffle in df's plan, and of windows."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    out = [line for line in lines if "Window [" in line]
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line:
            for below in lines[i + 1 :]:
                if depth(below) <= depth(line):
                    break
                out += [below] if "Join " in below else []
    return out


def test_interpolation_adds_up_in_the_cell(spark):
    rng = random.Random(2)
    places = [(t, rng.randrange(40) / 4, rng.randrange(40) / 4) for t in range(2) for _ in range(150)]
    places = sorted(set(places))
    anchors = [(t, rng.randrange(40) / 4, rng.randrange(40) / 4, rng.random(), rng.random(), -rng.random()) for t in range(2) for _ in range(200)]
    points = spark.createDataFrame([(t, i, y, x) for i, (t, y, x) in enumerate(places)], "t int, id long, y double, x double")
    flow = spark.createDataFrame(anchors + anchors[:50], "t int, y double, x double, dy double, dx double, cost double")
    mean = tracking._means(points.select("t", "y", "x"), flow, ("y", "x"), 1.5, True, ("t",))
    assert shuffled_joins(mean) == []
    got = {r["id"]: r for r in tracking.interpolate(points, flow, ("y", "x"), 1.5).collect()}
    for i, (t, y, x) in enumerate(places):
        near = [(math.hypot(y - a[1], x - a[2]), a) for a in anchors + anchors[:50] if a[0] == t]
        near = [(d, a) for d, a in near if d <= 1.5]
        if not near:
            assert i not in got
            continue
        same = min(d for d, _ in near) == 0
        w = [-a[5] * (float(d == 0) if same else 1 / d) for d, a in near]
        u = [v - min(w) + 1 for v in w]
        assert got[i]["neighbours"] == len(near)
        assert got[i]["dy"] == pytest.approx(sum(v * a[3] for v, (_, a) in zip(u, near, strict=True)) / sum(u))


def test_candidates_of_places_are_those_of_rows(spark):
    rng = random.Random(5)
    at = [(t, rng.randrange(60) / 10, rng.randrange(60) / 10) for t in range(3) for _ in range(40)]
    points = spark.createDataFrame([(t, 1000 * k + i, y, x) for k in range(3) for i, (t, y, x) in enumerate(at)], "t int, id long, y double, x double")
    axes = ("y", "x")
    places = tracking.point_places(points, axes)
    flow = checkpointed(tracking.nearest_flow(places, axes, 2.0, -3.0))
    fw, bw = [tracking.interpolate(points, flow, axes, 3.0, forward) for forward in (True, False)]
    by_row = tracking.voxel_candidates(points, fw, bw, axes, 2.0)
    by_place = tracking.place_candidates(places, flow, axes, 3.0, 2.0)
    assert by_place.count() <= places.count()  # of three times as many rows
    rows = lambda df: sorted((r["t"], r["prev"], r["next"], round(r["distance"], 6)) for r in df.collect())
    assert rows(tracking.candidate_rows(points, by_place, axes)) == rows(by_row)
    labels = points.selectExpr("t", "id", "y", "x", "cast(id % 4 AS int) AS label")
    counts = labels.groupBy("t", *axes, "label").count().withColumnRenamed("count", "n")
    spots = tracking.point_places(labels, axes, "label")
    chain = tracking.place_chain(by_place, spots, counts, axes, 2)
    ends = spots.selectExpr("t", "y", "x", "id AS spot").join(chain, ["t", *axes])
    got = labels.join(ends, ["t", *axes]).selectExpr("t", "id", "CASE WHEN id = spot THEN spot_label WHEN label > 0 THEN other_label ELSE 0 END AS label")
    want = tracking.reassign_chain(by_row, labels.select("t", "id", "label")).where("t > 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("t", "id", "label").collect()))


@pytest.mark.parametrize("name", ["agg_2_voxel_to_node", "agg_35_node_dynamics"])
def test_boxes_and_points_are_added_up_where_they_meet(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    met = plan.count("Join ")
    assert met == (1 if name == "agg_2_voxel_to_node" else 7)  # the boxes'; and two for each flow and one for its places: none by id


def test_voting_queries_join_places_not_candidates(spark):
    import __spark_entry__ as entry

    for name, most in (("win_2_two_level_ranking", 0), ("jon_21_label_pair_counts", 0)):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("events.parquet") <= most  # rows are counted by place once, and written


def test_costs_do_not_shuffle_pairs(spark):
    gated = spark.createDataFrame([(t, p, q, 0.5, [float(p)], [float(q)]) for t in range(2) for p in range(5) for q in range(5)], "t int, pre long, post long, distance double, stat_diff array<double>, hu_diff array<double>")
    plan = tracking.pair_costs(gated, 1.0, 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
