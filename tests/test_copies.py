"""Joins of points many of which lie at one place, against plain loops: what is shuffled is lists of rows, not rows for each pair."""

import itertools

import numpy as np
import pytest

from voxframe import registry
from voxframe.operators import spatial

SF = "/root/testdata/sf0.001"


def rows(rng, n, first):
    """(t, id, y, x) at few places; the last ones have no place."""
    at = rng.integers(0, 6, (n, 2)) * 0.7 - 2
    return [(int(rng.integers(0, 2)), first + i, float(y), float(x)) for i, (y, x) in enumerate(at)] + [(0, first + n, None, 1.0), (1, first + n + 1, float("nan"), 1.0)]


def near(p, q, radius, strict):
    if p[0] != q[0] or None in (*p, *q):
        return False
    d = np.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2)
    return d < radius if strict else d <= radius


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("radius", [0.7, 1.4, 5.0])
def test_radius_rows(spark, monkeypatch, radius, strict):
    monkeypatch.setattr(spatial, "LIST", 3)  # places of more rows have several lists
    rng = np.random.default_rng(5)
    left, right = rows(rng, 60, 0), rows(rng, 50, 100)
    make = lambda x: spark.createDataFrame(x, "t int, id long, y double, x double")
    got = spatial.radius_rows(make(left), make(right), ["t"], ("y", "x"), radius, strict)
    assert got.columns == ["t", "l_id", "l_y", "l_x", "r_id", "r_y", "r_x", "distance"]
    want = sorted((p[1], q[1]) for p, q in itertools.product(left, right) if near(p, q, radius, strict))
    assert sorted((r["l_id"], r["r_id"]) for r in got.collect()) == want
    plain = spatial.radius_join(make(left), make(right), ["t"], ("y", "x"), radius, strict)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.select(got.columns).collect()))


def test_box_rows(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LIST", 3)
    rng = np.random.default_rng(6)
    left = rows(rng, 60, 0)
    boxes = [(t, i, y, y + 1.4, x, x + 2.1) for t, i, y, x in rows(rng, 40, 100) if y is not None]
    points = spark.createDataFrame(left, "t int, id long, y double, x double")
    held = spark.createDataFrame(boxes, "t int, node long, low_y double, high_y double, low_x double, high_x double")
    got = spatial.box_rows(points, held, ["t"], ("y", "x"), 2)
    plain = spatial.box_join(points, held, ["t"], ("y", "x"), 2)
    assert got.count() == plain.dropna().count() > 100
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.dropna().select(got.columns).collect()))


@pytest.mark.parametrize("name", ["jon_2_radius_join", "jon_3_radius_gate_strict", "jon_4_radius_gate_inclusive", "jon_8_box_join", "jon_20_feature_differences", "agg_31_best_matches"])
def test_pairs_are_made_from_lists(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = max(i for i, line in enumerate(plan) if "Join Inner" in line and "_cy" in line)
    assert sum("Generate explode(_" in line for line in plan[:join]) >= 2, plan
    assert sum("collect_list" in line for line in plan[join:]) == 2, plan
