"""Queries over the point view: spatial joins, matching, flow, voting, tracks, motility."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.functions.scalar import tidy
from voxframe.operators import spatial, tracking
from voxframe.operators.spatial import shuffled
from voxframe.plans.adapters import POINTS, SERIES, points, series
from voxframe.plans.session import checkpointed
from voxframe.registry import register

YX = ("y", "x")
R = 2.0


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _r6(df, *cols):
    return df.select(*[tidy(F.col(c)).alias(c) if c in cols else c for c in df.columns])


def _p(spark, sf):
    return points(spark, sf).select("t", "id", "y", "x")


def _next(df):
    return df.withColumn("t", (F.col("t") - 1).cast("int"))


_D = "sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2))"
_PAIR = f"pr AS (SELECT a.t, a.id AS pre, b.id AS post, {_D} AS d FROM p a JOIN p b ON b.t = a.t + 1 AND abs(a.y - b.y) <= {R} AND abs(a.x - b.x) <= {R} WHERE {_D} {{op}} {R})"


def _radius(spark, sf, strict):
    pairs = spatial.radius_rows(_p(spark, sf), _next(_p(spark, sf)), ["t"], YX, R, strict)
    return _r6(pairs.select("t", F.col("l_id").alias("pre"), F.col("r_id").alias("post"), "distance"), "distance")


_SEL = "SELECT t, pre, post, round(d + 1e-9, 6) AS distance FROM pr"
register("jon_2_radius_join", lambda s, sf: _radius(s, sf, False), _with(POINTS, _PAIR.format(op="<=")) + _SEL)
register("jon_3_radius_gate_strict", lambda s, sf: _radius(s, sf, True), _with(POINTS, _PAIR.format(op="<")) + _SEL)
register("jon_4_radius_gate_inclusive", lambda s, sf: _radius(s, sf, False), _with(POINTS, _PAIR.format(op="<=")) + _SEL)
register(
    "jon_5_nearest",
    lambda s, sf: _r6(spatial.nearest_within(_p(s, sf), _next(_p(s, sf)), ["t"], YX, R, "id", "id"), "distance"),
    _with(POINTS, _PAIR.format(op="<")) + "SELECT t, pre AS id, post AS nearest_id, round(round(d, 9) + 1e-9, 6) AS distance FROM pr QUALIFY row_number() OVER (PARTITION BY t, pre ORDER BY round(d, 9), post) = 1",
)
register(
    "jon_6_nearest_by_rings",
    lambda s, sf: _r6(spatial.nearest_any(_p(s, sf), _next(_p(s, sf)), ["t"], YX, 2.0, "id", "id"), "distance"),
    _with(POINTS, f"nb AS (SELECT a.t, a.id, min({{'d': round({_D}, 9), 'id': b.id}}) AS b FROM p a JOIN p b ON b.t = a.t + 1 GROUP BY a.t, a.id)") + "SELECT t, id, b.id AS nearest_id, round(b.d + 1e-9, 6) AS distance FROM nb",
)
register(
    "jon_7_nearest_border",
    lambda s, sf: _r6(spatial.nearest_any(_p(s, sf), points(s, sf).where("kind = 'click'").select("t", "id", "y", "x"), ["t"], YX, 4.0, "id", "id").select("t", "id", "distance"), "distance"),
    _with(POINTS) + f"SELECT a.t, a.id, round(min(round({_D}, 9)) + 1e-9, 6) AS distance FROM p a JOIN p b ON a.t = b.t WHERE b.kind = 'click' GROUP BY a.t, a.id",
)


def _boxes(spark, sf, *more):
    r = F.lit(1) + F.col("id") % 3
    low = lambda c: F.greatest(F.floor(F.col(c)) - r, F.lit(0))
    return _p(spark, sf).select("t", F.col("id").alias("node"), low("y").alias("low_y"), (F.floor("y") + r).alias("high_y"), low("x").alias("low_x"), (F.floor("x") + r).alias("high_x"), *more)


_BOX = "bx AS (SELECT t, id AS node, greatest(floor(y) - (1 + id % 3), 0) AS ly, floor(y) + (1 + id % 3) AS hy, greatest(floor(x) - (1 + id % 3), 0) AS lx, floor(x) + (1 + id % 3) AS hx FROM p)"
_VN = "vn AS (SELECT bx.t, node, p.id FROM p JOIN bx ON p.t = bx.t AND p.y BETWEEN ly AND hy AND p.x BETWEEN lx AND hx)"


def _box_edges(spark, sf):
    return spatial.box_rows(_p(spark, sf), _boxes(spark, sf), ["t"], YX, 8).select("t", "node", "id")


register("jon_8_box_join", _box_edges, _with(POINTS, _BOX, _VN) + "SELECT t, node, id FROM vn")
register("prj_24_box_subvolumes", lambda s, sf: spatial.box_counts(_p(s, sf), _boxes(s, sf), ["t"], YX, 8, "node"), _with(POINTS, _BOX, _VN) + "SELECT t, node, count(*) AS n FROM vn GROUP BY ALL")
register("prj_23_roi_bounds", lambda s, sf: _boxes(s, sf).select("t", "node", *[F.col(c).cast("double").alias(c) for c in ("low_y", "high_y", "low_x", "high_x")]), _with(POINTS, _BOX) + "SELECT t, node, ly::double AS low_y, hy::double AS high_y, lx::double AS low_x, hx::double AS high_x FROM bx")
register("prj_22_coords_in_bounds", lambda s, sf: _p(s, sf).where("y >= 10 and y < 50 and x >= 5 and x < 60").select("t", "id"), _with(POINTS) + "SELECT t, id FROM p WHERE y >= 10 AND y < 50 AND x >= 5 AND x < 60")
register("prj_12_physical_coords", lambda s, sf: _r6(_p(s, sf).select("t", "id", (F.col("y") * 0.2).alias("y"), (F.col("x") * 0.3).alias("x")), "y", "x"), _with(POINTS) + "SELECT t, id, round(y * 0.2::double + 1e-9, 6) AS y, round(x * 0.3::double + 1e-9, 6) AS x FROM p")
register(
    "agg_2_voxel_to_node",
    lambda s, sf: spatial.box_join(_p(s, sf).where("id is not null").select("t", "y", "x"), _boxes(s, sf), ["t"], YX, 8).groupBy("t", "node").agg(F.round(F.avg("y") + 1e-7, 5).alias("y_mean"), F.round(F.stddev_pop("y") + 1e-7, 4).alias("y_std_dev"), F.min("y").alias("y_min"), F.max("y").alias("y_max")),
    _with(POINTS, _BOX, _VN) + "SELECT vn.t, node, round(avg(y) + 1e-7, 5) AS y_mean, round(stddev_pop(y) + 1e-7, 4) AS y_std_dev, min(y) AS y_min, max(y) AS y_max FROM vn JOIN p USING (id) GROUP BY vn.t, node",
)

# markers: four statistics and six shape numbers, all functions of the row
_STATS = "[y, x, (id % 7)::double, (id % 11)::double]"
_HU = "[(id % 3)::double, (id % 5)::double, (id % 13)::double, y / 10, x / 10, (id % 2)::double]"


def _markers(spark, sf):
    k = lambda n: (F.col("id") % n).cast("double")
    return _p(spark, sf).select("t", "id", "y", "x", F.array("y", "x", k(7), k(11)).alias("stats"), F.array(k(3), k(5), k(13), F.col("y") / 10, F.col("x") / 10, k(2)).alias("hu"))


_FLAT = (
    f"mk AS (SELECT t, id, y, x, {_STATS} AS st, {_HU} AS hu FROM p)",
    _PAIR.format(op="<"),
    "fl AS (SELECT pr.t, pre, post, d, d / 2.0::double AS z0, " + ", ".join(f"abs(a.st[{i}] - b.st[{i}]) AS z{i}" for i in range(1, 5)) + ", " + ", ".join(f"abs(a.hu[{i}] - b.hu[{i}]) AS z{i + 4}" for i in range(1, 7)) + " FROM pr JOIN mk a ON a.id = pre JOIN mk b ON b.id = post)",
    "zs AS (SELECT t, pre, post, d, " + ", ".join(f"(z{i} - avg(z{i}) OVER (PARTITION BY t)) / (stddev_pop(z{i}) OVER (PARTITION BY t) + 1e-8) AS z{i}" for i in range(11)) + " FROM fl)",
    "co AS (SELECT t, pre, post, d, z0 + (z1 + z2 + z3 + z4) / 4 + (z5 + z6 + z7 + z8 + z9 + z10) / 6 AS cost FROM zs)",
    "mt AS (SELECT t, pre, post, d, cost FROM (SELECT *, row_number() OVER (PARTITION BY t, post ORDER BY round(cost + 1e-9, 6), pre) AS k FROM co) WHERE k = 1 AND round(cost + 1e-9, 6) <= 1 UNION ALL SELECT t, pre, post, d, cost FROM (SELECT *, row_number() OVER (PARTITION BY t, pre ORDER BY round(cost + 1e-9, 6), post) AS k FROM co) WHERE k = 1 AND round(cost + 1e-9, 6) <= 1)",
    "fw AS (SELECT mt.t, pre, post, a.y, a.x, b.y - a.y AS dy, b.x - a.x AS dx, cost FROM mt JOIN p a ON a.id = pre JOIN p b ON b.id = post)",
)


def _gated(spark, sf):
    return tracking.gated_pairs(_markers(spark, sf), YX, R, "stats", "hu", sizes=(4, 6))


def _costs(spark, sf):
    return tracking.pair_costs(_gated(spark, sf), R, 4, 6)


def _matches(spark, sf):
    return tracking.best_matches(_costs(spark, sf))


def _flow(spark, sf):
    return tracking.flow_table(_matches(spark, sf), _markers(spark, sf), YX)


register("jon_20_feature_differences", lambda s, sf: _gated(s, sf).select("t", "pre", "post", F.round(sum((F.get("stat_diff", F.lit(i)) for i in range(4)), F.lit(0.0)) + 1e-9, 5).alias("total")), _with(POINTS, *_FLAT[:3]) + "SELECT t, pre, post, round(z1 + z2 + z3 + z4 + 1e-9, 5) AS total FROM fl")
register("agg_29_zscore", lambda s, sf: _gated(s, sf).groupBy("t").agg(F.round(F.avg("distance") / R + 1e-9, 6).alias("mean"), F.round(F.stddev_pop("distance") / R + 1e-9, 6).alias("std_dev"), F.count("*").alias("n")), _with(POINTS, *_FLAT[:3]) + "SELECT t, round(avg(z0) + 1e-9, 6) AS mean, round(stddev_pop(z0) + 1e-9, 6) AS std_dev, count(*) AS n FROM fl GROUP BY t")
register("agg_30_pair_cost", lambda s, sf: _costs(s, sf).select("t", "pre", "post", F.round(F.col("cost") + 1e-9, 5).alias("cost")), _with(POINTS, *_FLAT[:5]) + "SELECT t, pre, post, round(cost + 1e-9, 5) AS cost FROM co")
register("agg_31_best_matches", lambda s, sf: _matches(s, sf).select("t", "pre", "post"), _with(POINTS, *_FLAT[:6]) + "SELECT t, pre, post FROM mt")
register("set_2_union_all_matches", lambda s, sf: _matches(s, sf).groupBy("t", "pre", "post").agg(F.count("*").alias("times")), _with(POINTS, *_FLAT[:6]) + "SELECT t, pre, post, count(*) AS times FROM mt GROUP BY ALL")
register("opr_5_track_markers", lambda s, sf: _flow(s, sf).select("t", "pre", "post", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("y", "x", "dy", "dx", "cost")]), _with(POINTS, *_FLAT) + "SELECT t, pre, post, " + ", ".join(f"round({c} + 1e-9, 5) AS {c}" for c in ("y", "x", "dy", "dx", "cost")) + " FROM fw")
register("prj_20_flow_to_track_rows", lambda s, sf: _r5(tracking.flow_rows(_flow(s, sf), YX, 0.5), "y", "x"), _with(POINTS, *_FLAT) + "SELECT pre, post, t, round(y + 1e-9, 5) AS y, round(x + 1e-9, 5) AS x FROM fw WHERE cost <= 0.5 UNION ALL SELECT pre, post, t + 1, round(y + dy + 1e-9, 5), round(x + dx + 1e-9, 5) FROM fw WHERE cost <= 0.5")


def _r5(df, *cols):
    return df.select(*[F.round(F.col(c) + 1e-9, 5).alias(c) if c in cols else c for c in df.columns])


def _stride(df, order, k, most):
    from voxframe.operators.kernels import every_kth

    return every_kth(df, order, k, most)


register(
    "prj_19_flow_filter",
    lambda s, sf: _stride(_flow(s, sf).where("cost <= 0.5"), ["t", "pre", "post", "cost"], 3, 200).select("t", "pre", "post"),
    _with(POINTS, *_FLAT) + "SELECT t, pre, post FROM (SELECT *, row_number() OVER (ORDER BY t, pre, post, cost) AS k FROM fw WHERE cost <= 0.5) WHERE k % 3 = 1 ORDER BY k LIMIT 200",
)
register("opr_12_flow_tables", lambda s, sf: _flow(s, sf).groupBy("t").agg(F.count("*").alias("n"), F.countDistinct("pre").alias("origins")), _with(POINTS, *_FLAT) + "SELECT t, count(*) AS n, count(DISTINCT pre) AS origins FROM fw GROUP BY t")
register("win_13_every_kth", lambda s, sf: _stride(_p(s, sf), ["t", "id"], 7, 10**9).select("t", "id"), _with(POINTS) + "SELECT t, id FROM (SELECT *, row_number() OVER (ORDER BY t, id) AS k FROM p) WHERE k % 7 = 1")
register("srt_5_head", lambda s, sf: _p(s, sf).orderBy("t", "id").limit(50).select("t", "id"), _with(POINTS) + "SELECT t, id FROM p ORDER BY t, id LIMIT 50")


# flow with simple costs, so that interpolation is checked apart from matching
def _simple_flow(spark, sf):
    pairs = spatial.nearest_within(_p(spark, sf), _next(_p(spark, sf)), ["t"], YX, R, "id", "id")
    m = pairs.select("t", F.col("id").alias("pre"), F.col("nearest_id").alias("post"), (F.col("distance") - 3).alias("cost"))
    return tracking.flow_table(m, _p(spark, sf), YX)


def _place_flow(spark, sf):
    """The same flow, a row for all that start at one place."""
    return tracking.nearest_flow(_p(spark, sf), YX, R, -3.0)


_SF = (
    _PAIR.format(op="<"),
    "nn AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY t, pre ORDER BY round(d, 9), post) = 1)",
    "fw AS (SELECT nn.t, pre, post, a.y, a.x, b.y - a.y AS dy, b.x - a.x AS dx, round(d, 9) - 3 AS cost FROM nn JOIN p a ON a.id = pre JOIN p b ON b.id = post)",
)


def _interp(name: str, anchors: str, source: str = "p", radius: float = 3.0) -> tuple[str, ...]:
    return (
        f"{name}_n AS (SELECT q.t, q.id, f.dy, f.dx, f.cost, sqrt(pow(q.y - f.ay, 2) + pow(q.x - f.ax, 2)) AS d FROM {source} q JOIN ({anchors}) f ON f.t = q.t AND abs(q.y - f.ay) <= {radius} AND abs(q.x - f.ax) <= {radius} WHERE sqrt(pow(q.y - f.ay, 2) + pow(q.x - f.ax, 2)) <= {radius})",
        f"{name}_w AS (SELECT *, -cost * CASE WHEN min(d) OVER (PARTITION BY t, id) = 0 THEN (d = 0)::int::double ELSE 1 / d END AS w FROM {name}_n)",
        f"{name}_v AS (SELECT *, w - min(w) OVER (PARTITION BY t, id) + 1 AS u FROM {name}_w)",
        f"{name} AS (SELECT t, id, sum(u * dy) / sum(u) AS dy, sum(u * dx) / sum(u) AS dx, count(*) AS neighbours FROM {name}_v GROUP BY t, id)",
    )


_FWD = _interp("fi", "SELECT t, y AS ay, x AS ax, dy, dx, cost FROM fw")
_BWD = _interp("bi", "SELECT t + 1 AS t, y + dy AS ay, x + dx AS ax, dy, dx, cost FROM fw")


def _forward(spark, sf):
    return tracking.interpolate(_p(spark, sf), _place_flow(spark, sf), YX, 3.0, True)


def _backward(spark, sf):
    return tracking.interpolate(_p(spark, sf), _place_flow(spark, sf), YX, 3.0, False)


_V = "SELECT t, id, round(dy + 1e-9, 5) AS dy, round(dx + 1e-9, 5) AS dx, neighbours FROM "
register("agg_34_weighted_flow", lambda s, sf: _r5(_forward(s, sf), "dy", "dx"), _with(POINTS, *_SF, *_FWD) + _V + "fi")
register("opr_6_interpolate_forward", lambda s, sf: _r5(_forward(s, sf), "dy", "dx"), _with(POINTS, *_SF, *_FWD) + _V + "fi")
register("opr_6_interpolate_backward", lambda s, sf: _r5(_backward(s, sf), "dy", "dx"), _with(POINTS, *_SF, *_BWD) + _V + "bi")
register("jon_1_flow_by_frame", lambda s, sf: _simple_flow(s, sf).select("t", "pre").join(_p(s, sf).groupBy("t").agg(F.count("*").alias("n")), "t"), _with(POINTS, *_SF) + "SELECT fw.t, pre, n FROM fw JOIN (SELECT t, count(*) AS n FROM p GROUP BY t) USING (t)")
_KIN = "sqrt(dy * dy + dx * dx) / 2 AS linear_vel, abs(((atan2(x + dx, y + dy) - atan2(x, y) + pi()) - 2 * pi() * floor((atan2(x + dx, y + dy) - atan2(x, y) + pi()) / (2 * pi())) - pi()) / 2) AS angular_vel, abs(sqrt(pow(y + dy, 2) + pow(x + dx, 2)) - sqrt(y * y + x * x)) / (sqrt(pow(y + dy, 2) + pow(x + dx, 2)) + sqrt(y * y + x * x)) AS directionality"


def _motility(spark, sf):
    moved = _forward(spark, sf).join(shuffled(_p(spark, sf)), ["t", "id"])
    return moved.select("t", "id", *tracking.kinematics_2d(moved, 2.0))


register("opr_13_motility", lambda s, sf: _r5(_motility(s, sf), "linear_vel", "angular_vel", "directionality"), _with(POINTS, *_SF, *_FWD, f"kn AS (SELECT fi.t, fi.id, {_KIN} FROM fi JOIN p USING (t, id))") + "SELECT t, id, round(linear_vel + 1e-9, 5) AS linear_vel, round(angular_vel + 1e-9, 5) AS angular_vel, round(directionality + 1e-9, 5) AS directionality FROM kn")
register("win_8_acceleration", lambda s, sf: _r5(tracking.accelerations(_forward(s, sf), _backward(s, sf), YX, 2.0), "linear_acc"), _with(POINTS, *_SF, *_FWD, *_BWD) + "SELECT fi.t, fi.id, round(sqrt(pow((fi.dy - bi.dy) / 2, 2) + pow((fi.dx - bi.dx) / 2, 2)) / 2 + 1e-9, 5) AS linear_acc FROM fi JOIN bi USING (t, id)")
register("agg_9_reference_voxel", lambda s, sf: _r6(tracking.reference_voxels(_forward(s, sf).withColumn("branch", F.col("id") % 10), ["t", "branch"], YX), "displacement"), _with(POINTS, *_SF, *_FWD) + "SELECT t, id % 10 AS branch, id AS ref, round(round(sqrt(dy * dy + dx * dx), 9) + 1e-9, 6) AS displacement FROM fi QUALIFY row_number() OVER (PARTITION BY t, id % 10 ORDER BY round(sqrt(dy * dy + dx * dx), 9), id) = 1")


def _dynamics(spark, sf):
    places = tracking.point_places(_p(spark, sf), YX)
    flows = tracking.place_flows(places, checkpointed(tracking.nearest_flow(places, YX, R, -3.0)), YX, 3.0).drop("id")
    met = spatial.box_join(flows, _boxes(spark, sf, F.col("y").alias("ny"), F.col("x").alias("nx")), ["t"], YX, 8)
    return tracking.met_dynamics(met.withColumns({"vy": F.col("y"), "vx": F.col("x")}), YX)


_LEN = "sqrt(pow(v.y - n.y, 2) + pow(v.x - n.x, 2))"
register(
    "agg_35_node_dynamics",
    lambda s, sf: _r5(_dynamics(s, sf), "divergence", "convergence", "vergere"),
    _with(POINTS, *_SF, *_FWD, *_BWD, _BOX, _VN, f"dyn AS (SELECT vn.t, vn.node, avg(CASE WHEN {_LEN} <> 0 THEN (fi.dy * (v.y - n.y) + fi.dx * (v.x - n.x)) / {_LEN} END) AS divergence, avg(CASE WHEN {_LEN} <> 0 THEN (bi.dy * (v.y - n.y) + bi.dx * (v.x - n.x)) / {_LEN} END) AS convergence FROM vn JOIN p v ON v.id = vn.id JOIN p n ON n.id = vn.node LEFT JOIN fi ON fi.id = vn.id LEFT JOIN bi ON bi.id = vn.id GROUP BY vn.t, vn.node)")
    + "SELECT t, node, round(divergence + 1e-9, 5) AS divergence, round(convergence + 1e-9, 5) AS convergence, round(divergence + convergence + 1e-9, 5) AS vergere FROM dyn",
)
_CAND = (
    f"fc AS (SELECT fi.t, fi.id AS prev, b.id AS next, round(sqrt(pow(a.y + fi.dy - b.y, 2) + pow(a.x + fi.dx - b.x, 2)), 9) AS d FROM fi JOIN p a ON a.id = fi.id JOIN p b ON b.t = fi.t + 1 WHERE sqrt(pow(a.y + fi.dy - b.y, 2) + pow(a.x + fi.dx - b.x, 2)) < {R} QUALIFY row_number() OVER (PARTITION BY fi.id ORDER BY d, b.id) = 1)",
    f"bc AS (SELECT bi.t - 1 AS t, a.id AS prev, bi.id AS next, round(sqrt(pow(b.y - bi.dy - a.y, 2) + pow(b.x - bi.dx - a.x, 2)), 9) AS d FROM bi JOIN p b ON b.id = bi.id JOIN p a ON a.t = bi.t - 1 WHERE sqrt(pow(b.y - bi.dy - a.y, 2) + pow(b.x - bi.dx - a.x, 2)) < {R} QUALIFY row_number() OVER (PARTITION BY bi.id ORDER BY d, a.id) = 1)",
    "cd AS (SELECT * FROM fc UNION ALL SELECT * FROM bc)",
)


def _place_candidates(spark, sf, places):
    flow = checkpointed(tracking.nearest_flow(places, YX, R, -3.0))  # read by both directions
    return tracking.place_candidates(places, flow, YX, 3.0, R)


def _candidates(spark, sf):
    return tracking.candidate_rows(_p(spark, sf), _place_candidates(spark, sf, tracking.point_places(_p(spark, sf), YX)), YX)


def _labels(spark, sf):
    return points(spark, sf).select("t", "id", (F.col("user_id") % 20).cast("int").alias("label"))


def _best_source(spark, sf):
    """The smallest id of a place is met by the ways of all places that lead there; its other points have their own backward way."""
    places = tracking.point_places(_p(spark, sf), YX)
    found = _place_candidates(spark, sf, places)
    best = lambda d, prev: F.struct(F.round(F.col(d) + 1e-9, 5).alias("d"), F.col(prev).alias("prev"))
    met = found.where("next_id is not null").select((F.col("t") + 1).cast("int").alias("t"), F.col("next_y").alias("y"), F.col("next_x").alias("x"), best("next_distance", "id").alias("b"))
    met = met.groupBy("t", *YX).agg(F.min("b").alias("met"))
    own = F.when(F.col("prev_id").isNotNull(), best("prev_distance", "prev_id"))
    ways = places.join(shuffled(found.select("t", *YX, own.alias("own"))), ["t", *YX], "left").join(shuffled(met), ["t", *YX], "left")
    ways = ways.select("t", *YX, F.col("id").alias("spot"), F.least("own", "met").getField("prev").alias("first"), F.col("own.prev").alias("other"))
    rows = _p(spark, sf).where("id is not null").join(shuffled(ways), ["t", *YX])
    return rows.select((F.col("t") - 1).cast("int").alias("t"), F.col("id").alias("next"), F.when(F.col("id") == F.col("spot"), F.col("first")).otherwise(F.col("other")).alias("prev")).where("prev is not null")


register("set_1_candidates", lambda s, sf: _r5(_candidates(s, sf), "distance"), _with(POINTS, *_SF, *_FWD, *_BWD, *_CAND) + "SELECT t, prev, next, round(d + 1e-9, 5) AS distance FROM cd")
register("win_1_best_source", _best_source, _with(POINTS, *_SF, *_FWD, *_BWD, *_CAND) + "SELECT t, next, prev FROM cd QUALIFY row_number() OVER (PARTITION BY t, next ORDER BY round(d + 1e-9, 5), prev) = 1")
_VOTE = "vt AS (SELECT t, next, label, round(sum(1 / (d + 1e-6)), 6) AS w FROM cd JOIN (SELECT id AS prev, (user_id % 20)::int AS label FROM p) USING (prev) WHERE label > 0 AND next IN (SELECT id FROM p WHERE user_id % 20 > 0) GROUP BY ALL)"


def _labelled(spark, sf):
    """Points with label, their places with the label of the smallest id, and the points of each label at a place."""
    rows = points(spark, sf).select("t", "id", "y", "x", (F.col("user_id") % 20).cast("int").alias("label"))
    counts = rows.where("id is not null").dropna(subset=list(YX)).groupBy("t", *YX, "label").agg(F.count("*").alias("n"))
    return rows, tracking.point_places(rows, YX, "label"), checkpointed(counts)


def _votes(spark, sf):
    rows, places, counts = _labelled(spark, sf)
    return rows, places, counts, tracking.place_votes(_place_candidates(spark, sf, places), counts, places, YX)


def _reassign(spark, sf):
    rows, places, _, won = _votes(spark, sf)
    rows = rows.where("label > 0").drop("label").join(shuffled(places.select("t", *YX, F.col("id").alias("spot")).join(shuffled(won), ["t", *YX])), ["t", *YX])
    label = F.when(F.col("id") == F.col("spot"), F.col("spot_label")).otherwise(F.col("other_label"))
    return rows.select((F.col("t") - 1).cast("int").alias("t"), F.col("id").alias("next"), label.alias("label")).where("label is not null")


def _ranking(spark, sf):
    """Points that each label wins, counted by place."""
    _, places, counts, won = _votes(spark, sf)
    own = places.select("t", *YX, F.coalesce(F.col("label") > 0, F.lit(False)).cast("long").alias("own"))
    labelled = counts.where("label > 0").groupBy("t", *YX).agg(F.sum("n").alias("labelled"))
    met = own.join(shuffled(labelled), ["t", *YX]).join(shuffled(won), ["t", *YX])
    both = F.array(F.struct(F.col("spot_label").alias("label"), F.col("own").alias("won")), F.struct(F.col("other_label").alias("label"), (F.col("labelled") - F.col("own")).alias("won")))
    rows = met.select((F.col("t") - 1).cast("int").alias("t"), F.explode(both).alias("c")).select("t", "c.*").where("won > 0 and label is not null")
    return rows.groupBy("t", "label").agg(F.sum("won").alias("won"))


def _ends_labelled(spark, sf):
    """Points with label, the points of each label at a place, and candidates with the labels of the points they lead to (next_label, prev_label)."""
    rows, places, counts = _labelled(spark, sf)
    found = _place_candidates(spark, sf, places).select("t", *YX, *[f"{k}_{c}" for k in ("next", "prev") for c in ("id", *YX)])
    for k, sign in (("next", -1), ("prev", 1)):
        spots = places.select((F.col("t") + sign).cast("int").alias("t"), *[F.col(a).alias(f"{k}_{a}") for a in YX], F.col("label").alias(f"{k}_label"))
        found = found.join(shuffled(spots), ["t", *[f"{k}_{a}" for a in YX]], "left")
    return rows, counts, found.select("t", *YX, "next_id", "next_label", "prev_id", "prev_label")


def _labelled_candidates(spark, sf):
    rows, _, found = _ends_labelled(spark, sf)
    met = rows.where("label > 0 and id is not null").drop("label").join(shuffled(found.where("next_label > 0 or prev_label > 0")), ["t", *YX])
    fwd = F.when(F.col("next_label") > 0, F.struct(F.col("t").alias("t"), F.col("id").alias("prev"), F.col("next_id").alias("next")))
    bwd = F.when(F.col("prev_label") > 0, F.struct((F.col("t") - 1).cast("int").alias("t"), F.col("prev_id").alias("prev"), F.col("id").alias("next")))
    return met.select(F.explode(F.array(fwd, bwd)).alias("c")).where("c is not null").select("c.*")


register("agg_33_weighted_vote", lambda s, sf: _reassign(s, sf).select("t", "next", "label"), _with(POINTS, *_SF, *_FWD, *_BWD, *_CAND, _VOTE) + "SELECT t, next, label FROM vt QUALIFY row_number() OVER (PARTITION BY t, next ORDER BY w DESC, label) = 1")
register("win_2_two_level_ranking", _ranking, _with(POINTS, *_SF, *_FWD, *_BWD, *_CAND, _VOTE) + "SELECT t, label, count(*) AS won FROM (SELECT * FROM vt QUALIFY row_number() OVER (PARTITION BY t, next ORDER BY w DESC, label) = 1) GROUP BY ALL")
register("jon_18_labelled_candidates", _labelled_candidates, _with(POINTS, *_SF, *_FWD, *_BWD, *_CAND) + "SELECT t, prev, next FROM cd WHERE prev IN (SELECT id FROM p WHERE user_id % 20 > 0) AND next IN (SELECT id FROM p WHERE user_id % 20 > 0)")
register(
    "jon_21_label_pair_counts",
    lambda s, sf: _pair_counts(s, sf),
    _with(POINTS, *_SF, *_FWD, *_BWD, *_CAND, "pc AS (SELECT cd.t, (a.user_id % 20)::int AS src, (b.user_id % 20)::int AS dst, count(*) AS n FROM cd JOIN p a ON a.id = prev JOIN p b ON b.id = next GROUP BY ALL)") + "SELECT t, dst, src, n FROM pc QUALIFY row_number() OVER (PARTITION BY t, dst ORDER BY n DESC, src) = 1",
)


def _pair_counts(spark, sf):
    _, counts, found = _ends_labelled(spark, sf)
    c = counts.join(shuffled(found), ["t", *YX])
    fwd = F.when(F.col("next_id").isNotNull(), F.struct(F.col("t").alias("t"), F.col("label").alias("src"), F.col("next_label").alias("dst"), "n"))
    bwd = F.when(F.col("prev_id").isNotNull(), F.struct((F.col("t") - 1).cast("int").alias("t"), F.col("prev_label").alias("src"), F.col("label").alias("dst"), "n"))
    n = c.select(F.explode(F.array(fwd, bwd)).alias("c")).where("c is not null").select("c.*").groupBy("t", "src", "dst").agg(F.sum("n").alias("n"))
    return n.groupBy("t", "dst").agg(F.max(F.struct("n", (-F.col("src")).alias("s"))).alias("b")).select("t", "dst", (-F.col("b.s")).alias("src"), "b.n")


#: Frames 0 .. LAST of the events; the queries read the last one from the table, the oracles write out each step.
LAST = 29


def _last(spark, sf):
    return points(spark, sf).agg(F.max("t")).first()[0] or 0


def _chain(spark, sf):
    rows, places, counts = _labelled(spark, sf)
    chain = tracking.place_chain(_place_candidates(spark, sf, places), places, counts, YX, _last(spark, sf))
    ends = places.select("t", *YX, F.col("id").alias("spot")).join(shuffled(chain), ["t", *YX], "left")
    met = rows.where("t >= 0").join(shuffled(ends), ["t", *YX], "left")
    won = F.when(F.col("id") == F.col("spot"), F.col("spot_label")).when(F.col("label") > 0, F.col("other_label"))
    return met.select("t", "id", F.when(F.col("t") == 0, F.col("label")).otherwise(F.coalesce(won, F.lit(0))).alias("label"))


def _chain_sql() -> str:
    steps = ["cdm AS MATERIALIZED (SELECT * FROM cd)", "l0 AS MATERIALIZED (SELECT id, (user_id % 20)::int AS label FROM p WHERE t = 0)"]
    for t in range(LAST):
        steps.append(f"v{t} AS MATERIALIZED (SELECT next AS id, label, round(sum(1 / (d + 1e-6)), 6) AS w FROM cdm JOIN l{t} q ON q.id = prev WHERE cdm.t = {t} AND label > 0 AND next IN (SELECT id FROM p WHERE user_id % 20 > 0) GROUP BY ALL)")
        steps.append(f"l{t + 1} AS MATERIALIZED (SELECT p.id, coalesce(q.label, 0) AS label FROM p LEFT JOIN (SELECT * FROM v{t} QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1) q ON q.id = p.id WHERE p.t = {t + 1})")
    return _with(POINTS, *_SF, *_FWD, *_BWD, *_CAND, *steps) + " UNION ALL ".join(f"SELECT {t} AS t, id, label FROM l{t}" for t in range(LAST + 1))


register("opr_7_reassign_chain", _chain, _chain_sql())


def _tracks(spark, sf, forward=True, seeds=None):
    """Tracks of the points of the first (last) frame, or of the frames that `seeds` names, up to the other end of the series."""
    last = _last(spark, sf)
    where = seeds if seeds is not None else (F.col("t") == (0 if forward else last))
    return tracking.extend_tracks(_p(spark, sf).where(where), _place_flow(spark, sf), YX, 3.0, last, forward)


def _track_sql(name: str, start: str, forward: bool) -> tuple[str, ...]:
    """CTEs of all steps of the tracks from points of p where `start` holds; `name` is their union."""
    sign, anchors = ("+", "SELECT t, y AS ay, x AS ax, dy, dx, cost FROM fwm") if forward else ("-", "SELECT t + 1 AS t, y + dy AS ay, x + dx AS ax, dy, dx, cost FROM fwm")
    out = [f"{name}0 AS MATERIALIZED (SELECT id, t, y, x FROM p WHERE {start})"]
    for k in range(LAST):
        out += _interp(f"{name}i{k}", anchors, f"{name}{k}")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT q.id, q.t {sign} 1 AS t, q.y {sign} i.dy AS y, q.x {sign} i.dx AS x FROM {name}{k} q JOIN {name}i{k} i USING (id))")
    return (*out, f"{name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(LAST + 1)) + ")")


_FWM = "fwm AS MATERIALIZED (SELECT * FROM fw)"
_T1 = (_FWM, *_track_sql("tk", "t = 0", True))
_B1 = (_FWM, *_track_sql("tk", f"t = {LAST}", False))
_TRACK = "SELECT id AS track_id, t, round(y + 1e-9, 4) AS y, round(x + 1e-9, 4) AS x, t AS frame_num FROM tk"
register("opr_10_extend_forward", lambda s, sf: _r4(_tracks(s, sf), "y", "x"), _with(POINTS, *_SF, *_T1) + _TRACK)


def _r4(df, *cols):
    return df.select(*[F.round(F.col(c) + 1e-9, 4).alias(c) if c in cols else c for c in df.columns])


register("opr_10_extend_backward", lambda s, sf: _r4(_tracks(s, sf, False), "y", "x"), _with(POINTS, *_SF, *_B1) + _TRACK)


def _cells(spark, sf):
    return _p(spark, sf).select("t", F.floor("y").alias("y"), F.floor("x").alias("x"), F.lit(1).alias("label"))


_HITS = "hit AS (SELECT tk.* FROM tk WHERE EXISTS (SELECT 1 FROM p WHERE p.t = tk.t AND floor(p.y) = round_even(tk.y, 0) AND floor(p.x) = round_even(tk.x, 0)))"
register("jon_19_label_hits", lambda s, sf: tracking.label_hits(_tracks(s, sf), _cells(s, sf), YX).select("track_id", "t"), _with(POINTS, *_SF, *_T1, _HITS) + "SELECT id AS track_id, t FROM hit")
register("opr_9_label_tracks", lambda s, sf: tracking.label_hits(_tracks(s, sf), _cells(s, sf), YX).groupBy("track_id").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")), _with(POINTS, *_SF, *_T1, _HITS) + "SELECT id AS track_id, count(*) AS n, min(t) AS first, max(t) AS last FROM hit GROUP BY id")
#: Seeds of all frames go forward at once; a frame's tracks are numbered behind those of the frames before it.
register(
    "opr_11_all_frame_tracks",
    lambda s, sf: tracking.numbered_tracks(_tracks(s, sf, True, F.lit(True))).select("number", "track_id", "t"),
    _with(POINTS, *_SF, _FWM, *_track_sql("tk", "true", True), "nb AS (SELECT id, row_number() OVER (ORDER BY min(t), id) - 1 AS number FROM tk GROUP BY id)") + "SELECT number, id AS track_id, t FROM tk JOIN nb USING (id)",
)
register("srt_4_backward_first", lambda s, sf: _r4(_tracks(s, sf, False).orderBy("track_id", "t"), "y", "x").select("track_id", "t", "y"), _with(POINTS, *_SF, *_B1) + "SELECT id AS track_id, t, round(y + 1e-9, 4) AS y FROM tk ORDER BY 1, 2")


def _both_ways(spark, sf):
    last = _last(spark, sf)
    middle = F.col("t") == last // 2
    back = _tracks(spark, sf, False, middle).where(F.col("t") < last // 2)
    return back.select("track_id", "t").unionByName(_tracks(spark, sf, True, middle).select("track_id", "t"))


_MIDDLE = LAST // 2
register(
    "set_7_tracks_both_ways",
    _both_ways,
    _with(POINTS, *_SF, _FWM, *_track_sql("bk", f"t = {_MIDDLE}", False), *_track_sql("tk", f"t = {_MIDDLE}", True)) + f"SELECT id AS track_id, t FROM bk WHERE t < {_MIDDLE} UNION ALL SELECT id, t FROM tk",
)
register("set_6_concat_frames", lambda s, sf: _place_flow(s, sf).groupBy("t").agg(F.sum("_copies").alias("n")), _with(POINTS, *_SF) + "SELECT t, count(*) AS n FROM fw GROUP BY t")
register(
    "win_9_time_differences",
    lambda s, sf: _diffs(s, sf).select("user_id", "id", "diff"),
    _with(SERIES) + "SELECT user_id, id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, id) AS diff FROM s",
)


def _diffs(spark, sf):
    from voxframe.sources.metadata import time_differences

    return time_differences(series(spark, sf), ["user_id"], "s", "id")


register("src_7_median_interval", lambda s, sf: _diffs(s, sf).groupBy("user_id").agg(F.median("diff").alias("dt")), _with(SERIES, "d AS (SELECT user_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, id) AS diff FROM s)") + "SELECT user_id, median(diff) AS dt FROM d GROUP BY user_id")
