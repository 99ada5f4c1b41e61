"""Queries over the raster view: thresholds, stencils, components, region geometry, moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import moments, thresholds
from voxframe.functions.scalar import tidy
from voxframe.operators import kernels, network, regions, stats, stencil
from voxframe.plans.adapters import RASTER, raster, volume
from voxframe.registry import register

BINS = 16
SHAPE = {"y": 8, "x": 8}
YX = ("y", "x")
#: Least vesselness values of the raster: a dense object mask and a thin one standing for its skeleton.
MASK, SKELETON = 0.05, 0.15

_HIST = f"""
ends AS (SELECT t, min(v) AS low, max(v) AS high FROM src GROUP BY t),
cnt AS (SELECT s.t, least(floor((v - low) / (high - low) * {BINS}), {BINS - 1})::int AS bin, count(*) AS n FROM src s JOIN ends USING (t) GROUP BY 1, 2),
hist AS (SELECT e.t, b.bin::int AS bin, coalesce(n, 0) AS n, low, (high - low) / {BINS} AS width
  FROM ends e CROSS JOIN range({BINS}) b(bin) LEFT JOIN cnt ON cnt.t = e.t AND cnt.bin = b.bin)"""
_OTSU = f"""{_HIST},
cum AS (SELECT t, bin, low + (bin + 0.5) * width AS c,
  sum(n) OVER up AS w1, sum(n) OVER dn AS w2, sum(n * (low + (bin + 0.5) * width)) OVER up AS s1, sum(n * (low + (bin + 0.5) * width)) OVER dn AS s2
  FROM hist WINDOW up AS (PARTITION BY t ORDER BY bin ROWS UNBOUNDED PRECEDING), dn AS (PARTITION BY t ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
otsu AS (SELECT t, c AS threshold FROM (SELECT t, c, row_number() OVER (PARTITION BY t ORDER BY round(w1::double * w2 * pow(s1 / w1 - s2 / w2, 2), 9) DESC, bin) AS k FROM cum WHERE w1 > 0 AND w2 > 0) WHERE k = 1)"""
_TRIANGLE = f"""
shape AS (SELECT t, max(n) AS top, min(bin) FILTER (n > 0) AS first, max(bin) FILTER (n > 0) AS last, sum(n) AS total FROM hist GROUP BY t),
pk AS (SELECT hist.t, min(bin) AS peak FROM hist JOIN shape ON hist.t = shape.t AND n = top GROUP BY hist.t),
tri0 AS (SELECT hist.t, bin, n, low, width, top, total, peak, first, last, (peak - first) < (last - peak) AS flip FROM hist JOIN shape USING (t) JOIN pk USING (t)),
tri1 AS (SELECT *, CASE WHEN flip THEN {BINS - 1} - bin ELSE bin END AS pos, CASE WHEN flip THEN {BINS - 1} - peak ELSE peak END AS top_at, CASE WHEN flip THEN {BINS - 1} - last ELSE first END AS low_at FROM tri0),
tri2 AS (SELECT t, low + (bin + 0.5) * width AS c, pos,
  round((top::double / total) / sqrt(pow(top::double / total, 2) + pow(top_at - low_at, 2)) * (pos - low_at) - (top_at - low_at) / sqrt(pow(top::double / total, 2) + pow(top_at - low_at, 2)) * (n::double / total), 9) AS d
  FROM tri1 WHERE pos >= low_at AND pos < top_at),
triangle AS (SELECT t, c AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d DESC, pos) AS k FROM tri2) WHERE k = 1)"""
_BOTH = "both_t AS (SELECT coalesce(a.t, b.t) AS t, least(a.threshold, b.threshold) AS threshold FROM triangle a FULL JOIN otsu b ON a.t = b.t)"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p.strip() for p in parts) + " "


SRC = "src AS (SELECT t, y, x, v FROM r)"
POS = "src AS (SELECT t, y, x, v FROM r WHERE v > 0)"
LOGS = "src AS (SELECT t, y, x, log10(v) AS v FROM r WHERE v > 0)"


def _r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[tidy(F.col(c)).alias(c) if c in cols else c for c in df.columns])


def _mask(spark: SparkSession, sf: str, least: float) -> DataFrame:
    return raster(spark, sf).where(F.col("v") > least)


def _histogram(spark, sf):
    h = thresholds.histogram(raster(spark, sf), ["t"], "v", BINS)
    return _r6(h.select("t", "bin", "n", F.col("low").alias("low"), "width"), "low", "width")


register("agg_18_histogram", _histogram, _with(RASTER, SRC, _HIST) + "SELECT t, bin, n, round(low + 1e-9, 6) AS low, round(width + 1e-9, 6) AS width FROM hist")
register("agg_19_otsu", lambda s, sf: _r6(thresholds.otsu(raster(s, sf), ["t"], "v", BINS), "threshold"), _with(RASTER, SRC, _OTSU) + "SELECT t, round(threshold + 1e-9, 6) AS threshold FROM otsu")
register("agg_20_triangle", lambda s, sf: _r6(thresholds.triangle(raster(s, sf), ["t"], "v", BINS), "threshold"), _with(RASTER, SRC, _HIST, _TRIANGLE) + "SELECT t, round(threshold + 1e-9, 6) AS threshold FROM triangle")
register("agg_21_gamma", lambda s, sf: _r6(thresholds.gamma(raster(s, sf), ["t"], "v", BINS), "gamma"), _with(RASTER, POS, _OTSU, _TRIANGLE, _BOTH) + "SELECT t, round(greatest(threshold, 2.220446049250313e-16) + 1e-9, 6) AS gamma FROM both_t")
register("agg_22_frangi_threshold", lambda s, sf: _r6(thresholds.log_threshold(raster(s, sf), ["t"], "v", BINS), "threshold"), _with(RASTER, LOGS, _OTSU, _TRIANGLE, _BOTH) + "SELECT t, round(pow(10, threshold) + 1e-9, 6) AS threshold FROM both_t")
register(
    "agg_23_intensity_otsu",
    lambda s, sf: _r6(thresholds.otsu(raster(s, sf).withColumn("v", F.col("v") * F.col("v")), ["t"], "v", BINS), "threshold"),
    _with(RASTER, "src AS (SELECT t, y, x, v * v AS v FROM r)", _OTSU) + "SELECT t, round(threshold + 1e-9, 6) AS threshold FROM otsu",
)
register("prj_6_mask_coords", lambda s, sf: _mask(s, sf, MASK).select("t", "y", "x"), _with(RASTER) + f"SELECT t, y, x FROM r WHERE v > {MASK}")
register(
    "prj_9_intensity_mask",
    lambda s, sf: raster(s, sf).select("t", "y", "x", tidy(F.when(F.col("v") > 0.1, F.col("v")).otherwise(0.0)).alias("v")),
    _with(RASTER) + "SELECT t, y, x, round(CASE WHEN v > 0.1 THEN v ELSE 0 END + 1e-9, 6) AS v FROM r",
)
register("prj_10_grid_sample", lambda s, sf: raster(s, sf).where("y % 2 = 0 and x % 2 = 0 and v > 0").select("t", "y", "x"), _with(RASTER) + "SELECT t, y, x FROM r WHERE y % 2 = 0 AND x % 2 = 0 AND v > 0")


def _flat_sample(spark, sf):
    return kernels.strided_sample(raster(spark, sf), ["t"], (F.col("y") * 8 + F.col("x")), "v", 64, 3).select("t", "y", "x")


register(
    "prj_11_flat_sample",
    _flat_sample,
    _with(RASTER) + "SELECT t, y, x FROM (SELECT *, (y * 8 + x) % 3 AS k, min((y * 8 + x) % 3) FILTER (v > 0) OVER (PARTITION BY t) AS best FROM r) WHERE v > 0 AND k = best",
)
register(
    "prj_25_bbox",
    lambda s, sf: _mask(s, sf, MASK).groupBy("t").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")),
    _with(RASTER) + f"SELECT t, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM r WHERE v > {MASK} GROUP BY t",
)
register(
    "prj_26_remove_edges",
    lambda s, sf: _r6(stencil.cut_edges(raster(s, sf), ["t"], "v", 2), "v"),
    _with(RASTER, "b AS (SELECT t, min(y) AS y0, max(y) AS y1 FROM r WHERE v > 0 GROUP BY t)") + "SELECT t, y, x, round(CASE WHEN y < y0 + 2 OR y > y1 - 2 THEN 0 ELSE v END + 1e-9, 6) AS v FROM r LEFT JOIN b USING (t)",
)
register("prj_7_gather", lambda s, sf: _r6(_mask(s, sf, SKELETON).select("t", "y", "x").join(raster(s, sf), ["t", "y", "x"]), "v"), _with(RASTER) + f"SELECT t, y, x, round(v + 1e-9, 6) AS v FROM r WHERE v > {SKELETON}")
register(
    "prj_8_scatter",
    lambda s, sf: raster(s, sf).select("t", "y", "x").join(_mask(s, sf, SKELETON).select("t", "y", "x", F.lit(1).alias("one")), ["t", "y", "x"], "left").select("t", "y", "x", F.coalesce("one", F.lit(0)).alias("marked")),
    _with(RASTER) + f"SELECT t, y, x, (v > {SKELETON})::int AS marked FROM r",
)
register(
    "win_12_max_filter",
    lambda s, sf: _r6(stencil.neighbourhood(raster(s, sf), ["t"], YX, [F.max("v").alias("top"), F.min("v").alias("low")]), "top", "low"),
    _with(RASTER) + "SELECT a.t, a.y, a.x, round(max(b.v) + 1e-9, 6) AS top, round(min(b.v) + 1e-9, 6) AS low FROM r a JOIN r b ON a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL",
)
register(
    "krn_23_roi_radius",
    lambda s, sf: stencil.neighbourhood(raster(s, sf), ["t"], YX, [F.max("v").alias("m")]).select("t", "y", "x", tidy(F.col("m") * 2).alias("radius")),
    _with(RASTER) + "SELECT a.t, a.y, a.x, round(2 * max(b.v) + 1e-9, 6) AS radius FROM r a JOIN r b ON a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL",
)
_KRN24_SQL = _with(RASTER) + "SELECT t, y, x, round(CASE WHEN v > 0 THEN log10(v) - least(0, min(CASE WHEN v > 0 THEN log10(v) END) OVER (PARTITION BY t)) ELSE 0 END + 1e-9, 6) AS v FROM r"
register("krn_24_log_vesselness", lambda s, sf: _r6(kernels.shifted_log(raster(s, sf), ["t"], "v"), "v"), _KRN24_SQL)
register(
    "krn_19_border",
    lambda s, sf: stencil.border(_mask(s, sf, MASK), ["t"], YX, SHAPE),
    _with(RASTER, f"k AS (SELECT t, y, x FROM r WHERE v > {MASK})") + "SELECT DISTINCT r.t, r.y, r.x FROM r JOIN k ON r.t = k.t AND abs(r.y - k.y) + abs(r.x - k.x) = 1 WHERE NOT EXISTS (SELECT 1 FROM k q WHERE q.t = r.t AND q.y = r.y AND q.x = r.x)",
)
_K = f"k AS (SELECT t, y, x FROM r WHERE v > {SKELETON})"
register(
    "krn_15_pixel_class",
    lambda s, sf: stencil.pixel_class(_mask(s, sf, SKELETON), ["t"], YX),
    _with(RASTER, _K) + "SELECT a.t, a.y, a.x, least(count(*), 4)::int AS pixel_class FROM k a JOIN k b ON a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL",
)
_L = f"l AS (SELECT t, y, x, 1 + x // 3 AS label FROM r WHERE v > {SKELETON})"


def _labelled_strip(spark, sf):
    return _mask(spark, sf, SKELETON).select("t", "y", "x", (F.lit(1) + F.floor(F.col("x") / F.lit(3))).cast("int").alias("label"))


register(
    "krn_13_unambiguous",
    lambda s, sf: stencil.unambiguous(_labelled_strip(s, sf), ["t"], YX, "label", SHAPE),
    _with(RASTER, _L, "w AS (SELECT a.t, a.y, a.x, a.label, min(b.label) AS lo, max(b.label) AS hi FROM l a JOIN l b ON a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)")
    + "SELECT t, y, x, label::int AS label FROM w WHERE lo = hi OR y IN (0, 7) OR x IN (0, 7)",
)
register(
    "krn_21_nms",
    lambda s, sf: stencil.local_maxima(raster(s, sf), ["t"], YX, "v", 2).select("t", "y", "x"),
    _with(RASTER) + "SELECT a.t, a.y, a.x FROM r a JOIN r b ON a.t = b.t AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 WHERE a.v > 0 GROUP BY a.t, a.y, a.x, a.v HAVING max(b.v) = a.v",
)
_LINE = "CASE WHEN lag({v}) OVER {w} IS NULL THEN lead({v}) OVER {w} - {v} WHEN lead({v}) OVER {w} IS NULL THEN {v} - lag({v}) OVER {w} ELSE (lead({v}) OVER {w} - lag({v}) OVER {w}) / 2 END"
_WY, _WX = "(PARTITION BY t, x ORDER BY y)", "(PARTITION BY t, y ORDER BY x)"
_HESS = (
    f"g1 AS (SELECT *, {_LINE.format(v='v', w=_WY)} AS gy, {_LINE.format(v='v', w=_WX)} AS gx FROM r)",
    f"hs AS (SELECT t, y, x, {_LINE.format(v='gy', w=_WY)} AS gyy, {_LINE.format(v='gy', w=_WX)} AS gyx, {_LINE.format(v='gx', w=_WX)} AS gxx FROM g1)",
)
_EIG = (
    "e0 AS (SELECT *, (gyy + gxx) / 2 AS h, sqrt(pow((gyy - gxx) / 2, 2) + gyx * gyx) AS q FROM hs)",
    "eg AS (SELECT t, y, x, gyy, gyx, gxx, CASE WHEN abs(h - q) > abs(h + q) THEN h + q ELSE h - q END AS l1, CASE WHEN abs(h - q) > abs(h + q) THEN h - q ELSE h + q END AS l2 FROM e0)",
)


def _hessian(spark, sf):
    return stencil.hessian_2d(raster(spark, sf), ["t"]).select("t", "y", "x", "gyy", "gyx", "gxx")


def _eigen(spark, sf):
    l1, l2 = stencil.eigen_2d(F.col("gyy"), F.col("gyx"), F.col("gxx"))
    return _hessian(spark, sf).select("t", "y", "x", "gyy", "gyx", "gxx", l1.alias("l1"), l2.alias("l2"))


register("krn_2_hessian", lambda s, sf: _r6(_hessian(s, sf), "gyy", "gyx", "gxx"), _with(RASTER, *_HESS) + "SELECT t, y, x, round(gyy + 1e-9, 6) AS gyy, round(gyx + 1e-9, 6) AS gyx, round(gxx + 1e-9, 6) AS gxx FROM hs")
register("krn_4_eigen_2d", lambda s, sf: _r6(_eigen(s, sf).select("t", "y", "x", F.abs("l1").alias("l1"), F.abs("l2").alias("l2")), "l1", "l2"), _with(RASTER, *_HESS, *_EIG) + "SELECT t, y, x, round(abs(l1) + 1e-9, 6) AS l1, round(abs(l2) + 1e-9, 6) AS l2 FROM eg")
_FROB = "fr AS (SELECT t, y, x, sqrt(gyy * gyy + 2 * gyx * gyx + gxx * gxx) / max(greatest(abs(gyy), abs(gyx), abs(gxx))) OVER (PARTITION BY t) AS v FROM hs)"


def _frobenius(spark, sf):
    return kernels.frobenius(_hessian(spark, sf), ["t"], ["gyy", "gyx", "gyx", "gxx"])


register("agg_40_frobenius", lambda s, sf: _r6(_frobenius(s, sf).select("t", "y", "x", "norm"), "norm"), _with(RASTER, *_HESS, _FROB) + "SELECT t, y, x, round(v + 1e-9, 6) AS norm FROM fr")


def _frob_mask(spark, sf):
    f = _frobenius(spark, sf).select("t", "y", "x", "norm")
    bar = thresholds.smaller_of_both(f.where("norm > 0"), ["t"], "norm", BINS).select("t", (F.col("threshold") / 2).alias("bar"))
    return f.join(bar, "t").where("norm > bar").select("t", "y", "x")


register(
    "krn_3_frobenius_mask",
    _frob_mask,
    _with(RASTER, *_HESS, _FROB, "src AS (SELECT * FROM fr WHERE v > 0)", _OTSU, _TRIANGLE, _BOTH) + "SELECT fr.t, y, x FROM fr JOIN both_t USING (t) WHERE v > threshold / 2",
)


def _vesselness(spark, sf):
    return _eigen(spark, sf).select("t", "y", "x", stencil.vesselness_2d(F.col("l1"), F.col("l2"), F.lit(2 * 0.1 * 0.1)).alias("vessel"))


_VES = "CASE WHEN l2 > 0 THEN 0 ELSE exp(-pow(abs(l1) / (abs(l2) + 1e-12), 2) / 0.5) * (1 - exp(-(l1 * l1 + l2 * l2) / 0.02)) END"
register("krn_6_vesselness", lambda s, sf: _vesselness(s, sf).select("t", "y", "x", F.round(F.col("vessel") + 1e-9, 4).alias("vessel")), _with(RASTER, *_HESS, *_EIG) + f"SELECT t, y, x, round({_VES} + 1e-9, 4) AS vessel FROM eg")


def _gammas(spark, sf):
    e = _eigen(spark, sf).crossJoin(F.broadcast(spark.createDataFrame([(0, 0.05), (1, 0.1), (2, 0.2)], "k int, gamma double")))  # three scales
    return e.select("t", "y", "x", "k", stencil.vesselness_2d(F.col("l1"), F.col("l2"), 2 * F.col("gamma") * F.col("gamma")).alias("vessel"))


register(
    "krn_7_max_over_scales",
    lambda s, sf: _gammas(s, sf).groupBy("t", "y", "x").agg(F.round(F.max("vessel") + 1e-9, 4).alias("vessel"), F.bool_and(F.col("vessel") > 1e-6).alias("in_all")),
    _with(RASTER, *_HESS, *_EIG, f"ga AS (SELECT t, y, x, {_VES.replace('0.02', '(2 * gamma * gamma)')} AS vessel FROM eg, (VALUES (0.05::double), (0.1), (0.2)) g(gamma))")
    + "SELECT t, y, x, round(max(vessel) + 1e-9, 4) AS vessel, bool_and(vessel > 1e-6) AS in_all FROM ga GROUP BY ALL",
)
register("win_11_max_over_scales", lambda s, sf: _gammas(s, sf).groupBy("t", "k").agg(F.round(F.max("vessel") + 1e-9, 4).alias("top")), _with(RASTER, *_HESS, *_EIG, f"ga AS (SELECT t, k::int AS k, {_VES.replace('0.02', '(2 * gamma * gamma)')} AS vessel FROM eg, (VALUES (0, 0.05::double), (1, 0.1), (2, 0.2)) g(k, gamma))") + "SELECT t, k, round(max(vessel) + 1e-9, 4) AS top FROM ga GROUP BY ALL")


def _mask_volume(spark, sf):
    r = raster(spark, sf)
    low = r.groupBy("t").agg(F.percentile("v", 0.01).alias("low"))
    kept = r.join(low, "t").where("v > low")
    return stencil.opening(kept, ["t"], YX, SHAPE)


register(
    "krn_9_mask_volume",
    _mask_volume,
    _with(
        RASTER,
        "k AS (SELECT r.t, y, x FROM r JOIN (SELECT t, quantile_cont(v, 0.01) AS low FROM r GROUP BY t) USING (t) WHERE v > low)",
        "er AS (SELECT a.t, a.y, a.x FROM k a JOIN k b ON a.t = b.t AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(*) = 5)",
    )
    + "SELECT DISTINCT r.t, r.y, r.x FROM r JOIN er ON r.t = er.t AND abs(r.y - er.y) + abs(r.x - er.x) <= 1",
)

# components: least ordinal reachable, by recursion in the oracle
_CC = (
    f"cm AS (SELECT t, y, x, y * 8 + x AS o FROM r WHERE v > {MASK})",
    "reach AS (SELECT t, o, o AS root, y, x FROM cm UNION SELECT c.t, c.o, q.root, c.y, c.x FROM reach q JOIN cm c ON c.t = q.t AND abs(c.y - q.y) <= 1 AND abs(c.x - q.x) <= 1 AND q.root < c.o)",
    "cc AS (SELECT t, y, x, min(root) AS root FROM reach GROUP BY ALL)",
    "lab AS (SELECT t, y, x, dense_rank() OVER (PARTITION BY t ORDER BY root)::int AS label FROM cc)",
)


def _components(spark, sf):
    return regions.components(_mask(spark, sf, MASK), ["t"], ["y", "x"])


def _labelled(spark, sf):
    return _components(spark, sf).join(raster(spark, sf), ["t", "y", "x"])


register("krn_10_components", _components, _with(RASTER, *_CC) + "SELECT t, y, x, label FROM lab")
register("krn_11_components_tiled", lambda s, sf: regions.components_tiled(_mask(s, sf, MASK), ["t"], ["y", "x"], 3), _with(RASTER, *_CC) + "SELECT t, y, x, label FROM lab")
register("win_6_compact_labels", _components, _with(RASTER, *_CC) + "SELECT t, y, x, label FROM lab")
register("agg_6_min_size", lambda s, sf: regions.keep_large(_components(s, sf), ["t", "label"], 3), _with(RASTER, *_CC) + "SELECT t, y, x, label FROM lab QUALIFY count(*) OVER (PARTITION BY t, label) >= 3")
_GEO = """g AS (SELECT t, label, count(*) * 0.06 AS area, count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)) AS extent, avg(y) * 0.2 AS cy, avg(x) * 0.3 AS cx,
  var_pop(y) * 0.04 + 0.04 / 12 AS aa, var_pop(x) * 0.09 + 0.09 / 12 AS bb, covar_pop(y, x) * 0.06 AS ab FROM lab GROUP BY t, label)"""


def _geometry(spark, sf):
    return regions.geometry(_components(spark, sf), ["t", "label"], YX, (0.2, 0.3))


register("agg_10_area", lambda s, sf: _r6(_geometry(s, sf).select("t", "label", "area"), "area"), _with(RASTER, *_CC, _GEO) + "SELECT t, label, round(area + 1e-9, 6)::double AS area FROM g")
register("agg_11_centroid", lambda s, sf: _r6(_geometry(s, sf).select("t", "label", "centroid_y", "centroid_x"), "centroid_y", "centroid_x"), _with(RASTER, *_CC, _GEO) + "SELECT t, label, round(cy + 1e-9, 6) AS centroid_y, round(cx + 1e-9, 6) AS centroid_x FROM g")
register(
    "agg_12_axis_lengths",
    lambda s, sf: _r6(_geometry(s, sf).select("t", "label", "axis_major", "axis_minor"), "axis_major", "axis_minor"),
    _with(RASTER, *_CC, _GEO) + "SELECT t, label, round(4 * sqrt((aa + bb) / 2 + sqrt(pow((aa - bb) / 2, 2) + ab * ab)) + 1e-9, 6) AS axis_major, round(4 * sqrt(greatest((aa + bb) / 2 - sqrt(pow((aa - bb) / 2, 2) + ab * ab), 0)) + 1e-9, 6) AS axis_minor FROM g",
)
register("agg_13_extent", lambda s, sf: _r6(_geometry(s, sf).select("t", "label", "extent"), "extent"), _with(RASTER, *_CC, _GEO) + "SELECT t, label, round(extent + 1e-9, 6) AS extent FROM g")
# a hull's ends at each line of pixel corners lie on the chords between the ends of other lines; between lines it is a trapezium
_HULL = (
    "co AS (SELECT t, label, y + dy AS y, min(x)::double AS lo, max(x) + 1::double AS hi FROM lab, (VALUES (0), (1)) d(dy) GROUP BY ALL)",
    "ch AS (SELECT c.t, c.label, c.y, a.lo AS la, b.lo AS lb, a.hi AS ha, b.hi AS hb, CASE WHEN b.y > a.y THEN (c.y - a.y) / (b.y - a.y)::double ELSE 0 END AS s"
    " FROM co c JOIN co a ON c.t = a.t AND c.label = a.label AND a.y <= c.y JOIN co b ON c.t = b.t AND c.label = b.label AND b.y >= c.y)",
    "en AS (SELECT t, label, y, min(la + (lb - la) * s) AS lo, max(ha + (hb - ha) * s) AS hi FROM ch GROUP BY ALL)",
    "tz AS (SELECT t, label, (hi - lo + lead(hi - lo) OVER (PARTITION BY t, label ORDER BY y)) / 2 AS area FROM en)",
)
register(
    "agg_14_solidity",
    lambda s, sf: _r6(kernels.solidity(_components(s, sf), ["t", "label"]), "solidity"),
    _with(RASTER, *_CC, *_HULL) + "SELECT t, label, round(n / area + 1e-9, 6) AS solidity FROM (SELECT t, label, sum(area) AS area FROM tz GROUP BY ALL) JOIN (SELECT t, label, count(*) AS n FROM lab GROUP BY ALL) USING (t, label)",
)
register(
    "agg_24_argmax_position",
    lambda s, sf: _labelled(s, sf).groupBy("t", "label").agg(F.max_by(F.struct("y", "x"), F.struct("v", -F.col("y"), -F.col("x"))).alias("b")).select("t", "label", "b.y", "b.x"),
    _with(RASTER, *_CC) + "SELECT t, label, y, x FROM lab JOIN r USING (t, y, x) QUALIFY row_number() OVER (PARTITION BY t, label ORDER BY v DESC, y, x) = 1",
)
register("agg_41_distinct_labels", lambda s, sf: _components(s, sf).select("t", "label").distinct(), _with(RASTER, *_CC) + "SELECT DISTINCT t, label FROM lab")
_FIVE = "round(avg({0}) + 1e-7, 5) AS {0}_mean, round(stddev_pop({0}) + 1e-7, 5) AS {0}_std_dev, round(min({0}) + 1e-7, 5) AS {0}_min, round(max({0}) + 1e-7, 5) AS {0}_max, round(sum({0}) + 1e-7, 5) AS {0}_sum"


def round5(df: DataFrame, *names: str) -> DataFrame:
    cols = {f"{n}_{s}" for n in names for s in stats.SUFFIXES}
    return df.select(*[F.round(F.col(c) + 1e-7, 5).alias(c) if c in cols else c for c in df.columns])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Otsu mask, full-connectivity components of two voxels or more, geometry and five intensity statistics of each."""
    r = raster(spark, sf)
    mask = r.join(thresholds.otsu(r, ["t"], "v", BINS), "t").where("v > threshold").drop("threshold")
    objects = regions.keep_large(regions.components(mask, ["t"], ["y", "x"]), ["t", "label"], 2).join(r, ["t", "y", "x"])
    shape = _r6(regions.geometry(objects, ["t", "label"]).select("t", "label", "area", "centroid_y", "centroid_x", "extent"), "area", "centroid_y", "centroid_x", "extent")
    return shape.join(round5(stats.five_stats(objects, ["t", "label"], ["v"]), "v"), ["t", "label"])


register(
    "m1_segment_and_measure",
    flagship,
    _with(RASTER, SRC, _OTSU, "cm AS (SELECT r.t, y, x, y * 8 + x AS o FROM r JOIN otsu USING (t) WHERE v > threshold)", *_CC[1:], "big AS (SELECT * FROM lab QUALIFY count(*) OVER (PARTITION BY t, label) >= 2)")
    + f"SELECT t, label, count(*)::double AS area, round(avg(y) + 1e-9, 6) AS centroid_y, round(avg(x) + 1e-9, 6) AS centroid_x, round(count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)) + 1e-9, 6) AS extent, {_FIVE.format('v')} FROM big JOIN r USING (t, y, x) GROUP BY t, label",
)

# moments of each frame as a region of interest
_RAW = ", ".join(f"sum(v * pow(x, {p}) * pow(y, {q})) AS m{p}{q}" for p in range(4) for q in range(4) if p + q <= 3)
_POSV = "q AS (SELECT t, y, x, CASE WHEN v > 0 THEN v ELSE 0 END AS v FROM r)"
_CENT = "ce AS (SELECT q.t, " + ", ".join(f"sum(v * pow(x - cx, {p}) * pow(y - cy, {k})) AS u{p}{k}" for p in range(4) for k in range(4) if p + k <= 3) + " FROM q JOIN (SELECT t, sum(v * x) / sum(v) AS cx, sum(v * y) / sum(v) AS cy FROM q GROUP BY t HAVING sum(v) > 0) USING (t) GROUP BY q.t)"
_NORM = "nm AS (SELECT t, " + ", ".join(f"u{p}{k} / pow(u00, {1 + (p + k) / 2}) AS n{p}{k}" for p in range(4) for k in range(4) if 2 <= p + k <= 3) + " FROM ce)"


def _roi(spark, sf):
    return raster(spark, sf).withColumn("v", F.when(F.col("v") > 0, F.col("v")).otherwise(0.0))


register("agg_26_normalized_moments", lambda s, sf: _round4(moments.normalized(_roi(s, sf), ["t"], "y", "x", "v"), ["t"]), _with(RASTER, _POSV, _CENT, _NORM) + "SELECT t, " + ", ".join(f"round(n{p}{k} + 1e-9, 4) AS n{p}{k}" for p in range(4) for k in range(4) if 2 <= p + k <= 3) + " FROM nm")


def _round4(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in df.columns if c not in keep])


_HU = """hu AS (SELECT t, n20 + n02 AS h1, pow(n20 - n02, 2) + 4 * n11 * n11 AS h2, pow(n30 - 3 * n12, 2) + pow(3 * n21 - n03, 2) AS h3, pow(n30 + n12, 2) + pow(n21 + n03, 2) AS h4,
  (n30 - 3 * n12) * (n30 + n12) * (pow(n30 + n12, 2) - 3 * pow(n21 + n03, 2)) + (3 * n21 - n03) * (n21 + n03) * (3 * pow(n30 + n12, 2) - pow(n21 + n03, 2)) AS h5,
  (n20 - n02) * (pow(n30 + n12, 2) - pow(n21 + n03, 2)) + 4 * n11 * (n30 + n12) * (n21 + n03) AS h6 FROM nm)"""
register("agg_27_log_hu", lambda s, sf: moments.log_hu_table(_roi(s, sf), ["t"], "y", "x", "v").select("t", *[F.round(F.col(f"h{i}") + 1e-9, 3).alias(f"h{i}") for i in range(1, 7)]), _with(RASTER, _POSV, _CENT, _NORM, _HU) + "SELECT t, " + ", ".join(f"round(CASE WHEN h{i} = 0 THEN 0 ELSE -sign(h{i}) * log10(greatest(abs(h{i}), 2.2250738585072014e-308)) END + 1e-9, 3) AS h{i}" for i in range(1, 7)) + " FROM hu")
register(
    "agg_25_nonzero_stats",
    lambda s, sf: _r6(moments.nonzero_stats(_roi(s, sf), ["t"], "v"), "mean", "variance"),
    _with(RASTER, _POSV) + "SELECT t, round(coalesce(avg(v) FILTER (v <> 0), 0) + 1e-9, 6) AS mean, round(coalesce(var_pop(v) FILTER (v <> 0), 0) + 1e-9, 6) AS variance FROM q GROUP BY t",
)


def _volume(spark, sf):
    return volume(spark, sf).withColumn("v", F.greatest("v", F.lit(0.0)))


register(
    "agg_28_projections",
    lambda s, sf: _r6(moments.projections(_volume(s, sf), ["image"], "v"), "v"),
    _with(RASTER, _POSV, "vo AS (SELECT t // 8 AS image, (t % 8)::int AS z, y, x, v FROM q)")
    + "SELECT image, axis, a, b, round(max(v) + 1e-9, 6) AS v FROM (SELECT image, 'z' AS axis, y AS a, x AS b, v FROM vo UNION ALL SELECT image, 'y', z, x, v FROM vo UNION ALL SELECT image, 'x', z, y, v FROM vo) GROUP BY ALL",
)

# distance to the background in pixels, clamped; smallest-ordinal nearest seed
register(
    "krn_18_distance",
    lambda s, sf: _r6(kernels.distance(raster(s, sf).withColumn("on", F.col("v") > MASK), ["t"], "on", 4.0), "distance"),
    _with(RASTER, f"bg AS (SELECT t, y, x FROM r WHERE v <= {MASK})", f"fg AS (SELECT t, y, x FROM r WHERE v > {MASK})")
    + "SELECT fg.t, fg.y, fg.x, round(least(coalesce(sqrt(min(pow(fg.y - bg.y, 2) + pow(fg.x - bg.x, 2))), 4), 4) + 1e-9, 6) AS distance FROM fg LEFT JOIN bg ON fg.t = bg.t GROUP BY fg.t, fg.y, fg.x",
)
register(
    "jon_16_nearest_seed",
    lambda s, sf: network.nearest_seed(_components(s, sf), _seeds(s, sf), ["t", "label"], YX, (1.0, 1.0), "seed"),
    _with(RASTER, *_CC, f"sd AS (SELECT lab.t, lab.label, y, x, y * 8 + x AS seed FROM lab JOIN r USING (t, y, x) WHERE v > {SKELETON})")
    + "SELECT lab.t, lab.label, lab.y, lab.x, arg_min(seed, (pow(lab.y - sd.y, 2) + pow(lab.x - sd.x, 2)) * 1000 + seed)::int AS seed FROM lab JOIN sd ON lab.t = sd.t AND lab.label = sd.label GROUP BY lab.t, lab.label, lab.y, lab.x",
)
register("krn_17_propagate", lambda s, sf: network.nearest_seed(_components(s, sf), _seeds(s, sf), ["t", "label"], YX, (1.0, 1.0), "seed").groupBy("t", "seed").agg(F.count("*").alias("n")),
    _with(RASTER, *_CC, f"sd AS (SELECT lab.t, lab.label, y, x, y * 8 + x AS seed FROM lab JOIN r USING (t, y, x) WHERE v > {SKELETON})",
    "ns AS (SELECT lab.t, lab.y, lab.x, arg_min(seed, (pow(lab.y - sd.y, 2) + pow(lab.x - sd.x, 2)) * 1000 + seed)::int AS seed FROM lab JOIN sd ON lab.t = sd.t AND lab.label = sd.label GROUP BY lab.t, lab.y, lab.x)") + "SELECT t, seed, count(*) AS n FROM ns GROUP BY ALL")


def _seeds(spark, sf):
    return _labelled(spark, sf).where(F.col("v") > SKELETON).select("t", "label", "y", "x", (F.col("y") * 8 + F.col("x")).cast("int").alias("seed"))


_MISSING = "ms AS (SELECT DISTINCT t, label FROM lab EXCEPT SELECT DISTINCT lab.t, label FROM lab JOIN r USING (t, y, x) WHERE v > 0.15)"
register("jon_17_labels_without_skeleton", lambda s, sf: network.without_skeleton(_components(s, sf), _seeds(s, sf), ["t", "label"]), _with(RASTER, *_CC, _MISSING) + "SELECT t, label FROM ms")
register("set_3_except_labels", lambda s, sf: _components(s, sf).select("t", "label").subtract(_seeds(s, sf).select("t", "label")), _with(RASTER, *_CC, _MISSING) + "SELECT t, label FROM ms")
register(
    "krn_14_add_missing_skeleton",
    lambda s, sf: network.add_missing_skeleton(_labelled(s, sf), _seeds(s, sf), ["t"], "label", YX, "v"),
    _with(RASTER, *_CC, _MISSING) + "SELECT t, label, y, x FROM lab JOIN r USING (t, y, x) WHERE v > 0.15 UNION ALL (SELECT t, label, y, x FROM lab JOIN ms USING (t, label) JOIN r USING (t, y, x) QUALIFY row_number() OVER (PARTITION BY t, label ORDER BY v DESC, y, x) = 1)",
)
_BR = (
    _K,
    "pc AS (SELECT a.t, a.y, a.x, least(count(*), 4) AS pc FROM k a JOIN k b ON a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)",
    "cm AS (SELECT t, y, x, y * 8 + x AS o FROM pc WHERE pc < 4)",
    *_CC[1:],
)


def _branches(spark, sf):
    return network.branch_labels(_mask(spark, sf, SKELETON), ["t"], YX)


register("krn_16_branch_labels", lambda s, sf: _branches(s, sf).select("t", "y", "x", "branch"), _with(RASTER, *_BR) + "SELECT t, y, x, label AS branch FROM lab")
_EDGES = "ed AS (SELECT a.t, a.label, a.y, a.x, b.y AS y2, b.x AS x2, sqrt(pow((a.y - b.y) * 0.2, 2) + pow((a.x - b.x) * 0.3, 2)) AS d FROM lab a JOIN lab b ON a.t = b.t AND a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (b.y, b.x) > (a.y, a.x))"
register(
    "jon_15_branch_edges",
    lambda s, sf: _r6(network.branch_edges(_branches(s, sf), ["t"], "branch", YX, (0.2, 0.3)).groupBy("t", "branch").agg(F.count("*").alias("edges"), F.sum("length").alias("length")), "length"),
    _with(RASTER, *_BR, _EDGES) + "SELECT t, label AS branch, count(*) AS edges, round(sum(d) + 1e-9, 6) AS length FROM ed GROUP BY ALL",
)
_BG = (
    _EDGES,
    "dg AS (SELECT t, label, y, x, count(*) AS deg FROM (SELECT t, label, y, x FROM ed UNION ALL SELECT t, label, y2, x2 FROM ed) GROUP BY ALL)",
    "nd AS (SELECT lab.t, lab.label, lab.y, lab.x, coalesce(deg, 0) AS deg, v AS radius FROM lab JOIN r USING (t, y, x) LEFT JOIN dg USING (t, label, y, x))",
    "tp AS (SELECT t, label, max(y) FILTER (k = 1) AS ya, max(x) FILTER (k = 1) AS xa, max(y) FILTER (k = 2) AS yb, max(x) FILTER (k = 2) AS xb FROM (SELECT *, row_number() OVER (PARTITION BY t, label ORDER BY y, x) AS k FROM nd WHERE deg = 1) GROUP BY t, label)",
    "bl AS (SELECT nd.t, nd.label, coalesce(max(el.len), 0) + sum(CASE deg WHEN 0 THEN 2 * radius WHEN 1 THEN radius ELSE 0 END) AS len, 2 * median(radius) AS thick FROM nd LEFT JOIN (SELECT t, label, sum(d) AS len FROM ed GROUP BY ALL) el ON el.t = nd.t AND el.label = nd.label GROUP BY nd.t, nd.label)",
    "bg2 AS (SELECT bl.t, bl.label AS branch, greatest(len, thick) AS length, least(len, thick) AS thickness, CASE WHEN yb IS NULL THEN 1 ELSE len / sqrt(pow((ya - yb) * 0.2, 2) + pow((xa - xb) * 0.3, 2)) END AS tortuosity FROM bl LEFT JOIN tp ON bl.t = tp.t AND bl.label = tp.label)",
)


def _branch_geometry(spark, sf):
    b = _branches(spark, sf).join(raster(spark, sf), ["t", "y", "x"]).withColumnRenamed("v", "radius")
    return network.branch_geometry(b, ["t"], "branch", YX, (0.2, 0.3), "radius")


register("agg_15_branch_length", lambda s, sf: _r6(_branch_geometry(s, sf).select("t", "branch", "length"), "length"), _with(RASTER, *_BR, *_BG) + "SELECT t, branch, round(length + 1e-9, 6) AS length FROM bg2")
register("agg_16_thickness", lambda s, sf: _r6(_branch_geometry(s, sf).select("t", "branch", "thickness", "aspect_ratio"), "thickness", "aspect_ratio"), _with(RASTER, *_BR, *_BG) + "SELECT t, branch, round(thickness + 1e-9, 6) AS thickness, round(CASE WHEN thickness <> 0 THEN length / thickness END + 1e-9, 6) AS aspect_ratio FROM bg2")
register("agg_17_tortuosity", lambda s, sf: _r6(_branch_geometry(s, sf).select("t", "branch", "tortuosity"), "tortuosity"), _with(RASTER, *_BR, *_BG) + "SELECT t, branch, round(tortuosity + 1e-9, 6) AS tortuosity FROM bg2")
register("srt_9_first_tips", lambda s, sf: network.first_tips(_branch_nodes(s, sf), ["t", "branch"], YX).select("t", "branch", "y", "x", "k"), _with(RASTER, *_BR, *_BG[:3]) + "SELECT t, label AS branch, y, x, k::int AS k FROM (SELECT *, row_number() OVER (PARTITION BY t, label ORDER BY y, x) AS k FROM nd WHERE deg = 1) WHERE k <= 2")


def _branch_nodes(spark, sf):
    return network.with_degree(_branches(spark, sf), ["t"], "branch", YX, (0.2, 0.3))


register(
    "agg_8_median_thickness",
    lambda s, sf: _r6(_branches(s, sf).join(raster(s, sf), ["t", "y", "x"]).groupBy("t", "branch").agg((F.median("v") * 2).alias("thickness")), "thickness"),
    _with(RASTER, *_BR) + "SELECT lab.t, label AS branch, round(2 * median(v) + 1e-9, 6) AS thickness FROM lab JOIN r USING (t, y, x) GROUP BY ALL",
)
register(
    "jon_14_chunk_boundary_pairs",
    lambda s, sf: network.boundary_pairs(_components(s, sf).select((F.col("t") % 8).cast("int").alias("z"), F.floor(F.col("t") / F.lit(8)).alias("image"), "y", "x", "label"), ["image"], "z", YX),
    _with(RASTER, *_CC, "vl AS (SELECT t // 8 AS image, (t % 8)::int AS z, y, x, label FROM lab)") + "SELECT DISTINCT a.image, a.z, a.label AS upper, b.label AS lower FROM vl a JOIN vl b ON a.image = b.image AND a.z + 1 = b.z AND a.y = b.y AND a.x = b.x",
)
register(
    "win_5_running_offset",
    lambda s, sf: network.running_offsets(_components(s, sf).groupBy((F.col("t") % 8).cast("int").alias("z"), F.floor(F.col("t") / F.lit(8)).alias("image")).agg(F.max("label").alias("top")), ["image"], "z", "top"),
    _with(RASTER, *_CC) + "SELECT t // 8 AS image, (t % 8)::int AS z, max(label) AS top, coalesce(sum(max(label)) OVER (PARTITION BY t // 8 ORDER BY t % 8 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS offset FROM lab GROUP BY t",
)
register("win_4_argmax_first", lambda s, sf: thresholds.histogram(raster(s, sf), ["t"], "v", BINS).groupBy("t").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("peak")), _with(RASTER, SRC, _HIST) + "SELECT t, bin AS peak FROM hist QUALIFY row_number() OVER (PARTITION BY t ORDER BY n DESC, bin) = 1")
register(
    "win_3_cumulative",
    lambda s, sf: kernels.cumulative(thresholds.histogram(raster(s, sf), ["t"], "v", BINS), ["t"], "bin", "n").select("t", "bin", "up", "down"),
    _with(RASTER, SRC, _HIST) + "SELECT t, bin, (sum(n) OVER (PARTITION BY t ORDER BY bin))::bigint AS up, (sum(n) OVER (PARTITION BY t ORDER BY bin DESC))::bigint AS down FROM hist",
)
register(
    "win_10_running_best",
    lambda s, sf: kernels.running_best(_gammas(s, sf).withColumn("vessel", F.round(F.col("vessel") + 1e-9, 4)), ["t", "y", "x"], "k", "vessel").where("best").select("t", "y", "x", "k"),
    _with(RASTER, *_HESS, *_EIG, f"ga AS (SELECT t, y, x, k::int AS k, round({_VES.replace('0.02', '(2 * gamma * gamma)')} + 1e-9, 4) AS vessel FROM eg, (VALUES (0, 0.05::double), (1, 0.1), (2, 0.2)) g(k, gamma))")
    + "SELECT t, y, x, k FROM ga QUALIFY vessel > coalesce(max(vessel) OVER (PARTITION BY t, y, x ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)",
)
register(
    "set_4_mask_sets",
    lambda s, sf: kernels.mask_sets(_mask(s, sf, MASK).select("t", "y", "x"), _labelled_strip(s, sf).where("label = 2").select("t", "y", "x"), ["t", "y", "x"]),
    _with(RASTER) + f"SELECT t, y, x, a AND b AS both, a <> b AS one_only FROM (SELECT t, y, x, v > {MASK} AS a, v > {SKELETON} AND x // 3 = 1 AS b FROM r) WHERE a OR b",
)
register("prj_30_master_mask", lambda s, sf: _mask(s, sf, MASK).select("t", "y", "x").unionByName(_mask(s, sf, SKELETON).select("t", "y", "x")).distinct(), _with(RASTER) + f"SELECT t, y, x FROM r WHERE v > {MASK} OR v > {SKELETON}")
register(
    "prj_21_marker_points",
    lambda s, sf: kernels.every_kth(stencil.local_maxima(raster(s, sf), ["t"], YX, "v", 2), ["t", "y", "x"], 3, 10**9).select("t", "y", "x"),
    _with(RASTER, "pk AS (SELECT a.t, a.y, a.x FROM r a JOIN r b ON a.t = b.t AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 WHERE a.v > 0 GROUP BY a.t, a.y, a.x, a.v HAVING max(b.v) = a.v)")
    + "SELECT t, y, x FROM (SELECT *, row_number() OVER (ORDER BY t, y, x) AS k FROM pk) WHERE k % 3 = 1",
)


def _line_sql(name: str, sigma: float, reach: int) -> tuple[str, ...]:
    """The matrices of a Gaussian and of its second derivative along a line of 8 cells folded back at both ends: i, j, w, w2."""
    return (
        f"{name}g AS (SELECT k, exp(-0.5 * pow(k / {sigma}::double, 2)) / sum(exp(-0.5 * pow(k / {sigma}::double, 2))) OVER () AS w FROM range(-{reach}, {reach + 1}) q(k))",
        f"{name} AS (SELECT i, CASE WHEN i + k < 0 THEN -i - k - 1 WHEN i + k > 7 THEN 15 - i - k ELSE i + k END AS j, w, w * (k * k / pow({sigma}::double, 4) - 1 / pow({sigma}::double, 2)) AS w2 FROM range(8) a(i), {name}g)",
    )


def _smooth_sql(out: str, source: str, line: str) -> tuple[str, ...]:
    return (f"{out}y AS (SELECT t, i AS y, x, sum(w * v) AS v FROM {source} JOIN {line} ON j = y GROUP BY t, i, x)", f"{out} AS (SELECT t, y, i AS x, sum(w * v) AS v FROM {out}y JOIN {line} ON j = x GROUP BY t, y, i)")


def _blob_sql(out: str, sigma: float, reach: int) -> tuple[str, ...]:
    """-sigma squared times the Laplacian of the Gaussian of r."""
    return (
        *_line_sql(f"{out}l", sigma, reach),
        f"{out}y AS (SELECT t, i AS y, x, sum(w * v) AS v, sum(w2 * v) AS v2 FROM r JOIN {out}l ON j = y GROUP BY t, i, x)",
        f"{out} AS (SELECT t, y, i AS x, greatest(-pow({sigma}::double, 2) * (sum(w * v2) + sum(w2 * v)), 0) AS v FROM {out}y JOIN {out}l ON j = x GROUP BY t, y, i)",
    )


_BLOBS = (*_blob_sql("ba", 0.8, 3), *_blob_sql("bb", 1.2, 5))
_RIM = "(SELECT max(q.v) FROM {0} q WHERE q.t = {0}.t AND abs(q.y - {0}.y) <= 1 AND abs(q.x - {0}.x) <= 1)"
register(
    "krn_1_gaussian",
    lambda s, sf: kernels.frame_kernel(raster(s, sf), ["t"], "v", kernels.Gaussian((0.6, 0.9))).select("t", "y", "x", (F.round(F.col("v") + 1e-9, 4) + 0.0).alias("v")),
    _with(RASTER, *_line_sql("la", 0.6, 2), *_smooth_sql("sa", "r", "la"), *_line_sql("lb", 0.45**0.5, 2), *_smooth_sql("sb", "sa", "lb")) + "SELECT t, y::int AS y, x::int AS x, round(v + 1e-9, 4) + 0.0::double AS v FROM sb",
)
register(
    "krn_8_log_response",
    lambda s, sf: kernels.frame_kernel(raster(s, sf), ["t"], "v", kernels.LaplaceOfGaussian((0.8, 1.2))).select("t", "y", "x", F.round(F.col("v") + 1e-9, 4).alias("v")),
    _with(RASTER, *_BLOBS, "bl AS (SELECT ba.t, ba.y, ba.x, greatest(ba.v, bb.v) AS v FROM ba JOIN bb USING (t, y, x))") + "SELECT t, y::int AS y, x::int AS x, round(v / (max(v) OVER (PARTITION BY t) + 1e-12) / 10 + 1e-9, 4) AS v FROM bl",
)
register(
    "krn_20_log_peaks",
    lambda s, sf: kernels.frame_kernel(raster(s, sf), ["t"], "v", kernels.LogPeaks((0.8, 1.2))).where("v > 0").select("t", "y", "x"),
    _with(
        RASTER, *_BLOBS,
        "pa AS (SELECT a.t, a.y, a.x, a.v, a.v > 0 AND max(q.v) = a.v AS peak FROM ba a JOIN ba q ON a.t = q.t AND abs(a.y - q.y) <= 1 AND abs(a.x - q.x) <= 1 GROUP BY a.t, a.y, a.x, a.v)",
        "pb AS (SELECT a.t, a.y, a.x, a.v, a.v > 0 AND max(q.v) = a.v AS peak FROM bb a JOIN bb q ON a.t = q.t AND abs(a.y - q.y) <= 1 AND abs(a.x - q.x) <= 1 GROUP BY a.t, a.y, a.x, a.v)",
    ) + "SELECT pa.t, pa.y::int AS y, pa.x::int AS x FROM pa JOIN pb USING (t, y, x) WHERE pa.peak OR pb.peak AND (NOT pa.peak OR pb.v > pa.v)",
)
# each volume's three projections as regions of interest: six invariants each
_VIEWS = (
    "vo AS (SELECT t // 8 AS image, (t % 8)::int AS z, y, x, v FROM q)",
    "pj AS (SELECT image, axis, a, b, max(v) AS v FROM (SELECT image, 'z' AS axis, y AS a, x AS b, v FROM vo UNION ALL SELECT image, 'y', z, x, v FROM vo UNION ALL SELECT image, 'x', z, y, v FROM vo) GROUP BY ALL)",
    "q3 AS (SELECT image || axis AS t, a AS y, b AS x, v FROM pj)",
    *[c.replace("FROM q ", "FROM q3 ").replace("SELECT q.t", "SELECT q3.t").replace("BY q.t", "BY q3.t") for c in (_CENT, _NORM, _HU)],
)
register(
    "agg_28_projection_hu",
    lambda s, sf: moments.log_hu_table(moments.projections(_volume(s, sf), ["image"], "v"), ["image", "axis"], "a", "b", "v").select(F.concat(F.col("image").cast("string"), "axis").alias("t"), *[F.round(F.col(f"h{i}") + 1e-9, 3).alias(f"h{i}") for i in range(1, 7)]),
    _with(RASTER, _POSV, *_VIEWS) + "SELECT t, " + ", ".join(f"round(CASE WHEN h{i} = 0 THEN 0 ELSE -sign(h{i}) * log10(greatest(abs(h{i}), 2.2250738585072014e-308)) END + 1e-9, 3) AS h{i}" for i in range(1, 7)) + " FROM hu",
)
# thinning: a frame with a rim of zeros as a list of 100 cells; each recursion is a step, until two in turn take nothing
_RING = [f"m[i {d:+d}]" for d in (-10, -9, 1, 11, 10, 9, -1, -11)]
_TURNS = " + ".join(f"({a} < {b})::int" for a, b in zip(_RING, _RING[1:] + _RING[:1], strict=True))
_N, _E, _S, _W = _RING[::2]
_THIN = (
    f"m0 AS (SELECT g.t, list(coalesce(v > {MASK}, false)::int ORDER BY gy, gx) AS m FROM (SELECT * FROM (SELECT DISTINCT t FROM r), range(-1, 9) a(gy), range(-1, 9) b(gx)) g LEFT JOIN r ON r.t = g.t AND r.y = gy AND r.x = gx GROUP BY g.t)",
    "th AS (SELECT t, 0 AS k, 0 AS still, m FROM m0 UNION ALL SELECT t, k + 1, CASE WHEN n = m THEN still + 1 ELSE 0 END, n FROM (SELECT *, "
    f"[CASE WHEN m[i] = 1 AND {' + '.join(_RING)} BETWEEN 2 AND 6 AND {_TURNS} = 1 AND CASE WHEN k % 2 = 0 THEN {_E} * {_S} * ({_N} + {_W}) ELSE {_N} * {_W} * ({_E} + {_S}) END = 0 THEN 0 ELSE m[i] END for i in range(1, 101)] AS n FROM th WHERE still < 2))",
    "sk AS (SELECT t, (p // 10 - 1)::int AS y, (p % 10 - 1)::int AS x FROM (SELECT t, unnest(m) AS v, unnest(range(100)) AS p FROM th WHERE still = 2) WHERE v = 1)",
)
register(
    "krn_12_skeletonize",
    lambda s, sf: kernels.frame_kernel(raster(s, sf).withColumn("v", (F.col("v") > MASK).cast("double")), ["t"], "v", kernels.Thinning()).where("v > 0").select("t", "y", "x"),
    _with(RASTER, *_THIN) + "SELECT t, y, x FROM sk",
)
register(
    "krn_12_skeletonize_3d",
    lambda s, sf: kernels.frame_kernel(volume(s, sf).withColumn("v", (F.col("v") > MASK).cast("double")), ["image"], "v", kernels.Thinning3D(), ("z", "y", "x")).where("v > 0").select("image", "z", "y", "x"),
)

# volumes of eight frames: Hessian, eigenvalues, vesselness with a z axis
_VZ, _VY, _VX = "(PARTITION BY image, y, x ORDER BY z)", "(PARTITION BY image, z, x ORDER BY y)", "(PARTITION BY image, z, y ORDER BY x)"
_ACROSS = {"z": _VZ, "y": _VY, "x": _VX}
_HESS3 = (
    "vo AS (SELECT t // 8 AS image, (t % 8)::int AS z, y, x, v FROM r)",
    "v1 AS (SELECT *, " + ", ".join(f"{_LINE.format(v='v', w=w)} AS g{a}" for a, w in _ACROSS.items()) + " FROM vo)",
    "h3 AS (SELECT image, z, y, x, " + ", ".join(f"{_LINE.format(v=f'g{a}', w=_ACROSS[b])} AS g{a}{b}" for a, b in ("zz", "zy", "zx", "yy", "yx", "xx")) + " FROM v1)",
    "e1 AS (SELECT *, (gzz + gyy + gxx) / 3 AS q, sqrt((pow(gzz - (gzz + gyy + gxx) / 3, 2) + pow(gyy - (gzz + gyy + gxx) / 3, 2) + pow(gxx - (gzz + gyy + gxx) / 3, 2) + 2 * (gzy * gzy + gzx * gzx + gyx * gyx)) / 6) AS p FROM h3)",
    "e2 AS (SELECT *, CASE WHEN p > 0 THEN greatest(-1, least(1, ((gzz - q) * ((gyy - q) * (gxx - q) - gyx * gyx) - gzy * (gzy * (gxx - q) - gyx * gzx) + gzx * (gzy * gyx - (gyy - q) * gzx)) / (2 * p * p * p))) ELSE 0 END AS c FROM e1)",
    "e3 AS (SELECT image, z, y, x, q + 2 * p * cos(acos(c) / 3) AS a, q + 2 * p * cos(acos(c) / 3 + 2 * pi() / 3) AS b, 3 * q AS s FROM e2)",
    "e4 AS (SELECT image, z, y, x, list_sort([{'s': abs(a), 'e': a}, {'s': abs(s - a - b), 'e': s - a - b}, {'s': abs(b), 'e': b}]) AS l FROM e3)",
    "eg3 AS (SELECT image, z, y, x, l[1].e AS l1, l[2].e AS l2, l[3].e AS l3 FROM e4)",
)


def _eigen_volume(spark, sf):
    h = stencil.hessian_3d(volume(spark, sf), ["image"])
    l1, l2, l3 = stencil.eigen_3d(*[F.col(f"g{ab}") for ab in ("zz", "zy", "zx", "yy", "yx", "xx")])
    return h.select("image", "z", "y", "x", l1.alias("l1"), l2.alias("l2"), l3.alias("l3"))


# slabs of bright cells of each volume as regions: second moments, and their eigenvalues as above
_SLAB = (
    "vo AS (SELECT t // 8 AS image, (t % 8)::int AS z, y, x, v FROM r)",
    f"""h3 AS (SELECT image, y // 4 AS label, 0 AS z, var_pop(z) * 0.25 + 0.25 / 12 AS gzz, covar_pop(z, y) * 0.1 AS gzy, covar_pop(z, x) * 0.15 AS gzx,
      var_pop(y) * 0.04 + 0.04 / 12 AS gyy, covar_pop(y, x) * 0.06 AS gyx, var_pop(x) * 0.09 + 0.09 / 12 AS gxx FROM vo WHERE v > {MASK} GROUP BY ALL)""",
    *[c.replace("image, z, y, x", "image, label") for c in _HESS3[3:]],
)
register(
    "agg_12_axis_lengths_3d",
    lambda s, sf: _r6(regions.geometry(volume(s, sf).where(f"v > {MASK}").withColumn("label", F.floor(F.col("y") / F.lit(4))), ["image", "label"], ("z", "y", "x"), (0.5, 0.2, 0.3)).select("image", "label", "axis_major", "axis_minor"), "axis_major", "axis_minor"),
    _with(RASTER, *_SLAB) + "SELECT image, label, round(sqrt(20 * l3) + 1e-9, 6) AS axis_major, round(sqrt(20 * greatest(l1, 0)) + 1e-9, 6) AS axis_minor FROM eg3",
)
register("krn_5_eigen_3d", lambda s, sf: _eigen_volume(s, sf).select("image", "z", "y", "x", *[F.round(F.abs(f"l{i}") + 1e-7, 5).alias(f"l{i}") for i in (1, 2, 3)]), _with(RASTER, *_HESS3) + "SELECT image, z, y, x, " + ", ".join(f"round(abs(l{i}) + 1e-7, 5) AS l{i}" for i in (1, 2, 3)) + " FROM eg3")
_VES3 = "CASE WHEN l2 > 0 OR l3 > 0 THEN 0 ELSE (1 - exp(-pow(abs(l2) / (abs(l3) + 1e-12), 2) / 0.5)) * exp(-pow(abs(l2) / (sqrt(abs(l2 * l3)) + 1e-12), 2) / 0.5) * (1 - exp(-(l1 * l1 + l2 * l2 + l3 * l3) / 0.02)) END"
register("krn_6_vesselness_3d", lambda s, sf: _eigen_volume(s, sf).select("image", "z", "y", "x", F.round(stencil.vesselness_3d(F.col("l1"), F.col("l2"), F.col("l3"), F.lit(2 * 0.1 * 0.1)) + 1e-7, 4).alias("vessel")), _with(RASTER, *_HESS3) + f"SELECT image, z, y, x, round({_VES3} + 1e-7, 4) AS vessel FROM eg3")
register("krn_22_tiles", lambda s, sf: kernels.tiles(raster(s, sf), YX, (4, 4), (1, 1), SHAPE).groupBy("t", "tile_y", "tile_x").agg(F.count("*").alias("n"), F.sum(F.col("halo").cast("int")).alias("halo")),
    _with(RASTER) + "SELECT t, ty::int AS tile_y, tx::int AS tile_x, count(*) AS n, sum((y // 4 <> ty OR x // 4 <> tx)::int)::bigint AS halo FROM r, range(2) a(ty), range(2) b(tx) WHERE y BETWEEN ty * 4 - 1 AND ty * 4 + 4 AND x BETWEEN tx * 4 - 1 AND tx * 4 + 4 GROUP BY ALL")
