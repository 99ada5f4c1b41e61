"""Queries of the composite verbs and of written stage tables."""

from __future__ import annotations

import re
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe import queries_points as qp
from voxframe import queries_raster as qr
from voxframe.plans import settings
from voxframe.plans.adapters import HIERARCHY, POINTS, RASTER, hierarchy, mosaic, mosaic_volume, raster
from voxframe.plans.engine import Config, Engine
from voxframe.plans.session import checkpointed, shared_dir
from voxframe.registry import register
from voxframe.sources.stages import FEATURES, STAGES, StageStore
from voxframe.sources.tiff import TiffSource, pages_to_cells, write_stacks

#: Frames of 64 x 64 cells, and volumes of 8 x 32 x 32; the small ones of single vectors are for oracles.
CONFIG = Config(height=64, width=64, least_radius=2.0, most_radius=6.0, least_object=2, most_speed=3.0, match_speed=2.0)
VOLUME = Config(depth=8, height=32, width=32, least_radius=2.0, most_radius=6.0, least_object=2, smooth_mask=False, most_speed=3.0, match_speed=2.0)
SMALL = Config(bins=16, least_object=1)


def _frames(spark, sf):
    return mosaic(spark, sf)


def _volumes(spark, sf):
    return mosaic_volume(spark, sf)


def _round(df, *cols):
    return df.select(*[F.round(F.col(c) + 1e-9, 4).alias(c) if c in cols else c for c in df.columns])


def _labels(spark, sf):
    """Labels of the raw frames, so that the later verbs can be asked for alone."""
    return checkpointed(Engine(replace(CONFIG, threshold=0.05, smooth_mask=False)).label(_frames(spark, sf)))


def digest(tables: dict[str, DataFrame]) -> DataFrame:
    """name, rows, columns, total (of all numbers, rounded) of each table."""
    out = None
    for name, df in tables.items():
        numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "integer", "long")]
        total = F.lit(0.0)
        for c in numbers:
            total = total + F.coalesce(F.sum(F.round(F.col(c).cast("double"), 3)), F.lit(0.0))
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.round(total, 1).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


#: The filter of single vectors at two scales; a frame at a scale is a frame of its own to the thresholds, numbered 2 t + k.
TWO_SCALES = replace(SMALL, least_radius=2.0, most_radius=4.0)
_SCALES = (
    RASTER.replace("r AS", "r0 AS", 1),
    *qr._line_sql("la", 1.0, 3), *qr._smooth_sql("sa", "r0", "la"), *qr._line_sql("lb", 0.44**0.5, 2), *qr._smooth_sql("sb", "sa", "lb"),
    "r AS (SELECT t * 2 AS t, y, x, v FROM sa UNION ALL SELECT t * 2 + 1, y, x, v FROM sb)",
    *[x.replace("FROM r JOIN", "FROM r0 JOIN") for x in (*qr._blob_sql("ba", 1.0, 4), *qr._blob_sql("bb", 1.2, 5))],
)
_NORM_BAR = [re.sub(r"\b(src|ends|cnt|hist|cum|otsu|shape|pk|tri[012]|triangle|both_t)\b", r"\g<1>_f", x) for x in ("src AS (SELECT * FROM fr WHERE v > 0)", qr._OTSU, qr._TRIANGLE, qr._BOTH)]
_FILTER = (
    *_SCALES, qr.POS, qr._OTSU, qr._TRIANGLE, qr._BOTH, *qr._HESS, *qr._EIG, qr._FROB, *_NORM_BAR,
    "fb AS (SELECT fr.t, y, x, fr.v > coalesce(threshold / 2, 0) AS strong FROM fr LEFT JOIN both_t_f USING (t))",
    f"ra AS (SELECT fb.t // 2 AS t, fb.y, fb.x, strong, {qr._VES.replace('0.02', '(2 * pow(greatest(threshold, 2.220446049250313e-16), 2))')} AS v FROM fb JOIN eg ON fb.t = eg.t AND fb.y = eg.y AND fb.x = eg.x JOIN both_t ON both_t.t = fb.t WHERE fb.t IN (SELECT t FROM fb WHERE strong))",
    "be AS (SELECT t, y, x, max(CASE WHEN strong THEN v ELSE 0 END) AS v, bool_and(strong) AS strong FROM ra GROUP BY ALL)",
    "o1 AS (SELECT ba.t, ba.y, ba.x, CASE WHEN coalesce(strong, true) THEN coalesce(be.v, 0) ELSE 0 END AS v, CASE WHEN coalesce(strong, true) THEN greatest(ba.v, bb.v) ELSE 0 END AS blob FROM ba JOIN bb USING (t, y, x) LEFT JOIN be USING (t, y, x))",
    "o2 AS (SELECT t, y::int AS y, x::int AS x, greatest(v, blob / (max(blob) OVER (PARTITION BY t) + 1e-12) / 10) AS v FROM o1)",
    "km AS (SELECT o2.t, y, x FROM o2 JOIN (SELECT t, quantile_cont(v, 0.01) FILTER (v > 0) AS faint FROM o2 GROUP BY t) USING (t) WHERE v > faint)",
    "er AS (SELECT a.t, a.y, a.x FROM km a JOIN km b ON a.t = b.t AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(*) = 5)",
    "op AS (SELECT DISTINCT o2.t, o2.y, o2.x FROM o2 JOIN er ON o2.t = er.t AND abs(o2.y - er.y) + abs(o2.x - er.x) <= 1)",
)
register(
    "opr_1_filter",
    lambda s, sf: _round(Engine(TWO_SCALES).vesselness(raster(s, sf)), "v"),
    qr._with(*_FILTER) + "SELECT o2.t, o2.y, o2.x, round(CASE WHEN op.t IS NULL THEN 0 ELSE v END + 1e-9, 4) AS v FROM o2 LEFT JOIN op ON o2.t = op.t AND o2.y = op.y AND o2.x = op.x",
)
register("opr_1_filter_wide", lambda s, sf: _round(Engine(CONFIG).vesselness(_frames(s, sf)), "v"))
register("opr_1_filter_3d", lambda s, sf: _round(Engine(VOLUME).vesselness(_volumes(s, sf)), "v"))
register("opr_2_label", lambda s, sf: Engine(replace(SMALL, threshold=0.05, least_object=3)).label(raster(s, sf)), qr._with(
    RASTER, *qr._CC, "lg AS (SELECT t, y, x FROM lab QUALIFY count(*) OVER (PARTITION BY t, label) >= 3)",
    # the mean of nine cells, edges repeated, above a half: five or more
    "st AS (SELECT a.v AS dy, b.v AS dx FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v))",
    "sm AS (SELECT r.t, r.y, r.x FROM r, st JOIN lg ON lg.t = r.t AND lg.y = greatest(0, least(7, r.y + dy)) AND lg.x = greatest(0, least(7, r.x + dx)) GROUP BY ALL HAVING count(*) >= 5)",
    "sc AS (SELECT t, y, x, y * 8 + x AS o FROM sm)",
    "rs AS (SELECT t, o, o AS root, y, x FROM sc UNION SELECT c.t, c.o, q.root, c.y, c.x FROM rs q JOIN sc c ON c.t = q.t AND abs(c.y - q.y) <= 1 AND abs(c.x - q.x) <= 1 AND q.root < c.o)",
    "sr AS (SELECT t, y, x, min(root) AS root FROM rs GROUP BY ALL)",
) + "SELECT t, y, x, dense_rank() OVER (PARTITION BY t ORDER BY root)::int AS label FROM sr")
register(
    "opr_3_network",
    lambda s, sf: Engine(SMALL).network(checkpointed(qr._components(s, sf)), raster(s, sf))[1],
    qr._with(
        RASTER, *qr._CC, *qr._THIN,
        "sl AS (SELECT t, y, x, label FROM sk JOIN lab USING (t, y, x))",
        "cl AS (SELECT a.t, a.y, a.x, a.label FROM sl a JOIN sl b ON a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(DISTINCT b.label) = 1 OR a.y IN (0, 7) OR a.x IN (0, 7))",
        "ms AS (SELECT t, label FROM lab EXCEPT SELECT t, label FROM cl)",
        "sx AS (SELECT t, y, x FROM cl UNION ALL SELECT t, y, x FROM (SELECT t, label, y, x FROM lab JOIN ms USING (t, label) JOIN r USING (t, y, x) QUALIFY row_number() OVER (PARTITION BY t, label ORDER BY v DESC, y, x) = 1))",
        "cm2 AS (SELECT a.t, a.y, a.x, a.y * 8 + a.x AS o FROM sx a JOIN sx b ON a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(*) < 4)",
        *[re.sub(r"\b(cm|reach|cc|lab)\b", r"\g<1>2", x) for x in qr._CC[1:]],
        "sd AS (SELECT lab.t, lab.label, lab.y, lab.x, lab2.label AS branch FROM lab JOIN lab2 ON lab.t = lab2.t AND lab.y = lab2.y AND lab.x = lab2.x)",
    ) + "SELECT lab.t, lab.label, lab.y, lab.x, arg_min(branch, (pow(lab.y - sd.y, 2) + pow(lab.x - sd.x, 2)) * 1000 + branch)::int AS branch FROM lab JOIN sd ON lab.t = sd.t AND lab.label = sd.label GROUP BY lab.t, lab.label, lab.y, lab.x",
)
register("opr_3_network_wide", lambda s, sf: Engine(CONFIG).network(_labels(s, sf), _frames(s, sf))[1])
register("opr_4_markers", lambda s, sf: Engine(CONFIG).markers(_labels(s, sf), _frames(s, sf), _frames(s, sf)).select("t", "id", "y", "x"))
register("opr_16_run", lambda s, sf: digest(Engine(CONFIG).run(_frames(s, sf))))
register("opr_16_run_3d", lambda s, sf: digest(Engine(VOLUME).run(_volumes(s, sf))))
register("opr_17_settings", lambda s, sf: settings.table(s), "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in settings.SETTINGS) + ") f(name, value, field)")
register("snk_1_flow_vectors", lambda s, sf: checkpointed(qp._flow(s, sf)).select("t", "pre", "post"), qp._with(POINTS, *qp._FLAT) + "SELECT t, pre, post FROM fw")
register("snk_2_voxel_matches", lambda s, sf: checkpointed(qp._candidates(s, sf)).select("t", "prev", "next"), qp._with(POINTS, *qp._SF, *qp._FWD, *qp._BWD, *qp._CAND) + "SELECT t, prev, next FROM cd")
register("snk_7_feature_scan", lambda s, sf: checkpointed(hierarchy(s, sf)).groupBy("t").agg(F.count("*").alias("n"), F.max("intensity").alias("top")), "WITH " + HIERARCHY + " SELECT t, count(*) AS n, max(intensity) AS top FROM h GROUP BY t")
register("snk_8_export", lambda s, sf: hierarchy(s, sf).where("t = 4").select("t", "intensity"), "WITH " + HIERARCHY + " SELECT t, intensity FROM h WHERE t = 4")


# stage tables and TIFF stacks, written to the shared folder and read back
def _store(spark) -> StageStore:
    return StageStore(spark, f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}")


def _stage_round_trip(spark, sf):
    return _store(spark).write("labels", raster(spark, sf).where("v > 0.05").select("t", "y", "x", F.lit(1).alias("label"))).select(F.col("t").cast("long").alias("t"), "y", "x", "label")


def _readiness(spark, sf, remove=False):
    """Which stages are there after two are written, and after the intermediate ones are removed."""
    store = _store(spark)
    frames = raster(spark, sf).groupBy("t").agg(F.max("v").alias("top"))
    store.write("flow", frames.coalesce(1).select(F.col("top").alias("cost")))
    store.write("features_image", frames.coalesce(1).select("top"))
    if remove:
        store.remove_intermediates()
    return spark.createDataFrame([(k, store.ready(k)) for k in STAGES + FEATURES], "stage string, ready boolean")


def _ready_sql(*there: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(k in there).lower()})" for k in STAGES + FEATURES) + ") f(stage, ready)"


def _tiff_read(spark, sf):
    """Frames written as TIFF pages by tasks, one stack for eight of them, and read back by the source, a page a partition."""
    root = f"{shared_dir(spark)}/tiff-{uuid.uuid4().hex}"
    write_stacks(raster(spark, sf).withColumn("stack", F.floor(F.col("t") / F.lit(8)).cast("long")), "stack", "t", "v", root)
    spark.dataSource.register(TiffSource)
    pages = spark.read.format("tiff_frames").load(root)
    return pages_to_cells(pages).select(F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("stack"), "page", "y", "x", F.round(F.col("v") + 1e-9, 6).alias("v"))


register("src_1_tiff_read", _tiff_read, "WITH " + RASTER + " SELECT t // 8 AS stack, (dense_rank() OVER (PARTITION BY t // 8 ORDER BY t) - 1)::int AS page, y, x, round(v + 1e-9, 6) AS v FROM r")
register("src_9_open_stage", _stage_round_trip, "WITH " + RASTER + " SELECT t, y, x, 1 AS label FROM r WHERE v > 0.05")
register("src_10_write_stage", lambda s, sf: _stage_round_trip(s, sf).groupBy("t").agg(F.sum("label").alias("n")), "WITH " + RASTER + " SELECT t, count(*) AS n FROM r WHERE v > 0.05 GROUP BY t")
register("src_11_stage_paths", lambda s, sf: s.createDataFrame([(k, _path_end(s, k)) for k in STAGES + FEATURES], "stage string, path string"), "SELECT * FROM (VALUES " + ", ".join(f"('{k}', 'run/{k}')" for k in STAGES + FEATURES) + ") f(stage, path)")
register("src_16_readiness", _readiness, _ready_sql("flow", "features_image"))
register("snk_9_remove_intermediates", lambda s, sf: _readiness(s, sf, True), _ready_sql("features_image"))


def _path_end(spark, stage):
    return StageStore(spark, "run/").path(stage)
