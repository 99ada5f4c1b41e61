"""Queries over the hierarchy and metadata views: roll-ups, edges, overlays, views, names, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.functions import scalar, thresholds
from voxframe.functions.scalar import tidy
from voxframe.operators import features, stats
from voxframe.plans.adapters import HIERARCHY, PARTS, hierarchy, parts
from voxframe.registry import register
from voxframe.sources import metadata

_FIVE = "round(avg({0}) + 1e-7, 4) AS {0}_mean, round(stddev_pop({0}) + 1e-7, 4) AS {0}_std_dev, round(min({0}) + 1e-7, 4) AS {0}_min, round(max({0}) + 1e-7, 4) AS {0}_max, round(sum({0}) + 1e-5, 3) AS {0}_sum"


def _with(*p: str) -> str:
    return "WITH " + ", ".join(p) + " "


def _round(df, *names):
    def one(c):
        for n in names:
            if c == f"{n}_sum":
                return F.round(F.col(c) + 1e-5, 3).alias(c)
            if c.startswith(f"{n}_"):
                return F.round(F.col(c) + 1e-7, 4).alias(c)
        return F.col(c)

    return df.select(*[one(c) for c in df.columns])


def _level(level, *values):
    return lambda s, sf: _round(features.level_table(hierarchy(s, sf), level, list(values)), *values)


def _level_sql(level, *values):
    label = "0::bigint AS label" if level == "image" else f"{level} AS label"
    by = "t" if level == "image" else f"t, {level}"
    return _with(HIERARCHY) + f"SELECT t, {label}, {', '.join(_FIVE.format(v) for v in values)} FROM h GROUP BY {by}"


register("agg_1_five_stats", _level("branch", "intensity"), _level_sql("branch", "intensity"))
register("agg_3_voxel_to_branch", _level("branch", "intensity", "structure"), _level_sql("branch", "intensity", "structure"))
register("agg_4_to_organelle", _level("organelle", "intensity", "x"), _level_sql("organelle", "intensity", "x"))
register("agg_5_to_image", _level("image", "intensity", "structure", "x"), _level_sql("image", "intensity", "structure", "x"))
register("opr_8_hierarchy_branch", _level("branch", "intensity", "structure", "x"), _level_sql("branch", "intensity", "structure", "x"))
register("snk_3_feature_table", _level("organelle", "structure"), _level_sql("organelle", "structure"))
register("snk_4_feature_columns", lambda s, sf: _long(s, sf), _with(HIERARCHY, "f AS (SELECT t, avg(intensity) AS intensity_mean, max(structure) AS structure_max FROM h GROUP BY t)") + "SELECT t, 'intensity' AS feature, 'mean' AS form, round(intensity_mean + 1e-7, 4) AS value FROM f UNION ALL SELECT t, 'structure', 'max', round(structure_max + 1e-7, 4) FROM f")


def _long(spark, sf):
    f = features.level_table(hierarchy(spark, sf), "image", ["intensity", "structure"])
    names = ["intensity_mean", "structure_max"]
    cells = F.explode(F.array(*[F.struct(F.lit(features.split_name(c)[0]).alias("feature"), F.lit(features.split_name(c)[1]).alias("form"), F.round(F.col(c) + 1e-7, 4).alias("value")) for c in names]))
    return f.select("t", cells.alias("c")).select("t", "c.*")


register("agg_7_mode", lambda s, sf: features.reassigned_label(hierarchy(s, sf).withColumn("q", F.col("x").cast("long") % 5), "branch", "q"), _with(HIERARCHY, "c AS (SELECT t, branch AS label, x::bigint % 5 AS q, count(*) AS n FROM h GROUP BY ALL)") + "SELECT t, label, q AS reassigned_label FROM c QUALIFY row_number() OVER (PARTITION BY t, label ORDER BY n DESC, q) = 1")


def _label_joins(spark, sf):
    h = hierarchy(spark, sf)
    size = lambda level: h.groupBy("t", F.col(level).alias("label")).agg(F.count("*").alias("n"))
    return features.label_joins(h.select("t", "id", "branch", "organelle"), size("branch"), size("organelle"))


register(
    "jon_9_label_joins",
    _label_joins,
    _with(HIERARCHY, "b AS (SELECT t, branch, count(*) AS branch_n FROM h GROUP BY ALL)", "o AS (SELECT t, organelle, count(*) AS organelle_n FROM h GROUP BY ALL)")
    + "SELECT h.t, h.id, h.branch, h.organelle, branch_n, organelle_n FROM h JOIN b ON b.t = h.t AND b.branch = h.branch JOIN o ON o.t = h.t AND o.organelle = h.organelle",
)
_BO = "bo AS (SELECT t, branch, arg_min(organelle, id) AS organelle FROM h GROUP BY t, branch)"
register("jon_10_branch_to_organelle", lambda s, sf: features.branch_to_organelle(hierarchy(s, sf)), _with(HIERARCHY, _BO) + "SELECT t, branch, organelle FROM bo")
_ED = "ed AS (SELECT t, 'v_b' AS kind, id AS src, branch AS dst FROM h UNION ALL SELECT t, 'v_o', id, organelle FROM h UNION ALL SELECT t, 'b_o', branch, organelle FROM bo)"
register("jon_11_containment_edges", lambda s, sf: features.containment_edges(hierarchy(s, sf)), _with(HIERARCHY, _BO, _ED) + "SELECT t, kind, src, dst FROM ed")
register("snk_6_adjacency", lambda s, sf: features.containment_edges(hierarchy(s, sf)).groupBy("t", "kind").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("parents")), _with(HIERARCHY, _BO, _ED) + "SELECT t, kind, count(*) AS edges, count(DISTINCT dst) AS parents FROM ed GROUP BY ALL")


def _overlay(spark, sf):
    h = hierarchy(spark, sf)
    table = features.level_table(h, "branch", ["intensity"])
    return features.overlay(features.containment_edges(h).where("kind = 'v_b'"), table, "intensity_mean").select("t", "src", F.round(F.col("intensity_mean") + 1e-7, 4).alias("intensity_mean"))


_OV = _with(HIERARCHY, "f AS (SELECT t, branch, avg(intensity) AS m FROM h GROUP BY t, branch)") + "SELECT h.t, id AS src, round(avg(m) + 1e-7, 4) AS intensity_mean FROM h JOIN f ON h.t = f.t AND h.branch = f.branch GROUP BY h.t, id"
register("jon_12_overlay", _overlay, _OV)
register("opr_15_overlay", _overlay, _OV)
register("jon_13_lookup", lambda s, sf: features.lookup(hierarchy(s, sf), "x = 17 and structure > 0.05"), _with(HIERARCHY) + "SELECT t, id, branch, organelle, 0 AS image FROM h WHERE x = 17 AND structure > 0.05")
register("win_7_ordinals", lambda s, sf: _ordinals(s, sf), _with(HIERARCHY) + "SELECT t, id, row_number() OVER (PARTITION BY t, organelle ORDER BY id) - 1 AS ordinal FROM h")


def _ordinals(spark, sf):
    from pyspark.sql import Window

    return hierarchy(spark, sf).select("t", "id", (F.row_number().over(Window.partitionBy("t", "organelle").orderBy("id")) - 1).cast("long").alias("ordinal"))


register("prj_13_match_t", lambda s, sf: hierarchy(s, sf).where("t = 3").select("t", "id"), _with(HIERARCHY) + "SELECT t, id FROM h WHERE t = 3")
register("prj_3_time_range", lambda s, sf: metadata.time_range(hierarchy(s, sf), 1, 3, 7).select("t", "id"), _with(HIERARCHY) + "SELECT t, id FROM h WHERE t BETWEEN 1 AND 3")
register("prj_2_channel", lambda s, sf: s.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber = 2").select("l_orderkey", "l_quantity"), "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_linenumber = 2")


def _axes_order(spark, sf):
    """Cells whose coordinates stand in the order of their image's axes: XTY for even parts, TZYX with one plane for odd ones."""
    p = parts(spark, sf)
    axes = F.when(F.col("image_id") % 2 == 0, "XTY").otherwise("TZYX")
    t, y, x = (F.col("image_id") % 7).cast("int"), F.col("num").cast("int"), F.col("unit")
    at = F.when(F.col("image_id") % 2 == 0, F.array(x, t, y)).otherwise(F.array(t, F.lit(0), y, x))
    cells = p.select("image_id", axes.alias("axes"), at.alias("at"))
    return cells.select("image_id", *[metadata.coordinate(F.col("axes"), F.col("at"), a).alias(a.lower()) for a in "TZYX"])


register("prj_1_axes_order", _axes_order, _with(PARTS) + "SELECT image_id, (image_id % 7)::int AS t, CASE WHEN image_id % 2 = 1 THEN 0 END AS z, num::int AS y, unit AS x FROM m")
register("prj_17_log_view", lambda s, sf: hierarchy(s, sf).where("structure > 0").select("id", tidy(F.log10("structure")).alias("v")), _with(HIERARCHY) + "SELECT id, round(log10(structure) + 1e-9, 6) AS v FROM h WHERE structure > 0")
register("prj_18_nan_to_zero", lambda s, sf: hierarchy(s, sf).select("id", tidy(F.coalesce(scalar.ratio(F.lit(1.0), F.col("structure")), F.lit(0.0))).alias("v")), _with(HIERARCHY) + "SELECT id, round(CASE WHEN structure <> 0 THEN 1 / structure ELSE 0 END + 1e-9, 6) AS v FROM h")
register("agg_36_percentiles", lambda s, sf: _percentiles(s, sf), _with(HIERARCHY) + "SELECT t, " + ", ".join(f"round(quantile_cont(intensity, {p}) + 1e-7, 4) AS p{int(p * 100)}" for p in (0.01, 0.25, 0.75, 0.98)) + " FROM h GROUP BY t")


def _percentiles(spark, sf):
    found = stats.quantiles(hierarchy(spark, sf), ["t"], "intensity", {f"p{int(p * 100)}": p for p in (0.01, 0.25, 0.75, 0.98)})
    return found.select("t", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in found.columns if c.startswith("p")])


_BY_T = " GROUP BY t"


def _views(spark, sf, **how):
    return stats.view(hierarchy(spark, sf), "intensity", by=["t"], **how)


register("agg_37_view_mean", lambda s, sf: _views(s, sf).select("t", "n", F.round("mean", 3).alias("mean"), F.round("std_dev", 3).alias("std_dev")), _with(HIERARCHY) + "SELECT t, count(*) AS n, round(avg(intensity), 3) AS mean, round(stddev_pop(intensity), 3) AS std_dev FROM h" + _BY_T)
register("agg_37_view_robust", lambda s, sf: _views(s, sf, robust=True).select("t", "n", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("q25", "median", "q75", "iqr")]), _with(HIERARCHY, "q AS (SELECT t, count(*) AS n, quantile_cont(intensity, 0.25) AS q25, quantile_cont(intensity, 0.5) AS median, quantile_cont(intensity, 0.75) AS q75 FROM h GROUP BY t)") + "SELECT t, n, round(q25 + 1e-7, 4) AS q25, round(median + 1e-7, 4) AS median, round(q75 + 1e-7, 4) AS q75, round(q75 - q25 + 1e-7, 4) AS iqr FROM q")


def _histogram(spark, sf):
    rows = hierarchy(spark, sf)
    return thresholds.histogram(rows, [], "intensity", int(rows.count() ** 0.5)).select("bin", "n")


register("agg_38_view_histogram", _histogram, "WITH " + HIERARCHY + ", e AS (SELECT min(intensity) AS lo, max(intensity) AS hi, floor(sqrt(count(*)))::int AS k FROM h), c AS (SELECT least(floor((intensity - lo) / (hi - lo) * k), k - 1)::int AS bin, count(*) AS n FROM h, e GROUP BY 1), g AS (SELECT unnest(range(k))::int AS bin FROM e) SELECT g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.bin = g.bin")
register("opr_14_analysis_view", lambda s, sf: stats.view(features.level_table(hierarchy(s, sf), "organelle", ["intensity"]), "intensity_mean", log=True).select("n", F.round(F.col("mean") + 1e-9, 6).alias("mean"), F.round(F.col("std_dev") + 1e-9, 6).alias("std_dev")), _with(HIERARCHY, "f AS (SELECT avg(intensity) AS v FROM h GROUP BY t, organelle)") + "SELECT count(*) AS n, round(avg(log10(v)) + 1e-9, 6) AS mean, round(stddev_pop(log10(v)) + 1e-9, 6) AS std_dev FROM f WHERE v > 0")
register("agg_32_joint_standard", lambda s, sf: _standard(s, sf), _with(HIERARCHY, "m AS (SELECT avg(structure) AS a, stddev_pop(structure) AS e FROM h)") + "SELECT id, round((structure - a) / (e + 1e-8) + 1e-9, 5) AS z FROM h, m")


def _standard(spark, sf):
    h = hierarchy(spark, sf)
    m = h.agg(F.avg("structure").alias("a"), F.stddev_pop("structure").alias("e"))  # one row
    return h.crossJoin(F.broadcast(m)).select("id", F.round((F.col("structure") - F.col("a")) / (F.col("e") + 1e-8) + 1e-9, 5).alias("z"))


register("set_5_distinct_pairs", lambda s, sf: hierarchy(s, sf).select("branch", "organelle").distinct(), _with(HIERARCHY) + "SELECT DISTINCT branch, organelle FROM h")
register("srt_1_target_distance", lambda s, sf: hierarchy(s, sf).groupBy("organelle").agg(F.min(F.struct("intensity", "id")).alias("b")).select("organelle", "b.id"), _with(HIERARCHY) + "SELECT organelle, id FROM h QUALIFY row_number() OVER (PARTITION BY organelle ORDER BY intensity, id) = 1")
register("srt_2_target_label_weight", lambda s, sf: _top_label(s, sf), _with(HIERARCHY, "c AS (SELECT t, branch % 10 AS label, round(sum(structure) + 1e-7, 4) AS w FROM h GROUP BY ALL)") + "SELECT t, label FROM c QUALIFY row_number() OVER (PARTITION BY t ORDER BY w DESC, label) = 1")


def _top_label(spark, sf):
    c = hierarchy(spark, sf).groupBy("t", (F.col("branch") % 10).alias("label")).agg(F.round(F.sum("structure") + 1e-7, 4).alias("w"))
    return c.groupBy("t").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("b")).select("t", (-F.col("b.l")).alias("label"))


register("srt_3_by_absolute", lambda s, sf: hierarchy(s, sf).select("id", F.element_at(F.array_sort(F.array(F.lit(0.05) - F.col("structure"), F.col("structure") - 0.02), lambda a, b: F.when(F.abs(a) < F.abs(b), -1).when(F.abs(a) > F.abs(b), 1).otherwise(0)), 1).alias("v")).select("id", F.round(F.abs("v") + 1e-9, 6).alias("v")), _with(HIERARCHY) + "SELECT id, round(least(abs(0.05::double - structure), abs(structure - 0.02::double)) + 1e-9, 6) AS v FROM h")
register("srt_6_sorted_names", lambda s, sf: parts(s, sf).select("name").distinct().orderBy("name"), _with(PARTS) + "SELECT DISTINCT name FROM m ORDER BY name")
register("srt_7_form_order", lambda s, sf: _forms(s), "SELECT * FROM (VALUES ('raw', 1), ('mean', 2), ('std_dev', 3), ('min', 4), ('max', 5), ('sum', 6)) f(form, place)")


def _forms(spark):
    return spark.createDataFrame([(f, i + 1) for i, f in enumerate(features.FORMS)], "form string, place int")


# metadata
_UNIT = "CASE unit WHEN 0 THEN 'centimeter' WHEN 1 THEN 'inch' END"


def _unit():
    return F.when(F.col("unit") == 0, "centimeter").when(F.col("unit") == 1, "inch")


register("src_6_tag_resolution", lambda s, sf: parts(s, sf).select("image_id", tidy(metadata.tag_resolution(F.col("num"), F.lit(1.0), _unit())).alias("res")), _with(PARTS) + f"SELECT image_id, round(1.0::double / num * CASE {_UNIT} WHEN 'centimeter' THEN 1e4 WHEN 'inch' THEN 25400 ELSE 1 END + 1e-9, 6) AS res FROM m")
register("src_5_resolution_fields", lambda s, sf: parts(s, sf).select("image_id", F.struct(F.col("price").alias("x"), F.col("num").alias("z")).alias("r")).select("image_id", tidy(F.col("r.x")).alias("x"), "r.z"), _with(PARTS) + "SELECT image_id, round(price + 1e-9, 6) AS x, num AS z FROM m")
register("src_4_metadata_kind", lambda s, sf: parts(s, sf).select("image_id", metadata.metadata_kind(F.col("unit") == 0, F.col("unit") == 1, F.col("num") > 25).alias("kind")), _with(PARTS) + "SELECT image_id, CASE WHEN unit = 0 THEN 'ome' WHEN unit = 1 AND num <= 25 THEN 'imagej' WHEN unit = 1 THEN 'imagej_tif_tags' ELSE 'none' END AS kind FROM m")
_FILE = "name || CASE unit WHEN 0 THEN '.TIF' WHEN 1 THEN '.nd2' ELSE '.png' END"


def _file():
    return F.concat("name", F.when(F.col("unit") == 0, ".TIF").when(F.col("unit") == 1, ".nd2").otherwise(".png"))


register("src_3_format_dispatch", lambda s, sf: parts(s, sf).select("image_id", metadata.file_format(_file()).alias("format")), _with(PARTS) + "SELECT image_id, CASE unit WHEN 0 THEN 'tiff' WHEN 1 THEN 'nd2' END AS format FROM m")
register("src_13_directory_scan", lambda s, sf: parts(s, sf).select(_file().alias("file")).where(F.col("file").contains("1") & F.lower("file").endswith(".tif")).select("file"), _with(PARTS) + f"SELECT {_FILE} AS file FROM m WHERE file LIKE '%1%' AND lower(file) LIKE '%.tif'")
register("src_14_same_layout", lambda s, sf: metadata.same_layout(parts(s, sf), "unit", "num", by=["kind"]), _with(PARTS) + "SELECT kind, count(*) AS files, count(DISTINCT (unit, num)) <= 1 AS same FROM m GROUP BY kind")
register(
    "src_12_output_name",
    lambda s, sf: parts(s, sf).select("image_id", metadata.output_name(F.col("name"), F.lit("TYX"), F.col("num") / F.lit(7.0), F.lit(None).cast("double"), F.when(F.col("unit") == 0, F.col("price")), F.lit(1.0), F.col("unit"), F.lit(0), F.col("num")).alias("file")),
    _with(PARTS) + "SELECT image_id, name || '-TYX-X' || replace(printf('%.4f', round(num / 7.0::double, 4)), '.', 'p') || CASE WHEN unit = 0 THEN '-Z' || replace(printf('%.4f', round(price, 4)), '.', 'p') ELSE '' END || '-T1p0000-ch' || unit || '-t0_to_' || num AS file FROM m",
)
register("src_8_provenance", lambda s, sf: parts(s, sf).select("image_id", F.to_json(F.struct("image_id", "num", "unit")).alias("provenance")), _with(PARTS) + "SELECT image_id, '{\"image_id\":' || image_id || ',\"num\":' || num || ',\"unit\":' || unit || '}' AS provenance FROM m")
_AX = "CASE unit WHEN 0 THEN 'TZYX' WHEN 1 THEN 'TYY' ELSE 'XQ' END"


def _validation(spark, sf):
    axes = F.when(F.col("unit") == 0, "TZYX").when(F.col("unit") == 1, "TYY").otherwise("XQ")
    null = F.lit(None).cast("double")
    errors = metadata.validation_errors(axes, F.lit(4), F.lit(0.1), F.lit(0.1), F.when(F.col("num") > 25, 0.3), null, F.lit(0), F.col("num"), F.lit(30))
    return parts(spark, sf).select("image_id", F.array_join(errors, "; ").alias("errors"))


register(
    "prj_4_validation",
    _validation,
    _with(PARTS)
    + """SELECT image_id, concat_ws('; ', CASE WHEN unit <> 0 THEN 'axes and dimensions differ in number' END, CASE WHEN unit = 1 THEN 'an axis is repeated' END, CASE WHEN unit = 2 THEN 'an axis is unknown' END,
    CASE WHEN unit <> 0 THEN 'X and Y are required' END, CASE WHEN unit = 0 AND num <= 25 THEN 'Z resolution is missing' END, CASE WHEN unit <> 2 THEN 'T resolution is missing' END, CASE WHEN unit <> 2 AND num >= 30 THEN 'the time range is out of bounds' END) AS errors FROM m""",
)
register("prj_5_overrides", lambda s, sf: parts(s, sf).select("image_id", F.coalesce(F.when(F.col("unit") == 1, 0.5), tidy(F.col("price"))).alias("x")), _with(PARTS) + "SELECT image_id, CASE WHEN unit = 1 THEN 0.5 ELSE round(price + 1e-9, 6) END::double AS x FROM m")
register("prj_14_split_names", lambda s, sf: _split(s), "SELECT * FROM (VALUES ('intensity_mean', 'intensity', 'mean'), ('branch_length_raw', 'branch_length', 'raw'), ('x_std_dev', 'x', 'std_dev'), ('rel_linear_vel_max', 'rel_linear_vel', 'max')) f(name, feature, form)")


def _split(spark):
    names = ["intensity_mean", "branch_length_raw", "x_std_dev", "rel_linear_vel_max"]
    return spark.createDataFrame([(n, *features.split_name(n)) for n in names], "name string, feature string, form string")


register("prj_15_numeric_columns", lambda s, sf: s.createDataFrame([(c,) for c in features.plottable(hierarchy(s, sf))], "name string"), "SELECT * FROM (VALUES ('id'), ('branch'), ('organelle'), ('intensity'), ('structure'), ('x')) f(name)")
register("prj_16_resolve_column", lambda s, sf: s.createDataFrame([(features.column_for(features.level_table(hierarchy(s, sf), "branch", ["x"]), "x"),)], "name string"), "SELECT 'x_mean' AS name")
register("prj_27_min_object_size", lambda s, sf: parts(s, sf).select("image_id", metadata.min_object_pixels(F.col("num") / F.lit(10.0), [F.lit(0.2), F.lit(0.3)]).alias("pixels")), _with(PARTS) + "SELECT image_id, greatest(ceil(3.141592653589793 * pow(greatest(num / 10.0::double, 0.3), 2) / (0.2::double * 0.3)), 1)::bigint AS pixels FROM m")
register("prj_28_sigma_ladder", lambda s, sf: s.createDataFrame([(i, round(v, 6)) for i, v in enumerate(metadata.sigma_ladder(2.5, 10.0))], "k int, sigma double"), "SELECT k::int AS k, round(1.25 + k * (10.0 / 3 - 1.25) / 5, 6)::double AS sigma FROM range(5) g(k)")
register("prj_29_sigma_vector", lambda s, sf: parts(s, sf).select("image_id", tidy(F.col("num") / (F.col("price") / F.lit(100.0))).alias("sigma_z"), F.col("num").cast("double").alias("sigma_x")), _with(PARTS) + "SELECT image_id, round(num / (price / 100.0::double) + 1e-9, 6) AS sigma_z, num::double AS sigma_x FROM m")
_SC = "abs(num - 25) AS a, sqrt(num) AS r, exp(-num / 10.0::double) AS e, sign(num - 25)::double AS g, round_even(num / 2.0::double, 0) AS h"
register("fn_scalar_math", lambda s, sf: parts(s, sf).select("image_id", F.abs(F.col("num") - 25).alias("a"), tidy(F.sqrt("num")).alias("r"), tidy(F.exp(-F.col("num") / F.lit(10.0))).alias("e"), F.signum(F.col("num") - 25).alias("g"), scalar.half_even(F.col("num") / F.lit(2.0)).alias("h")), _with(PARTS) + f"SELECT image_id, a, round(r + 1e-9, 6) AS r, round(e + 1e-9, 6) AS e, g, h FROM (SELECT image_id, {_SC} FROM m)")
register("fn_wrap_angle", lambda s, sf: parts(s, sf).select("image_id", tidy(scalar.wrap_angle(F.col("num") - F.lit(25.0))).alias("w")), _with(PARTS) + "SELECT image_id, round((num - 25 + pi()) - 2 * pi() * floor((num - 25 + pi()) / (2 * pi())) - pi() + 1e-9, 6) AS w FROM m")
register("fn_strings", lambda s, sf: parts(s, sf).select("image_id", F.lower("kind").alias("low"), F.replace("kind", F.lit(" "), F.lit("_")).alias("under"), F.col("kind").contains("A").alias("has")), _with(PARTS) + "SELECT image_id, lower(kind) AS low, replace(kind, ' ', '_') AS under, contains(kind, 'A') AS has FROM m")
register("fn_ravel_index", lambda s, sf: parts(s, sf).select("image_id", ((F.col("unit") * 50 + F.col("num")) * 10 + F.col("image_id") % 10).alias("flat")), _with(PARTS) + "SELECT image_id, (unit * 50 + num) * 10 + image_id % 10 AS flat FROM m")
register("fn_date_stamp", lambda s, sf: s.read.parquet(f"{sf}/events.parquet").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp")), "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
register("fn_arrays", lambda s, sf: parts(s, sf).select("image_id", F.array_join(F.transform(F.sequence(F.lit(1), F.col("unit") + 1), lambda i: (i * F.col("num")).cast("string")), ",").alias("line")), _with(PARTS) + "SELECT image_id, array_to_string([(i * num)::varchar FOR i IN range(1, unit + 2)], ',') AS line FROM m")


def _maps(spark, sf):
    """Feature maps of each image merged: later ones win, keys in order."""
    first = F.create_map(F.lit("num"), F.col("num"), F.lit("unit"), F.col("unit").cast("long"))
    second = F.create_map(F.lit("twice"), F.col("num") * 2)
    merged = F.map_concat(first.cast("map<string,bigint>"), second.cast("map<string,bigint>"))
    entries = F.array_sort(F.map_entries(merged))
    return parts(spark, sf).select("image_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("features"))


register("fn_maps", _maps, _with(PARTS) + "SELECT image_id, 'num=' || num || ',twice=' || num * 2 || ',unit=' || unit AS features FROM m")
