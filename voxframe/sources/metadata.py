"""Image metadata: resolutions, axes, time ranges, file names, validation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Micrometres in one unit of a TIFF resolution tag.
MICRONS = {"centimeter": 1e4, "inch": 25400.0}
AXES = "TZCYX"
#: File name endings by format.
FORMATS = {".ome.tif": "ome", ".ome.tiff": "ome", ".tif": "tiff", ".tiff": "tiff", ".nd2": "nd2"}


def tag_resolution(numerator: Column, denominator: Column, unit: Column) -> Column:
    """Micrometres a pixel of a TIFF tag (pixels a unit as a fraction); without a known unit the bare ratio; null for 0."""
    scale = F.when(unit == "centimeter", MICRONS["centimeter"]).when(unit == "inch", MICRONS["inch"]).otherwise(1.0)
    return F.when(numerator != 0, denominator / numerator * scale)


def inverse(x: Column) -> Column:
    """1 / x, null for 0: slice spacing from slices a unit, seconds a frame from a frame rate."""
    return F.when(x != 0, 1 / x)


def time_differences(df: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    line = Window.partitionBy(*by).orderBy(time, tie)
    return df.withColumn("diff", F.col(time) - F.lag(time).over(line))


def median_interval(df: DataFrame, by: list[str], time: str, tie: str) -> DataFrame:
    """by, dt: median difference of successive times; null where there are fewer than two."""
    return time_differences(df, by, time, tie).groupBy(*by).agg(F.median("diff").alias("dt"))


def file_format(path: Column) -> Column:
    """tiff, nd2 or null, by the ending whatever its case."""
    low = F.lower(path)
    return F.when(low.endswith(".tif") | low.endswith(".tiff"), "tiff").when(low.endswith(".nd2"), "nd2")


def metadata_kind(is_ome: Column, is_imagej: Column, tags: Column) -> Column:
    """ome, imagej, imagej_tif_tags or none: which of a TIFF's descriptions is read."""
    return F.when(is_ome, "ome").when(is_imagej & ~tags, "imagej").when(is_imagej & tags, "imagej_tif_tags").otherwise("none")


def number_text(x: Column) -> Column:
    """Rounded to four places, the point written as p."""
    return F.replace(F.format_string("%.4f", F.round(x, 4)), F.lit("."), F.lit("p"))


def output_name(stem: Column, axes: Column, x: Column, y: Column, z: Column, t: Column, channel: Column, start: Column, end: Column) -> Column:
    """stem-axes-res..-ch-t0_to_t1: parts that are null are left out."""
    part = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(k), number_text(v)))
    span = F.when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("t"), start.cast("string"), F.lit("_to_"), end.cast("string")))
    return F.concat_ws("-", stem, axes, part("X", x), part("Y", y), part("Z", z), part("T", t), F.concat(F.lit("ch"), channel.cast("string")), span)


def validation_errors(axes: Column, ndim: Column, x: Column, y: Column, z: Column, t: Column, start: Column, end: Column, frames: Column) -> Column:
    """Messages of the rules an image breaks, in a fixed order; an empty array is a valid image."""
    has = lambda a: axes.contains(a)
    letters = F.split(axes, "")
    rules = [
        (axes.isNull() | (F.length(axes) == 0), "axes are not set"),
        (F.length(axes) != ndim, "axes and dimensions differ in number"),
        (F.size(F.array_distinct(letters)) != F.size(letters), "an axis is repeated"),
        (axes.rlike(f"[^{AXES}]"), "an axis is unknown"),
        (~has("X") | ~has("Y"), "X and Y are required"),
        (has("X") & x.isNull(), "X resolution is missing"),
        (has("Y") & y.isNull(), "Y resolution is missing"),
        (has("Z") & z.isNull(), "Z resolution is missing"),
        (has("T") & t.isNull(), "T resolution is missing"),
        (has("T") & ((start < 0) | (end >= frames) | (start > end)), "the time range is out of bounds"),
    ]
    return F.filter(F.array(*[F.when(rule, F.lit(text)) for rule, text in rules]), lambda m: m.isNotNull())


def coordinate(axes: Column, at: Column, axis: str) -> Column:
    """The place of a cell along an axis: that of the axis' letter in the axes, null if it has none; so any order of axes gives T, Z, Y, X."""
    place = F.locate(axis, axes)
    return F.when(place > 0, F.try_element_at(at, place.cast("int")))


def same_layout(files: DataFrame, axes: str, shape: str, by: list[str] | None = None) -> DataFrame:
    """A row for all files (of each group): whether they agree in axes and shape, and how many there are."""
    return files.groupBy(*(by or [])).agg(F.count("*").alias("files"), (F.countDistinct(F.struct(axes, shape)) <= 1).alias("same"))


def time_range(df: DataFrame, start: int, end: int, frames: int) -> DataFrame:
    """Rows of frames start .. end, both included; a range outside 0 .. frames - 1 is an error."""
    if not 0 <= start <= end < frames:
        raise IndexError(f"time range {start}..{end} is outside 0..{frames - 1}")
    return df.where(F.col("t").between(start, end))


def sigma_ladder(least_radius: float, most_radius: float, steps: int = 5, least_step: float = 0.2) -> list[float]:
    """Scales from half the least radius to a third of the most, in pixels; at least least_step apart."""
    low, high = least_radius / 2, most_radius / 3
    step = max(least_step, (high - low) / steps)
    return [low + k * step for k in range(max(1, math.ceil((high - low) / step - 1e-9)))]


def min_object_pixels(radius: Column, spacing: list[Column]) -> Column:
    """Voxels of a disc or ball of the radius (no smaller than the X spacing), rounded up, at least 1."""
    r = F.greatest(radius, spacing[-1])
    if len(spacing) == 2:
        return F.greatest(F.ceil(F.lit(3.141592653589793) * r * r / (spacing[0] * spacing[1])), F.lit(1))
    return F.greatest(F.ceil(F.lit(4 / 3 * 3.141592653589793) * r * r * r / (spacing[0] * spacing[1] * spacing[2])), F.lit(1))
