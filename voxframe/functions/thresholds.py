"""Histogram thresholds as aggregates: one pass to bin, then windows over the bins of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, by: list[str], value: str, bins: int = 256) -> DataFrame:
    """by, bin, n, low, width: counts in equal bins over [min, max], the last bin closed; bins without rows too.

    A group of one value is spread over [value - 0.5, value + 0.5]. Null values are left out.
    """
    known = df.where(F.col(value).isNotNull())
    ends = known.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    ends = ends.select(*by, F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    joined = known.join(ends, by) if by else known.crossJoin(F.broadcast(ends))  # without groups: one row of ends
    place = F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("int")
    counted = joined.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select(*by, "low", ((F.col("high") - F.col("low")) / bins).alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counted, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), "low", "width")


def _both(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """by, triangle, otsu from one histogram; null where a group has none.

    Otsu: centre of the first bin with the greatest between-class variance. Triangle: centre of the bin farthest from
    the line between the peak and the end of the longer tail. A group's bins are one window, shared by both.
    """
    group = Window.partitionBy(*by)
    up = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    after = group.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    center = F.col("low") + (F.col("bin") + 0.5) * F.col("width")
    h = histogram(df, by, value, bins).select(*by, "bin", "n", center.alias("center"))
    moment, filled = F.col("n") * F.col("center"), F.when(F.col("n") > 0, F.col("bin"))
    h = h.select(
        "*",
        F.sum("n").over(up).alias("w1"), F.sum("n").over(after).alias("w2"), F.sum(moment).over(up).alias("s1"), F.sum(moment).over(after).alias("s2"),
        F.max("n").over(group).alias("top"), F.min(filled).over(group).alias("first"), F.max(filled).over(group).alias("last"), F.sum("n").over(group).alias("total"),
    )
    h = h.withColumn("peak", F.min(F.when(F.col("n") == F.col("top"), F.col("bin"))).over(group))
    # otsu
    gap = F.col("s1") / F.col("w1") - F.col("s2") / F.col("w2")
    spread = F.when((F.col("w1") > 0) & (F.col("w2") > 0), F.struct(F.round(F.col("w1").cast("double") * F.col("w2") * gap * gap, 9).alias("spread"), (-F.col("bin")).alias("first")))
    # triangle, mirrored if the longer tail is behind the peak
    flip = (F.col("peak") - F.col("first")) < (F.col("last") - F.col("peak"))
    mirrored = lambda c: F.when(flip, bins - 1 - F.col(c)).otherwise(F.col(c))
    at, top_at, low_at = mirrored("bin"), mirrored("peak"), F.when(flip, bins - 1 - F.col("last")).otherwise(F.col("first"))
    width = top_at - low_at
    share, peak_share = F.col("n") / F.col("total"), F.col("top") / F.col("total")
    length = F.sqrt(peak_share * peak_share + width * width)
    far = F.round(peak_share / length * (at - low_at) - width / length * share, 9)
    below = F.when((at >= low_at) & (at < top_at), F.struct(far.alias("far"), (-at).alias("first")))
    h = h.select(*by, "center", spread.alias("spread"), below.alias("below"))
    return h.groupBy(*by).agg(F.max_by("center", "below").alias("triangle"), F.max_by("center", "spread").alias("otsu"))


def otsu(df: DataFrame, by: list[str], value: str, bins: int = 256) -> DataFrame:
    """by, threshold: centre of the first bin with the greatest between-class variance."""
    return _both(df, by, value, bins).select(*by, F.col("otsu").alias("threshold")).where("threshold is not null")


def triangle(df: DataFrame, by: list[str], value: str, bins: int = 256) -> DataFrame:
    """by, threshold: centre of the bin farthest from the line between the peak and the end of the longer tail."""
    return _both(df, by, value, bins).select(*by, F.col("triangle").alias("threshold")).where("threshold is not null")


def smaller_of_both(df: DataFrame, by: list[str], value: str, bins: int = 256) -> DataFrame:
    """by, triangle, otsu, threshold: the smaller of both where both exist."""
    return _both(df, by, value, bins).select(*by, "triangle", "otsu", F.least("triangle", "otsu").alias("threshold")).where("threshold is not null")


def gamma(df: DataFrame, by: list[str], value: str, bins: int = 256) -> DataFrame:
    """The smaller threshold of the positive values, at least the double's epsilon."""
    both = smaller_of_both(df.where(F.col(value) > 0), by, value, bins)
    return both.select(*by, F.greatest("threshold", F.lit(2.220446049250313e-16)).alias("gamma"))


def log_threshold(df: DataFrame, by: list[str], value: str, bins: int = 256) -> DataFrame:
    """The smaller threshold of log10 of the positive values, taken back by a power of ten."""
    logs = df.where(F.col(value) > 0).withColumn("_log", F.log10(value))
    return smaller_of_both(logs, by, "_log", bins).select(*by, F.pow(F.lit(10.0), F.col("threshold")).alias("threshold"))
