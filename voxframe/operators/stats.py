"""Group statistics: five numbers, mode, quantiles, views of a feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.scalar import finite, log10_positive
from voxframe.plans.session import checkpointed

SUFFIXES = ("mean", "std_dev", "min", "max", "sum")


def five(value: str, name: str | None = None) -> list[Column]:
    """mean, std_dev (ddof 0), min, max, sum of a column without its nulls; a sum of nothing is 0."""
    c, n = F.col(value), name or value
    return [F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std_dev"), F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"), F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{n}_sum")]


def five_stats(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """One row per group with the five statistics of each value column; NaN counts as null."""
    clean = df.select(*by, *[finite(F.col(v).cast("double")).alias(v) for v in values])
    return clean.groupBy(*by).agg(*[c for v in values for c in five(v)])


def smallest_mode(value: str) -> Column:
    return F.mode(value, True)


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, n and one column for each of `shares` (name: p): exact quantiles of the values known, between neighbours in proportion.

    Equal values are counted first; the counted ones are dealt into ranges of their order and numbered from the sums of the ranges before, so no
    task holds a group. Only one row a range and group is ever ordered by one task.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_m"))
    counted = checkpointed(counted.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()))
    sizes = counted.groupBy(*by, "_range").agg(F.sum("_m").alias("_size"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(group).alias("n"))
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in (*by, "_range")]
    line = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = counted.withColumn("_upto", F.sum("_m").over(line)).join(starts.withColumnsRenamed({c: f"_s_{c}" for c in (*by, "_range")}), same)
    last = F.col("_start") + F.col("_upto")  # the row is places last - _m .. last - 1 of its group
    out, ends = [], {}
    for name, p in shares.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        for end, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            ends[f"_{end}_{name}"] = F.max(F.when((place >= last - F.col("_m")) & (place < last), F.col("_v")))
        low, high, part = F.col(f"_low_{name}"), F.col(f"_high_{name}"), at - F.floor(at)
        out.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + part * high).cast("double").alias(name))
    return ended.groupBy(*by).agg(F.max("n").alias("n"), *[c.alias(k) for k, c in ends.items()]).select(*by, "n", *out)


def view(df: DataFrame, value: str, log: bool = False, robust: bool = False, by: list[str] | None = None) -> DataFrame:
    """Statistics of one feature, of all rows or of each group: mean and std_dev, or quartiles with IQR; log takes positives only."""
    x = log10_positive(F.col(value)) if log else F.col(value)
    known = df.select(*(by or []), finite(x).alias("x")).where("x is not null")
    if robust:
        found = quantiles(known, by or [], "x", {"q25": 0.25, "median": 0.5, "q75": 0.75})
        return found.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("iqr", F.col("q75") - F.col("q25"))
    return known.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std_dev"))
