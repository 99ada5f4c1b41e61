"""Places of rows in one global order, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.plans.session import checkpointed


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with `out`, the place of each row in the order, from 0.

    Rows are dealt into ranges of the order and sorted there; a range's rows are numbered from the sum of the ranges before it.
    The ranges are written first, so that both uses see the same ones. Only one row a range is ever ordered by one task.
    """
    line = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_line", F.monotonically_increasing_id())
    line = checkpointed(line.withColumn("_range", F.shiftright("_line", 33)).withColumn("_line", F.col("_line").bitwiseAND(2**33 - 1)))
    sizes = line.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return line.join(starts, "_range").withColumn(out, F.col("_start") + F.col("_line")).drop("_range", "_line", "_start")
