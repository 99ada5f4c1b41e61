"""Skeleton networks: branch labels, edges, lengths, and the transfer of labels from seeds to voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.regions import components, half_offsets
from voxframe.operators.spatial import nearest_any
from voxframe.operators.stencil import pixel_class


def branch_labels(skeleton: DataFrame, frame: list[str], axes: tuple[str, ...]) -> DataFrame:
    """frame, axes, branch: components of the skeleton without its junctions."""
    open_cells = pixel_class(skeleton, frame, axes).where("pixel_class between 1 and 3")
    return components(open_cells, frame, list(axes)).withColumnRenamed("label", "branch")


def branch_edges(nodes: DataFrame, frame: list[str], label: str, axes: tuple[str, ...], spacing: tuple[float, ...]) -> DataFrame:
    """Edges between neighbouring nodes of one label, each once: frame, label, axes, to_<axis>, length."""
    steps = half_offsets(len(axes))
    length = [sum((s * r) ** 2 for s, r in zip(step, spacing, strict=True)) ** 0.5 for step in steps]
    hop = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"s_{a}") for a, v in zip(axes, step, strict=True)], F.lit(d).alias("length")) for step, d in zip(steps, length, strict=True)]))
    reached = nodes.select(*frame, label, *axes, hop.alias("h")).select(*frame, label, *axes, *[(F.col(a) + F.col(f"h.s_{a}")).cast("int").alias(f"to_{a}") for a in axes], "h.length")
    there = nodes.select(*frame, label, *[F.col(a).alias(f"to_{a}") for a in axes])
    return reached.join(there, [*frame, label, *[f"to_{a}" for a in axes]])


def with_degree(nodes: DataFrame, frame: list[str], label: str, axes: tuple[str, ...], spacing: tuple[float, ...]) -> DataFrame:
    """nodes and degree: neighbours of the same label."""
    edges = branch_edges(nodes.select(*frame, label, *axes), frame, label, axes, spacing)
    ends = F.explode(F.array(F.struct(*axes), F.struct(*[F.col(f"to_{a}").alias(a) for a in axes])))
    degree = edges.select(*frame, label, ends.alias("e")).groupBy(*frame, label, *[F.col(f"e.{a}").alias(a) for a in axes]).agg(F.count("*").alias("degree"))
    return nodes.join(degree, [*frame, label, *axes], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def first_tips(nodes: DataFrame, by: list[str], axes: tuple[str, ...]) -> DataFrame:
    """The first two nodes of degree 1 of each branch in scan order, numbered k = 1, 2."""
    line = Window.partitionBy(*by).orderBy(*axes)
    return nodes.where("degree = 1").withColumn("k", F.row_number().over(line)).where("k <= 2")


def branch_geometry(nodes: DataFrame, frame: list[str], label: str, axes: tuple[str, ...], spacing: tuple[float, ...], radius: str) -> DataFrame:
    """frame, label, length, thickness, aspect_ratio, tortuosity of each branch.

    length: edges plus the radius at each tip (twice for a lone node); thickness: twice the median radius; the
    larger of both is the length. tortuosity: length over the distance of the first two tips, else 1.
    """
    by = [*frame, label]
    graded = with_degree(nodes, frame, label, axes, spacing)
    edges = branch_edges(nodes.select(*by, *axes), frame, label, axes, spacing).groupBy(*by).agg(F.sum("length").alias("_edges"))
    tip = F.when(F.col("degree") == 0, 2 * F.col(radius)).when(F.col("degree") == 1, F.col(radius)).otherwise(0.0)
    sums = graded.groupBy(*by).agg(F.sum(tip).alias("_tips"), (2 * F.median(radius)).alias("_thick")).join(edges, by, "left")
    sums = sums.withColumn("_len", F.coalesce("_edges", F.lit(0.0)) + F.col("_tips"))
    tips = first_tips(graded, by, axes).groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, F.col(a))).alias(f"_{a}{k}") for a in axes for k in (1, 2)])
    apart: Column = F.lit(0.0)
    for a, s in zip(axes, spacing, strict=True):
        apart = apart + (F.col(f"_{a}1") - F.col(f"_{a}2")) * (F.col(f"_{a}1") - F.col(f"_{a}2")) * s * s
    long, thick = F.greatest("_len", "_thick"), F.least("_len", "_thick")
    joined = sums.join(tips, by, "left")
    return joined.select(
        *by, long.alias("length"), thick.alias("thickness"), F.when(thick != 0, long / thick).alias("aspect_ratio"), F.when(F.col(f"_{axes[0]}2").isNull(), 1.0).otherwise(F.col("_len") / F.sqrt(apart)).alias("tortuosity")
    )


def nearest_seed(voxels: DataFrame, seeds: DataFrame, by: list[str], axes: tuple[str, ...], spacing: tuple[float, ...], seed: str, cell: float = 4.0) -> DataFrame:
    """voxels and the seed nearest within their object (straight distance), the smaller seed on a tie.

    Voxels of objects without a seed drop out. Objects are searched in rings of `cell` widths of a voxel and more, so a voxel meets the
    seeds around it and not all of a large object.
    """
    place = lambda df, *more: df.select(*by, *more, *[(F.col(a) * F.lit(float(s))).alias(f"_{a}") for a, s in zip(axes, spacing, strict=True)])
    left = place(voxels, *axes, F.struct(*axes).alias("_voxel"))
    found = nearest_any(left.select(*by, "_voxel", *[f"_{a}" for a in axes]), place(seeds, seed), by, tuple(f"_{a}" for a in axes), cell * max(spacing), "_voxel", seed)
    return found.select(*by, *[F.col(f"_voxel.{a}").alias(a) for a in axes], F.col(f"nearest_{seed}").alias(seed))


def without_skeleton(objects: DataFrame, skeleton: DataFrame, by: list[str]) -> DataFrame:
    return objects.select(*by).distinct().join(skeleton.select(*by).distinct(), by, "left_anti")


def add_missing_skeleton(voxels: DataFrame, skeleton: DataFrame, frame: list[str], label: str, axes: tuple[str, ...], value: str) -> DataFrame:
    """The skeleton and, for each object without any, its voxel of the greatest value (the first on a tie)."""
    by = [*frame, label]
    lacking = voxels.join(without_skeleton(voxels, skeleton, by), by, "left_semi")
    order = F.struct(F.col(value), *[(-F.col(a)).alias(a) for a in axes])
    best = lacking.groupBy(*by).agg(F.max_by(F.struct(*axes), order).alias("b")).select(*by, *[F.col(f"b.{a}").alias(a) for a in axes])
    return skeleton.select(*by, *axes).unionByName(best)


def boundary_pairs(voxels: DataFrame, by: list[str], axis: str, axes: tuple[str, ...]) -> DataFrame:
    """by, axis, upper, lower: labels that touch between a plane and the next."""
    below = voxels.select(*by, (F.col(axis) - 1).alias(axis), *axes, F.col("label").alias("lower"))
    return voxels.select(*by, axis, *axes, F.col("label").alias("upper")).join(below, [*by, axis, *axes]).select(*by, axis, "upper", "lower").distinct()


def running_offsets(tops: DataFrame, by: list[str], order: str, top: str) -> DataFrame:
    """tops and offset: the sum of `top` over the chunks before."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return tops.withColumn("offset", F.coalesce(F.sum(top).over(before), F.lit(0)).cast("long"))
