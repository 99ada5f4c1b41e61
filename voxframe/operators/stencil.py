"""Neighbourhood operators on sparse or dense frames, as joins of shifted coordinates or windows along an axis."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(dims: int, reach: int = 1, cross: bool = False) -> list[tuple[int, ...]]:
    """All steps of a (2 * reach + 1) ** dims window, or its cross; the centre is among them."""
    every = itertools.product(range(-reach, reach + 1), repeat=dims)
    return [s for s in every if not cross or sum(map(abs, s)) <= reach]


def shifted(df: DataFrame, axes: tuple[str, ...], steps: list[tuple[int, ...]]) -> DataFrame:
    """Each row once for each step, at the coordinates it reaches from there."""
    spread = F.explode(F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip(axes, s, strict=True)]) for s in steps]))
    moved = df.withColumn("_step", spread)
    for a in axes:
        moved = moved.withColumn(a, (F.col(a) + F.col(f"_step.{a}")).cast("int"))
    return moved.drop("_step")


def neighbourhood(df: DataFrame, frame: list[str], axes: tuple[str, ...], aggregates: list[Column], reach: int = 1, cross: bool = False) -> DataFrame:
    """Aggregates over each cell's window, for the cells df has. Rows meet partially aggregated, cell by cell."""
    around = shifted(df, axes, offsets(len(axes), reach, cross)).groupBy(*frame, *axes).agg(*aggregates)
    return around.join(df.select(*frame, *axes), [*frame, *axes], "left_semi")


def dilate(mask: DataFrame, frame: list[str], axes: tuple[str, ...], shape: dict[str, int], cross: bool = True) -> DataFrame:
    """Cells within one step of the mask, inside the shape."""
    out = shifted(mask.select(*frame, *axes), axes, offsets(len(axes), 1, cross))
    for a in axes:
        out = out.where((F.col(a) >= 0) & (F.col(a) < shape[a]))
    return out.distinct()


def border(mask: DataFrame, frame: list[str], axes: tuple[str, ...], shape: dict[str, int]) -> DataFrame:
    """The outside shell: one step of dilation by the cross, without the mask itself."""
    return dilate(mask, frame, axes, shape).join(mask.select(*frame, *axes), [*frame, *axes], "left_anti")


def erode(mask: DataFrame, frame: list[str], axes: tuple[str, ...]) -> DataFrame:
    """Mask cells whose whole cross lies in the mask."""
    steps = offsets(len(axes), 1, True)
    full = shifted(mask.select(*frame, *axes), axes, steps).groupBy(*frame, *axes).agg(F.count("*").alias("_n")).where(F.col("_n") == len(steps))
    return full.drop("_n")


def opening(mask: DataFrame, frame: list[str], axes: tuple[str, ...], shape: dict[str, int]) -> DataFrame:
    return dilate(erode(mask, frame, axes), frame, axes, shape)


def gradient(df: DataFrame, frame: list[str], axis: str, others: list[str], value: str, out: str, spacing: float = 1.0) -> DataFrame:
    """Central differences along an axis, one-sided at the ends; a line of one cell gives 0."""
    line = Window.partitionBy(*frame, *others).orderBy(axis)
    low, high, mid = F.lag(value).over(line), F.lead(value).over(line), F.col(value)
    slope = F.when(low.isNull() & high.isNull(), 0.0).when(low.isNull(), (high - mid) / spacing).when(high.isNull(), (mid - low) / spacing).otherwise((high - low) / (2 * spacing))
    return df.withColumn(out, slope)


def hessian_2d(df: DataFrame, frame: list[str], value: str = "v", spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """gyy, gyx, gxx: gradients of the gradients."""
    g = gradient(df, frame, "y", ["x"], value, "gy", spacing[0])
    g = gradient(g, frame, "x", ["y"], value, "gx", spacing[1])
    g = gradient(g, frame, "y", ["x"], "gy", "gyy", spacing[0])
    g = gradient(g, frame, "x", ["y"], "gy", "gyx", spacing[1])
    return gradient(g, frame, "x", ["y"], "gx", "gxx", spacing[1])


def eigen_2d(yy: Column, yx: Column, xx: Column) -> tuple[Column, Column]:
    """Eigenvalues of a symmetric 2 x 2 matrix, the one of smaller absolute value first."""
    half = (yy + xx) / 2
    root = F.sqrt(F.pow((yy - xx) / 2, F.lit(2.0)) + yx * yx)
    a, b = half - root, half + root
    swap = F.abs(a) > F.abs(b)
    return F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)


def hessian_3d(df: DataFrame, frame: list[str], value: str = "v", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """gzz, gzy, gzx, gyy, gyx, gxx: gradients of the gradients of frames with a z axis."""
    axes = ("z", "y", "x")
    g = df
    for a, s in zip(axes, spacing, strict=True):
        g = gradient(g, frame, a, [b for b in axes if b != a], value, f"g{a}", s)
    for i, a in enumerate(axes):
        for b, s in list(zip(axes, spacing, strict=True))[i:]:
            g = gradient(g, frame, b, [c for c in axes if c != b], f"g{a}", f"g{a}{b}", s)
    return g


def eigen_3d(zz: Column, zy: Column, zx: Column, yy: Column, yx: Column, xx: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix by the cosines of its characteristic cubic, in the order of their absolute values."""
    q = (zz + yy + xx) / 3
    off = zy * zy + zx * zx + yx * yx
    a, b, c = zz - q, yy - q, xx - q
    p = F.sqrt((a * a + b * b + c * c + 2 * off) / 6)
    det = a * (b * c - yx * yx) - zy * (zy * c - yx * zx) + zx * (zy * yx - b * zx)
    r = F.when(p > 0, F.greatest(F.least(det / (2 * p * p * p), F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)
    turn = F.acos(r) / 3
    most = q + 2 * p * F.cos(turn)
    least = q + 2 * p * F.cos(turn + F.lit(2 * math.pi / 3))
    by_size = F.array_sort(F.array(*[F.struct(F.abs(e).alias("size"), e.alias("e")) for e in (most, 3 * q - most - least, least)]))
    return tuple(by_size[k]["e"] for k in range(3))


def vesselness_2d(l1: Column, l2: Column, gamma_sq: Column, beta_sq: float = 0.5) -> Column:
    """Tube response of the eigenvalues (smaller absolute value first); 0 where the larger is positive."""
    blob = F.pow(F.abs(l1) / (F.abs(l2) + 1e-12), F.lit(2.0))
    response = F.exp(-blob / beta_sq) * (1 - F.exp(-(l1 * l1 + l2 * l2) / gamma_sq))
    return F.when(l2 > 0, 0.0).otherwise(response)


def vesselness_3d(l1: Column, l2: Column, l3: Column, gamma_sq: Column, alpha_sq: float = 0.5, beta_sq: float = 0.5) -> Column:
    plate = F.pow(F.abs(l2) / (F.abs(l3) + 1e-12), F.lit(2.0))
    blob = F.pow(F.abs(l2) / (F.sqrt(F.abs(l2 * l3)) + 1e-12), F.lit(2.0))
    response = (1 - F.exp(-plate / alpha_sq)) * F.exp(-blob / beta_sq) * (1 - F.exp(-(l1 * l1 + l2 * l2 + l3 * l3) / gamma_sq))
    return F.when((l2 > 0) | (l3 > 0), 0.0).otherwise(response)


def pixel_class(skeleton: DataFrame, frame: list[str], axes: tuple[str, ...]) -> DataFrame:
    """1 alone, 2 tip, 3 edge, 4 junction: skeleton cells in the window, itself among them, at most 4."""
    counted = neighbourhood(skeleton.select(*frame, *axes), frame, axes, [F.least(F.count("*"), F.lit(4)).cast("int").alias("pixel_class")])
    return counted


def unambiguous(skeleton: DataFrame, frame: list[str], axes: tuple[str, ...], label: str, shape: dict[str, int]) -> DataFrame:
    """Skeleton cells without a second label in their window; cells on the image boundary stay as they are."""
    seen = neighbourhood(skeleton.select(*frame, *axes, label), frame, axes, [F.min(label).alias("_low"), F.max(label).alias("_high")])
    edge = F.lit(False)
    for a in axes:
        edge = edge | (F.col(a) == 0) | (F.col(a) == shape[a] - 1)
    return skeleton.join(seen, [*frame, *axes]).where(edge | (F.col("_low") == F.col("_high"))).drop("_low", "_high")


def local_maxima(df: DataFrame, frame: list[str], axes: tuple[str, ...], value: str, reach: int) -> DataFrame:
    """Rows whose value is positive and the greatest of the rows in their window (non-maximum suppression)."""
    top = neighbourhood(df.select(*frame, *axes, value), frame, axes, [F.max(value).alias("_top")], reach)
    return df.join(top, [*frame, *axes]).where((F.col(value) == F.col("_top")) & (F.col(value) > 0)).drop("_top")


def cut_edges(df: DataFrame, frame: list[str], value: str, margin: int) -> DataFrame:
    """value 0 in the first and last `margin` rows of the bounding box of the positive cells."""
    box = df.where(F.col(value) > 0).groupBy(*frame).agg(F.min("y").alias("_top"), F.max("y").alias("_bottom"))
    near = (F.col("y") < F.col("_top") + margin) | (F.col("y") > F.col("_bottom") - margin)
    return df.join(box, frame, "left").withColumn(value, F.when(near, 0.0).otherwise(F.col(value))).drop("_top", "_bottom")
