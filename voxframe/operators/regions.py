"""Connected components of frames and the geometry of labelled regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.stencil import eigen_3d
from voxframe.plans.session import checkpointed, drop


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component: links to lesser roots, shortened until all nodes point at their root."""
    root = np.arange(count)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def label_cells(frame: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Labels 1.. in scan order, anew in each frame, of the full-connectivity components of cells (rows of at) of numbered frames."""
    if not len(at):
        return np.zeros(0, np.int32)
    at = at - at.min(axis=0) + 1
    shape = at.max(axis=0) + 2  # a free cell on every side, so that no step leads into another line
    weight = np.append(np.cumprod(shape[:0:-1].astype(np.int64))[::-1], 1)
    key = frame.astype(np.int64) * int(np.prod(shape.astype(object))) + at @ weight
    order = np.argsort(key, kind="stable")
    key = key[order]
    near = [np.zeros((2, 0), np.int64)]
    for step in half_offsets(at.shape[1]):
        to = key + int(np.dot(step, weight))
        spot = np.minimum(np.searchsorted(key, to), len(key) - 1)
        hit = np.flatnonzero(key[spot] == to)
        near.append(np.stack([hit, spot[hit]]))
    root = _roots(len(key), *np.concatenate(near, axis=1))
    heads, rank = np.unique(root, return_inverse=True)
    own = frame[order]
    first = np.searchsorted(own[heads], own)  # the rank of each frame's first component
    out = np.empty(len(key), np.int32)
    out[order] = rank - first + 1
    return out


def label_grid(mask: np.ndarray) -> np.ndarray:
    """Labels 1.. in scan order of the full-connectivity components of a dense mask; 0 outside."""
    at = np.argwhere(mask)
    out = np.zeros(mask.shape, np.int32)
    out[tuple(at.T)] = label_cells(np.zeros(len(at), np.int64), at)
    return out


def half_offsets(dims: int) -> list[tuple[int, ...]]:
    """One of each opposite pair of the 3**dims - 1 neighbours: 4 in 2D, 13 in 3D."""
    all_steps = np.array(np.meshgrid(*[[-1, 0, 1]] * dims, indexing="ij")).reshape(dims, -1).T
    return [tuple(int(v) for v in s) for s in all_steps if tuple(s) > (0,) * dims]


def components(voxels: DataFrame, frame: list[str], axes: list[str]) -> DataFrame:
    """frame, axes, label of each voxel row: full connectivity, labels from 1 in each frame in scan order.

    A task labels all frames of a batch at once, sparse cells and no grid; a frame is never split between tasks, so volumes beyond
    a task's memory are cut into tiles (see components_tiled).
    """
    fields = [voxels.schema[c] for c in [*frame, *axes]]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", label int"

    def labelled(pdf: pd.DataFrame) -> pd.DataFrame:
        number = pdf.groupby(frame, sort=False, dropna=False).ngroup().to_numpy()
        return pdf.assign(label=label_cells(number, pdf[axes].to_numpy(np.int64)))

    def run(batches):
        held = []  # rows of the last frame seen, which may go on in the next batch; joined when it ends
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf[frame].eq(pdf[frame].iloc[-1]).all(axis=1).to_numpy()
            goes_on = held and bool((pdf[frame].iloc[-1] == held[-1][frame].iloc[-1]).all())
            if goes_on and last.all():
                held.append(pdf)
                continue
            yield labelled(pd.concat([*held, pdf[~last]], ignore_index=True))
            held = [pdf[last]]
        if held:
            yield labelled(pd.concat(held, ignore_index=True))

    return voxels.select(*frame, *axes).repartition(*frame).sortWithinPartitions(*frame).mapInPandas(run, schema)


def components_tiled(voxels: DataFrame, frame: list[str], axes: list[str], tile: int) -> DataFrame:
    """components for frames too large for one task: tiles are labelled apart, then merged along their seams.

    Seam pairs of all full-connectivity neighbours become edges between tile labels, whose components are found by contraction,
    so only seams are shuffled. Labels follow scan order.
    """
    tiled = voxels.select(*frame, *axes, *[F.floor(F.col(a) / tile).cast("int").alias(f"_{a}") for a in axes])
    names = [f"_{a}" for a in axes]
    local = checkpointed(components(tiled, [*frame, *names], axes))
    first = F.min(F.struct(*axes)).alias("first")
    keys = [*frame, *names, "label"]
    nodes = local.groupBy(*keys).agg(first)
    local = local.join(nodes, keys)
    seams = local
    pairs = None
    for step in half_offsets(len(axes)):
        moved = seams.select(*frame, *[(F.col(a) + s).cast("int").alias(a) for a, s in zip(axes, step, strict=True)], F.struct(*names).alias("_tile"), F.col("first").alias("other"))
        met = seams.join(moved, [*frame, *axes]).where(F.col("_tile") != F.struct(*names)).select(*frame, F.col("first").alias("a"), F.col("other").alias("b"))
        pairs = met if pairs is None else pairs.unionByName(met)
    state = contracted(nodes.select(*frame, F.col("first").alias("node")), pairs, frame)
    ranked = state.withColumn("label", F.dense_rank().over(Window.partitionBy(*frame).orderBy("root")).cast("int"))
    return local.drop("label").join(ranked.select(*frame, F.col("node").alias("first"), "label"), [*frame, "first"]).select(*frame, *axes, "label")


def contracted(nodes: DataFrame, pairs: DataFrame, frame: list[str], leaps: int = 2, rounds: list[int] | None = None) -> DataFrame:
    """frame, node, root: the least node of each node's component, for nodes and the pairs (a, b) that link them.

    In a round each node that still has links points at its least neighbour, if that is less; pointers leap to their pointer's pointer `leaps`
    times, and nodes and links are replaced by what they point at. A round leaves at most half of the linked nodes, and of a chain of ascending nodes one in 2 ** leaps, so
    rounds grow with the logarithm of the links, not with an object's diameter. `rounds` is told the links left after each.
    """
    edges = pairs.where("a != b")
    edges = checkpointed(edges.unionByName(edges.select(*frame, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = nodes.select(*frame, "node", F.col("node").alias("root")).distinct()
    while not edges.isEmpty():
        to = edges.groupBy(*frame, "a").agg(F.min("b").alias("to")).select(*frame, "a", F.least("a", "to").alias("to"))
        for _ in range(leaps):
            to = checkpointed(to)
            on = to.select(*frame, F.col("a").alias("to"), F.col("to").alias("beyond"))
            to = to.join(on, [*frame, "to"], "left").select(*frame, "a", F.coalesce("beyond", "to").alias("to"))
        to = checkpointed(to)
        at = lambda df, c: df.join(to.select(*frame, F.col("a").alias(c), "to"), [*frame, c], "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: E731, B023
        state = checkpointed(at(state, "root").select(*frame, "node", "root"))
        before, edges = edges, checkpointed(at(at(edges, "a"), "b").where("a != b").select(*frame, "a", "b").distinct())
        drop(before)
        if rounds is not None:
            rounds.append(edges.count())
    return state


def keep_large(labelled: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows of the labels with at least so many voxels."""
    big = labelled.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return labelled.join(big, by, "left_semi")


def geometry(labelled: DataFrame, by: list[str], axes: tuple[str, ...] = ("y", "x"), spacing: tuple[float, ...] = (1.0, 1.0)) -> DataFrame:
    """by, area, centroid_<axis>, extent, major and minor axis lengths of each region.

    Axis lengths are those of the ellipse or ellipsoid with the region's second central moments, each cell adding its own spacing**2 / 12:
    4 * sqrt of the greatest and least eigenvalue in 2D, sqrt(20 * ..) in 3D.
    """
    size = 1.0
    for s in spacing:
        size *= s
    box = F.lit(1)
    for a in axes:
        box = box * (F.max(a) - F.min(a) + 1)
    out = [(F.count("*") * size).alias("area"), (F.count("*") / box).alias("extent")]
    out += [(F.avg(a) * s).alias(f"centroid_{a}") for a, s in zip(axes, spacing, strict=True)]
    scale = dict(zip(axes, spacing, strict=True))
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    moment = lambda a, b: F.var_pop(a) * scale[a] ** 2 + scale[a] ** 2 / 12 if a == b else F.covar_pop(a, b) * scale[a] * scale[b]
    sums = labelled.groupBy(*by).agg(*out, *[moment(a, b).alias(f"_{a}{b}") for a, b in pairs])
    parts = [F.col(f"_{a}{b}") for a, b in pairs]
    if len(axes) == 2:
        aa, ab, bb = parts
        half, spread = (aa + bb) / 2, F.sqrt(F.pow((aa - bb) / 2, F.lit(2.0)) + ab * ab)
        major, minor = 4 * F.sqrt(half + spread), 4 * F.sqrt(F.greatest(half - spread, F.lit(0.0)))
    else:
        least, _, most = eigen_3d(*parts)
        major, minor = F.sqrt(20 * most), F.sqrt(20 * F.greatest(least, F.lit(0.0)))
    return sums.select("*", major.alias("axis_major"), minor.alias("axis_minor")).drop(*[f"_{a}{b}" for a, b in pairs])
