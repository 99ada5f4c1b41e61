"""Dense kernels in numpy, one frame or tile at a time, and small table helpers around them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators.order import numbered
from voxframe.plans.session import checkpointed


def reflect_index(n: int, reach: int) -> np.ndarray:
    """Indices -reach .. n + reach - 1 folded back at both ends, the edge sample repeated."""
    i = np.arange(-reach, n + reach) % (2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


def convolve(image: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    reach = len(weights) // 2
    n = image.shape[axis]
    padded = np.take(image, reflect_index(n, reach), axis=axis)
    return sum(w * np.take(padded, range(k, k + n), axis=axis) for k, w in enumerate(weights))


def gaussian_weights(sigma: float, truncate: float = 3.0, order: int = 0) -> np.ndarray:
    reach = int(truncate * sigma + 0.5)
    x = np.arange(-reach, reach + 1)
    w = np.exp(-0.5 * (x / sigma) ** 2)
    w /= w.sum()
    return w if order == 0 else w * (x**2 / sigma**4 - 1 / sigma**2)


def _per_axis(sigma: float | tuple[float, ...], dims: int) -> tuple[float, ...]:
    return sigma if isinstance(sigma, tuple) else (sigma,) * dims


def smooth(image: np.ndarray, sigma: float | tuple[float, ...]) -> np.ndarray:
    for axis, s in enumerate(_per_axis(sigma, image.ndim)):
        if s > 0:
            image = convolve(image, gaussian_weights(s), axis)
    return image


def smoothing_reach(ladder: list[tuple[float, ...]]) -> tuple[int, ...]:
    """Cells along each axis that smoothing to each vector of the ladder in turn looks at."""
    total, last = np.zeros(len(ladder[0]), int), (0.0,) * len(ladder[0])
    for vector in ladder:
        total += [int(3.0 * max(0.0, a * a - b * b) ** 0.5 + 0.5) for a, b in zip(vector, last, strict=True)]
        last = vector
    return tuple(map(int, total))


def laplace_reach(vectors: list[tuple[float, ...]]) -> tuple[int, ...]:
    return tuple(int(4.0 * max(v) + 0.5) for v in zip(*vectors, strict=True))


def laplace_of_gaussian(image: np.ndarray, sigma: float | tuple[float, ...]) -> np.ndarray:
    total = np.zeros_like(image)
    per_axis = _per_axis(sigma, image.ndim)
    for axis in range(image.ndim):
        part = image
        for other, s in enumerate(per_axis):
            part = convolve(part, gaussian_weights(s, 4.0, 2 if other == axis else 0), other)
        total += part
    return total


@dataclass(frozen=True)
class Gaussian:
    """Smoothing to each sigma in turn, by what is missing from the last one."""

    sigmas: tuple[float, ...]

    def reach(self, dims: int) -> tuple[int, ...]:
        return smoothing_reach([(s,) * dims for s in self.sigmas])

    def __call__(self, image: np.ndarray) -> np.ndarray:
        last = 0.0
        for s in self.sigmas:
            image = smooth(image, max(0.0, s * s - last * last) ** 0.5)
            last = s
        return image


@dataclass(frozen=True)
class LaplaceOfGaussian:
    """Greatest bright-blob response over the scales, over its frame maximum and a tenth of that."""

    sigmas: tuple[float, ...]

    def __call__(self, image: np.ndarray) -> np.ndarray:
        best = np.max([-(s**2) * laplace_of_gaussian(image, s) for s in self.sigmas], axis=0)
        best = np.clip(best, 0, None)
        return best / (best.max() + 1e-12) / 10


@dataclass(frozen=True)
class ScaleSpace:
    """The image smoothed to each sigma, each by what is missing from the one before, and last its greatest bright-blob response.

    sigmas are in cells of the last axes; `ratio` is how much finer a cell of the last axis is than one of the first (1 in 2D).
    """

    sigmas: tuple[float, ...]
    ratio: float = 1.0

    def vector(self, sigma: float, dims: int) -> tuple[float, ...]:
        return (sigma * self.ratio,) * (dims - 2) + (sigma, sigma)

    def vectors(self, dims: int) -> list[tuple[float, ...]]:
        return [self.vector(s, dims) for s in self.sigmas]

    def reach(self, dims: int) -> tuple[int, ...]:
        return tuple(map(max, smoothing_reach(self.vectors(dims)), laplace_reach(self.vectors(dims))))

    def smoothed(self, image: np.ndarray) -> list[np.ndarray]:
        out, now, last = [], image, (0.0,) * image.ndim
        for vector in self.vectors(image.ndim):
            now = smooth(now, tuple(max(0.0, a * a - b * b) ** 0.5 for a, b in zip(vector, last, strict=True)))
            last = vector
            out.append(now)
        return out

    def __call__(self, image: np.ndarray) -> list[np.ndarray]:
        blob = np.max([-(s**2) * laplace_of_gaussian(image, v) for s, v in zip(self.sigmas, self.vectors(image.ndim), strict=True)], axis=0)
        return [*self.smoothed(image), blob]


def gradient(image: np.ndarray, axis: int, spacing: float) -> np.ndarray:
    """Central differences along an axis, one-sided at the ends; a line of one cell gives 0."""
    return np.gradient(image, spacing, axis=axis) if image.shape[axis] > 1 else np.zeros_like(image)


@dataclass(frozen=True)
class TubeSpace:
    """For each scale of a ScaleSpace: the smoothed image, the norm of its Hessian, the Hessian's greatest absolute part in each cell and its
    eigenvalues in the order of their absolute values. Last the greatest bright-blob response of all scales."""

    space: ScaleSpace
    spacing: tuple[float, ...]

    def outputs(self) -> list[str]:
        each = ["v", "norm", "part", *[f"l{i + 1}" for i in range(len(self.spacing))]]
        return [*[f"{c}_{k}" for k in range(len(self.space.sigmas)) for c in each], "blob"]

    def reach(self, dims: int) -> tuple[int, ...]:
        vectors = self.space.vectors(dims)
        return tuple(max(a + 2, b) for a, b in zip(smoothing_reach(vectors), laplace_reach(vectors), strict=True))

    def __call__(self, image: np.ndarray) -> list[np.ndarray]:
        dims, out = image.ndim, []
        *scales, blob = self.space(image)
        for v in scales:
            first = [gradient(v, a, s) for a, s in enumerate(self.spacing)]
            h = {(a, b): gradient(first[a], b, self.spacing[b]) for a in range(dims) for b in range(a, dims)}
            norm = np.sqrt(sum((1 if a == b else 2) * x * x for (a, b), x in h.items()))
            part = np.max([np.abs(x) for x in h.values()], axis=0)
            out += [v, norm, part, *(eigenvalues_2d if dims == 2 else eigenvalues_3d)(h)]
        return [*out, blob]


def eigenvalues_2d(h: dict[tuple[int, int], np.ndarray]) -> list[np.ndarray]:
    half, root = (h[0, 0] + h[1, 1]) / 2, np.sqrt(((h[0, 0] - h[1, 1]) / 2) ** 2 + h[0, 1] * h[0, 1])
    a, b = half - root, half + root
    swap = np.abs(a) > np.abs(b)
    return [np.where(swap, b, a), np.where(swap, a, b)]


def eigenvalues_3d(h: dict[tuple[int, int], np.ndarray]) -> list[np.ndarray]:
    """By the cosines of the characteristic cubic."""
    q = (h[0, 0] + h[1, 1] + h[2, 2]) / 3
    a, b, c = h[0, 0] - q, h[1, 1] - q, h[2, 2] - q
    zy, zx, yx = h[0, 1], h[0, 2], h[1, 2]
    p = np.sqrt((a * a + b * b + c * c + 2 * (zy * zy + zx * zx + yx * yx)) / 6)
    det = a * (b * c - yx * yx) - zy * (zy * c - yx * zx) + zx * (zy * yx - b * zx)
    turn = np.arccos(np.clip(np.divide(det, 2 * p * p * p, out=np.zeros_like(det), where=p > 0), -1, 1)) / 3
    most, least = q + 2 * p * np.cos(turn), q + 2 * p * np.cos(turn + 2 * np.pi / 3)
    all_three = np.stack([most, 3 * q - most - least, least])
    return list(np.take_along_axis(all_three, np.argsort(np.abs(all_three), axis=0, kind="stable"), axis=0))


@dataclass(frozen=True)
class Opening:
    """The image where a cross that fits into the positive cells covers a cell, else 0; cells beyond the frame are off."""

    def reach(self, dims: int) -> tuple[int, ...]:
        return (2,) * dims

    def __call__(self, image: np.ndarray) -> np.ndarray:
        inner = (slice(1, -1),) * image.ndim
        mask = np.pad(image > 0, 1)
        steps = [(by, axis) for axis in range(image.ndim) for by in (1, -1)]
        eroded = np.logical_and.reduce([mask, *[np.roll(mask, by, axis) for by, axis in steps]])
        eroded = np.pad(eroded[inner], 1)
        opened = np.logical_or.reduce([eroded, *[np.roll(eroded, by, axis) for by, axis in steps]])[inner]
        return np.where(opened, image, 0.0)


@dataclass(frozen=True)
class Distance:
    """Distance of each cell that is 1 to the nearest that is 2, in cells, clamped to `most`; cells that are 0 are neither.

    The squared distance is the least over one axis after another of what was found so far and the squared step along it, so a cell costs
    the reach times the axes, whatever the shape of the mask.
    """

    most: float

    def reach(self, dims: int) -> tuple[int, ...]:
        return (int(np.ceil(self.most)),) * dims

    def __call__(self, image: np.ndarray) -> np.ndarray:
        far = float(self.most) ** 2
        square = np.where(image == 2, 0.0, far)
        for axis in range(image.ndim):
            now, lines = np.moveaxis(square, axis, 0), np.moveaxis(square.copy(), axis, 0)
            for k in range(1, min(int(self.most), image.shape[axis] - 1) + 1):
                np.minimum(now[k:], lines[:-k] + k * k, out=now[k:])
                np.minimum(now[:-k], lines[k:] + k * k, out=now[:-k])
        return np.sqrt(square)


@dataclass(frozen=True)
class MeanFilter:
    """The mean of each cell's window of three in every direction, edges repeated."""

    def reach(self, dims: int) -> tuple[int, ...]:
        return (1,) * dims

    def __call__(self, image: np.ndarray) -> np.ndarray:
        for axis in range(image.ndim):
            image = convolve(image, np.full(3, 1 / 3), axis)
        return image


@dataclass(frozen=True)
class FillHoles:
    """1 in the mask and wherever no path of cells beside each other leads out of the frame around it."""

    def __call__(self, image: np.ndarray) -> np.ndarray:
        mask = np.pad(image > 0, 1)
        out = np.zeros_like(mask)
        out[(0,) * mask.ndim] = True
        while True:
            grown = out.copy()
            for axis in range(mask.ndim):
                grown |= np.roll(out, 1, axis) | np.roll(out, -1, axis)
            grown &= ~mask
            if (grown == out).all():
                return (~out)[(slice(1, -1),) * mask.ndim].astype(float)
            out = grown


def window_max(image: np.ndarray, reach: int = 1) -> np.ndarray:
    for axis in range(image.ndim):
        n = image.shape[axis]
        padded = np.take(image, reflect_index(n, reach), axis=axis)
        image = np.max([np.take(padded, range(k, k + n), axis=axis) for k in range(2 * reach + 1)], axis=0)
    return image


@dataclass(frozen=True)
class LogPeaks:
    """Marks 1 where some scale's response is a positive window maximum above every response that peaked before."""

    sigmas: tuple[float, ...]
    ratio: float = 1.0

    def reach(self, dims: int) -> tuple[int, ...]:
        return tuple(r + 1 for r in laplace_reach(ScaleSpace(self.sigmas, self.ratio).vectors(dims)))

    def __call__(self, image: np.ndarray) -> np.ndarray:
        best, marks = np.zeros_like(image), np.zeros_like(image)
        for s in self.sigmas:
            response = np.clip(-(s**2) * laplace_of_gaussian(image, ScaleSpace((), self.ratio).vector(s, image.ndim)), 0, None)
            peak = (response == window_max(response)) & (response > best)
            best[peak] = response[peak]
            marks[peak] = 1
        return marks


@dataclass(frozen=True)
class Thinning:
    """Two-step parallel thinning (Zhang and Suen) of a 2D mask to lines of one pixel, or so many rounds of it."""

    rounds: int | None = None

    def reach(self, dims: int) -> tuple[int, ...]:
        return (2 * self.rounds,) * dims

    def __call__(self, image: np.ndarray) -> np.ndarray:
        mask = np.pad(image > 0, 1)
        ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
        changed, left = True, self.rounds
        while changed and left != 0:
            changed, left = False, None if left is None else left - 1
            for step in (0, 1):
                p = np.array([np.roll(mask, (-dy, -dx), (0, 1)) for dy, dx in ring])
                count = p.sum(axis=0)
                turns = (~p & np.roll(p, -1, axis=0)).sum(axis=0)
                n, e, s, w = p[0], p[2], p[4], p[6]
                free = ~(n & e & s) & ~(e & s & w) if step == 0 else ~(n & e & w) & ~(n & s & w)
                gone = mask & (count >= 2) & (count <= 6) & (turns == 1) & free
                if gone.any():
                    mask &= ~gone
                    changed = True
        return mask[1:-1, 1:-1].astype(float)


_CUBE = np.array([(z, y, x) for z in range(3) for y in range(3) for x in range(3)])
_FACES = np.abs(_CUBE[:, None] - _CUBE[None]).sum(axis=2) == 1
_TOUCH = np.abs(_CUBE[:, None] - _CUBE[None]).max(axis=2) == 1
_MIDDLE = 13
_NEAR_FACE = np.abs(_CUBE - 1).sum(axis=1) <= 2  # shares a face or an edge with the middle
_OTHERS = np.flatnonzero(np.arange(27) != _MIDDLE)


def _one_part(cells: np.ndarray, seeds: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Whether all seed cells of each row of a mask over the cube (and there are some) hang together through its cells."""
    beside = beside.astype(np.float32)
    held = np.zeros_like(cells)
    held[np.arange(len(cells)), seeds.argmax(axis=1)] = True
    held &= seeds
    while True:
        grown = held | (cells & (held.astype(np.float32) @ beside > 0))
        if (grown == held).all():
            return seeds.any(axis=1) & ~(seeds & ~held).any(axis=1)
        held = grown


def simple_cells(cubes: np.ndarray) -> np.ndarray:
    """For each row of 27 cells whether its middle can go without cutting, joining, opening or closing anything: one 26-connected part of
    the mask touches it, and one 6-connected part of the background within its 18 neighbours lies on its faces."""
    on = cubes.copy()
    on[:, _MIDDLE] = False
    off = ~cubes & _NEAR_FACE
    off[:, _MIDDLE] = False
    return _one_part(on, on, _TOUCH) & _one_part(off, off & _FACES[_MIDDLE], _FACES)


class _Removable:
    """Which of the 2**26 neighbourhoods let their middle go: simple ones of two cells or more. A neighbourhood is judged when it is first met."""

    def __init__(self):
        self.known = np.zeros(1 << len(_OTHERS), np.int8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        new = np.unique(codes[self.known[codes] == 0])
        if len(new):
            cubes = np.ones((len(new), 27), bool)
            cubes[:, _OTHERS] = new[:, None] >> np.arange(len(_OTHERS)) & 1
            self.known[new] = np.where(simple_cells(cubes) & (cubes.sum(axis=1) > 2), 1, -1)
        return self.known[codes] > 0


def is_simple(cube: np.ndarray) -> bool:
    """simple_cells of one 3 x 3 x 3 mask."""
    return bool(simple_cells(cube.reshape(1, 27))[0])


@dataclass(frozen=True)
class Thinning3D:
    """Thinning of a 3D mask to lines: border cells go from each of six sides in turn while they are simple and no line's end.

    Cells of one side go in eight fields, by the parity of their coordinates: no two cells of a field touch, so all of a field are judged at once.
    """

    def __call__(self, image: np.ndarray) -> np.ndarray:
        mask = np.pad(image > 0, 1)
        flat, shape, removable = mask.reshape(-1), mask.shape, _Removable()
        weight = np.array([shape[1] * shape[2], shape[2], 1])
        around = ((_CUBE - 1) @ weight)[_OTHERS]
        left = np.flatnonzero(flat)
        parity = (left // weight[0] % 2) * 4 + (left // weight[1] % shape[1] % 2) * 2 + left % shape[2] % 2
        changed = True
        while changed:
            changed = False
            for side in (-weight[0], weight[0], -weight[1], weight[1], -weight[2], weight[2]):
                open_side = ~flat[left + side]
                edge, field = left[open_side], parity[open_side]
                for k in range(8):
                    cells = edge[field == k]
                    codes = np.zeros(len(cells), np.int32)
                    for bit, step in enumerate(around):
                        codes |= flat[cells + step].astype(np.int32) << bit
                    gone = cells[removable(codes)]
                    if len(gone):
                        flat[gone] = False
                        changed = True
                stays = flat[left]
                left, parity = left[stays], parity[stays]
        return mask[1:-1, 1:-1, 1:-1].astype(float)


def thin(mask: DataFrame, frame: list[str], axes: tuple[str, ...], tiling: Tiling | None = None, rounds: int = 8) -> DataFrame:
    """frame, axes of the mask's skeleton.

    With a tiling, 2D frames are thinned so many rounds at a time, on tiles with a halo as wide as the rounds can see, until a step leaves all
    cells in place: each step equals that of the whole frame. Volumes are thinned whole: the fields of one round in 3D see too far for tiles.
    """
    rows = mask.select(*frame, *axes, F.lit(1.0).alias("v"))
    if tiling is None or len(axes) == 3:
        kernel = Thinning3D() if len(axes) == 3 else Thinning()
        return frame_kernel(rows, frame, "v", kernel, axes).where("v > 0").select(*frame, *axes)
    now = checkpointed(rows)
    count = now.count()
    while True:
        now = checkpointed(frame_kernel(now, frame, "v", Thinning(rounds), axes, tiling=tiling).where("v > 0"))
        before, count = count, now.count()
        if before == count:
            return now.select(*frame, *axes)


@dataclass(frozen=True)
class Tiling:
    """Frames of `shape` cut into tiles of `size` cells along each axis, for kernels that look at most their `reach` far."""

    size: int
    shape: dict[str, int]


def frame_kernel(df: DataFrame, frame: list[str], value: str, kernel, axes: tuple[str, ...] = ("y", "x"), outputs: list[str] | None = None, tiling: Tiling | None = None) -> DataFrame:
    """df's frame, axes and value with the kernel run over each dense frame; absent cells count as 0.

    One frame is one task's input or, with a tiling, one tile with the halo that kernel.reach(dims) asks for: the kernel sees the cells around a tile,
    and its results there are cut off, so a tiled frame equals a whole one. A kernel that returns several images gives a column for each of `outputs`.
    """
    fields = [df.schema[c] for c in [*frame, *axes]]
    names = outputs or [value]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + [f"{c} double" for c in names])
    rows, by, halo = df.select(*frame, *axes, value), list(frame), (0,) * len(axes)
    if tiling:
        halo = kernel.reach(len(axes))
        rows = tiles(rows, axes, (tiling.size,) * len(axes), halo, tiling.shape)
        by += [f"tile_{a}" for a in axes]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [pdf[a].to_numpy() for a in axes]
        if tiling:
            number = [int(pdf[f"tile_{a}"].iloc[0]) for a in axes]
            low = [max(0, k * tiling.size - h) for k, h in zip(number, halo, strict=True)]
            size = [min(tiling.shape[a], (k + 1) * tiling.size + h) - b for a, k, h, b in zip(axes, number, halo, low, strict=True)]
            own = ~pdf["halo"].to_numpy()
        else:
            low, size, own = [0] * len(axes), [int(a.max()) + 1 for a in at], slice(None)
        at = tuple(a - b for a, b in zip(at, low, strict=True))
        image = np.zeros(size)
        image[at] = pdf[value].to_numpy()
        made = kernel(image) if outputs else [kernel(image)]
        kept = tuple(a[own] for a in at)
        return pdf.loc[own, [*frame, *axes]].assign(**{c: m[kept] for c, m in zip(names, made, strict=True)})

    return rows.groupBy(*by).applyInPandas(run, schema)


def tiles(df: DataFrame, axes: tuple[str, ...], size: tuple[int, ...], halo: tuple[int, ...], shape: dict[str, int]) -> DataFrame:
    """Rows dealt to tiles tile_<axis>, once to their own and once more to each whose halo they lie in (halo true)."""
    out = df.withColumn("halo", F.lit(False))
    for a, n, h in zip(axes, size, halo, strict=True):
        last = (shape[a] - 1) // n
        low = F.greatest(F.floor((F.col(a) - h) / F.lit(n)), F.lit(0)).cast("int")
        high = F.least(F.floor((F.col(a) + h) / F.lit(n)), F.lit(last)).cast("int")
        out = out.withColumn(f"tile_{a}", F.explode(F.sequence(low, high)))
        out = out.withColumn("halo", F.col("halo") | (F.floor(F.col(a) / F.lit(n)) != F.col(f"tile_{a}")))
    return out


def strided_sample(df: DataFrame, frame: list[str], ordinal: Column, value: str, most: int, stride: int) -> DataFrame:
    """Positive rows at every stride-th ordinal, from the first offset that has any."""
    rows = df.withColumn("_k", F.pmod(ordinal, F.lit(stride)))
    first = rows.where(F.col(value) > 0).groupBy(*frame).agg(F.min("_k").alias("_k"))
    return rows.where(F.col(value) > 0).join(first, [*frame, "_k"]).drop("_k")


def shifted_log(df: DataFrame, frame: list[str], value: str) -> DataFrame:
    """log10 of positive values, raised so that none is below 0; other values 0."""
    log = F.when(F.col(value) > 0, F.log10(value))
    low = df.groupBy(*frame).agg(F.least(F.min(log), F.lit(0.0)).alias("_low"))
    return df.join(low, frame).withColumn(value, F.coalesce(log - F.col("_low"), F.lit(0.0))).drop("_low")


def frobenius(df: DataFrame, frame: list[str], parts: list[str]) -> DataFrame:
    """df and norm: root of the sum of squares of the parts, over the frame's greatest absolute part."""
    top = df.groupBy(*frame).agg(F.max(F.greatest(*[F.abs(F.col(p)) for p in dict.fromkeys(parts)])).alias("_top"))
    total = F.lit(0.0)
    for p in parts:
        total = total + F.col(p) * F.col(p)
    return df.join(top, frame).withColumn("norm", F.when(F.col("_top") > 0, F.sqrt(total) / F.col("_top")).otherwise(0.0)).drop("_top")


def cumulative(h: DataFrame, by: list[str], order: str, n: str) -> DataFrame:
    up = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return h.select("*", F.sum(n).over(up).alias("up"), F.sum(n).over(down).alias("down"))


def running_best(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """df and best: the value exceeds every one before it, and 0."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("best", F.col(value) > F.coalesce(F.max(value).over(before), F.lit(0.0)))


def mask_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell of either mask, with both (intersection) and one_only (symmetric difference)."""
    marked = a.withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(b.withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    sides = marked.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return sides.select(*keys, (F.col("_a") + F.col("_b") == 2).alias("both"), (F.col("_a") + F.col("_b") == 1).alias("one_only"))


def every_kth(df: DataFrame, order: list[str], stride: int, most: int) -> DataFrame:
    """Rows 1, 1 + stride, .. of df in order, at most `most` of them."""
    placed = numbered(df, order, "_k").where((F.pmod("_k", F.lit(stride)) == 0) & (F.col("_k") < F.lit(stride * most)))
    return placed.drop("_k")


@dataclass(frozen=True)
class _WithInput:
    """A kernel's result beside its input."""

    kernel: Distance

    def reach(self, dims: int) -> tuple[int, ...]:
        return self.kernel.reach(dims)

    def __call__(self, image: np.ndarray) -> list[np.ndarray]:
        return [image, self.kernel(image)]


def distance(df: DataFrame, frame: list[str], mask: str, most: float, axes: tuple[str, ...] = ("y", "x"), tiling: Tiling | None = None) -> DataFrame:
    """frame, axes, distance of each mask cell to the nearest cell outside, in cells, clamped to `most`; cells that df lacks are neither."""
    kinds = df.select(*frame, *axes, F.when(F.col(mask), 1.0).otherwise(2.0).alias("_kind"))
    made = frame_kernel(kinds, frame, "_kind", _WithInput(Distance(most)), axes, ["_kind", "distance"], tiling)
    return made.where("_kind = 1").select(*frame, *axes, "distance")


def hull_area(points: np.ndarray) -> float:
    """Pixels of the convex hull of pixel squares in 2D: the area of the hull of all corners."""
    corners = np.unique(np.concatenate([points + d for d in ((0, 0), (0, 1), (1, 0), (1, 1))]), axis=0)

    def half(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(half(corners) + half(corners[::-1]))
    y, x = ring[:, 0], ring[:, 1]
    return abs(float(np.dot(y, np.roll(x, -1)) - np.dot(x, np.roll(y, -1)))) / 2


def hull_volume(points: np.ndarray) -> float:
    """Volume of the convex hull of points with whole coordinates that don't lie in one plane.

    Quickhull: the point farthest beyond a face replaces all faces that it sees, or lies in the plane of, by faces to their rim. Signs of
    determinants are exact in whole numbers, so points in one plane need no tolerance.
    """
    p = np.unique(points.astype(np.int64), axis=0)
    p -= p[0]
    first = [0, int(np.abs(p).sum(axis=1).argmax())]
    first.append(int(np.abs(np.cross(p[first[1]], p)).sum(axis=1).argmax()))
    first.append(int(np.abs(p @ np.cross(p[first[1]], p[first[2]])).argmax()))
    corners, normals, levels, beyond = {}, {}, {}, {}
    owner: dict[tuple[int, int], int] = {}  # face on the left of each directed edge

    def add(a: int, b: int, c: int) -> int:
        k = add.next
        add.next += 1
        corners[k] = (a, b, c)
        normals[k] = np.cross(p[b] - p[a], p[c] - p[a])
        levels[k] = int(normals[k] @ p[a])
        owner[a, b] = owner[b, c] = owner[c, a] = k
        return k

    add.next = 0

    def deal(rows: np.ndarray, faces: list[int]) -> None:
        """Each point goes to the first of the faces that it lies beyond; others are inside."""
        above = p[rows] @ np.stack([normals[k] for k in faces]).T - np.array([levels[k] for k in faces])
        some, to = (above > 0).any(axis=1), (above > 0).argmax(axis=1)
        for j, k in enumerate(faces):
            mine = some & (to == j)
            if mine.any():
                beyond[k] = rows[mine], above[mine, j]

    for a, b, c, d in ((0, 1, 2, 3), (0, 3, 1, 2), (1, 3, 2, 0), (0, 2, 3, 1)):
        a, b, c, d = (first[x] for x in (a, b, c, d))
        add(a, b, c) if np.cross(p[b] - p[a], p[c] - p[a]) @ (p[d] - p[a]) < 0 else add(a, c, b)
    deal(np.arange(len(p)), list(corners))
    while beyond:
        k, (rows, heights) = next(iter(beyond.items()))
        top = int(rows[heights.argmax()])
        seen, todo, rim = {k}, [k], []
        while todo:
            a, b, c = corners[todo.pop()]
            for u, v in ((a, b), (b, c), (c, a)):
                other = owner[v, u]
                if other in seen:
                    continue
                if int(normals[other] @ p[top]) >= levels[other]:
                    seen.add(other)
                    todo.append(other)
                else:
                    rim.append((u, v))
        rim = [(u, v) for u, v in rim if owner[v, u] not in seen]
        left = [beyond.pop(x)[0] for x in seen if x in beyond]
        for x in seen:
            del corners[x], normals[x], levels[x]
        made = [add(u, v, top) for u, v in rim]
        left = np.concatenate(left)
        deal(left[left != top], made)
    return float(sum(levels.values())) / 6


def hull_size(points: np.ndarray) -> float:
    """Cells of the convex hull of whole cells (not of their centres): the area or volume of the hull of all their corners."""
    if points.shape[1] == 2:
        return hull_area(points)
    return hull_volume((points[:, None, :] + (_CUBE[(_CUBE < 2).all(axis=1)])[None]).reshape(-1, 3))


def solidity(labelled: DataFrame, by: list[str], axes: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """by, solidity: cells over those of their convex hull.

    Only the two ends of each line of a region along the last axis can be corners of its hull, so regions meet as lines, counted before. A task
    takes many regions in turn and holds the lines of one.
    """
    schema = ", ".join(f"{labelled.schema[c].name} {labelled.schema[c].dataType.simpleString()}" for c in by) + ", solidity double"
    *across, along = axes
    lines = labelled.groupBy(*by, *across).agg(F.count("*").alias("_n"), F.min(along).alias("_low"), F.max(along).alias("_high"))

    def rate(pdf: pd.DataFrame) -> float:
        at = pdf[across].to_numpy(np.int64)
        ends = np.concatenate([np.column_stack([at, pdf[c].to_numpy(np.int64)]) for c in ("_low", "_high")])
        return pdf["_n"].sum() / hull_size(ends)

    def run(batches):
        held = []  # lines of the last region seen, which may go on in the next batch
        for pdf in batches:
            if not len(pdf):
                continue
            edge = np.flatnonzero((pdf[by].to_numpy()[1:] != pdf[by].to_numpy()[:-1]).any(axis=1)) + 1
            parts = [pdf.iloc[a:b] for a, b in zip([0, *edge], [*edge, len(pdf)], strict=True)]
            if held and (held[-1][by].to_numpy()[-1] != parts[0][by].to_numpy()[0]).any():
                parts.insert(0, pd.concat(held))
                held = []
            elif held:
                parts[0] = pd.concat([*held, parts[0]]) if len(parts) > 1 else parts[0]
                held = held if len(parts) == 1 else []
            held.append(parts.pop())
            if parts:
                yield pd.DataFrame({c: [q[c].iloc[0] for q in parts] for c in by} | {"solidity": [rate(q) for q in parts]})
        if held:
            last = pd.concat(held)
            yield last[by].head(1).assign(solidity=rate(last))

    return lines.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)
