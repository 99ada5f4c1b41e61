"""Filter and markers of whole frames against plain loops that share no code with the engine."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.plans.engine import Config, Engine


def table(spark, images):
    """t, axes, v of a list of arrays."""
    axes = ("z", "y", "x")[-images[0].ndim :]
    rows = [(t, *map(int, c), float(image[c])) for t, image in enumerate(images) for c in np.ndindex(image.shape)]
    return spark.createDataFrame(rows, "t int, " + ", ".join(f"{a} int" for a in axes) + ", v double")


def fold(i, n):
    """Mirrored at both ends, the edge repeated."""
    while not 0 <= i < n:
        i = -1 - i if i < 0 else 2 * n - 1 - i
    return i


def weighted(image, weights, axis):
    out = np.zeros_like(image)
    reach = len(weights) // 2
    for c in np.ndindex(image.shape):
        for k, w in enumerate(weights):
            at = list(c)
            at[axis] = fold(c[axis] + k - reach, image.shape[axis])
            out[c] += w * image[tuple(at)]
    return out


def bell(sigma, truncate, second=False):
    reach = int(truncate * sigma + 0.5)
    w = [math.exp(-(x * x) / (2 * sigma * sigma)) for x in range(-reach, reach + 1)]
    w = [v / sum(w) for v in w]
    return [v * (x * x / sigma**4 - 1 / sigma**2) for v, x in zip(w, range(-reach, reach + 1))] if second else w


def log_response(image, vector, sigma):
    total = np.zeros_like(image)
    for axis in range(image.ndim):
        part = image
        for other, s in enumerate(vector):
            part = weighted(part, bell(s, 4.0, other == axis), other)
        total += part
    return -(sigma**2) * total


def histogram(values, bins):
    low, high = min(values), max(values)
    low, high = (low - 0.5, high + 0.5) if low == high else (low, high)
    counts = [0] * bins
    for v in values:
        counts[min(bins - 1, int((v - low) / (high - low) * bins))] += 1
    return counts, [low + (k + 0.5) * (high - low) / bins for k in range(bins)]


def otsu(values, bins):
    counts, centres = histogram(values, bins)
    best, at = None, None
    for k in range(bins):
        w1, w2 = sum(counts[: k + 1]), sum(counts[k + 1 :])
        if w1 and w2:
            m1 = sum(c * x for c, x in zip(counts[: k + 1], centres)) / w1
            m2 = sum(c * x for c, x in zip(counts[k + 1 :], centres[k + 1 :])) / w2
            spread = round(w1 * w2 * (m1 - m2) ** 2, 9)
            if best is None or spread > best:
                best, at = spread, centres[k]
    return at


def triangle(values, bins):
    counts, centres = histogram(values, bins)
    peak = counts.index(max(counts))
    filled = [k for k, c in enumerate(counts) if c]
    if peak - filled[0] < filled[-1] - peak:
        counts, centres = counts[::-1], centres[::-1]
        peak, filled = bins - 1 - peak, [bins - 1 - k for k in filled][::-1]
    low, n = filled[0], sum(counts)
    width, height = peak - low, counts[peak] / n
    length = math.hypot(width, height)
    far = [(round(height / length * (k - low) - width / length * counts[k] / n, 9), -k) for k in range(low, peak)]
    return centres[-max(far)[1]] if far else None


def lower(values, bins):
    both = [x for x in (triangle(values, bins), otsu(values, bins)) if x is not None]
    return min(both) if both else None


def slope(image, axis):
    out = np.zeros_like(image)
    n = image.shape[axis]
    for c in np.ndindex(image.shape):
        a, b = list(c), list(c)
        a[axis], b[axis] = max(0, c[axis] - 1), min(n - 1, c[axis] + 1)
        if a[axis] != b[axis]:
            out[c] = (image[tuple(b)] - image[tuple(a)]) / (b[axis] - a[axis])
    return out


def plain_filter_3d(image, sigmas, bins):
    last, now, responses, masks = 0.0, image, [], []
    for s in sigmas:
        for axis in range(3):
            step = math.sqrt(s * s - last * last)
            now = weighted(now, bell(step, 3.0), axis)
        last = s
        first = [slope(now, a) for a in range(3)]
        h = {(a, b): slope(first[a], b) for a in range(3) for b in range(a, 3)}
        top = max(abs(x).max() for x in h.values())
        matrices = np.array([[h[min(a, b), max(a, b)] for b in range(3)] for a in range(3)])
        norm = np.sqrt((matrices**2).sum(axis=(0, 1))) / top
        gamma = max(lower([v for v in now.ravel() if v > 0], bins), 2.220446049250313e-16)
        bar = (lower([v for v in norm.ravel() if v > 0], bins) or 0.0) / 2
        response = np.zeros_like(image)
        for c in np.ndindex(image.shape):
            l1, l2, l3 = sorted(np.linalg.eigvalsh(matrices[(slice(None), slice(None), *c)]), key=abs)
            if l2 <= 0 and l3 <= 0:
                plate, blob = (abs(l2) / (abs(l3) + 1e-12)) ** 2, (abs(l2) / (math.sqrt(abs(l2 * l3)) + 1e-12)) ** 2
                response[c] = (1 - math.exp(-plate / 0.5)) * math.exp(-blob / 0.5) * (1 - math.exp(-(l1 * l1 + l2 * l2 + l3 * l3) / (2 * gamma * gamma)))
        responses.append(np.where(norm > bar, response, 0))
        masks.append(norm > bar)
    v = np.where(np.logical_and.reduce(masks), np.max(responses, axis=0), 0)
    positive = sorted(v[v > 0])
    place = 0.01 * (len(positive) - 1)
    faint = positive[int(place)] + (place - int(place)) * (positive[min(len(positive) - 1, int(place) + 1)] - positive[int(place)])
    on = {c for c in np.ndindex(v.shape) if v[c] > faint}
    cross = [s for s in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, s)) <= 1]
    moved = lambda c, s: tuple(a + b for a, b in zip(c, s))
    core = {c for c in on if all(moved(c, s) in on for s in cross)}
    opened = {moved(c, s) for c in core for s in cross}
    return np.array([v[c] if c in opened else 0.0 for c in np.ndindex(v.shape)]).reshape(v.shape)


def test_the_filter_of_a_volume(spark):
    rng = np.random.default_rng(3)
    z, y, x = np.indices((9, 14, 15))
    image = np.exp(-((z - 4) ** 2 + (y - 6) ** 2) / 4.0) + 0.6 * np.exp(-((z - 4) ** 2 + (x - 10) ** 2) / 5.0) + rng.random((9, 14, 15)) * 0.02
    config = Config(depth=9, height=14, width=15, bins=32, least_radius=2.0, most_radius=4.5)
    got = np.zeros(image.shape)
    for r in Engine(config).vesselness(table(spark, [image])).collect():
        got[r["z"], r["y"], r["x"]] = r["v"]
    want = plain_filter_3d(image, config.sigmas, 32)
    assert (want > 0).sum() > 20 and np.allclose(got, want, atol=1e-7)


def plain_hu(box):
    """-sign * log10 of six invariants of the moments of a plane."""
    y, x = np.indices(box.shape)
    m = box.sum()
    cy, cx = (box * y).sum() / m, (box * x).sum() / m
    n = lambda p, q: (box * (x - cx) ** p * (y - cy) ** q).sum() / m ** (1 + (p + q) / 2)
    a, b, c, d, e = n(3, 0) + n(1, 2), n(2, 1) + n(0, 3), n(3, 0) - 3 * n(1, 2), 3 * n(2, 1) - n(0, 3), n(2, 0) - n(0, 2)
    six = [n(2, 0) + n(0, 2), e * e + 4 * n(1, 1) ** 2, c * c + d * d, a * a + b * b, c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b), e * (a * a - b * b) + 4 * n(1, 1) * a * b]
    return [0.0 if v == 0 else -math.copysign(1, v) * math.log10(abs(v)) for v in six]


@pytest.mark.parametrize("peaks_from", ["distance", "vesselness"])
def test_markers_of_frames(spark, peaks_from):
    rng = np.random.default_rng(6)
    y, x = np.indices((18, 20))
    image = np.exp(-((y - 6) ** 2 + (x - 7) ** 2) / 9.0) + 0.8 * np.exp(-((y - 12) ** 2 / 4 + (x - 13) ** 2 / 20)) + rng.random((18, 20)) * 0.05
    ves = image**2
    config = Config(height=18, width=20, least_marker_radius=1.0, most_marker_radius=3.0, scales=3, peak_distance=2, peaks_from=peaks_from)
    labels = table(spark, [image]).where("v > 0.3").select("t", "y", "x", F.lit(1).alias("label"))
    got = {(r["y"], r["x"]): r for r in Engine(config).markers(labels, table(spark, [image]), table(spark, [ves])).collect()}

    mask = image > 0.3
    outside = np.argwhere(~mask)
    far = np.zeros(image.shape)
    for c in np.argwhere(mask):
        far[tuple(c)] = min(config.reach, math.sqrt(((outside - c) ** 2).sum(axis=1).min()))
    base, best, marks = far if peaks_from == "distance" else ves, np.zeros(image.shape), set()
    window = lambda a, c, reach: a[max(0, c[0] - reach) : c[0] + reach + 1, max(0, c[1] - reach) : c[1] + reach + 1]
    for s in config.marker_sigmas:
        response = np.maximum(log_response(base, (s, s), s), 0)
        peaks = [c for c in np.ndindex(image.shape) if response[c] == window(response, c, 1).max() and response[c] > best[c]]
        for c in peaks:
            best[c] = response[c]
            marks.add(c)
    marks = {c for c in marks if far[c] > 0}
    bright = {c for c in marks if image[c] == max(image[d] for d in marks if max(abs(d[0] - c[0]), abs(d[1] - c[1])) <= 2)}
    assert set(got) == bright and len(bright) >= 2
    for c in bright:
        r = math.ceil(2 * window(far, c, 1).max())
        box, tube = window(image, c, r), window(ves, c, r)
        assert got[c]["id"] == c[0] * 20 + c[1]
        assert got[c]["stats"] == pytest.approx([box.mean(), box.var(), tube.mean(), tube.var()])
        assert got[c]["hu"] == pytest.approx(plain_hu(box), abs=1e-6)
