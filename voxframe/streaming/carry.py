"""Frames as a stream: what the last frame held carried forward as state of each image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "image_id long, t int, n int, change int"
STATE = "t int, n int"


def object_counts(frames: DataFrame) -> DataFrame:
    """image_id, t, n, change: objects of each arriving frame, and how many more than in the image's last frame seen.

    frames: a stream of (image_id, t, labels array). State is one row an image; frames of a batch are taken in order
    of t, and one that is not later than the last seen is reported without a change.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        out = []
        for r in rows.itertuples():
            n = len(set(r.labels) - {0})
            late = last is not None and r.t <= last[0]
            out.append((key[0], r.t, n, None if last is None or late else n - last[1]))
            last = last if late else (int(r.t), n)
        state.update(last)
        yield pd.DataFrame(out, columns=["image_id", "t", "n", "change"]).astype({"change": "Int32", "n": "int32", "t": "int32"})

    return frames.select("image_id", "t", F.col("labels")).groupBy("image_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


MARKER_STATE = "t int, n int, id array<long>, at array<double>, stats array<double>, hu array<double>"


def _standard(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-8)


def _matched(pre: tuple[np.ndarray, ...], post: tuple[np.ndarray, ...], gate: float, most_cost: float) -> list[tuple[int, int, float]]:
    """Places (pre, post) and cost of the flow rows between two frames: the best pre of each post, then the best post of each pre."""
    (id_a, at_a, stats_a, hu_a), (id_b, at_b, stats_b, hu_b) = pre, post
    apart = np.sqrt(((at_a[:, None] - at_b[None]) ** 2).sum(axis=2))
    i, j = np.nonzero(apart < gate)
    if not len(i):
        return []
    parts = [_standard(apart[i, j][:, None] / gate), _standard(np.abs(stats_a[i] - stats_b[j])), _standard(np.abs(hu_a[i] - hu_b[j]))]
    cost = sum(p.mean(axis=1) for p in parts)
    key = np.round(cost + 1e-9, 6)
    out = []
    for own, other in ((j, id_a[i]), (i, id_b[j])):
        order = np.lexsort((other, key, own))
        first = order[np.concatenate([[True], np.diff(own[order]) != 0])]
        out += [(int(i[k]), int(j[k]), float(cost[k])) for k in first if key[k] <= most_cost]
    return out


def marker_flow(markers: DataFrame, axes: tuple[str, ...], gate: float, most_cost: float = 1.0) -> DataFrame:
    """image_id, t, pre, post, axes, d<axis>, cost: flow rows between each frame's markers and those of the image's frame before, as they arrive.

    markers: a stream of (image_id, t, id, axes in micrometres, stats, hu) that brings whole frames. State is the last frame's markers of each image; frames
    of a batch are taken in order of t, one that isn't the next leaves a gap without flow, and one that is not later than the last is left
    out. The rows are those of track_markers over the same frames.
    """
    place = ", ".join(f"{a} double" for a in axes)
    out = f"image_id long, t int, pre long, post long, {place}, " + ", ".join(f"d{a} double" for a in axes) + ", cost double"
    names = [c.split(" ")[0] for c in out.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, held = None, None
        if state.exists:
            t, n, ids, at, stats, hu = state.get
            last, held = t, (np.array(ids, np.int64), *(np.array(x, float).reshape(n, -1) for x in (at, stats, hu)))
        rows = []
        for t, frame in pd.concat(list(batches)).groupby("t", sort=True):
            if last is not None and t <= last:
                continue
            frame = frame.sort_values("id")
            now = (frame["id"].to_numpy(np.int64), frame[list(axes)].to_numpy(float), *(np.array(frame[c].tolist(), float) for c in ("stats", "hu")))
            if last is not None and t == last + 1:
                for i, j, cost in _matched(held, now, gate, most_cost):
                    rows.append((key[0], last, held[0][i], now[0][j], *held[1][i], *(now[1][j] - held[1][i]), cost))
            last, held = int(t), now
        if last is not None:
            state.update((last, len(held[0]), held[0].tolist(), *(x.ravel().tolist() for x in held[1:])))
        yield pd.DataFrame(rows, columns=names).astype({"image_id": "int64", "t": "int32", "pre": "int64", "post": "int64"})

    picked = markers.select(F.col("image_id").cast("long").alias("image_id"), F.col("t").cast("int").alias("t"), F.col("id").cast("long").alias("id"), *[F.col(a).cast("double").alias(a) for a in axes], "stats", "hu")
    return picked.groupBy("image_id").applyInPandasWithState(step, out, MARKER_STATE, "append", GroupStateTimeout.NoTimeout)
