"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat arrays."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import bounded_sample, id_bucket, slices, texts_of

#: Names of the statistics, in the order of their columns.
STATISTICS = (
    "log_bytes", "log_words", "word_len_mean", "upper_share", "digit_share", "space_share", "high_share", "punct_share",
    "bang_share", "pipe_share", "symbol_share", "quote_share", "stop_share", "comma_share", "newline_share", "bracket_share",
    "distinct_share", "top_word_share", "same_next_share", "line_len_mean", "line_distinct_share",
    "line_upper_max", "line_symbol_max", "line_repeat_max", "byte_entropy", "repeat_char_share",
)

_KIND = np.zeros(256, np.int64)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[128:] = 4
for _k, _chars in ((5, b"!?"), (6, b"|"), (7, b"%$&*#@^~=+_<>\\/"), (8, b"\"'`"), (9, b"."), (10, b",;:"), (11, b"\n"), (12, b"()[]{}-")):
    _KIND[list(_chars)] = _k
_KINDS = 13
_WORD = re.compile(rb"[^\x00-\x20]+")


def document_statistics(text: bytes | None) -> np.ndarray:
    """STATISTICS of one whole text; null and empty texts give zeros."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    by_byte = np.bincount(raw, minlength=256)
    kind = np.bincount(_KIND, weights=by_byte, minlength=_KINDS)
    words = text.split()
    m = max(1, len(words))
    count = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    p = by_byte[by_byte > 0] / n
    out[0], out[1], out[2] = np.log1p(n), np.log1p(len(words)), (n - kind[3] - kind[11]) / m
    out[3:16] = kind[[1, 2, 3, 4, 0, 5, 6, 7, 8, 9, 10, 11, 12]] / n
    out[7] = kind[5:].sum() / n
    out[16] = len(count) / m
    out[17] = max(count.values(), default=0) / m
    out[18] = sum(map(bytes.__eq__, words, words[1:])) / m
    out[19] = np.log1p(n / max(1, len(lines)))
    out[20] = len(set(lines)) / max(1, len(lines))
    if lines:
        per_kind = _KIND[raw]
        starts = np.concatenate(([0], np.flatnonzero(raw == 10) + 1))
        starts = starts[starts < n]
        length = np.maximum(np.diff(np.append(starts, n)), 20)
        out[21] = (np.add.reduceat(per_kind == 1, starts, dtype=np.int64) / length).max()
        out[22] = (np.add.reduceat((per_kind >= 5) & (per_kind <= 7), starts, dtype=np.int64) / length).max()
        out[23] = max(sum(map(bytes.__eq__, w, w[1:])) / max(8, len(w)) for w in map(bytes.split, lines))
    out[24] = -(p * np.log2(p)).sum()
    out[25] = np.count_nonzero(raw[1:] == raw[:-1]) / n
    return out


@dataclass
class Forest:
    """Complete binary trees as flat arrays: node i of a tree has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    base: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for each row, all trees and rows stepped down together."""
        if not len(x):
            return np.zeros(0)
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        margin = self.base + self.leaf[trees, at - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 5) -> Forest:
    """Boost log-loss trees on binned columns. One class or no rows: a constant forest."""
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, 2**depth)), base, depth)
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.column_stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(f)])
    flat = binned + np.arange(f) * bins
    margin = np.full(n, base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within the level
        for level in range(depth):
            width = 2**level
            key = (node[:, None] * (f * bins) + flat).ravel()
            sums = [np.bincount(key, np.repeat(v, f), minlength=width * f * bins).reshape(width, f, bins) for v in (g, h, np.ones(n))]
            left = [s.cumsum(axis=2) for s in sums]
            total = [s[:, :, -1:] for s in left]
            gain = left[0] ** 2 / (left[1] + l2) + (total[0] - left[0]) ** 2 / (total[1] - left[1] + l2) - total[0] ** 2 / (total[1] + l2)
            gain[(left[2] < least) | (total[2] - left[2] < least)] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            top = gain.reshape(width, -1)[np.arange(width), best]
            own, cut = best // bins, best % bins
            for k in np.flatnonzero(top > 1e-6):
                if cut[k] < len(cuts[own[k]]):
                    feature[t, width - 1 + k], threshold[t, width - 1 + k] = own[k], cuts[own[k]][cut[k]]
            at = width - 1 + node
            node = 2 * node + (x[np.arange(n), feature[t, at]] > threshold[t, at])
        gs, hs = np.bincount(node, g, minlength=2**depth), np.bincount(node, h, minlength=2**depth)
        leaf[t] = -rate * gs / (hs + l2)
        margin += leaf[t][node]
    return Forest(feature, threshold, leaf, base, depth)


def _with_statistics(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep and `stats` (array of STATISTICS) of each row's text."""
    fields = [df.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in slices(batches):
            texts = b.column(b.num_columns - 1).to_pylist()
            stats = [document_statistics(x) for x in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(stats, pa.list_(pa.float64()))], names=[*keep, "stats"])

    return df.select(*keep, F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 12_000) -> Forest:
    """Fit on at most `most` labelled documents (doc_id, text; doc_id, label 0 or 1).

    Only their statistics come to the driver. Null ids, texts or labels teach nothing; an id that is
    repeated counts once, with its text of the least hash. Without labels of both classes the forest is constant.
    """
    known = labels.select("doc_id", F.col("label").cast("double").alias("label")).where("doc_id is not null and label is not null")
    chosen = bounded_sample(known.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", most)
    joined = texts_of(docs, chosen).join(F.broadcast(chosen), "doc_id")  # chosen has at most `most` rows
    got = _with_statistics(joined.select("doc_id", "label", "text"), ["doc_id", "label"]).toPandas().sort_values("doc_id", kind="stable")
    if not len(got):
        return fit_forest(np.zeros((0, len(STATISTICS))), np.zeros(0))
    return fit_forest(np.vstack(got["stats"]), got["label"].to_numpy())


def score_quality(docs: DataFrame, forest: Forest, cut: float = 0.7) -> DataFrame:
    """docs with quality_score (chance of good quality) and quality_predicted (1 if score >= cut).

    Every column and row of docs stays, names that clash are replaced. Null and empty texts have the
    score of all-zero statistics; whole texts are read, whatever their length.
    """
    keep = [c for c in docs.columns if c not in ("quality_score", "quality_predicted")]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("quality_score", T.DoubleType()), T.StructField("quality_predicted", T.IntegerType())])
    model = docs.sparkSession.sparkContext.broadcast(forest)  # trees * 2**depth numbers

    def run(batches):
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            x = np.vstack([document_statistics(t) for t in texts]) if texts else np.zeros((0, len(STATISTICS)))
            p = model.value.probability(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= cut).astype(np.int32))], names=[*b.schema.names, "quality_score", "quality_predicted"])

    return docs.select(*keep).mapInArrow(run, schema)


def training_labels(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """doc_id and label of the rows outside the held-out fold."""
    return labels.where(id_bucket("doc_id", modulus) != held_out).select("doc_id", F.col(column).alias("label"))
