"""Importance resampling towards a target distribution, through a dictionary of distinct features.

Every distinct n-gram string is counted once over the corpus and hashed once into a bucket. Buckets of the corpus and the target give each
bucket's gain, the dictionary gives each string the gain of its bucket, and documents meet those gains by their own feature counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import drop, written
from voxframe.llm.words import LETTERS, LOWER, buffers, hashes, mixed, portions, spans
from voxframe.operators.order import numbered

#: Features with more than 1 / HEAD of all occurrences, hence fewer than HEAD of them, are told to the tasks if they are at most HEAD_BYTES long; all others are joined.
HEAD, HEAD_BYTES = 200_000, 40


def _features(texts: pa.Array, least: int, most: int) -> tuple[pd.DataFrame, pa.Array, np.ndarray]:
    """Row, feature number and count m of each feature of each text, the features, and the number of words of each text."""
    data, bounds = buffers(texts)
    data = LOWER[data]
    starts, ends, row = spans(data, bounds, LETTERS)
    own = hashes(data, starts, ends)
    grams, found = own, []
    for n in range(1, most + 1):
        if n > 1:
            grams = mixed(grams[:-1], own[n - 1 :]) if len(grams) else grams
        if n >= least:
            at = np.arange(len(grams))
            at = at[row[at] == row[at + n - 1]] if len(at) else at
            found.append((grams[at], at, np.full(len(at), n)))
    h, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
    place = mixed(h, n.astype(np.uint64))
    _, first, code = np.unique(place, return_index=True, return_inverse=True)
    raw = data.tobytes()
    strings = [b" ".join(raw[s:e] for s, e in zip(starts[a : a + k].tolist(), ends[a : a + k].tolist(), strict=True)) for a, k in zip(at[first].tolist(), n[first].tolist(), strict=True)]
    counts = pd.DataFrame({"row": row[at], "code": code}).groupby(["row", "code"]).size().reset_index(name="m")
    return counts, pa.array(strings, pa.binary()).cast(pa.string(), safe=False), np.bincount(row, minlength=len(texts))


def feature_counts(docs: DataFrame, least: int, most: int) -> DataFrame:
    """feature, n: occurrences of every distinct run of `least` to `most` words in all texts; counted in tasks before they are shuffled."""

    def run(batches):
        for b in portions(batches, "text"):
            counts, strings, _ = _features(b.column("text"), least, most)
            n = np.bincount(counts["code"], counts["m"], len(strings)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([strings, pa.array(n)], names=["feature", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _bucket(buckets: int) -> Column:
    return (F.crc32(F.col("feature").cast("binary")) % buckets).alias("bucket")


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain for each bucket with a feature in corpus (feature, n); target: feature, n."""
    of = lambda df, out: df.groupBy(_bucket(buckets)).agg(F.sum("n").alias(out))
    s, t = written(of(corpus, "s"), "buckets"), written(of(target, "t"), "target-buckets")
    total = lambda df, c: float(df.agg(F.sum(c)).first()[0] or 0)
    all_s, all_t = total(s, "s"), total(t, "t")
    ratio = (F.coalesce("t", F.lit(0)) + 1).cast("double") * F.lit(all_s + buckets) / ((F.col("s") + 1).cast("double") * F.lit(all_t + buckets))
    return s.join(F.broadcast(t), "bucket", "left").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))  # at most `buckets` rows


def document_weights(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """row, doc_id, n_words, n_features, weight for every row of docs (doc_id, text); target: text. row is a number of its own."""
    corpus = written(feature_counts(docs, least, most), "features")
    gains = written(bucket_gains(corpus, feature_counts(target, least, most), buckets), "gains")
    dictionary = corpus.withColumn("bucket", _bucket(buckets)).join(F.broadcast(gains), "bucket")  # at most `buckets` gains
    total = corpus.agg(F.sum("n")).first()[0] or 0
    is_head = (F.col("n") * HEAD > total) & (F.octet_length("feature") <= HEAD_BYTES)
    head = dictionary.where(is_head).select("feature", "gain").toArrow()  # below HEAD rows of HEAD_BYTES each
    told = docs.sparkSession.sparkContext.broadcast((head.column("feature").combine_chunks(), head.column("gain").combine_chunks()))
    schema = "doc_id long, n_words long, n_features long, head long, tail array<string>, tail_m array<int>"

    def run(batches):
        known, gain = told.value
        gain = np.asarray(gain, np.int64)
        for b in portions(batches, "text"):
            counts, strings, n_words = _features(b.column("text"), least, most)
            at = np.asarray(pc.fill_null(pc.index_in(strings, value_set=known), -1))
            row, code, m = (counts[c].to_numpy() for c in ("row", "code", "m"))
            found = at[code] >= 0
            weight = np.zeros(b.num_rows, np.int64)
            np.add.at(weight, row[found], gain[at[code[found]]] * m[found])
            features = np.bincount(row, m, b.num_rows).astype(np.int64)
            rest = ~found
            ends = pa.array(np.searchsorted(row[rest], np.arange(b.num_rows + 1)).astype(np.int32))
            tail = pa.ListArray.from_arrays(ends, strings.take(pa.array(code[rest])))
            tail_m = pa.ListArray.from_arrays(ends, pa.array(m[rest], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(features), pa.array(weight), tail, tail_m], names=["doc_id", "n_words", "n_features", "head", "tail", "tail_m"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "weights")
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "tail_m")).alias("x")).select("row", F.col("x.tail").alias("feature"), F.col("x.tail_m").alias("m"))
    rest = tail.join(dictionary.where(~is_head).select("feature", "gain"), "feature").groupBy("row").agg(F.sum(F.col("gain") * F.col("m")).alias("rest"))
    out = written(rows.drop("tail", "tail_m").join(rest, "row", "left").select("row", "doc_id", "n_words", "n_features", (F.col("head") + F.coalesce("rest", F.lit(0))).alias("weight")), "weighed")
    for df in (corpus, gains, rows):
        drop(df)
    return out


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of an id, drawn by sha256; an id that is null is drawn as an empty one."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs (doc_id, text); target: text.

    Words are runs of digits, letters and everything beyond ASCII, A-Z lower-cased; features are all runs of `least` to `most` words, repeats
    counted. Of the N rows with at least least_words words the floor(percent * N / 100) best scores are drawn and ranked from 1; rank is null
    for the others. A draw without replacement by weights is the best of weights with Gumbel noise.

    Null and empty texts have no features, weight 0, and aren't drawn unless least_words is 0; equal scores are ranked by ascending doc_id, a null id last, rows
    of one id in any order; every repeated row is a row of its own; other columns are ignored; an empty table gives no rows, an empty
    target leaves t at 0. Features are told apart by a 64-bit hash inside a portion of 4 MB of texts, by their strings everywhere else.
    """
    weights = document_weights(docs, target, least, most, buckets)
    scored = weights.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    can = F.col("n_words") >= least_words
    drawn = weights.where(can).count() * percent // 100
    order = scored.select("*", (~can).cast("int").alias("_out"), (-F.col("score")).alias("_worse"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_id"))
    placed = numbered(order, ["_out", "_worse", "_id", "row"], "place")
    rank = F.when(can & (F.col("place") < drawn), F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
