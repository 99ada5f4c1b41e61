"""Hot keys: rows repeated in bulk and ids that are lacking in bulk don't meet in one task."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from voxframe.llm import fingerprints, packing


def test_equal_rows_are_spread_over_blocks(spark):
    pieces = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1000).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    out = packing.pack(pieces, 4096, block_rows=25_000)
    blocks = out.groupBy(F.shiftright("sequence_id", 32).alias("b")).agg(F.count("*").alias("n")).collect()
    assert len(blocks) == 8 and all(20_000 < r["n"] < 30_000 for r in blocks)
    full = out.groupBy("sequence_id").agg(F.count("*").alias("n"), F.min("offset").alias("low"), F.max("offset").alias("high"))
    assert full.where("n > 4 or low != 0 or high != 1000 * (n - 1)").isEmpty() and out.count() == 200_000


def test_rows_without_ids_are_cut_into_ranges(spark):
    rows = [(None if i % 2 else i, f"text {i}") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    led = fingerprints.with_next(docs, ["text"], per_block=1_000)
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0]))
    nones = {t for i, t in order if i is None}
    got = {(r["doc_id"], r["text"]): r["next_text"] for r in led.collect()}
    assert len(got) == 20_000
    # those without an id lead through all of their kind, then to the least id; ids lead in order, the last to the first row
    with_id = [t for i, t in order if i is not None]
    assert [got[i, f"text {i}"] for i in range(0, 20_000, 2)][:-1] == with_id[1:]
    text, seen = got[19_998, "text 19998"], set()
    while text in nones:
        assert text not in seen
        seen.add(text)
        text = got[None, text]
    assert seen == nones and text == "text 0"
    sizes = led.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 15_000


def test_edited_texts_of_rows_without_ids(spark):
    rows = [(None, "b" * 10), (None, "a" * 4), (3, "cc"), (None, None)]
    out = fingerprints.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 4 and {r["n_chars"] for r in out} == {10, 4, 2, 0}
    assert [r["edited_sha256"] for r in out if r["n_chars"] == 0] == [hashlib.sha256(b"").hexdigest()]


def test_bitmaps_of_large_sets_bound_their_difference(spark):
    from voxframe.llm import jaccard

    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 40_000, np.uint64))
    rows, want = [], []
    for n, m, both in ((1000, 1024, 900), (1020, 1030, 1000), (1024, 1025, 0), (4000, 4800, 3990), (4096, 4097, 3000), (4096, 5000, 10), (30_000, 36_000, 29_000), (33_000, 33_000, 5000), (33_000, 35_000, 32_900)):
        a, b = base[:n], base[n - both : n - both + m]
        same = len(np.intersect1d(a, b))
        rows.append((len(rows), len(a), len(b), jaccard.parity_bits(a).tolist(), jaccard.parity_bits(b).tolist()))
        want.append(5 * same >= 4 * (len(a) + len(b) - same))
    df = spark.createDataFrame(rows, "i int, n1 int, n2 int, b1 array<long>, b2 array<long>")
    got = [r["ok"] for r in df.select("i", jaccard.may_reach(F.col("n1"), F.col("n2"), F.col("b1"), F.col("b2")).alias("ok")).orderBy("i").collect()]
    assert all(g for g, w in zip(got, want, strict=True) if w)  # no link is lost
    assert [got[i] for i in (2, 5, 7)] == [False] * 3  # large sets of little in common are told apart
