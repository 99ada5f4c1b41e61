"""Each stage of the pipeline on the rows its predecessor kept, against plain loops."""

import math
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from voxframe.llm import jaccard, quality, toxicity
from voxframe.llm.common import table, written
from voxframe.llm.quality import training_labels

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = written(stage(spark, docs, SF), name)
        out.append((docs, kept))
        docs = kept
    return {name: pair for (name, _), pair in zip(corpus_pipeline.STAGES, out, strict=True)}


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.fit_toxicity(before, training_labels(table(spark, SF, "labels"), "toxic", 5, 0))
    restorer = toxicity.Restorer(model.chars)

    def score(text):
        per_run = [toxicity.word_features(restorer.words(r)) for r in set((text or "").split())] + [toxicity.word_features(restorer.spaced(text or ""))]
        return max((model.chance[f] for f in toxicity.document_features(per_run) if f in model.chance), default=model.base)

    assert rows_of(after) == sorted(tuple(r) for r in before.collect() if score(r["text"]) < 0.5)


def plain_probability(forest, x):
    """Tree by tree, step by step."""
    margin = forest.base
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
        at = 0
        for _ in range(forest.depth):
            at = 2 * at + (2 if x[feature[at]] > threshold[at] else 1)
        margin += leaf[at - (2**forest.depth - 1)]
    return 1 / (1 + math.exp(-margin))


def test_good_documents_stay(spark, stages):
    before, after = stages["quality"]
    forest = quality.fit_quality(before, training_labels(table(spark, SF, "labels"), "quality", 4, 2))
    rows = before.collect()
    assert rows_of(after) == sorted(tuple(r) for r in rows if plain_probability(forest, quality.document_statistics((r["text"] or "").encode())) >= 0.7)


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_one_of_each_family_stays(stages):
    before, after = stages["near_duplicates"]
    rows = {r["doc_id"]: r for r in before.collect()}
    sets = {k: sets_of(r["text"]) for k, r in rows.items()}
    root = {k: k for k in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(sorted(rows), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert rows_of(after) == sorted(tuple(rows[k]) for k in rows if find(k) == k)


def words_of(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_documents_with_benchmark_windows_go(spark, stages):
    before, after = stages["decontamination"]
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words_of(r["text"])
        m = min(10, len(w))
        windows |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()

    def hit(text):
        w = words_of(text)
        return any(tuple(w[i : i + m]) in windows for m in {len(x) for x in windows} for i in range(len(w) - m + 1))

    assert rows_of(after) == sorted(tuple(r) for r in before.collect() if not hit(r["text"]))


def test_packed_pieces_hold_all_tokens(stages):
    before, after = stages["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in before.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r["doc_id"], k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    pieces = after.collect()
    assert sorted((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == sorted(want)
    by = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_texts_without_an_id_link(spark):
    words = [f"w{i}" for i in range(60)]
    near = words[:59] + ["other"]
    rows = [(None, " ".join(words)), (7, " ".join(near)), (None, " ".join(words[:58])), (None, "alone in the world of the texts"), (3, "something else that has no copy")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("None", 56, "7"), ("7", 56, "7"), ("None", 54, "7"), ("None", 3, "None"), ("3", 2, "3")])


def test_repeated_labelled_ids_count_once(spark):
    rows = [(i % 30, f"text {i % 30} {'good words here' if i % 2 else '!!! bad'}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, label int")
    once = docs.dropDuplicates(["doc_id", "text"])
    assert np.array_equal(quality.fit_quality(docs, labels).leaf, quality.fit_quality(once, labels).leaf)
    assert docs.where(F.col("doc_id").isNull()).count() == 0
