"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: every operator and stage."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from voxframe.llm import chat, decontamination, fingerprints, jaccard, langid, lm, packing, quality, sharding, toxicity
from voxframe.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _block int, n long"
LONG = "alpha beta gamma delta " * 8000
TEXTS = [None, "", " \t\n", "one", LONG, "the same words again and again here", "the same words again and again here", "ÉÀ ß Ω <|endoftext|> <|im_end|> \x1c İ", "a", "1d10t l0ser $$$ %%%"]
VOCABULARY = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 3 == 0 else "en", None, None, 1.0, 2, 3) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "no id at all but some words", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(len(TEXTS))] + [(3, None), (None, 1), (99, 1)], "doc_id long, label int")


def _run(name, df, labels):
    spark = df.sparkSession
    if name == "sharding":
        return sharding.shard_documents(df, 3)
    if name == "toxicity":
        return toxicity.score_toxicity(df, toxicity.fit_toxicity(df, labels))
    if name == "decontamination":
        items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "alpha beta gamma delta " * 3), (4, "alpha beta gamma delta " * 3)], "item_id int, text string")
        return decontamination.find_benchmark(df, items)
    if name == "fingerprints":
        return fingerprints.edited_likeness(df)
    if name == "lm":
        counts = written(lm.corpus_counts(df), "test")
        return lm.score_lm(df, counts, lm.fit_lm(df, counts))
    if name == "langid":
        return langid.predict_languages(df, langid.fit_languages(df, langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))))
    if name == "quality":
        return quality.score_quality(df, quality.fit_quality(df, labels))
    if name == "jaccard":
        return jaccard.near_duplicates(df)
    return packing.pack_documents(df, public_tokenizers.path(VOCABULARY))


NAMES = ["sharding", "toxicity", "decontamination", "fingerprints", "lm", "langid", "quality", "jaccard", "packing"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, docs, labels):
    rows = _run(name, docs, labels).collect()
    if name == "packing":
        by = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        assert {r["doc_id"] for r in rows} == {None, *range(len(TEXTS))}
        return
    assert len(rows) == docs.count()
    if name == "sharding":
        sizes = [sum(r["shard"] == s for r in rows) for s in range(3)]
        assert max(sizes) - min(sizes) <= 1
        assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in enumerate(sizes))
    if name == "decontamination":
        hit = {r["doc_id"]: (r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in rows}
        assert hit[0] == (0, 0, ()) and hit[3] == (1, 1, ("3",)) and hit[4][0] == 32000 and hit[4][1] == 32000 and hit[4][2] == ("4",)
    if name == "jaccard":
        got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
        assert got[0]["n_shingles"] == 0 and got[1]["component_id"] == 1 and got[3]["n_shingles"] == 1 and got[6]["component_id"] == 5
    if name == "langid":
        assert {r["doc_id"]: r["lang_pred"] for r in rows}[0] == "und"
    if name in ("toxicity", "quality"):
        assert all(0 <= r[f"{'toxic' if name == 'toxicity' else 'quality'}_score"] <= 1 for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(name, docs, labels):
    assert _run(name, docs.where("1 = 0"), labels).count() == 0


def test_pipeline_stages_on_odd_rows(spark, docs, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta " * 3)], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        if name != "packing":
            assert out.columns == docs.columns
        now = written(out, name)
    left = {r["doc_id"] for r in now.select("doc_id").distinct().collect()}
    assert 4 not in left and 5 in left and 6 not in left and None in left
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("1 = 0"), folder).count() == 0


def test_columns_named_like_the_stages_own_keep_their_values(spark, tmp_path):
    folder = str(tmp_path)
    names = ["toxic_score", "toxic_predicted", "Quality_score", "quality_predicted", "own_toxic_score", "copy", "_copy", "_canon", "fingerprint", "c", "token", "h", "no_id"]
    rows = [(i, f"some words of text number {i} that differ " * 3, *range(10 * i, 10 * i + len(names))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "words that are nowhere in these texts at all so none goes")], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(map(tuple, stage(spark, docs, folder).collect())) == rows
    assert fingerprints.with_fingerprint(docs).drop("fingerprint").columns == [c for c in docs.columns if c != "fingerprint"]


def test_chat_round_trip_of_odd_turns(spark):
    says = ["", None, "<|im_end|>", "\\", "<\\|", "\\<|im_sep|>\\", "<", "|im_end|>", "a\nb", "<|" * 5000]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", s, 0) for i, s in enumerate(says)] + [(2, 0, None, "x", 0), (2, 0, "a<|b", "y", 0), (None, None, "user", None, 0)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"))
    got = {r["conv_id"]: r for r in out.withColumn("turns", chat.parse_formatted(F.col("formatted"))).withColumn("lost", chat.loss_text(F.col("segments"))).collect()}
    assert [t["text"] for t in got[1]["turns"]] == [s or "" for s in says]
    assert got[1]["lost"] == "".join(s or "" for s in says[1::2]) and got[1]["valid"]
    assert [tuple(t) for t in got[2]["turns"]] == [("", "x"), ("a<|b", "y")] and not got[2]["valid"]
    assert got[None]["n_turns"] == 1 and len(got) == 3


def test_chat_of_no_rows(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
